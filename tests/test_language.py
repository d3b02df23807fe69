"""Numbers as they are said, one-to-one matching and dictionaries against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from trivalent.functions import numbers
from trivalent.operators import dictionary, matching
from trivalent.plans import language_plans


def test_numbers_survive_being_spoken(spark):
    rng = random.Random(1)
    some = [*range(10_001), *(rng.randrange(10 ** rng.randrange(4, 10)) for _ in range(3000)), 10**9, 10**12 + 5, 99_99_99_999, 250_000]
    df = spark.createDataFrame([(n,) for n in some], "n long").withColumn("said", numbers.hindi_words(F.col("n"))).withColumn("again", numbers.number(F.col("said")))
    assert df.where("not (n <=> cast(again as bigint))").limit(3).collect() == []
    said = {r.n: r.said for r in df.where("n in (0, 100, 150, 1005, 250000, 9999)").collect()}
    assert said == {0: "शून्य", 100: "सौ", 150: "एक सौ पचास", 1005: "एक हजार पांच", 250000: "दो लाख पचास हजार", 9999: "नौ हजार नौ सौ निन्यानवे"}
    assert len(set(numbers.HINDI)) == 100 and len(set(numbers.LATIN)) == 99
    assert spark.range(1).select(numbers.hindi_words(F.lit(-5))).first()[0] == "माइनस पांच"


SAID = [
    ("दो लाख पचास हजार", [250000]), ("सैंतालीस लाख", [4700000]), ("बावन", [52]), ("इकतीस", [31]), ("one lakh", [100000]), ("डेढ़ लाख", [150000]), ("ढाई हजार", [2500]), ("सवा लाख", [125000]), ("सवा दो लाख", [225000]),
    ("पौने दो लाख", [175000]), ("पौने लाख", [75000]), ("साढ़े तीन लाख", [350000]), ("डेढ़ सौ", [150]), ("सवा सौ", [125]), ("2.5 लाख", [250000]), ("Rs. 1,20,000 per year", [120000]), ("₹50k", [50000]), ("50 60", [50, 60]),
    ("two thousand crore", [20_000_000_000]), ("twenty five thousand three hundred and forty two", [25342]), ("एक करोड़ दो लाख तीन हजार चार सौ पांच", [10203405]), ("एक लाख दो लाख", [100000, 200000]), ("18 से 40 वर्ष", [18, 40]),
    ("nothing", []), ("", []), ("लाख", []), ("५ लाख और २० हजार", [520000]), ("1 lakh for 2", [100000, 2]), ("age 62, income 3 lakh", [62, 300000]), ("3 lakh 50", [300050]), ("ek lakh assi hazar", [180000]), ("two hundred, three hundred", [200, 300]),
    ("साढ़े", [1.5]), ("1.5 crore 2 lakh", [15200000]),
]


def test_numbers_of_utterances(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SAID)] + [(99, None)], "i long, s string").select("i", numbers.numbers(F.col("s")).alias("n"))
    got = {r.i: None if r.n is None else [x.value for x in r.n] for r in df.collect()}
    assert {SAID[i][0]: v for i, v in got.items() if i < 99 and v != SAID[i][1]} == {} and got[99] is None


def test_ranges_bounds_and_approximations(spark):
    said = ["एक से डेढ़ लाख के बीच", "1 से 2 लाख", "18-40", "5 to 3", "2 लाख से कम", "more than three lakh", "तीन लाख से ज्यादा", "लगभग दो लाख", "two and three", None, "1,000 to 2,000 people", "between one lakh and two lakh", "between 18 and 40"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i long, s string")
    c = F.col("s")
    got = {r.i: r for r in df.select("i", numbers.number_range(c).alias("r"), numbers.bounds(c).alias("b"), numbers.about(c).alias("a")).collect()}
    assert {i: tuple(r.r) for i, r in got.items() if r.r} == {0: (100000, 150000), 1: (100000, 200000), 2: (18, 40), 10: (1000, 2000), 11: (100000, 200000), 12: (18, 40)}
    assert {i: tuple(r.b) for i, r in got.items() if tuple(r.b) != (None, None)} == {4: (None, 200000), 5: (300000, None), 6: (300000, None)}
    assert [i for i, r in got.items() if r.a] == [7]


def greedy(pairs):
    taken, used_l, used_r = set(), set(), set()
    for _, a, b in sorted((-(s if s is not None else float("-inf")), a, b) for a, b, s in pairs):
        if a not in used_l and b not in used_r:
            taken.add((a, b))
            used_l.add(a)
            used_r.add(b)
    return taken


def test_rounds_of_mutual_best_are_greedy(spark):
    rng = random.Random(2)
    rows = []
    for case in range(60):
        n = rng.randrange(1, 9)
        rows += [(case, a, b, rng.choice([None, 0.1, 0.5, 0.5, 0.9])) for a in range(n) for b in range(n) if rng.random() < 0.7]
    rows += [(100, i, j, float(i + j)) for i in range(12) for j in (i, i + 1)]  # a chain
    rows += [(101, None, 1, 1.0), (101, 1, None, 1.0), (102, 1, 1, 0.1), (102, 1, 1, 0.1)]
    got = matching.one_to_one(spark.createDataFrame(rows, "case long, l long, r long, s double"), "case", "l", "r", "s").collect()
    want = {(c, *p) for c in {r[0] for r in rows} for p in greedy([r[1:] for r in rows if r[0] == c and None not in r[1:3]])}
    assert len(got) == len(want) and {(r.case, r.l, r.r) for r in got} == want
    assert matching.one_to_one(spark.createDataFrame([], "case long, l long, r long, s double"), "case", "l", "r", "s").collect() == []


def test_rounds_are_dealt_by_their_rows(spark, monkeypatch):
    """Every shuffle of the rounds has a partition for so many rows left, whatever spark.sql.shuffle.partitions is."""
    rows = [(case, a, b, float((7 * a + 5 * b) % 4)) for case in range(50) for a in range(3) for b in range(3)]
    monkeypatch.setattr(matching, "PART_ROWS", 8)
    seen, plain = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df: seen.append(df.rdd.getNumPartitions()) or plain(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = matching.one_to_one(spark.createDataFrame(rows, "case long, l long, r long, s double"), "case", "l", "r", "s").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r.case, r.l, r.r) for r in got} == {(c, *p) for c in range(50) for p in greedy([r[1:] for r in rows if r[0] == c])}
    assert seen[1:3] == [15, 15]  # 450 pairs


def test_facts_and_scores(spark):
    ddl = "case long, n long, field string, op string, value string"
    expected = [(1, 1, "Eligibility/age[0]", "GTE", "18"), (1, 2, "eligibility.age", "LTE", "60"), (1, 3, "benefits.amount", None, "1,000"), (2, 1, "x.a", "EQ", "yes"), (3, 1, "x.a", "EQ", "Hello, World")]
    found = [(1, 1, "eligibility.AGE", "gte", "18.0"), (1, 2, "eligibility.rules.age", "LT", "60"), (1, 3, "other.amount", None, "1"), (2, 5, "x-a", "EQ", "true"), (3, 1, "x.a", "EQ", "hello world"), (4, 1, "x.a", None, "1")]
    pairs = matching.fact_pairs(spark.createDataFrame(expected, ddl), spark.createDataFrame(found, ddl), "case")
    got = {r.case: r for r in matching.case_scores(pairs, "case").collect()}
    assert [tuple(got[1])[1:4], got[1].value_accuracy, got[1].op_accuracy, got[1].strict] == [(2, 1, 1), 1.0, 0.5, False]
    assert tuple(got[2])[1:4] == (0, 1, 1)  # x-a is x_a, another field
    assert got[3].strict and tuple(got[3])[1:7] == (1, 0, 0, 1.0, 1.0, 1.0)
    assert (got[4].precision, got[4].recall, got[4].f1) == (0.0, 1.0, 0.0)
    total = matching.totals(matching.case_scores(pairs, "case").withColumn("all", F.lit(1)), "all").first()
    assert (total.cases, total.strict_rate, total.precision, total.recall) == (4, 0.25, 0.5, 0.6)


def plain_mentions(text, names, overlapping):
    words = re.findall(r"[^\W_]+", text.lower())
    found = []
    for spelled in sorted(names):
        p = re.findall(r"[^\W_]+", spelled.lower())
        found += [(i, i + len(p), spelled) for i in range(len(words) - len(p) + 1) if p and words[i : i + len(p)] == p]
    if overlapping:
        return sorted(found)
    out, free = [], 0
    for m in sorted(found, key=lambda m: (m[0], -m[1])):
        if m[0] >= free:
            out.append(m)
            free = m[1]
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_mentions_are_the_plain_ones(spark, shard_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice(["aa", "b", "C", "éa", "ab", "aab"])
    names = list({" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(40)}) + ["", "!!", "x y"]
    lowered = {}
    for n in names:
        lowered.setdefault(n.lower(), n)
    names = sorted(lowered.values())
    texts = [(i, rng.choice([" ", ", ", "\n", "--"]).join(word() for _ in range(rng.randrange(30)))) for i in range(80)] + [(200, None), (201, ""), (202, "x, Y")]
    docs, table = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names] + [(None,)], "n string")
    for overlapping in (False, True):
        got = dictionary.mentions(docs, "id", "text", table, "n", overlapping, shard_bytes)
        rows = sorted((r.id, r.at, r.to, r.name) for r in got.collect())
        assert rows == sorted((i, *m) for i, t in texts for m in plain_mentions(t or "", names, overlapping))
    first = {r.id: r.name for r in dictionary.first_mention(dictionary.mentions(docs, "id", "text", table, "n"), "id").collect()}
    assert first == {i: plain_mentions(t or "", names, False)[0][2] for i, t in texts if plain_mentions(t or "", names, False)}
    assert dictionary.mentions(docs, "id", "text", table.limit(0), "n").collect() == []


def test_texts_are_read_once_for_many_names(spark):
    docs = spark.createDataFrame([(i, f"w{i} of w{i + 1} and x") for i in range(50)], "id int, text string")
    names = spark.createDataFrame([(f"w{i}{end}",) for i in range(60) for end in ("", " and X", " of")], "n string")
    found = dictionary.mentions(docs, "id", "text", names, "n", True, 100)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = [(i, n, at, to) for i in range(50) for n, at, to in ((f"w{i}", 0, 1), (f"w{i} of", 0, 2), (f"w{i + 1}", 2, 3), (f"w{i + 1} and X", 2, 5))]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_only_the_way_asked_for_is_said_and_words_are_taken_once(spark, sf):
    plan = language_plans.spoken_amounts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at(array(" not in plan and "RepartitionByExpression" in plan
    found = spark.createDataFrame([("between two and nine lakh",)], "s string").select("s", numbers.numbers(F.col("s")).alias("found"))
    read = found.select(numbers.number_range(F.col("s"), F.col("found")).alias("r"))
    assert read._jdf.queryExecution().analyzed().toString().split("\n")[0].count("regexp_extract_all") == 1
    assert tuple(read.first().r) == (200000.0, 900000.0)
