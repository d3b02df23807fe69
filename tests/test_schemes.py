"""Criteria in words, sections and base documents against plain versions."""

import random

from pyspark.sql import functions as F

from trivalent.functions import numbers
from trivalent.operators import candidates, criteria, sections

SAID = {
    "आयु 25 वर्ष या अधिक": ("age", "GTE", 25, 25, None, None), "Age between 18 and 40 years": ("age", "BETWEEN", 18, 40, None, None), "18 से 40 वर्ष": ("age", "BETWEEN", 18, 40, None, None),
    "पारिवारिक आय दो लाख से अधिक नहीं": ("family_income", "LTE", 200000, 200000, None, None), "annual income less than 1.5 lakh": ("annual_income", "LT", 150000, 150000, None, None), "applicant must be a resident": ("residency", "EQ", None, None, ["rajasthan"], None),
    "only women may apply": ("gender", "EQ", None, None, ["female"], None), "पुरुष": ("gender", "EQ", None, None, ["male"], None), "SC or ST caste": ("social_category", "IN", None, None, ["sc", "st"], None), "अनुसूचित जाति": ("social_category", "EQ", None, None, ["sc"], None),
    "disability of 40%": ("disability_percentage", "GTE", 40, 40, None, None), "दिव्यांग": ("disability_status", "EQ", None, None, None, True), "BPL card": ("bpl_status", "EQ", None, None, None, True), "at least 3 cows": ("CUSTOM", "GTE", 3, 3, None, None),
    "owns a Farm ": ("CUSTOM", "EQ", None, None, ["owns a farm"], None),
}


def test_criteria_are_conditions(spark):
    df = spark.createDataFrame([*enumerate(SAID)], "i long, s string").select("i", "s", F.explode(F.array(numbers.numbers(F.col("s")))).alias("n"))
    got = {r.s: (r.c.field, r.c.op, r.c.low, r.c.high, r.c.choices, r.c.flag) for r in df.select("s", criteria.criterion(F.col("s"), F.col("n")).alias("c")).collect()}
    assert {s: v for s, v in got.items() if v != SAID[s]} == {}


def test_trees_of_worded_schemes(spark):
    rows = [("a", "Age at least 18; income up to 2 lakh or\nBPL card; women or SC caste and disability at least 40%"), ("b", "women"), ("c", None), ("d", "  ;\n"), ("e", "18 years or more and above. women")]
    got = {}
    for r in criteria.tree_rows(spark.createDataFrame(rows, "id string, said string"), "id", "said").collect():
        got.setdefault(r.scheme_id, {})[r.path] = (r.parent, r.depth, r.kind if r.kind != "COND" else r.field, r.open, r.least, r.most)
    assert got["a"] == {
        "0": (None, 0, "AND", 3, 2, 0), "0.0": ("0", 1, "age", 0, 2, 0), "0.1": ("0", 1, "OR", 2, 2, 0), "0.1.0": ("0.1", 2, "annual_income", 0, 2, 0), "0.1.1": ("0.1", 2, "bpl_status", 0, 2, 0),
        "0.2": ("0", 1, "OR", 2, 2, 0), "0.2.0": ("0.2", 2, "gender", 0, 2, 0), "0.2.1": ("0.2", 2, "AND", 2, 2, 0), "0.2.1.0": ("0.2.1", 3, "social_category", 0, 2, 0), "0.2.1.1": ("0.2.1", 3, "disability_percentage", 0, 2, 0),
    }
    assert got["b"] == {"0": (None, 0, "AND", 1, 2, 0), "0.0": ("0", 1, "gender", 0, 2, 0)}
    assert got["c"] == got["d"] == {"0": (None, 0, "AND", 0, 2, 2)}
    assert [v[2] for _, v in sorted(got["e"].items())] == ["AND", "age", "gender"]


def test_heading_paths_are_a_stack(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for doc in range(20):
        stack = []
        for i in range(40):
            level = rng.choice([None, None, 1, 2, 3, 4])
            if level:
                stack = [(n, t) for n, t in stack if n < level] + [(level, f"t{i}")]
            rows.append((doc, i, level, f"t{i}"))
            want[doc, i] = [t for _, t in stack]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc long, i long, level int, title string")
    assert {(r.doc, r.i): r.path for r in sections.heading_paths(df, "doc", "i", "level", "title", 4).collect()} == want
    levels = spark.createDataFrame([("## a",), ("#a",), ("###### x y",), ("text",), (None,)], "s string").select(sections.markdown_level(F.col("s")).alias("n")).collect()
    assert [r.n for r in levels] == [2, None, 6, None, None]


def test_base_documents_are_the_plain_ones(spark):
    rng = random.Random(2)
    ddl = "{} long, citation string, title string, tokens array<string>, department string"

    def some(n, at):
        out = []
        for i in range(n):
            tokens = [rng.choice("abcdefgh") for _ in range(rng.randrange(6))]
            title = rng.choice([None, ""]) if not tokens else " ".join(tokens)
            out.append((at + i, rng.choice([None, "", "c1", "c2", f"x{i}"]), title, tokens, rng.choice(["d", "d", "e", None])))
        return out

    new, bases = some(80, 0), some(80, 1000)
    want = {}
    name = lambda r: (r[2] or "").strip().lower()
    first = lambda r, key: min(x[0] for x in bases if key(x) == key(r))
    for a in new:
        for b in bases:
            found = []
            if a[1] and a[1] == b[1]:
                found.append((1.0, "CITATION", first(b, lambda x: x[1])))
            if name(a) and a[4] and a[4] == b[4]:
                own = first(b, lambda x: (x[4], name(x)))
                s, t = set(a[3]), set(b[3])
                if name(a) == name(b):
                    found.append((0.95, "NAME", own))
                if s and t and len(s & t) / len(s | t) >= 0.5:
                    found.append((round(len(s & t) / len(s | t), 4), "TITLE", own))
            for score, kind, base in found:
                want[a[0], base] = max(want.get((a[0], base), (0, "")), (score, kind))
    got = candidates.candidates(spark.createDataFrame(new, ddl.format("new_id")), spark.createDataFrame(bases, ddl.format("base_id")))
    assert {(r.new_id, r.base_id): (r.score, r.kind) for r in got.collect()} == want
    best = {r.new_id: r for r in candidates.best_base(got).collect()}
    for i, r in best.items():
        own = {b: s for (a, b), (s, _) in want.items() if a == i}
        top = max(own.values())
        assert (r.base_id, r.score, r.n_bases) == (min(b for b, s in own.items() if s == top), top, len(own))
        assert r.conflict or sum(round(top - s, 4) < 0.1 for s in own.values()) == 1
    assert {a for a, _ in want} == set(best) and {r.conflict for r in best.values()} == {True, False}


def test_titles_that_only_share_words_leave_no_pair(spark):
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(80), rng.randint(1, 25))) for _ in range(150)]
    sets += [sorted({*rng.sample(s, len(s) - len(s) // 5), rng.randint(0, 80)}) for s in sets[:60]]
    rows = [(i, None, " ".join(f"w{x:02}" for x in s) + f" {i}", [f"w{x:02}" for x in s], "d") for i, s in enumerate(sets)]
    ddl = "{} long, citation string, title string, tokens array<string>, department string"
    new, bases = spark.createDataFrame(rows, ddl.format("new_id")), spark.createDataFrame(rows, ddl.format("base_id"))
    alike = lambda s, t: len({*s} & {*t}) / len({*s} | {*t})
    want = {(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets) if i == j or alike(s, t) >= 0.5}
    assert {(r.new_id, r.base_id) for r in candidates.candidates(new, bases).collect()} == want
    bits = [F.expr(candidates._BITS.format(n=candidates.LONGS, i=i)).alias(f"bits{i}") for i in range(candidates.LONGS)]
    titles = new.select(F.col("new_id").alias("id"), "department", "tokens", *bits)
    counts = titles.select("department", F.explode("tokens").alias("token")).groupBy("department", "token").agg(F.count("*").alias("n"))
    x, y = (candidates._prefixes(titles.withColumnRenamed("id", id), counts, id, 0.5) for id in "ab")
    shared = x.select("a", "token").join(y.select("b", "token"), "token")
    kept = {tuple(r) for r in x.alias("x").join(y.alias("y"), candidates._may_be_alike(0.5)).select("a", "b").collect()}
    assert want <= kept and len(kept) < 2 * len(want) < shared.select("a", "b").distinct().count() / 2
