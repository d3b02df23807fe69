"""Laws and edge cases of single operators."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from trivalent.functions import documents, text, truth
from trivalent.operators import changes, conditions, dedup, discovery, evaluation, metrics, profiles, retrieval, rules, validation
from trivalent.sources import files
from trivalent.streaming import events

STATES = (True, False, None)


def test_kleene_laws(spark):
    df = spark.createDataFrame([(a, b) for a in STATES for b in STATES], "a boolean, b boolean")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", truth.all_of([a, b]).alias("x"), truth.any_of([a, b]).alias("y"), truth.negation([truth.all_of([~a, ~b])]).alias("z")).collect()
    for r in got:
        pair = {r.a, r.b}
        assert r.x is (False if False in pair else None if None in pair else True)
        assert r.y is (True if True in pair else None if None in pair else False)
        assert r.z is r.y
    one = df.limit(1).select(truth.all_of([]).alias("x"), truth.any_of([]).alias("y"), truth.negation([]).alias("z")).first()
    assert (one.x, one.y, one.z) == (True, False, None)


@pytest.mark.parametrize(
    ("op", "value", "target", "want"),
    [
        ("EQ", " Delhi ", "delhi", True), ("EQ", "1,000", 1000, True), ("EQ", "x", 1, False), ("NE", None, "a", None), ("GT", "abc", 1, None), ("LTE", "5", 5, True),
        ("BETWEEN", "5", [5, 7], True), ("BETWEEN", "0", {"min": 0, "max": 3}, True), ("IN", "b", ["A", "B", None], True), ("IN", "c", ["A", None], False), ("NOT_IN", "c", ["A", None], True),
        ("IN", None, ["a"], None), ("EXISTS", None, None, None), ("EXISTS", "x", None, True), ("NOT_EXISTS", "x", None, False), ("LIKE", "x", "x", None),
    ],
)
def test_operators(spark, op, value, target, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(truth.compare(op, F.col("v"), target).alias("r")).first().r is want


def test_missing_fields_follow_the_order_of_evaluation(spark):
    df = spark.createDataFrame([(None, None, None), (5, None, None), (20, None, None), (20, "b", None)], "a int, b string, c string")
    tree = {"logic": "AND", "children": [{"field": "a", "operator": "GT", "value": 10}, {"type": "OR", "children": [{"field": "b", "operator": "EQ", "value": "b"}, {"field": "c", "operator": "EQ", "value": "c"}]}]}
    state, missing = rules.compiled(tree)
    got = [(r.s, r.m) for r in df.select(state.alias("s"), missing.alias("m")).collect()]
    assert got == [(None, ["a", "b", "c"]), (False, []), (None, ["b", "c"]), (True, [])]


def test_rule_errors():
    with pytest.raises(rules.RuleError):
        rules.compiled({"children": []})
    tree = {"type": "NOT", "children": []}
    for _ in range(12):
        tree = {"type": "AND", "children": [tree]}
    with pytest.raises(rules.RuleError):
        rules.compiled(tree, -1)
    assert rules.availability(date(2024, 1, 2), None, date(2024, 1, 1)) == "NOT_YET_ACTIVE"
    assert rules.availability(None, date(2024, 1, 1), date(2024, 1, 1)) == "ACTIVE"


def test_canonical_roots_end_cycles_and_chains(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 9)], "id long, parent long")
    assert {r.id: r.root for r in dedup.canonical_roots(links, "id", "parent").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 9}


def test_sets_are_made_once_of_words_hashed_once(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd bb cc dd"), (2, "aa bb"), (3, "aa"), (4, "bb aa"), (5, ""), (6, None), (7, "AA, bb!"), (8, "aa aa aa aa")], "id long, t string")
    hashed = docs.select("id", F.explode(F.array(dedup.word_hashes(F.col("t")))).alias("w")).select("id", dedup.shingle_hashes(F.col("w"), 3).alias("s"))
    got = {r.id: r.s for r in hashed.collect()}
    assert [len(got[i]) for i in range(1, 9)] == [4, 1, 1, 1, 0, 0, 1, 1]
    assert got[2] == got[7] and len({tuple(got[i]) for i in (2, 3, 4, 8)}) == 4 and got[1] == sorted(got[1])
    assert sorted(map(tuple, dedup.shingle_classes(docs, "id", "t").select("id", "class_id").collect())) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 2), (8, 8)]
    plans = []
    with pytest.MonkeyPatch.context() as m:  # the plan that makes the sets names the sets' hashes once, not again in a filter
        m.setattr(type(docs), "checkpoint", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.localCheckpoint())
        dedup.jaccard_pairs(docs, "id", "t", 0.5).collect()
    assert plans[0].count("array_distinct") == 1


def test_jaccard_of_empty_and_equal_texts(spark):
    docs = spark.createDataFrame([(1, "a1 b1 c1 d1 e1"), (2, "a1 b1 c1 d1 e1"), (3, ""), (4, None), (5, "aa bb")], "id long, t string")
    assert dedup.jaccard_pairs(docs, "id", "t", 0.5).collect() == []


def test_error_rates(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("", ""), ("", "a")], "r string, h string")
    got = df.select(metrics.word_error_rate(F.col("r"), F.col("h")).alias("w"), metrics.character_error_rate(F.col("r"), F.col("h")).alias("c")).collect()
    assert [(round(r.w, 4), round(r.c, 4)) for r in got] == [(0.3333, 0.3333), (0, 0), (1, 1)]


def test_partial_amendment_removes_nothing(spark):
    base, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "x"), (3, None)], "k int, v string")
    assert {(r.k, r.change) for r in changes.full_diff(base, new, "k", ["v"]).collect()} == {(1, "CHANGED"), (2, "REMOVED"), (3, "ADDED")}
    assert {(r.k, r.change) for r in changes.full_diff(base, new, "k", ["v"], partial=True).collect()} == {(1, "CHANGED"), (3, "ADDED")}


def test_unknown_conditions_are_no_issue(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "k int, v int")
    assert [r.k for r in validation.issues(df, ["k"], [("BIG", "ERROR", F.col("v") > 1)]).collect()] == [2]


def test_text_functions(spark):
    df = spark.createDataFrame([("पात्र की आयु ६० वर्ष",), ("2.5 lakh",), (None,)], "s string")
    got = df.select(text.indian_number(F.col("s")).alias("n"), text.duration(F.col("s"))[1].alias("u")).collect()
    assert [(r.n, r.u) for r in got] == [(60.0, "YEAR"), (250000.0, None), (None, None)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,city\ncafé,x\n".encode("iso-8859-1"))
    df = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.first().name == "café"
    assert files.flattened(df, ["name", " "]).first().row_text == "name: café | Column_2: x"
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    assert {r.extension: r.valid for r in files.read_files(spark, str(tmp_path)).collect()} == {"csv": True, "pdf": False}
    xml = "<urlset><url><loc>b</loc><lastmod>2</lastmod></url><url><loc>a</loc></url></urlset>"
    assert spark.createDataFrame([(xml,)], "x string").select(files.feed_entries(F.col("x")).alias("e")).first().e == ["a|", "b|2"]
    known = spark.createDataFrame([(1, "h"), (2, "g")], "k int, h string")
    new = spark.createDataFrame([(1, "h"), (2, "x"), (3, "y")], "k int, h string")
    changed = files.changed_rows(new, known, "k", "h")
    assert sorted((r.k, r.h) for r in files.upserted(known, changed, "k").collect()) == [(1, "h"), (2, "x"), (3, "y")]


def test_streams(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.limit(200).union(rows.limit(20)).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = events.read_folder(spark, str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert run(events.once(source, "event_id"), "append", "once").count() == 200
    assert run(events.windowed_counts(source, "1 day"), "complete", "windows").agg(F.sum("n")).first()[0] == 220
    assert run(events.session_counts(source), "complete", "stream_sessions").agg(F.sum("n")).first()[0] == 220
    told = run(events.change_states(source), "append", "told")
    assert told.where("state = 'BASELINE'").count() == told.select("user_id").distinct().count()


@pytest.mark.parametrize(
    ("kind", "value", "target", "want"),
    [
        ("string", "maybe", True, False), ("string", "Yes", True, True), ("string", "हाँ", True, True), ("string", "no", False, True), ("boolean", True, "yes", True), ("boolean", True, "no", False), ("int", 2, True, True),
        ("boolean", False, 0, True), ("boolean", None, True, None), ("string", "x", None, None),
    ],
)
def test_booleans_meet_text_and_numbers(spark, kind, value, target, want):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    assert df.select(truth.equals(F.col("v"), target).alias("r")).first().r is want


def test_rules_as_rows_know_what_is_missing(spark):
    leaf = lambda f, op, v=None: {"field": f, "operator": op, "value": v}
    trees = {
        "and": {"type": "AND", "children": [leaf("age", "GTE", 5), leaf("income", "LTE", 9)]}, "or": {"type": "OR", "children": [leaf("age", "LT", 5), leaf("income", "LTE", 9)]}, "not": {"type": "NOT", "children": [leaf("income", "GT", 1)]},
        "between": leaf("age", "BETWEEN", {"min": 0, "max": 10}), "exists": leaf("age", "EXISTS"), "gone": leaf("income", "NOT_EXISTS"), "none": {"type": "AND", "children": []}, "or_none": {"type": "OR", "children": []}, "not_none": {"type": "NOT", "children": []},
        "fixed": {"type": "AND", "children": [leaf("age", "GTE", 5), {"type": "OR", "children": []}]}, "open": {"type": "AND", "children": [leaf("x", "EQ", "y"), {"type": "AND", "children": []}]}, "word": leaf("flag", "EQ", True),
        "decided": {"type": "AND", "children": [leaf("age", "LT", 5), leaf("x", "EQ", 1)]},
    }
    rows = rules.nodes_of([{"id": k, "rule": t} for k, t in trees.items()])
    facts = spark.createDataFrame([(1, "age", 7.0, None, None), (1, "flag", None, "yes", None), (2, "income", 5.0, None, None)], "profile_id int, field string, num double, str string, flag_value boolean")
    got = {(r.profile_id, r.scheme_id): r.state for r in rules.evaluate_nodes(facts, spark.createDataFrame(rows, rules.NODES), max(r[3] for r in rows)).collect()}
    first = {"and": 1, "or": 1, "not": 1, "between": 2, "exists": 2, "gone": 1, "none": 2, "or_none": 0, "not_none": 1, "fixed": 0, "open": 1, "word": 2, "decided": 0}
    assert {k: got[1, k] for k in trees} == first and len(got) == 2 * len(trees)
    assert (got[2, "and"], got[2, "or"], got[2, "not"], got[2, "gone"], got[2, "fixed"]) == (1, 2, 0, 0, 0)


def test_preferences_and_exclusions_may_be_groups(spark):
    leaf = lambda f: {"field": f, "operator": "EQ", "value": 1}
    group = {"type": "AND", "children": [leaf("a"), leaf("b")]}
    scheme = {"id": "S", "rule": leaf("a"), "preferences": [group, leaf("b")], "exclusions": [{"id": "X", "mandatory_check": True, "rule": {"type": "OR", "children": [leaf("b"), leaf("c")]}}]}
    df = spark.createDataFrame([(1, 1, 1, 1), (2, 1, None, None)], "id int, a int, b int, c int")
    got = {r.id: (r.status, r.missing, r.preferences) for r in rules.evaluate(df, [scheme], date(2024, 1, 1)).collect()}
    assert got == {1: ("NOT_ELIGIBLE", [], ["a+b", "b"]), 2: ("MORE_INFORMATION_REQUIRED", ["b", "c"], [])}


def test_canonical_roots_of_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 7), (7, 6), (8, None), (9, 8)], "id long, parent long")
    assert {r.id: r.root for r in dedup.canonical_roots(links, "id", "parent").collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8, 9: 8}


def test_versions_hold_on_their_last_day(spark):
    d = date
    versions = spark.createDataFrame([("a", 1, None, d(2024, 1, 31), True), ("a", 2, d(2024, 1, 1), d(2024, 2, 29), False), ("a", 3, d(2024, 3, 1), None, False)], "k string, n int, s date, e date, active boolean")
    events = spark.createDataFrame([(1, "a", d(2024, 1, 31)), (2, "a", d(2024, 2, 29)), (3, "a", d(2030, 1, 1)), (4, "a", d(1990, 1, 1)), (5, "b", d(2024, 1, 1))], "id int, k string, day date")
    assert {r.id: r.n for r in changes.as_of(events, versions, "k", "day", "s", "e", "n", "id", F.col("active")).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: None}


@pytest.mark.parametrize(
    ("row", "seconds"),
    [
        (("tier_1", "CHANGED", 0, 0, None), 3600), (("TIER_9", "CHANGED", 0, 0, None), 86400), (("TIER_1", "CHECK_FAILED", 1, 0, None), 900), (("TIER_1", "TIMEOUT", 3, 0, None), 3600), (("TIER_1", "TIMEOUT", 9, 0, None), 14400),
        (("TIER_1", "CHANGED", 0, 0, 30), 900), (("TIER_1", "CHANGED", 0, 0, 5000), 5000), (("TIER_1", "AUTH_REQUIRED", 5, 0, None), 86400), (("TIER_2", "UNCHANGED", 0, 5, None), 32400), (("TIER_2", "UNCHANGED", 0, 10, None), 48600),
        (("TIER_4", "UNCHANGED", 0, 12, None), 604800),
    ],
)
def test_intervals(spark, row, seconds):
    df = spark.createDataFrame([row], "p string, o string, f int, u int, r int")
    assert df.select(changes.next_interval(F.col("p"), F.col("o"), F.col("f"), F.col("u"), F.col("r")).alias("s")).first().s == seconds


def test_bounds_of_alternatives_do_not_contradict(spark):
    rows = [(1, "age", "a", "GTE", 60), (1, "age", "b", "LTE", 18), (2, "age", None, "GTE", 60), (2, "age", "b", "LTE", 18), (3, "age", None, "GT", 5), (3, "age", None, "LTE", 5)]
    df = spark.createDataFrame(rows, "id int, field string, branch string, op string, value int")
    assert sorted((r.id, r.low, r.high) for r in validation.contradictions(df, "id", "field", "branch").collect()) == [(2, 60, 18), (3, 5, 5)]


@pytest.mark.parametrize(
    ("phrase", "op"),
    [
        ("income exceeding 5 lakh", "GT"), ("60 वर्ष या अधिक", "GTE"), ("आयु 18 से ज्यादा", "GT"), ("18 से 40 वर्ष", "BETWEEN"), ("not exceeding 5", "LTE"), ("२ लाख से ज्यादा नहीं", "LTE"), ("21 वर्ष पूर्ण कर चुके", "GTE"), ("18-40 years", "BETWEEN"),
        ("18 से कम", "LT"), ("2.5 लाख तक", "LTE"), ("5", "EQ"), ("none", None),
    ],
)
def test_bound_operators(spark, phrase, op):
    assert spark.createDataFrame([(phrase,)], "s string").select(text.bound_operator(F.col("s")).alias("o")).first().o == op


def test_profiles_and_candidates(spark):
    rows = [(1, "राजस्थान ", "MONTHLY", 10.0, None, 5), (2, None, None, None, " yes", None)]
    df = profiles.normalized(spark.createDataFrame(rows, "profile_id int, state string, family_income_frequency string, family_income double, domicile_status string, land_area_bigha int"))
    got = {r.profile_id: (r.state, r.family_income, r.domicile, r.land_holding) for r in df.collect()}
    assert got == {1: ("Rajasthan", 120.0, None, 5), 2: (None, None, "Rajasthan", None)}
    schemes = [(1, None, None, "Rajasthan", [], "BOTH", "UNKNOWN"), (2, None, date(2024, 6, 1), "Gujarat", None, "ALL", "UNKNOWN"), (3, date(2024, 6, 2), None, None, None, "BOTH", "UNKNOWN"), (4, None, None, None, ["Kota"], "RURAL", "UNKNOWN"), (5, None, None, None, None, "BOTH", "CENTRAL")]
    s = spark.createDataFrame([(i, True, True, *r, None) for i, *r in schemes], "scheme_id int, verified boolean, active boolean, valid_from date, valid_until date, state string, districts array<string>, rural_urban string, origin string, category string")
    p = spark.createDataFrame([(1, None, None, None), (2, "Rajasthan", "Jaipur", "URBAN"), (3, "gujarat", None, "rural")], "profile_id int, p_state string, p_district string, p_rural_urban string")
    found = discovery.candidates(p, s, F.lit("2024-06-01").cast("date")).collect()
    assert sorted((r.profile_id, r.scheme_id) for r in found) == [(1, 1), (1, 2), (1, 4), (2, 1), (3, 2)]


def test_evaluation_edges(spark):
    df = spark.createDataFrame([([], []), (["a"], []), ([], ["a"]), (["a", "b"], ["b", "c"])], "e array<string>, f array<string>")
    p, r, f1 = evaluation.set_scores(F.col("e"), F.col("f"))
    assert [tuple(x) for x in df.select(p, r, f1).collect()] == [(1, 1, 1), (0, 0, 0), (0, 1, 0), (0.5, 0.5, 0.5)]
    none = evaluation.confusion(spark.createDataFrame([], "e string, p string"), "e", "p", ["A", "B"]).collect()
    assert [(x["class"], x.a, x.precision, x.f1) for x in none] == [("A", 0, 0, 0), ("B", 0, 0, 0)]
    judged = spark.createDataFrame([(1, 0)], "q int, g int")
    assert evaluation.ranking_at(judged.withColumn("i", F.lit(1)), "q", "i", "g", evaluation.largest_gains(judged, "q", "g"), (1,)).first()[1:] == (0.0, 1.0, 0.0, 0.0)


def test_condition_conflicts_keep_contexts_apart(spark):
    rows = [(1, 0, "age", "GTE", "18", None, ["a"]), (1, 1, "age", "GTE", "21", "SC", ["b"]), (1, 2, "age", "GTE", "18", None, ["c", "a"]), (2, 0, "age", "GTE", "18", None, ["a"]), (2, 1, "age", "LTE", "60", None, ["b"]), (2, 2, "marks", "GTE", "1", None, []), (2, 3, "marks", "GTE", "2", None, [])]
    df = spark.createDataFrame([(d, i, f, o, v, None, None, c, r) for d, i, f, o, v, c, r in rows], "d int, i int, field string, operator string, value string, unit string, periodicity string, context string, refs array<string>")
    assert sorted((r.d, r.field, r.value, r.refs) for r in conditions.merged(df, ["d"], "i").where("d = 1").collect()) == [(1, "age", "18", ["a", "c"]), (1, "age", "21", ["b"])]
    assert [(r.d, r.conflict_id, r["values"]) for r in conditions.conflicts(df, ["d"], "i").collect()] == [(2, "CONF-001", ["18", "60"])]


def test_document_functions(spark):
    df = spark.createDataFrame([("a\nb ", "b\nc 2025\n")], "o string, n string")
    added, removed = documents.line_changes(F.col("o"), F.col("n"))
    assert df.select(added, removed, documents.year_shift(F.col("n"), F.col("o"))).first() == (["c 2025"], ["a"], False)
    urls = {"http://127.0.0.1/": (False, True), "https://x.example.com:8/": (True, False), "ftp://example.com/": (False, False), "http://badexample.com": (False, False), None: (False, None)}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", documents.allowed(F.col("u"), ["example.com"]).alias("a"), documents.private_host(F.col("u")).alias("p")).collect()
    assert {r.u: (r.a, r.p) for r in got} == urls


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 0.999, 1.0])
def test_interpolated_percentiles_are_exact(spark, q):
    import random

    import numpy as np

    rng = random.Random(4)
    rows = [(n, rng.choice([rng.random(), 0.5, 0.25])) for n in [*range(1, 24), 3000] for _ in range(n)]
    got = {r.g: r.value for r in metrics.interpolated_percentile(spark.createDataFrame([*rows, (99, None), (2, None)], "g int, v double"), "g", "v", q).collect()}
    want = {g: float(np.quantile([v for h, v in rows if h == g], q)) for g in {g for g, _ in rows}}
    assert set(got) == set(want) and all(abs(got[g] - want[g]) < 1e-12 for g in want)


def test_addresses_that_are_not_public(spark):
    private = ["127.0.0.1", "10.0.0.1", "100.64.1.1", "169.254.169.254", "172.31.0.1", "192.168.1.1", "0.0.0.0", "224.0.0.1", "240.1.1.1", "198.18.0.1", "2130706433", "localhost", "LOCALHOST.", "a.local", "x.localhost", "metadata.google.internal", "instance-data"]
    private += ["[::1]", "[::]", "[fd00::1]", "[fe80::1]", "[FF02::1]", "[::ffff:10.0.0.1]", "[::ffff:7f00:1]", "[2001:db8::5]", "[::g]", "[1:2]", "[1::2::3]", ""]
    public = ["10.example.com", "172.40.0.1", "100.128.0.1", "8.8.8.8", "11.0.0.1", "192.169.0.1", "[2606:4700::1111]", "[::ffff:8.8.8.8]", "256.1.1.1", "local", "127.0.0.1.example.com", "1.2.3"]
    got = spark.createDataFrame([(h, f"http://u:p@{h}:80/x?y") for h in private + public], "h string, u string").select("h", documents.private_host(F.col("u")).alias("p")).collect()
    assert {r.h for r in got if r.p} == set(private)


def test_relations_need_whole_phrases(spark):
    from trivalent.operators import relations

    said = {
        "in supersession of the order": "SUPERSEDES", "the word shall be read as other": "CORRIGENDUM_TO", "in partial modification of": "AMENDS", "shall be substituted": "AMENDS", "shall be inserted": "ADDENDUM_TO", "for the removal of doubt": "CLARIFIES",
        "validity extended": "EXTENDS", "ask the extension officer": None, "an extended family": None, "a superseding order, amended": "SUPERSEDES", "के स्थान पर पढ़ा जावे": "CORRIGENDUM_TO",
    }
    df = spark.createDataFrame([(s,) for s in said], "s string")
    got = df.select("s", relations.relationship(F.col("s"), F.lit("x"), F.lit(""))[0].alias("r")).collect()
    assert {r.s: r.r for r in got} == said


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_index_percentiles_are_exact(spark, q):
    import random

    rng = random.Random(2)
    rows = [(g, v) for g, n in (("a", 1), ("b", 7), ("c", 3000), ("d", 500)) for v in ([rng.random() for _ in range(n)] if g != "d" else [rng.choice([1.0, 2.0, 2.0, 9.0]) for _ in range(n)])]
    got = {r.g: r.value for r in metrics.index_percentile(spark.createDataFrame(rows, "g string, v double"), "g", "v", q).collect()}
    by = {g: sorted(v for h, v in rows if h == g) for g in "abcd"}
    assert got == {g: v[min(int(len(v) * q), len(v) - 1)] for g, v in by.items()}


def test_spoken_numbers_and_places(spark):
    from trivalent.plans import page_plans

    want = {i: None if v is None else float(v) for i, (_, v) in enumerate(page_plans._SPOKEN)}
    assert {r.id: r.value for r in page_plans.spoken_numbers(spark, "").collect()} == want
    assert [r.place for r in page_plans.places(spark, "").orderBy("id").collect()] == ["Jaipur", "Jaipur", "Kota", "Ganganagar", "Ganganagar", "Jaipur", "Banswara", None, None, None]


def test_links_are_resolved(spark):
    from trivalent.operators import pages

    cases = {"/a": "http://h.org/a", "b?x=1#f": "http://h.org/d/b?x=1", "//o.org/c": "http://o.org/c", "https://z.org/": "https://z.org/", "#top": None, "mailto:a@b.c": None, "JavaScript:x()": None}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.r for r in df.select("u", pages.resolved(F.col("u"), F.lit("http://h.org/d/page.html?q")).alias("r")).collect()} == cases
    assert spark.range(1).select(pages.resolved(F.lit("x"), F.lit("http://h.org")).alias("r")).first().r == "http://h.org/x"
    html = "<a class=x href='/n1'> One <b>two</b></a><A HREF=\"/n1\">again</A><a href='#x'>no</a>"
    got = pages.links(spark.createDataFrame([(1, "http://h.org/", html), (2, None, None)], "id int, url string, html string"), "id", "url", "html").collect()
    assert [(r.id, r.link, r.anchor) for r in got] == [(1, "http://h.org/n1", "One two")]


def test_chunks_keep_provisos_and_share_blocks(spark):
    from trivalent.operators import chunking

    rows = [([10, 10, 10, 10], [False] * 4), ([10, 10, 10, 10], [False, False, True, False]), ([50], [False]), ([], []), ([5, 50, 5], [False] * 3)]
    df = spark.createDataFrame(rows, "t array<bigint>, b array<boolean>").select("b", F.explode(F.array(chunking.sums(F.col("t")))).alias("r"))
    got = [[(c.first, c.last) for c in r.c] for r in df.select(chunking.packed(F.col("r"), F.col("b"), 25, 10).alias("c")).collect()]
    assert got == [[(0, 1), (1, 2), (2, 3)], [(0, 2), (2, 3)], [(0, 0)], [], [(0, 0), (0, 1), (2, 2)]]
    rows = [([3, 9, 2], [(0, 0), (1, 1), (2, 2)]), ([1], [(0, 0)]), ([], []), ([9, 2], [(0, 0), (1, 1)]), ([8, 3], [(0, 1), (1, 1)]), ([2, 2, 9], [(0, 1), (1, 2)])]
    df = spark.createDataFrame(rows, "t array<bigint>, c array<struct<first:bigint,last:bigint>>").select("c", F.explode(F.array(chunking.sums(F.col("t")))).alias("r"))
    merged = df.select("r", F.explode(F.array(chunking.merged(F.col("r"), F.col("c"), 5, 14))).alias("m")).select("m", F.transform("m", lambda x: chunking.size_of(F.col("r"), x)).alias("n")).collect()
    assert [[tuple(x) for x in r.m] for r in merged] == [[(0, 2)], [(0, 0)], [], [(0, 1)], [(0, 1)], [(0, 1), (1, 2)]]
    assert [r.n for r in merged] == [[14], [1], [], [11], [11], [4, 11]]


def test_nearest_by_cosine_and_gains_are_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    vectors = [[rng.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(4)] for _ in range(60)] + [[1.0, 0.0, 0.0, 0.0]] * 8 + [[1.0, 0.0, 0.0, 1023**0.5]] * 3
    vectors += [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0, float("nan"), 0.0, 0.0], [0.0, float("inf"), 1.0, 0.0]]
    v = spark.createDataFrame([(i, x, rng.choice((1, 2, None))) for i, x in enumerate(vectors)], "id int, v array<double>, label int")
    v = v.where("v is null or size(v) <> 0")
    q = v.where("id % 3 = 0").select(F.col("id").alias("query_id"), "v", F.col("label").alias("wanted"))
    both = v.join(F.broadcast(q.withColumnRenamed("v", "q")), F.col("id") != F.col("query_id"))
    plain = retrieval.top_k(both.select("query_id", "id", "label", F.round(retrieval.cosine(F.col("q"), F.col("v")), 4).alias("similarity")), ["query_id"], [F.desc("similarity"), F.col("id")], 7)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 20)
    got = retrieval.nearest_by_cosine(q, v, "id", "v", 7, 4)
    columns = ["query_id", "rank", "id", "label", "similarity"]
    assert sorted(got.select(columns).collect(), key=lambda r: r[:2]) == sorted(plain.select(columns).collect(), key=lambda r: r[:2])
    assert {f.name: f.dataType for f in got.schema}.items() >= {"query_id": v.schema["id"].dataType, "label": v.schema["label"].dataType}.items()
    worth = F.when(F.col("id") < 40, 2).otherwise(1)
    gain = F.when(F.col("label") != F.col("wanted"), 0).otherwise(worth)
    want = evaluation.largest_gains(both.select("query_id", gain.alias("g")), "query_id", "g", 5)
    judged = evaluation.label_gains(v.select("id", "label"), q.select("query_id", "wanted"), "id", "label", worth)
    assert sorted(evaluation.largest_gains(judged, "query_id", "gain", 5, F.col("n")).collect()) == sorted(want.collect())
    alone = v.where("id = 0")
    assert retrieval.nearest_by_cosine(q.where("query_id = 0"), alone, "id", "v", 7, 4).isEmpty()
    assert evaluation.label_gains(alone, q.where("query_id = 0"), "id", "label", worth).isEmpty()


def test_candidates_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    day = F.lit("2024-06-01").cast("date")
    pick = rng.choice
    schemes = [
        (i, pick((True, True, None)), pick((True, True, True, False)), pick((None, date(2024, 1, 1), date(2024, 7, 1))), pick((None, date(2024, 8, 1), date(2024, 2, 1))), pick((None, "Rajasthan", "ALL_INDIA", "gujarat", "any", "open")),
         pick((None, [], ["Kota"], ["kota", "Kota"], ["jaipur", None], ["any"], ["open"])), pick((None, "BOTH", "ALL", "RURAL", "URBAN", "urban")), pick(("UNKNOWN", "CENTRAL", None)), pick(("a", "B", None)))
        for i in range(400)
    ]
    s = spark.createDataFrame(schemes, "scheme_id int, verified boolean, active boolean, valid_from date, valid_until date, state string, districts array<string>, rural_urban string, origin string, category string")
    profiles_ = [(i, pick((None, "RAJASTHAN", "Gujarat", "all_india", "any", "")), pick((None, "Kota", "JAIPUR", "any", "open", "")), pick((None, "rural", "Urban", "both", "x")), pick((None, " b ", "c"))) for i in range(150)]
    p = spark.createDataFrame(profiles_, "profile_id int, p_state string, p_district string, p_rural_urban string, wish string")
    for category, central in ((None, False), (F.col("wish"), True)):
        plain = discovery.top_k(p.join(F.broadcast(s), discovery.admits(day, category, central)), ["profile_id"], [F.col("scheme_id")], 9)
        got = discovery.candidates(p, s, day, 9, category, central)
        assert got.columns == plain.columns
        assert sorted(got.collect(), key=lambda r: (r.profile_id, r.rank)) == sorted(plain.collect(), key=lambda r: (r.profile_id, r.rank))
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_rows_of_rules_deal_profiles_by_their_states(spark, monkeypatch):
    facts = spark.createDataFrame([(p, f, float(p), None, None) for p in range(40) for f in ("age", "x")], "profile_id int, field string, num double, str string, flag_value boolean")
    rows = [(str(s), *r) for s in range(5) for r in (("0", None, 0, "AND", None, None, None, None, None, None, 2, 2, 0), ("0.0", "0", 1, "COND", "age", "GTE", 20.0 + s, None, None, None, 0, 2, 0), ("0.1", "0", 1, "COND", "no", "EXISTS", None, None, None, None, 0, 2, 0))]
    nodes = spark.createDataFrame(rows, rules.NODES)
    monkeypatch.setattr(rules, "STATES", 10)
    assert rules._dealt(facts, nodes).rdd.getNumPartitions() == 20  # 40 profiles, one fact each that five conditions ask for
    out = rules.evaluate_nodes(facts, nodes, 1)
    assert {(r.profile_id, r.scheme_id): r.state for r in out.collect()} == {(p, str(s)): 0 if p < 20 + s else 1 for p in range(40) for s in range(5)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "scheme_id" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)  # groups stay with their profile


def test_shingles_are_taken_once(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd"), (2, "AA bb, cc dd"), (3, "aa bb cc"), (4, None)], "id int, text string")
    out = dedup.shingle_classes(docs, "id", "text")
    assert sorted(tuple(r) for r in out.where("id < 4").collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]
    assert "text" not in out._jdf.queryExecution().optimizedPlan().toString()  # both sides of the join read kept keys


def test_pairs_that_share_too_little_cost_no_sets(spark):
    rng = random.Random(11)
    texts = [[rng.choice("abcdefgh") * 2 for _ in range(rng.randint(1, 60))] for _ in range(60)]
    texts += [[w if rng.random() > 0.03 else "zz" for w in t] for t in texts[:40]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id int, text string")
    sets = [frozenset(tuple(t[i : i + 3]) for i in range(len(t) - 2)) or frozenset([tuple(t)]) for t in texts]
    first = {s: i for i, s in reversed([*enumerate(sets)])}
    want = {(i, j): round(len(s & t) / len(s | t), 4) for s, i in first.items() for t, j in first.items() if i < j and len(s & t) / len(s | t) >= 0.6}
    assert {(r.a, r.b): r.similarity for r in dedup.jaccard_pairs(docs, "id", "text", 0.6).collect()} == want and len(want) > 15
    rows = spark.createDataFrame([([*range(k, k + 300)],) for k in (0, 40, 900)], "s array<bigint>").select(F.expr(dedup.PARITIES.replace("h,", "xxhash64(h),")).alias("b")).collect()
    differ = lambda x, y: sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x.b, y.b))
    assert differ(rows[0], rows[1]) <= 80 < 250 < differ(rows[0], rows[2])


def test_jaccard_pairs_of_large_groups_and_common_words(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    near = [rng.choice(words) for _ in range(80)]
    texts = [[w if rng.random() > 0.03 else rng.choice(words) for w in near] for _ in range(50)]  # all near copies of one
    texts += [["the", "same", "line", "in", "all", *(rng.choice(words) for _ in range(rng.randint(0, 40)))] for _ in range(60)]
    texts += [t[: rng.randint(1, len(t))] for t in texts[::3]] + [list(t) for t in texts[::4]]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    sets = [frozenset(tuple(t[i : i + 3]) for i in range(len(t) - 2)) or frozenset([tuple(t)]) for t in texts]
    first = {s: i for i, s in reversed([*enumerate(sets)])}
    monkeypatch.setattr(dedup, "COMMON", 2)
    for threshold in (0.5, 0.7, 0.98):
        want = {(i, j): round(len(s & t) / len(s | t), 4) for s, i in first.items() for t, j in first.items() if i < j and len(s & t) / len(s | t) >= threshold}
        for block, rows in (256, 10**8), (7, 1000):  # groups whole and in blocks, tokens in one round and in several
            monkeypatch.setattr(dedup, "BLOCK", block)
            monkeypatch.setattr(dedup, "ROUND_ROWS", rows)
            assert {(r.a, r.b): r.similarity for r in dedup.jaccard_pairs(docs, "id", "text", threshold).collect()} == want
    assert len(dedup._common(dedup._sets(docs, "id", "text", 3), "id")[0]) > 2


def test_sets_are_shuffled_once_a_group_not_once_a_pair(spark):
    texts = [" ".join(f"w{j}" if (i, j) != (i, 3 * i) else f"x{i}" for j in range(200)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    ids = spark.range(60)
    pairs = ids.select(F.col("id").alias("a")).join(ids.select(F.col("id").alias("b")), F.expr("a < b"))
    out = dedup._compared(pairs, dedup._sets(docs, "id", "text", 3), "id", 0.7)
    rows = []
    with pytest.MonkeyPatch.context() as m:  # what comes to the tasks that compare
        m.setattr(type(docs), "mapInArrow", lambda df, *a: rows.append(df.count()) or df)
        dedup._compared(pairs, dedup._sets(docs, "id", "text", 3), "id", 0.7)
    assert rows == [60] and out.count() == 60 * 59 // 2
    met = dedup._met(spark.createDataFrame([(i, 300, list(range(10**9, 10**9 + 10**6 * 90, 10**6))) for i in range(20)], "id long, size int, t array<bigint>"), "id", 0.7)
    assert met.count() == 190


def test_schemes_are_cut_before_their_keys_are_listed(spark, monkeypatch):
    s = spark.createDataFrame([(i, True, True, None, None, None, [], "BOTH", "UNKNOWN") for i in range(30)], "scheme_id int, verified boolean, active boolean, valid_from date, valid_until date, state string, districts array<string>, rural_urban string, origin string")
    p = spark.createDataFrame([(1, "rajasthan", "kota", "rural")], "profile_id int, p_state string, p_district string, p_rural_urban string")
    plans, keep = [], discovery.written
    monkeypatch.setattr(discovery, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    assert [r.scheme_id for r in discovery.candidates(p, s, F.lit("2024-06-01").cast("date"), 3).orderBy("rank").collect()] == [0, 1, 2]
    assert plans[0].rindex("Window") > plans[0].rindex("Generate explode(in_residence")  # further down: before
