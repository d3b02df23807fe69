"""Edit scripts, JSON trees, rule trees and traces against plain versions."""

import copy
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from trivalent.operators import diffs, json_trees, rules, trees
from trivalent.plans import structure_plans


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + 1 if x == y else 0))
        row = new
    return row[-1]


def check_script(a, b, script):
    i = j = same = 0
    for tag, i1, i2, j1, j2 in script:
        assert (i1, j1) == (i, j)
        i, j = i2, j2
        if tag == "equal":
            assert a[i1:i2] == b[j1:j2]
            same += i2 - i1
        else:
            assert tag == ("replace" if i2 > i1 and j2 > j1 else "delete" if i2 > i1 else "insert") and (i2 > i1 or j2 > j1)
    assert (i, j) == (len(a), len(b)) and same == common(a, b)
    assert all(x[0] != y[0] or "equal" not in (x[0], y[0]) for x, y in zip(script, script[1:]))


def test_edit_scripts_are_shortest():
    rng = random.Random(1)
    for _ in range(3000):
        k = rng.randrange(1, 8)
        a, b = ([rng.randrange(k + n) for _ in range(rng.randrange(25))] for n in (0, 1))
        check_script(a, b, diffs.edit_script(a, b))
    assert diffs.edit_script([], []) == [] and diffs.edit_script(["a"], ["a"]) == [("equal", 0, 1, 0, 1)]


def test_edit_scripts_take_linear_memory():
    import tracemalloc

    rng = random.Random(2)
    a, b = ([rng.randrange(4) for _ in range(1500)] for _ in range(2))
    tracemalloc.start()
    script = diffs.edit_script(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    check_script(a, b, script)
    assert most < 2_000_000  # a table would have 2,250,000 cells


def test_text_changes(spark):
    rows = [
        (1, "a\nb\nc", "c\na\nb", "Order 2024", "Order 2025"),  # moved: a line goes and comes
        (2, "a\na\nb", "a\nb", "x", "x"),  # a repeated line goes
        (3, "a\n  b \n", "a\nb revised here", "x 2025", "y 2024"),
        (4, "same\n", "same", "amended", "x"),
        (5, None, "", None, None),
        (6, None, "संशोधित\r\nnew", "2024", "in 2024"),
        (7, "unamended", "amendments", "1202455", "2024"),
    ]
    got = {r.id: r for r in diffs.text_changes(spark.createDataFrame(rows, "id long, old string, new string, ot string, nt string"), "old", "new", "ot", "nt").collect()}
    assert [(got[i].n_added, got[i].n_removed) for i in range(1, 8)] == [(1, 1), (0, 1), (1, 1), (0, 0), (0, 0), (2, 0), (1, 1)]
    assert [got[i].year_changed for i in range(1, 8)] == [True, False, True, False, False, False, False]
    assert [got[i].words for i in range(1, 8)] == [[], [], ["revised"], ["amended"], [], ["संशोधित"], []]
    assert [got[i].is_version for i in range(1, 8)] == [True, False, True, False, False, True, False]
    assert got[3].summary == "- b\n+ b revised here" and got[2].summary == "- a" and got[5].summary == ""


def test_opcodes_of_blocks_and_extra_columns(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"], ["b", None], "kept"), (2, None, ["x"], None)], "id long, old array<string>, new array<string>, opcodes_ string")
    got = {r.id: r for r in diffs.opcodes(df, "old", "new").collect()}
    check_script(got[1].old, got[1].new, [tuple(x) for x in got[1].opcodes])
    assert [tuple(x) for x in got[2].opcodes] == [("insert", 0, 0, 0, 1)] and got[1].opcodes_ == "kept"
    assert diffs.opcodes(df.limit(0), "old", "new").collect() == []


KEYS = ["a", "b/c", "d~", "e", "name", "", "é"]


def document(rng, depth=0):
    r = rng.random()
    if depth > 5 or r < 0.3 and depth:
        return rng.choice([1, 2.5, "x", 'é "q" / ~\n', None, True, "", -3, 10**17])
    if r < 0.65:
        return {rng.choice(KEYS): document(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [document(rng, depth + 1) for _ in range(rng.randrange(4))]


def canonical(v):
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pytest.mark.parametrize("names", [(), ("name", "e")])
def test_walked_documents_fold_back(spark, names):
    rng = random.Random(3)
    docs = [document(rng) for _ in range(80)] + [[{"name": "A", "v": 1}, {"name": " a", "v": 2}, "a", "b"]]
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)] + [(500, None), (501, "{broken"), (502, "")]
    df = spark.createDataFrame(rows, "id long, j string")
    nodes = json_trees.walk(df, "id", "j", names)
    assert {r.id: r.json for r in json_trees.fold(nodes, "id").collect()} == {i: canonical(d) for i, d in enumerate(docs)}
    if names:
        assert [r.key for r in nodes.where("id = 80 and depth = 1").orderBy("pos").collect()] == ["a", "a#2", "a#3", "b"]
    else:
        hashes = {r.id: r.hash for r in json_trees.canonical_hashes(df, "id", "j").collect()}
        assert hashes == {i: hashlib.sha256(canonical(d).encode()).hexdigest() for i, d in enumerate(docs)}


def test_no_documents(spark):
    nodes = json_trees.walk(spark.createDataFrame([(1, None)], "id long, j string"), "id", "j")
    assert nodes.collect() == [] and json_trees.fold(nodes, "id").collect() == []


def plain_patch(doc, path, value):
    """Objects only: what stands in the way of a path becomes an object."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]
    if not parts:
        return value
    doc = doc if isinstance(doc, dict) else {}
    if value is None and not (parts[0] in doc):
        return doc
    at = doc
    for p in parts[:-1]:
        if not isinstance(at.get(p), dict):
            if value is None:
                return doc
            at[p] = {}
        at = at[p]
    if value is None:
        at.pop(parts[-1], None)
    else:
        at[parts[-1]] = value
    return doc


def test_patches_are_applied_in_order(spark):
    rng = random.Random(4)

    def objects(depth=0):
        return {k: objects(depth + 1) if depth < 3 and rng.random() < 0.6 else rng.randrange(9) for k in rng.sample(["a", "b", "c/d"], rng.randrange(1, 4))}

    rows, patches, want = [], [], {}
    for i in range(60):
        doc = objects()
        rows.append((i, json.dumps(doc)))
        state = copy.deepcopy(doc)
        for seq in range(rng.randrange(6)):
            path = "".join("/" + rng.choice(["a", "b", "c~1d"]) for _ in range(rng.randrange(1, 5)))
            value = None if rng.random() < 0.25 else objects(2) if rng.random() < 0.5 else rng.randrange(100)
            patches.append((i, path, None if value is None else json.dumps(value), seq, f"p{seq}"))
            state = plain_patch(state, path, copy.deepcopy(value))
        want[i] = canonical(state)
    rng.shuffle(patches)
    patches += [(999, "/a", "1", 0, "nobody"), (0, None, "1", 0, "nowhere")]
    nodes = json_trees.walk(spark.createDataFrame(rows, "id long, j string"), "id", "j")
    out = json_trees.patched(nodes, spark.createDataFrame(patches, "id long, path string, value string, seq int, origin string"), "id")
    assert {r.id: r.json for r in json_trees.fold(out, "id").collect()} == want


def test_patches_of_lists_and_their_origin(spark):
    base = spark.createDataFrame([(1, '{"a":{"b":1,"c":[{"name":"p","v":1},{"name":"q","v":2}]},"s":5}')], "id long, j string")
    patches = [("/a/b", "7", 1, "A"), ("/a/b", "8", 2, "B"), ("/a/c/q/v", "9", 3, "C"), ("/a/c/r", '{"name":"r","v":[1,{"k":2}]}', 4, "D"), ("/s/t/u", '"new"', 5, "E"), ("/gone", None, 6, "F"), ("/a/c/p", None, 7, "G")]
    nodes = json_trees.walk(base, "id", "j", ("name",))
    out = json_trees.patched(nodes, spark.createDataFrame([(1, *p) for p in patches], "id long, path string, value string, seq int, origin string"), "id", ("name",))
    assert json_trees.fold(out, "id").first().json == '{"a":{"b":8,"c":[{"name":"q","v":9},{"name":"r","v":[1,{"k":2}]}]},"s":{"t":{"u":"new"}}}'
    assert {r.path: r.origin for r in out.where("origin is not null and kind = 'VALUE'").collect()} == {"/a/b": "B", "/a/c/q/v": "C", "/a/c/r/name": "D", "/a/c/r/v/0": "D", "/a/c/r/v/1/k": "D", "/s/t/u": "E"}
    changes = {(r.path, r.change) for r in json_trees.value_changes(nodes, out, "id", partial=False).collect()}
    assert changes == {("/a/b", "REPLACE"), ("/a/c/q/v", "REPLACE"), ("/a/c/p/name", "REMOVE"), ("/a/c/p/v", "REMOVE"), ("/a/c/r/name", "ADD"), ("/a/c/r/v/0", "ADD"), ("/a/c/r/v/1/k", "ADD"), ("/s/t/u", "ADD"), ("/s", "REMOVE")}
    assert all(r.change != "REMOVE" for r in json_trees.value_changes(nodes, out, "id").collect())


def random_rule(rng, depth=0, fields=("age", "income", "segment", "has_card")):
    if depth and rng.random() < 0.5 or depth > 3:
        field = rng.choice(fields)
        if field in ("age", "income"):
            return {"field": field, "operator": rng.choice(["GTE", "LT"]), "value": rng.randrange(5)}
        if field == "segment":
            return {"field": field, "operator": rng.choice(["IN", "EQ"]), "value": rng.choice(["x", "y"])}
        return {"field": field, "operator": "EQ", "value": rng.random() < 0.5}
    kind = rng.choice(["AND", "OR", "NOT", "AND", "OR"])
    return {"type": kind, "children": [random_rule(rng, depth + 1, fields) for _ in range(1 if kind == "NOT" else rng.randrange(1, 4))]}


def shuffled(rng, node):
    node = dict(node)
    if "children" in node:
        node["children"] = [shuffled(rng, c) for c in node["children"]]
        if node["type"] != "NOT":
            rng.shuffle(node["children"])
    return node


def test_signatures_ignore_the_order_of_children(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        rule = random_rule(rng)
        rows += [(2 * i, json.dumps(rule)), (2 * i + 1, json.dumps(shuffled(rng, rule)))]
    rows += [(1000, '{"type":"NOT","children":[{"field":"a","value":1},{"field":"b","value":2}]}'), (1001, '{"type":"NOT","children":[{"field":"b","value":2},{"field":"a","value":1}]}')]
    rows += [(1002, '{"field":" Age ","operator":"gte","value":10}'), (1003, '{"field":"age","operator":"GTE","value":10.0}'), (1004, '{"field":"age","operator":"GTE","value":100}')]
    rows += [(1005, '{"field":"s","operator":"IN","value":["B "," a"]}'), (1006, '{"field":"s","operator":"IN","value":["a","b"]}')]

    def plain(node):
        if "field" in node:
            v = node["value"]
            return f"{node['field']}|{node['operator']}|{v}"
        inside = [plain(c) for c in node["children"]]
        return f"{node['type']}[{','.join(inside if node['type'] == 'NOT' else sorted(inside))}]"

    df = spark.createDataFrame(rows, "id long, j string")
    got = {r.id: r.signature for r in trees.signatures(trees.nodes(df, "id", "j"), "id").where("depth = 0").collect()}
    want = {i: plain(json.loads(j)) for i, j in rows[:120]}
    assert len({(got[i], want[i]) for i in want}) == len({got[i] for i in want}) == len(set(want.values()))
    assert all(got[2 * i] == got[2 * i + 1] for i in range(60))
    assert got[1000] != got[1001] and got[1002] == got[1003] != got[1004] and got[1005] == got[1006]


def test_changes_between_rule_trees(spark):
    condition = lambda f, v, op="GTE": {"field": f, "operator": op, "value": v}
    group = lambda kind, *c: {"type": kind, "children": [*c]}
    old = group("AND", condition("age", 18), condition("area", "x", "EQ"), group("OR", condition("income", 5, "LTE"), condition("caste", "sc", "EQ")), group("NOT", condition("job", "y", "EQ")))
    news = {
        1: group("AND", *old["children"][::-1]),
        2: group("AND", condition("age", 21), *old["children"][1:]),
        3: group("OR", *old["children"]),
        4: group("AND", *old["children"], condition("job2", 1)),
        5: group("AND", *old["children"][1:]),
        6: group("AND", *old["children"][:2], group("OR", condition("caste", "sc", "EQ"), condition("income", 6, "LTE")), old["children"][3]),
        7: group("AND", *old["children"][:2], group("AND", *old["children"][2]["children"]), old["children"][3]),
        8: condition("age", 18),
        9: group("AND", condition("age", 18), condition("age", 60, "LT"), *old["children"][1:]),
    }
    base = trees.nodes(spark.createDataFrame([(i, json.dumps(old)) for i in news] + [(50, json.dumps(old))], "id long, j string"), "id", "j")
    new = trees.nodes(spark.createDataFrame([(i, json.dumps(n)) for i, n in news.items()], "id long, j string"), "id", "j")
    got = {i: set() for i in news}
    for r in trees.changes(base, new, "id", partial=False).collect():
        got[r.id].add((r.field, r.change, r.risk, r.old, r.new))
    assert got[1] == set()
    assert got[2] == {("age", "REPLACE", "CRITICAL", "GTE 18", "GTE 21")}
    assert got[3] == {("0", "MODIFY", "CRITICAL", "AND", "OR")}
    assert got[4] == {("job2", "ADD", "NORMAL", None, "GTE 1")}
    assert got[5] == {("age", "REMOVE", "CRITICAL", "GTE 18", None)}
    assert got[6] == {("income", "REPLACE", "CRITICAL", "LTE 5", "LTE 6")}
    assert got[7] == {("0.2", "MODIFY", "CRITICAL", "OR", "AND")}
    assert {(f, c) for f, c, *_ in got[8]} == {("area", "REMOVE"), ("income", "REMOVE"), ("caste", "REMOVE"), ("job", "REMOVE")}
    assert got[9] == {("age", "ADD", "CRITICAL", None, "LT 60")}
    kept = {(r.id, r.change) for r in trees.changes(base, new, "id").collect()}
    assert kept == {(2, "REPLACE"), (3, "MODIFY"), (4, "ADD"), (6, "REPLACE"), (7, "MODIFY"), (9, "ADD")}


def plain_states(node, profile):
    """True, False or None by the documented order of evaluation."""
    if "field" in node:
        v = profile[node["field"]]
        if v is None:
            return None
        want = node["value"]
        return {"GTE": lambda: v >= want, "LT": lambda: v < want, "IN": lambda: v == want, "EQ": lambda: v == want}[node["operator"]]()
    states = [plain_states(c, profile) for c in node["children"]]
    if node["type"] == "NOT":
        return None if states[0] is None else not states[0]
    stop = node["type"] == "OR"
    return stop if stop in states else None if None in states else not stop


def plain_trace(node, profile, path="0", skipped=False):
    state = plain_states(node, profile)
    yield path, "SKIPPED" if skipped else {True: "TRUE", False: "FALSE", None: "UNKNOWN"}[state]
    for i, c in enumerate(node.get("children", [])):
        yield from plain_trace(c, profile, f"{path}.{i}", skipped)
        if node["type"] != "NOT" and plain_states(c, profile) is (node["type"] == "OR"):
            skipped = True


def test_both_forms_trace_alike(spark):
    rng = random.Random(6)
    pick = lambda *v: rng.choice([None, *v])
    people = [{"profile_id": i, "age": pick(*range(5)), "income": pick(*range(5)), "segment": pick("x", "y"), "has_card": pick(True, False)} for i in range(40)]
    schemes = [{"id": f"S{k}", "rule": random_rule(rng)} for k in range(12)]
    profiles = spark.createDataFrame([tuple(p.values()) for p in people], "profile_id long, age int, income int, segment string, has_card boolean")
    nodes = rules.nodes_of(schemes)
    form = lambda df: {(r.profile_id, r.scheme_id, r.step, r.path, r.outcome) for r in df.collect()}
    by_rows = form(rules.trace_nodes(structure_plans.rule_facts(profiles), spark.createDataFrame(nodes, rules.NODES), max(n[3] for n in nodes)))
    want = {(p["profile_id"], s["id"], step, path, outcome) for p in people for s in schemes for step, (path, outcome) in enumerate(plain_trace(s["rule"], p))}
    assert by_rows == want
    assert form(rules.trace(profiles, schemes)) == want


def test_decisive_conditions_tell_only_what_was_looked_at(spark):
    steps = [(1, "S", 0, "0", "AND", None, "FALSE"), (1, "S", 1, "0.0", "COND", "age", "FALSE"), (1, "S", 2, "0.1", "COND", "income", "SKIPPED"), (2, "S", 0, "0", "AND", None, "UNKNOWN"), (2, "S", 1, "0.0", "COND", "age", "TRUE"), (2, "S", 2, "0.1", "COND", "income", "UNKNOWN")]
    df = spark.createDataFrame(steps, "profile_id long, scheme_id string, step int, path string, kind string, field string, outcome string")
    conditions = spark.createDataFrame([("S", "0.0", "GTE", "18"), ("S", "0.1", "LTE", "5")], "scheme_id string, path string, op string, required string")
    told = rules.decisive(df, conditions)
    assert {r.profile_id: r.told for r in told.collect()} == {1: ["age < 18"], 2: ["age >= 18", "income is missing"]}
    gold = spark.createDataFrame([(1, "S", ["AGE  < 18", "income > 5"])], "profile_id long, scheme_id string, expected array<string>")
    assert {r.profile_id: r.recall for r in rules.decisive_recall(told, gold).collect()} == {1: 0.5, 2: 1.0}


def test_written_rows_are_kept(spark):
    df = json_trees.written(spark.range(3).withColumn("r", F.rand()))
    assert df.collect() == df.collect()


def test_trees_of_one_input_partition_are_dealt_to_many(spark, monkeypatch):
    from trivalent.operators import json_trees, sizes, trees

    monkeypatch.setattr(sizes, "PART_ROWS", 5)
    docs = spark.createDataFrame([(i, f'{{"type":"AND","children":[{{"field":"age","value":{i}}}]}}') for i in range(100)], "id int, j string").coalesce(1)
    for nodes, n in ((trees.nodes(docs, "id", "j"), 200), (json_trees.walk(docs, "id", "j"), 600)):
        assert nodes.count() == n and nodes.where("depth = 0").rdd.getNumPartitions() >= 20


def test_patched_texts_write_no_nodes_and_shuffle_once_by_id(spark, sf):
    from pathlib import Path

    from trivalent.plans import structure_plans

    json_trees.written(spark.range(1))  # the folder is there
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {f.name for f in folder.iterdir()}
    out = structure_plans.patched_documents(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/customer.parquet").count()
    assert {f.name for f in folder.iterdir()} == before
    shuffles = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "REPARTITION_BY" in line]
    assert len(shuffles) == 1


def test_patched_texts_are_patched_nodes_folded(spark):
    docs = ['{"a":{"b":1,"c":[{"name":"p","v":1},{"name":"P ","v":2},"p","x"]},"s":5}', "[1,[2,{}],[]]", "7", "{broken", None, '{"":{"":[]}}', '["a","b","a","b","a","a#2"]']
    patches = [("/a/c/p#2/v", "9", 1, "A"), ("/a/c/q", '{"name":"q","w":["k","k"]}', 4, "B"), ("/a/c/p", None, 5, "C"), ("/s/t/u", '"new"', 5, "D"), ("/s/t/u", '"newer"', 5, "E"), ("/s", None, 3, "F"), ("", '{"z":1}', 6, "G"), ("/y/x", "{broken", 7, "H"), ("/b", "[[]]", 8, None), ("/0", None, 2, "I")]
    rows = spark.createDataFrame(list(enumerate(docs)), "id long, j string")
    for some in (patches[:6], patches[:8], patches, patches[7:], []):
        given = spark.createDataFrame([(i, *p) for i in range(9) for p in some], "id long, path string, value string, seq int, origin string")
        nodes = json_trees.written(json_trees.patched(json_trees.walk(rows, "id", "j", ("name",)), given, "id", ("name",)))
        texts, counts = {r.id: r.json for r in json_trees.fold(nodes, "id").collect()}, {r.id: (r.n, r.k) for r in nodes.groupBy("id").agg(F.count("*").alias("n"), F.count("origin").alias("k")).collect()}
        out = json_trees.patched_texts(rows, given, "id", "j", ("name",)).collect()
        assert {r.id: (r.json, r.n_nodes, r.n_patched) for r in out} == {i: (t, *counts[i]) for i, t in texts.items()} and set(texts) == {0, 1, 2, 5, 6}
        assert all(json.loads(t) is not None for t in texts.values())
    names = json_trees.walk(rows, "id", "j", ("name",)).where("id = 6 and depth = 1").orderBy("pos")
    assert [r.key for r in names.collect()] == ["a", "b", "a#2", "b#2", "a#3", "a#2"]
