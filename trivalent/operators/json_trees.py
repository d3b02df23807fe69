"""JSON documents as rows, a row a node: walked to any depth, changed by paths, and folded back to canonical text.

A node has a path of keys joined by slashes (the document itself is the empty path; ~ and / in keys are ~0 and ~1), the path of its
parent, its key, its place, its kind (OBJECT, ARRAY or VALUE) and, if it is a value, that as JSON. Elements of lists have their number as
key, or the name that they bear, so that they can be found whatever their place. Documents are dealt by id once, and walked, patched
and folded a level at a time by the tasks that got them: generators, windows and groups within an id, which need no other shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sizes
from .sizes import written

NODE = ("path", "parent", "key", "pos", "depth", "kind", "value")
#: The place of a new element, after all that were there.
NEW = 1 << 30
#: Characters of JSON a partition, about: some ten times as much when they are nodes.
PART_CHARS = 4_000_000


def _kind(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").otherwise("VALUE")


def segment(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _below(path: Column, key: Column) -> Column:
    return F.concat(path, F.lit("/"), segment(key))


def nesting(json: Column) -> Column:
    """How many objects and lists stand in one another where a JSON text is deepest: no node of it lies deeper. Null, or 0, for what is no JSON."""
    brackets = F.regexp_replace(F.regexp_replace(F.regexp_replace(json, r"\\.", ""), '"[^"]*"', ""), r"[^\[\]{}]+", "")
    steps = F.transform(F.split(brackets, ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))
    return F.when(brackets == "", 0).when(F.try_parse_json(json).isNotNull(), F.aggregate(steps, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.greatest(s["most"], s["at"] + x).alias("most")))["most"])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numbered(keys: Column) -> Column:
    """The keys of a list's elements, of equal ones the second as key#2, and so on. Equal ones are found by sorting, whatever the list's length."""
    row = lambda k, i: F.struct(k.alias("k"), i.alias("i"))
    number = lambda x, n: F.struct(x["i"].alias("i"), F.when(n > 1, F.concat(x["k"], F.lit("#"), n.cast("string"))).otherwise(x["k"]).alias("k"))

    def by_runs(s):
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["k"] != F.get(s, i - 1)["k"]))
        lengths = lambda b: F.flatten(F.transform(b, lambda at, r: F.sequence(F.lit(1), F.coalesce(F.get(b, r + 1), F.size(s)) - at)))
        return _let(_let(begins, lengths), lambda n: F.array_sort(F.transform(s, lambda x, i: number(x, F.get(n, i)))))

    again = F.transform(_let(F.array_sort(F.transform(keys, row)), by_runs), lambda x: x["k"])
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), again).otherwise(keys)


def _key(e: Column, pos: Column, names: tuple[str, ...]) -> Column:
    own = [F.lower(F.trim(F.try_variant_get(e, f"$.{n}", "string"))) for n in names]
    text = [F.when(F.schema_of_variant(e) == "STRING", F.lower(F.trim(F.try_variant_get(e, "$", "string"))))] if names else []
    return F.coalesce(*(F.when(n != "", n) for n in own + text), pos.cast("string"))


def _opened(rows: DataFrame, names: tuple[str, ...], levels: int) -> DataFrame:
    """rows (NODE, and v: the variant of what is still to be opened) with all nodes below, to so many levels. Nothing is shuffled or kept: a level is one generator over the rows."""
    others = [c for c in rows.columns if c not in (*NODE, "v")]
    entry = lambda key, pos, e: F.struct(key.alias("key"), pos.cast("int").alias("pos"), e.alias("e"))
    own = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("variant").alias("e")))
    for _ in range(levels):
        fields = F.transform(F.map_entries(F.col("v").cast("map<string,variant>")), lambda x, i: entry(x["key"], i, x["value"]))
        elements = F.col("v").cast("array<variant>")
        keys = F.transform(elements, lambda e, i: _key(e, i, names))
        keyed = _let(_numbered(keys) if names else keys, lambda k: F.transform(elements, lambda e, i: entry(F.get(k, i), i, e)))
        below = F.when(F.col("v").isNotNull() & (F.col("kind") == "OBJECT"), fields).when(F.col("v").isNotNull(), keyed)
        rows = rows.withColumn("x", F.explode(F.concat(own, F.coalesce(below, F.array().cast("array<struct<key:string,pos:int,e:variant>>")))))
        new = F.col("x.pos").isNotNull()
        rows = rows.select(
            *others, F.when(new, _below(F.col("path"), F.col("x.key"))).otherwise(F.col("path")).alias("path"), F.when(new, F.col("path")).otherwise(F.col("parent")).alias("parent"),
            F.when(new, F.col("x.key")).otherwise(F.col("key")).alias("key"), F.when(new, F.col("x.pos")).otherwise(F.col("pos")).alias("pos"), (F.col("depth") + F.when(new, 1).otherwise(0)).alias("depth"),
            F.when(new, _kind(F.col("x.e"))).otherwise(F.col("kind")).alias("kind"), "value", F.col("x.e").alias("v"),
        )
        value = F.col("v").isNotNull() & (F.col("kind") == "VALUE")
        rows = rows.select(*others, *NODE[:-1], F.when(value, F.to_json("v")).otherwise(F.col("value")).alias("value"), F.when(~value, F.col("v")).alias("v"))
    return rows.select(*others, *NODE)


def _parts(rows: int, chars: int, least: int) -> int:
    return max(least, -(-rows // sizes.PART_ROWS), -(-chars // PART_CHARS))


def _least(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def walk(docs: DataFrame, id: str, json: str, names: tuple[str, ...] = ()) -> DataFrame:
    """id and NODE for every node of the documents in a column of JSON text. What is null or no JSON has no nodes.

    Elements of a list that are objects with a text under one of `names` are keyed by it, trimmed and in lower case, and so are elements that are
    text themselves; of equal names in a list the second is name#2, and so on. Without names all elements are keyed by number, from 0.
    Ids must be unique: rows that repeat one would be one document."""
    n, chars, levels = docs.agg(F.count("*"), F.coalesce(F.sum(F.length(json)), F.lit(0)), F.coalesce(F.max(nesting(F.col(json))), F.lit(0))).first()
    none = F.lit(None).cast("string")
    root = docs.select(id, json).repartition(_parts(n, chars, _least(docs)), id).select(id, F.try_parse_json(json).alias("v")).where("v is not null").withColumn("kind", _kind(F.col("v")))
    value = F.col("kind") == "VALUE"
    root = root.select(id, F.lit("").alias("path"), none.alias("parent"), none.alias("key"), F.lit(0).alias("pos"), F.lit(0).alias("depth"), "kind", F.when(value, F.to_json("v")).alias("value"), F.when(~value, F.col("v")).alias("v"))
    return written(_opened(root, names, levels))


def _quoted(text: Column) -> Column:
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def fold(nodes: DataFrame, id: str, deepest: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, json, and what to keep of the documents' own nodes: each document as text without spaces, keys of objects sorted, elements of lists by their place.

    Nodes that have no parent are documents; those whose parents are missing are lost. Where it is known how deep nodes may lie,
    rows that are dealt by id are folded as they come; else they are written first, and looked at."""
    if deepest is None:
        nodes = written(nodes.select(id, *NODE, *keep))
        deepest = nodes.agg(F.max("depth")).first()[0] or 0
    me = F.struct("depth", "kind", "parent", "key", "pos", F.col("value").alias("json"), *keep)
    entry = lambda json: F.struct("pos", "key", json.alias("json"))
    leaf = (F.col("kind") == "VALUE") & F.col("parent").isNotNull()
    # values go to what holds them at once, then what holds others, from the deepest up; a group is one list or object
    level = nodes.groupBy(id, F.when(leaf, F.col("parent")).otherwise(F.col("path")).alias("path")).agg(F.collect_list(F.when(leaf, entry(F.col("value")))).alias("items"), F.max(F.when(leaf & (F.col("depth") > 0), None).otherwise(me)).alias("me"))
    for depth in range(deepest, -1, -1):
        level = level.where("me is not null").select(id, "path", "items", "me.*")
        of = F.col("kind")
        items = F.array_sort(F.transform("items", lambda x: F.struct(F.when(of == "ARRAY", x["pos"]).otherwise(0).alias("pos"), x["key"].alias("key"), x["json"].alias("json"))))
        inside = F.array_join(F.transform(items, lambda x: F.when(of == "OBJECT", F.concat(_quoted(x["key"]), F.lit(":"), x["json"])).otherwise(x["json"])), ",")
        text = F.when(of == "VALUE", F.col("json")).when(of == "ARRAY", F.concat(F.lit("["), inside, F.lit("]"))).otherwise(F.concat(F.lit("{"), inside, F.lit("}")))
        here = F.col("depth") == depth
        if depth == 0:
            return level.where(here).select(id, text.alias("json"), *keep)
        level = level.select(id, F.when(here, F.col("parent")).otherwise(F.col("path")).alias("path"), F.when(here, F.array(entry(text))).otherwise(F.col("items")).alias("items"), F.when(~here, F.struct("depth", "kind", "parent", "key", "pos", "json", *keep)).alias("me"))
        level = level.groupBy(id, "path").agg(F.flatten(F.collect_list("items")).alias("items"), F.max("me").alias("me"))


def canonical_hashes(docs: DataFrame, id: str, json: str) -> DataFrame:
    """id, hash: SHA-256 of each document's canonical text."""
    return fold(walk(docs, id, json), id).select(id, F.sha2("json", 256).alias("hash"))


def _ancestors(path: Column, itself: bool) -> Column:
    parts = F.split(path, "/")
    to = F.size(parts) if itself else F.size(parts) - 1
    return F.when(to > 0, F.transform(F.sequence(F.lit(1), to), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def _begun(patches: DataFrame, id: str) -> DataFrame:
    """What patches (id, path, value, seq, origin, own: a whole document) begin with: its mark, its parents, which it sees to for a while, and the top of its value, still to be opened."""
    none, parents = F.lit(None).cast("string"), F.transform(_ancestors(F.col("path"), False), lambda p: F.struct(p.alias("path"), F.lit("PARENT").alias("kind")))
    ends = F.when(F.col("own"), F.array().cast("array<struct<path:string,kind:string>>")).otherwise(F.concat(F.array(F.struct("path", F.lit("MARK").alias("kind"))), F.when(F.col("value").isNotNull(), parents).otherwise(F.array().cast("array<struct<path:string,kind:string>>"))))
    rows = patches.withColumn("v", F.try_parse_json("value")).withColumn("top", F.when(F.col("v").isNotNull(), F.array(F.struct("path", _kind(F.col("v")).alias("kind")))).otherwise(F.array().cast("array<struct<path:string,kind:string>>")))
    rows = rows.select(id, "seq", "origin", "own", "v", F.explode(F.concat("top", ends)).alias("x"))
    path, parts = F.col("x.path"), F.split("x.path", "/")
    last = F.element_at(parts, -1)
    return rows.select(
        id, "seq", "origin", "own", path.alias("path"), F.when(path != "", F.regexp_replace(path, "/[^/]*$", "")).alias("parent"), F.when(path != "", F.replace(F.replace(last, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))).alias("key"),
        F.when(F.col("own"), 0).otherwise(NEW).alias("pos"), (F.size(parts) - 1).alias("depth"), F.col("x.kind").alias("kind"),
        F.when(F.col("x.kind") == "VALUE", F.to_json("v")).alias("value"), F.when(F.col("x.kind").isin("OBJECT", "ARRAY"), F.col("v")).alias("v"),
    )


def _resolved(rows: DataFrame, id: str, deepest: int) -> DataFrame:
    """What is left of rows (NODE, seq, origin, own) when all patches, of paths down to deepest, are applied. One sort by path serves all windows: each is one document's, one of its nodes' with all below, or one path's."""
    parts = [f"_{n}" for n in range(1, deepest + 1)]
    rows = rows.select("*", F.split("path", "/").alias("_parts")).select("*", *(F.get("_parts", F.lit(n)).alias(p) for n, p in enumerate(parts, 1))).drop("_parts")
    within = [Window.partitionBy(id, *parts[:n]) for n in range(deepest + 1)]
    here = Window.partitionBy(id, *parts, "path")
    parent = F.col("kind") == "PARENT"
    rows = rows.withColumn("_nth", F.row_number().over(here.orderBy(parent.desc(), F.desc("seq"), F.desc("origin"))))
    rows = rows.withColumn("_pos", F.max(F.when(F.col("own"), F.col("pos"))).over(here))  # an element that was there before keeps its place, others come after all, by seq
    ends = [F.max(F.when((F.col("kind") == "MARK") & (F.col("depth") == n), F.col("seq"))).over(w) for n, w in enumerate(within)]
    rows = rows.select("*", F.max("own").over(within[0]).alias("_known"), *(e.alias(f"_end{n}") for n, e in enumerate(ends)))
    end = F.greatest(*(f"_end{n}" for n in range(deepest + 1)), F.lit(None).cast("long"))
    alive = rows.where(F.col("_known") & (F.col("kind") != "MARK") & (end.isNull() | (end <= F.col("seq"))))
    alive = alive.select("*", F.max(F.col("kind").isin("OBJECT", "ARRAY")).over(here).alias("_holds"), F.max(parent).over(here).alias("_wanted"))
    alive = alive.where(F.when(parent, ~F.col("_holds") & (F.col("_nth") == 1)).otherwise(F.col("_holds") | ~F.col("_wanted")))
    pos = F.when(F.col("pos") == NEW, F.coalesce("_pos", (F.col("pos") + F.greatest("seq", F.lit(0))).cast("int"))).otherwise(F.col("pos"))
    changed = {"pos": pos, "kind": F.when(parent, "OBJECT").otherwise(F.col("kind"))}
    return alive.select(id, *(changed[c].alias(c) if c in changed else c for c in NODE), "origin")


def _sized(patches: DataFrame) -> tuple[int, int, int, int, int]:
    """Of patches (path, value): rows, characters, the depth of the deepest path, the levels of the deepest value, and how deep nodes may lie."""
    rows = patches.select(F.coalesce(F.length("value"), F.lit(0)).alias("chars"), (F.size(F.split("path", "/")) - 1).alias("depth"), F.coalesce(nesting(F.col("value")), F.lit(0)).alias("levels"))
    return tuple(x or 0 for x in rows.agg(F.count("*"), F.sum("chars"), F.max("depth"), F.max("levels"), F.max(F.col("depth") + F.col("levels"))).first())


def _wanted(patches: DataFrame, id: str) -> DataFrame:
    return patches.where("seq is not null and path is not null").select(id, "path", F.col("seq").cast("long").alias("seq"), "value", "origin", F.lit(False).alias("own"))


def _last(patches: DataFrame, id: str) -> DataFrame:
    """Of patches of equal seq at one path the one with the largest value."""
    one = patches.groupBy(id, "own", "path", "seq").agg(F.max(F.struct("value", "origin")).alias("p"))
    return one.select(id, "own", "path", "seq", "p.value", "p.origin")


def patched(nodes: DataFrame, patches: DataFrame, id: str, names: tuple[str, ...] = ()) -> DataFrame:
    """nodes with patches (id, path, value: JSON, null to remove; seq; origin) applied in the order of seq, and the origin of each node.

    A patch replaces what is at its path with all below it, whoever put it there before. Parents that aren't there become objects, values among
    them too; new elements of lists come last, in the order of seq. A document's own nodes have no origin. Patches of equal seq at
    one path would contradict each other: the one with the largest value stays. Patches without seq, path or a document are ignored."""
    wanted = _wanted(patches, id)
    n, chars, deepest, levels, _ = _sized(wanted)
    new = _opened(_begun(_last(wanted, id), id), names, levels)
    own = nodes.select(id, *NODE, F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("origin"), F.lit(True).alias("own"))
    return _resolved(own.unionByName(new).repartition(_parts(nodes.count() // 10 + n, chars, _least(nodes)), id), id, deepest)


def patched_texts(docs: DataFrame, patches: DataFrame, id: str, json: str, names: tuple[str, ...] = ()) -> DataFrame:
    """id, json, n_nodes and n_patched: documents of JSON text with patches applied (see walk and patched), as canonical text; how many nodes they have then, and how many of these came with patches.

    Documents and patches are shuffled once, by id, as they are given: nodes are opened, patched and folded in the tasks that get them, and none is written."""
    whole = docs.select(id, F.lit("").alias("path"), F.lit(-1).cast("long").alias("seq"), F.col(json).alias("value"), F.lit(None).cast("string").alias("origin"), F.lit(True).alias("own"))
    given = whole.unionByName(_wanted(patches, id))
    n, chars, deepest, levels, down = _sized(given)
    rows = _opened(_begun(_last(given.repartition(_parts(n, chars, _least(docs)), id), id), id), names, levels)
    every = Window.partitionBy(id)
    out = _resolved(rows, id, deepest).select("*", F.count("*").over(every).alias("n_nodes"), F.count("origin").over(every).alias("n_patched"))
    return fold(out, id, down, ("n_nodes", "n_patched"))


def value_changes(base: DataFrame, new: DataFrame, id: str, partial: bool = True) -> DataFrame:
    """id, path, change, old, new for nodes of two states of documents: values that were added, replaced or (unless new is partial, where silence
    removes nothing) removed."""
    a = base.where("kind = 'VALUE' and value <> 'null'").select(id, "path", F.col("value").alias("old"))
    b = new.where("kind = 'VALUE' and value <> 'null'").select(id, "path", F.col("value").alias("new"))
    both = a.join(b, [id, "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "ADD").when(F.col("new").isNull(), "REMOVE").otherwise("REPLACE")
    out = both.select(id, "path", change.alias("change"), "old", "new")
    return out.where("change <> 'REMOVE'") if partial else out
