"""A manifest of a dataset: hash trees over its rows, one a group and one over the groups, and a proof for each row.

Rows are leaves in the order of their group and key. They are dealt to partitions by ranges of that order, and one row a partition tells
each task the index of its first leaf (see ranges). A task keeps a mountain range of its current group: for each level the nodes that
wait for their run to fill. A run of `fanout` nodes is a carry: it is written with its children and becomes a node of the next level.
A group's last runs may be short; they are hashed as they are, without padding. Runs that begin or end in another partition are
written as pieces; these are at most two a level and partition, and are put together level by level, grouped by their run.

The written records are the manifest. Proofs are joins of each level's runs with the runs above, a row a run on both sides, so that a
group that holds most of the rows is as well spread as any other."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, new_folder, schema_of, table
from ..operators.ranges import in_ranges, places

FANOUT = 16
#: Records that a task hands over at once.
RECORDS = 500
_RECORD = "kind string, level int, grp string, run long, first int, keys array<string>, digests array<string>, changed array<string>"
_NAMES = [x.split(" ")[0] for x in _RECORD.split(", ")]
_ARROW = pa.schema([("kind", pa.string()), ("level", pa.int32()), ("grp", pa.string()), ("run", pa.int64()), ("first", pa.int32()), *((n, pa.list_(pa.string())) for n in _NAMES[5:])])


def digest(*values: Column) -> Column:
    """Hex SHA-256 of the values, each as its bytes' count, a colon and the value, or - for null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class _Mountains:
    """The nodes of one group that wait in one partition, by level: the index of the first, and (key, digest, changed) of each."""

    def __init__(self, grp: str, start: int, fanout: int, out: list) -> None:
        self.grp, self.at, self.fanout, self.out, self.waiting = grp, start, fanout, out, []

    def push(self, leaf: tuple) -> None:
        self._put(0, self.at, leaf)
        self.at += 1

    def _put(self, level: int, index: int, node: tuple) -> None:
        while True:
            if level == len(self.waiting):
                self.waiting.append((index, []))
            first, nodes = self.waiting[level]
            nodes.append(node)
            if (index + 1) % self.fanout:
                return
            node = self._close(level)
            if node is None:
                return
            level, index = level + 1, index // self.fanout

    def _close(self, level: int) -> tuple | None:
        """Write the run that waits at a level; the node above it, if the run begins in this partition."""
        first, nodes = self.waiting[level]
        whole = first % self.fanout == 0
        self._write("run" if whole else "piece", level, first, nodes)
        self.waiting[level] = (first + len(nodes), [])
        return (None, _joined([n[1] for n in nodes]), None) if whole else None

    def _write(self, kind: str, level: int, first: int, nodes: list) -> None:
        keys, digests, changed = zip(*nodes)
        self.out.append((kind, level, self.grp, first // self.fanout, first % self.fanout, None if level else keys, digests, None if level else changed))

    def end(self, goes_on: bool) -> None:
        """No more leaves in this partition: the last runs are closed as they are, or are pieces where the group goes on."""
        level, nodes_of_level = 0, self.at
        while level < len(self.waiting):
            first, nodes = self.waiting[level]
            if nodes and goes_on:
                self._write("piece", level, first, nodes)
            elif nodes and nodes_of_level == 1:
                self._write("top", level, 0, nodes)
            elif nodes and (node := self._close(level)):
                self._put(level + 1, first // self.fanout, node)
            level, nodes_of_level = level + 1, -(-nodes_of_level // self.fanout)


def _records(fanout: int, known: dict):
    def run(batches):
        now, part, out = None, None, []

        def handed(least):
            if len(out) >= least:
                columns = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW)
                out.clear()

        for batch in batches:
            for own, grp, key, leaf, changed in zip(*(c.to_pylist() for c in batch.columns)):
                if own != part or grp != now.grp:  # a task may hold several partitions of the order
                    if now:
                        now.end(own != part and known[part].goes_on)
                    now = _Mountains(grp, known[own].before if own != part else 0, fanout, out)
                    part = own
                now.push((key, leaf, changed))
                yield from handed(RECORDS)
        if now:
            now.end(known[part].goes_on)
        yield from handed(1)

    return run


@dataclass(frozen=True)
class Forest:
    """runs (level, grp, run, keys, digests, changed): all runs with more above them; tops (grp, level, keys, digest, changed): the last node of each group."""

    runs: DataFrame
    tops: DataFrame
    fanout: int


def forest(leaves: DataFrame, order: list[Column], fanout: int = FANOUT, parts: int | None = None) -> Forest:
    """A tree for each grp over leaves (grp, key, digest, changed and what the order needs), in the shared folder.

    changed is null or another digest that the leaf may have; it is only carried along. An empty table has no tree."""
    spark = leaves.sparkSession
    ordered = checkpointed(in_ranges(leaves, [F.col("grp"), *order], parts).select("part", "grp", "key", "digest", "changed"))
    known, totals = places(ordered, "grp")
    folder = new_folder(spark, "manifest")
    ordered.mapInArrow(_records(fanout, known), schema_of(_RECORD)).write.partitionBy("kind", "level").parquet(folder)
    records = spark.read.schema(schema_of(", ".join(sorted(_RECORD.split(", "), key=lambda c: c.split(" ")[0] in ("kind", "level"))))).parquet(folder)
    runs, tops = [records.where("kind = 'run'")], [records.where("kind = 'top'")]
    if totals:
        sizes = F.broadcast(spark.createDataFrame([*totals.items()], "grp string, total long"))  # fewer than partitions
        pieces, merged, level = records.where("kind = 'piece'"), None, 0
        while level == 0 or max(totals.values()) > fanout**level:
            here = pieces.where(F.col("level") == level).select("grp", "run", "first", "keys", "digests", "changed")
            here = here.unionByName(merged) if merged else here
            lists = F.array_sort(F.collect_list(F.struct("first", "keys", "digests", "changed")))
            whole = here.groupBy("grp", "run").agg(lists.alias("all"))  # at most fanout nodes
            flat = lambda name: F.flatten(F.transform("all", lambda x: x[name]))
            whole = checkpointed(whole.select("grp", "run", *(flat(n).alias(n) for n in ("keys", "digests", "changed"))))
            runs.append(whole.select(F.lit("run").alias("kind"), F.lit(level).alias("level"), "grp", "run", F.lit(0).alias("first"), "keys", "digests", "changed"))
            nodes = whole.join(sizes, "grp").select("grp", "run", F.array(F.sha2(F.array_join("digests", ""), 256)).alias("digests"), (F.col("total") <= fanout ** (level + 1)).alias("top"))
            none = F.lit(None).cast("array<string>")
            nodes = nodes.select("grp", (F.col("run") / fanout).cast("long").alias("run"), (F.col("run") % fanout).cast("int").alias("first"), none.alias("keys"), "digests", none.alias("changed"), "top")
            level += 1
            merged = nodes.where("not top").drop("top")
            tops.append(nodes.where("top").select(F.lit("top").alias("kind"), F.lit(level).alias("level"), *_NAMES[2:]))
    union = lambda found: found[0].select(*_NAMES) if len(found) == 1 else found[0].select(*_NAMES).unionByName(union(found[1:]))
    tops = union(tops).select("grp", "level", F.col("keys")[0].alias("key"), F.col("digests")[0].alias("digest"), F.col("changed")[0].alias("changed"))
    return Forest(union(runs).drop("kind", "first"), tops, fanout)


def _step(digests: Column, at: Column) -> Column:
    """What is hashed before and after a run's node at a place (from 0)."""
    return F.struct(F.array_join(F.slice(digests, 1, at), "").alias("before"), F.array_join(F.slice(digests, at + 2, F.size(digests)), "").alias("after"))


def paths(trees: Forest, tops: DataFrame) -> DataFrame:
    """key, changed, digest, grp and path of every leaf: the steps from it to the top of its tree, then those that tops (grp, path, ...) has; tops' other columns are carried along.

    Each level's runs are joined with those above by group and run, which is one row on the upper side."""
    levels = sorted(r.level for r in trees.runs.select("level").distinct().collect())  # a logarithm of the rows
    carried = [c for c in tops.columns if c not in ("grp", "path")]
    above = trees.tops.join(tops, "grp").withColumnRenamed("level", "top_level")
    alone = above.where("top_level = 0").select("key", "changed", "digest", "grp", "path", *carried)
    # what a group's last run lies below has no run of its own: a row without digests stands for it
    none = F.lit(None).cast("array<string>")
    start = above.where("top_level > 0").select("grp", F.lit(0).cast("long").alias("parent"), none.alias("above"), "path", F.col("top_level").alias("level"), *carried)
    upper = None
    for level in reversed(levels):
        known = start.where(F.col("level") == level + 1).drop("level")
        if upper is not None:
            known = known.unionByName(upper.select("grp", F.col("run").alias("parent"), F.col("digests").alias("above"), "path", *carried))
        here = trees.runs.where(F.col("level") == level).drop("level").withColumn("parent", (F.col("run") / trees.fanout).cast("long"))
        place = (F.col("run") % trees.fanout).cast("int")
        path = F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat(F.array(_step(F.col("above"), place)), "path"))
        upper = here.join(known, ["grp", "parent"]).select("grp", "run", "keys", "digests", "changed", path.alias("path"), *carried)
    if upper is None:
        return alone
    leaf = upper.select("grp", "path", *carried, "digests", F.posexplode(F.arrays_zip("keys", "changed", "digests")).alias("at", "leaf"))
    leaf = leaf.select(F.col("leaf.keys").alias("key"), F.col("leaf.changed").alias("changed"), F.col("leaf.digests").alias("digest"), "grp", F.concat(F.array(_step(F.col("digests"), F.col("at"))), "path").alias("path"), *carried)
    return leaf.unionByName(alone)


def proofs(leaves: DataFrame, order: list[Column], fanout: int = FANOUT) -> DataFrame:
    """key, grp, leaf, changed, subroot, root, path for leaves (grp, key, digest, changed): the trees of all groups, a tree over these in
    the order of their names, and each leaf's steps to the root.

    Groups may be as many as rows: the tree over them is made like the others. Leaves that are equal in the order are ordered by their
    digest; repeated rows are a leaf each, and all are proved."""
    own = forest(leaves, [*order, F.col("digest")], fanout)
    groups = own.tops.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest", F.lit(None).cast("string").alias("changed"))
    upper = forest(checkpointed(groups), [F.col("key")], fanout)
    root = upper.tops.select("grp", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("digest").alias("root"))
    of_groups = checkpointed(paths(upper, root).select(F.col("key").alias("grp"), F.col("digest").alias("subroot"), "root", "path"))
    return paths(own, of_groups).withColumnRenamed("digest", "leaf")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    return F.aggregate(path, leaf, lambda x, step: F.sha2(F.concat(step["before"], x, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.aggregate(path, F.lit(""), lambda x, step: F.concat(x, step["before"], step["after"]))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_proofs(docs: DataFrame, changed_text: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, path, changed for every document; a tree a source, null first, documents by doc_id, null first.

    changed is the digest that the row has with changed_text in place of its text, null where changed_text is null. Any column may be
    null, and texts may be empty or long: a leaf tells these apart. Equal doc_ids are ordered by their leaves' digests; repeated rows are
    a leaf each. An empty table gives no row. Extra columns are no part of a leaf, whatever their names."""
    text = F.lit(None).cast("string") if changed_text is None else changed_text
    values = {c: F.col(c) for c in FIELDS}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("grp"),
        F.col("doc_id"),
        F.col("doc_id").cast("string").alias("key"),
        digest(*values.values()).alias("digest"),
        F.when(text.isNotNull(), digest(*(values | {"text": text}).values())).alias("changed"),
    )
    out = proofs(checkpointed(leaves), [F.col("doc_id")], fanout)
    return out.select(F.col("key").cast("long").alias("doc_id"), "leaf", "subroot", "root", "path", "changed")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, checked against the root with A-Z lower-cased in the text of a fifth of the documents."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", upper, upper.lower()))
    found = document_proofs(table(spark, sf_dir, "documents", *FIELDS), tampered)
    again = folded(F.coalesce("changed", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a decimal number, a byte at a time and then eight shifts, as a fold over the operations
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split({0}, ''), lambda c: list_concat([ascii(c)::UBIGINT], [999::UBIGINT FOR i IN range(8)])))),
  lambda x, y: CASE WHEN y < 999 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END), 4294967295::UBIGINT)"""
_VALUE = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c) for c in FIELDS[:4]) + " || {0})"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _climb(name: str, leaves: str) -> str:
    """CTEs name_node (grp, level, idx, digest), name_run and name_path (grp, id, level, idx, sibs: before and after) over leaves (grp, id, digest, idx)."""
    return f"""
{name}_node AS (
  SELECT grp, 0 AS level, idx, digest FROM {leaves}
  UNION ALL
  SELECT grp, max(level) + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}_node) WHERE n > 1 GROUP BY grp, idx // 16),
{name}_step AS (
  SELECT a.grp, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
  FROM {name}_node a JOIN {name}_node b ON a.grp = b.grp AND a.level = b.level AND a.idx // 16 = b.idx // 16
  WHERE a.level < (SELECT max(level) FROM {name}_node t WHERE t.grp = a.grp) GROUP BY a.grp, a.level, a.idx)"""


OP11_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('=' || source, '-') AS grp, {_LEAF.format(_VALUE.format("text"))} AS digest,
    CASE WHEN text IS NOT NULL AND {_CRC.format("doc_id::VARCHAR")} % 5 = 0 THEN {_LEAF.format(f"strlen({_LOWER}) || ':' || {_LOWER}")} END AS changed
  FROM documents),
own AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM leaf),
{_climb("own", "own")},
top AS (SELECT '' AS grp, grp AS name, digest, row_number() OVER (ORDER BY grp) - 1 AS idx FROM own_node t WHERE level = (SELECT max(level) FROM own_node s WHERE s.grp = t.grp)),
{_climb("top", "top")},
walk AS (
  SELECT doc_id, o.digest AS leaf, t.digest AS subroot, t.idx AS top_idx, o.grp, 0 AS level, o.idx, '' AS sibs, coalesce(changed, o.digest) AS folded FROM own o JOIN top t ON t.name = o.grp
  UNION ALL
  SELECT w.doc_id, leaf, subroot, top_idx, w.grp, w.level + 1, w.idx // 16, sibs || before || after, sha256(before || folded || after)
  FROM walk w JOIN own_step s ON s.grp = w.grp AND s.level = w.level AND s.idx = w.idx),
up AS (
  SELECT doc_id, leaf, subroot, 0 AS level, top_idx AS idx, sibs, folded FROM walk w WHERE level = (SELECT max(level) FROM own_node s WHERE s.grp = w.grp)
  UNION ALL
  SELECT doc_id, leaf, subroot, w.level + 1, w.idx // 16, sibs || before || after, sha256(before || folded || after)
  FROM up w JOIN top_step s ON s.level = w.level AND s.idx = w.idx)
SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM up, (SELECT digest AS root FROM top_node ORDER BY level DESC LIMIT 1) WHERE level = (SELECT max(level) FROM top_node)
"""
