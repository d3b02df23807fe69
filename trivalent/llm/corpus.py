"""Whole-corpus steps built from the operators: each takes documents and returns what it keeps of them, in all their columns."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, hinted, map_columns, released_shuffles, schema_of, text_bytes
from .components import components
from .simhash import WORDS, candidate_roots, set_fingerprint, shingle_hashes

#: Sets that are compared with each other in one step, and about how many bytes of them.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Sets that a task holds while others pass by, in blocks, and those that pass by.
HELD, PASSING = 8, 32
#: Members of sets in one matrix, and rows that are unpacked at once.
STEP, ROWS = 4096, 256


def text_hash(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))


def matching(docs: DataFrame, keys: DataFrame, how: str, text: str = "text") -> DataFrame:
    """docs whose id and text hash are among keys (doc_id, text_hash), or are not: how is left_semi or left_anti."""
    key_id, key_hash = fresh(docs, "key_id"), fresh(docs, "key_hash")
    keys = hinted(checkpointed(keys.select(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_hash)).distinct()))
    return docs.join(keys, docs["doc_id"].eqNullSafe(F.col(key_id)) & (text_hash(text) == F.col(key_hash)), how)


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set of left shares with each of right, by products of their incidence matrices, some members at a time.

    left and right may be one and the same list."""
    sets = left if left is right else [*left, *right]
    out = np.zeros((len(left), len(right)), np.float32)  # exact below 2^24 members
    side = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    members, number = np.unique(np.concatenate(sets), return_inverse=True)
    number = number.astype(np.int32)
    if left is right:
        shared = np.bincount(number, minlength=len(members)) > 1
        sizes = np.array([len(x) for x in left])
        np.fill_diagonal(out, sizes - np.bincount(side, shared[number], minlength=len(sets)))  # what only a set itself has
    else:
        shared = (np.bincount(number[side < len(left)], minlength=len(members)) > 0) & (np.bincount(number[side >= len(left)], minlength=len(members)) > 0)
    column = np.cumsum(shared, dtype=np.int32) - 1
    side, number = side[shared[number]], column[number[shared[number]]]
    order = np.argsort(number, kind="stable")
    side, number = side[order], number[order]
    for at in range(0, int(shared.sum()), STEP):
        s, e = np.searchsorted(number, [at, at + STEP])
        m = np.zeros((len(sets), STEP), np.float32)
        m[side[s:e], number[s:e] - at] = 1
        out += m[: len(left)] @ (m if left is right else m[len(left) :]).T
    return out


def _similar(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    shared = _intersections(left, right)
    sizes = np.array([len(x) for x in left], np.float32)[:, None] + np.array([len(x) for x in right], np.float32)[None, :]
    return (shared.astype(np.float64) >= similarity * (sizes - shared).astype(np.float64)) & (sizes > 0)


def _labels(near: np.ndarray) -> np.ndarray:
    """The first member of each one's component under a symmetric matrix of links."""
    out = np.full(len(near), -1)
    for i in range(len(near)):
        if out[i] < 0:
            reached = np.zeros(len(near), bool)
            front = reached.copy()
            front[i] = True
            while front.any():
                reached |= front
                front = near[front].any(0) & ~reached
            out[reached] = i
    return out


def _groups(batches):
    """Rows in order of their first two columns, a group of equal ones at a time, as lists of the other columns."""
    key, rows = None, []
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        for *own, values in zip(*(c.to_pylist() for c in batch.columns[:2]), zip(*(c.to_pylist() for c in batch.columns[2:]))):
            if own != key and rows:
                yield key, list(zip(*rows))
                rows = []
            key = own
            rows.append(values)
    if rows:
        yield key, list(zip(*rows))


def _sets(hashes) -> list[np.ndarray]:
    return [np.frombuffer(h, np.uint64) for h in hashes]


def _block_labels(sets: DataFrame, similarity: float) -> DataFrame:
    """node, root, label for sets (root, block, node, hashes): the smallest node of each one's component within its block."""
    arrow = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("label", pa.int64())])

    def run(batches):
        for (root, _), (node, hashes) in _groups(batches):
            node, held = np.array(node, np.int64), _sets(hashes)
            order = np.argsort(node)
            held = [held[i] for i in order]
            label = node[order][_labels(_similar(held, held, similarity))]
            yield pa.RecordBatch.from_arrays([pa.array(node[order]), pa.array(np.full(len(node), root)), pa.array(label)], schema=arrow)

    rows = sets.select("root", "block", "node", "hashes").repartition("root", "block").sortWithinPartitions("root", "block", "node")
    return rows.mapInArrow(run, schema_of("node long, root long, label long"))


def _crossing_links(sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """a, b: links between labels for sets (root, pair, rest, label, hashes): of each that is rest with all others of its pair.

    A task holds the rest of a pair, which comes first, and the others pass by, a block at a time."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(label, held, others):
        i, j = np.nonzero(_similar(held, _sets(h for _, h in others), similarity))
        other = np.array([x for x, _ in others], np.int64)
        ends = np.unique(np.sort(np.stack([np.array(label, np.int64)[i], other[j]], 1), 1), axis=0)
        ends = ends[ends[:, 0] != ends[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=arrow)

    def run(batches):
        key, label, held = None, [], []
        for batch in (b.slice(at, block) for b in batches for at in range(0, b.num_rows, block)):
            for pair, rows in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: r[:2]):
                if pair != key:
                    key, label, held = pair, [], []
                others = []
                for _, _, rest, own, hashes in rows:
                    if rest:
                        label.append(own)
                        held += _sets([hashes])
                    else:
                        others.append((own, hashes))
                if held and others:
                    yield links(label, held, others)

    rows = sets.select("root", "pair", "rest", "label", "hashes").repartition("root", "pair").sortWithinPartitions("root", "pair", F.col("rest").desc())
    return rows.mapInArrow(run, schema_of("a long, b long"))


def verified_groups(sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """node, label for sets (node, root, hashes): nodes of one root have one label if a chain of links joins them.

    A link is a pair of one root with at least `similarity`, each pair's whole sets compared. Roots with more than a block of nodes are cut into
    blocks: first each block is grouped on its own, then one node a group stands for it among the others' as long as that joins any,
    and last all nodes outside of their root's largest group are compared with all: some blocks of them are held while all others pass by, so that
    sets are sent to a task for every HELD blocks outside of the largest group, not for every block. A group of any number of similar
    nodes takes work in proportion to it, and no pair is left out but those of nodes that are joined anyway. `sets` is read again
    for each step, so it should be computed; what steps keep are numbers."""

    def blocks(df):
        n, size = F.count("*"), F.sum(F.length("hashes"))
        return df.groupBy("root").agg(F.greatest(F.ceil(n / block), F.ceil(size / BLOCK_BYTES)).alias("blocks")).where("blocks > 1")

    def dealt(df, counts, salt):
        return df.join(hinted(counts), "root", "left").withColumn("block", F.pmod(F.xxhash64("node", F.lit(salt)), F.coalesce("blocks", F.lit(1))))

    large = checkpointed(blocks(sets))
    labels = checkpointed(_block_labels(dealt(sets, large, 0), similarity))
    if large.isEmpty():
        return labels.select("node", "label")
    own = checkpointed(labels.join(hinted(large.select("root")), "root", "left_semi"))
    links, heads, salt = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b").limit(0), own.where("node = label"), 0
    while True:
        several = checkpointed(heads.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"))
        heads = checkpointed(heads.join(hinted(several.select("root")), "root", "left_semi").select("node"))
        before, salt = heads.count(), salt + 1
        held = sets.join(hinted(heads), "node", "left_semi")
        found = checkpointed(_block_labels(dealt(held, checkpointed(blocks(held)), salt), similarity))
        links = links.union(found.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b"))
        heads = found.where("node = label")
        if heads.count() == before:
            break
    own = _relabelled(own, links)
    sizes = own.groupBy("root", "label").count()
    main = sizes.groupBy("root").agg(F.max(F.struct("count", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1")
    main = checkpointed(main.select("root", F.col("m.label").alias("main")))
    if not main.isEmpty():
        rows = checkpointed(own.join(hinted(main), "root").select("node", "label", (F.col("label") != F.col("main")).alias("rest")))
        rows = sets.join(hinted(rows), "node")
        size = F.length("hashes")
        parts = lambda n, size, blocks: F.greatest(F.lit(1), F.ceil(n / (blocks * block)), F.ceil(size / (blocks * BLOCK_BYTES)))
        counts = rows.groupBy("root").agg(
            parts(F.count_if("rest"), F.sum(F.when(F.col("rest"), size)), HELD).alias("few"), parts(F.count("*"), F.sum(size), PASSING).alias("many")
        )
        rows = rows.join(hinted(checkpointed(counts)), "root")
        to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        place = lambda n: F.pmod(F.xxhash64("node", F.lit(-1)), F.col(n))
        one = rows.where("rest").withColumn("pair", F.explode(F.transform(to("many"), lambda k: place("few") * F.col("many") + k)))
        two = rows.withColumn("rest", F.lit(False)).withColumn("pair", F.explode(F.transform(to("few"), lambda k: k * F.col("many") + place("many"))))
        own = _relabelled(own, _crossing_links(one.unionByName(two), similarity, block))
    return labels.join(hinted(large.select("root")), "root", "left_anti").select("node", "label").union(own.select("node", "label"))


def _relabelled(own: DataFrame, links: DataFrame) -> DataFrame:
    """own (root, node, label) with labels that links (a, b) join made one."""
    joined = checkpointed(components(links, "a", "b").select(F.col("node").alias("label"), F.col("root").alias("joined")))
    return checkpointed(own.join(hinted(joined), "label", "left").select("root", "node", F.coalesce("joined", "label").alias("label")))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, root, hashes (sorted 64-bit hashes of the shingles as bytes) for docs with node, root and text."""

    def make():
        return lambda node, root, text: (node, root, [shingle_hashes(t, words).tobytes() for t in text])

    return map_columns(docs.select("node", "root", "text"), make, "node long, root long, hashes binary")


def similar_nodes(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4, wide: int = 60, text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, node for each row, and a table node, root, first (doc_id, text_hash): nodes of one root are near copies.

    A node is a set of word shingles; rows with equal sets share it, whatever their texts repeat. Candidates are nodes that meet in
    a table of a covering family and differ in at most `wide` of 256 bits: at a similarity of 0.8 these are 39 in the mean, with a deviation
    of 6. Nodes that candidates join are compared by their whole sets (see verified_groups).

    Null and empty texts are one node; repeated rows and rows with null ids are rows like any other; an empty table gives empty ones.
    Of ties the smallest id is first (null last), and of equal ids the smallest hash of the text."""
    with released_shuffles(docs.sparkSession):
        return _similar_nodes(docs, words, similarity, radius, wide, text, block)


def _similar_nodes(docs: DataFrame, words: int, similarity: float, radius: int, wide: int, text: str, block: int) -> tuple[DataFrame, DataFrame]:
    def make():
        def each(doc_id, text_hash, text):
            return doc_id, text_hash, *([*c] for c in zip(*(set_fingerprint(shingle_hashes(t, words)) for t in text)))

        return each

    prints = [f"f{i}" for i in range(WORDS)]
    rows = docs.select("doc_id", text_hash(text).alias("text_hash"), text_bytes(text).alias("text"))
    known = checkpointed(map_columns(rows, make, "doc_id long, text_hash long, node long, " + ", ".join(f"{p} long" for p in prints)))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = checkpointed(known.groupBy("node", *prints).agg(F.min(order).alias("first")))
    roots = candidate_roots(nodes.select("node", *prints), radius, wide)
    need = nodes.join(roots, "node").select("node", "root", F.col("first.doc_id").alias("key_id"), F.col("first.text_hash").alias("key_hash"))
    need = hinted(checkpointed(need), 32)
    texts = rows.join(need, rows.doc_id.eqNullSafe(F.col("key_id")) & (F.col("text_hash") == F.col("key_hash")))
    sets = checkpointed(shingle_sets(texts, words).dropDuplicates(["node"]))  # a row may be repeated
    labels = verified_groups(sets, similarity, block)
    rooted = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("root"), "first")
    return known.select("doc_id", "text_hash", "node"), checkpointed(rooted)


def similar_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_hash, node, root for each row: rows with one root are near copies (see similar_nodes for what is defined how)."""
    known, rooted = similar_nodes(docs, **options)
    return known.join(rooted.select("node", "root"), "node").select("doc_id", "text_hash", "node", "root")


def one_of_each_group(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with one document of each group of near copies: that with the smallest id (null ids last).

    Of rows that repeat in id and text one stays as well. Rows of a hot group are never joined by their group: what stays is a row
    a group, found by minima, and all other rows go."""
    known, rooted = similar_nodes(docs, text=text, **options)
    kept = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash")))
    own = known.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    own = checkpointed(own.join(kept, own.doc_id.eqNullSafe(F.col("kept_id")) & (own.text_hash == kept.kept_hash), "left"))
    left = matching(docs, own.where("kept_hash is null"), "left_anti", text)
    repeated = own.where("kept_hash is not null and n > 1")
    if repeated.isEmpty():
        return left
    alone, again = (matching(left, repeated, how, text) for how in ("left_anti", "left_semi"))
    name = fresh(docs, "text_hash")
    return alone.unionByName(again.withColumn(name, text_hash(text)).dropDuplicates(["doc_id", name]).drop(name))
