"""SimHash near-duplicates with covering locality-sensitive hashing.

Each of the fingerprint's bits gets a vector of radius + 1 random bits. Every non-zero
vector v of that length makes a mask: the bits whose vector has odd overlap with v. Two
fingerprints that differ in at most `radius` bits agree on at least one mask, because the
vectors of the differing bits leave some v orthogonal to them all. So a table for each mask
finds every pair; nothing is left to chance.

Equal fingerprints are one node. A bucket that is too large for comparison in one task is
hashed again under a second, independent family, which keeps the guarantee: its members
are dealt to smaller buckets, and a pair within the radius meets in one of them. What is
too large even then is cut into blocks, and every pair of blocks is a task's matter.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, hinted, map_columns, schema_of, table, text_bytes
from .components import components

SEED = 42
#: A bucket of more fingerprints is hashed again; one that still has more is compared in pairs of blocks.
BUCKET = 8192
#: In larger buckets, only links that join what is not joined yet are written.
FOREST = 32
#: Pairs a member beyond which a bucket gives a forest of its candidates only.
DENSE = 4
#: Fingerprints of sets have 64 * WORDS bits; tables are made of the first PARTS * 32.
WORDS, PARTS = 4, 4


def covering_masks(radius: int, seed: int, bits: range = range(64)) -> list[int]:
    """2^(radius+1) - 1 masks over the given bits, about half of them in each."""
    rng = random.Random(seed)
    vectors = {i: rng.randrange(1, 2 ** (radius + 1)) for i in bits}
    return [sum(1 << i for i, m in vectors.items() if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def shingles_of(text: bytes, words: int) -> list[bytes]:
    """Shingles of a lower-cased (A-Z) text, repeats included; fewer words give one, none give none."""
    w = text.lower().split()  # ASCII letters and ASCII white space, as both act on bytes
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    joined, starts, ends, at = b" ".join(w), [], [], 0
    for x in w:
        starts.append(at)
        at += len(x)
        ends.append(at)
        at += 1
    return [joined[s:e] for s, e in zip(starts, ends[words - 1 :])]


def fingerprint(text: bytes, words: int) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; no words: 0."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts = shingles_of(text, words)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(parts), 65536):
        h = np.array([digest(p, SEED) for p in parts[at : at + 65536]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(parts)).astype(np.uint8), bitorder="little").view("<i8")[0]) if parts else 0


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of each hash, for every salt."""
    h = h + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % (1 << 64))
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The set of shingles of a lower-cased (A-Z) text as sorted 64-bit hashes: words are hashed, and runs of them mixed in order."""
    import xxhash

    w = text.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    out = np.full(len(w) - k + 1 if w else 0, k, np.uint64)
    for i in range(k):
        out = _mixed(out ^ h[i : i + len(out)], i)
    return np.unique(out)


def set_fingerprint(hashes: np.ndarray) -> tuple[int, ...]:
    """A hash of the set, and the 64 * WORDS bits voted by its members, one vote each whatever the repeats, as signed numbers."""
    import xxhash

    if not len(hashes):
        return (0,) * (WORDS + 1)
    out = [int.from_bytes(xxhash.xxh64_digest(hashes.tobytes(), SEED), "little", signed=True)]
    for salt in range(WORDS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65536):
            mixed = _mixed(hashes[at : at + 65536], salt).astype("<u8")
            ones += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0]))
    return tuple(out)


def fingerprints(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row; null texts count as empty."""

    def make():
        return lambda doc_id, text: (doc_id, [fingerprint(t, words) for t in text])

    return map_columns(docs.select("doc_id", text_bytes(text)), make, "doc_id long, fp long")


def _links(radius: int):
    """A function over partitions sorted by bucket: links within buckets, neighbours by rising offset.

    Small buckets give all their links, others a spanning forest of them."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def distance(x, y):
        return np.bitwise_count(x ^ y)

    def forest(fp):
        left, out = fp, []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                near = distance(left, queue[-1]) <= radius
                u = queue.pop()
                new = left[near]
                out.append(np.stack([np.full(len(new), u), new]))
                queue.extend(new)
                left = left[~near]
        return out

    def links(key, fp):
        out = []
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        for s, n in zip(starts[sizes > FOREST], sizes[sizes > FOREST]):
            out += forest(fp[s : s + n])
        group = np.repeat(sizes, sizes)
        at = np.flatnonzero((group <= FOREST) & (group > 1))
        end = np.repeat(starts + sizes, sizes)
        for o in range(1, FOREST):
            at = at[at + o < end[at]]
            if not len(at):
                break
            near = at[distance(fp[at], fp[at + o]) <= radius]
            out.append(np.stack([fp[near], fp[near + o]]))
        return out

    def run(batches):
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def made(found):
            if found:
                a, b = np.concatenate(found, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=arrow)

        for batch in batches:
            key = np.r_[key, batch.column(0).to_numpy()]
            fp = np.r_[fp, batch.column(1).to_numpy().view(np.uint64)]
            if len(key):
                whole = int(np.searchsorted(key == key[-1], True))  # the last bucket may go on
                yield from made(links(key[:whole], fp[:whole]))
                key, fp = key[whole:], fp[whole:]
        if len(key):
            yield from made(links(key, fp))

    return run


def _dealt(members: DataFrame, masks: list[int], level: int, *others: str) -> DataFrame:
    """bucket, fp and others: a row for each mask. bucket: a hash of the mask's number, the bits it keeps, and the bucket before.
    Buckets that share a hash by chance are compared together; that adds no link, as distances are checked."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.xxhash64(F.lit(level), F.lit(t), F.col("bucket"), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)))
    return members.select("fp", *others, F.explode(keys).alias("bucket")).select("bucket", "fp", *others)


def split_buckets(rows: DataFrame, member: str, bucket: int) -> DataFrame:
    """rows with the key `bucket` of each that has over `bucket` rows replaced by keys of pairs of blocks, as often as there are blocks.

    Members are dealt to blocks by hash, so that any two of a bucket meet under some key, and no key has many more than 2 * bucket rows."""
    sizes = checkpointed(rows.groupBy("bucket").agg(F.ceil(F.count("*") / bucket).alias("blocks")).where("blocks > 1"))
    if sizes.isEmpty():
        return rows
    own = F.pmod(F.xxhash64(member, F.lit(SEED)), F.col("blocks"))
    keys = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.xxhash64("bucket", F.least(own, other), F.greatest(own, other)))
    dealt = rows.join(hinted(sizes), "bucket", "left").withColumn("bucket", F.explode(F.when(F.col("blocks").isNull(), F.array("bucket")).otherwise(keys)))
    return dealt.drop("blocks")


def near_links(nodes: DataFrame, radius: int, seed: int = 1, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints `fp` that differ in at most `radius` bits; their components are exactly those of all such pairs."""

    def found(rows):
        return rows.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_links(radius), schema_of("a long, b long")).distinct()

    rows = _dealt(nodes.select(F.lit(0).cast("long").alias("bucket"), "fp"), covering_masks(radius, seed), 0)
    sizes = checkpointed(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))  # most buckets have one fingerprint
    links = found(rows.join(sizes.where(F.col("n") <= bucket), "bucket"))
    hot = checkpointed(sizes.where(F.col("n") > bucket).select("bucket"))
    if hot.isEmpty():
        return links
    members = checkpointed(rows.join(hinted(hot), "bucket").select("bucket", "fp"))
    again = _dealt(members, covering_masks(radius, seed + 1), 1)
    return links.union(found(split_buckets(again, "fp", bucket)))


def least_of_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, least = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, least[a], low)  # roots move too, so that whole trees are joined at once
        np.minimum.at(new, least[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == least).all():
            return nodes, nodes[least]
        least = new


def _distance(x, y):
    """Differing bits of fingerprints (rows of numbers), broadcast against each other."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int16)


def _forest(prints: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest over all pairs within `wide` bits, found breadth first."""
    left, i, j = np.arange(len(prints)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = _distance(prints[left], prints[u]) <= wide
            new, left = left[near], left[~near]
            i.append(np.full(len(new), u))
            j.append(new)
            queue.extend(new)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *i]), np.concatenate([none, *j])


def _candidates(wide: int):
    """A function over partitions sorted by bucket (bucket, label, fingerprint's numbers): a, b, links between labels, whose components are
    those of all pairs of the partition's buckets within `wide` bits and under two labels. They lead from each label to the smallest of its
    component, so that partitions that see parts of one large group give the same ones."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs_of(label, prints):
        values, counts = np.unique(label, return_counts=True)
        main = label == values[counts.argmax()]
        order, rest = np.argsort(main, kind="stable"), len(label) - counts.max()  # what has the commonest label comes last, as it is only met
        label, prints = label[order], prints[order]
        n, i, j = len(prints), [order[:0]], [order[:0]]
        step = max(1, (1 << 18) // n)
        for s in range(0, rest, step):
            e = min(s + step, rest)
            u, v = np.nonzero((_distance(prints[s:e, None], prints[None, s:]) <= wide) & (label[s:e, None] != label[None, s:]))
            u, v = u[v > u] + s, v[v > u] + s
            i.append(u)
            j.append(v)
            if sum(map(len, i)) > DENSE * n:
                u, v = _forest(prints, wide)
                return label[u], label[v]
        return label[np.concatenate(i)], label[np.concatenate(j)]

    def buckets(key, label, prints):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        for s, n in zip(starts[sizes > 2 * DENSE], sizes[sizes > 2 * DENSE]):
            yield pairs_of(label[s : s + n], prints[s : s + n])
        group, end = np.repeat(sizes, sizes), np.repeat(starts + sizes, sizes)
        at = np.flatnonzero((group <= 2 * DENSE) & (group > 1))
        for o in range(1, 2 * DENSE):  # together at most DENSE pairs a member
            at = at[at + o < end[at]]
            if not len(at):
                break
            near = at[(_distance(prints[at], prints[at + o]) <= wide) & (label[at] != label[at + o])]
            yield label[near], label[near + o]

    def run(batches):
        held, left, right = None, [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def take(rows):
            for a, b in buckets(*rows):
                left.append(a)
                right.append(b)

        for batch in batches:
            key, label, *prints = (c.to_numpy() for c in batch.columns)
            new = key, label, np.stack(prints, 1).view(np.uint64)
            held = tuple(np.concatenate(x) for x in zip(held, new)) if held else new
            if len(held[0]):
                whole = int(np.searchsorted(held[0] == held[0][-1], True))  # the last bucket may go on
                if whole:
                    take(c[:whole] for c in held)
                    held = tuple(c[whole:] for c in held)
        if held and len(held[0]):
            take(held)
        labels, smallest = least_of_components(np.concatenate(left), np.concatenate(right))
        own = labels != smallest
        yield pa.RecordBatch.from_arrays([pa.array(smallest[own]), pa.array(labels[own])], schema=arrow)

    return run


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with label: what their node is joined under in roots (node, root), or else the node."""
    return rows.join(hinted(roots), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")


def _met(rows: DataFrame, wide: int) -> DataFrame:
    """a, b: links between labels that meet in a bucket of rows (bucket, label, f0 to f3)."""
    rows = rows.select("bucket", "label", *(f"f{i}" for i in range(WORDS))).repartition("bucket").sortWithinPartitions("bucket", "label")
    return checkpointed(rows.mapInArrow(_candidates(wide), schema_of("a long, b long")).distinct())


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) with what links (a, b) between their labels join."""
    return roots if links.isEmpty() else checkpointed(components(links.union(roots.select("root", "node")), "a", "b"))


def _in_blocks(rows: DataFrame, large: DataFrame, salt: int) -> DataFrame:
    """rows with the key `bucket` of each that is in large (bucket, blocks) replaced by keys of that many blocks, dealt anew for each salt."""
    block = F.xxhash64("bucket", F.lit(salt), F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks")))
    dealt = rows.join(hinted(large), "bucket", "left")
    return dealt.withColumn("bucket", F.when(F.col("blocks").isNull(), F.col("bucket")).otherwise(block)).drop("blocks")


def _joined_in_large(rows: DataFrame, large: DataFrame, roots: DataFrame, wide: int, bucket: int) -> DataFrame:
    """roots with the candidates of large buckets (bucket, blocks), whose blocks are compared on their own already.

    Members are dealt to blocks anew as long as that halves the buckets' labels at least. Then what lies outside of a bucket's commonest
    label is compared with all, in pairs of blocks. So near copies take work in proportion to them, whatever their number, and no
    pair is left out but those under one label; members that nothing joins take pairs of all their blocks."""
    rows = rows.join(hinted(large), "bucket", "left_semi")
    before, salt = None, 0
    while True:
        sizes = _labelled(rows, roots).groupBy("bucket", "label").agg(F.count("*").alias("n"))
        several = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("labels"))
        several = checkpointed(several.where("labels > 1").select("bucket", F.col("most.label").alias("main"), F.col("most.n").alias("few"), "n", "labels"))
        now = several.agg(F.sum("labels")).first()[0]
        if now is None:
            return roots
        if before and 2 * now > before:
            break
        before, salt = now, salt + 1
        held = rows.join(hinted(several.select("bucket")), "bucket", "left_semi")
        roots = _merged(roots, _met(_labelled(_in_blocks(held, large, salt), roots), wide))
    blocks = several.select("bucket", "main", F.ceil((F.col("n") - F.col("few")) / bucket).alias("rest"), F.ceil(F.col("few") / bucket).alias("others"))
    held = _labelled(rows, roots).join(hinted(blocks, 32), "bucket")
    out, place = F.col("label") != F.col("main"), F.xxhash64("node", F.lit(SEED))
    own = F.when(out, F.pmod(place, F.col("rest"))).otherwise(F.col("rest") + F.pmod(place, F.col("others")))
    last = F.col("rest") - 1 + F.when(out, F.col("others")).otherwise(0)
    keys = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda other: F.xxhash64("bucket", F.least(own, other), F.greatest(own, other)))
    return _merged(roots, _met(held.withColumn("bucket", F.explode(keys)), wide))


def candidate_roots(nodes: DataFrame, radius: int, wide: int, seed: int = 1, bucket: int = BUCKET) -> DataFrame:
    """node, root over nodes (node, f0 to f3), for every node that has a candidate: the components of all candidates.

    The first half of the fingerprint is cut into PARTS of 32 bits, each with a covering family of `radius`: a pair that differs in at
    most PARTS * (radius + 1) - 1 of these bits is within the radius in one part at least, and so certainly meets in a table; of
    pairs further apart most do. Pairs that meet and differ in at most `wide` of all bits are candidates.

    What one table a part joins has one label in the other tables, which give links between labels only: a group of near copies is linked
    a few times a member, not once a table."""
    prints, tables = [f"f{i}" for i in range(WORDS)], []
    for part in range(PARTS):
        value = F.shiftrightunsigned(f"f{part // 2}", 32 * (part % 2)).bitwiseAND(F.lit(0xFFFFFFFF))
        masks = covering_masks(radius, seed + part, range(32))
        tables.append([F.xxhash64(F.lit(part), F.lit(t), value.bitwiseAND(F.lit(m))) for t, m in enumerate(masks)])
    roots = nodes.sparkSession.createDataFrame([], "node long, root long")
    links = nodes.sparkSession.createDataFrame([], "a long, b long")
    none = links
    steps = [[t[0] for t in tables], *(t[1:] for t in tables)]
    for n, keys in enumerate(steps):  # one part after the other, so that a part's buckets alone are on disk
        rows = nodes.select("node", *prints, F.explode(F.array(*keys)).alias("bucket"))
        large = checkpointed(rows.groupBy("bucket").agg(F.ceil(F.count("*") / bucket).alias("blocks")).where("blocks > 1"))
        hot = not large.isEmpty()
        links = links.union(_met(_labelled(_in_blocks(rows, large, 0) if hot else rows, roots), wide))
        if hot or n in (0, len(steps) - 1):
            roots, links = _merged(roots, links), none
        if hot:
            roots = _joined_in_large(rows, large, roots, wide, bucket)
    return roots


def near_duplicate_groups(docs: DataFrame, words: int = 4, radius: int = 4, text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id for each row of docs.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most `radius` bits.
    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows stay; a null
    doc_id gets its component's smallest id (null if there is none); an empty table gives an empty result.
    """
    prints = checkpointed(fingerprints(docs, words, text))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(nodes, radius, bucket=bucket), "a", "b")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, links at 4 or fewer differing bits of 64."""
    groups = near_duplicate_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
