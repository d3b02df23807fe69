"""Removal of long substrings that occur earlier in the corpus, exact, without sorting every suffix.

The suffixes that are sorted are a sample, as in induced sorting: from each window of `length`
bytes, the leftmost of its least-hashed 32-byte words is its anchor, so equal windows have
equal anchors and a suffix is sampled about every 35 bytes. Each anchor carries the hash of
its block, which is all that the windows of this anchor can cover. Sorted by word and block,

- an anchor whose block came before is settled: all its windows are repeats;
- an anchor whose word has one block only has no repeated window;
- of other words, the first anchor of each block is left, at the borders of repeats. Its windows
  are looked at in parts of equal distance to the anchor, again with what all windows of a part
  share as the word and what they cover as the block; what is left then is hashed window by
  window and sorted, and all but the first of each are repeats.

Rows that a task itself sees to repeat are settled there and dealt out evenly, so that a block
that is in very many documents isn't one task's matter.

Order is induced from the sample to all windows, each of which is judged as the definition
says. Texts that are copies of another are settled before. Sorting is Spark's (external,
in the shuffle); what a task reads is a stream of rows in order, of which it holds the last.

The method asked for, external induced sorting of all suffixes with disk-backed priority
queues, doesn't fit: see the README for figures.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, map_columns, schema_of, table, text_bytes
from .common import hinted

LENGTH, WORD = 100, 32
#: Windows whose anchor lies at one of so many neighbouring distances are a part.
PART = 16
_LOW = (1 << 20) - 1
#: The bit that marks a frequent word, and how many there are at most.
FREQUENT, FREQUENT_WORDS = 1 << 62, 2000


def _word_hashes(x: np.ndarray) -> np.ndarray:
    """A mixed hash of the WORD bytes that begin at each place."""
    w = x.astype(np.uint64)
    for step in (1, 2, 4):
        w = w[: len(w) - step] | w[step:] << np.uint64(8 * step)
    n = len(x) - WORD + 1
    h = np.zeros(n, np.uint64)
    for i in range(0, WORD, 8):
        h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, the first window of each, how many windows it has, and the words' hashes."""
    x = np.frombuffer(text, np.uint8)
    words = length - WORD + 1
    least, hashes = [], []
    for s in range(0, max(len(x) - length + 1, 0), _LOW + 1 - length):
        h = _word_hashes(x[s : s + _LOW])
        m = h & np.uint64(~_LOW & (1 << 64) - 1) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while 2 * reach <= words:
            m = np.minimum(m[:-reach], m[reach:])
            reach *= 2
        if reach < words:
            m = np.minimum(m[: len(m) - words + reach], m[words - reach :])
        own = (m & np.uint64(_LOW)).astype(np.int64)[: _LOW + 1 - length]
        least.append(own + s)
        hashes.append(h[own])
    if not least:
        none = np.empty(0, np.int64)
        return none, none, none, none
    at, word = np.concatenate(least), np.concatenate(hashes)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.diff(np.r_[first, len(at)]), (word[first] >> np.uint64(20)).astype(np.int64)


def _place(first, count, back=0):
    """A run of windows as one number that sorts by its start, with the distance from there to their anchor; both are below 256."""
    return first << 16 | back << 8 | count


def _unplaced(place):
    return place >> 16, place >> 8 & 255, place & 255


_ANCHORS = "word long, block long, ord long, place long"


def _spread(word, block, ord, place, frequent=None):
    """The words, but negative and dealt evenly for rows that repeat a block of an earlier one among these.

    A frequent word is dealt by its blocks: it certainly has more than one, so these needn't meet."""
    if frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, word), len(frequent) - 1)
        mixed = (word.astype(np.uint64) ^ block.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        word = np.where(frequent[at] == word, FREQUENT | (mixed >> np.uint64(20)).astype(np.int64), word)
    order = np.lexsort((place, ord, block, word))
    w, b = word[order], block[order]
    again = order[1:][(w[1:] == w[:-1]) & (b[1:] == b[:-1])]
    word = word.copy()
    mixed = (ord[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place[again].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    word[again] = -1 - (mixed >> np.uint64(20)).astype(np.int64)
    return word


def frequent_words(docs: DataFrame, length: int) -> np.ndarray:
    """The words of most anchors in a sample of a hundredth of docs, at most FREQUENT_WORDS of those that are over a thousandth of it.

    They only say what is dealt how; any list gives the same result."""
    sample = docs.where(F.pmod(F.xxhash64("ord", F.lit(5)), F.lit(100)) == 0)
    counts = map_columns(sample.select("ord", "text"), _anchor_rows(length), _ANCHORS, rows=500).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("block").alias("blocks"))
    counts = checkpointed(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.where((F.col("word") >= 0) & (F.col("blocks") > max(10, total / 1000))).orderBy(F.desc("blocks"), "word").limit(FREQUENT_WORDS)
    return np.array(sorted(r.word for r in top.collect()), np.int64)


def _anchor_rows(length: int, frequent: np.ndarray | None = None):
    def make():
        import xxhash

        def each(ord, text):
            out = [[np.empty(0, np.int64)] * 4]
            for o, t in zip(ord, text):
                at, first, count, word = anchors(t, length)
                left = length - WORD
                block = [xxhash.xxh3_64_intdigest(t[max(a - left, 0) : a + length], min(a, left)) for a in at.tolist()]
                out.append((word, np.array(block, np.uint64).view(np.int64), np.full(len(at), o, np.int64), _place(first, count, at - first)))
            word, block, ord, place = (np.concatenate(c) for c in zip(*out))
            return [pa.array(c) for c in (_spread(word, block, ord, place, frequent), block, ord, place)]

        return each

    return make


def _part_rows(length: int):
    """Rows for the parts of anchors' windows, with the bytes that a part covers."""

    def make():
        import xxhash

        def each(ord, text, places):
            word, block, o, p, content = [], [], [], [], []
            for i, t, each_place in zip(ord, text, places):
                for place in each_place:
                    first, back, count = _unplaced(place)
                    anchor, end = first + back, first + count
                    while first < end:
                        distance = anchor - first
                        nearest = distance // PART * PART
                        last = min(end - 1, anchor - nearest)
                        inner = anchor - nearest  # up to where the part's farthest window ends: what all its windows share
                        word.append(xxhash.xxh3_64_intdigest(t[inner : inner - PART + 1 + length], nearest) >> 20)
                        whole = t[first : last + length]
                        block.append(xxhash.xxh3_64_intdigest(whole, distance))
                        o.append(i)
                        p.append(_place(first, last - first + 1))
                        content.append(whole)
                        first = last + 1
            word, block, o, p = np.array(word, np.int64), np.array(block, np.uint64).view(np.int64), np.array(o, np.int64), np.array(p, np.int64)
            return [pa.array(c) for c in (_spread(word, block, o, p), block, o, p)] + [pa.array(content, pa.binary())]

        return each

    return make


def _repeats(batches):
    """Rows (word, block, and what is kept) in order. Out: what is kept, and settled: all its windows are repeats, else they must be looked at."""
    last, held = None, None  # last row's word and block; the row of a word's first block while that is its only one

    def out(rows, settled):
        return pa.RecordBatch.from_arrays([*rows.columns[2:], pa.array(settled, pa.bool_())], names=[*rows.schema.names[2:], "settled"])

    for b in batches:
        if not b.num_rows:
            continue
        word, block = b.column(0).to_numpy(), b.column(1).to_numpy()
        new_word = np.r_[last is None or word[0] != last[0], word[1:] != word[:-1]]
        new_block = new_word | np.r_[last is None or block[0] != last[1], block[1:] != block[:-1]]
        group = np.cumsum(new_word)
        blocks = np.bincount(group, new_block)
        look = new_block & (~new_word | (blocks[group] > 1) | (word >= FREQUENT))
        if held is not None and blocks[0]:  # the word that was open goes on with another block
            yield out(held, [False])
            held = None
        if new_word.any():
            held = None
            if blocks[-1] == 1 and 0 <= word[-1] < FREQUENT:
                held = b.slice(int(np.flatnonzero(new_word)[-1]), 1)
        last = word[-1], block[-1]
        settled = ~new_block | (word < 0)
        keep = settled | look
        yield out(b.filter(pa.array(keep)), settled[keep])


def _window_rows(length: int):
    def make():
        import xxhash

        def each(ord, place, content):
            digests, o, p = [], [], []
            for i, at, c in zip(ord, place, content):
                first, _, count = _unplaced(at)
                digests += [xxhash.xxh3_128_digest(c[w : w + length]) for w in range(count)]
                p += [_place(w, 1) for w in range(first, first + count)]
                o += [i] * count
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            o, p, word, block = np.array(o, np.int64), np.array(p, np.int64), both[:, 0] & (2**63 - 1), both[:, 1].copy()
            return [pa.array(c) for c in (_spread(word, block, o, p), block, o, p)]

        return each

    return make


def _later(batches):
    """Rows (word, block, ord, place) in order: all but the first of each pair of word and block."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        word, block = b.column(0).to_numpy(), b.column(1).to_numpy()
        same = np.r_[last is not None and (word[0], block[0]) == last, (word[1:] == word[:-1]) & (block[1:] == block[:-1])]
        last = word[-1], block[-1]
        yield b.filter(pa.array(same | (word < 0))).select(["ord", "place"])


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("word").sortWithinPartitions("word", "block", "ord", "place")


def _packed(docs: DataFrame) -> DataFrame:
    def make():
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        return lambda ord, doc_id, text: (ord, doc_id, [pack(t) for t in text])

    return map_columns(docs.select("ord", "doc_id", "text"), make, "ord long, doc_id long, packed binary")


def _unpacked(make):
    """make over a second column that is packed."""

    def wrapped():
        import zstandard

        each, unpack = make(), zstandard.ZstdDecompressor().decompress
        return lambda ord, packed, *rest: each(ord, [unpack(p) for p in packed], *rest)

    return wrapped


def _runs(places: list[int], length: int) -> list[tuple[int, int]]:
    """Places (runs of window starts) as maximal runs of bytes."""
    out: list[list[int]] = []
    for place in sorted(places):
        a, _, count = _unplaced(place)
        b = a + count - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _ordered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) with ord, which sorts them, and a table of ord, doc_id, digest, n_bytes, rows without texts.

    ord is the id, if ids are there and unique. Else rows that share id and text are one document, and documents are
    ordered by id (null last) and then by their text's digest."""
    facts = docs.select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n_bytes"))
    facts = checkpointed(facts.groupBy("doc_id", "digest", "n_bytes").agg(F.count("*").alias("rows")))
    plain = facts.agg(F.count("*") == F.countDistinct("doc_id"), F.max("rows") == 1).first()
    if all(plain):
        return docs.withColumn("ord", F.col("doc_id")), facts.withColumn("ord", F.col("doc_id"))
    facts = checkpointed(facts.orderBy(F.asc_nulls_last("doc_id"), "digest").withColumn("ord", F.monotonically_increasing_id()))
    names = hinted(facts.select(F.col("doc_id").alias("key_id"), F.col("digest").alias("key_digest"), "ord"), 100)
    named = docs.join(names, docs.doc_id.eqNullSafe(F.col("key_id")) & (F.sha2("text", 256) == F.col("key_digest")))
    return named.select("doc_id", "text", "ord").dropDuplicates(["ord"]), facts


def repeated_spans(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, spans (start and end of each maximal removed run), kept_sha256.

    A byte is removed if a string of `length` bytes covers it that also starts earlier: in a document of smaller id, or
    before in the same one. Null texts are empty; documents with a null id come last; rows that share id and text are
    one document, reported each; those that share an id only are ordered by their digests."""
    if not WORD < length <= 255:
        raise ValueError(f"length must be above {WORD} and below 256")
    docs, facts = _ordered(docs.select("doc_id", text_bytes(text).alias("text")))
    first = facts.groupBy("digest").agg(F.min("ord").alias("ord")).select("ord", F.lit(False).alias("copy"))
    facts = checkpointed(facts.join(first, "ord", "left").withColumn("copy", F.coalesce("copy", F.lit(True))))  # by ord, which no two rows share
    copies = hinted(checkpointed(facts.where("copy").select(F.col("ord").alias("copy_ord"))))
    own = docs.join(copies, docs.ord == F.col("copy_ord"), "left_anti")
    long = own.where(F.length("text") >= length)
    rows = map_columns(long.select("ord", "text"), _anchor_rows(length, frequent_words(long, length)), _ANCHORS, rows=500)
    found = checkpointed(_in_order(rows).mapInArrow(_repeats, schema_of("ord long, place long, settled boolean")))
    packed = _packed(own)
    look = found.where("not settled").groupBy("ord").agg(F.collect_list("place").alias("places"))  # a document's own anchors
    parts = map_columns(packed.join(look, "ord").select("ord", "packed", "places"), _unpacked(_part_rows(length)), _ANCHORS + ", content binary", rows=100)
    again = checkpointed(_in_order(parts).mapInArrow(_repeats, schema_of("ord long, place long, content binary, settled boolean")).withColumn("content", F.when(~F.col("settled"), F.col("content"))))
    windows = map_columns(again.where("not settled").select("ord", "place", "content"), _window_rows(length), _ANCHORS, rows=5000)
    more = _in_order(windows).mapInArrow(_later, schema_of("ord long, place long"))
    runs = found.where("settled").select("ord", "place").union(again.where("settled").select("ord", "place")).union(more).groupBy("ord").agg(F.collect_list("place").alias("places"))

    def make():
        def each(ord, text, places):
            spans = [_runs(p or [], length) for p in places]
            kept = []
            for t, s in zip(text, spans):
                digest, at = hashlib.sha256(), 0
                for a, b in s:
                    digest.update(t[at:a])
                    at = b
                digest.update(t[at:])
                kept.append(digest.hexdigest())
            return ord, spans, kept

        return each

    result = map_columns(packed.join(runs, "ord", "left").select("ord", "packed", "places"), _unpacked(make), "ord long, spans array<array<long>>, kept_sha256 string")
    result = result.join(facts.where("not copy"), "ord").select("doc_id", "n_bytes", "spans", "kept_sha256", "rows")
    whole = F.col("n_bytes") >= length
    all_of_it = F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    copied = facts.where("copy").select("doc_id", "n_bytes", F.when(whole, all_of_it).otherwise(F.array().cast("array<array<long>>")).alias("spans"), F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("digest")).alias("kept_sha256"), "rows")
    return result.union(copied).select("doc_id", "n_bytes", "spans", "kept_sha256", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("col")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without bytes of repeated strings of 100 bytes."""
    found = repeated_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
