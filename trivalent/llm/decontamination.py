"""Benchmark decontamination as a prefix-filtered join of word windows.

Every window (item_words consecutive words of an item) is a sequence of shingles. The
shingles are ordered by rarity in the documents, and the rarest one is the window's prefix:
a document that contains the window contains it, so only documents with a prefix shingle are
looked at further. A match of the prefix at a place fixes where the window would start;
it must fit in the document (length and position), and all its words are then compared.

The benchmark is cut into blocks of bounded size, each sent to all tasks; the documents are
read once a block. A block's results are added up by document, so any number gives the same.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table, text_bytes

WINDOW, SHINGLE = 10, 3
#: Benchmark bytes a block: what one broadcast holds, and with its tables what a task keeps.
BLOCK = 4 << 20

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a lower-cased (A-Z) text: ASCII digits and letters and whatever is not ASCII."""
    return text.translate(_WORDS).split()


class Windows:
    """The windows of a block of items, their words as numbers, and the shingles in them."""

    def __init__(self, items: list[tuple], window: int):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                found[tuple(ids[at : at + window])].add(item)
        if len(self.number) >= 1 << 21:
            raise ValueError("an item of more than 2^21 different words can't be coded; cut it")
        self.windows, self.items = list(found), [[*x] for x in found.values()]  # put in order where they are reported

    def shingles(self, window: tuple[int, ...]) -> list[tuple[int, ...]]:
        q = min(SHINGLE, len(window))
        return [window[i : i + q] for i in range(len(window) - q + 1)]

    def code(self, shingle) -> int:
        """A shingle as a number; exact, as a block has fewer than 2^21 different words."""
        out = 0
        for w in shingle:
            out = out << 21 | int(w)
        return out

    def numbers(self, text: bytes) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)

    @staticmethod
    def codes(ids: np.ndarray, q: int) -> np.ndarray:
        """The code of the shingle that starts at each place; 0 if it has a word that no item has."""
        n = len(ids) - q + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(q):
            part = ids[i : i + n]
            out = out << 21 | part
            known &= part > 0
        return np.where(known, out, 0)

    def all_codes(self) -> dict[int, np.ndarray]:
        by: dict[int, set] = defaultdict(set)
        for w in self.windows:
            for s in self.shingles(w):
                by[len(s)].add(self.code(s))
        return {q: np.array(sorted(c), np.int64) for q, c in by.items()}


def _places(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of codes that are in the sorted table, and their rows in it."""
    row = np.searchsorted(table, codes)
    row[row == len(table)] = 0
    hit = np.flatnonzero(table[row] == codes) if len(table) else np.empty(0, np.int64)
    return hit, row[hit]


def shingle_frequencies(docs: DataFrame, items: list[tuple], window: int) -> dict[int, int]:
    """How often each of the items' shingles occurs in all documents; at most one number a shingle of the block."""

    def make():
        w = Windows(items, window)
        tables = w.all_codes()

        def each(text):
            total: dict[int, np.ndarray] = {q: np.zeros(len(t), np.int64) for q, t in tables.items()}
            for t in text:
                ids = w.numbers(t)
                for q, known in tables.items():
                    _, rows = _places(known, w.codes(ids, q))
                    np.add.at(total[q], rows, 1)
            codes, n = np.concatenate(list(tables.values())), np.concatenate(list(total.values()))
            return codes[n > 0].tolist(), n[n > 0].tolist()

        return each

    counts = map_columns(docs.select(text_bytes()), make, "code long, n long", rows=20000)
    return {r.code: r.n for r in counts.groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator()}


class PrefixIndex:
    """Windows by their rarest shingle."""

    def __init__(self, windows: Windows, frequency: dict[int, int]):
        self.w = windows
        by: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for n, window in enumerate(windows.windows):
            parts = [windows.code(s) for s in windows.shingles(window)]
            offset = min(range(len(parts)), key=lambda i: (frequency.get(parts[i], 0), parts[i], i))
            by[min(SHINGLE, len(window))][parts[offset]].append((offset, n))
        self.tables = {q: np.array(sorted(p), np.int64) for q, p in by.items()}
        self.groups = {q: [self._grouped(p[c]) for c in sorted(p)] for q, p in by.items()}

    def _grouped(self, found: list[tuple[int, int]]) -> list[tuple[int, np.ndarray, list[int]]]:
        """For each place of the prefix in its window and length: the windows' words, and their numbers."""
        by = defaultdict(list)
        for offset, n in found:
            by[offset, len(self.w.windows[n])].append(n)
        return [(offset, np.array([self.w.windows[n] for n in ns], np.int64), ns) for (offset, _), ns in by.items()]

    def hits(self, text: bytes) -> tuple[int, np.ndarray, list[int]]:
        """Words of the document, the first and last of each occurrence, and the windows that occur."""
        ids = self.w.numbers(text)
        spans, occurring = [], set()
        for q, known in self.tables.items():
            places, rows = _places(known, self.w.codes(ids, q))
            for row in np.unique(rows):
                at = places[rows == row]
                for offset, words, ns in self.groups[q][row]:
                    k = words.shape[1]
                    start = at - offset
                    start = start[(start >= 0) & (start + k <= len(ids))]
                    for s in range(0, len(start), 4096):
                        own = ids[start[s : s + 4096, None] + np.arange(k)]
                        for i, window in enumerate(words):
                            same = start[s : s + 4096][(own == window).all(1)]
                            if len(same):
                                occurring.add(ns[i])
                                spans.append(np.stack([same, same + k], 1))
        return len(ids), np.concatenate(spans) if spans else np.empty((0, 2), np.int64), sorted(occurring)


def _blocks(benchmark: DataFrame, block: int):
    """The items in blocks of at most `block` bytes (a longer item is a block of its own); one is held at a time."""
    held, size = [], 0
    for r in benchmark.select("item_id", text_bytes()).where("text <> X''").toLocalIterator():
        if held and size + len(r.text) > block:
            yield held
            held, size = [], 0
        held.append((r.item_id, bytes(r.text)))
        size += len(r.text)
    if held:
        yield held


def _runs(spans: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: text_hash, doc_id, n_words, hit_runs (first word and one past the last of each run of words
    that lie in an occurrence of a window), items (ids of the items with such windows, as sorted strings).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
    Null and empty texts have no words. Null item ids are reported as 'null'. Repeated rows are each reported.
    An empty benchmark hits nothing. text_hash is the text's xxhash64."""
    ddl = "text_hash long, doc_id long, n_words long, runs array<array<long>>, items array<string>"
    docs = docs.select("doc_id", text_bytes())
    parts = []
    for items in _blocks(benchmark, block):
        frequency = shingle_frequencies(docs, items, window)
        shared = docs.sparkSession.sparkContext.broadcast((items, frequency))

        def make(shared=shared):
            items, frequency = shared.value
            index = PrefixIndex(Windows(items, window), frequency)
            name = lambda i: "null" if i is None else str(i)

            def each(row, doc_id, text):
                found = [index.hits(t) for t in text]
                return row, doc_id, [f[0] for f in found], [_runs(f[1]) for f in found], [sorted({name(i) for n in f[2] for i in index.w.items[n]}) for f in found]

            return each

        parts.append(map_columns(docs.select(F.xxhash64("text").alias("text_hash"), "doc_id", "text"), make, ddl))
    if not parts:
        none = lambda: lambda text_hash, doc_id, text: (text_hash, doc_id, [len(words_of(t)) for t in text], [[]] * len(text), [[]] * len(text))
        parts = [map_columns(docs.select(F.xxhash64("text").alias("text_hash"), "doc_id", "text"), none, ddl)]
    if len(parts) == 1:
        return parts[0].select("text_hash", "doc_id", "n_words", F.col("runs").alias("hit_runs"), "items")
    return _added(parts)


def _added(parts: list[DataFrame]) -> DataFrame:
    """The blocks' results by row; rows are told apart by id and a hash of the text, and rows that share both hit alike."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    n = len(parts)

    def make():
        def each(text_hash, doc_id, n_words, rows, runs, items):
            return text_hash, doc_id, n_words, rows, [_runs(np.array([x for part in r for x in part] or np.empty((0, 2)), np.int64).reshape(-1, 2)) for r in runs], [sorted({x for part in i for x in part}) for i in items]

        return each

    grouped = out.groupBy("text_hash", "doc_id", "n_words").agg((F.count("*") / n).cast("long").alias("rows"), F.collect_list(F.when(F.size("runs") > 0, F.col("runs"))).alias("runs"), F.collect_list(F.when(F.size("items") > 0, F.col("items"))).alias("items"))
    made = map_columns(grouped, make, "text_hash long, doc_id long, n_words long, rows long, hit_runs array<array<long>>, items array<string>")
    return made.select(F.explode(F.sequence(F.lit(1).cast("long"), "rows")), "text_hash", "doc_id", "n_words", "hit_runs", "items").drop("col")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that contain a window of the benchmark, in all their columns."""
    from .corpus import matching

    return matching(docs, overlaps(docs, benchmark, **options).where(F.size("hit_runs") > 0), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against windows of ten words of all benchmark items."""
    found = overlaps(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
