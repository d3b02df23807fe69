"""Names of a dictionary in texts, whole words only: one automaton over all names in each task, or for many names runs of words joined with them."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .sizes import written

#: Bytes of names that are sent to all tasks at most; of a larger dictionary they get a filter of at most 2^MOST_BITS bits, a sixteenth of which a name of
#: its own sets while there are fewer, and texts are read once all the same.
SHARD_BYTES, MOST_BITS = 8_000_000, 26
ROWS = 200
#: Parts of the filter are 2^PART_BITS bits; a name that is found everywhere is joined in so many tasks.
PART_BITS, SALTS = 16, 16
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def plain_words(c: Column) -> Column:
    """Letters, marks and digits in lower case, what is between them one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def leftmost_longest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, end, name) those that don't overlap: the first to begin, of these the longest."""
    out, free = [], 0
    for start, end, name in sorted(found, key=lambda m: (m[0], -m[1], m[2])):
        if start >= free:
            out.append((start, end, name))
            free = end
    return out


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2^64."""
    of = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64), dtype=np.uint64)])
    return of(_BASE), of(_BACK)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Of texts with single spaces: each one's end among all words, the words as numbers, what these stand for, and sums by which runs of words are told."""
    lists = pc.split_pattern(texts, " ")
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    numbers, spelled = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    hashes = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in spelled], np.uint64)
    up, _ = _powers(1 << max(1, len(numbers).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[numbers] * up[: len(numbers)], dtype=np.uint64)])
    return ends, numbers, spelled, sums


def _slots(sums: np.ndarray, at: np.ndarray, n: np.ndarray | int, bits: int) -> np.ndarray:
    """The filter's bit of each run of n words at a place: of equal runs the same."""
    _, back = _powers(1 << max(1, (len(sums) - 1).bit_length()))
    x = (sums[at + n] - sums[at]) * back[at] + np.asarray(n, np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_BACK)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _filter(plain: DataFrame, bits: int) -> tuple[np.ndarray, list[int]]:
    """A bit for each name, packed, and the numbers of words that names have."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                ends, _, _, sums = _words(b.column(0))
                at = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(_slots(sums, at, ends - at, bits)), pa.array(ends - at, pa.int64())], names=["slot", "n"])

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(1 << PART_BITS, np.uint8)
        part[rows["slot"].to_numpy() & ((1 << PART_BITS) - 1)] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(part).tobytes()], "n": [sorted(set(rows["n"]))]})

    slots = plain.select("plain").mapInArrow(run, "slot long, n long").distinct()
    parts = slots.groupBy(F.shiftright("slot", PART_BITS).alias("part")).applyInPandas(packed, "part long, bits binary, n array<long>").collect()  # of the filter's size, which is bounded
    out = np.zeros((max(1, 1 << bits >> PART_BITS), 1 << PART_BITS - 3), np.uint8)
    for r in parts:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1), sorted({n for r in parts for n in r.n})


def _by_runs(rows: DataFrame, id: str, kind: T.DataType, plain: DataFrame) -> DataFrame:
    """id, name, at, to of all names in the texts: runs of as many words as names have that pass the filter are joined with the names, which tells them for sure."""
    bits = min(MOST_BITS, max(PART_BITS, (plain.count() * 16).bit_length()))
    held = rows.sparkSession.sparkContext.broadcast(_filter(plain, bits))
    schema = T.StructType([T.StructField(id, kind), T.StructField("at", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("plain", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, lengths = held.value
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ends, numbers, spelled, sums = _words(batch.column(1))
            text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            last, first = ends[text], np.concatenate([[0], ends[:-1]])
            for n in lengths:
                at = np.flatnonzero(np.arange(len(numbers)) + n <= last)
                slot = _slots(sums, at, n, bits)
                at = at[(passes[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)]
                if len(at):
                    place = at - first[text[at]]
                    said = [" ".join([spelled[w] for w in numbers[i : i + n]]) for i in at]
                    columns = batch.column(0).take(pa.array(text[at])), pa.array(place, pa.int32()), pa.array(place + n, pa.int32()), pa.array(said, arrow.field("plain").type)
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    salted = plain.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    runs = rows.mapInArrow(run, schema).withColumn("salt", F.col("at") % SALTS)
    return runs.join(salted, ["plain", "salt"]).select(id, "name", "at", "to")


def mentions(docs: DataFrame, id: str, text: str, names: DataFrame, name: str, overlapping: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, name, at, to: where texts hold names, as places of words (to is exclusive) in plain_words of the text.

    Names are compared as plain_words; such as have none are nowhere, equal ones are one, told by the smallest spelling. Of names that overlap the leftmost
    longest count, or with `overlapping` all. What passes the driver is bounded: all names while they are few, else the filter. Null texts hold nothing; a dictionary without names finds none."""
    plain = written(names.select(plain_words(F.col(name)).alias("plain"), name).where("plain <> ''").groupBy("plain").agg(F.min(name).alias("name")))  # read up to four times
    size = plain.agg(F.sum(F.octet_length("plain") + F.octet_length("name") + 32)).first()[0] or 0
    few = size <= shard_bytes
    kind = docs.schema[id].dataType
    schema = T.StructType([T.StructField(id, kind), T.StructField("name", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("to", T.IntegerType())])
    arrow = to_arrow_schema(schema)
    rows = docs.select(id, plain_words(F.col(text)).alias("t"))

    if few:
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in plain.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            spelled = [n for _, n in held.value]
            automaton = ahocorasick.Automaton()
            for i, (p, _) in enumerate(held.value):
                automaton.add_word(f" {p} ", (i, len(p), p.count(" ") + 1))
            if not held.value:
                return
            automaton.make_automaton()
            for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
                out = [], [], [], []
                for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    t = f" {t} "
                    found, word, seen = [], 0, 0
                    for end, (i, size, n) in automaton.iter(t):
                        # the closing space ends word number (spaces before it)
                        word, seen = word + t.count(" ", seen, end), end
                        found.append((word - n, word, i))
                    for at, to, i in leftmost_longest(found) if not overlapping else found:
                        for column, v in zip(out, (key, spelled[i], at, to)):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

        return rows.mapInArrow(run, schema)

    found = _by_runs(rows, id, kind, plain)
    if overlapping:
        return found
    listed = found.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("to")).alias("end"), "name"))).alias("m"))  # one text's mentions
    none = F.struct(F.array().cast("array<struct<at:int,end:int,name:string>>").alias("kept"), F.lit(0).alias("free"))
    step = lambda s, m: F.when(m["at"] >= s["free"], F.struct(F.concat(s["kept"], F.array(m)).alias("kept"), (-m["end"]).alias("free"))).otherwise(s)
    kept = listed.select(id, F.inline(F.aggregate("m", none, step, lambda s: s["kept"])))
    return kept.select(id, "name", "at", (-F.col("end")).alias("to"))


def first_mention(found: DataFrame, id: str) -> DataFrame:
    """id, name: the name that each text mentions first, of these the longest."""
    return found.groupBy(id).agg(F.min(F.struct("at", (-F.col("to")).alias("to"), "name")).alias("m")).select(id, F.col("m.name").alias("name"))
