"""Chunks of blocks: packed to a token budget with overlap, tiny ones merged, and how well they cover a document. Folds along one document's blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that close a chunk, that it repeats of the one before, below which it is tiny, and that a merged one may have.
TARGET, OVERLAP, TINY, MOST = 400, 200, 100, 800
# Words that bind a block to the one before.
PROVISO = r"(?i)provided that|subject to|except|exception|notwithstanding|however|unless|परन्तु|परंतु|बशर्ते|सिवाय|अपवाद|किन्तु|शर्त"
BOILERPLATE = r"(?i)https?://|www\.|page\s*[0-9]+|पृष्ठ\s*[0-9]+|^[0-9]+$"


def is_proviso(text: Column) -> Column:
    return F.coalesce(text.rlike(PROVISO), F.lit(False))


def is_boilerplate(kind: Column, text: Column) -> Column:
    """Headers, footers, empty blocks and short ones with a url or a page number; a table never is."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(kind == "TABLE", False).otherwise(F.coalesce(kind.isin("HEADER", "FOOTER"), F.lit(False)) | (t == "") | ((F.length(t) < 40) & t.rlike(BOILERPLATE)))


def sums(tokens: Column) -> Column:
    """0 and the running sums of an array."""
    start = F.struct(F.array(F.lit(0).cast("long")).alias("out"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(tokens, start, lambda a, n: F.struct(F.concat(a.out, F.array(a["sum"] + n)).alias("out"), (a["sum"] + n).alias("sum")), lambda a: a.out)


def packed(running: Column, provisos: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Chunks (first, last: numbers of blocks from 0) of blocks with running sums of tokens (see sums; a column of its own).

    A block that would make the open chunk larger than target closes it, unless it is a proviso or the first. The next chunk begins with as many
    of the last blocks as have overlap tokens at most."""
    n = F.size(provisos)
    of = lambda first, end: F.element_at(running, (end + 1).cast("int")) - F.element_at(running, (first + 1).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("first"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("out"))

    def step(a, i):
        closes = (i > a.first) & (of(a.first, i + 1) > target) & ~F.element_at(provisos, (i + 1).cast("int"))
        shared = F.array_min(F.filter(F.sequence(a.first, i - 1), lambda j: of(j, i) <= overlap))
        return F.when(closes, F.struct(F.coalesce(shared, i).alias("first"), F.concat(a.out, F.array(F.struct(a.first.alias("first"), (i - 1).alias("last")))).alias("out"))).otherwise(a)

    end = lambda a: F.concat(a.out, F.array(F.struct(a.first.alias("first"), (n - 1).cast("long").alias("last"))))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), start, step, end)).otherwise(F.array().cast("array<struct<first:bigint,last:bigint>>"))


def size_of(running: Column, chunk: Column) -> Column:
    """The tokens of a chunk (first, last) of blocks with running sums."""
    return F.element_at(running, (chunk["last"] + 2).cast("int")) - F.element_at(running, (chunk["first"] + 1).cast("int"))


def merged(running: Column, chunks: Column, tiny: int = TINY, most: int = MOST) -> Column:
    """Chunks (see packed) of one section after tiny ones are joined with the next, or else with the one before, where the tokens of both are few enough.

    A joined chunk has each of its blocks once, also those that the two shared; running and chunks are columns of their own."""
    kind = "array<struct<first:bigint,last:bigint>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(False).alias("skip"))
    both = lambda x, y: F.array(F.struct(F.least(x["first"], y["first"]).alias("first"), F.greatest(x["last"], y["last"]).alias("last")))
    then = lambda out, skip=False: F.struct(out.alias("out"), F.lit(skip).alias("skip"))

    def step(a, i):
        own, following, last = F.get(chunks, i), F.get(chunks, i + 1), F.try_element_at(a.out, F.lit(-1))
        is_tiny = size_of(running, own) < tiny
        fits = lambda other: is_tiny & other.isNotNull() & (size_of(running, own) + size_of(running, other) <= most)
        return (
            F.when(a.skip, then(a.out)).when(fits(following), then(F.concat(a.out, both(own, following)), True))
            .when(fits(last), then(F.concat(F.slice(a.out, 1, F.size(a.out) - 1), both(last, own)))).otherwise(then(F.concat(a.out, F.array(own))))
        )

    return F.when(F.size(chunks) > 0, F.aggregate(F.sequence(F.lit(0), F.size(chunks) - 1), start, step, lambda a: a.out)).otherwise(F.array().cast(kind))


def coverage(blocks: DataFrame, chunks: DataFrame, document: str, block: str, boilerplate: Column) -> DataFrame:
    """document, blocks, boilerplate, covered, missing and coverage: blocks that count and are in some chunk (document, block), by document."""
    inside = chunks.select(document, block).distinct().withColumn("inside", F.lit(True))
    rows = blocks.withColumn("boilerplate", boilerplate).join(inside, [document, block], "left")
    counts, covered = F.count_if(~F.col("boilerplate")), F.count_if(~F.col("boilerplate") & F.col("inside").isNotNull())
    return rows.groupBy(document).agg(F.count("*").alias("blocks"), F.count_if("boilerplate").alias("boilerplate"), covered.alias("covered"), (counts - covered).alias("missing"), F.when(counts > 0, F.round(covered / counts, 4)).otherwise(1.0).alias("coverage"))
