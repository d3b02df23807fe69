"""Readers and sinks around Spark's own: delimited text of unknown encoding, feeds, JSON cases, hashes and validation of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "iso-8859-1")
EXTENSIONS = {"pdf": "255044462D", "xlsx": "504B0304", "xls": "D0CF11E0", "html": None, "csv": None, "txt": None}


def read_delimited(spark: SparkSession, path: str, header: bool = True, separator: str = ",") -> DataFrame:
    """A delimited file in UTF-8 or else in the next encoding: the first in which no character is a replacement."""
    for encoding in ENCODINGS:
        df = spark.read.csv(path, header=header, sep=separator, encoding=encoding, multiLine=True)
        broken = [F.contains(F.col(f"`{c}`"), F.lit("�")) for c in df.columns]
        names_fine = not any("�" in c for c in df.columns)
        if names_fine and df.where(F.coalesce(F.greatest(*broken, F.lit(False)), F.lit(False))).isEmpty():
            return df
    return df


def flattened(df: DataFrame, names: list[str]) -> DataFrame:
    """row_text: 'header: value' parts of what isn't blank, joined by bars; a blank header is named by its place."""
    label = [n.strip() or f"Column_{i + 1}" for i, n in enumerate(names)]
    parts = [F.when(F.trim(F.col(f"`{c}`")) != "", F.concat(F.lit(f"{n}: "), F.trim(F.col(f"`{c}`")))) for c, n in zip(df.columns, label)]
    return df.withColumn("row_text", F.concat_ws(" | ", *parts))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256, extension, valid: whole files, checked by size, extension and first bytes."""
    files = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    magic = F.lit(None).cast("string")
    for e, m in EXTENSIONS.items():
        magic = F.when(ext == e, F.lit(m)).otherwise(magic)
    head = F.hex(F.substring("content", 1, 5))
    valid = (F.col("length") > 0) & ext.isin(*EXTENSIONS) & (magic.isNull() | F.startswith(head, magic))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), ext.alias("extension"), valid.alias("valid"))


def feed_entries(xml: Column) -> Column:
    """Sorted distinct 'location|date' of a sitemap, an RSS or an Atom feed."""

    def parts(block: str, name: str, date: str) -> Column:
        blocks = F.regexp_extract_all(xml, F.lit(rf"(?s)<{block}[\s>].*?</{block}>"), F.lit(0))
        one = lambda b, tag: F.trim(F.regexp_extract(b, rf"(?s)<{tag}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1))
        return F.transform(blocks, lambda b: F.concat(one(b, name), F.lit("|"), one(b, date)))

    return F.array_sort(F.array_distinct(F.concat(parts("url", "loc", "lastmod"), parts("item", "guid", "pubDate"), parts("entry", "id", "updated"))))


def read_cases(spark: SparkSession, path: str, labels: tuple[str, ...] = ("expected",)) -> DataFrame:
    """JSON files of one case each, without what tells the answer."""
    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return df.drop(*labels)


def changed_rows(new: DataFrame, known: DataFrame, key: str, hash: str) -> DataFrame:
    """new's rows that an index doesn't have, or has with another hash: what an upsert writes."""
    return new.join(known.select(key, F.col(hash).alias("_known")), key, "left").where(~F.col(hash).eqNullSafe(F.col("_known"))).drop("_known")


def upserted(known: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    return known.join(changed.select(key), key, "left_anti").unionByName(changed)
