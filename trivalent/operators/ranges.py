"""Rows in one total order over many partitions, and what a task must know of the partitions around its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Place:
    """Of a partition: how many rows of its first group lie in earlier ones, and whether its last group goes on in later ones."""

    before: int
    goes_on: bool


def in_ranges(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """df dealt by ranges of the order and sorted by it, with its partition as `part`.

    Rows that are equal in all of the order are told apart by their place in the input, so that no value, however frequent, is one task's."""
    rows = df.withColumn("input_place", F.monotonically_increasing_id())
    order = [*order, F.col("input_place")]
    rows = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    return rows.drop("input_place").withColumn("part", F.spark_partition_id())


def places(ordered: DataFrame, group: str) -> tuple[dict[int, Place], dict[str, int]]:
    """The place of each partition, and the rows of each group that lies in several, for rows sorted by a group that isn't null.

    A group in several partitions is the first or the last of each. So the driver gets one row a partition and holds no more than that."""
    counts = ordered.groupBy("part", group).agg(F.count("*").alias("n"))
    of = F.struct(F.col(group).alias("g"), "n")
    rows = sorted(counts.groupBy("part").agg(F.min(of).alias("low"), F.max(of).alias("high")).collect())
    totals, found = {}, {}
    before = {}
    for r in rows:
        before[r.part] = totals.get(r.low.g, 0)
        for g, n in {r.low, r.high}:
            totals[g] = totals.get(g, 0) + n
    parts = {}
    for r in rows:
        for g in {r.low.g, r.high.g}:
            parts[g] = parts.get(g, 0) + 1
    for k, r in enumerate(rows):
        found[r.part] = Place(before[r.part], k + 1 < len(rows) and rows[k + 1].low.g == r.high.g)
    return found, {g: n for g, n in totals.items() if parts[g] > 1}
