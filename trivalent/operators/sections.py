"""Where each line of a document stands under its headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heading_paths(lines: DataFrame, document: str, order: str, level: str, title: str, levels: int, name: str = "path") -> DataFrame:
    """lines with the titles of the headings that they stand under, outermost first; a heading stands under itself.

    A line's level is 1 to `levels` if it is a heading, null (or anything else) if not. A heading closes those of its own and of deeper levels; a level
    that was skipped is simply not there. One window a document: the last heading of each level, unless one of a higher level came after it."""
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col(level) == n, F.struct(F.col(order).alias("at"), F.col(title).alias("title"))), ignorenulls=True).over(w) for n in range(1, levels + 1)]
    rows = lines.select("*", *(c.alias(f"_h{n}") for n, c in enumerate(last, 1)))
    shown = []
    for n in range(1, levels + 1):
        own = F.col(f"_h{n}")
        above = F.greatest(*(F.col(f"_h{k}.at") for k in range(1, n)), F.lit(None), F.lit(None)) if n > 1 else None
        shown.append(F.when(own.isNotNull() & (above.isNull() | (own["at"] > above)), own["title"]) if n > 1 else own["title"])
    return rows.select(*lines.columns, F.array_compact(F.array(*shown)).alias(name))


def markdown_level(line: Column) -> Column:
    """The level of a heading in markdown, null for other lines."""
    marks = F.regexp_extract(line, r"^(#{1,6})\s+\S", 1)
    return F.when(marks != "", F.length(marks))
