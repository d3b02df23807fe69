"""Watched web pages: their links, what changed between two looks, and which of it to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, resource_type

#: Links of a page that are followed at most; the rest waits for the next look.
MOST_LINKS = 50
# Words that make a link a notification or about a scheme.
NOTIFICATIONS, SCHEMES = r"notification|circular|order|अधिसूचना|परिपत्र|आदेश", r"scheme|yojana|योजना"


def resolved(link: Column, base: Column) -> Column:
    """A link against its page's url: absolute ones as they are, those of the same host or folder completed, no fragment; null if it can't be fetched."""
    plain = F.trim(F.regexp_replace(link, "#.*$", ""))
    origin, folder = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    inside = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when((plain == "") | plain.rlike("(?i)^(?:mailto|javascript|tel|data):"), None).when(plain.rlike("(?i)^https?://"), plain)
        .when(plain.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), plain)).when(plain.startswith("/"), F.concat(origin, plain)).otherwise(F.concat(inside, plain))
    )


def links(pages: DataFrame, id: str, url: str, html: str) -> DataFrame:
    """id, link, anchor: every different link of each page with the first of its texts that isn't empty."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>.*?</a>"""), F.lit(0))
    rows = pages.select(id, F.col(url).alias("base"), F.posexplode(found).alias("i", "a"))
    link = resolved(F.regexp_extract("a", r"""(?is)href\s*=\s*["']([^"']*)["']""", 1), F.col("base"))
    rows = rows.select(id, "i", link.alias("link"), collapsed(F.regexp_replace("a", "(?s)<[^>]*>", "")).alias("anchor")).where("link is not null")
    return rows.groupBy(id, "link").agg(F.coalesce(F.min_by(F.when(F.col("anchor") != "", F.col("anchor")), F.when(F.col("anchor") != "", F.col("i"))), F.lit("")).alias("anchor"))


def link_changes(before: DataFrame, after: DataFrame, id: str) -> DataFrame:
    """id, link, anchor, change: LINK_ADDED, LINK_REMOVED or LINK_CHANGED (the same link under another text)."""
    a, b = before.select(id, "link", F.col("anchor").alias("old")), after.select(id, "link", F.col("anchor").alias("new"))
    change = F.when(F.col("old").isNull(), "LINK_ADDED").when(F.col("new").isNull(), "LINK_REMOVED").when(F.col("old") != F.col("new"), "LINK_CHANGED")
    return a.join(b, [id, "link"], "full_outer").select(id, "link", F.coalesce("new", "old").alias("anchor"), change.alias("change")).where("change is not null")


def to_fetch(changes: DataFrame, id: str, most: int = MOST_LINKS) -> DataFrame:
    """id, link, reason, rank: added and changed links of each page, notifications and files first, `most` of them."""
    said = F.lower(F.concat_ws(" ", "anchor", "link"))
    pdf = resource_type(F.col("link")) == "PDF"
    wanted = said.rlike(NOTIFICATIONS) | said.rlike(SCHEMES)
    reason = F.when(pdf & wanted, "NEW_NOTIFICATION").when(pdf, "NEW_PDF").when(F.col("change") == "LINK_CHANGED", "CHANGED_LINK").otherwise("NEW_LINK")
    order = F.element_at(F.create_map(*(F.lit(x) for i, r in enumerate(("NEW_NOTIFICATION", "NEW_PDF", "NEW_LINK", "CHANGED_LINK")) for x in (r, i))), F.col("reason"))
    rows = changes.where("change in ('LINK_ADDED', 'LINK_CHANGED')").select(id, "link", reason.alias("reason"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(id).orderBy(order, "link"))).where(F.col("rank") <= most)
