"""Change detection, versions and sessions over keyed histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_states(history: DataFrame, key: str, order: list[str], body: str, links: str) -> DataFrame:
    """history with state and kind: the first observation of a key is its baseline, later ones are changed if a fingerprint is."""
    w = Window.partitionBy(key).orderBy(*order)
    b, li = F.lag(body).over(w), F.lag(links).over(w)
    first = F.row_number().over(w) == 1
    b_new, l_new = ~F.col(body).eqNullSafe(b), ~F.col(links).eqNullSafe(li)
    state = F.when(first, "BASELINE").when(b_new | l_new, "CHANGED").otherwise("UNCHANGED")
    kind = F.when(first, None).when(b_new & l_new, "BOTH").when(b_new, "BODY").when(l_new, "LINKS")
    return history.withColumn("state", state).withColumn("kind", kind)


# Minutes between looks by priority, and outcomes by what follows from them.
TIERS = {"TIER_1": 60, "TIER_2": 360, "TIER_3": 1440, "TIER_4": 10080}
FAILED = ("CHECK_FAILED", "TEMPORARILY_UNAVAILABLE", "TIMEOUT")
REFUSED = ("BLOCKED_BY_POLICY", "ACCESS_FORBIDDEN", "AUTH_REQUIRED")
QUIET = ("UNCHANGED", "BASELINE_CREATED")


def next_interval(priority: Column, outcome: Column, failures: Column, unchanged: Column, retry_after: Column, custom: Column | None = None, least: int = 15, most: int = 10080, slower: float = 1.5, backoff: float = 2.0) -> Column:
    """Seconds to the next look, without jitter.

    A stated wait comes first, of `least` minutes at least. Failures wait 15 minutes times backoff to the power of one less than their number,
    refusals a day, long quiet sources up to slower squared of their own interval; all else the interval of the priority, or its
    own. Intervals lie between least and most."""
    clamp = lambda c: F.greatest(F.lit(float(least)), F.least(c, F.lit(float(most))))
    tier = F.coalesce(F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair))[F.upper(priority)], F.lit(1440))
    own = F.when(custom > 0, custom).otherwise(tier) if custom is not None else tier
    base = clamp(own.cast("double"))
    failed = clamp(max(15, least) * F.pow(F.lit(backoff), F.greatest(F.least(failures, F.lit(5)) - 1, F.lit(0))))
    quiet = clamp(base * F.when(unchanged >= 10, slower**2).when(unchanged >= 5, slower).otherwise(1.0))
    minutes = F.when(outcome.isin(*FAILED), failed).when(outcome.isin(*REFUSED), float(min(1440, most))).when(outcome.isin(*QUIET), quiet).otherwise(base)
    return F.when(retry_after > 0, F.greatest(retry_after.cast("double"), F.lit(least * 60.0))).otherwise(minutes * 60)


def full_diff(base: DataFrame, new: DataFrame, key: str, values: list[str], partial: bool = False) -> DataFrame:
    """key, change: ADDED, REMOVED (not if new is partial, where silence removes nothing) or CHANGED."""
    a, b = base.select(key, F.struct(*values).alias("a"), F.lit(True).alias("in_a")), new.select(key, F.struct(*values).alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("in_a").isNull(), "ADDED").when(F.col("in_b").isNull(), F.lit(None) if partial else F.lit("REMOVED")).when(~F.col("a").eqNullSafe(F.col("b")), "CHANGED")
    return both.select(key, change.alias("change")).where("change is not null")


def version_issues(versions: DataFrame, key: str, number: str, start: str, end: str) -> DataFrame:
    """Overlaps and gaps of more than a day between a key's neighbouring versions."""
    w = Window.partitionBy(key).orderBy(number)
    rows = versions.withColumn("next_start", F.lead(start).over(w))
    issue = F.when(F.col(end) > F.col("next_start"), "OVERLAP").when(F.datediff("next_start", end) > 1, "GAP")
    return rows.withColumn("issue", issue).where("issue is not null").select(key, number, "issue")


def as_of(events: DataFrame, versions: DataFrame, key: str, at: str, start: str, end: str, number: str, event: str, active: Column | None = None) -> DataFrame:
    """event, number: the version of the event's key that holds at its time, null if none does.

    Both days of an interval belong to it and a missing end is open. An active version comes before others, then the highest number."""
    v = versions.select(key, F.col(start).alias("_s"), F.col(end).alias("_e"), F.struct((active if active is not None else F.lit(True)).alias("active"), F.col(number).alias("n")).alias("_v"))
    holds = (events[key] == v[key]) & (F.col("_s").isNull() | (F.col("_s") <= events[at])) & (F.col("_e").isNull() | (events[at] <= F.col("_e")))
    return events.join(v, holds, "left").groupBy(events[event]).agg(F.max("_v").alias("_v")).select(event, F.col("_v.n").alias(number))


def sessions(events: DataFrame, key: str, at: str, minutes: int) -> DataFrame:
    """key, session, start, end, n: runs of events without a pause of `minutes` or more."""
    w = Window.partitionBy(key).orderBy(at)
    pause = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    rows = events.withColumn("session", F.sum(F.coalesce((pause >= minutes * 60_000_000).cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(at).alias("start"), F.max(at).alias("end"))


def folded(events: DataFrame, key: str, order: list[str], name: str, table: dict[tuple[str, str], str], start: str) -> DataFrame:
    """key, state: a transition table folded over each key's events in order; without a transition the state stays."""
    moves = F.create_map(*(F.lit(x) for (s, e), t in table.items() for x in (f"{s}|{e}", t)))
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(name).alias("_e")))).alias("es"))  # one key's events
    return listed.select(key, F.aggregate("es", F.lit(start), lambda s, e: F.coalesce(moves[F.concat(s, F.lit("|"), e["_e"])], s)).alias("state"))
