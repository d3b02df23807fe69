"""Three-valued logic and typed comparisons as Columns. Unknown is null throughout, so Catalyst's AND, OR and NOT are Kleene's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def unknown() -> Column:
    return F.lit(None).cast("boolean")

DECIMAL = "decimal(18,4)"


def all_of(states: list[Column]) -> Column:
    """True for none."""
    return reduce(lambda a, b: a & b, states, F.lit(True))


def any_of(states: list[Column]) -> Column:
    """False for none."""
    return reduce(lambda a, b: a | b, states, F.lit(False))


def negation(states: list[Column]) -> Column:
    """Of the first; unknown for none."""
    return ~states[0] if states else unknown()


def number(value: Column) -> Column:
    """As a decimal, thousands' commas dropped; unknown if it is no number."""
    return F.regexp_replace(value.cast("string"), ",", "").try_cast(DECIMAL)


def text(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string")))


#: What text counts as true against a boolean; all other text is false.
YES = ("true", "1", "yes", "हाँ", "ha")


def flag(value: Column) -> Column:
    """As a boolean: text and booleans by YES, numbers by being other than 0."""
    as_text = F.lower(value.cast("string"))
    return F.when(F.typeof(value).isin("boolean", "string"), as_text.isin(*YES)).otherwise(as_text.try_cast("double") != 0)


def equals(value: Column, target) -> Column:
    """Booleans on either side as such, then numbers, then trimmed text without regard to case."""
    if target is None:
        return unknown()
    if isinstance(target, bool):
        return flag(value) == F.lit(target)
    wanted = target.lower() in YES if isinstance(target, str) else bool(target)
    goal = number(F.lit(str(target)))
    as_number = number(value)
    same_text = text(value) == text(F.lit(str(target)))
    plain = F.when(as_number.isNotNull() & goal.isNotNull(), as_number == goal).otherwise(same_text)
    return F.when(F.typeof(value) == "boolean", flag(value) == F.lit(wanted)).otherwise(plain)


def one_of(value: Column, targets: list) -> Column:
    """A miss is false even if targets hold a null; a null value is unknown."""
    wanted = F.array(*(text(F.lit(None if t is None else str(t))) for t in targets))
    return F.when(value.isNotNull(), F.exists(wanted, lambda t: t.eqNullSafe(text(value))))


def between(value: Column, low, high) -> Column:
    v = number(value)
    return (v >= number(F.lit(str(low)))) & (v <= number(F.lit(str(high))))


def compare(op: str, value: Column, target) -> Column:
    """An operator of the rule language; unknown for one that isn't."""
    if op == "EQ":
        return equals(value, target)
    if op == "NE":
        return ~equals(value, target)
    if op in ("GT", "GTE", "LT", "LTE"):
        v, t = number(value), number(F.lit(str(target)))
        return {"GT": v > t, "GTE": v >= t, "LT": v < t, "LTE": v <= t}[op]
    if op == "BETWEEN":
        low, high = (target.get("min"), target.get("max")) if isinstance(target, dict) else target
        return between(value, low, high)
    if op in ("IN", "NOT_IN"):
        hit = one_of(value, target if isinstance(target, list) else [target])
        return hit if op == "IN" else ~hit
    if op == "EXISTS":  # a missing value is unknown, not false
        return F.when(value.isNotNull(), F.lit(True))
    if op == "NOT_EXISTS":
        return F.when(value.isNotNull(), F.lit(False))
    return unknown()
