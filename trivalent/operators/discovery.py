"""From a profile to ranked schemes: the candidate filter, the verdict buckets and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import open_between, top_k
from .sizes import hinted, written

# Origins that the state's own policy admits, and schemes that hold anywhere.
ORIGINS = ("RAJASTHAN_STATE", "CENTRALLY_SPONSORED", "RAJASTHAN_MODIFIED_CSS", "UNKNOWN")
HOME, EVERYWHERE = "rajasthan", ("rajasthan", "all_india")
#: Candidates of a profile at most, by id; and results a bucket.
MOST_CANDIDATES, MOST_RESULTS = 200, 5


def admits(day: Column, category: Column | None = None, central: bool = False, fixed: bool = False) -> Column:
    """Whether a scheme (verified, active, valid_from, valid_until, origin, state, districts, rural_urban, category) is a candidate for a
    profile (p_state, p_district, p_rural_urban). What is unknown of a profile filters nothing. If fixed, only what doesn't depend on the profile is looked at."""
    out = F.col("verified") & F.col("active") & open_between(F.col("valid_from"), F.col("valid_until"), day)
    if not central:
        out &= F.col("origin").isin(*ORIGINS)
    if category is not None:
        out &= category.isNull() | (F.lower("category") == F.lower(F.trim(category)))
    if fixed:
        return F.coalesce(out, F.lit(False))
    home = F.lower("p_state") == HOME
    state = F.lower("state")
    by_state = F.col("p_state").isNull() | F.when(home, state.isNull() | state.isin(*EVERYWHERE)).otherwise(F.coalesce(state == F.lower("p_state"), F.lit(False)))
    wanted = F.col("p_district")
    by_district = wanted.isNull() | F.col("districts").isNull() | (F.size("districts") == 0) | F.array_contains("districts", wanted) | F.array_contains("districts", F.lower(wanted))
    residence = F.upper("p_rural_urban")
    by_residence = ~residence.isin("RURAL", "URBAN") | residence.isNull() | F.col("rural_urban").isin("BOTH", "ALL") | (F.col("rural_urban") == residence)
    return F.coalesce(out & by_state & by_district & by_residence, F.lit(False))


#: Stands for what is unknown of a profile, and for the districts of a scheme that holds in all; no value, as values are kept behind a sign.
ANY, OPEN = "any", "open"


def _scheme_keys() -> tuple[Column, Column, Column]:
    """Arrays of the states, districts and residences, as profiles are classed, that a scheme admits."""
    state, own = F.lower("state"), F.concat(F.lit("="), F.lower("state"))
    at_home = state.isNull() | state.isin(*EVERYWHERE)
    states = F.array_compact(F.array(F.lit(ANY), F.when(at_home, f"={HOME}"), F.when(state != HOME, own)))
    everywhere = F.col("districts").isNull() | (F.size("districts") == 0)
    listed = F.transform(F.array_distinct(F.array_compact("districts")), lambda d: F.concat(F.lit("="), d))
    districts = F.concat(F.array(F.lit(ANY)), F.when(everywhere, F.array(F.lit(OPEN))).otherwise(listed))
    fits = lambda r: F.col("rural_urban").isin("BOTH", "ALL", r)
    residences = F.array_compact(F.array(F.lit(ANY), *(F.when(fits(r), r) for r in ("RURAL", "URBAN"))))
    return states, districts, residences


def candidates(profiles: DataFrame, schemes: DataFrame, day: Column, most: int = MOST_CANDIDATES, category: Column | None = None, central: bool = False) -> DataFrame:
    """profiles joined with the schemes that admit them (see admits), the first `most` of each profile by scheme_id, and rank.

    What a scheme admits are states, districts, residences and wished categories, and profiles of one class (alike in these) have the same candidates. So the first
    schemes of each key are found once, classes are joined with keys by equality, and profiles with their class: no scheme meets profiles that
    it doesn't admit, and what leaves a step are at most `most` schemes a list of keys, key, class and profile."""
    rows = schemes.where(admits(day, None, central, fixed=True))
    states, districts, residences = _scheme_keys()
    kinds = F.array(F.lit(ANY)) if category is None else F.array_compact(F.array(F.lit(ANY), F.concat(F.lit("="), F.lower("category"))))
    keys = ["in_state", "in_district", "in_residence", "in_category"]
    lists = dict(zip(keys, (states, districts, residences, kinds)))
    # schemes of equal lists are cut first: a scheme has up to some thirty keys, and few of those that share them are needed
    few = top_k(rows.withColumns(lists), keys, [F.col("scheme_id")], most).drop("rank")
    for k in keys:
        few = few.withColumn(k, F.explode(k))
    first = top_k(few, keys, [F.col("scheme_id")], most).drop("rank")

    wanted, residence = F.col("p_district"), F.upper("p_rural_urban")
    classed = profiles.withColumns({
        "in_state": F.when(F.col("p_state").isNull(), ANY).otherwise(F.concat(F.lit("="), F.lower("p_state"))), "of_district": F.coalesce(F.concat(F.lit("="), wanted), F.lit(ANY)),
        "in_residence": F.when(residence.isin("RURAL", "URBAN"), residence).otherwise(ANY),
        "in_category": F.lit(ANY) if category is None else F.coalesce(F.concat(F.lit("="), F.lower(F.trim(category))), F.lit(ANY)),
    })
    by = ["in_state", "of_district", "in_residence", "in_category"]
    named = F.substring("of_district", 2, 1_000_000)
    in_districts = F.when(F.col("of_district") == ANY, F.array(F.lit(ANY))).otherwise(F.array_distinct(F.array(F.lit(OPEN), F.col("of_district"), F.concat(F.lit("="), F.lower(named)))))
    classes = classed.select(*by).distinct().withColumn("in_district", F.explode(in_districts))
    own = schemes.columns
    admitted = classes.join(first, keys).groupBy(*by, "scheme_id").agg(*(F.first(c).alias(c) for c in own if c != "scheme_id"))
    best = written(top_k(admitted, by, [F.col("scheme_id")], most))
    return classed.join(hinted(best, 200), by).select(*profiles.columns, *own, "rank")


def buckets(evaluated: DataFrame, similarity: str, most: int = MOST_RESULTS) -> DataFrame:
    """The first `most` of each profile's eligible schemes and of those that need information: by similarity (unknown counts -1), then by id.

    Schemes that a profile is not eligible for are left out."""
    open_ = evaluated.where(F.col("status").isin("ELIGIBLE", "MORE_INFORMATION_REQUIRED"))
    return top_k(open_, ["profile_id", "status"], [F.desc(F.coalesce(similarity, F.lit(-1.0))), F.col("scheme_id")], most)
