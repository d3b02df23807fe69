"""Citizen profiles: canonical values, aliases and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of the canonical names.
STATES = {"Rajasthan": ("rajasthan", "राजस्थान", "raj")}
DOMICILES = {"Rajasthan": ("rajasthan", "राजस्थान", "yes", "true", "1")}
GENDERS = {"MALE": ("M", "MALE", "पुरुष"), "FEMALE": ("F", "FEMALE", "महिला", "स्त्री")}
RESIDENCES = {"RURAL": ("RURAL", "ग्रामीण"), "URBAN": ("URBAN", "शहरी"), "BOTH": ("BOTH", "दोनों")}
#: Columns that stand in for another where that is null.
ALIASES = {"land_holding": ("land_area_bigha",), "social_category": ("caste_category",), "student_status": ("is_student",), "bpl_status": ("is_bpl",), "domicile": ("domicile_status",)}
#: Least and greatest values of numeric fields; null is open.
RANGES = {"age": (0, 130), "annual_income": (0, None), "family_income": (0, None), "land_holding": (0, None), "disability_percentage": (0, 100), "marks_percentage": (0, 100), "family_size": (1, None)}


def _named(value: Column, names: dict[str, tuple[str, ...]], otherwise: Column) -> Column:
    out = otherwise
    for name, spellings in names.items():
        out = F.when(value.isin(*spellings), name).otherwise(out)
    return F.when(value.isNotNull(), out)


def canonical(field: str, value: Column) -> Column:
    """A field's canonical value: known spellings by name; other text is trimmed, and in capitals where the names are."""
    plain = F.trim(value)
    if field == "state":
        return _named(F.lower(plain), STATES, value)
    if field == "domicile":
        return _named(F.lower(plain), DOMICILES, plain)
    capitals = F.upper(plain)
    if field == "gender":
        return _named(capitals, GENDERS, capitals)
    if field == "rural_urban":
        return _named(capitals, RESIDENCES, value)
    return capitals if field == "social_category" else value


def normalized(profiles: DataFrame, districts: dict[str, str] | None = None) -> DataFrame:
    """profiles with aliases resolved, monthly amounts made annual (x_frequency says which are) and names canonical.

    districts: lower-case spelling to name. Columns that a profile lacks are not made up; a null stays null."""
    columns = set(profiles.columns)
    out = profiles
    for field, others in ALIASES.items():
        known = [c for c in (field, *others) if c in columns]
        if known:
            out = out.withColumn(field, F.coalesce(*known))
    for field in ("family_income", "annual_income"):
        often = f"{field}_frequency"
        if {field, often} <= columns:
            monthly = F.upper(often) == "MONTHLY"
            out = out.withColumn(field, F.when(monthly, F.col(field) * 12).otherwise(F.col(field))).withColumn(often, F.when(monthly, "ANNUAL").otherwise(F.col(often)))
    for field in ("state", "domicile", "gender", "rural_urban", "social_category"):
        if field in out.columns:
            out = out.withColumn(field, canonical(field, F.col(field)))
    if districts and "district" in columns:
        names = F.create_map(*(F.lit(x) for pair in districts.items() for x in pair))
        out = out.withColumn("district", F.coalesce(names[F.lower(F.trim("district"))], F.col("district")))
    return out


def range_rules(columns: list[str]) -> list[tuple[str, str, Column]]:
    """For validation.issues: code, severity and the broken condition of each numeric field there is."""
    out = []
    for field, (low, high) in RANGES.items():
        if field in columns:
            broken = F.col(field) < low
            out.append((f"{field.upper()}_RANGE", "ERROR", broken | (F.col(field) > high) if high is not None else broken))
    return out
