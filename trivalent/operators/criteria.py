"""Criteria in words to conditions, and a scheme's criteria to a rule tree kept as rows (see rules.NODES)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import number, number_range, numbers
from ..functions.text import ascii_digits, bound_operator, percentage, periodicity

# What a criterion must say to be about a field, in order, and what it may not say then; a space is any white space or none.
TOPICS = (
    ("income", "आय(?!ु) | income | वेतन | salary | lakh | लाख", "marks | अंक | प्रतिशत | %"),
    ("age", r"आयु | उम्र | \bage | वर्ष | साल | years?\b", "आय(?!ु) | income | अनुभव | experience"),
    ("residency", "निवासी | मूल निवासी | resident | domicile | राजस्थान", "आय(?!ु) | income"),
    ("gender", "महिला | स्त्री | पुरुष | female | women | woman | male", ""),
    ("social_category", r"अनुसूचित | \bsc\b | \bst\b | \bobc\b | जाति | वर्ग | category | caste", ""),
    ("disability", "दिव्यांग | विकलांग | disability | disabled | विशेष योग्यजन", ""),
    ("bpl_status", r"\bbpl\b | बीपीएल | गरीबी रेखा", ""),
)
FAMILY = "पारिवारिक | परिवार | family"
GENDERS = (("FEMALE", r"महिला | स्त्री | female | women | woman"), ("MALE", r"पुरुष | \bmale | \bmen\b | \bman\b"), ("ANY", r"सभी | \bany\b | \bboth\b"))
CATEGORIES = (("SC", r"\bsc\b | अनुसूचित जाति"), ("ST", r"\bst\b | अनुसूचित जनजाति"), ("OBC", r"\bobc\b | अन्य पिछड़ा वर्ग"), ("EWS", r"\bews\b | आर्थिक रूप से कमजोर"), ("GENERAL", r"\bgeneral\b | सामान्य"), ("MINORITY", r"\bminority\b | अल्पसंख्यक"))
#: The state that residents are of.
STATE = "Rajasthan"
#: Words between alternatives and between what must hold together, but where they belong to a bound or a range.
OR = r"(?i)\s+(?:or|अथवा|या)\s+(?!more\b|above\b|older\b|less\b|below\b|अधिक|ज्यादा|कम|उससे)"
AND = r"(?i)(?<!\bbetween\s{1,3}[0-9]{1,12})\s+(?:and|तथा|एवं|और)\s+(?!above\b|over\b|below\b)"
TRAILING = r"(?i)(?:^|\s)(?:or|अथवा|या)\s*$"
CONDITION = "struct<field:string,op:string,low:double,high:double,choices:array<string>,flag:boolean,period:string,sure:boolean>"


def _pattern(phrases: str) -> str:
    return "|".join(p.strip().replace(" ", r"\s*") for p in phrases.split(" | "))


def topic(text: Column) -> Column:
    """The field that a criterion is about; CUSTOM if it is none of TOPICS."""
    t, out = F.lower(text), F.lit(None).cast("string")
    for name, says, unless in reversed(TOPICS):
        holds = t.rlike(_pattern(says)) & ~t.rlike(_pattern(unless)) if unless else t.rlike(_pattern(says))
        out = F.when(holds, name).otherwise(out)
    return F.coalesce(F.when(t.isNotNull(), out), F.lit("CUSTOM"))


def criterion(text: Column, found: Column) -> Column:
    """CONDITION of a criterion: its field and operator, bounds, choices or flag, period, and whether it was understood. found is numbers(text), as a column of its own.

    Income is of the family or the applicant; a share of disability without an operator is at least that. What is about no known field is CUSTOM, with its
    number or else its text."""
    t = F.lower(ascii_digits(text))
    none, no_choice = F.lit(None).cast("double"), F.lit(None).cast("array<string>")
    n, r, op, about = number(text, found), number_range(text, found), F.coalesce(bound_operator(text), F.lit("EQ")), topic(text)
    between = r.isNotNull() & ~F.coalesce(t.rlike(r"से\s*(?:अधिक|ज्यादा|कम)"), F.lit(False))
    found = lambda table: F.array_compact(F.array(*(F.when(t.rlike(_pattern(p)), k) for k, p in table)))

    def made(field, op, low, high, choices, flag, sure):
        return F.struct(field.alias("field"), op.alias("op"), low.alias("low"), high.alias("high"), choices.alias("choices"), flag.alias("flag"), periodicity(text).alias("period"), F.coalesce(sure, F.lit(False)).alias("sure")).cast(CONDITION)

    lowered = lambda c: F.transform(c, F.lower)
    no_flag = F.lit(None).cast("boolean")
    of_number = lambda field: made(field, F.when(between, "BETWEEN").otherwise(F.when(op == "BETWEEN", "EQ").otherwise(op)), F.when(between, r["low"]).otherwise(n), F.when(between, r["high"]).otherwise(n), no_choice, no_flag, n.isNotNull())
    named = lambda field, choices: made(F.lit(field), F.when(F.size(choices) > 1, "IN").otherwise("EQ"), none, none, F.when(F.size(choices) > 0, lowered(choices)).otherwise(F.array(F.lower(F.trim(text)))), no_flag, F.size(choices) > 0)
    yes = lambda field: made(F.lit(field), F.lit("EQ"), none, none, no_choice, F.lit(True), F.lit(True))
    share = percentage(text)
    disabled = F.when(share.isNotNull(), made(F.lit("disability_percentage"), F.when(op.isin("EQ", "BETWEEN"), "GTE").otherwise(op), share, share, no_choice, no_flag, F.lit(True))).otherwise(yes("disability_status"))
    custom = F.when(n.isNotNull(), of_number(F.lit("CUSTOM"))).otherwise(made(F.lit("CUSTOM"), F.lit("EQ"), none, none, F.array(F.lower(F.trim(text))), no_flag, F.lit(False)))
    return (
        F.when(about == "income", of_number(F.when(t.rlike(_pattern(FAMILY)), "family_income").otherwise("annual_income"))).when(about == "age", of_number(F.lit("age")))
        .when(about == "residency", made(F.lit("residency"), F.lit("EQ"), none, none, F.array(F.lit(STATE.lower())), no_flag, F.lit(True))).when(about == "gender", named("gender", F.slice(found(GENDERS), 1, 1)))
        .when(about == "social_category", named("social_category", found(CATEGORIES))).when(about == "disability", disabled).when(about == "bpl_status", yes("bpl_status")).otherwise(custom)
    )


def tree_rows(schemes: DataFrame, id: str, text: str) -> DataFrame:
    """Rows (rules.NODES) of the trees that schemes' criteria say, one text a scheme.

    Lines (or what semicolons and full stops of either script part) must all hold. Within a line `or` parts alternatives and, below that, `and` what must hold
    together; a line that ends with `or` is one with the next. A line without a second part is a condition of its own. A scheme without
    criteria has a root that is always true. Criteria that were not understood stay, as conditions on CUSTOM."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)(\s(?:or|अथवा|या))\s*(?:[;।\n]|\.\s)\s*", "$1 ")
    parted = lambda c, pattern: F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(F.regexp_replace(x, r"[.,]+\s*$", ""))), lambda x: x != "")
    lines = parted(joined, r"[;।\n]|\.(?=\s|$)")
    alternatives = F.transform(lines, lambda line: F.transform(parted(F.regexp_replace(line, TRAILING, ""), OR), lambda a: parted(a, AND)))
    rows = schemes.select(F.col(id).cast("string").alias("scheme_id"), F.filter(alternatives, lambda a: F.size(F.flatten(a)) > 0).alias("lines"))

    none = lambda kind: F.lit(None).cast(kind)

    def group(path, parent, depth, kind, n):
        return F.struct(
            path.alias("path"), parent.alias("parent"), F.lit(depth).alias("depth"), kind.alias("kind"), none("string").alias("said"), n.cast("int").alias("open"), F.when(n > 0, 2).otherwise(2).alias("least"), F.when(n > 0, 0).otherwise(2).alias("most")
        )

    def condition(path, parent, depth, said):
        return F.struct(path.alias("path"), parent.alias("parent"), F.lit(depth).alias("depth"), F.lit("COND").alias("kind"), said.alias("said"), F.lit(0).alias("open"), F.lit(2).alias("least"), F.lit(0).alias("most"))

    at = lambda *parts: F.concat(*(p if isinstance(p, Column) and i == 0 else F.concat(F.lit("."), p.cast("string")) for i, p in enumerate(parts)))

    def of_parts(parts, path, parent, depth):
        """What must hold together: a condition, or a group of conditions."""
        below = F.transform(parts, lambda c, k: condition(at(path, k), path, depth + 1, c))
        return F.when(F.size(parts) == 1, F.array(condition(path, parent, depth, F.get(parts, F.lit(0))))).otherwise(F.concat(F.array(group(path, parent, depth, F.lit("AND"), F.size(parts))), below))

    def of_line(line, i):
        path = at(F.lit("0"), i)
        below = F.flatten(F.transform(line, lambda parts, j: of_parts(parts, at(path, j), path, 2)))
        return F.when(F.size(line) == 1, of_parts(F.get(line, F.lit(0)), path, F.lit("0"), 1)).otherwise(F.concat(F.array(group(path, F.lit("0"), 1, F.lit("OR"), F.size(line))), below))

    root = group(F.lit("0"), none("string"), 0, F.lit("AND"), F.size("lines"))
    every = rows.select("scheme_id", F.inline(F.concat(F.array(root), F.flatten(F.transform("lines", of_line)))))
    every = every.select("*", F.explode(F.array(numbers(F.coalesce("said", F.lit(""))))).alias("found"))  # generators keep what they make a column, computed once
    every = every.select("*", F.explode(F.array(F.when(F.col("kind") == "COND", criterion(F.col("said"), F.col("found"))))).alias("c"))
    return every.select("scheme_id", "path", "parent", "depth", "kind", "c.field", "c.op", "c.low", "c.high", "c.choices", "c.flag", "open", "least", "most")
