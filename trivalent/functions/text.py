"""Scalar functions over bilingual text as Columns: numbers, dates, operators, periods, intents, tokens and urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DEVANAGARI = "०१२३४५६७८९"
_DEVANAGARI_BLOCK = "".join(map(chr, range(0x0900, 0x0980)))
# Scale words of Indian numbers.
SCALES = {"thousand": 1_000, "hazar": 1_000, "हजार": 1_000, "lakh": 100_000, "lac": 100_000, "लाख": 100_000, "crore": 10_000_000, "करोड़": 10_000_000, "arab": 1_000_000_000, "अरब": 1_000_000_000}


def ascii_digits(c: Column) -> Column:
    return F.translate(c, _DEVANAGARI, "0123456789")


def indian_number(c: Column) -> Column:
    """The first number: with a scale word, else with thousands' commas, else plain. Unknown without one."""
    t = F.lower(ascii_digits(c))
    words = "|".join(SCALES)
    scaled = F.regexp_extract(t, rf"([0-9][0-9,]*\.?[0-9]*)\s*({words})", 1)
    word = F.regexp_extract(t, rf"([0-9][0-9,]*\.?[0-9]*)\s*({words})", 2)
    scale = F.lit(None).cast("decimal(18,2)")
    for w, n in SCALES.items():
        scale = F.when(word == w, F.lit(n).cast("decimal(18,2)")).otherwise(scale)
    plain = F.regexp_replace(F.regexp_extract(t, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "")
    return F.coalesce((F.regexp_replace(scaled, ",", "").try_cast("decimal(18,2)") * scale).cast("double"), plain.try_cast("double"))


def percentage(c: Column) -> Column:
    return F.regexp_extract(ascii_digits(c), r"([0-9]+(?:\.[0-9]+)?)\s*(?:%|percent|प्रतिशत)", 1).try_cast("double")


# What a phrase must say for a bound, by operator and in order of precedence; a space is any white space or none, | is or.
NOT_A_RANGE = "से अधिक | से ज्यादा | से कम"
RANGE = r"between\s+[0-9].*and\s+[0-9]|(?<![0-9-])[0-9]+\s*(?:-|to|से)\s*[0-9]+(?![0-9-])"
BOUNDS = (
    ("LTE", "not more | not exceed | not above | not greater | से अधिक नहीं | से ज्यादा नहीं"),
    ("GTE", "not less | not below | से कम नहीं"),
    ("GTE", "at least | minimum | or more | and above | न्यूनतम | कम से कम | या अधिक | या उससे अधिक | या ज्यादा | पूर्ण कर चुके"),
    ("GT", "more than | above | over | greater than | exceeding | से अधिक | से ज्यादा"),
    ("LTE", "at most | maximum | up to | or less | अधिकतम | तक"),
    ("LT", "less than | below | under | से कम"),
)


def phrase_pattern(phrases: str) -> str:
    return "|".join(p.strip().replace(" ", r"\s*") for p in phrases.split("|"))


def bound_operator(c: Column) -> Column:
    """The comparison that a phrase names: range, negated bound, then the plain bounds; a bare number is EQ."""
    t = F.lower(ascii_digits(c))
    out = F.when(~t.rlike(phrase_pattern(NOT_A_RANGE)) & t.rlike(RANGE), "BETWEEN")
    for operator, phrases in BOUNDS:
        out = out.when(t.rlike(phrase_pattern(phrases)), operator)
    return out.when(t.rlike(r"[0-9]"), "EQ")


def unit(c: Column) -> Column:
    """The unit of a number: years, months, days, per cent or rupees, in this order."""
    t = F.lower(ascii_digits(c))
    return (
        F.when(t.rlike("वर्ष|साल|year|yr"), "years").when(t.rlike("माह|महीने|month"), "months").when(t.rlike("दिन|day"), "days")
        .when(t.rlike("%|प्रतिशत|percent"), "PERCENT").when(t.rlike("₹|rs|rupee|रुपये|रुपए"), "INR")
    )


def periodicity(c: Column) -> Column:
    t = F.lower(c)
    return F.when(t.rlike(r"month|प्रति माह|मासिक"), "MONTHLY").when(t.rlike(r"quarter|त्रैमासिक"), "QUARTERLY").when(t.rlike(r"annual|year|per annum|वार्षिक|प्रति वर्ष"), "ANNUAL").when(t.rlike(r"one.?time|lump ?sum|एकमुश्त"), "ONE_TIME")


def annual(amount: Column, period: Column) -> Column:
    return F.when(period == "MONTHLY", amount * 12).when(period == "QUARTERLY", amount * 4).otherwise(amount)


def parsed_date(c: Column) -> Column:
    """ISO dates, then day/month/year of the years 2020 to 2039."""
    t = ascii_digits(c)
    iso = F.regexp_extract(t, r"((?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})", 1)
    d, m, y = (F.regexp_extract(t, r"\b([0-9]{1,2})[/.-]([0-9]{1,2})[/.-](20[23][0-9])\b", i) for i in (1, 2, 3))
    return F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))


def duration(c: Column) -> tuple[Column, Column]:
    """A relative duration's value and unit."""
    t = F.lower(ascii_digits(c))
    pattern = r"([0-9]+)\s*(year|month|week|day|वर्ष|माह|दिन)"
    unit = F.regexp_extract(t, pattern, 2)
    named = F.when(unit.isin("year", "वर्ष"), "YEAR").when(unit.isin("month", "माह"), "MONTH").when(unit == "week", "WEEK").when(unit.isin("day", "दिन"), "DAY")
    return F.regexp_extract(t, pattern, 1).try_cast("int"), named


def intent(c: Column) -> Column:
    """What an utterance wants: query, correction, decline, unknown, else information."""
    t = F.lower(F.trim(c))
    return (
        F.when(t.rlike(r"\?|^(?:what|which|how|when|where|why|who)\b|क्या|कौन|कैसे"), "QUERY")
        .when(t.rlike(r"\b(?:actually|correction|i meant|change)\b|गलत"), "CORRECTION")
        .when(t.rlike(r"\b(?:skip|prefer not|decline|won't say)\b|नहीं बताना"), "DECLINE")
        .when(t.rlike(r"don't know|do not know|not sure|no idea|पता नहीं"), "UNKNOWN")
        .otherwise("INFORMATION")
    )


def yes_no(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.rlike(r"^(?:no|nope|nah|never|नहीं|ना)\b"), False).when(t.rlike(r"^(?:yes|yeah|yep|sure|ok|correct|हाँ|जी)\b"), True)


def negated(c: Column) -> Column:
    return F.lower(c).rlike(r"(?:^|[^\p{L}])(?:not|no|never|none|without|nicht|kein|keine|pas|sans|no|sin|nunca|नहीं|बिना)(?:$|[^\p{L}])")


def estimated_tokens(c: Column) -> Column:
    """A word is 0.45 tokens a Devanagari character and 0.28 any other, each part rounded half to even, one at least."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")

    def cost(hindi, other):
        return F.greatest(F.lit(1), (F.bround(hindi * 0.45) + F.bround(other * 0.28)).cast("int"))

    def mixed(w):
        other = F.length(F.translate(w, _DEVANAGARI_BLOCK, ""))
        return cost(F.length(w) - other, other)

    # most texts have no such character: their words needn't be looked at one character after the other
    costs = F.when(c.rlike(r"[\x{0900}-\x{097F}]"), F.transform(words, mixed)).otherwise(F.transform(words, lambda w: cost(F.lit(0), F.length(w))))
    return F.aggregate(costs, F.lit(0).cast("long"), lambda a, b: a + b)


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalized_for_dedup(c: Column) -> Column:
    """Lower case, white space of each line made one space, without blank lines and bare page numbers."""
    lines = F.transform(F.split(F.lower(c), r"\r\n|\r|\n"), collapsed)
    return F.array_join(F.filter(lines, lambda s: (s != "") & ~s.rlike(r"^(?:page\s*)?[0-9]+(?:\s*(?:of|/)\s*[0-9]+)?$")), "\n")


def normalized_url(c: Column) -> Column:
    """Host in lower case, no fragment, repeated slashes of the path made one, the query kept."""
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+", "/")
    query = F.regexp_extract(c, r"(\?[^#]*)", 1)
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, path, query))


def resource_type(url: Column) -> Column:
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return F.when(path.rlike(r"\.pdf$"), "PDF").when(path.rlike(r"\.docx?$"), "DOCUMENT").when(path.rlike(r"\.(?:xlsx?|csv)$"), "SPREADSHEET").when(path.rlike(r"\.(?:png|jpe?g|gif|webp)$"), "IMAGE").when(path.rlike(r"\.html?$|/$|/[^./]*$"), "HTML").otherwise("OTHER")


def words(c: Column) -> Column:
    """Lower-case words of letters, marks, digits and underscores, of two characters at least."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: F.length(w) > 1)


def garbled_ratio(c: Column) -> Column:
    """The share of characters that are controls, unassigned or replacements."""
    n = F.length(c)
    return F.when(n > 0, (n - F.length(F.regexp_replace(c, r"[\p{Cn}\p{Co}\x{FFFD}]|[\p{Cc}&&[^\t\r\n]]", ""))) / n).otherwise(0.0)


def ocr_decision(c: Column) -> Column:
    return F.when(garbled_ratio(c) > 0.15, "GARBLED").when(F.length(F.regexp_replace(c, r"[^\x{FFFD}]", "")) >= 3, "REPLACEMENTS").when(F.length(F.trim(c)) < 50, "LITTLE_TEXT").otherwise("NOT_NEEDED")


def evidence_contains(c: Column, quote: Column) -> Column:
    return F.contains(F.lower(collapsed(c)), F.lower(collapsed(quote)))
