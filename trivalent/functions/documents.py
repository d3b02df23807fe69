"""Scalar functions over official documents: headings, dates, amounts, hosts, titles, tables, stable embeddings."""

from __future__ import annotations

import functools
import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_digits, words

# Words of titles that say nothing, formats of dates, signs of versions and of amounts.
TITLE_NOISE = ("final", "copy", "download", "new", "latest", "doc", "pdf", "file", "draft", "scan", "circular", "notification")
DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy")
CARDINALS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def any_date(c: Column) -> Column:
    """The date that the whole text is, in the first of DATE_FORMATS that fits."""
    t = F.trim(ascii_digits(c))
    return F.coalesce(*(F.try_to_date(t, f) for f in DATE_FORMATS))


def title_tokens(c: Column) -> Column:
    """Distinct words of three letters or more that are neither numbers nor TITLE_NOISE."""
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) > 2) & ~w.isin(*TITLE_NOISE) & ~w.rlike("^[0-9]+$")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values, rounded to 4 places; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(both / (F.size(a) + F.size(b) - both), 4)).otherwise(0.0)


def line_changes(old: Column, new: Column) -> tuple[Column, Column]:
    """Distinct lines of new that old lacks, and of old that new lacks; white space at the ends doesn't count."""
    lines = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: s != ""))
    return F.array_except(lines(new), lines(old)), F.array_except(lines(old), lines(new))


def year_shift(old: Column, new: Column) -> Column:
    """Whether both texts name years and the latest of new is later."""
    latest = lambda c: F.array_max(F.transform(F.regexp_extract_all(ascii_digits(c), F.lit(r"(?<![0-9])(20[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int")))
    return F.coalesce(latest(new) > latest(old), F.lit(False))


def stable_embedding(c: Column, dimensions: int) -> Column:
    """A unit vector made of hashes: component i is the first four bytes (little-endian) of the md5 of text:i, less a half. No model."""

    def component(i):
        h = F.md5(F.concat(c, F.lit(":"), i.cast("string")))
        return F.conv(F.concat(*(F.substring(h, at, 2) for at in (7, 5, 3, 1))), 16, 10).cast("double") / 2.0**32 - 0.5

    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), component)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def allowed(url: Column, domains: list[str]) -> Column:
    """Whether a url is http or https and its host is one of the domains or below one."""
    h = host(url)
    inside = F.lit(False)
    for d in domains:
        inside = inside | (h == d) | h.endswith(f".{d}")
    return F.coalesce(url.rlike("(?i)^https?://") & inside, F.lit(False))


# Networks that are not public, and names of this machine or of its surroundings.
NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/128", "::1/128", "100::/64", "2001:db8::/32", "fc00::/7", "fe80::/10", "ff00::/8",
)
LOCAL_NAMES = ("localhost", "metadata.google.internal", "instance-data")
_MAPPED = "0" * 20 + "ffff"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ipv4(text: Column) -> Column:
    """The number of an address in four parts or in one, null if the text is none."""
    parts = F.transform(F.split(text, r"\."), lambda p: p.try_cast("long"))
    four = F.when(text.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), _let(parts, lambda ps: F.when(F.forall(ps, lambda p: p <= 255), F.aggregate(ps, F.lit(0).cast("long"), lambda n, p: n * 256 + p))))
    one = F.when(text.rlike("^[0-9]{1,10}$") & (text.try_cast("long") < 1 << 32), text.try_cast("long"))
    return F.coalesce(four, one)


def _ipv6(text: Column) -> Column:
    """The 32 hexadecimal digits of an address, null if the text is none; its end may be in four decimal parts."""
    tail = _ipv4(F.regexp_extract(text, r":([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1))
    words = _let(tail, lambda n: F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(65535))))
    groups = lambda h: F.filter(F.split(F.coalesce(h, F.lit("")), ":"), lambda g: g != "")

    def filled(halves):
        """All eight groups: noughts stand for a double colon."""
        both = F.struct(groups(F.get(halves, F.lit(0))).alias("l"), groups(F.get(halves, F.lit(1))).alias("r"), F.size(halves).alias("n"))
        return _let(both, lambda x: F.when(x["n"] == 1, x["l"]).when((x["n"] == 2) & (F.size(x["l"]) + F.size(x["r"]) < 8), F.concat(x["l"], F.array_repeat(F.lit("0"), 8 - F.size(x["l"]) - F.size(x["r"])), x["r"])))

    every = _let(F.split(F.lower(F.when(text.contains("."), words).otherwise(text)), "::"), filled)
    return _let(every, lambda gs: F.when((F.size(gs) == 8) & F.forall(gs, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")))


def private_host(url: Column) -> Column:
    """Whether the host is an address of a network that isn't public (in any notation), a name of this machine or its surroundings, empty, or an address that is none."""
    host_of = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/:?#]*)", 1)), r"\.+$", "")
    nets = [ipaddress.ip_network(n) for n in NETWORKS]
    bound = lambda n: (n[0], n[-1])
    any_of = lambda tests: functools.reduce(lambda x, y: x | y, tests)
    in_v4 = lambda number: _let(number, lambda c: any_of([c.between(*map(int, bound(n))) for n in nets if n.version == 4]))

    def in_v6(six):
        mapped = F.when(F.startswith(six, F.lit(_MAPPED)), F.conv(F.substring(six, 25, 8), 16, 10).cast("long"))
        return F.coalesce(in_v4(mapped), any_of([six.between(*(f"{int(x):032x}" for x in bound(n))) for n in nets if n.version == 6]), F.lit(True))

    def closed(h):
        named = (h == "") | h.isin(*LOCAL_NAMES) | h.rlike(r"\.(?:local|localhost)$")
        return F.when(h.startswith("["), _let(_ipv6(F.regexp_extract(h, r"^\[(.*)\]$", 1)), in_v6)).otherwise(named | F.coalesce(in_v4(_ipv4(h)), F.lit(False)))

    return _let(host_of, closed)


def markdown_table(rows: Column) -> Column:
    """An array of rows (arrays of cells) as a table in markdown: the first is the head, short rows are filled up, bars are escaped."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda s: F.replace(F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")).otherwise("")


def canonical_json(fields: Column) -> Column:
    """A map of strings as JSON with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def numeric_change(c: Column) -> Column:
    """Whether a text speaks of amounts, percentages, ages or days."""
    return F.lower(ascii_digits(c)).rlike(r"(?:₹|rs\.?|inr)\s*[0-9]|[0-9][0-9,]*\s*(?:lakh|crore|लाख|करोड़)|[0-9]+(?:\.[0-9]+)?\s*(?:%|percent|प्रतिशत)|[0-9]+\s*(?:years?|वर्ष)|[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}|[0-9]+\s*(?:days?|दिन)")


# Words of benefits by type, in order of precedence; amounts that are years; signs of rupees; punctuation of transcripts.
BENEFITS = {
    "PENSION": "पेंशन|pension", "SCHOLARSHIP": "छात्रवृत्ति|scholarship|stipend", "SUBSIDY": "अनुदान|सब्सिडी|subsidy", "INSURANCE": "बीमा|insurance|coverage", "LOAN": "ऋण|loan", "REIMBURSEMENT": "पुनर्भरण|reimbursement",
    "CASH": r"वित्तीय\s*सहायता|नकद|cash|financial\s*assistance|grant", "IN_KIND": "राशन|किट|उपकरण|in-kind|material", "CONCESSION": "छूट|concession",
}
YEARS = (2024.0, 2025.0, 2026.0, 2027.0)
RUPEES = r"₹|\brs\b|rs\.|inr|rupee|रुपये|रुपए|रु\."
SECTIONS = {
    "EXCLUSIONS": r"\b(?:exclusions?|ineligible|disqualification)\b|अपात्र|बहिष्करण|अयोग्यता", "ELIGIBILITY": r"\b(?:eligibility|eligible|criteria)\b|पात्रता|योग्यता", "BENEFITS": r"\b(?:benefits?|assistance|grant|incentive|scholarship)\b|लाभ|अनुदान",
    "DOCUMENTS_REQUIRED": r"\b(?:documents?|checklist|attachments?)\b|दस्तावेज|संलग्नक", "APPLICATION_PROCESS": r"\b(?:application|how to apply|procedure|registration)\b|आवेदन|पंजीकरण", "DEFINITIONS": r"\b(?:definitions?|interpretation)\b|परिभाषा",
    "DATES": r"\b(?:timeline|schedule|dates?|deadline|validity)\b|समय सीमा|तिथि", "FINANCIAL_RULES": r"\b(?:funding|budget|ceiling|income limit)\b|आय सीमा|बजट", "CONTACTS": r"\b(?:contacts?|helpline|helpdesk)\b|संपर्क|हेल्पलाइन",
}


def benefit_type(c: Column) -> Column:
    out = F.lit("OTHER")
    for kind, pattern in reversed(BENEFITS.items()):
        out = F.when(F.lower(c).rlike(pattern), kind).otherwise(out)
    return out


def benefit_amount(number: Column) -> Column:
    """A parsed number, unless it is a year of the present."""
    return F.when(~number.isin(*YEARS), number)


def currency(c: Column) -> Column:
    return F.when(F.lower(c).rlike(RUPEES), "INR")


def section_heading(c: Column) -> Column:
    """The section that a heading opens, null if it is none: a short line, or a lead-in of at most 40 characters before a colon."""
    head = F.when(F.length(c) <= 80, c).otherwise(F.regexp_extract(c, "^([^:]{1,40}):", 1))
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(SECTIONS.items()):
        out = F.when(F.lower(head).rlike(pattern), kind).otherwise(out)
    return out


def transcript(c: Column) -> Column:
    """For comparison: ASCII digits, lower case, no punctuation (full stops of either script included), white space made one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(ascii_digits(c)), r"""[।॥.,!?;:"'()\[\]{}\-–—_/\\]""", " "), r"\s+", " "))
