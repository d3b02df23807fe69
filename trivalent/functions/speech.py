"""Scalar functions over spoken Hindi and English: fractions, scale words, places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import number
from .text import SCALES

# Cardinals by name, and words that add to a number or stand for one alone.
CARDINALS = {
    "एक": 1, "दो": 2, "तीन": 3, "चार": 4, "पांच": 5, "पाँच": 5, "छह": 6, "छः": 6, "सात": 7, "आठ": 8, "नौ": 9, "दस": 10, "बीस": 20, "पच्चीस": 25, "तीस": 30, "चालीस": 40, "पचास": 50, "साठ": 60, "सत्तर": 70, "अस्सी": 80, "नब्बे": 90,
    "ek": 1, "do": 2, "teen": 3, "char": 4, "paanch": 5, "chhah": 6, "saat": 7, "aath": 8, "nau": 9, "das": 10, "bees": 20, "pachas": 50, "saath": 60,
}
FRACTIONS = {"सवा": 0.25, "sawa": 0.25, "साढ़े": 0.5, "साढे": 0.5, "sadhe": 0.5, "पौने": -0.25, "paune": -0.25}
ALONE = {"डेढ़": 1.5, "डेढ": 1.5, "dedh": 1.5, "ढाई": 2.5, "dhai": 2.5, "adhai": 2.5}
_HUNDRED = {"सौ": 100, "sau": 100} | SCALES


def spoken_number(c: Column) -> Column:
    """The first number that is said, in digits or words (see numbers)."""
    return number(c)


def place(c: Column, names: dict[str, str]) -> Column:
    """The place that an utterance names: all of it, else the first pair of words, else the first word of more than two letters that is in names."""
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    t = F.trim(F.regexp_replace(F.lower(c), r"[,.!?।\s]+", " "))
    w = F.split(t, " ")
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: known[F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1))]))
    singles = F.transform(F.filter(w, lambda x: F.length(x) > 2), lambda x: known[x])
    return F.coalesce(known[t], F.get(F.array_compact(pairs), F.lit(0)), F.get(F.array_compact(singles), F.lit(0)))
