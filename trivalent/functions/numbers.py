"""Numbers as they are said in Hindi and English, read and spoken: a fold over words with descending scales, and its inverse."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_digits

# The cardinals from 0 to 99 as they are spoken, other spellings, and their Latin transliterations from 1.
HINDI = (
    "शून्य एक दो तीन चार पांच छह सात आठ नौ दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस बीस इक्कीस बाईस तेईस चौबीस पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस तीस इकतीस बत्तीस तैंतीस चौंतीस पैंतीस छत्तीस सैंतीस अड़तीस उनतालीस "
    "चालीस इकतालीस बयालीस तैंतालीस चवालीस पैंतालीस छियालीस सैंतालीस अड़तालीस उनचास पचास इक्यावन बावन तिरपन चौवन पचपन छप्पन सत्तावन अट्ठावन उनसठ साठ इकसठ बासठ तिरसठ चौंसठ पैंसठ छियासठ सरसठ अड़सठ उनहत्तर सत्तर इकहत्तर बहत्तर तिहत्तर "
    "चौहत्तर पचहत्तर छिहत्तर सतहत्तर अठहत्तर उन्यासी अस्सी इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी अट्ठासी नवासी नब्बे इक्यानवे बानवे तिरानवे चौरानवे पचानवे छियानवे सत्तानवे अट्ठानवे निन्यानवे"
).split()
SPELLINGS = {"जीरो": 0, "पाँच": 5, "छः": 6, "नवाँसी": 89, "बायनवे": 92, "chaar": 4, "paanch": 5, "che": 6, "chhe": 6, "pachees": 25, "paintalis": 45, "pachas": 50, "sath": 60, "iksath": 61, "basath": 62, "assi": 80}
LATIN = (
    "ek do teen char panch chhah saat aath nau das gyarah barah terah chaudah pandrah solah satrah atharah unnees bees ikkees baees teis chaubees pachchees chhabbees sattaees atthaees unatees tees ikatees battees taintees chauntees paintees "
    "chhattees saintees adatees unatalees chalees ikatalees bayalees taintalees chawalees paintalees chhiyalees saintalees adatalees unachaas pachaas ikyawan baawan tirpan chauwan pachpan chhappan sattawan atthawan unasath saath ikasath "
    "baasath tirasath chaunsath painsath chhiyaasath sarasath adasath unahattar sattar ikahattar bahattar tihattar chauhattar pachahattar chhihattar satahattar athahattar uniyasi assee ikyasi bayasi tirasi chaurasi pachasi chhiyasi "
    "sattasi atthasi nawasi nabbe ikyanwe baanwe tiranwe chauranwe pachanwe chhiyanwe sattanwe atthanwe ninyanwe"
).split()
UNITS = "one two three four five six seven eight nine".split()
TEENS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
HUNDREDS = ("सौ", "sau", "hundred")
SCALES = {
    1_000: ("हजार", "हज़ार", "hazar", "thousand", "thousands", "k"), 100_000: ("लाख", "lakh", "lakhs", "lac", "lacs"), 10_000_000: ("करोड़", "करोड", "crore", "crores", "cr"), 1_000_000_000: ("अरब", "arab"),
}
MORE = {0.25: ("सवा", "sawa"), 0.5: ("साढ़े", "साढे", "sadhe"), -0.25: ("पौने", "paune")}
ALONE = {1.5: ("डेढ़", "डेढ", "dedh", "deedh"), 2.5: ("ढाई", "dhai", "adhai")}
JOINERS = ("and", "और", "व")
BETWEEN = ("से", "to", "-", "–")
LESS = ("से कम", "less than", "below", "under")
MORE_THAN = ("से ज्यादा", "से अधिक", "more than", "above", "over")
ABOUT = ("लगभग", "करीब", "क़रीब", "तकरीबन", "आसपास", "आस-पास", "अंदाजन", "अनुमानित", "थोड़ा ऊपर", "थोड़ा कम", "approx", "around", "nearly", "about", "close to")


def _table() -> dict[str, tuple[str, float]]:
    """A word's kind and value: C cardinal, T tens and U units in English, A alone, H hundred, S scale, F fraction to add, J joiner."""
    out = {w: ("C", i) for i, w in enumerate(HINDI)} | {w: ("C", i) for i, w in enumerate(LATIN, 1)} | {w: ("C", i) for w, i in SPELLINGS.items()}
    out |= {w: ("U", i) for i, w in enumerate(UNITS, 1)} | {w: ("C", i) for i, w in enumerate(TEENS, 10)} | {w: ("T", 10 * i) for i, w in enumerate(TENS, 2)} | {"zero": ("C", 0)}
    for kind, words in (("S", SCALES), ("F", MORE), ("A", ALONE)):
        out |= {w: (kind, v) for v, ws in words.items() for w in ws}
    return out | {w: ("H", 100) for w in HUNDREDS} | {w: ("J", 0) for w in JOINERS}


WORDS = _table()
_NUMBER = "struct<value:double,scale:double,at:int,to:int>"
_STATE = f"struct<done:array<{_NUMBER}>,total:double,now:double,last:double,more:double,kind:string,at:int,to:int>"


def tokens(c: Column) -> Column:
    """Numbers in digits (with their commas), words, and other signs one by one; in lower case, signs of rupees left out."""
    t = F.regexp_replace(F.lower(ascii_digits(c)), r"₹|\brs\b\.?", " ")
    return F.regexp_extract_all(t, F.lit(r"([0-9](?:[0-9,]*[0-9])?(?:\.[0-9]+)?|[\p{L}\p{M}]+|[^\s\p{L}\p{M}0-9])"), F.lit(1))


def numbers(c: Column) -> Column:
    """All numbers of a text in order: value, scale (its first scale word's, null without one), at and to (its words' places).

    A number is read word by word: units, hundreds, then scales that fall; a scale that doesn't begins another number, unless it follows a scale
    at once (two thousand crore). A fraction adds to the number after it, or to one."""
    table = json.dumps({w: {"kind": k, "value": v} for w, (k, v) in WORDS.items()}, ensure_ascii=False)
    pair = F.from_json(F.lit(table), "map<string,struct<kind:string,value:double>>")  # one literal, folded once
    none = F.lit(None).cast("double")

    def typed(t):
        digits = F.regexp_replace(t, ",", "").try_cast("double")
        return F.coalesce(pair[t], F.when(digits.isNotNull(), F.struct(F.lit("C").alias("kind"), digits.alias("value"))), F.struct(F.lit("X").alias("kind"), none.alias("value")))

    def state(done, total, now, last, more, kind, at, to):
        return F.struct(done.alias("done"), total.alias("total"), now.alias("now"), last.alias("last"), more.alias("more"), kind.alias("kind"), at.alias("at"), to.alias("to")).cast(_STATE)

    def closed(s):
        value = s["total"] + F.coalesce(s["now"], F.when(s["more"].isNotNull(), 1 + s["more"]), F.lit(0.0))
        number = F.struct(value.alias("value"), s["last"].alias("scale"), s["at"].alias("at"), s["to"].alias("to")).cast(_NUMBER)
        return F.when(s["at"].isNotNull(), F.concat(s["done"], F.array(number))).otherwise(s["done"])

    def fresh(s):
        return state(closed(s), F.lit(0.0), none, none, none, F.lit("X"), F.lit(None).cast("int"), F.lit(None).cast("int"))

    def step(s, x):
        t, i = x["t"], x["i"].cast("int")
        kind, v = t["kind"], t["value"]
        is_open = s["at"].isNotNull()
        start = F.coalesce(s["at"], i)
        value = v + F.coalesce(s["more"], F.lit(0.0))
        same = lambda total, now, last, more, to=i: state(s["done"], total, now, last, more, kind, start, to)
        another = lambda now, more: state(closed(s), F.lit(0.0), now, none, more, kind, i, i)
        adds = (kind == "U") & (s["kind"] == "T") | kind.isin("C", "T", "U") & (s["kind"] == "H") & (v < 100) | kind.isin("C", "T", "U") & (s["kind"] == "J") & s["now"].isNotNull() & (v < 100) & (s["now"] % 100 == 0)
        says = F.when(~is_open | s["now"].isNull(), same(s["total"], value, s["last"], none)).when(adds, same(s["total"], s["now"] + v, s["last"], none)).otherwise(another(v, none))
        count = F.coalesce(s["now"], F.when(s["more"].isNotNull(), 1 + s["more"]))
        hundred = F.when(~is_open | count.isNull(), same(s["total"], F.lit(100.0), s["last"], none)).when(count < 100, same(s["total"], count * 100, s["last"], none)).otherwise(another(F.lit(100.0), none))
        falls = s["last"].isNull() | (v < s["last"])
        at_once = s["now"].isNull() & s["last"].isNotNull() & (s["kind"] == "S") & (v > s["last"])
        turned = state(F.concat(s["done"], F.array(F.struct(s["total"].alias("value"), s["last"].alias("scale"), s["at"].alias("at"), (s["to"] - 1).alias("to")).cast(_NUMBER))), count * v, none, v, none, F.lit("S"), s["to"], i)
        scale = (
            F.when(is_open & count.isNotNull() & falls, same(s["total"] + count * v, none, F.coalesce(s["last"], v), none)).when(is_open & count.isNotNull(), turned)
            .when(is_open & at_once, same(s["total"] * v, none, v, none)).otherwise(fresh(s))
        )
        fraction = F.when(is_open & s["now"].isNull() & s["more"].isNull(), same(s["total"], none, s["last"], v)).otherwise(another(none, v))
        joined = F.when(is_open & s["kind"].isin("S", "H"), same(s["total"], s["now"], s["last"], s["more"], s["to"])).otherwise(fresh(s))
        return F.when(kind.isin("C", "T", "U", "A"), says).when(kind == "H", hundred).when(kind == "S", scale).when(kind == "F", fraction).when(kind == "J", joined).otherwise(fresh(s))

    words = F.transform(tokens(c), lambda t, i: F.struct(typed(t).alias("t"), i.alias("i")))
    first = state(F.array().cast(f"array<{_NUMBER}>"), F.lit(0.0), none, none, none, F.lit("X"), F.lit(None).cast("int"), F.lit(None).cast("int"))
    return F.aggregate(words, first, step, closed)


def number(c: Column, found: Column | None = None) -> Column:
    """The first number of a text. found is what numbers gave for it, if that is there already; so below."""
    return F.get(numbers(c) if found is None else found, F.lit(0))["value"]


def number_range(c: Column, found: Column | None = None) -> Column:
    """low, high of the first two numbers that stand on both sides of a word for `to` (or a dash, or of `and` after `between`), null if there are none or they fall.

    A scale that only the second has is the first's too."""
    found = numbers(c) if found is None else found
    pairs = F.transform(F.sequence(F.lit(0), F.size(found) - 2), lambda i: F.struct(F.get(found, i).alias("a"), F.get(found, i + 1).alias("b")))

    def beside(words):
        middle = lambda p: F.get(words, p["b"]["at"] - 1)
        both = lambda p: middle(p).isin(*JOINERS) & (F.get(words, p["a"]["at"] - 1) == "between")
        return F.filter(pairs, lambda p: (p["b"]["at"] - p["a"]["to"] <= 2) & (middle(p).isin(*BETWEEN) | F.coalesce(both(p), F.lit(False))))

    # an array of one, so that a text's words are taken once, not for each pair of numbers, and only of texts with two numbers
    side = F.get(F.when(F.size(found) > 1, F.transform(F.array(tokens(c)), beside)), F.lit(0))

    def ends(p):
        low = p["a"]["value"] * F.when(p["a"]["scale"].isNull(), F.coalesce(p["b"]["scale"], F.lit(1.0))).otherwise(1.0)
        return F.when(low <= p["b"]["value"], F.struct(low.alias("low"), p["b"]["value"].alias("high")))

    return F.get(F.transform(F.slice(side, 1, 1), ends), F.lit(0))


def _says(c: Column, phrases: tuple[str, ...]) -> Column:
    return F.lower(c).rlike("|".join(p.replace(" ", r"\s*") for p in phrases))


def bounds(c: Column, found: Column | None = None) -> Column:
    """least, most of a text that says `less than` or `more than`; both null if it says neither."""
    less, more = _says(c, LESS), _says(c, MORE_THAN)
    return F.struct(F.when(~less & more, number(c, found)).alias("least"), F.when(less, number(c, found)).alias("most"))


def about(c: Column) -> Column:
    """Whether a text says that its number is not exact."""
    return F.coalesce(_says(c, ABOUT), F.lit(False))


def hindi_words(n: Column) -> Column:
    """A whole number of up to fourteen digits in Hindi words, by crores, lakhs, thousands and hundreds."""
    names = F.split(F.lit(" ".join(HINDI)), " ")  # one literal

    def said(n: Column, deep: int) -> Column:
        small = lambda x: F.get(names, x.cast("int"))
        part = lambda x, words, unit: F.when(x > 0, F.concat(words, F.lit(" " + unit)))
        crores = (n / 10_000_000).cast("long")
        lakhs, thousands, hundreds, rest = ((F.floor(n / d) % m).cast("long") for d, m in ((100_000, 100), (1_000, 100), (100, 10), (1, 100)))
        large = [part(crores, said(crores, deep - 1), "करोड़")] if deep else []
        words = F.concat_ws(" ", *large, part(lakhs, small(lakhs), "लाख"), part(thousands, small(thousands), "हजार"), part(hundreds, small(hundreds), "सौ"), F.when(rest > 0, small(rest)))
        return F.when(n == 0, HINDI[0]).when(n == 100, "सौ").otherwise(words)

    n = n.cast("long")
    return F.when(n < 0, F.concat(F.lit("माइनस "), said(-n, 1))).otherwise(said(n, 1))
