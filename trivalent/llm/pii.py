"""Personal data in texts, also where it is disguised, with spans in the source.

Four detectors read the text as it is. Then a chain of transducers rewrites disguises:
look-alike characters (full-width forms, Cyrillic and Greek letters, other scripts' digits,
invisible characters), spelled digits, and "at" and "dot" in words or brackets. Each
rewriting knows which source characters every output character stands for, so what the
same detectors find in the normalised text is mapped back to the source. A finding is added
if it uses a rewritten character and isn't within a plain finding of its kind, which may be only its head or tail.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping. An address can only begin where the run of local characters before an @ does."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        end_local = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = end_local = m.end()
        else:
            end = max(end, at + 1)  # no address takes in this @
        at = text.find("@", end_local)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if len(m[0]) >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) in code points, by kind and start."""
    return [(k, s, e) for k, kind in enumerate(KINDS) for s, e in DETECTORS[kind](text)]


# The transducers' alphabets. All scripts' digits and all compatibility forms follow from Unicode's own tables; the look-alikes
# of other scripts are listed here, as Python has no table of them.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "․": ".", "·": ".", "∙": ".", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
}
_LOOKALIKES |= dict(zip(
    "ӏԍցոսօհյզԱՍՏՕԼΜΖӀԌᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏞᏟᏢᏦᏴⲟⲣⲥⲞⲢⲤⲘⲚⲦɑɡɩıʏʀᴀʙᴄᴅᴇɢʜᴊᴋʟᴍɴᴏᴘᴛᴜᴠᴡᴢꜱϲϳϹͿѵѴԚԜԁգ℮ғвмнткг",
    "lGgnuohjqUUSOLMZlGDRTAJEWMHGZSLCPKBopcOPCMNTagiiyrabcdeghjklmnoptuvwzscjCJvVQWdqefbmhtkr", strict=True))
_LOOKALIKES |= {"‚": ",", "﹣": "-", "⁃": "-", "﹘": "-", "⸱": ".", "۔": ".", "𝟎": "0", "ⅼ": "l"}
_INVISIBLE = "­​‌‍⁠﻿"
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
#: Last labels that make words a disguised address.
_ENDINGS = frozenset("com org net edu gov mil int info biz io co dev app eu uk us ca au in de fr es ch at nl pl ru jp cn br mx".split())
#: All countries' labels, the reserved ones and frequent others: where the words can't be prose.
_MORE_ENDINGS = _ENDINGS | frozenset(
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr "
    "ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz "
    "na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw "
    "aero arpa asia cat coop jobs mobi museum name post pro tel travel xxx example test invalid localhost local onion academy agency art bank berlin blog cafe cloud club codes company consulting design digital email events expert family finance fun global group guru hamburg "
    "health help host house icu koeln law life link live london love ltd media money network news ninja nyc one online page paris party photo photos plus press program radio review rocks school science services shop site social software solutions space store studio support swiss team tech tips today tools "
    "top tours town training vip video wales web website wien wiki win work world wtf xyz zone".split()
)
_AT, _DOT, _PLUS = "at|arroba|chez|klammeraffe", "dot|punkt|punto|point", "plus|más"


def _folds() -> dict[str, str]:
    """What each character outside ASCII stands for: a digit, what its compatibility form is if that is ASCII, or what it looks like."""
    import unicodedata

    out = {}
    for first, last in ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000)):  # no other has a fold
        for c in map(chr, range(first, last)):
            digit = unicodedata.digit(c, None)
            new = unicodedata.normalize("NFKC", c) if digit is None else str(digit)
            if new.isascii() and (len(new) == 1 or new.isalnum()):
                out[c] = new
    return out | _LOOKALIKES | dict.fromkeys(_INVISIBLE, "")


_FOLDS = _folds()
#: Beyond the first plane whole ranges, as the engine tries these one by one; not all in them have a fold.
_SOFT = re.compile("[" + "".join(re.escape(c) for c in _FOLDS if c < "\U00010000") + "\U00010000-\U0001f2ff\U0001fbf0-\U0001fbf9]")
_BRACKETED = re.compile(rf"[\[({{<]\s*(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.))\s*[\])}}>]\s*", re.I)
#: Bare words count only in the whole form name at host dot end.
_SEPARATOR = rf"(?:\s+(?:{_DOT})\s+|\s*\.\s*)"
_BARE = re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<name>[A-Za-z0-9._%+-]+)(?P<at>\s+(?:{_AT})\s+|\s*@\s*)(?P<host>[A-Za-z0-9-]+(?:{_SEPARATOR}[A-Za-z0-9-]+)+)", re.I)
_BARE_DOT = re.compile(_SEPARATOR, re.I)
#: name_at_host_dot_end, with one joining character throughout.
_JOINED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9.%+]+(?:[_-][A-Za-z0-9.%+]+)*?(?P<at>(?P<join>[_-])at(?P=join))(?P<host>[A-Za-z0-9]+(?:(?P=join)dot(?P=join)[A-Za-z0-9]+)+)", re.I)
_JOINED_DOT = re.compile(r"[_-]dot[_-]", re.I)
_NUMBER_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_TOKEN = rf"(?:(?:{_NUMBER_WORD})(?![^\W_])|[0-9]+)"
_SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:(?:{_PLUS})\s+)?{_TOKEN}(?:(?:\s*[-.,()]\s*|\s+(?:(?:{_DOT})\s+)?){_TOKEN}){{3,}}", re.I)
_SPELLED_PART = re.compile(rf"(?P<plus>(?:{_PLUS})\s+)|(?P<dot>\s+(?:{_DOT})\s+)|(?P<digits>[0-9]+)|(?P<word>{_NUMBER_WORD})|(?P<gap>\s*[-.,()]\s*|\s+)", re.I)
_TRIGGER_ASCII = re.compile(rf"[\[({{<]\s*(?:{_AT}|{_DOT}|@|\.)\s*[\])}}>]|\s(?:{_DOT}|@)\s|[_-]dot[_-]", re.I)


class Tape:
    """A text in rewriting: its characters, and for each the source span that it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [(i, i + 1, False) for i in range(len(text))]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches, in order; each output character stands for all of its stretch."""
        if not edits:
            return
        out, spans, at = [], [], 0
        for start, end, new in edits:
            out.append(self.text[at:start] + new)
            spans += self.spans[at:start] + [(self.spans[start][0], self.spans[end - 1][1], True)] * len(new)
            at = end
        self.text = "".join(out) + self.text[at:]
        self.spans = spans + self.spans[at:]


def lookalikes(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), _FOLDS[m[0]]) for m in _SOFT.finditer(tape.text) if m[0] in _FOLDS])


def brackets(tape: Tape) -> None:
    edits, end = [], 0
    for m in _BRACKETED.finditer(tape.text):
        start = m.start()  # white space before is taken in by hand: a pattern that begins with it takes quadratic time on blanks
        while start > end and tape.text[start - 1].isspace():
            start -= 1
        end = m.end()
        edits.append((start, end, "@" if m["at"] else "."))
    tape.rewrite(edits)


def joined_words(tape: Tape) -> None:
    """name_at_host_dot_end, if the end is a top-level domain."""
    edits = []
    for m in _JOINED.finditer(tape.text):
        if re.split(_JOINED_DOT, m["host"])[-1].lower() in _MORE_ENDINGS:
            edits.append((*m.span("at"), "@"))
            edits += [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in _JOINED_DOT.finditer(m["host"])]
    tape.rewrite(edits)


def _host_dots(at: str, host: str) -> list[tuple[int, int, str]]:
    """The separators (start, end, text) of the longest part of host that makes an address.

    Its last label is one of _ENDINGS, or of all if the words before it can't be prose: "at some point to" could."""
    dots = [(*d.span(), d[0]) for d in _BARE_DOT.finditer(host)]
    word = at.strip().lower()
    spelled, good = set(), 0
    for n, (_, end, dot) in enumerate(dots):
        if dot[0] == "." and dot != ".":  # a sentence ends here
            break
        label = host[end : dots[n + 1][0] if n + 1 < len(dots) else len(host)]
        if dot.strip() != ".":
            spelled.add(dot.strip().lower())
        if not (label.isalpha() and len(label) > 1) or not spelled and word.isalpha():
            continue
        sure = spelled and (word in ("@", "arroba", "klammeraffe") or spelled == {"dot"}) and (dot == "." or dot.strip() != ".")
        if label.lower() in (_MORE_ENDINGS if sure else _ENDINGS):
            good = n + 1
    return dots[:good]


def _local_dots(text: str, start: int, floor: int) -> list[tuple[int, int, str]]:
    """Spelled dots before the name that begins at start: john dot doe."""
    edits = []

    def back(at, inside):
        while at > floor and inside(text[at - 1]):
            at -= 1
        return at

    while True:
        word_end = back(start, str.isspace)
        word = back(word_end, str.isalpha)
        name_end = back(word, str.isspace)
        name = back(name_end, _LOCAL_CHARS.__contains__)
        if word_end == start or text[word:word_end].lower() not in _DOT.split("|") or name_end == word or name == name_end:
            return edits[::-1]
        edits.append((name_end, start, "."))
        start = name


def bare_words(tape: Tape) -> None:
    edits, at, floor = [], 0, 0
    while m := _BARE.search(tape.text, at):
        start, dots = m.start("host"), _host_dots(m["at"], m["host"])
        if dots:
            edits += _local_dots(tape.text, m.start(), floor)
            edits.append((*m.span("at"), "@"))
            edits += [(start + a, start + b, ".") for a, b, dot in dots if dot != "."]
            at = floor = start + dots[-1][1]
        else:
            at = m.end("at")  # the host may be a name
    tape.rewrite([e for e in edits if tape.text[e[0] : e[1]] != e[2]])


def spelled_digits(tape: Tape) -> None:
    edits = []
    for run in _SPELLED_RUN.finditer(tape.text):
        parts = list(_SPELLED_PART.finditer(tape.text, *run.span()))
        if not any(p["word"] for p in parts):
            continue
        for n, p in enumerate(parts):
            if p["plus"]:
                new = "+"
            elif p["dot"]:
                new = "."
            elif p["word"]:
                new = _SPELLED[p["word"].lower()]
            elif p["gap"] and not p["gap"].strip() and any(x["word"] for x in parts[n - 1 : n + 2]):
                new = ""
            else:
                continue
            edits.append((p.start(), p.end(), new))
    tape.rewrite(edits)


TRANSDUCERS = (lookalikes, brackets, joined_words, bare_words, spelled_digits)


def _disguised_parts(text: str) -> list[tuple[int, int]]:
    """Stretches around what may be a disguise: text without any is not rewritten at all."""
    found = [m.start() for m in _SOFT.finditer(text) if m[0] in _FOLDS] if not text.isascii() else []
    found += [m.start() for m in _TRIGGER_ASCII.finditer(text)]
    found += [m.start() for m in _SPELLED_RUN.finditer(text)] if _SPELLED_HINT.search(text) else []
    return found


_SPELLED_HINT = re.compile(rf"(?<![^\W_])(?:{_NUMBER_WORD})[\s.,()-]+(?:(?:{_DOT})\s+)?{_TOKEN}", re.I)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain findings, and all findings; both by kind and start."""
    base = base_spans(text)
    if not _disguised_parts(text):
        return base, base
    tape = Tape(text)
    for t in TRANSDUCERS:
        t(tape)
    more = list(base)
    for kind, start, end in base_spans(tape.text):
        own = tape.spans[start:end]
        if any(x[2] for x in own) or any(x[1] < y[0] for x, y in zip(own, own[1:])):  # rewritten, or with characters taken out
            s, e = min(x[0] for x in own), max(x[1] for x in own)
            if not any(k == kind and a <= s and e <= b for k, a, b in base):
                more.append((kind, s, e))
    return base, sorted(more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, counts of plain findings by kind, plain and all findings as kind:start:end.

    Offsets count code points, the end is exclusive. Null texts count as empty; empty texts have no findings; texts of any
    length are read whole; repeated rows are each reported."""
    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_disguised long"

    def make():
        def each(doc_id, text):
            found = [all_spans(t) for t in text]
            counts = [[sum(x[0] == k for x in base) for base, _ in found] for k in range(len(KINDS))]
            return [doc_id, *counts, [_joined(b) for b, _ in found], [_joined(a) for _, a in found], [len(a) - len(b) for b, a in found]]

        return each

    return map_columns(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), make, ddl)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every finding, plain or disguised, replaced by its kind in brackets; the other columns stay as they are.

    A null text stays null. Findings that overlap are replaced as one, by the kind that begins first. Repeated rows
    are each redacted; an empty table gives an empty one; columns may have any names."""
    at = docs.columns.index(text)

    def cover(t: str | None) -> str | None:
        out, end = [], 0
        for s, e, k in sorted((s, e, k) for k, s, e in all_spans(t)[1]) if t else ():
            if s >= end:
                out.append(f"{t[end:s]}[{KINDS[k]}]")
            end = max(end, e)
        return t if not out else "".join(out) + t[end:]

    def make():
        return lambda *cols: [[cover(t) for t in c] if i == at else c for i, c in enumerate(cols)]

    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # a name may be one that Spark would parse
    return map_columns(numbered, make, numbered.schema).toDF(*docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data; the counts and base_sha256 are of the plain findings, spans has all."""
    found = find(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_disguised")

