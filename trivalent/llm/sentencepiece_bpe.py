"""SentencePiece encoding and decoding with a merge-type prefix table.

A BPE encoding is valid exactly when each pair of neighbouring pieces is the encoding of
its own concatenation. So every prefix of a text has one last piece: the longest piece that
ends there, found by an Aho-Corasick automaton, and that is compatible with the last piece
of the prefix before it. The table of last pieces is filled from left to right and the ids
are read off backwards. Time is linear in the text for a vocabulary of bounded piece length.

Merges never cross some boundaries (before white space, after a letter that no piece
continues with the next character); they are found in the vocabulary when it is loaded, and
the table is built between them, so that the results for repeated stretches are remembered.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

from pyspark.sql import DataFrame, SparkSession

from .common import map_columns, table, text_bytes

SPACE = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: At most so many remembered words, stretches and pairs each a task, and the longest that is remembered.
REMEMBERED, LONGEST = 600_000, 48


#: Texts on which models of another kind (unigram, normalising, without a dummy prefix or byte fallback) differ from what is built here.
PROBES = ("", " ", "  two  spaces ", "Ｆｕｌｌ ﬁ ① ½", "e\u0301 é Å", "tab\tand\nline\r", "internationalization of misunderstandings", "Donaudampfschifffahrtsgesellschaft", "aaaaaaaaaaaaa", "語ア😀\u200b", "3.14159, 2026-01-01")


class PrefixTableEncoder:
    """Encoder and decoder for a BPE model with byte fallback, identity normalisation and a dummy prefix; another model is refused."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_ids, self.byte_of, self.ids, self.score = {}, {}, {}, {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p], self.score[p] = i, sp.get_score(i)
        self.special = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.alone: dict[str, bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.known = frozenset(p for p in self.ids if len(p) == 1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.seen: dict[str, tuple[int, str, str]] = {}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.id_lists: dict[str, list[int]] = {}
        self.unit = self._units()
        if any(self.encode(t) != sp.encode(t) or self.decode(sp.encode(t)) != sp.decode(sp.encode(t)) for t in PROBES):
            raise ValueError("the model is not BPE with byte fallback, identity normalisation and a dummy prefix")

    def _units(self) -> re.Pattern:
        inside = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        self.parts_words = not any(b == SPACE and a != SPACE for a, b in inside)
        if not self.parts_words:
            return re.compile(r"(?s).+")
        letter = re.compile(f"[{LETTERS}]")
        candidates = [chr(c) for c in range(1, 127) if not letter.match(chr(c))]
        joined = {b for a, b in inside if letter.match(a)}
        ends = "".join(map(re.escape, (c for c in candidates if c not in joined)))
        line = "" if "\n" in self.ids or any("\n" in p for p in self.ids) else "\n"
        rest, more = f"[^{LETTERS}{SPACE}{line}]", f"[^{LETTERS}{SPACE}{line}{ends}]"
        words = f"{SPACE}*{rest}*[{LETTERS}]+(?:{more}{rest}*[{LETTERS}]*)*|{SPACE}*{rest}+|{SPACE}+"
        return re.compile((r"\n+|" if line else "") + words)

    def _merge(self, text: str, whole: str | None = None) -> list[str]:
        """The merges themselves, in the model's order: used on single pieces only, once each. Ends before it makes whole."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None or len(parts) == 2 and whole == text:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stands(self, piece: str) -> bool:
        ok = self.alone.get(piece)
        if ok is None:
            ok = self.alone[piece] = self._merge(piece) == [piece]
        return ok

    def _split(self, piece: str) -> tuple[str, str]:
        """The two pieces of the last merge that makes this one."""
        halves = self.halves.get(piece)
        if halves is None:
            halves = self.halves[piece] = tuple(self._merge(piece, whole=piece))
        return halves

    def _compatible(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border: the pieces at it are taken apart, the later merge first, and no pair
        that meets there may merge before the merges that hid it. Among equals, the merge on the left comes first."""
        ok = self.pairs.get((left, right))
        if ok is None:
            a, b, score, limit = left, right, self.score, None
            while True:
                s = score.get(a + b)
                if s is not None and (limit is None or s > limit[0] or s == limit[0] and limit[1]):
                    ok = False
                    break
                sa, sb = score[a] if len(a) > 1 else None, score[b] if len(b) > 1 else None
                if sa is None and sb is None:
                    ok = True
                    break
                if sb is None or sa is not None and sa < sb:
                    a, limit = self._split(a)[1], (sa, False)
                else:
                    b, limit = self._split(b)[0], (sb, True)
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            self.pairs[left, right] = ok
        return ok

    def table(self, text: str) -> list[str | None]:
        """The last piece of each prefix of text, whose characters all are pieces."""
        last: list[str | None] = [None] * (len(text) + 1)
        for end, piece in self.automaton.iter(text):  # at each end, the longest match first
            end += 1
            if last[end] is None:
                start = end - len(piece)
                if self._stands(piece) if start == 0 else last[start] is not None and self._compatible(last[start], piece):
                    last[end] = piece
        return last

    def _known(self, text: str) -> list[int]:
        last, at, out = self.table(text), len(text), []
        while at:
            piece = last[at]
            out.append(self.ids[piece])
            at -= len(piece)
        return out[::-1]

    def encode_unit(self, text: str) -> list[int]:
        """The ids of a stretch that no merge leaves; characters outside the vocabulary become bytes."""
        if self.known.issuperset(text):
            return self._known(text)
        out, start = [], 0
        for i, c in enumerate(text):
            if c not in self.known:
                if start < i:
                    out += self._known(text[start:i])
                out += [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
                start = i + 1
        return out + self._known(text[start:]) if start < len(text) else out

    def normalise(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _fresh_ids(self, word: str) -> list[int]:
        ids = [i for u in self.unit.findall(SPACE + word) for i in self.encode_unit(u)]
        if len(word) <= LONGEST:
            if len(self.id_lists) >= REMEMBERED:
                self.id_lists.clear()
            self.id_lists[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if self._words_alone(text):
            get, fresh = self.id_lists.get, self._fresh_ids
            return list(chain.from_iterable([get(w) or fresh(w) for w in text.split(" ")]))
        return [i for u in self.unit.findall(self.normalise(text)) for i in self.encode_unit(u)]

    def _words_alone(self, text: str) -> bool:
        """Whether single spaces alone part the words: then each word with the space before it stands alone."""
        return bool(text) and self.parts_words and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " "

    def pieces_text(self, ids: list[int]) -> str:
        """The ids' text with its dummy prefix: bytes are gathered and read as UTF-8, control ids are dropped."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.special:
                out.append(self.pieces[i].replace(SPACE, " "))
        return "".join(out) + held.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.pieces_text(ids).removeprefix(" ")

    def _fresh(self, unit: str) -> tuple[int, str, str]:
        ids = self.encode_unit(unit)
        made = len(ids), ",".join(map(str, ids)), self.pieces_text(ids)
        if len(unit) <= LONGEST:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[unit] = made
        return made

    def _units_digest(self, text: str) -> tuple[int, str, str]:
        get, fresh = self.seen.get, self._fresh
        counts, ids, texts = zip(*[get(u) or fresh(u) for u in self.unit.findall(text)])
        return sum(counts), ",".join(ids), "".join(texts)

    def _fresh_word(self, word: str) -> tuple[int, str, str]:
        made = self._units_digest(SPACE + word)
        if len(word) <= LONGEST and "\n" not in word:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[word] = made
        return made

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, their decimal form joined by commas, and the decoded text."""
        if not text:
            return 0, "", ""
        if self._words_alone(text):
            get, fresh = self.words.get, self._fresh_word
            counts, ids, texts = zip(*[get(w) or fresh(w) for w in text.split(" ")])
            return sum(counts), ",".join(ids), "".join(texts).removeprefix(" ")
        n, ids, decoded = self._units_digest(self.normalise(text))
        return n, ids, decoded.removeprefix(" ")


def load_model(spark: SparkSession, path: str):
    """The model file's bytes, sent to the executors once (half a megabyte for 32,000 pieces)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """docs with a column of piece ids and, if named, the text decoded from them.

    Null and empty texts have no ids and decode to the empty text; texts of any length are encoded whole; rows
    repeat as they are; the other columns stay, and a column named like an output is replaced.
    """
    model = load_model(docs.sparkSession, model_path)

    made = [ids] + ([decoded] if decoded else [])
    rest = [c for c in docs.columns if c not in made]
    fields = {f.name: f for f in docs.schema.fields}
    ddl = ", ".join([f"`{c}` {fields[c].dataType.simpleString()}" for c in rest] + [f"`{ids}` array<int>"] + ([f"`{decoded}` string"] if decoded else []))
    at = rest.index(text)

    def make():
        e = PrefixTableEncoder(model.value)

        def each(*cols):
            tokens = [e.encode(t or "") for t in cols[at]]
            return [*cols, tokens] + ([[e.decode(x) for x in tokens]] if decoded else [])

        return each

    return map_columns(docs.select(*(f"`{c}`" for c in rest)), make, ddl)


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts; null texts count as empty."""
    model = load_model(docs.sparkSession, model_path)

    def make():
        e = PrefixTableEncoder(model.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()

        def each(doc_id, text):
            made = [e.digest(t.decode("utf-8", "replace")) for t in text]
            return doc_id, [m[0] for m in made], [sha(m[1]) for m in made], [sha(m[2]) for m in made]

        return each

    return map_columns(docs.select("doc_id", text_bytes()), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Token counts and digests of every document under the 32,000-piece vocabulary."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return token_digests(table(spark, sf_dir, "documents", "doc_id", "text"), model_path)
