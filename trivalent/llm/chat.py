"""Conversations as token sequences with a loss mask.

A turn is written as `### role: text</turn>` and a line break. Its three marks are reserved ids behind the vocabulary's own; role and text
are encoded on their own, as ordinary text, so that nothing in them becomes a mark and no token reaches over a border. In the text form a
backslash stands before each backslash, each < of </turn> and each # that begins ### within role or text, so that the first unescaped
mark ends a turn and unescaping gives back what was there.

Rows are dealt to partitions by ranges of conversation and turn and formatted there in order: a task joins its segments' ids to pieces,
and the mask is the running sum of +1 where a segment under the loss begins and -1 where it ends. A piece has at most `turns` turns and,
but for a single longer one, `chars` characters; a conversation is one piece or more, also where it lies in several partitions, and
pieces are in order by (part, piece). So no conversation, however long, is held by a task."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, schema_of, table
from ..operators.ranges import in_ranges

OPEN, SAYS, CLOSE = MARKS = ("### ", ": ", "</turn>\n")
TRAINED = ("assistant",)
#: Turns and characters of a piece.
TURNS, CHARS = 256, 1 << 20
_PIECE = "conv_id long, part int, piece long, alone boolean, n_turns long, token_ids array<int>, loss_mask array<boolean>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("alone", pa.bool_()), ("n_turns", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_()))])
_CONTROL = r"\\|#(?=##)|<(?=/turn>)"


def escape(text: str) -> str:
    return re.sub(_CONTROL, r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escaped(text: str) -> Column:
    """escape() as a Column; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _CONTROL, r"\\$0")


class Codec:
    """A byte-level vocabulary, given as a file of ranks, and three reserved ids behind it."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.marks = tuple(max(table.values()) + 1 + i for i in range(len(MARKS)))

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def segments(self, ids) -> list[tuple[int, int, str]]:
        """(start, end, text) of what lies between marks, decoded; each mark is a segment of its own, with its text form."""
        ids = np.asarray(ids, np.int64)
        out, at = [], 0
        for i in [*np.flatnonzero(ids >= self.marks[0]).tolist(), len(ids)]:
            if at < i:
                out.append((at, i, self.encoding.decode_bytes(ids[at:i].tolist()).decode()))
            if i < len(ids):
                out.append((i, i + 1, MARKS[ids[i] - self.marks[0]]))
            at = i + 1
        return out

    def text(self, ids) -> str:
        """The text form of ids, marks included; ids may not end within a character."""
        return "".join(t for _, _, t in self.segments(ids))

    def turns(self, ids) -> list[tuple[str, str]]:
        """(role, text) of each turn, unescaped; ids that aren't whole turns are refused."""
        return [(unescape(role), unescape(text)) for role, text in self._whole(np.asarray(ids, np.int64), self.segments(ids))]

    def _whole(self, ids: np.ndarray, segments: list[tuple[int, int, str]]) -> list[tuple[str, str]]:
        at = np.flatnonzero(ids >= self.marks[0])
        if not np.array_equal(ids[at], np.tile(self.marks, len(at) // 3)) or len(at) and (at[0] or at[-1] + 1 != len(ids) or np.any(at[3::3] != at[2:-1:3] + 1)):
            raise ValueError("not whole turns")
        said = {start: t for start, _, t in segments}
        marks = set(at.tolist())
        part = lambda i: "" if i + 1 in marks else said[i + 1]
        return [(part(a), part(b)) for a, b, _ in at.reshape(-1, 3).tolist()]

    def read(self, ids, mask) -> tuple[list[tuple[str, str]], str, int]:
        """The turns, all text under the mask (both unescaped), and the length of the text form."""
        ids, segments = np.asarray(ids, np.int64), self.segments(ids)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(mask, np.int8), [0]])))
        known = {(start, end): t for start, end, t in segments}
        runs = [(a, b) for a, b in edges.reshape(-1, 2).tolist()]
        loss = "".join(known[r] if r in known else self.text(ids[slice(*r)]) for r in runs)
        return [(unescape(r), unescape(t)) for r, t in self._whole(ids, segments)], unescape(loss), sum(len(t) for _, _, t in segments)


def loss_mask(lengths: list[int], trained: list[bool]) -> np.ndarray:
    """Which tokens are under the loss, for segments of these lengths."""
    lengths, on = np.asarray(lengths, np.int64), np.asarray(trained, bool)
    ends = np.cumsum(lengths)
    steps = np.zeros(int(lengths.sum()) + 1, np.int64)
    np.add.at(steps, ends[on] - lengths[on], 1)
    np.add.at(steps, ends[on], -1)
    return np.cumsum(steps[:-1]) > 0


def format_conversations(rows: DataFrame, codec, trained: tuple[str, ...] = TRAINED, turns: int = TURNS, chars: int = CHARS, parts: int | None = None) -> DataFrame:
    """conv_id, part, piece, n_turns, token_ids, loss_mask for rows (conv_id, turn, role, text). codec() makes a Codec in the task.

    A null role or text is empty; rows without conv_id are one conversation, and come first, as null turns do in theirs. Equal turns are
    ordered by role and text; repeated rows are each a turn. Texts may be empty or of any length; an empty table gives no piece. Extra
    columns are left out. Only the texts of roles in trained are under the loss, marks and roles never are."""
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = in_ranges(own, [F.col(c) for c in ("conv_id", "turn", "role", "text")], parts).select("part", "conv_id", "role", "text")

    def run(batches):
        use = codec()
        opens, says, closes = ([m] for m in use.marks)
        marks = {}
        ids, lengths, on, size, n, number, now = [], [], [], 0, 0, 0, None
        begun = 0  # conversations of this partition so far
        first = True  # whether the piece is its conversation's first here

        def piece(last):
            """The piece; it is alone if it is all of its conversation, which must begin after another one's and end before another one's in this partition."""
            alone = first and last and begun > 1
            columns = [[now[1]], [now[0]], [number], [alone], [n], [np.fromiter(itertools.chain.from_iterable(ids), np.int32, sum(lengths))], [loss_mask(lengths, on)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW)

        for batch in batches:
            for part, conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if n and (now != (part, conv_id) or n >= turns or size + len(text) > chars):
                    yield piece(now != (part, conv_id) and now[0] == part)
                    first = now != (part, conv_id)
                    number += 1
                    ids, lengths, on, size, n = [], [], [], 0, 0
                if now != (part, conv_id):
                    begun = begun + 1 if now and now[0] == part else 1
                now = part, conv_id
                if role not in marks and len(marks) < 1000:
                    marks[role] = use.encode(escape(role))
                name = marks[role] if role in marks else use.encode(escape(role))
                segments = [opens, name, says, use.encode(escape(text)), closes]
                ids += segments
                lengths += map(len, segments)
                on += [False, False, False, role in trained, False]
                size, n = size + len(text), n + 1
        if n:
            yield piece(False)

    return ordered.mapInArrow(run, schema_of(_PIECE))


def texts(pieces: DataFrame, codec) -> DataFrame:
    """conv_id, part, piece, formatted: the text form of each piece."""

    def make():
        use = codec()
        return lambda conv_id, part, piece, ids: (conv_id, part, piece, [use.text(i) for i in ids])

    return map_columns(pieces.select("conv_id", "part", "piece", "token_ids"), make, "conv_id long, part int, piece long, formatted string")


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(c.split(" ")[0], _TYPES[c.split(" ")[1]]) for c in ddl.split(", ")])


def _said(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{role}\n{text}\n" for role, text in turns)


def _pieces(batches, use: Codec):
    """For pieces as from format_conversations: conv_id, part, piece, alone, and what read() tells of ids and mask."""
    for batch in batches:
        head = [c.to_pylist() for c in batch.columns[:4]]
        ids, mask = batch.column(4), batch.column(5)
        flat, on = ids.flatten().to_numpy(), mask.flatten().to_numpy(zero_copy_only=False)
        starts, places = ids.offsets.to_numpy() - ids.offsets[0].as_py(), mask.offsets.to_numpy() - mask.offsets[0].as_py()
        for n, row in enumerate(zip(*head)):
            yield *row, *use.read(flat[starts[n] : starts[n + 1]], on[places[n] : places[n + 1]])


def _in_batches(rows, arrow: pa.Schema, most: int = 200):
    rows = iter(rows)
    while part := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), arrow)], schema=arrow)


_COLUMNS = ("conv_id", "part", "piece", "alone", "token_ids", "loss_mask")


def read_back(pieces: DataFrame, codec) -> DataFrame:
    """conv_id, part, piece, n_turns, turns, loss, formatted_chars: what a piece's ids and mask say.

    turns is role, line break, text, line break of each turn; loss is the text under the mask. Both are unescaped."""
    ddl = "conv_id long, part int, piece long, n_turns long, turns string, loss string, formatted_chars long"

    def run(batches):
        rows = ((c, p, k, len(turns), _said(turns), loss, size) for c, p, k, _, turns, loss, size in _pieces(batches, codec()))
        yield from _in_batches(rows, _arrow(ddl), 16)

    return pieces.select(*_COLUMNS).mapInArrow(run, schema_of(ddl))


def digests(pieces: DataFrame, codec) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the ids and masks of pieces.

    A piece that is its whole conversation is hashed where it is. The others' texts are brought together: a hash is a chain over a
    conversation in order, so that it is one task's; but the task reads it a piece at a time, and holds no more."""
    ddl = "conv_id long, part int, piece long, n_turns long, loss_chars long, formatted_chars long, turns string, loss string, turns_sha256 string, loss_sha256 string"

    def read(batches):
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        rows = (
            (c, p, k, len(turns), len(loss), size, *((None, None, sha(_said(turns)), sha(loss)) if alone else (_said(turns), loss, None, None)))
            for c, p, k, alone, turns, loss, size in _pieces(batches, codec())
        )
        yield from _in_batches(rows, _arrow(ddl), 16)

    def hashed(batches):
        now, held = None, None
        for batch in batches:
            for conv_id, n, chars, size, turns, loss, turns_sha, loss_sha in zip(*(c.to_pylist() for c in batch.columns)):
                if turns is None:
                    yield conv_id, n, turns_sha, chars, loss_sha, size
                    continue
                if now != (conv_id,):
                    if now:
                        yield now[0], held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]
                    now, held = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[0] += n
                held[1].update(turns.encode())
                held[2] += chars
                held[3].update(loss.encode())
                held[4] += size
        if now:
            yield now[0], held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]

    said = pieces.select(*_COLUMNS).mapInArrow(read, schema_of(ddl))
    dealt = said.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").select("conv_id", "n_turns", "loss_chars", "formatted_chars", "turns", "loss", "turns_sha256", "loss_sha256")
    return dealt.mapInArrow(lambda batches: _in_batches(hashed(batches), _arrow(_DIGEST)), schema_of(_DIGEST))


def public_codec() -> Codec:
    import public_tokenizers

    return Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: A conversation whose texts hold the template's own marks.
PLANTED = r"\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of texts that look like the template, formatted, and what is read back from ids and masks."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], rows.schema)
    return digests(format_conversations(rows.union(planted), public_codec), public_codec)


_LENGTH = r"length(regexp_replace(regexp_replace(regexp_replace({0}, '\\', '\\\\', 'g'), '</turn>', '\\</turn>', 'g'), '##(#+)', '##\1\1', 'g'))"
OP12_SQL = f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '{PLANTED}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(14 + {_LENGTH.format("role")} + {_LENGTH.format("text")})::BIGINT AS formatted_chars
FROM every GROUP BY conv_id
"""
