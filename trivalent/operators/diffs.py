"""Differences of sequences: the shortest edit script between two arrays of lines or blocks, and what it says of two texts.

Scripts come from the greedy search for a middle snake from both ends (Myers), so that memory is linear in the arrays; what only one
side has is set aside first, as it matches nothing. Everything that reads the scripts is a Column."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Words that tell of another version, matched as whole words or within words.
VERSION_WORDS = ("addendum", "amended", "amendment", "corrigendum", "extension", "modified", "notification", "revised", "revision", "supersession", "updated")
VERSION_PARTS = ("अधिसूचना", "आदेश", "नवीन", "परिवर्तन", "परिशिष्ट", "शुद्धिपत्र", "संशोधन", "संशोधित")
_OPCODE = T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("old_from", "old_to", "new_from", "new_to"))])
#: Rows of an Arrow batch that are compared before their scripts are handed on.
ROWS = 64


def _middle(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
    """A snake in the middle of a shortest script: from (x, y) to (u, v)."""
    n, m = a1 - a0, b1 - b0
    delta, most = n - m, (n + m + 1) // 2
    forth, back = [-1] * (2 * most + 3), [-1] * (2 * most + 3)  # by diagonal; negative ones count from the end
    forth[1] = back[1] = 0
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = forth[k + 1] if k == -d or k != d and forth[k - 1] < forth[k + 1] else forth[k - 1] + 1
            y = x - k
            at = x
            while x < n and y < m and a[a0 + x] == b[b0 + y]:
                x, y = x + 1, y + 1
            forth[k] = x
            if delta % 2 and abs(k - delta) < d and x + back[delta - k] >= n:
                return a0 + at, b0 + at - k, a0 + x, b0 + y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or k != d and back[k - 1] < back[k + 1] else back[k - 1] + 1
            y = x - k
            at = x
            while x < n and y < m and a[a1 - 1 - x] == b[b1 - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not delta % 2 and abs(k - delta) <= d and x + forth[delta - k] >= n:
                return a1 - x, b1 - y, a1 - at, b1 - at + k
    raise AssertionError("no middle")


def _matches(a: list, b: list) -> Iterator[tuple[int, int]]:
    """The places that a longest common subsequence matches, in order."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 < 0:  # a run of matches that is due
            yield from ((-a0 - 1 + i, b0 + i) for i in range(a1))
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            yield a0, b0
            a0, b0 = a0 + 1, b0 + 1
        same = 0
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1, same = a1 - 1, b1 - 1, same + 1
        if same:
            todo.append((-a1 - 1, same, b1, 0))
        if a0 < a1 and b0 < b1:
            x, y, u, v = _middle(a, b, a0, a1, b0, b1)
            todo += [(u, a1, v, b1), (-x - 1, u - x, y, 0), (a0, x, b0, y)]


def edit_script(old: list, new: list) -> list[tuple[str, int, int, int, int]]:
    """(tag, old_from, old_to, new_from, new_to): equal, delete, insert and replace, in order, covering both sides; ends are exclusive."""
    number = {v: n for n, v in enumerate(dict.fromkeys(old))}
    there = {number[v] for v in new if v in number}
    a = [(i, number[v]) for i, v in enumerate(old) if number[v] in there]
    b = [(j, number[v]) for j, v in enumerate(new) if v in number]
    out, i, j = [], 0, 0

    def gap(to_i, to_j):
        if i < to_i or j < to_j:
            out.append(("replace" if i < to_i and j < to_j else "delete" if i < to_i else "insert", i, to_i, j, to_j))

    for p, q in _matches([v for _, v in a], [v for _, v in b]):
        p, q = a[p][0], b[q][0]
        gap(p, q)
        if out and out[-1][0] == "equal" and (i, j) == (p, q):
            out[-1] = (*out[-1][:2], p + 1, out[-1][3], q + 1)
        else:
            out.append(("equal", p, p + 1, q, q + 1))
        i, j = p + 1, q + 1
    gap(len(old), len(new))
    return out


def opcodes(pairs: DataFrame, old: str, new: str, name: str = "opcodes") -> DataFrame:
    """pairs with the edit script between two columns of arrays of strings. A null array is empty, a null element equals only null."""
    schema = T.StructType([*pairs.schema.fields, T.StructField(name, T.ArrayType(_OPCODE))])
    arrow = to_arrow_schema(schema)
    old_at, new_at = pairs.columns.index(old), pairs.columns.index(new)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                scripts = [[dict(zip(_OPCODE.names, op)) for op in edit_script(a or [], b or [])] for a, b in zip(part.column(old_at).to_pylist(), part.column(new_at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scripts, arrow.field(name).type)], schema=arrow)

    return pairs.mapInArrow(run, schema)


def lines(text: Column) -> Column:
    """The lines of a text; a line break at its end begins no other line."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n$", "")
    return F.when(F.length(F.coalesce(text, F.lit(""))) > 0, F.split(t, "\n")).otherwise(F.array().cast("array<string>"))


def _told(script: Column, side: Column, tags: tuple[str, str], start: str, end: str) -> Column:
    changed = F.filter(script, lambda op: op["tag"].isin(*tags))
    return F.flatten(F.transform(changed, lambda op: F.transform(F.slice(side, op[start] + 1, op[end] - op[start]), lambda s: F.trim(s))))


def added(script: Column, new: Column) -> Column:
    return _told(script, new, ("insert", "replace"), "new_from", "new_to")


def removed(script: Column, old: Column) -> Column:
    return _told(script, old, ("delete", "replace"), "old_from", "old_to")


def summary(script: Column, old: Column, new: Column, most: int = 8) -> Column:
    """The first changed lines: those that went after a minus, then those that came after a plus, place by place."""
    part = lambda sign, side, a, b: F.transform(F.slice(side, a + 1, b - a), lambda s: F.concat(F.lit(sign), F.trim(s)))
    each = F.transform(F.filter(script, lambda op: op["tag"] != "equal"), lambda op: F.concat(part("- ", old, op["old_from"], op["old_to"]), part("+ ", new, op["new_from"], op["new_to"])))
    return F.coalesce(F.array_join(F.slice(F.flatten(each), 1, most), "\n"), F.lit(""))


def version_words(text: Column) -> Column:
    """Which of the words that tell of versions a text holds, sorted."""
    lower = F.lower(text)
    said = [F.when(lower.rlike(rf"\b{w}\b"), w) for w in VERSION_WORDS] + [F.when(F.contains(text, F.lit(w)), w) for w in VERSION_PARTS]
    return F.array_sort(F.array_compact(F.array(*said)))


def years(title: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"(?U)\b(20\d{2})\b"), F.lit(1))))


def year_change(old_title: Column, new_title: Column) -> Column:
    """Whether both titles name years, and not the same ones."""
    a, b = years(old_title), years(new_title)
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)


def text_changes(pairs: DataFrame, old: str, new: str, old_title: str, new_title: str, most: int = 8) -> DataFrame:
    """pairs (without the texts) with n_added, n_removed, summary, words, year_changed and is_version.

    Two texts that differ are probably versions of one another if what changed or a title says so, or the titles' years differ. Null texts
    and titles are empty."""
    kept = [c for c in pairs.columns if c not in (old, new)]
    rows = pairs.select(*kept, lines(F.col(old)).alias("old_lines"), lines(F.col(new)).alias("new_lines"))
    rows = opcodes(rows, "old_lines", "new_lines")
    script, a, b = F.col("opcodes"), F.col("old_lines"), F.col("new_lines")
    rows = rows.select(*kept, added(script, b).alias("added"), removed(script, a).alias("removed"), summary(script, a, b, most).alias("summary"))
    title = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = version_words(F.concat_ws(" ", title(new_title), title(old_title), F.array_join("added", " "), F.array_join("removed", " ")))
    differs = (F.size("added") > 0) | (F.size("removed") > 0)
    return rows.select(
        *kept, F.size("added").cast("long").alias("n_added"), F.size("removed").cast("long").alias("n_removed"), "summary", said.alias("words"),
        year_change(F.col(old_title), F.col(new_title)).alias("year_changed"), (differs & ((F.size(said) > 0) | year_change(F.col(old_title), F.col(new_title)))).alias("is_version"),
    )

