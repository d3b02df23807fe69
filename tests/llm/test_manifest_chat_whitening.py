"""Hash trees, chat formatting and whitening against plain versions, and over nulls, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trivalent.llm import chat, merkle, whitening
from trivalent.operators import ranges


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_path(levels, i, fanout):
    for level in levels[:-1]:
        start = i // fanout * fanout
        run = level[start : start + fanout]
        yield "".join(run[: i - start]), "".join(run[i - start + 1 :])
        i //= fanout


def plain_proofs(rows, fanout):
    """Sorted (doc_id, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0], sha("".join(map(value, r)))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    by = {s: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s, v in by.items()}
    trees = {s: plain_tree([x[1] for x in v], fanout) for s, v in by.items()}
    top = plain_tree([trees[s][-1][0] for s in order], fanout)
    out = []
    for at, s in enumerate(order):
        for i, (doc_id, leaf) in enumerate(by[s]):
            path = [*plain_path(trees[s], i, fanout), *plain_path(top, at, fanout)]
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], path))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fanout", "parts"), [(2, 7), (3, 5), (16, 3)])
def test_proofs_are_the_plain_trees(spark, monkeypatch, fanout, parts):
    rng = random.Random(fanout)
    rows = [(i, rng.choice(["hot"] * 8 + ["b", "é", "", None]), "en", i % 7, f"text {i} ß😀") for i in range(500)]
    rows += [(1000 + i, f"s{i}", None, None, None if i % 2 else "") for i in range(40)]
    rows += [(None, "hot", "en", 1, "no id"), (None, None, None, None, None), (3, "hot", "en", 2, "other"), *[rows[0]] * 60]
    real = ranges.in_ranges
    monkeypatch.setattr(merkle, "in_ranges", lambda df, order, n=None: real(df, order, parts))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp string, part int")
    found = merkle.document_proofs(docs, fanout=fanout)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in found.collect()]
    assert sorted(got, key=str) == plain_proofs(rows, fanout)
    assert found.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()


@pytest.mark.parametrize("n", [1, 16, 257])
def test_trees_of_one_source(spark, n):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in merkle.document_proofs(docs).collect()]
    assert sorted(got, key=str) == plain_proofs(rows, 16)


def test_no_documents_have_no_tree(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.document_proofs(docs).collect() == []


def test_every_change_of_a_leaf_is_seen(spark, sf):
    """Each field in turn; null and empty, and values that shift between fields, are other leaves."""
    rows = [(1, "s", "a", 1, "b"), (1, "s", "a", 1, None), (1, "s", "a", 1, ""), (1, "s", "a", None, "b"), (1, "s", None, 1, "b"), (1, "s", "a1", None, "b"), (1, "s", "", 1, "ab"), (11, "s", "a", 1, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert len({r.leaf for r in merkle.document_proofs(docs).collect()}) == len(rows)
    found = merkle.op11_merkle_manifest(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    for r in found:
        changed = r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in r.text)
        assert r.verified != changed
    assert len({r.root for r in found}) == 1 and {r.verified for r in found} == {True, False}


def same_as_sql(spark, sf, query, sql, table):
    c = duckdb.connect()
    c.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    got, want = query(spark, sf).toPandas(), c.sql(sql).df()
    got, want = (d[sorted(d.columns)].sort_values(sorted(d.columns)).reset_index(drop=True).astype(str) for d in (got, want))
    assert got.equals(want) and len(got)


def test_manifest_is_its_sql(spark, sf):
    same_as_sql(spark, sf, merkle.op11_merkle_manifest, merkle.OP11_SQL, "documents")


def test_chat_is_its_sql(spark, sf):
    same_as_sql(spark, sf, chat.op12_chat_format, chat.OP12_SQL, "conversations")


PARTS = ["\\", "#", "##", "###", "### ", "<", "</turn>", "</turn>\n", "/turn>", ": ", "\n", " ", "a", "é", "😀", "user", "### assistant: ", "\x00", "<|endoftext|>"]


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_escaping_is_reversible_and_hides_all_marks():
    import re

    for text in odd_texts(1, 5000):
        out = chat.escape(text)
        assert chat.unescape(out) == text
        for after in ("", chat.SAYS, chat.CLOSE):  # read from the left, no mark begins within the text
            rest = out + after
            at = 0
            while at < len(out):
                assert not re.match(r"###|</turn>", rest[at:])
                at += 2 if rest[at] == "\\" else 1


def test_escaping_as_a_column(spark):
    texts = odd_texts(2, 500)
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", chat.escaped("text").alias("e")).collect()
    assert all(r.e == chat.escape(texts[r.i]) for r in got)


def test_text_form_is_read_back():
    import re

    codec, texts = chat.public_codec(), odd_texts(3, 300)
    for role, text in zip(texts, texts[1:]):
        ids = [codec.marks[0], *codec.encode(chat.escape(role)), codec.marks[1], *codec.encode(chat.escape(text)), codec.marks[2]]
        assert codec.turns(ids) == [(role, text)] and max(codec.encode(text), default=0) < codec.marks[0]
        assert codec.text(ids) == f"### {chat.escape(role)}: {chat.escape(text)}</turn>\n"
    mask = chat.loss_mask([2 + len(codec.encode(chat.escape(role))), len(ids) - 3 - len(codec.encode(chat.escape(role))), 1], [False, True, False])
    assert codec.read(ids, mask) == ([(role, text)], text, len(codec.text(ids))) and codec.read(ids, [False] * len(ids))[1] == ""
    two = [*ids, *ids]
    said = codec.text(two)
    assert len(re.findall(r"(?s)### ((?:[^\\]|\\.)*?)</turn>\n", said)) == 2
    for broken in (two[:-1], two[1:], [*ids, 5, *ids], [*ids, codec.marks[2]]):
        with pytest.raises(ValueError):
            codec.turns(broken)


def test_mask_is_the_running_sum():
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.randrange(4) for _ in range(rng.randrange(8))]
        on = [rng.random() < 0.5 for _ in lengths]
        assert chat.loss_mask(lengths, on).tolist() == [o for n, o in zip(lengths, on) for _ in range(n)]


@pytest.mark.parametrize(("turns", "chars", "parts"), [(256, 1 << 20, 3), (2, 30, 5), (1, 1, 7)])
def test_conversations_of_any_kind(spark, turns, chars, parts):
    texts = odd_texts(5, 400)
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 2, 3, None, *range(20, 50)]), rng.randrange(50), rng.choice(["user", "assistant", "system", "Odd: role</turn>", ""]), t) for t in texts]
    rows += [(9, 0, None, None), (9, None, "assistant", None), (8, 1, "assistant", "word " * 20000 + "x" * 50000), *[(7, 1, "assistant", "same")] * 9]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, part int, piece string")
    pieces = chat.format_conversations(df, chat.public_codec, turns=turns, chars=chars, parts=parts)
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(pieces, chat.public_codec).collect()}
    by = defaultdict(list)
    for conv_id, turn, role, text in rows:
        by[conv_id].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    want = {}
    for conv_id, own in by.items():
        own = [(r.decode(), t.decode()) for *_, r, t in sorted(own)]
        loss = "".join(t for r, t in own if r == "assistant")
        size = sum(len(f"### {chat.escape(r)}: {chat.escape(t)}</turn>\n") for r, t in own)
        want[conv_id] = len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss), size
    assert got == want
    read = chat.read_back(pieces, chat.public_codec).collect()
    assert sum(r.n_turns for r in read) == len(rows) and all(hashlib.sha256(r.loss.encode()) for r in read)
    counts = defaultdict(int)
    for r in pieces.collect():
        counts[r.conv_id] += 1
    assert all(counts[r.conv_id] == 1 for r in pieces.where("alone").collect())
    whole = defaultdict(str)
    for r in chat.texts(pieces, chat.public_codec).orderBy("part", "piece").collect():
        whole[r.conv_id] += r.formatted
    assert {k: len(v) for k, v in whole.items()} == {k: v[-1] for k, v in want.items()}
    assert all(len(r.token_ids) == len(r.loss_mask) and r.n_turns <= turns for r in pieces.collect())


def test_no_conversations_give_no_pieces(spark):
    pieces = chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), chat.public_codec)
    assert chat.digests(pieces, chat.public_codec).collect() == []


def plain_whitening(rows, k=4):
    """For each id: n, deviation, whitened and explained, from exact integers; None where a vector takes no part."""
    ok = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({v for _, v in ok}), object)
    n, s = len(x), x.sum(0)
    cov = np.array([[a / (n * n) for a in row] for row in n * (x.T @ x) - np.outer(s, s)], float)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    out = {}
    for i, v in ok:
        c = n * np.array(v, object) - s
        out[i] = n, int((c**2).sum()), np.array([a / n for a in c], float) @ basis / np.sqrt(values), values / np.trace(cov)
    return out


def check_whitening(found, rows):
    want, by = plain_whitening(rows), defaultdict(dict)
    for r in found:
        by[r.vec_id][r.component] = r
    assert set(by) == set(want) and all(set(v) == {1, 2, 3, 4} for v in by.values())
    got = np.array([[by[i][c].whitened for c in range(1, 5)] for i in want])
    plain = np.array([want[i][2] for i in want])
    sign = np.sign((got * plain).sum(0))
    assert np.abs(got - plain * sign).max() < 1e-9
    for i, (n, deviation, _, explained) in want.items():
        for c, r in by[i].items():
            assert (r.n, r.deviation and int(r.deviation)) == (n, deviation if deviation < 10**38 else None) and r.identity_error < 1e-9 and abs(r.explained / explained[c - 1] - 1) < 1e-9


@pytest.mark.parametrize(("scale", "offset"), [(1, 0), (1e3, 1e6), (1, 1e9), (1e9, 1e12), (1e14, -9e15), (1e-2, 4)])
def test_whitening_is_exact(spark, scale, offset):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=6) * scale * np.array([9, 6, 4, 2, 1, 1]) + offset]) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 4), (1002, [float("inf")] * 6), (1003, [float("nan")] * 6), (1004, [-float("inf")] + [0.0] * 5)]
    rows += [(2000 + i, rows[0][1]) for i in range(80)]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, x double, d int")
    check_whitening(whitening.whiten(df).collect(), rows)


def test_whitening_of_all_embeddings(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(whitening.op13_embedding_whitening(spark, sf).collect(), rows)


def test_scatter_of_any_integers():
    rng = random.Random(8)
    for bits in (3, 20, 21, 45, 62, 66):
        x = np.array([[rng.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(50)], object)
        assert (whitening.scatter(x if bits > 62 else x.astype(np.int64)) == x.T @ x).all()
    assert all(sum(w << 32 * k for k, w in enumerate(whitening._words(v))) == v for v in (0, 1, -1, 1 << 150, -(1 << 150) + 7))


def test_whitening_without_variance_or_of_other_lengths(spark):
    ddl = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], ddl)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, 2.0])], ddl)).collect() == []
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(9)] + [(100 + i, [float(i % 4), 1.0, float(i % 3)]) for i in range(12)] + [(None, [3.0, 3.0])]
    found = whitening.whiten(spark.createDataFrame(rows, ddl)).collect()
    assert {(r.vec_id is None or r.vec_id < 100, r.n) for r in found} == {(True, 10), (False, 12)} and all(r.identity_error < 1e-9 for r in found)
    assert {r.component for r in found if r.vec_id == 1} == {1, 2} and {r.component for r in found if r.vec_id == 101} == {1, 2}
    far = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], ddl)).collect()
    assert {r.vec_id for r in far} == {1, 2, 3} and all(math.isfinite(r.whitened) for r in far)
