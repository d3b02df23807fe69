"""Whole operators over small tables against brute force, and over nulls, empty tables, repeated rows and extra columns."""

import hashlib
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trivalent.llm import ann, corpus, decontamination, html_text, pii, queries, quality, sentencepiece_bpe, simhash, substring_dedup, url_filter, warc
from trivalent.llm.components import components

from .test_text_operators import model_path

LONG = "word" + "s" * 3000 + " " + "a b c d e f " * 2000
TEXTS = [(1, None), (2, ""), (2, ""), (3, "one two"), (4, LONG), (5, LONG), (None, "null id"), (None, None), (7, "Same text here"), (7, "Other text here"), (8, "é ß 語 😀 \x00")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, text_hash long, ord long, row long, component_id long"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None, None, 1, 1, 1, 1, 1) for i, t in TEXTS], DOCS)


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 5), (7, 7)], "a long, b long"), "a", "b").collect()}
    want = groups(edges, {x for e in edges for x in e})
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if k in got}
    assert all(k in got for a, b in edges if a != b for k in (a, b))
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("bucket", [2, 8192])
def test_simhash_groups(spark, sf, bucket):
    docs = read(spark, sf, "documents")
    got = simhash.near_duplicate_groups(docs, bucket=bucket).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    fps = {i: simhash.fingerprint(t, 4) & (1 << 64) - 1 for i, t in texts.items()}
    ids = sorted(fps)
    want = groups([(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4], ids)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == fps


def test_simhash_odd_rows(spark, odd):
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicate_groups(odd).collect()]
    assert len(got) == len(TEXTS)
    assert Counter(c for i, c in got if i in (1, 2, None)) and (1, 1) in got and got.count((2, 1)) == 2 and (5, 4) in got
    assert simhash.near_duplicate_groups(odd.limit(0)).count() == 0


def test_one_of_each_group(spark, odd):
    kept = corpus.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 7, 7, 8]
    assert corpus.one_of_each_group(odd.limit(0)).count() == 0


def test_similar_groups_find_near_copies(spark, sf):
    docs = read(spark, sf, "documents")
    got = {r.doc_id: r.root for r in corpus.similar_groups(docs).collect()}
    sets = {r.doc_id: set(simhash.shingles_of((r.text or "").encode(), 5)) for r in docs.collect()}
    ids = sorted(sets)
    similar = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    want = groups([(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if similar(sets[a], sets[b])], ids)
    links = [(a, b) for a in ids for b in [want[a]] if a != b]
    found = sum(got[a] == got[b] for a, b in links)
    assert found >= 0.95 * len(links)
    assert all(want[a] == want[b] for a in ids for b in ids if got[a] == got[b])


def test_pii_rows_and_redaction(spark, odd):
    found = pii.find(odd.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" a@b.co 1.2.3.4")))).collect()
    assert len(found) == len(TEXTS) and all((r.n_email, r.n_ip) == (1, 1) for r in found)
    assert pii.find(odd.limit(0)).count() == 0
    red = pii.redact(spark.createDataFrame([(1, "x a@b.co y (at) z.com"), (2, None)], "doc_id long, text string")).collect()
    assert [r.text for r in red] == ["x [email] [email]", None]


def test_nearest_neighbours(spark, sf):
    v = read(spark, sf, "embeddings")
    got, info = ann.nearest(v, F.col("vec_id") % 20 == 0, leaves=12)
    rows = sorted(v.collect(), key=lambda r: r.vec_id)
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found, hits, total = defaultdict(list), 0, 0
    for r in got.collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in ids[ids % 20 == 0]:
        s = (x * x[ids == q]).sum(1)
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        own = sorted(found[q])
        assert [o[0] for o in own] == list(range(1, 21)) and all(abs(s[ids == i][0] - score) < 1e-12 for _, i, score in own)
        hits, total = hits + len({o[1] for o in own} & set(best)), total + 20
    assert hits >= 0.9 * total and info["leaves"] > 1


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (20, [0.0, 2.0]), (8, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0)[0].orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (0, 4, 8, -1.0), (20, 1, 8, 1.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0)[0].count() == 0


def test_neighbours_of_a_hot_leaf_and_of_each_length(spark, monkeypatch):
    """Equal vectors fill one leaf, which is cut into blocks; vectors of another length are compared among themselves."""
    monkeypatch.setattr(ann._paired, "__defaults__", (16,))
    rows = [(i, [1.0, 2.0]) for i in range(200)] + [(i, [0.0, float(i)]) for i in range(200, 220)] + [(300 + 20 * i, [1.0, 2.0, float(i)]) for i in range(3)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=5, leaves=8, recall=1.0)[0].orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = dict(rows)
    assert set(got) == {i for i in x if i % 20 == 0}
    for q, found in got.items():
        own = sorted((-sum(a * b for a, b in zip(x[q], x[i])), i) for i in x if i != q and len(x[i]) == len(x[q]))[:5]
        assert found == [(i, -s) for s, i in own]


def test_pages_of_every_size_in_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", {200: 5, 2000: 3, 1 << 62: 2})
    rows = [(i, f"http://x/{i}", "ab" * (i % 7) * 40 + "z" * (5000 if i % 11 == 0 else 0)) for i in range(60)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got} == {(i, len(h), *(("revisit", first[h]) if first[h] != i and len(h) >= 100 else ("response", None))) for i, _, h in rows}


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    rows = [(1, None, None, 9), (2, "http://x y/", "", 9), (3, "u", "short é", 9), (4, "u", "short é", 9), (6, "u", "é" * 60, 9), (5, "v", "é" * 60, 9), (5, "v", "é" * 60, 9), (None, "w", "é" * 60, 9), (9, "z", "WARC/1.1\r\n\r\n" * 20, 9)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, record_type int"), version).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h, _ in rows)
    assert sorted((r.page_id or 0, r.refers_to) for r in got if r.record_type == "revisit") == [(0, 5), (5, 5), (6, 5)]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decontamination_blocks_and_odd_rows(spark, sf, odd):
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    whole, cut = (sorted(map(str, decontamination.overlaps(docs, items, block=b).collect())) for b in (1 << 22, 1500))
    assert whole == cut
    got = {(r.doc_id, r.n_words): (r.hit_runs, r.items) for r in decontamination.overlaps(odd, spark.createDataFrame([(1, "ONE two"), (2, ""), (3, None), (None, "other")], "item_id long, text string")).collect()}
    assert got[3, 2] == ([[0, 2]], ["1"]) and got[7, 3] in (([], []), ([[0, 1]], ["null"])) and got[1, 0] == ([], [])
    assert decontamination.overlaps(odd, items.limit(0)).count() == len(TEXTS) and decontamination.overlaps(odd.limit(0), items).count() == 0
    assert decontamination.clean(odd, spark.createDataFrame([(1, "ONE two")], "item_id long, text string")).count() == len(TEXTS) - 1


def test_quality_keeps_clean_text_and_finds_junk(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op6_quality_classifier"](spark, sf).join(read(spark, sf, "labels"), "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.98 and kept[0] < 0.3


def test_quality_shards_agree_and_odd_rows(spark, sf, odd):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    whole, cut = ({r.doc_id: (r.keep, round(r.perplexity or 0, 6)) for r in quality.classify(docs, labels, shard_rows=n).collect()} for n in (2_000_000, 60_000))
    assert whole == cut
    few = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, few).count() == len(TEXTS)
    assert quality.keep_good(odd, few).count() <= len(TEXTS) and quality.keep_good(odd, few.limit(0)).count() == len(TEXTS)
    assert quality.classify(odd.limit(0), few).count() == 0


def brute_repeats(docs, length=100):
    seen, out = set(), []
    for i, t in docs:
        edge = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                edge[p] += 1
                edge[p + length] -= 1
            seen.add(w)
        gone = np.cumsum(edge)[: len(t)] > 0
        out.append((i, int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_repeated_substrings(spark, sf, odd):
    docs = read(spark, sf, "documents")
    got = queries.QUERIES["op7_substring_dedup"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(sorted((r.doc_id, r.text.encode()) for r in docs.collect()))
    rows = [(1, "a" * 500), (2, "ab" * 200), (3, "a" * 99), (4, "é" * 300), (5, "x" * 50 + "ab" * 100), (6, "b" + "ab" * 60 + "c"), (-7, "ab" * 55)]
    got = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, sum(b - a for a, b in r.spans), len(r.spans), r.kept_sha256) for r in got) == brute_repeats(sorted((i, t.encode()) for i, t in rows))
    got = substring_dedup.repeated_spans(odd).collect()
    assert len(got) == len(TEXTS) and [r.spans for r in got if r.doc_id == 5] == [[[0, len(LONG)]]]
    assert substring_dedup.repeated_spans(odd.limit(0)).count() == 0


def test_frequent_words_are_dealt_by_their_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    word = "a boilerplate line of text that is in every document, always "
    docs = [(i, "".join(chr(int(c)) for c in rng.integers(97, 123, 150)) + word + "".join(chr(int(c)) for c in rng.integers(97, 123, 150))) for i in range(60)]
    docs += [(100 + i, docs[i][1][40:]) for i in range(0, 60, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = {r.doc_id: (r.spans, r.kept_sha256) for r in substring_dedup.repeated_spans(df).collect()}
    at = substring_dedup.anchors
    words = np.unique(np.concatenate([at(t.encode())[3] for _, t in docs]))
    monkeypatch.setattr(substring_dedup, "frequent_words", lambda *_: words)
    assert {r.doc_id: (r.spans, r.kept_sha256) for r in substring_dedup.repeated_spans(df).collect()} == plain
    assert sorted((i, sum(b - a for a, b in s), len(s), k) for i, (s, k) in plain.items()) == brute_repeats([(i, t.encode()) for i, t in docs])


def test_url_rules_and_odd_rows(spark):
    urls = ["http://www.Example.com/en/1?x", "https://b.example.com/en/2", "x", None, "http://a.net/es/3#f", "http://a.net", "http://notcom/", "http://n.org/a/b/c/d/e/f", "ftp://é.com/x"]
    pages = spark.createDataFrame([(i, u, 1, 1, 1) for i, u in enumerate(urls)] + [(None, "http://a.net/fr/", 1, 1, 1)], "page_id long, url string, host int, path int, rule int")
    none = spark.createDataFrame([], "label_id long, good boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, none).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[1] == ("b.example.com", "/en/2", "example.com/en/", "block")
    assert got[2] == got[3] == ("", "", None, "allow") and got[4] == ("a.net", "/es/3", "net/es/", "block") and got[5] == ("a.net", "", None, "allow")
    assert got[6][2] is None and got[7][1] == "/a/b/c/d/e/f" and got[8][2] == "com/" and got[None][2] == "net/fr/"
    assert url_filter.judge(pages.limit(0), none).count() == 0


def test_url_templates_reject_bad_branches(spark):
    rows = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)] + [(200 + i, f"http://w.org/{chr(97 + i % 26)}{chr(97 + i // 26)}x/p") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(0, 100)], "label_id long, good boolean")
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert {r.verdict for r in got if r.host == "h.org" and r.page_id % 2} == {"block"} and {r.verdict for r in got if r.host == "h.org" and r.page_id % 2 == 0} == {"allow"}
    assert {r.template for r in got if r.host == "w.org"} == {"/*/p"}


def test_encoding_columns(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    out = sentencepiece_bpe.encode(odd, model_path(), decoded="decoded")
    assert out.columns == [*odd.columns, "token_ids", "decoded"]
    assert all(r.token_ids == sp.encode(r.text or "") and r.decoded == sp.decode(r.token_ids) for r in out.collect())
    digests = sentencepiece_bpe.token_digests(odd, model_path()).collect()
    assert Counter((r.n_tokens, r.decoded_sha256) for r in digests) == Counter((len(i := sp.encode(t or "")), hashlib.sha256(sp.decode(i).encode()).hexdigest()) for _, t in TEXTS)


def test_html_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 1), (None, "u", "<p>x", 1)], "page_id long, url string, html string, text int")
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()] == [(1, "", 0), (2, "", 0), (None, "x", 1)]
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    duck = duckdb.connect()
    for f in os.listdir(sf):
        duck.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()))
    norm = lambda d: d.assign(**{c: d[c].astype("float64") for c in d.columns if d[c].dtype.kind in "if" or str(d[c].dtype).startswith("Int")})
    assert rows(norm(got)) == rows(norm(want))


def test_pipeline_stages_are_what_brute_force_gives(spark, sf):
    """Each stage on what the one before has kept: counts by stage, its decisions by plain code where they are plain."""
    import corpus_pipeline

    docs = read(spark, sf, "documents")
    kept = [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf).checkpoint()
        kept.append(docs.count())
        if n + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == before.columns, name
        if name == "benchmark decontamination":
            windows = {tuple(w[i : i + 10]) for r in read(spark, sf, "benchmark").collect() for w in [decontamination.words_of(r.text.encode())] for i in range(max(1, len(w) - 9))}
            clean = {r.doc_id for r in before.collect() for w in [decontamination.words_of(r.text.encode())] if not any(tuple(w[i : i + 10]) in windows for i in range(len(w)))}
            assert {r.doc_id for r in docs.collect()} == clean
        if name == "PII":
            assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in docs.collect())
    assert kept[0] > kept[1] > kept[2] > kept[3] == kept[4] == kept[5] > 0
    sf_run = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in sf_run.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def jaccard_groups(sets):
    ids = sorted(sets)
    similar = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    return groups([(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and similar(sets[a], sets[b])], ids)


@pytest.mark.parametrize("block", [4, 7, 256])
def test_verified_groups_of_any_block(spark, block):
    """A root of near sets, chains in which only neighbours are similar, and sets that are like none: cut into blocks or not."""
    rng = np.random.default_rng(4)
    sets = {}
    for i in range(60):  # a chain: each set is 0.9 of the one before
        sets[i] = set(range(10 * i, 10 * i + 100))
    for i in range(60, 120):  # a group around one set
        sets[i] = set(range(5000, 5100)) - set(int(x) for x in rng.integers(5000, 5100, 4))
    for i in range(120, 150):  # near each other, but not enough
        sets[i] = set(range(9000, 9070)) | set(range(20000 + 100 * i, 20030 + 100 * i))
    rows = [(i, i % 2 if i >= 150 else 0, np.array(sorted(s), np.uint64).tobytes()) for i, s in sets.items()]
    rows += [(200, 1, b""), (201, 1, np.array([1, 2], np.uint64).tobytes())]
    got = {r.node: r.label for r in corpus.verified_groups(spark.createDataFrame(rows, "node long, root long, hashes binary"), 0.8, block).collect()}
    want = jaccard_groups(sets) | {200: 200, 201: 201}
    assert len({(got[i], want[i]) for i in want}) == len(set(got.values())) == len(set(want.values())) and len(got) == len(want)


def test_recall_of_pairs_at_the_border_and_a_large_group(spark):
    """Pairs of 0.80 to 0.84, and 400 near copies of one text: no false group, hardly a link lost, none in the large group."""
    rng = np.random.default_rng(5)
    texts = []
    while len(texts) < 400:
        w = [f"w{x}" for x in rng.integers(0, 20000, 120)]
        x = [f"w{rng.integers(0, 20000)}" if i in set(rng.integers(0, 120, 3).tolist()) else v for i, v in enumerate(w)]
        a, b = ({tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in (w, x))
        if 0.8 <= len(a & b) / len(a | b) <= 0.84:
            texts += [" ".join(w), " ".join(x)]
    base = [f"v{x}" for x in rng.integers(0, 20000, 200)]
    for _ in range(400):
        x = list(base)
        for at in rng.integers(0, 200, rng.integers(1, 5)):
            x[at] = f"u{rng.integers(0, 20000)}"
        texts.append(" ".join(x))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.root for r in corpus.similar_groups(docs, block=64).collect()}
    want = jaccard_groups({i: set(simhash.shingles_of(t.encode(), 5)) for i, t in enumerate(texts)})
    assert len({(got[i], want[i]) for i in got}) == len(set(got.values()))
    assert sum(got[i] == got[i + 1] for i in range(0, 400, 2)) >= 0.97 * 200
    assert len({(got[i], want[i]) for i in range(400, 800)}) == len({want[i] for i in range(400, 800)})


@pytest.mark.parametrize("bucket", [20, 8192])
def test_near_copies_are_linked_a_few_times_each(spark, monkeypatch, bucket):
    """Components of all pairs that meet in a table within 60 bits, whether buckets are cut or not, from links in proportion to the nodes."""
    rng = np.random.default_rng(3)
    flipped = lambda x, n: x ^ np.isin(np.arange(256), rng.choice(256, n, False))
    base, chain = rng.integers(0, 2, (2, 256))
    far = flipped(base, 70)  # shares buckets with the first group
    bits = [flipped(base, rng.integers(0, 24)) for _ in range(150)] + [flipped(far, rng.integers(0, 10)) for _ in range(40)] + [*rng.integers(0, 2, (60, 256))]
    for _ in range(30):
        bits.append(chain := flipped(chain, 12))
    prints = np.packbits(np.array(bits, np.uint8), axis=1, bitorder="little").view("<u8")
    made, plain = spark.sparkContext.accumulator(0), simhash._candidates

    def counted(wide):
        links = plain(wide)

        def run(batches):
            for out in links(batches):
                made.add(out.num_rows)
                yield out

        return run

    monkeypatch.setattr(simhash, "_candidates", counted)
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        nodes = spark.createDataFrame([(i, *x) for i, x in enumerate(prints.view("<i8").tolist())], "node long, f0 long, f1 long, f2 long, f3 long")
        got = {r.node: r.root for r in simhash.candidate_roots(nodes, 4, 60, bucket=bucket).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    meet = np.zeros((len(bits), len(bits)), bool)
    for part in range(simhash.PARTS):
        value = prints[:, part // 2] >> np.uint64(32 * (part % 2)) & np.uint64(0xFFFFFFFF)
        for mask in simhash.covering_masks(4, 1 + part, range(32)):
            kept = value & np.uint64(mask)
            meet |= kept[:, None] == kept[None, :]
    near = meet & (np.bitwise_count(prints[:, None] ^ prints[None, :]).sum(-1) <= 60)
    ids = [*range(len(bits))]
    want = groups([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)))], ids)
    assert got == {i: want[i] for i in ids if near[i].sum() > 1}
    assert 0 < made.value <= 6 * len(bits)


def test_columns_that_clash_with_helpers(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 0, 0, 0, 0), (1, "a b", "en", 0, 0, 0, 0), (2, "A b", "en", 0, 0, 0, 0), (3, "c", "en", 0, 0, 0, 0)], "doc_id long, text string, lang string, key_id int, key_hash int, trusted_id int, text_hash int")
    assert corpus.one_of_each_group(docs).columns == docs.columns and sorted(r.doc_id for r in corpus.one_of_each_group(docs).collect()) == [1, 3]
    assert sorted(r.doc_id for r in decontamination.clean(docs, spark.createDataFrame([(1, "c")], "item_id long, text string")).collect()) == [1, 1, 2]
    few = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, few).columns == docs.columns


def test_repeated_passages_neither_join_nor_part_documents(spark):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    line = "one line again and again "
    texts = [line * 400 + words(k, 60) for k in range(3)] + [words(9, 200), words(9, 200) + " " + words(9, 20) * 30, words(8, 150), words(8, 150) + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(simhash.shingles_of(t.encode(), 5)) for t in texts]
    similar = [(a, b) for a in range(7) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert similar == [(4, 3), (6, 5)]
    got = {r.doc_id: r.root for r in corpus.similar_groups(docs).collect()}
    assert [(a, b) for a in range(7) for b in range(a) if got[a] == got[b]] == similar
    assert sorted(r.doc_id for r in corpus.one_of_each_group(docs).collect()) == [0, 1, 2, 3, 5]


def plain_judgements(pages, labels):
    """The tree and its purities by dictionaries: host, shape, template and verdict without rules."""
    import re

    def shape(path):
        kind = lambda s: "<n>" if re.fullmatch("[0-9]+", s) else "<date>" if re.fullmatch("[0-9]{4}-[0-9]{2}(-[0-9]{2})?", s) else "<hex>" if re.fullmatch("[0-9a-fA-F]{16,}", s) else re.sub("[0-9]+", "<n>", s)
        return tuple(kind(s) for s in path.split("/") if s)

    rows = []
    for i, url in pages:
        m = re.match("(?s)^.*?://([^/?#]*)([^?#]*)", url)
        number = re.search(r"([0-9]{1,18})[^0-9/]*/*$", m[2])
        rows.append((i, m[1], shape(m[2]), labels.get(int(number[1])) if number else None))
    paths = defaultdict(lambda: [0, 0, 0])
    for _, h, s, good in rows:
        paths[h, s][0] += 1
        if good is not None:
            paths[h, s][1 if good else 2] += 1
    template = {}

    def grow(host, at, members, level):
        children = defaultdict(list)
        for s in members:
            if len(s) > level:
                children[s[level]].append(s)
            else:
                template[host, s] = at
        total = [sum(paths[host, s][k] for c in children.values() for s in c) for k in range(3)]
        below = defaultdict(list)
        for name, own in children.items():
            n, good, bad = (sum(paths[host, s][k] for s in own) for k in range(3))
            rest_good, rest = total[1] - good, total[1] + total[2] - good - bad
            differs = False
            if good + bad and rest:
                pooled = total[1] / (total[1] + total[2])
                if 0 < pooled < 1:
                    differs = abs(good / (good + bad) - rest_good / rest) / (pooled * (1 - pooled) * (1 / (good + bad) + 1 / rest)) ** 0.5 > 1.96
            label = "*" if len(children) >= 20 and len(children) >= 0.5 * total[0] else name if differs or len(children) == 1 else "~"
            below[f"{at}/{label}"] += own
        alone = sum(map(len, children.values())) == 1
        for name, own in below.items():
            if alone:
                template[host, own[0]] = f"{at}/{'/'.join(own[0][level:])}"
            else:
                grow(host, name, own, level + 1)

    for host in {h for h, _ in paths}:
        grow(host, "", [s for h, s in paths if h == host], 0)
    good, bad = (sum(p[k] for p in paths.values()) for k in (1, 2))
    prior = (good + 1) / (good + bad + 1)
    smooth = lambda g, b, p: (g + 4 * p) / (g + b + 4)
    by_host, by_template = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, s), p in paths.items():
        for by in (by_host[h], by_template[h, template[h, s]]):
            by[0] += p[1]
            by[1] += p[2]
    out = {}
    for i, h, s, _ in rows:
        t = template[h, s]
        out[i] = (t, round(smooth(*by_template[h, t], smooth(*by_host[h], prior)), 9))
    return out


@pytest.mark.parametrize("frequent", [20_000, 3])
def test_url_templates_are_the_plain_trees(spark, monkeypatch, frequent):
    monkeypatch.setattr(url_filter, "FREQUENT", frequent)
    import random

    rng = random.Random(6)
    pages = []
    for i in range(1500):
        host = rng.choice(["a.org", "a.org", "b.org", "c.org"])
        parts = [rng.choice(["news", "spam", "x", "tag", f"u{rng.choice('abcdefghijklmnopqrstuvwxyz')}{rng.choice('abcdefghijklmnop')}z"]) for _ in range(rng.randrange(4))]
        pages.append((i, f"http://{host}/" + "/".join([*parts, str(i)] if rng.random() < 0.9 else parts)))
    labels = {i: ("spam" not in u) ^ (rng.random() < 0.1) for i, u in pages if rng.random() < 0.6}
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(list(labels.items()), "label_id long, good boolean"), rules=[]).collect()
    want = plain_judgements(pages, labels)
    assert {r.page_id: (r.template, round(r.purity, 9)) for r in got} == want
    assert all((r.verdict == "block") == (r.purity < 0.5) for r in got) and len({r.verdict for r in got}) == 2


def test_url_templates_reach_any_depth(spark):
    rows = [(i, f"http://h.org/a/b/c/d/e/f/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)] + [(200, "http://deep.org/" + "y/" * 300 + "200")]
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(0, 100)], "label_id long, good boolean")
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert len(got) == 201 and {(r.page_id % 2, r.verdict) for r in got} == {(0, "allow"), (1, "block")}
    assert {r.template for r in got if r.page_id == 1} == {"/a/b/c/d/e/f/spam/<n>"}
