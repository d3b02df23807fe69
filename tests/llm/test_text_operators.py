"""Helpers of the operators against plain versions: no Spark in these."""

import random
import re
from html import unescape

import numpy as np
import pytest

from trivalent.llm import html_text, pii, quality, simhash, substring_dedup, warc
from trivalent.llm.sentencepiece_bpe import PrefixTableEncoder


def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_sentencepiece_is_the_librarys():
    import sentencepiece

    ours, theirs = PrefixTableEncoder(open(model_path(), "rb").read()), sentencepiece.SentencePieceProcessor(model_file=model_path())
    rng = random.Random(1)
    letters = list("abcdefg the in er\n\t ..,,!%  <>&$0123é▁ßłЖ語ア😀​\x00")
    texts = ["", " ", "  ", "\n", "<s>", "</s> <0x41>", "a" * 5000, " " * 300 + "x", "word " * 3000]
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        texts.append(t.replace("a", " " * rng.randrange(40)) if rng.random() < 0.3 else t)
    for t in texts:
        ids = theirs.encode(t)
        assert ours.encode(t) == ids
        assert ours.decode(ids) == theirs.decode(ids)
        assert ours.digest(t) == (len(ids), ",".join(map(str, ids)), theirs.decode(ids))


def test_other_models_are_refused():
    from pathlib import Path

    import public_tokenizers

    others = [f for f in Path(public_tokenizers.__file__).parent.glob("*.model") if f.name != "piece_bpe_32k.model"]
    for f in others:
        with pytest.raises(Exception):  # noqa: B017  a file of another library, or a ValueError
            PrefixTableEncoder(f.read_bytes())


def test_disguises_of_any_identifier_are_found():
    """Random identifiers, each character or separator disguised at random: the whole source stretch is found."""
    rng = random.Random(12)
    wide = lambda s: "".join(chr(ord(c) + 0xFEE0) if c.isalnum() and rng.random() < 0.4 else c for c in s)
    cyrillic = lambda s: "".join({"a": "а", "e": "е", "o": "о", "c": "с"}.get(c, c) if rng.random() < 0.6 else c for c in s)
    hidden = lambda s: s[:1] + "".join((chr(0x200B) if rng.random() < 0.2 else "") + c for c in s[1:])
    brackets = lambda s: s.replace("@", rng.choice([" [at] ", "(at)", " { AT } "])).replace(".", rng.choice([" [dot] ", "(dot)"]))
    words = lambda s: s.replace("@", " at ").replace(".", " dot ")
    for _ in range(400):
        name = "".join(rng.choice("abcdeghok") for _ in range(rng.randrange(2, 9)))
        kind, plain = rng.choice([(0, f"{name}@{name[::-1]}.com"), (0, f"{name}.x@mail.{name}.org"), (1, ".".join(str(rng.randrange(256)) for _ in range(4))), (3, "+" + "".join(rng.choice("123456789") for _ in range(11)))])
        shown = rng.choice([wide, cyrillic, hidden, brackets, words] if kind == 0 else [wide, hidden])(plain)
        text = f"Write: {shown} , please"
        found = [(k, text[s:e]) for k, s, e in pii.all_spans(text)[1]]
        assert (kind, shown) in found, (shown, found)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PLAIN[kind], text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [v if i % 2 == 0 else 2 * v - 9 * (2 * v > 9) for i, v in enumerate(reversed(digits))]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and sum(doubled) % 10 == 0) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_plain_findings_are_the_patterns():
    rng = random.Random(3)
    for _ in range(10000):
        t = "".join(rng.choice("ab0123456789..@@+- ()%x\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("1" * 200_000 + "." * 5 + "a" * 200_000 + "@") == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john.doe [at] mail7 [dot] example (dot) com now", ["john.doe [at] mail7 [dot] example (dot) com"]), ("john at example dot com", ["john at example dot com"]),
        ("j＠exаmple.com", ["j＠exаmple.com"]), ("call plus one two three four five five five one two one two", ["plus one two three four five five five one two one two"]),
        ("one nine two dot one six eight dot one dot one", ["one nine two dot one six eight dot one dot one"]), ("１９２.168.0.1", ["１９２.168.0.1"]),
        ("look at him dot he", []), ("The dot com era at noon", []), ("nine eight seven six", []), ("x@y.com", ["x@y.com"]),
    ],
)
def test_disguises(text, found):
    base, spans = pii.all_spans(text)
    assert [text[s:e] for _, s, e in spans] == found
    assert set(base) <= set(spans)


@pytest.mark.parametrize(
    "text, whole",
    [
        ("x jоhn@example.com y", "jоhn@example.com"), ("x a@mail.example [dot] com y", "a@mail.example [dot] com"), ("call +44 20 7946 ０９５８ now", "+44 20 7946 ０９５８"),
        ("call +44 20 7946 zero nine five eight.", "+44 20 7946 zero nine five eight"), ("mail anna at example dot it", "anna at example dot it"), ("mail anna at mail dot host dot example", "anna at mail dot host dot example"),
        ("write jane_at_example_dot_com now", "jane_at_example_dot_com"), ("write john dot doe at example dot com now", "john dot doe at example dot com"), ("write j-d-at-mail-dot-example-dot-org", "j-d-at-mail-dot-example-dot-org"), ("a [at] b (dot) com   [at] c", "a [at] b (dot) com"),
        ("𝐛𝐨𝐛@example.com", "𝐛𝐨𝐛@example.com"), ("bob at mail dot example dot tv", "bob at mail dot example dot tv"), ("ip ১.২.৩.৪ here", "১.২.৩.৪"), ("mail ᴀnnᴀ@example.com", "ᴀnnᴀ@example.com"),
    ],
)
def test_disguises_are_covered_whole(text, whole):
    at = text.index(whole)
    assert (at, at + len(whole)) in [(s, e) for _, s, e in pii.all_spans(text)[1]]


def test_texts_of_blanks_and_separators_take_linear_time():
    import time

    spelled = "mail john (at) example (dot) com "
    for filler in (" ", "\n", "( ", "1 ", "one ", "a dot ", "a_", "a-a ", ". ", "@ ", "at ", "+1 ", "1.", "(\t", "x@", "@x."):
        took = []
        for n in (20_000, 200_000):
            at = time.process_time()
            pii.all_spans(spelled + filler * n + spelled)
            took.append(time.process_time() - at)
        assert took[1] < 40 * took[0] + 0.5, filler


@pytest.mark.parametrize("text", ["look @ home. de la", "We arrived at some point after ten", "Write to a@b.com. In the end it. Is", "look at example.com", "he stared at the dot"])
def test_prose_is_no_disguise(text):
    base, more = pii.all_spans(text)
    assert base == more


def test_covering_masks_leave_no_pair_out():
    rng = random.Random(2)
    masks = simhash.covering_masks(4, 1)
    assert len(masks) == 31
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        assert any(m & flips == 0 for m in masks)


def test_least_of_components():
    rng = np.random.default_rng(3)
    for n in (1, 10, 60):
        a, b = rng.integers(-40, 40, (2, n))
        nodes, least = simhash.least_of_components(a, b)
        group = {x: {x} for x in {*a.tolist(), *b.tolist()}}
        for x, y in zip(a.tolist(), b.tolist()):
            both = group[x] | group[y]
            for z in both:
                group[z] = both
        assert dict(zip(nodes.tolist(), least.tolist())) == {x: min(g) for x, g in group.items()}
    assert len(simhash.least_of_components(a[:0], b[:0])[0]) == 0


def test_fingerprint_edges():
    import xxhash

    assert simhash.fingerprint(b" \n", 4) == 0
    one = xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(b"A\tB", 4) & (1 << 64) - 1 == one
    assert simhash.shingles_of(b"a b c d e", 4) == [b"a b c d", b"b c d e"]


def test_anchors_depend_on_windows_only():
    rng = random.Random(4)
    text = bytes(rng.choice(b"abc ") for _ in range(3000))
    at, first, count, _ = substring_dedup.anchors(text)
    assert count.sum() == len(text) - 99 and (first[1:] == first[:-1] + count[:-1]).all()
    assert ((at >= first + count - 1) & (at + 32 <= first + 100)).all()
    own = np.repeat(at, count)
    for p in range(0, len(text) - 100, 97):
        alone, _, _, _ = substring_dedup.anchors(text[p : p + 100])
        assert own[p] == p + alone[0]


def plain_article(page):
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", re.sub(r"<[^>]*\Z", "", m[1]))) if m else ()
    return "\n".join(p for p in parts if p)


def test_pages_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()
    assert all(html_text.main_text(r.html) == plain_article(r.html) for r in pages)


def test_pages_without_an_article():
    page = '<body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies.</div><div class="layout"><div class="sidebar"><p>Side, with commas, and so on.</p></div><div class="content"><h2>Title</h2><p>First para, long enough &eacute; to matter.</p><ul><li>one<li>two</ul><p>Second.<p>Third</div></div><section class="comments"><p>Nice post, really.</p></section><form>x</form><footer>foot</footer>'
    assert html_text.main_text(page) == "Title\nFirst para, long enough é to matter.\none\ntwo\nSecond.\nThird"
    assert html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<p>a<b>b</b> c") == "ab c"
    assert html_text.main_text("<div>" * 3000 + "x") == "x"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p title=it's>First para, here.</p><p>Second, isn't lost.</p><p>Third.</p></article>", "First para, here.\nSecond, isn't lost.\nThird."),
        ('<p data-x="a>b" class=\'c\'>Text, in it.</p>', "Text, in it."),
        ('<article><p>One, two.</p><div class="social-history"><p>The history, of it.</p></div><section id="related-work"><p>Others, too.</p></section></article>', "One, two.\nThe history, of it.\nOthers, too."),
        ('<body><div class="content with-sidebar"><article><h1>T</h1><p>Body, of text.</p></article></div><div class="sidebar"><p>Latest</p></div></body>', "T\nBody, of text."),
        ('<body><form action=/post><div><h1>Head</h1><p>A page within a form, with a sentence. And one more, of some length.</p><p>Last one, here.</p></div></form></body>', "Head\nA page within a form, with a sentence. And one more, of some length.\nLast one, here."),
        ("<body><main><article><p>First, of two.</p></article><article><p>Second, of two.</p></article></main><footer><p>Foot, of it.</p></footer></body>", "First, of two.\nSecond, of two."),
        ('<article><p>Long body of an article, with commas, and more of that.</p><div class="comments"><p>I like it.</p><p>Me too.</p></div><p>End.</p></article>', "Long body of an article, with commas, and more of that.\nEnd."),
        ("<body><h1>Lead</h1><div><p>The body of it, long enough to be the body, and so on.</p><p>Then more of it, long enough as well, and so on.</p></div><ul class=menu><li>a<li>b</ul></body>", "Lead\nThe body of it, long enough to be the body, and so on.\nThen more of it, long enough as well, and so on."),
    ],
)
def test_content_of_pages(page, want):
    assert html_text.main_text(page) == want


BODY = "<p>First para, with a comma, and a second sentence. And a third one.</p><p>Then another, as long as that, and no shorter. The end.</p>"
SHOWN = "First para, with a comma, and a second sentence. And a third one.\nThen another, as long as that, and no shorter. The end."


@pytest.mark.parametrize(
    "page",
    [
        f'<article>{BODY}</article><div class="comments"><p>{"A comment, longer than all of it. " * 40}</p></div>',
        f'<article>{BODY}<div class="comments"><p>{"A comment, longer than all of it. " * 40}</p></div></article>',
        f'<div id="cookie-consent"><p>{"We use cookies, and so on. " * 40}</p></div><article>{BODY}</article>',
        f'<article>{BODY}<ul><li><a href=x>Share on X</a></li><li><a href=y>Share on Y</a></li></ul></article>',
        f'<div><div>{BODY}</div><ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li></ul></div>',
        f'<form class="login"><p>{"Log in, or sign up. " * 40}</p></form><main>{BODY}</main>',
    ],
)
def test_boxes_of_any_length_and_lists_of_links_are_left_out(page):
    assert html_text.main_text(page) == SHOWN


def test_nothing_but_a_form():
    assert html_text.main_text('<form class="login"><p>Name, and password.</p></form>') == ""


def test_scores_decide(monkeypatch):
    """With the ratios made constant, and the prior as it is, unmarked lists of links come in."""
    page = f"<article>{BODY}<ul><li><a href=x>Share on X</a></li></ul></article>"
    assert html_text.main_text(page) == SHOWN
    scores = html_text.content_scores
    monkeypatch.setattr(html_text, "content_scores", lambda e, t: (scores(e, t)[1], scores(e, t)[1]))
    assert html_text.main_text(page) == f"{SHOWN}\nShare on X"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    data = warc.arc_version_block(version, "n") + b"\n" + warc.arc_record(version, "http://a/", b"line\nfeed", "n") + b"\n" + warc.arc_record(version, "u", b"", "n") + b"\n"
    got = list(warc.parse_arc(data))
    assert [(f["URL"], c) for f, c in got] == [("http://a/", b"line\nfeed"), ("u", b"")]
    assert len(got[0][0]) == (5 if version == 1 else 10)
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_arc(data[: data.index(b"feed")]))
    with pytest.raises(ValueError, match="within a header"):
        list(warc.parse_arc(data[:-12]))


def test_counts_of_plain_texts_are_those_of_packed_ones(spark):
    """One function a task counts texts that need no shuffle, slices are small, and thresholds pass no Python worker."""
    docs = spark.createDataFrame([(1, "en", "one two two"), (2, None, "é one"), (3, "en", None), (4, "en", "one two " * 400_000)], "doc_id long, lang string, text string")
    plain = quality.ngram_counts(docs.select(*quality._plain("text", "lang")))
    assert plain._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = quality.ngram_counts(quality._packed(docs, "text", "lang").select("lang", "packed"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, want.collect()))
    texts = [b"x" * 300_000] * 10
    assert max(sum(map(len, texts[a:b])) for a, b in quality._slices(texts)) <= 1 << 20
    assert [*quality._slices([b"x" * (3 << 20), b"y"])] == [(0, 1), (1, 2)]


def test_kneser_ney_sums_to_one(spark):
    docs = spark.createDataFrame([(1, "en", "abracadabra abba"), (2, "en", "cad bar abra")], "doc_id long, lang string, text string")
    model = quality.kneser_ney(quality.ngram_counts(quality._packed(docs, "text", "lang").select("lang", "packed")))
    ((_, _, packed),) = quality.shards(model)
    tables = quality._unpack(packed)
    for context in (b"\0\0\0\0", b"abra", b"zzzz", b"bra "):
        code = np.array([int.from_bytes(context + bytes([c]), "big") for c in range(256)])
        assert np.exp(quality._log_probabilities(code, tables, "en")).sum() == pytest.approx(1, abs=1e-4)


def plain_kneser_ney(texts):
    """Log probability of a text's bytes by dictionaries, as the recursive definition says."""
    from collections import defaultdict

    n = quality.ORDER
    counts = [defaultdict(int) for _ in range(n + 1)]
    for t in texts:
        t = bytes(n - 1) + t
        for i in range(n - 1, len(t)):
            counts[n][t[i - n + 1 : i + 1]] += 1
    for k in range(n - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] += 1
    discounts, contexts = {}, {}
    for k in range(1, n + 1):
        of = [sum(c == i for c in counts[k].values()) for i in range(5)]
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else 0
        raw = [i - (i + 1) * y * of[i + 1] / of[i] if of[i] and of[i + 1] and of[1] else i / 2 for i in (1, 2, 3)]
        discounts[k] = [max(0.0, min(i + 1.0, d)) for i, d in enumerate(raw)]
        took = {g: min(discounts[k][min(c, 3) - 1], c) for g, c in counts[k].items()}
        totals = defaultdict(lambda: [0, 0.0])
        for g, c in counts[k].items():
            totals[g[:-1]][0] += c
            totals[g[:-1]][1] += took[g]
        contexts[k] = (totals, took)

    def p(gram):
        if not gram:
            return 1 / 256
        totals, took = contexts[len(gram)]
        lower = p(gram[1:])
        if gram[:-1] not in totals:
            return lower
        total, mass = totals[gram[:-1]]
        return (counts[len(gram)].get(gram, 0) - took.get(gram, 0)) / total + mass / total * lower

    def log_probability(t):
        t = bytes(n - 1) + t
        return sum(np.log(p(t[i - n + 1 : i + 1])) for i in range(n - 1, len(t)))

    return log_probability


@pytest.mark.parametrize("shard_rows", [8_000_000, 4000])
def test_perplexities_are_the_plain_models(spark, shard_rows):
    rng = random.Random(9)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    trusted = [("en", text("abcde  .", rng.randrange(1, 200))) for _ in range(25)] + [("fr", text("abéè  ,", rng.randrange(1, 150))) for _ in range(15)]
    asked = [(i, g, t) for i, (g, t) in enumerate([("en", "abc de."), ("en", "zzz"), ("fr", "é a b"), ("de", "abc"), ("en", ""), ("fr", None), ("en", text("abcdefgh .", 900)), ("en", "abc de.")])]
    train = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(trusted)], "doc_id long, lang string, text string")
    model = quality.kneser_ney(quality.ngram_counts(quality._packed(train, "text", "lang").select("lang", "packed")))
    got = {r.doc_id: r.perplexity for r in quality.perplexities(spark.createDataFrame(asked, "doc_id long, lang string, text string"), model, shard_rows=shard_rows).collect()}
    plain = {g: plain_kneser_ney([t.encode() for x, t in trusted if x == g]) for g in ("en", "fr")}
    assert len(got) == len(asked)
    for i, g, t in asked:
        if not t or g not in plain:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(np.exp(-plain[g](t.encode()) / len(t.encode())), rel=1e-4)


def test_windows_of_items_without_an_id():
    from trivalent.llm.decontamination import PrefixIndex, Windows

    w = Windows([(None, b"a b c"), (1, b"A, b c"), (1, b"a b c")], 10)
    assert [set(i) for i in w.items] == [{None, 1}] and PrefixIndex(w, {}).hits(b"x a b c a b c")[2] == [0]


def test_limits_of_sparse_lengths_are_no_maximum():
    plain = [("en", 5, 1400 + i, 1) for i in range(200)] + [("fr", 5, 1300 + i, 1) for i in range(20)] + [("en", 7, 1450, 1)]
    odd = [("en", 2, 3000, 1), ("fr", 2, 2900, 1)]
    got = {(g, b): x for g, b, x in quality.limits(plain + odd)}
    assert set(got) == {(g, b) for g in ("en", "fr") for b in quality.BANDS}
    assert got["en", 7] < 1.61 and got["fr", 7] < 1.61 and got["fr", 5] < 1.61 and 1.59 < got["en", 5] < 1.6
    assert quality.limits([]) == []


def test_toxic_text_is_not_trusted(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, 0), (4, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted(r.trusted_id for r in quality._trusted(labels).collect()) == [1, 5]


def test_redact_any_names(spark):
    docs = spark.createDataFrame([(1, "a@b.co", 5), (1, "a@b.co", 5), (2, None, None)], "doc_id long, text string, `back``tick` int")
    want = [(1, "[email]", 5), (1, "[email]", 5), (2, None, None)]
    assert sorted(map(tuple, pii.redact(docs).collect())) == want
    assert pii.redact(docs.limit(0)).columns == docs.columns and pii.redact(docs.limit(0)).count() == 0


def test_archives_are_zipped_at_the_fast_level(spark, monkeypatch, tmp_path):
    words = random.Random(5).choices(["page", "line", "menu", "text", "article", "river", "house"], k=40_000)
    pages = spark.createDataFrame([(1, "http://a/", " ".join(words))], "page_id long, url string, html string")

    def size(folder):
        warc.write_arc(pages, folder)
        return sum(f.stat().st_size for f in (tmp_path / folder.rpartition("/")[2]).glob("part-*"))

    fast = size(f"{tmp_path}/fast")
    monkeypatch.setattr(warc, "GZIP_LEVEL", "DEFAULT_COMPRESSION")
    assert fast != size(f"{tmp_path}/default")
