"""Quality classifier: interpolated modified Kneser-Ney n-grams of bytes, trained on trusted text, one model a language.

Counting: every trusted document adds its n-grams; tasks add up their own before the shuffle.
The orders below the highest count distinct left neighbours. Probabilities and back-off
weights are made by joins between the count tables of neighbouring orders.

Scoring: the model's rows are cut into shards by the two bytes before the predicted one, which
all its longer n-grams share, so that a document's log probability is the sum of its shards'.
Shards are as many as keep each within a stated number of rows. Tasks sort and pack them, each is
sent to all tasks as compressed bytes, and the documents are read once a shard: no n-gram of a
document is ever shuffled, as these would be ten times the text.

Thresholds: a tenth of the trusted documents is left out of the counts. Their perplexities'
quantile, by language and length, decides: a document above it is rejected.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, map_columns, schema_of, table, text_bytes

ORDER = 5
#: Model rows in a shard: 12 bytes each once loaded, fewer as they are sent.
SHARD_ROWS = 8_000_000
HELD_OUT = 10
QUANTILE, MARGIN = 0.99, 0.15
#: Ids of trusted documents that are sent to all tasks at most; beyond that the join with the texts is shuffled.
SMALL_ROWS = 500_000
#: A language and length lends from others as much as this number of documents counts, with weights of NEAR to the power of
#: the bands between, times ABROAD for other languages. Steps of the logarithm in which documents are counted.
LENT, NEAR, ABROAD, STEP = 100, 0.25, 0.5, 0.001


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER bytes that end at each byte of the texts as numbers (zero bytes before a text), and the texts' lengths."""
    pad = bytes(ORDER - 1)
    b = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    code = np.zeros(max(len(b) - ORDER + 1, 0), np.int64)
    for i in range(ORDER):
        code = code << 8 | b[i : len(code) + i]
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    own = np.zeros(len(code) + 1, np.int64)
    inside = np.zeros(len(b) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + lengths, -1)
    own = np.cumsum(inside)[: len(code)] > 0
    return code[own], lengths


def _slices(texts, most=1 << 20):
    """Index ranges of about `most` bytes, so that one slice bounds the memory of a step (some 50 bytes a byte of text); a longer text is alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def ngram_counts(trusted: DataFrame) -> DataFrame:
    """lang, code, n over documents with columns lang and packed (zstd-compressed UTF-8), or lang and text (bytes).

    Texts that weren't shuffled needn't be packed: packing them is another function in the same task, and so another worker that keeps its memory."""
    plain = "text" in trusted.columns

    def make():
        import zstandard

        def each(lang, given):
            unpack = bytes if plain else zstandard.ZstdDecompressor().decompress
            out = []
            for name in sorted(set(lang)):
                texts = [unpack(p) for g, p in zip(lang, given) if g == name]
                for a, b in _slices(texts):
                    code, n = np.unique(_codes(texts[a:b])[0], return_counts=True)
                    out.append((np.full(len(code), name, object), code, n))
            if not out:
                return [], [], []
            names, code, n = (np.concatenate(x) for x in zip(*out))
            return pa.array(names, pa.string()), pa.array(code), pa.array(n)

        return each

    return map_columns(trusted.select("lang", "text" if plain else "packed"), make, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _plain(text: str, lang: str) -> list:
    return [F.coalesce(lang, F.lit("")).alias("lang"), text_bytes(text).alias("text")]


def _packed(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Texts are compressed for the one shuffle that brings them together with their labels."""

    def make():
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        return lambda doc_id, lang, text: (doc_id, lang, [pack(t) for t in text])

    return map_columns(docs.select("doc_id", *_plain(text, lang)), make, "doc_id long, lang string, packed binary")


def _order_tables(counts: DataFrame) -> list[DataFrame]:
    """For each order from 1: lang, code, n (raw counts at the highest, distinct left neighbours below)."""
    tables = [counts]
    for k in range(ORDER - 1, 0, -1):
        tables.append(checkpointed(tables[-1].groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code")).agg(F.count("*").alias("n"))))
    return tables[::-1]


def _discounts(rows: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: the modified Kneser-Ney discounts from the counts of counts."""
    c = rows.groupBy("lang").agg(*(F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0) & (F.col("n1") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(F.lit(i / 2)) for i in (1, 2, 3)]
    return c.select("lang", *(F.greatest(F.lit(0.0), F.least(F.lit(float(i + 1)), x)).alias(f"d{i + 1}") for i, x in enumerate(d)))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """k, lang, back_off (whether the row is a context's weight), code, value (natural logarithm).

    k is the n-gram's order; a context's code has k - 1 bytes."""
    below, out = None, None
    for k, rows in enumerate(_order_tables(counts), 1):
        d = F.broadcast(_discounts(rows))  # a row a language
        rows = rows.join(d, "lang").withColumn("context", F.shiftright("code", 8))
        took = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.withColumn("took", F.least(took, F.col("n").cast("double")))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("took").alias("mass"))
        contexts = contexts.withColumn("weight", F.col("mass") / F.col("total"))
        p = rows.join(contexts.select("lang", "context", "total", "weight"), ["lang", "context"])
        if below is None:
            p = p.withColumn("lower", F.lit(1 / 256))
        else:
            p = p.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below.select("lang", F.col("code").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
        p = p.select("lang", "code", ((F.col("n") - F.col("took")) / F.col("total") + F.col("weight") * F.col("lower")).alias("p"))
        p = below = checkpointed(p)
        weights = contexts.select(F.lit(k).alias("k"), "lang", F.lit(True).alias("back_off"), F.col("context").alias("code"), F.log("weight").cast("float").alias("value"))
        made = p.select(F.lit(k).alias("k"), "lang", F.lit(False).alias("back_off"), "code", F.log("p").cast("float").alias("value")).union(weights)
        out = made if out is None else out.union(made)
    return checkpointed(out.where("value > -1e30"))


def _pair(row_code, back_off):
    """The two bytes before the predicted one."""
    return F.when(back_off, row_code).otherwise(F.shiftright(row_code, 8)).bitwiseAND(F.lit(0xFFFF))


def _pack(groups: dict) -> bytes:
    """Tables of a shard, {(k, back_off, lang): (sorted codes, values)}, as compressed bytes: neighbouring codes differ little."""
    import zstandard

    parts = [(key, np.diff(code, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), value.astype("<f4").view(np.uint8).reshape(-1, 4).T.tobytes()) for key, (code, value) in groups.items()]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts))


def _unpack(packed: bytes) -> dict:
    import zstandard

    def plain(data, dtype, width):
        return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()

    return {key: (np.cumsum(plain(code, "<i8", 8)), plain(value, "<f4", 4)) for key, code, value in pickle.loads(zstandard.ZstdDecompressor().decompress(packed))}


def _shard_rows(batches):
    """Rows (part, k, back_off, lang, code, value) in order: part and its packed tables, a row a part."""
    part, pieces = None, {}

    def made():
        groups = {key: tuple(np.concatenate(x) for x in zip(*found)) for key, found in pieces.items()}
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([_pack(groups)], pa.binary())], names=["part", "packed"])

    for b in batches:
        if not b.num_rows:
            continue
        number, k, back_off, lang = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3).dictionary_encode()
        code, value, names, which = b.column(4).to_numpy(), b.column(5).to_numpy(), lang.dictionary.to_pylist(), lang.indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (k[1:] != k[:-1]) | (back_off[1:] != back_off[:-1]) | (which[1:] != which[:-1])])
        for s, e in zip(starts, [*starts[1:], len(number)]):
            if part is not None and number[s] != part:
                yield made()
                pieces = {}
            part = int(number[s])
            pieces.setdefault((int(k[s]), bool(back_off[s]), names[which[s]]), []).append((code[s:e].copy(), value[s:e].copy()))
    if part is not None:
        yield made()


def packed_shards(model: DataFrame, rows: int = SHARD_ROWS) -> tuple[int, DataFrame]:
    """How many parts the model has, and a row (part, packed) for each.

    Rows of the orders 1 and 2 are in every part: there are at most 2^16 + 2^9 a language. The number of parts
    doubles until every part has at most `rows` rows besides those, or each has one pair of bytes. Tasks sort and pack
    the parts: no row of the model passes the driver."""
    long = (F.col("k") > 2) & ~(F.col("back_off") & (F.col("k") == 2))
    keyed = model.withColumn("pair", F.when(long, _pair(F.col("code"), F.col("back_off"))))
    pairs = np.array([(r.pair, r.n) for r in keyed.where("pair is not null").groupBy("pair").agg(F.count("*").alias("n")).collect()] or [(0, 0)], np.int64)  # at most 65536
    n = 1
    while n < 65536 and np.bincount(pairs[:, 0] % n, pairs[:, 1]).max() > max(rows, pairs[:, 1].max()):
        n *= 2
    parts = F.when(F.col("pair").isNull(), F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).otherwise(F.array((F.col("pair") % n).cast("long")))
    dealt = keyed.select(F.explode(parts).alias("part"), "k", "back_off", "lang", "code", "value")
    order = dealt.repartition(n, "part").sortWithinPartitions("part", "k", "back_off", "lang", "code")
    return n, checkpointed(order.mapInArrow(_shard_rows, schema_of("part long, packed binary")))


def shards(model: DataFrame, rows: int = SHARD_ROWS):
    """The model in parts: (number, of how many, packed tables), of which the driver takes one at a time to send it to all tasks."""
    n, packed = packed_shards(model, rows)
    for i in range(n):
        row = packed.where(F.col("part") == i).first()
        yield i, n, bytes(row.packed) if row else _pack({})


def _log_probabilities(code: np.ndarray, tables: dict, lang: str) -> np.ndarray:
    """Of each code's last byte after the others: the longest known n-gram's, and the weights of known contexts above it."""
    out, left = np.zeros(len(code), np.float64), np.arange(len(code))
    for k in range(ORDER, 0, -1):
        own = code[left] & ((1 << 8 * k) - 1)
        at, found, value = _find(tables, (k, False, lang), own)
        out[left[found]] += value
        left, own = left[~found], own[~found]
        if not len(left):
            return out
        at, found, value = _find(tables, (k, True, lang), own >> 8)
        out[left[found]] += value
    out[left] += np.log(1 / 256)
    return out


def _find(tables, key, codes):
    known, values = tables.get(key, (np.empty(0, np.int64), np.empty(0, np.float32)))
    if not len(known):
        return None, np.zeros(len(codes), bool), np.empty(0)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    found = known[at] == codes
    return at, found, values[at[found]]


def perplexities(docs: DataFrame, model: DataFrame, text: str = "text", lang: str = "lang", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each row of docs: doc_id, lang, n_bytes, perplexity, text_hash (xxhash64 of the text).

    Null languages count as '' and null texts as empty. Empty texts, and languages without trusted text, have no perplexity."""
    docs = docs.select("doc_id", *_plain(text, lang))
    parts = []
    for number, of, packed in shards(model, shard_rows):
        shared = docs.sparkSession.sparkContext.broadcast(packed)

        def make(shared=shared, number=number, of=of):
            tables = _unpack(shared.value)
            known = {x[2] for x in tables}

            def each(row, doc_id, lang, text):
                total = np.full(len(text), np.nan)
                for name in known & set(lang):
                    at = [i for i, g in enumerate(lang) if g == name]
                    for a, b in _slices([text[i] for i in at]):
                        code, lengths = _codes([text[i] for i in at[a:b]])
                        document = np.repeat(np.arange(b - a), lengths)
                        if of > 1:  # what another part holds isn't looked up
                            own = (code >> 8 & 0xFFFF) % of == number
                            code, document = code[own], document[own]
                        unique, inverse = np.unique(code, return_inverse=True)
                        value = _log_probabilities(unique, tables, name)
                        total[np.array(at[a:b])] = np.bincount(document, value[inverse], minlength=b - a)
                return row, doc_id, lang, [len(t) for t in text], pa.array(total, from_pandas=True)

            return each

        parts.append(map_columns(docs.select(F.xxhash64("text").alias("text_hash"), "doc_id", "lang", "text"), make, "text_hash long, doc_id long, lang string, n_bytes long, total double"))
    out = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            out = out.union(p)
        n = len(parts)
        out = out.groupBy("text_hash", "doc_id", "lang", "n_bytes").agg(F.sum("total").alias("total"), (F.count("*") / n).cast("long").alias("rows"))
        out = out.select("text_hash", "doc_id", "lang", "n_bytes", (F.col("total") / F.col("rows")).alias("total"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return out.select("doc_id", "lang", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(-F.col("total") / F.col("n_bytes"))).alias("perplexity"), "text_hash")


BANDS = range(2, 8)


def _band(n_bytes):
    """Length band: a perplexity of fewer bytes varies more."""
    return F.least(F.lit(BANDS[-1]), F.greatest(F.lit(BANDS[0]), F.floor(F.log2(n_bytes + F.lit(1)) / 2))).cast("int")


def limits(counts: list[tuple[str, int, int, int]], quantile: float = QUANTILE) -> list[tuple[str, int, float]]:
    """(lang, band, x) for every band of every language in counts (lang, band, x in steps, documents): the quantile of x.

    A language's and band's own documents count fully. All others count as LENT of these at most, nearer bands and the
    same language more, by their distance from their language's median: so the more documents a band has, the more is its
    quantile its own, and no odd one of another length sets it."""
    langs = sorted({c[0] for c in counts})
    lang, band = np.array([langs.index(c[0]) for c in counts], int), np.array([c[1] for c in counts], int)
    x, n = np.array([c[2] for c in counts], float), np.array([c[3] for c in counts], float)

    def at(x, weight, share):
        order = np.argsort(x, kind="stable")
        below = np.cumsum(weight[order])
        return x[order][min(np.searchsorted(below, share * below[-1] * (1 - 1e-12)), len(x) - 1)]

    middle = np.array([at(x[lang == g], n[lang == g], 0.5) for g in range(len(langs))])
    out = []
    for g, name in enumerate(langs):
        for b in BANDS:
            own = (lang == g) & (band == b)
            lent = np.where(own, 0, n * NEAR ** np.abs(band - b) * np.where(lang == g, 1, ABROAD))
            weight = np.where(own, n, lent * min(1, LENT / max(lent.sum(), 1e-9)))
            out.append((name, b, float((at(x - middle[lang], weight, quantile) + middle[g] + 1) * STEP)))
    return out


def _trusted(labels: DataFrame) -> DataFrame:
    """Ids whose labels all say quality 1 and none toxic: labels may repeat, and a null toxic isn't."""
    ids = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("trusted_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return ids.where("quality = 1 and toxic = 0").select("trusted_id", (F.pmod(F.xxhash64("trusted_id"), F.lit(HELD_OUT)) == 0).alias("held"))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each row of docs: doc_id, lang, n_bytes, perplexity, threshold, keep, text_hash.

    Rejected is what lies above the threshold of its language and length: the held-out trusted documents' quantile of the
    logarithm, plus margin; where these are few, other lengths and languages lend some (see limits). What has no perplexity or no
    threshold can't be judged and is kept: empty and null texts, and languages without trusted text. A perplexity of just the threshold
    stays. Null ids are scored like any other and repeated rows each; an empty table gives an empty result; other columns are ignored."""
    trusted = _trusted(labels)
    train = checkpointed(trusted.where("not held").select("trusted_id"))
    if train.count() <= SMALL_ROWS:  # 8 bytes each: sent to all tasks, so that no text is shuffled
        own = docs.select("doc_id", text, lang)
        train = own.join(F.broadcast(train), own.doc_id == F.col("trusted_id"), "left_semi").select(*_plain(text, lang))
    else:
        packed = _packed(docs, text, lang)
        train = packed.join(train, packed.doc_id == F.col("trusted_id"), "left_semi").select("lang", "packed")
    model = kneser_ney(checkpointed(ngram_counts(train)))
    scored = checkpointed(perplexities(docs, model, text, lang, shard_rows))
    held = scored.where("perplexity is not null").join(trusted.where("held"), scored.doc_id == F.col("trusted_id")).select("lang", _band(F.col("n_bytes")).alias("band"), F.log("perplexity").alias("x"))
    counts = held.groupBy("lang", "band", F.floor(F.col("x") / STEP).alias("step")).count().collect()  # as many as steps, not as documents
    found = limits([tuple(c) for c in counts], quantile)
    columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.float64()))]
    bounds = docs.sparkSession.createDataFrame(pa.table(columns, ["lang", "band", "q"]))  # of an Arrow table, as rows would pass Python workers
    out = scored.withColumn("band", _band(F.col("n_bytes"))).join(F.broadcast(bounds), ["lang", "band"], "left")
    threshold = F.exp(F.col("q") + F.lit(margin))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("keep"), "text_hash")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the model of its language's trusted documents, and whether it stays."""
    return classify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")).drop("text_hash")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without what the classifier rejects, in all their columns."""
    from .corpus import matching

    return matching(docs, classify(docs, labels, text=text, **options).where("not keep"), "left_anti", text)
