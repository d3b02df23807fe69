"""Retrieval, deduplication and segmentation over documents, embeddings and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chunking, dedup, relations, retrieval

BM25_QUERIES = [(1, "the of and"), (2, "de la que"), (3, "der die und der")]


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as schemes with open-ended validity, for customers' wishes; unknown wishes filter nothing; counts by segment."""
    parts = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    schemes = parts.select("p_partkey", "p_brand", F.when(k % 4 != 0, F.col("p_size")).alias("low"), F.when(k % 6 != 0, F.col("p_size") + 15).alias("high"))
    wishes = spark.createDataFrame([(1, "Brand#11", 20), (2, None, 30), (3, "Brand#23", 10)], "wish int, brand string, size int")
    both = schemes.join(F.broadcast(wishes), retrieval.open_between(F.col("low"), F.col("high"), F.col("size")) & retrieval.matches_or_unknown(F.col("p_brand"), F.col("brand")))
    return both.groupBy("wish").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


def vector_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50, exact."""
    v = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")  # a stated query set against all
    return retrieval.nearest_by_cosine(q, v, "vec_id", "embedding", 5, 4)


def bm25_tf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieval.bm25_tf(_read(spark, sf_dir, "documents"), "doc_id", "text", BM25_QUERIES).withColumn("score", F.round("score", 6))
    return retrieval.top_k(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], 10)


def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical scores mixed with the cosine of equally numbered vectors to the query's."""
    lexical = retrieval.bm25_tf(_read(spark, sf_dir, "documents"), "doc_id", "text", BM25_QUERIES).withColumnRenamed("score", "lexical")
    v = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id in (1, 2, 3)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    dense = lexical.join(v, lexical.doc_id == v.vec_id).join(F.broadcast(q), "query_id").withColumn("dense", retrieval.cosine(F.col("q"), F.col("embedding")))
    scored = retrieval.hybrid(dense.select("query_id", "doc_id", "dense", "lexical"), "query_id", "dense", "lexical").select("query_id", "doc_id", F.round("score", 6).alias("score"))
    return retrieval.top_k(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], 10)


def stale_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without a document, and documents without a vector: what an index update has to do."""
    d, v = _read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "embeddings").select("vec_id")
    missing = d.join(v, d.doc_id == v.vec_id, "left_anti").agg(F.count("*").alias("n")).select(F.lit("to_add").alias("what"), "n")
    return missing.union(v.join(d, d.doc_id == v.vec_id, "left_anti").agg(F.count("*").alias("n")).select(F.lit("to_drop"), "n"))


def dedup_exact_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_by_hash(_read(spark, sf_dir, "documents"), "doc_id", F.sha2("text", 256))


def dedup_normalized_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_by_hash(_read(spark, sf_dir, "documents"), "doc_id", dedup.content_hash(F.col("text"))).where("doc_id <> original").select("doc_id", "original")


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts whose three-word shingles are similar to 0.7 or more, with their class."""
    pairs = dedup.jaccard_pairs(_read(spark, sf_dir, "documents"), "doc_id", "text", dedup.VERSION)
    return dedup.classify(pairs, F.col("a") % 2 == 0)


def canonical_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of chains in which a document points to the half of its number."""
    links = _read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.floor(F.col("doc_id") / 2)).alias("parent"))
    return dedup.canonical_roots(links, "doc_id", "parent")


def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks: a short line without a full stop is a heading, which holds for the lines after it; tokens by section."""
    from pyspark.sql import Window

    docs = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    heading = F.length("line").between(1, 40) & ~F.col("line").endswith(".")
    w = Window.partitionBy("doc_id").orderBy("i")
    rows = docs.withColumn("section", F.sum(heading.cast("int")).over(w))
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("blocks"), F.sum(F.length("line")).alias("chars"))


def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed greedily to chunks of at most 400 estimated tokens (a longer line alone): a fold along each document."""
    lines = F.transform(F.split("text", "\n"), lambda s: F.greatest(F.ceil(F.length(s) / 4), F.lit(1)).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("largest"))

    def step(a, n):
        fits = (a.open > 0) & (a.open + n <= 400)
        size = F.when(fits, a.open + n).otherwise(n)
        return F.struct(size.alias("open"), (a.chunks + F.when(fits, 0).otherwise(1)).alias("chunks"), F.greatest(a.largest, size).alias("largest"))

    return _read(spark, sf_dir, "documents").select("doc_id", F.aggregate(lines, start, step).alias("r")).select("doc_id", "r.chunks", "r.largest")


def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed with overlap, not cut before a line with "the" at its start (as provisos), and tiny chunks merged."""
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    tokens = F.transform("l", lambda s: F.greatest(F.ceil(F.length(s) / 4), F.lit(1)).cast("long"))
    bound = F.transform("l", lambda s: F.lower(s).startswith("the"))
    rows = lines.select("doc_id", bound.alias("b"), F.explode(F.array(chunking.sums(tokens))).alias("r"))  # the generator keeps the sums a column
    rows = rows.select("doc_id", "r", F.explode(F.array(chunking.packed(F.col("r"), F.col("b")))).alias("c"))
    sized = lambda c: F.transform(c, lambda x: chunking.size_of(F.col("r"), x))
    rows = rows.select("doc_id", "r", sized("c").alias("t"), F.explode(F.array(chunking.merged(F.col("r"), F.col("c")))).alias("m"))
    rows = rows.select("doc_id", "t", sized("m").alias("m"))
    return rows.select("doc_id", F.array_join("t", ",").alias("tokens"), F.array_join("m", ",").alias("merged"))


def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks, of which every fifth was forgotten."""
    blocks = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    chunks = blocks.where("i % 5 <> 3")
    out = chunking.coverage(blocks, chunks.unionByName(chunks.where("i = 0")), "doc_id", "i", chunking.is_boilerplate(F.when(F.col("i") == 7, "HEADER"), F.col("line")))
    return out


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' types as texts in which some words stand for the signals."""
    k = F.col("p_partkey")
    said = F.element_at(F.array(*map(F.lit, ("in supersession of", "shall be read as", "as amended by", "shall be  inserted", "for the removal of doubt", "validity extended to", "see the extension officer", ""))), (k % 8 + 1).cast("int"))
    name = F.when(k % 16 == 7, "amendment.pdf").otherwise("order.pdf")
    text = F.concat(said, F.lit(" "), F.when(k % 3 == 0, "order 12/2024").otherwise("a rule"))
    relation, strength = relations.relationship(text, name, F.lit("Order 12/2024"))
    return _read(spark, sf_dir, "part").groupBy(relation.alias("relation"), strength.alias("strength")).agg(F.count("*").alias("n"))


_W = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda x: length(x) > 1)"
_COS = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))"
_BM = f"""w AS (SELECT doc_id, {_W} AS w FROM documents), m AS (SELECT avg(len(w)) AS mean FROM w),
  q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'of'), (1, 'and'), (2, 'de'), (2, 'la'), (2, 'que'), (3, 'der'), (3, 'die'), (3, 'und'), (3, 'der')) AS q(query_id, token)),
  f AS (SELECT query_id::BIGINT AS query_id, doc_id, len(list_filter(w, lambda x: x = token))::DOUBLE AS tf, len(w) AS n, mean FROM w, m, q),
  b AS (SELECT query_id, doc_id, sum(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))) AS lexical FROM f GROUP BY ALL HAVING lexical > 0)"""
QUERIES = {f.__name__: f for f in (candidate_filter, vector_cosine_topk, bm25_tf_topk, hybrid_rank, stale_embeddings, dedup_exact_hash, dedup_normalized_hash, jaccard_pairs, canonical_root, section_carry_forward, chunk_packing, chunk_overlap, chunk_coverage, relationships)}
ORACLE_SQL = {
    "candidate_filter": """WITH w(wish, brand, size) AS (VALUES (1, 'Brand#11', 20), (2, NULL, 30), (3, 'Brand#23', 10)),
      s AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS low, CASE WHEN p_partkey % 6 <> 0 THEN p_size + 15 END AS high FROM part)
      SELECT wish, count(*) AS n, min(p_partkey) AS first_key FROM s, w WHERE (low IS NULL OR low <= size) AND (high IS NULL OR size <= high) AND (brand IS NULL OR p_brand = brand) GROUP BY wish""",
    "vector_cosine_topk": f"""SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, round(greatest(0, least(1, {_COS})), 4) AS similarity,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY round(greatest(0, least(1, {_COS})), 4) DESC, v.vec_id)::INT AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id) WHERE rank <= 5""",
    "bm25_tf_topk": f"WITH {_BM} SELECT query_id, doc_id, round(lexical, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 6) DESC, doc_id)::INT AS rank FROM b QUALIFY rank <= 10",
    "hybrid_rank": f"""WITH {_BM}, d AS (SELECT b.*, greatest(0, least(1, {_COS})) AS dense FROM b JOIN embeddings v ON v.vec_id = doc_id JOIN embeddings q ON q.vec_id = query_id),
      h AS (SELECT query_id, doc_id, round(0.65::DOUBLE * dense + (1 - 0.65::DOUBLE) * lexical / greatest(max(lexical) OVER (PARTITION BY query_id), 1), 6) AS score FROM d)
      SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM h QUALIFY rank <= 10""",
    "stale_embeddings": "SELECT 'to_add' AS what, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'to_drop', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)",
    "dedup_exact_hash": "SELECT doc_id, sha256(text) AS hash, min(doc_id) OVER (PARTITION BY text) AS original FROM documents",
    "dedup_normalized_hash": r"""WITH l AS (SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(text), '\r\n|\r|\n'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '' AND NOT regexp_full_match(s, '(page\s*)?[0-9]+(\s*(of|/)\s*[0-9]+)?')), chr(10)) AS k FROM documents)
      SELECT doc_id, original FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS original FROM l) WHERE doc_id <> original""",
    "jaccard_pairs": f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents),
      g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w),
      c AS (SELECT min(doc_id) AS doc_id, s FROM g WHERE len(s) > 0 GROUP BY s), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM c),
      p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING j >= 0.7)
      SELECT a, b, round(j, 4) AS similarity, CASE WHEN a % 2 = 0 THEN 'POSSIBLE_VERSION' WHEN round(j, 4) >= 0.98 THEN 'NEAR_DUPLICATE' ELSE 'NEW' END AS kind FROM p""",
    "canonical_root": """WITH RECURSIVE l AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id // 2 END AS parent FROM documents),
      r AS (SELECT doc_id, doc_id AS at FROM l UNION ALL SELECT r.doc_id, l.parent FROM r JOIN l ON l.doc_id = r.at WHERE l.parent IS NOT NULL)
      SELECT r.doc_id, r.at AS root FROM r JOIN l ON l.doc_id = r.at WHERE l.parent IS NULL""",
    "section_carry_forward": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
      s AS (SELECT *, sum((length(line) BETWEEN 1 AND 40 AND NOT line LIKE '%.')::INT) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS section FROM l) SELECT doc_id, section, count(*) AS blocks, sum(length(line))::BIGINT AS chars FROM s GROUP BY ALL""",
    "chunk_packing": """WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: greatest(ceil(length(s) / 4), 1)::BIGINT) AS n FROM documents),
      f AS (SELECT doc_id, n, 1 AS i, n[1] AS open, 1::BIGINT AS chunks, n[1] AS largest FROM l
        UNION ALL SELECT doc_id, n, i + 1, CASE WHEN open + n[i + 1] <= 400 THEN open + n[i + 1] ELSE n[i + 1] END, chunks + CASE WHEN open + n[i + 1] <= 400 THEN 0 ELSE 1 END,
          greatest(largest, CASE WHEN open + n[i + 1] <= 400 THEN open + n[i + 1] ELSE n[i + 1] END) FROM f WHERE i < len(n))
      SELECT doc_id, chunks, largest FROM f WHERE i = len(n)""",
    "chunk_overlap": r"""WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: greatest(ceil(length(s) / 4), 1)::BIGINT) AS n, list_transform(string_split(text, chr(10)), lambda s: lower(s) LIKE 'the%') AS b FROM documents),
      f AS (SELECT doc_id, n, b, 1 AS i, [n[1]] AS cur, []::STRUCT(f BIGINT, l BIGINT)[] AS done FROM l
        UNION ALL SELECT doc_id, n, b, i + 1, CASE WHEN list_sum(cur) + n[i + 1] > 400 AND NOT b[i + 1]
            THEN list_append(list_slice(cur, len(cur) + 1 - list_max(list_filter(range(0, len(cur) + 1), lambda k: coalesce(list_sum(list_slice(cur, len(cur) + 1 - k, len(cur))), 0) <= 200)), len(cur)), n[i + 1]) ELSE list_append(cur, n[i + 1]) END,
          CASE WHEN list_sum(cur) + n[i + 1] > 400 AND NOT b[i + 1] THEN list_append(done, {'f': (i - len(cur) + 1)::BIGINT, 'l': i::BIGINT}) ELSE done END FROM f WHERE i < len(n)),
      c AS (SELECT doc_id, n, list_append(done, {'f': (i - len(cur) + 1)::BIGINT, 'l': i::BIGINT}) AS t FROM f WHERE i = len(n)),
      z AS (SELECT doc_id, n, t, list_transform(t, lambda x: list_sum(list_slice(n, x.f, x.l))::BIGINT) AS s FROM c),
      m AS (SELECT doc_id, n, t, s, 0 AS i, []::STRUCT(f BIGINT, l BIGINT)[] AS o, false AS skip FROM z
        UNION ALL SELECT doc_id, n, t, s, i + 1, CASE WHEN skip THEN o WHEN s[i + 1] < 100 AND i + 1 < len(t) AND s[i + 1] + s[i + 2] <= 800 THEN list_append(o, {'f': least(t[i + 1].f, t[i + 2].f), 'l': greatest(t[i + 1].l, t[i + 2].l)})
          WHEN s[i + 1] < 100 AND len(o) > 0 AND s[i + 1] + list_sum(list_slice(n, o[len(o)].f, o[len(o)].l)) <= 800 THEN list_append(list_slice(o, 1, len(o) - 1), {'f': least(o[len(o)].f, t[i + 1].f), 'l': greatest(o[len(o)].l, t[i + 1].l)}) ELSE list_append(o, t[i + 1]) END,
          NOT skip AND s[i + 1] < 100 AND i + 1 < len(t) AND s[i + 1] + s[i + 2] <= 800 FROM m WHERE i < len(t))
      SELECT doc_id, array_to_string(s, ',') AS tokens, array_to_string(list_transform(o, lambda x: list_sum(list_slice(n, x.f, x.l))::BIGINT), ',') AS merged FROM m WHERE i = len(t)""",
    "chunk_coverage": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
      b AS (SELECT doc_id, i, i = 7 OR trim(line) = '' OR (length(trim(line)) < 40 AND regexp_matches(trim(line), '(?i)https?://|www[.]|page\s*[0-9]+|^[0-9]+$')) AS bp FROM l),
      g AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (bp) AS boilerplate, count(*) FILTER (NOT bp AND i % 5 <> 3) AS covered, count(*) FILTER (NOT bp AND i % 5 = 3) AS missing FROM b GROUP BY 1)
      SELECT *, CASE WHEN covered + missing > 0 THEN round(covered / (covered + missing), 4) ELSE 1 END AS coverage FROM g""",
    "relationships": r"""WITH p AS (SELECT (['in supersession of', 'shall be read as', 'as amended by', 'shall be  inserted', 'for the removal of doubt', 'validity extended to', 'see the extension officer', ''])[p_partkey % 8 + 1]
        || CASE WHEN p_partkey % 3 = 0 THEN ' order 12/2024' ELSE ' a rule' END AS text, CASE WHEN p_partkey % 16 = 7 THEN 'amendment.pdf' ELSE 'order.pdf' END AS file FROM part),
      r AS (SELECT CASE WHEN regexp_matches(text, 'supersession|superseded') THEN 'SUPERSEDES' WHEN regexp_matches(text, 'be\s+read\s+as|corrigendum') THEN 'CORRIGENDUM_TO' WHEN regexp_matches(text, 'amended|amendment|substituted') THEN 'AMENDS'
        WHEN regexp_matches(text, 'addendum|be\s+inserted') THEN 'ADDENDUM_TO' WHEN regexp_matches(text, 'clarif|removal\s+of\s+doubt') THEN 'CLARIFIES' WHEN regexp_matches(text, '(validity|deadline)\s+extended') THEN 'EXTENDS' END AS said,
        file LIKE '%amendment%' AS weak, text LIKE '%order 12/2024%' AS cited FROM p)
      SELECT coalesce(said, CASE WHEN weak THEN 'AMENDS' WHEN cited THEN 'REFERENCES' END) AS relation, CASE WHEN said IS NOT NULL THEN CASE WHEN cited THEN 'EXPLICIT' ELSE 'STRONG' END WHEN weak THEN 'WEAK' WHEN cited THEN 'EXPLICIT' END AS strength, count(*) AS n FROM r GROUP BY ALL""",
}
