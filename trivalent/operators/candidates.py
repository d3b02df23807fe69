"""Which of several bases a new document may belong to: blocked, scored once a pair, and told apart from what is ambiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sizes import written

#: Similarity of titles from which a base is a candidate, and how much better the best must be than the second.
LIKE, GAP = 0.5, 0.1


#: Longs of 64 bits that hold a title's tokens, a bit each.
LONGS = 4
_BITS = "aggregate(transform(tokens, t -> xxhash64(t)), 0L, (s, h) -> s | if(pmod(h, {n}) = {i}, shiftleft(1L, cast(pmod(shiftright(h, 8), 64) as int)), 0L))"


def _prefixes(rows: DataFrame, counts: DataFrame, id: str, like: float) -> DataFrame:
    """id, department, token, nth, size and bits for the rarest tokens of each title: so many that two titles alike enough share one of them."""
    bits = [f"bits{i}" for i in range(LONGS)]
    tokens = rows.select(id, "department", F.size("tokens").alias("size"), *bits, F.explode("tokens").alias("token")).join(counts, ["department", "token"])
    nth = F.row_number().over(Window.partitionBy(id).orderBy("n", "token"))  # one title's tokens
    return tokens.withColumn("nth", nth).where(F.col("nth") <= F.col("size") - F.ceil(F.col("size") * like - 1e-9) + 1).select(id, "department", "token", "nth", "size", *bits)


def _may_be_alike(like: float):
    """What must hold of two titles x and y of one department that are alike enough, at the rarest token that they share: so many tokens are left from it on in both, and so few
    bits differ, that they can share enough. Tells nearly all pairs that only share a word, before they are shuffled."""
    least = F.ceil((F.col("x.size") + F.col("y.size")) * like / (1 + like) - 1e-9)
    differing = sum((F.bit_count(F.col(f"x.bits{i}").bitwiseXOR(F.col(f"y.bits{i}"))) for i in range(LONGS)), F.lit(0))
    same = (F.col("x.department") == F.col("y.department")) & (F.col("x.token") == F.col("y.token"))
    return same & (F.col("x.size") - F.col("x.nth") + 1 >= least) & (F.col("y.size") - F.col("y.nth") + 1 >= least) & (differing <= F.col("x.size") + F.col("y.size") - 2 * least)


def _name(title: str = "title"):
    return F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))


def candidates(new: DataFrame, bases: DataFrame, like: float = LIKE) -> DataFrame:
    """new_id, base_id, kind, score, n_same for documents (new_id, citation, title, tokens, department) and bases (base_id, citation, title, tokens, department).

    CITATION (1.0): the same citation. NAME (0.95): the same title in the same department. TITLE: the Jaccard similarity of the titles' token
    sets, of `like` or more, in one department. A pair has its best reason. Nulls and empty titles match nothing.

    Bases that share a citation, or a title in one department, are one, told by the smallest id, and n_same says how many they are; documents of one
    title are compared once. So copies are not multiplied with copies. Pairs of titles are found by equal tokens only, so
    rare that similar titles share one; a frequent token is looked at only in titles of frequent ones. Of these only pairs
    whose sizes and tokens' bits allow the similarity leave the join."""
    cites = bases.where("citation <> ''").groupBy("citation").agg(F.min("base_id").alias("base_id"), F.count("*").alias("n_same"))
    cited = new.select("new_id", "citation").join(cites, "citation").select("new_id", "base_id", F.lit("CITATION").alias("kind"), F.lit(1.0).alias("score"), "n_same")
    bits = [F.expr(_BITS.format(n=LONGS, i=i)).alias(f"bits{i}") for i in range(LONGS)]
    titles = lambda df, id: df.select(id, "department", _name().alias("name"), F.array_sort(F.array_distinct("tokens")).alias("tokens")).where("name <> ''").groupBy("department", "name").agg(F.min(id).alias(id), F.count("*").alias("n_same"), F.min("tokens").alias("tokens")).select("*", *bits)
    a, b = written(titles(new, "new_id").withColumnRenamed("new_id", "title_id")), written(titles(bases, "base_id"))
    named = a.select("title_id", "department", "name").join(b.select("base_id", "department", "name", "n_same"), ["department", "name"]).select("title_id", "base_id", F.lit("NAME").alias("kind"), F.lit(0.95).alias("score"), "n_same")
    a_sets, b_sets = a.where("size(tokens) > 0"), b.where("size(tokens) > 0")
    counts = a_sets.select("department", "tokens").union(b_sets.select("department", "tokens")).select("department", F.explode("tokens").alias("token")).groupBy("department", "token").agg(F.count("*").alias("n"))
    x, y = _prefixes(a_sets, counts, "title_id", like), _prefixes(b_sets, counts, "base_id", like)
    pairs = x.alias("x").join(y.alias("y"), _may_be_alike(like)).select("title_id", "base_id").distinct()
    both = pairs.join(a_sets.select("title_id", F.col("tokens").alias("t")), "title_id").join(b_sets.select("base_id", F.col("tokens").alias("u"), "n_same"), "base_id")
    shared = F.size(F.array_intersect("t", "u"))
    titled = both.select("title_id", "base_id", F.lit("TITLE").alias("kind"), (shared / (F.size("t") + F.size("u") - shared)).alias("score"), "n_same").where(F.col("score") >= like)
    of_titles = named.union(titled).groupBy("title_id", "base_id").agg(F.max(F.struct("score", "kind", "n_same")).alias("m")).select("title_id", "base_id", "m.kind", "m.score", "m.n_same")
    of_documents = new.select("new_id", "department", _name().alias("name")).join(a.select("department", "name", "title_id"), ["department", "name"]).select("new_id", "title_id")
    every = cited.unionByName(of_documents.join(of_titles, "title_id").drop("title_id"))
    every = every.groupBy("new_id", "base_id").agg(F.max(F.struct("score", "kind", "n_same")).alias("m"))
    return every.select("new_id", "base_id", "m.kind", F.round("m.score", 4).alias("score"), "m.n_same")


def best_base(found: DataFrame, gap: float = GAP) -> DataFrame:
    """new_id, base_id, kind, score, n_bases, conflict: each document's best base (of ties the smallest id); a conflict if that is several, or another is within gap of it."""
    scores = found.groupBy("new_id", "score").agg(F.min(F.struct("base_id", "kind", "n_same")).alias("m"), F.count("*").alias("n"))  # few: a score has four digits
    every = scores.groupBy("new_id").agg(F.max_by("m", "score").alias("m"), F.sum("n").alias("n_bases"), F.max("score").alias("score"), F.collect_list(F.struct("score", "n")).alias("l"))
    near = F.aggregate(F.filter("l", lambda x: F.round(F.col("score") - x.score, 4) < gap), F.lit(0).cast("long"), lambda s, x: s + x.n)
    return every.select("new_id", "m.base_id", "m.kind", "score", "n_bases", ((near > 1) | (F.col("m.n_same") > 1)).alias("conflict"))
