"""Rule trees kept as JSON: their nodes as rows, signatures that don't depend on the order of children, and the changes between two trees.

Everything works a level at a time, on rows. Signatures grow from the leaves up; a comparison goes from the roots down and leaves whatever has
equal signatures, so that its work is in what differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import dealt, written

# Fields whose conditions are critical, and the names that groups go by.
CRITICAL = ("age", "min_age", "max_age", "family_income", "annual_income", "income", "caste", "category", "gender", "domicile", "residency", "disability_percentage", "land_holding_acres")
GROUPS = {"AND": "AND", "ALL": "AND", "OR": "OR", "ANY": "OR", "NOT": "NOT"}


def _kind(v: Column) -> Column:
    named = F.upper(F.coalesce(*(F.try_variant_get(v, f"$.{n}", "string") for n in ("type", "logical_operator", "group_type", "logic"))))
    return F.create_map(*(F.lit(x) for pair in GROUPS.items() for x in pair))[named]


def _value(v: Column) -> Column:
    """A condition's value as comparable text: numbers without trailing noughts, lists sorted, text trimmed and in lower case."""
    plain = lambda x: F.coalesce(F.regexp_replace(F.try_variant_get(x, "$", "decimal(30,8)").cast("string"), r"\.?0+$", ""), F.lower(F.trim(F.try_variant_get(x, "$", "string"))))
    one = F.try_variant_get(v, "$.value", "variant")
    many = F.try_variant_get(v, "$.value", "array<variant>")
    number = F.when(F.schema_of_variant(one).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.regexp_replace(F.try_variant_get(one, "$", "decimal(30,8)").cast("string"), r"\.?0+$", ""))
    return F.coalesce(F.when(many.isNotNull(), F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(many, plain)), ","), F.lit("]"))), number, F.lower(F.trim(F.try_variant_get(one, "$", "string"))), F.to_json(one))


def nodes(rules: DataFrame, id: str, json: str) -> DataFrame:
    """id, path, parent, pos, depth, kind, field, op, value for every node of the rule trees in a column of JSON text.

    What has a field is a condition (COND), fields in lower case; what else has no known kind of group is a group of kind AND. Null or broken texts have no nodes."""
    v = F.col("v")
    level = dealt(rules.select(id, json), id).select(id, F.lit("0").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("pos"), F.lit(0).alias("depth"), F.try_parse_json(json).alias("v")).where("v is not null")
    level, found = written(level), None
    while not level.isEmpty():
        field = F.lower(F.trim(F.try_variant_get(v, "$.field", "string")))
        is_condition = F.coalesce(field != "", F.lit(False))
        own = lambda c: F.when(is_condition, c)
        here = level.select(id, "path", "parent", "pos", "depth", F.when(is_condition, "COND").otherwise(F.coalesce(_kind(v), F.lit("AND"))).alias("kind"), own(field).alias("field"), own(F.upper(F.coalesce(F.try_variant_get(v, "$.operator", "string"), F.lit("EQ")))).alias("op"), own(_value(v)).alias("value"))
        found = here if found is None else found.union(here)
        children = level.where(~is_condition).select(id, F.col("path").alias("parent"), "depth", F.posexplode(F.try_variant_get(v, "$.children", "array<variant>")).alias("pos", "v"))
        level = written(children.where(F.schema_of_variant("v").startswith("OBJECT")).select(id, F.concat("parent", F.lit("."), F.col("pos").cast("string")).alias("path"), "parent", "pos", (F.col("depth") + 1).alias("depth"), "v"))
    empty = level.select(id, "path", "parent", "pos", "depth", *(F.lit(None).cast("string").alias(c) for c in ("kind", "field", "op", "value")))
    return found if found is not None else empty


def signatures(tree: DataFrame, id: str) -> DataFrame:
    """tree with a signature of each node: equal where trees are equal but for the order of children of AND and OR (not of NOT)."""
    deepest = tree.agg(F.max("depth")).first()[0]
    if deepest is None:
        return tree.withColumn("signature", F.lit(None).cast("string"))
    out, below = None, None
    for depth in range(deepest, -1, -1):
        here = tree.where(F.col("depth") == depth)
        own = F.sha2(F.to_json(F.array(F.lit("COND"), "field", "op", F.coalesce("value", F.lit("null")))), 256)
        if below is None:
            here = here.withColumn("inside", F.lit(""))
        else:
            both = below.join(here.select(id, F.col("path").alias("parent"), F.col("kind").alias("of")), [id, "parent"])
            sorts = F.struct(F.when(F.col("of") == "NOT", F.col("pos")).otherwise(0).alias("pos"), "signature")
            inner = both.groupBy(id, F.col("parent").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(sorts)), lambda x: x["signature"]), ",").alias("inside"))
            here = here.join(inner, [id, "path"], "left")
        group = F.sha2(F.concat("kind", F.lit(":["), F.coalesce("inside", F.lit("")), F.lit("]")), 256)
        here = written(here.withColumn("signature", F.when(F.col("kind") == "COND", own).otherwise(group)).drop("inside"))
        out, below = here if out is None else out.union(here), here.select(id, "parent", "pos", "signature")
    return out


def changes(base: DataFrame, new: DataFrame, id: str, partial: bool = True) -> DataFrame:
    """id, field, change, risk, old, new: what makes the trees of base and new (as from nodes) differ, by id.

    MODIFY is a group of another kind (its field is the path in base), ADD, REPLACE and REMOVE are of conditions; old and new are `operator value`.
    If new is partial (an amendment), silence removes nothing. Children are paired by signature first, groups then by kind and order, or else by order;
    conditions that are left are paired by field and order in the whole tree. Trees that only one side has are no changes."""
    columns = ("path", "parent", "pos", "depth", "kind", "field", "op", "value", "signature")
    a = written(signatures(base, id).select(id, *(F.col(c).alias(f"a_{c}") for c in columns)))
    b = written(signatures(new, id).select(id, *(F.col(c).alias(f"b_{c}") for c in columns)))
    pairs = a.where("a_depth = 0").join(b.where("b_depth = 0"), id).where("a_signature <> b_signature")
    left_a, left_b, groups, n = [], [], [], 0
    while True:
        pairs = written(pairs.select(id, *(f"{s}_{c}" for s in "ab" for c in columns)).withColumn("pair", F.concat_ws("|", F.coalesce("a_path", F.lit("-")), F.coalesce("b_path", F.lit("-")))))
        if pairs.isEmpty():
            break
        groups.append(pairs.where("a_kind <> 'COND' and b_kind <> 'COND' and a_kind <> b_kind").select(id, F.col("a_path").alias("field"), F.col("a_kind").alias("old"), F.col("b_kind").alias("new")))
        sides = []
        for s, left in (("a", left_a), ("b", left_b)):
            whole = {"a": a, "b": b}[s]
            left.append(pairs.where(f"{s}_kind = 'COND'").select(id, *(F.col(f"{s}_{c}").alias(c) for c in columns)))  # roots that are conditions
            above = pairs.where(f"{s}_kind <> 'COND'").select(id, F.col(f"{s}_path").alias(f"{s}_parent"), "pair")
            below = whole.join(above, [id, f"{s}_parent"])
            order = Window.partitionBy(id, "pair", f"{s}_signature").orderBy(f"{s}_pos")
            sides.append(below.withColumn("nth", F.row_number().over(order)))
        x, y = (written(s) for s in sides)
        same = x.select(id, "pair", F.col("a_signature").alias("signature"), "nth").join(y.select(id, "pair", F.col("b_signature").alias("signature"), "nth"), [id, "pair", "signature", "nth"])
        rest = []
        for s, df in (("a", x), ("b", y)):
            other = df.join(same.withColumnRenamed("signature", f"{s}_signature"), [id, "pair", f"{s}_signature", "nth"], "left_anti")
            left = left_a if s == "a" else left_b
            left.append(other.where(f"{s}_kind = 'COND'").select(id, *(F.col(f"{s}_{c}").alias(c) for c in columns)))
            nth = F.row_number().over(Window.partitionBy(id, "pair", f"{s}_kind").orderBy(f"{s}_pos"))
            rest.append(written(other.where(f"{s}_kind <> 'COND'").withColumn("nth", nth).withColumn("group", F.col(f"{s}_kind"))))
        kinds = [id, "pair", "group", "nth"]  # groups of one kind are pairs, then what is left is, by its order
        alike = rest[0].join(rest[1], kinds)
        others = [df.join(alike.select(*kinds), kinds, "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy(id, "pair").orderBy(f"{s}_pos"))).drop("group") for s, df in zip("ab", rest)]
        pairs = alike.drop("pair", "group", "nth").unionByName(others[0].join(others[1], [id, "pair", "nth"], "full_outer").drop("pair", "nth"))

    def conditions(parts, s):
        if not parts:
            return a.limit(0).select(id, F.col("a_field").alias("field"), F.lit(1).alias("nth"), F.col("a_op").alias(s))
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        nth = F.row_number().over(Window.partitionBy(id, "field").orderBy("path"))
        return every.select(id, "field", nth.alias("nth"), F.concat_ws(" ", "op", "value").alias(s))

    both = conditions(left_a, "old").join(conditions(left_b, "new"), [id, "field", "nth"], "full_outer").where("not (old <=> new)")
    change = F.when(F.col("old").isNull(), "ADD").when(F.col("new").isNull(), "REMOVE").otherwise("REPLACE")
    both = both.withColumn("change", change)
    risk = F.when((F.col("change") == "REMOVE") | F.col("field").isin(*CRITICAL), "CRITICAL").otherwise("NORMAL")
    out = both.select(id, "field", "change", risk.alias("risk"), "old", "new")
    for g in groups:
        out = out.union(g.select(id, "field", F.lit("MODIFY").alias("change"), F.lit("CRITICAL").alias("risk"), "old", "new"))
    return out.where("change <> 'REMOVE'") if partial else out
