"""Rule trees over profiles: compiled to Columns, or evaluated from a table of nodes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import truth
from .sizes import hinted

DEEPEST = 10
_NAMES = {"AND": "AND", "ALL": "AND", "OR": "OR", "ANY": "OR", "NOT": "NOT"}


def _no_fields() -> Column:
    return F.array().cast("array<string>")


class RuleError(ValueError):
    pass


def _group(node: dict) -> str | None:
    name = next((node[k] for k in ("type", "logical_operator", "group_type", "logic") if isinstance(node.get(k), str)), None)
    return _NAMES.get(name.upper()) if name else None


def fields_of(node: dict) -> list[str]:
    """The fields of a tree, in order, each once."""
    if _group(node) is None:
        return [node["field"]]
    return list(dict.fromkeys(f for c in node.get("children", []) for f in fields_of(c)))


def compiled(node: dict | None, depth: int = 0) -> tuple[Column, Column]:
    """A rule tree's state, and the fields that are missing for a decision, in the order of evaluation.

    Children are looked at from left to right until one decides; what a decided alternative would have
    needed is not missing. No tree is true."""
    if node is None:
        return F.lit(True), _no_fields()
    if depth > DEEPEST:
        raise RuleError(f"deeper than {DEEPEST}")
    kind = _group(node)
    if kind is None:
        if "field" not in node or "operator" not in node:
            raise RuleError(f"neither group nor condition: {sorted(node)}")
        value = F.col(node["field"])
        return truth.compare(node["operator"], value, node.get("value", True)), F.when(value.isNull(), F.array(F.lit(node["field"]))).otherwise(_no_fields())
    parts = [compiled(c, depth + 1) for c in node.get("children", [])]
    states = [s for s, _ in parts]
    if kind == "NOT":
        return truth.negation(states), parts[0][1] if parts else _no_fields()
    stop = F.lit(kind == "OR")
    missing, open_ = _no_fields(), F.lit(True)
    for state, fields in parts:
        missing = F.concat(missing, F.when(open_, fields).otherwise(_no_fields()))
        open_ = open_ & ~state.eqNullSafe(stop)
    state = truth.all_of(states) if kind == "AND" else truth.any_of(states)
    if kind == "OR":
        missing = F.when(state, _no_fields()).otherwise(missing)
    return state, F.array_distinct(missing)


def exclusion_state(exclusions: list[dict], positive: Column) -> tuple[Column, Column, Column]:
    """State, the first exclusion that holds, and fields still needed. Nothing is asked once the tree is false;
    an unknown exclusion counts only if its check is mandatory."""
    hit, unknown, needed = F.lit(None).cast("string"), F.lit(False), _no_fields()
    for e in reversed(exclusions):
        state, missing = compiled(e["rule"])
        hit = F.when(state, F.lit(e["id"])).otherwise(hit)
        if e.get("mandatory_check"):
            unknown = unknown | state.isNull()
            needed = F.concat(F.when(state.isNull(), missing).otherwise(_no_fields()), needed)
    off = positive.eqNullSafe(F.lit(False))
    state = F.when(off, False).when(hit.isNotNull(), True).when(unknown, None).otherwise(False)
    return state, F.when(~off, hit), F.when(off | hit.isNotNull(), _no_fields()).otherwise(needed)


def availability(valid_from: date | None, valid_until: date | None, on: date) -> str:
    return "NOT_YET_ACTIVE" if valid_from and on < valid_from else "EXPIRED" if valid_until and on > valid_until else "ACTIVE"


def evaluate(profiles: DataFrame, schemes: list[dict], on: date) -> DataFrame:
    """profiles × schemes in one pass over profiles: scheme_id, availability, status, missing fields, the exclusion that holds, preferences met."""
    results = []
    for s in schemes:
        positive, missing = compiled(s.get("rule"))
        excluded, hit, needed = exclusion_state(s.get("exclusions", []), positive)
        status = (
            F.when(positive.eqNullSafe(F.lit(False)) | excluded.eqNullSafe(F.lit(True)), "NOT_ELIGIBLE")
            .when(positive.isNull() | excluded.isNull(), "MORE_INFORMATION_REQUIRED")
            .otherwise("ELIGIBLE")
        )
        met = F.array_compact(F.array(*(F.when(compiled(p)[0], F.lit("+".join(fields_of(p)))) for p in s.get("preferences", [])))) if s.get("preferences") else _no_fields()
        results.append(
            F.struct(
                F.lit(s["id"]).alias("scheme_id"), F.lit(availability(s.get("valid_from"), s.get("valid_until"), on)).alias("availability"), status.alias("status"),
                F.array_distinct(F.concat(missing, needed)).alias("missing"), hit.alias("exclusion"), met.alias("preferences"),
            )
        )
    return profiles.select("*", F.explode(F.array(*results)).alias("r")).select(*profiles.columns, "r.*")


def _constant(node: dict) -> int | None:
    """The state of a group that no fact can change: 2 is true, 1 unknown, 0 false."""
    kind, children = _group(node), node.get("children", [])
    if kind is None:
        return None
    if not children:
        return {"AND": 2, "OR": 0, "NOT": 1}[kind]
    states = [_constant(c) for c in (children[:1] if kind == "NOT" else children)]
    if None in states:
        return None
    return min(states) if kind == "AND" else max(states) if kind == "OR" else 2 - states[0]


def nodes_of(schemes: list[dict]) -> list[tuple]:
    """A row (see NODES) for each node of all trees. Groups know how many of their children depend on facts, and the least
    and greatest state of those that don't, which have no rows."""
    out = []

    def walk(scheme, node, path, parent, depth):
        if depth > DEEPEST:
            raise RuleError(f"deeper than {DEEPEST}")
        kind, value, op = _group(node), node.get("value", True), node.get("operator")
        low = high = choices = flag = None
        if kind is None:
            if op == "BETWEEN":
                low, high = (value.get("min"), value.get("max")) if isinstance(value, dict) else value
            elif isinstance(value, bool):
                flag = value
            elif isinstance(value, (int, float)):
                low = high = value
            elif value is not None:
                choices = [str(v).strip().lower() for v in (value if isinstance(value, list) else [value])]
        children = node.get("children", [])[: 1 if kind == "NOT" else None]
        fixed = [_constant(c) for c in children]
        known = [x for x in fixed if x is not None] + ([_constant(node)] if kind and not children else [])
        number = lambda x: float(x) if x is not None else None
        out.append((scheme, path, parent, depth, kind or "COND", node.get("field"), op, number(low), number(high), choices, flag, fixed.count(None), min(known, default=2), max(known, default=0)))
        for i, c in enumerate(children):
            if fixed[i] is None:
                walk(scheme, c, f"{path}.{i}", path, depth + 1)

    for s in schemes:
        walk(s["id"], s["rule"], "0", None, 0)
    return out


NODES = "scheme_id string, path string, parent string, depth int, kind string, field string, op string, low double, high double, choices array<string>, flag boolean, open int, least int, most int"


def evaluate_nodes(facts: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """profile_id, scheme_id, state for facts (profile_id, field, num, str, flag_value) under rules kept as rows.

    Conditions meet facts in an equi-join on the field; groups are rolled up from the deepest level: false is 0,
    unknown 1 and true 2, so AND is the minimum, OR the maximum and NOT two less the state. A condition without a fact is
    unknown, whether the fact's row is null or there is none: a group counts the children that it should have.
    Every profile with any fact has a state under every scheme. Rules are sent to all tasks while they are small."""
    facts = _dealt(facts, nodes)
    states, _ = _rolled_up(facts, nodes, deepest)
    return _with_all_roots(facts, nodes, states)


#: States of conditions that a partition of profiles has, about.
STATES = 2_000_000


def _dealt(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """facts dealt by profile: so all that is grouped by profile and more stays where it is, and partitions keep their size when profiles grow."""
    each = facts.groupBy("field").count().join(nodes.where("kind = 'COND'").groupBy("field").agg(F.count("*").alias("leaves")), "field")
    states = each.agg(F.sum(F.col("count") * F.col("leaves"))).first()[0] or 0
    least = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return facts.repartition(max(least, -(-states // STATES)), "profile_id")


def _rolled_up(facts: DataFrame, nodes: DataFrame, deepest: int) -> tuple[DataFrame, DataFrame]:
    """profile_id, scheme_id, path, parent, depth, state: of the roots, and of all nodes with a fact below."""
    num, low, high = (F.col(c).cast(truth.DECIMAL) for c in ("num", "low", "high"))
    named = F.lower(F.trim("str"))
    op = F.col("op")
    given = F.coalesce(F.col("num").cast("string"), F.col("str"), F.col("flag_value").cast("string")).isNotNull()
    said = F.coalesce(F.col("flag_value"), named.isin(*truth.YES), F.col("num") != 0)
    holds = (
        F.when(op == "GTE", num >= low).when(op == "GT", num > low).when(op == "LTE", num <= low).when(op == "LT", num < low).when(op == "BETWEEN", (num >= low) & (num <= high))
        .when(op == "IN", F.array_contains("choices", named)).when(op == "NOT_IN", ~F.array_contains("choices", named))
        .when(op == "EXISTS", F.when(given, F.lit(True))).when(op == "NOT_EXISTS", F.when(given, F.lit(False)))
        .when(op.isin("EQ", "NE"), (op == "EQ") == F.when(F.col("flag").isNotNull(), said == F.col("flag")).otherwise(F.coalesce(num == low, F.array_contains("choices", named))))
    )
    leaves, groups = hinted(nodes.where("kind = 'COND'"), 200), nodes.where("kind <> 'COND'").select("scheme_id", "path", "parent", "depth", "kind", "open", F.col("least").alias("fixed_least"), F.col("most").alias("fixed_most"))
    level = facts.join(leaves, "field")
    level = level.select("profile_id", "scheme_id", "path", "parent", "depth", F.when(holds, 2).when(~holds, 0).otherwise(1).alias("state"))
    every = level
    for depth in range(deepest, 0, -1):
        here = level.where(F.col("depth") == depth).groupBy("profile_id", "scheme_id", "parent").agg(F.min("state").alias("least"), F.max("state").alias("most"), F.count("*").alias("seen"))
        here = here.withColumnRenamed("parent", "path").join(hinted(groups.where(F.col("depth") == depth - 1), 200), ["scheme_id", "path"])
        short = F.when(F.col("seen") < F.col("open"), 1)  # some child is unknown
        least, most = F.least("least", "fixed_least", short), F.greatest("most", "fixed_most", short)
        state = F.when(F.col("kind") == "AND", least).when(F.col("kind") == "OR", most).otherwise(2 - least)
        here = here.select("profile_id", "scheme_id", "path", "parent", "depth", state.alias("state"))
        every, level = every.unionByName(here), level.where(F.col("depth") < depth).unionByName(here)
    return level, every


def _with_all_roots(facts: DataFrame, nodes: DataFrame, level: DataFrame) -> DataFrame:
    # a tree none of whose conditions has a fact: unknown, or what its fixed parts decide
    alone = F.when(F.col("kind") == "COND", 1).when(F.col("kind") == "AND", F.least("least", F.when(F.col("open") > 0, 1))).when(F.col("kind") == "OR", F.greatest("most", F.when(F.col("open") > 0, 1))).otherwise(1)
    roots = hinted(nodes.where("depth = 0").select("scheme_id", alone.alias("alone")), 50)
    grid = facts.select("profile_id").distinct().join(roots).select("profile_id", "scheme_id", "alone", F.lit(None).cast("int").alias("state"))  # the result's own rows
    both = grid.unionByName(level.select("profile_id", "scheme_id", F.lit(None).cast("int").alias("alone"), "state"))
    return both.groupBy("profile_id", "scheme_id").agg(F.coalesce(F.max("state"), F.max("alone")).alias("state"))


OUTCOMES = ("FALSE", "UNKNOWN", "TRUE")


def _outcome(state: Column) -> Column:
    return F.element_at(F.array(*(F.lit(o) for o in OUTCOMES)), state + 1)


def traced(node: dict, path: str = "0", open_: Column | None = None) -> tuple[Column, list[Column]]:
    """A tree's state, and structs (path, kind, field, outcome) of its nodes in the order of evaluation.

    A node is SKIPPED if a sibling before it has decided their group, or if it lies below such a node. Groups that no fact can change are
    no part of the trace; what these decide skips nothing."""
    open_ = F.lit(True) if open_ is None else open_
    kind = _group(node)
    state, _ = compiled(node)
    outcome = F.when(open_, F.when(state, "TRUE").when(~state, "FALSE").otherwise("UNKNOWN")).otherwise("SKIPPED")
    out = [F.struct(F.lit(path).alias("path"), F.lit(kind or "COND").alias("kind"), F.lit(node.get("field")).cast("string").alias("field"), outcome.alias("outcome"))]
    stop = F.lit(kind == "OR")
    for i, child in enumerate(node.get("children", [])[: 1 if kind == "NOT" else None]):
        if _constant(child) is None:
            child_state, inner = traced(child, f"{path}.{i}", open_)
            out += inner
            if kind != "NOT":
                open_ = open_ & ~child_state.eqNullSafe(stop)
    return state, out


def trace(profiles: DataFrame, schemes: list[dict]) -> DataFrame:
    """profile_id, scheme_id, step, path, kind, field, outcome by compiled trees: one pass over profiles."""
    lists = F.array(*(F.struct(F.lit(s["id"]).alias("scheme_id"), F.array(*traced(s["rule"])[1]).alias("steps")) for s in schemes))
    each = profiles.select("profile_id", F.inline(lists))
    return each.select("profile_id", "scheme_id", F.posexplode("steps").alias("step", "s")).select("profile_id", "scheme_id", "step", "s.*")


def trace_nodes(facts: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """The same trace for rules kept as rows: every node's state from the roll-up, skips from a window over earlier siblings.

    A trace has a row for each node of each tree and profile; what is gathered at once are the skipped nodes of one tree for one profile."""
    every = _rolled_up(facts, nodes, deepest)[1].select("profile_id", "scheme_id", "path", "state")
    own = F.when(F.col("kind") == "COND", 1).when(F.col("kind") == "AND", F.least("least", F.when(F.col("open") > 0, 1))).when(F.col("kind") == "OR", F.greatest("most", F.when(F.col("open") > 0, 1))).otherwise(1)
    shown = nodes.select("scheme_id", "path", "parent", "kind", "field", own.alias("alone"))
    above = nodes.select("scheme_id", F.col("path").alias("parent"), F.col("kind").alias("of"))
    shown = shown.join(above, ["scheme_id", "parent"], "left")
    rows = facts.select("profile_id").distinct().join(hinted(shown, 100))  # the result's own rows
    rows = rows.join(every, ["profile_id", "scheme_id", "path"], "left").withColumn("state", F.coalesce("state", "alone").cast("int"))
    place = F.transform(F.split("path", "[.]"), lambda x: x.cast("int"))
    before = Window.partitionBy("profile_id", "scheme_id", "parent").orderBy(F.element_at(place, -1)).rowsBetween(Window.unboundedPreceding, -1)
    decides = ((F.col("of") == "AND") & (F.col("state") == 0)) | ((F.col("of") == "OR") & (F.col("state") == 2))
    rows = rows.withColumn("place", place).withColumn("skipped", F.coalesce(F.max(decides).over(before), F.lit(False)) & F.col("parent").isNotNull())
    tree = Window.partitionBy("profile_id", "scheme_id")
    skipped = F.collect_list(F.when(F.col("skipped"), F.col("path"))).over(tree)
    rows = rows.withColumn("off", skipped).withColumn("step", F.row_number().over(tree.orderBy("place")) - 1)
    is_off = F.exists("off", lambda p: (F.col("path") == p) | F.startswith(F.col("path"), F.concat(p, F.lit("."))))
    return rows.select("profile_id", "scheme_id", "step", "path", "kind", "field", F.when(is_off, "SKIPPED").otherwise(_outcome(F.col("state"))).alias("outcome"))


# Signs of operators, and of their opposites.
SIGNS = {"GTE": ">=", "GT": ">", "LTE": "<=", "LT": "<", "EQ": "==", "NE": "!=", "IN": "IN", "NOT_IN": "NOT IN"}
OPPOSITES = {"GTE": "<", "GT": "<=", "LTE": ">", "LT": ">=", "EQ": "!=", "NE": "=="}


def decisive(steps: DataFrame, conditions: DataFrame) -> DataFrame:
    """profile_id, scheme_id, outcome, told: the root's outcome and what decided it, sorted, for steps of a trace and conditions (scheme_id, path, op, required).

    Of a true tree these are the conditions that hold, of a false one the opposites of those that fail, of an open one those that hold and `field is missing`.
    Skipped conditions tell nothing."""
    sign = lambda table, other: F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.col("op")], other)
    own = steps.join(hinted(conditions, 100), ["scheme_id", "path"], "left")
    says = F.when(F.col("outcome") == "TRUE", F.concat_ws(" ", "field", sign(SIGNS, F.col("op")), "required")).when(F.col("outcome") == "FALSE", F.concat_ws(" ", "field", sign(OPPOSITES, F.lit("!=")), "required"))
    says = F.when(F.col("outcome") == "UNKNOWN", F.concat("field", F.lit(" is missing"))).otherwise(says)
    own = own.select("profile_id", "scheme_id", F.when(F.col("path") == "0", F.col("outcome")).alias("root"), F.when(F.col("kind") == "COND", F.struct("outcome", says.alias("says"))).alias("c"))
    tree = own.groupBy("profile_id", "scheme_id").agg(F.max("root").alias("outcome"), F.collect_list("c").alias("cs"))
    wanted = F.filter("cs", lambda c: F.when(F.col("outcome") == "UNKNOWN", c["outcome"].isin("TRUE", "UNKNOWN")).otherwise(c["outcome"] == F.col("outcome")))
    return tree.select("profile_id", "scheme_id", "outcome", F.array_sort(F.array_distinct(F.transform(wanted, lambda c: c["says"]))).alias("told"))


def decisive_recall(told: DataFrame, gold: DataFrame) -> DataFrame:
    """told with recall: the share of a profile's gold conditions (profile_id, scheme_id, expected) that were told; 1 where none are expected. White space and case don't count."""
    plain = lambda c: F.array_distinct(F.transform(c, lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\s+", " ")))
    both = told.join(gold, ["profile_id", "scheme_id"], "left")
    wanted, got = plain(F.coalesce("expected", F.array().cast("array<string>"))), plain(F.col("told"))
    return both.select(*told.columns, F.when(F.size(wanted) == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(wanted, got)) / F.size(wanted), 4)).alias("recall"))
