"""Row filters, attribute and role rules, visibility."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, NumericType, StringType


def row_filter(*predicates: Column) -> Column:
    """All predicates hold; a missing attribute denies."""
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), predicates, F.lit(True))


def classification_at_most(col: Column, ranks: list[str], cap: str) -> Column:
    """Classification rank is not above the cap; unknown classes are denied."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(ranks):
        rank = F.when(col == name, F.lit(i)).otherwise(rank)
    return rank <= ranks.index(cap)


def filter_chain(tags: list[str] | None = None, least: float | None = None, most: float | None = None, entity_type: str | None = None, project: str | None = None) -> Column:
    """Any tag matches; importance within bounds (a missing one fails them); exact type and project."""
    out = F.lit(True)
    if tags:
        out = out & F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(t.lower()) for t in tags]))
    if least is not None:
        out = out & (F.col("importance") >= least)
    if most is not None:
        out = out & (F.col("importance") <= most)
    if entity_type is not None:
        out = out & (F.col("entity_type") == entity_type)
    if project is not None:
        out = out & (F.col("project_id") == project)
    return F.coalesce(out, F.lit(False))


def symbolic_score(tags: list[str] | None = None, types: list[str] | None = None, importance: tuple[float, float] | None = None) -> Column:
    """1 where all filters hold, null where one fails, 0.5 without filters; missing importance is 5."""
    tests = []
    if tags:
        tests.append(F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(t.lower()) for t in tags])))
    if types:
        tests.append(F.lower("entity_type").isin([t.lower() for t in types]))
    if importance:
        tests.append(F.coalesce("importance", F.lit(5.0)).between(*importance))
    return F.when(row_filter(*tests), F.lit(1.0)) if tests else F.lit(0.5)


def decide(requests: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """The deciding rule of each request: highest priority, deny before allow, then the rule's id.

    ``rules`` (attribute, value, effect, priority, rule_id) meet requests by an equi-join
    on attribute and value; a request that no rule meets is denied.
    """
    met = requests.join(rules, ["attribute", "value"])
    w = Window.partitionBy(key).orderBy(F.desc("priority"), F.when(F.col("effect") == "deny", 0).otherwise(1), "rule_id")
    first = met.withColumn("n", F.row_number().over(w)).filter("n = 1").select(key, "effect", "rule_id")
    return requests.select(key).distinct().join(first, key, "left").select(key, F.coalesce("effect", F.lit("deny")).alias("effect"), "rule_id")


#: Operators of a condition (fixed values).
OPERATORS = "eq neq in not-in contains starts-with lt lte gt gte present absent".split()


def _same(left: Column, kind: DataType, value: object) -> Column:
    """Equal in type and value; null equals null only."""
    if value is None:
        return left.isNull()
    fits = isinstance(kind, BooleanType) if isinstance(value, bool) else isinstance(kind, NumericType) if isinstance(value, int | float) else isinstance(kind, StringType)
    return F.coalesce(left == F.lit(value), F.lit(False)) if fits else F.lit(False)


def condition(requests: DataFrame, attribute: str, op: str, value: object = None) -> Column:
    """Whether a request's attribute (a column, or a path into one) meets a condition; never null.

    Values of another type than the attribute's are unequal and in no order.  An attribute
    that the requests lack is like a null one, save that nothing equals it, null neither.
    A malformed condition is an error, as a policy that says something else is a risk.
    """
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r} for attribute {attribute!r}")
    if op in ("in", "not-in") and not isinstance(value, list | tuple | set):
        raise ValueError(f"operator {op!r} of attribute {attribute!r} takes a list")
    try:
        kind: DataType | None = requests.select(F.col(attribute)).schema[0].dataType
    except AnalysisException:
        kind = None
    if kind is None:
        return F.lit(op in ("neq", "not-in", "absent"))
    left = F.col(attribute)
    if op in ("present", "absent"):
        return left.isNotNull() if op == "present" else left.isNull()
    if op in ("eq", "neq"):
        return _same(left, kind, value) if op == "eq" else ~_same(left, kind, value)
    if op in ("in", "not-in"):
        among = reduce(lambda a, b: a | b, [_same(left, kind, v) for v in value], F.lit(False))
        return among if op == "in" else ~among
    if op == "contains" and isinstance(kind, ArrayType):
        return F.coalesce(F.exists(left, lambda x: _same(x, kind.elementType, value)), F.lit(False))
    if op in ("contains", "starts-with"):
        if not (isinstance(kind, StringType) and isinstance(value, str)):
            return F.lit(False)
        return F.coalesce(left.contains(value) if op == "contains" else left.startswith(value), F.lit(False))
    if not isinstance(kind, NumericType) or isinstance(value, bool) or not isinstance(value, int | float):
        return F.lit(False)
    held = {"lt": left < value, "lte": left <= value, "gt": left > value, "gte": left >= value}[op]
    if isinstance(kind, FloatType | DoubleType):
        held = held & ~F.isnan(left)  # Spark has NaN above all numbers
    return F.coalesce(held, F.lit(False))


def evaluate(requests: DataFrame, rules: list[dict], action: str = "action") -> DataFrame:
    """The requests with ``effect`` (``permit``, ``deny``, ``not-applicable``) and the deciding ``rule_id``.

    A rule has ``id, effect, action`` (``*`` for all), and may have ``priority`` (0) and
    ``conditions``, each ``(attribute, op)`` or ``(attribute, op, value)``, that must all
    hold.  The highest priority decides, deny before permit, then the id.  The policy becomes one
    expression over a request's row: nothing is joined or shuffled, however many requests there are.
    """
    for rule in rules:
        if rule["effect"] not in ("permit", "deny"):
            raise ValueError(f"rule {rule['id']!r}: unknown effect {rule['effect']!r}")
    decision = None
    for rule in sorted(rules, key=lambda r: (-r.get("priority", 0), r["effect"] != "deny", r["id"])):
        holds = F.lit(True) if rule["action"] == "*" else F.coalesce(F.col(action) == rule["action"], F.lit(False))
        holds = reduce(lambda a, c: a & condition(requests, *c), rule.get("conditions", ()), holds)
        found = F.struct(F.lit(rule["effect"]).alias("effect"), F.lit(rule["id"]).alias("rule_id"))
        decision = F.when(holds, found) if decision is None else decision.when(holds, found)
    none = F.struct(F.lit("not-applicable").alias("effect"), F.lit(None).cast("string").alias("rule_id"))
    return requests.withColumn("_d", none if decision is None else decision.otherwise(none)).withColumns({"effect": F.col("_d.effect"), "rule_id": F.col("_d.rule_id")}).drop("_d")
