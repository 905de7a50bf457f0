"""Queries of access policies with conditions, and of observations made to stand alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query
from .functions import observations
from .operators import access
from .sources.views import table

POLICY = [
    {"id": "board", "effect": "permit", "action": "*", "priority": 9, "conditions": [("segment", "eq", "MACHINERY"), ("balance", "gte", 9000)]},
    {"id": "overdrawn", "effect": "deny", "action": "write", "priority": 5, "conditions": [("balance", "lt", 0), ("status", "neq", "F")]},
    {"id": "old", "effect": "deny", "action": "read", "priority": 5, "conditions": [("status", "in", ["F", "P"]), ("price", "lte", 20000.0), ("nation", "present")]},
    {"id": "home", "effect": "permit", "action": "read", "priority": 5, "conditions": [("nation", "gt", 9), ("priority", "contains", "-"), ("segment", "not-in", ["BUILDING", None])]},
    {"id": "urgent", "effect": "permit", "action": "write", "conditions": [("priority", "starts-with", "1-"), ("labels", "contains", "O")]},
    {"id": "odd", "effect": "deny", "action": "write", "conditions": [("clearance", "absent"), ("nation", "eq", 7)]},
]


@query("""
    WITH q AS (SELECT o_orderkey AS request, CASE WHEN o_orderkey % 3 = 0 THEN 'write' ELSE 'read' END AS action, c_mktsegment AS segment, c_acctbal AS balance, c_nationkey AS nation,
                      o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey),
         r AS (SELECT request, CASE WHEN segment = 'MACHINERY' AND balance >= 9000 THEN 'permit board'
                   WHEN action = 'read' AND status IN ('F', 'P') AND price <= 20000 AND nation IS NOT NULL THEN 'deny old'
                   WHEN action = 'write' AND balance < 0 AND status <> 'F' THEN 'deny overdrawn'
                   WHEN action = 'read' AND nation > 9 AND contains(priority, '-') AND segment IS NOT NULL AND segment <> 'BUILDING' THEN 'permit home'
                   WHEN action = 'write' AND nation = 7 THEN 'deny odd'
                   WHEN action = 'write' AND starts_with(priority, '1-') AND status = 'O' THEN 'permit urgent'
                   ELSE 'not-applicable' END AS d FROM q)
    SELECT request, split_part(d, ' ', 1) AS effect, nullif(split_part(d, ' ', 2), '') AS rule_id FROM r""")
def abac_policy(spark: SparkSession, d: str) -> DataFrame:
    """Who may read or write which order, by attributes of the customer and of the order."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    requests = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("request"), F.when(F.col("o_orderkey") % 3 == 0, "write").otherwise("read").alias("action"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.array("o_orderstatus").alias("labels"),
    )
    return access.evaluate(requests, POLICY).select("request", "effect", "rule_id")


_STOP_SQL = ", ".join(f"'{w}'" for w in observations.STOP_WORDS)
_PHRASES = ["yesterday", "today", "tomorrow", "Last week", "last month", "last YEAR", "this week", "this month", "this year, not this year"]
_PHRASES_SQL = ", ".join(f"'{p}'" for p in _PHRASES)
_DAY_SQL = "strftime(clock + INTERVAL ({0}) DAY, '%Y-%m-%d')"
_ANCHORS_SQL = [
    ("yesterday", _DAY_SQL.format(-1)), ("today", _DAY_SQL.format(0)), ("tomorrow", _DAY_SQL.format(1)), ("last week", "concat('week of ', " + _DAY_SQL.format(-7) + ")"),
    ("last month", "strftime(date_trunc('month', clock) - INTERVAL 1 MONTH + INTERVAL (day(clock) - 1) DAY, '%Y-%m')"), ("last year", "CAST(year(clock) - 1 AS VARCHAR)"),
    ("this week", "concat('week of ', " + _DAY_SQL.format(0) + ")"), ("this month", "strftime(clock, '%Y-%m')"), ("this year", "CAST(year(clock) AS VARCHAR)"),
]


def _steps_sql() -> str:
    steps, before = [], "p"
    for i, (phrase, date) in enumerate(_ANCHORS_SQL):
        found = rf"regexp_matches(t, '\b{phrase}\b', 'i')"
        change = rf"CASE WHEN {found} THEN list_append(changes, concat('''', regexp_extract(t, '\b{phrase}\b', 0, 'i'), ''' -> ''', {date}, '''')) ELSE changes END"
        steps.append(rf"s{i} AS (SELECT id, clock, regexp_replace(t, '\b{phrase}\b', {date}, 'i') AS t, {change} AS changes FROM {before})")
        before = f"s{i}"
    return ",\n         ".join(steps)


def _any_sql(gender: str) -> str:
    return " OR ".join(f"contains(lower(name), '{n}')" for n in observations.NAMES[gender].split())


def _pronoun_sql(gender: str, text: str) -> str:
    return rf"regexp_replace({text}, '\b({observations.PRONOUNS[gender].replace(' ', '|')})\b', name, 'gi')"


@query(rf"""
    WITH o AS (SELECT 'd' || doc_id AS id, text AS t, 'Text ' || doc_id AS name, lang AS entity_type, CAST('2024-03-31' AS TIMESTAMP) AS clock FROM documents
               UNION ALL SELECT 'o' || o_orderkey, concat('He asked ', list_extract([{_PHRASES_SQL}], CAST(o_orderkey % 9 + 1 AS INT)), ': did her clerk send their order ', o_orderkey, ' to them today?'),
                                concat(CASE o_custkey % 3 WHEN 0 THEN 'Bob ' WHEN 1 THEN 'Mary ' ELSE 'Agent ' END, o_custkey), CASE WHEN o_custkey % 2 = 0 THEN 'Person' ELSE 'account' END, CAST(o_orderdate AS TIMESTAMP) FROM orders),
         g AS (SELECT *, CASE WHEN {_any_sql('masculine')} THEN {_pronoun_sql('masculine', 't')} WHEN {_any_sql('feminine')} THEN {_pronoun_sql('feminine', 't')} ELSE t END AS u FROM o),
         n AS (SELECT *, coalesce(CASE WHEN lower(entity_type) <> 'person' THEN {_pronoun_sql('neutral', 'u')} ELSE u END, t) AS v FROM g),
         p AS (SELECT id, clock, v AS t, CASE WHEN v <> t THEN [concat('Resolved pronouns to ''', name, '''')] ELSE CAST([] AS VARCHAR[]) END AS changes FROM n),
         {_steps_sql()}
    SELECT id, md5(t) AS normalized_md5, array_to_string(changes, '; ') AS changes,
           CAST(list_unique(list_filter(regexp_split_to_array(regexp_replace(lower(t), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP_SQL}))) AS BIGINT) AS n_keywords FROM s8""")
def normalized_observations(spark: SparkSession, d: str) -> DataFrame:
    """Documents at a fixed clock and statements about orders at their dates, without pronouns and relative dates."""
    docs, o = table(spark, d, "documents"), table(spark, d, "orders")
    text = lambda c: F.col(c).cast("string")
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    customer = F.concat(F.when(F.col("o_custkey") % 3 == 0, "Bob ").when(F.col("o_custkey") % 3 == 1, "Mary ").otherwise("Agent "), text("o_custkey"))
    orders = o.select(
        F.concat(F.lit("o"), text("o_orderkey")).alias("id"), F.concat(F.lit("He asked "), phrase, F.lit(": did her clerk send their order "), text("o_orderkey"), F.lit(" to them today?")).alias("text"),
        customer.alias("name"), F.when(F.col("o_custkey") % 2 == 0, "Person").otherwise("account").alias("entity_type"), F.col("o_orderdate").cast("timestamp").alias("clock"),
    )
    documents = docs.select(F.concat(F.lit("d"), text("doc_id")).alias("id"), "text", F.concat(F.lit("Text "), text("doc_id")).alias("name"), F.col("lang").alias("entity_type"), F.lit("2024-03-31").cast("timestamp").alias("clock"))
    found = observations.normalise(documents.unionByName(orders), "text", "name", "entity_type", "clock")
    return found.select("id", F.md5("normalized").alias("normalized_md5"), F.concat_ws("; ", "changes").alias("changes"), F.size("keywords").cast("bigint").alias("n_keywords"))
