"""Changes of entities, relations, observations and tags; filters, triggers and scores over memory records."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import text as T


def _empty() -> Column:
    return F.array().cast("array<string>")


# -- filters and search ------------------------------------------------------------------


def full_filter(
    tags: list[str] | None = None, least: float | None = None, most: float | None = None, entity_type: str | None = None, project: str | None = None,
    created: tuple[str | None, str | None] = (None, None), modified: tuple[str | None, str | None] = (None, None), superseded: bool = False, statuses: tuple[str, ...] = ("published",),
) -> Column:
    """The whole filter chain over ``tags, importance, entity_type, project_id, created_at, modified_at, is_latest, status``.

    Bounds count; what has no value fails a bound.  Superseded rows (``is_latest`` false) are
    left out unless asked for; a missing status is ``published``.
    """
    tests = []
    if tags:
        tests.append(F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(t.lower()) for t in tags])))
    if least is not None:
        tests.append(F.col("importance") >= least)
    if most is not None:
        tests.append(F.col("importance") <= most)
    if entity_type is not None:
        tests.append(F.col("entity_type") == entity_type)
    if project is not None:
        tests.append(F.col("project_id") == project)
    for column, (after, before) in (("created_at", created), ("modified_at", modified)):
        if after is not None:
            tests.append(F.col(column) >= F.to_timestamp(F.lit(after)))
        if before is not None:
            tests.append(F.col(column) <= F.to_timestamp(F.lit(before)))
    if not superseded:
        tests.append(F.coalesce("is_latest", F.lit(True)))
    tests.append(F.coalesce("status", F.lit("published")).isin(*statuses))
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), tests, F.lit(True))


def full_symbolic(tags: list[str] | None = None, types: list[str] | None = None, importance: tuple[float, float] | None = None, dates: tuple[str, str] | None = None, parent: str | None = None, observed: bool | None = None) -> Column:
    """1 where all filters hold, null where one fails, 0.5 without filters; a missing importance is 5."""
    tests = []
    if tags:
        tests.append(F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(t.lower()) for t in tags])))
    if types:
        tests.append(F.lower("entity_type").isin([t.lower() for t in types]))
    if importance:
        tests.append(F.coalesce("importance", F.lit(5.0)).between(*importance))
    if dates:
        tests.append(F.col("created_at").between(*[F.to_timestamp(F.lit(x)) for x in dates]))
    if parent is not None:
        tests.append(F.col("parent") == parent)
    if observed is not None:
        tests.append((F.size("observations") > 0) == observed)
    if not tests:
        return F.lit(0.5)
    return F.when(reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), tests), F.lit(1.0))


def like_any(term: str, *columns: Column) -> Column:
    """The term as it stands (``%`` and ``_`` too) is in one of the columns, without case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns])


def matched_fields(entities: DataFrame, terms: list[str]) -> DataFrame:
    """``ord, term, in_name, in_type, in_observations`` where a term is in one of them at least."""
    each = entities.select("ord", "name", "entity_type", "observations", F.explode(F.array(*[F.lit(t.lower()) for t in terms])).alias("term"))
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.col("term")), F.lit(False))
    out = each.select("ord", "term", has(F.col("name")).alias("in_name"), has(F.col("entity_type")).alias("in_type"), F.exists("observations", has).alias("in_observations"))
    return out.filter("in_name or in_type or in_observations")


def spelling(vocabulary: DataFrame, col: str, query: str, limit: int = 5, least: float = 0.4, distance: int = 3) -> DataFrame:
    """``correction, score, distance``: words that share a tenth of their bigrams and are near enough, best first."""
    q = F.lit(query.lower())
    words = vocabulary.select(F.lower(col).alias("correction")).distinct()
    near = words.filter(T.jaccard(T.ngrams(F.col("correction"), 2), T.ngrams(q, 2)) >= 0.1).withColumn("distance", F.levenshtein("correction", q)).filter(F.col("distance") <= distance)
    scored = near.withColumn("score", F.round(1 - F.col("distance") / F.greatest(F.length("correction"), F.length(q)), 6)).filter(F.col("score") >= least)
    return scored.select("correction", "score", "distance").orderBy(F.desc("score"), "distance", "correction").limit(limit)


def mentions(texts: DataFrame, text: Column, names: list[str], least: int = 2) -> DataFrame:
    """``ord, name`` of known names that stand in a text as words, without case; the names are a list of the query."""
    kept = sorted((n for n in dict.fromkeys(names) if len(n) >= least), key=lambda n: (-len(n), n))
    found = [F.when(text.rlike(rf"(?i)(?:^|\W)\Q{n}\E(?:\W|$)"), F.lit(n)) for n in kept]
    return texts.select("ord", F.explode(F.array_compact(F.array(*found))).alias("name")) if found else texts.select("ord", F.lit("").alias("name")).limit(0)


def resolve_aliases(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """``ref, name``: the entity of a reference, itself where it is no alias; aliases are one level deep."""
    return refs.join(aliases.select(F.col("alias").alias("ref"), F.col("name").alias("found")), "ref", "left").select("ref", F.coalesce("found", "ref").alias("name"))


def layer_union(*layers: DataFrame) -> DataFrame:
    """Rows (``ord, score``) of several layers, once for each ord, with the best score."""
    return reduce(DataFrame.unionByName, layers).groupBy("ord").agg(F.max("score").alias("score"))


# -- changes -----------------------------------------------------------------------------


def create_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities after creating ``new`` ones (name, tags, created_at): known names are left as they are.

    Of new rows with one name the earliest stays; tags are lower-cased and distinct.
    """
    first = new.groupBy("name").agg(F.min_by(F.struct("tags", "created_at"), F.struct("created_at", "tags")).alias("r")).select("name", F.array_sort(F.array_distinct(F.transform("r.tags", F.lower))).alias("tags"), "r.created_at")
    return old.select("name", "tags", "created_at").unionByName(first.join(old.select("name"), "name", "left_anti"))


def update_entities(old: DataFrame, changes: DataFrame, value: str) -> DataFrame:
    """``name, value, version, status`` after changes (name, value, expected).

    A change applies if it expects no version or the one there is, and raises it; a null value keeps the old one.
    """
    met = old.join(changes.select("name", F.col(value).alias("__new"), "expected", F.lit(True).alias("__asked")), "name", "left")
    fits = F.coalesce("__asked", F.lit(False)) & (F.col("expected").isNull() | (F.col("expected") == F.col("version")))
    status = F.when(F.col("__asked").isNull(), "kept").when(fits, "updated").otherwise("conflict")
    return met.select("name", F.when(fits, F.coalesce("__new", value)).otherwise(F.col(value)).alias(value), F.when(fits, F.col("version") + 1).otherwise(F.col("version")).alias("version"), status.alias("status"))


def create_relations(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst, relation_type, status`` of new relations: ``dangling``, ``existing`` or ``created``; repeats count once."""
    keys = ["src", "dst", "relation_type"]
    have = nodes.select(F.col("node")).distinct()
    asked = new.select(*keys).distinct().join(have.select(F.col("node").alias("src"), F.lit(True).alias("a")), "src", "left").join(have.select(F.col("node").alias("dst"), F.lit(True).alias("b")), "dst", "left")
    met = asked.join(old.select(*keys, F.lit(True).alias("known")).distinct(), keys, "left")
    status = F.when(F.col("a").isNull() | F.col("b").isNull(), "dangling").when(F.col("known"), "existing").otherwise("created")
    return met.select(*keys, status.alias("status"))


def change_observations(entities: DataFrame, added: Column | None = None, removed: Column | None = None) -> Column:
    """Observations after adding some (exact repeats are dropped) and removing others."""
    out = F.coalesce("observations", _empty())
    if added is not None:
        out = F.array_union(out, F.coalesce(added, _empty()))
    return F.array_except(out, F.coalesce(removed, _empty())) if removed is not None else out


def _exchange(old: str, new: str):
    return lambda x: F.when(x == old, F.lit(new)).otherwise(x)


def change_tags(added: list[str] | None = None, removed: list[str] | None = None, renamed: dict[str, str] | None = None) -> Column:
    """Lower-cased tags after renaming, adding and removing some; each once, in order."""
    out = F.transform(F.coalesce("tags", _empty()), F.lower)
    for old, new in (renamed or {}).items():
        out = F.transform(out, _exchange(old.lower(), new.lower()))
    if added:
        out = F.array_union(out, F.array(*[F.lit(t.lower()) for t in added]))
    if removed:
        out = F.array_except(out, F.array(*[F.lit(t.lower()) for t in removed]))
    return F.array_sort(F.array_distinct(out))


def forget_observation(entities: DataFrame, content: str) -> DataFrame:
    """Entities without an observation; those that it leaves empty are dropped."""
    left = entities.withColumn("observations", F.filter(F.coalesce("observations", _empty()), lambda o: o != content))
    return left.filter(F.size("observations") > 0)


def governed(rows: DataFrame, **policies: Column) -> DataFrame:
    """Adds ``refused_by``: the first policy (in order of arguments) that a row fails or can't be told to meet, else null."""
    tests = [F.when(~F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in policies.items()]
    return rows.withColumn("refused_by", F.coalesce(*tests) if tests else F.lit(None).cast("string"))


def relation_checks(relations: DataFrame, now: str) -> DataFrame:
    """Adds ``issues`` and ``current``: bounds of weight and confidence, order of validity, and whether it holds at ``now``."""
    t = F.to_timestamp(F.lit(now))
    issue = lambda bad, name: F.when(F.coalesce(bad, F.lit(False)), F.lit(name))
    issues = F.array_compact(F.array(issue(~F.col("weight").between(0, 1), "weight"), issue(~F.col("confidence").between(0, 1), "confidence"), issue(F.col("valid_from") > F.col("valid_until"), "validity")))
    current = F.coalesce(F.col("valid_from") <= t, F.lit(True)) & F.coalesce(F.col("valid_until") >= t, F.lit(True))
    return relations.withColumn("issues", issues).withColumn("current", current)


def observations_asof(observations: DataFrame, meta: DataFrame, at: str) -> DataFrame:
    """Observations (ord, content) that hold at a time, by metadata (ord, content, line, valid_from, valid_until).

    Of metadata for one content the last line counts, of equal lines the one that holds longest; without any an observation always holds.
    """
    last = meta.groupBy("ord", "content").agg(F.max_by(F.struct("valid_from", "valid_until"), F.struct("line", "valid_until", "valid_from")).alias("m"))
    t = F.to_timestamp(F.lit(at))
    met = observations.join(last, ["ord", "content"], "left")
    return met.filter(F.coalesce(F.col("m.valid_from") <= t, F.lit(True)) & F.coalesce(F.col("m.valid_until") >= t, F.lit(True))).select("ord", "content")


# -- scores ------------------------------------------------------------------------------


def prd_importance(importance: Column, created: Column, accessed: Column, text: Column, now: str, query: str = "", decay: float = 1e-6, cooling: float = 1e-6, relevance: float = 0.35) -> Column:
    """(1 + importance / 10 * 2) times decay since creation and since the last access, plus the share of query words in the text."""
    age = lambda ts: F.greatest(F.lit(0.0), scoring.hours_since(ts, now) * 3600)
    base = (1 + F.coalesce(importance, F.lit(5.0)) / 10 * 2) * F.exp(-decay * F.coalesce(age(created), F.lit(0.0))) * F.exp(-cooling * F.coalesce(age(F.coalesce(accessed, created)), F.lit(0.0)))
    words = sorted(set(re.findall(r"[a-z0-9]+", query.lower())))
    if not words:
        return base
    own = F.array_distinct(T.tokenize_alphanumeric(F.coalesce(text, F.lit(""))))
    return base + F.size(F.array_intersect(own, F.array(*map(F.lit, words)))) / len(words) * relevance


def turn_importance(text: Column, keywords: list[str] | None = None, context: str | None = None) -> Column:
    """0 to 10: length, share of the keywords, and share of the text's words in the context (a half without one)."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    some = lambda xs: F.array(*map(F.lit, sorted(set(xs))))
    key = F.size(F.array_intersect(words, some(k.lower() for k in keywords))) / len(set(keywords)) if keywords else F.lit(0.0)
    near = F.lit(0.5)
    if context is not None:
        near = F.when(F.size(words) > 0, F.size(F.array_intersect(words, some(re.findall(r"[^\W_]+", context.lower())))) / F.size(words)).otherwise(0.0)
    raw = 0.3 * F.least(F.lit(1.0), F.log10(F.length(text)) / 4) + 0.4 * key + 0.3 * near
    return F.when(F.length(text) > 0, F.least(F.lit(10.0), F.floor(raw * 10 + 0.5))).otherwise(0.0)


def failure_score(task: str, hint: Column, context: Column, attempted: Column) -> Column:
    """3 for each word of the task in the hint, 2 in the context, 1 in what was attempted."""
    words = [w for w in task.lower().split() if len(w) > 1]
    hit = lambda c, w: F.coalesce(F.contains(F.lower(c), F.lit(w)), F.lit(False)).cast("int")
    return reduce(lambda a, b: a + b, [3 * hit(hint, w) + 2 * hit(context, w) + hit(attempted, w) for w in words], F.lit(0))


def procedure_score(context: str, name: Column, triggers: Column) -> Column:
    """Jaccard similarity of the words (two letters or more) with those of the name and the triggers."""
    words = lambda c: F.filter(T.tokenize_alphanumeric(c), lambda w: F.length(w) >= 2)
    own = F.array_distinct(F.concat(words(name), words(F.array_join(F.coalesce(triggers, _empty()), " "))))
    return T.jaccard(own, F.array_distinct(words(F.lit(context))))


def success_rates(runs: DataFrame, key: str, ok: Column, order: list[str], alpha: float = 0.2, baseline: float = 0.5) -> DataFrame:
    """``key, runs, rate``: a moving rate folded over a key's runs in order, as a weighted sum (no run waits for another)."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])) - 1
    placed = runs.select(key, ok.cast("double").alias("ok"), back.alias("back"))
    n = F.count(F.lit(1))
    rate = F.sum(alpha * F.pow(F.lit(1 - alpha), "back") * F.col("ok")) + baseline * F.pow(F.lit(1 - alpha), n)
    return placed.groupBy(key).agg(n.alias("runs"), F.round(rate, 6).alias("rate"))


#: Levels of trust in ascending order (fixed values).
TRUST = ["unverified", "inferred", "verified", "ground-truth"]


def trust_rank(level: Column) -> Column:
    """1 to 4; an unknown or missing level is 0."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, TRUST)), level), F.lit(0))


def resolve_conflicts(claims: DataFrame, subject: str, strategy: str) -> DataFrame:
    """The claim (``ts, confidence, confirmations, trust, ord``) of each subject that a strategy chooses; ties to the smaller ord."""
    order = {"most_recent": "ts", "highest_confidence": "confidence", "most_confirmations": "confirmations"}
    first = trust_rank(F.col("trust")) if strategy == "trust_level" else F.col(order[strategy])
    return claims.groupBy(subject).agg(F.max_by("ord", F.struct(first.alias("x"), -F.col("ord"))).alias("winner"))


def degree_map(relations: DataFrame) -> DataFrame:
    """``node, degree, share``: relations of a node, a self-loop once, and their share of the largest degree."""
    ends = relations.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return ends.crossJoin(F.broadcast(ends.agg(F.max("degree").alias("top")))).select("node", "degree", F.round(F.col("degree") / F.col("top"), 6).alias("share"))


# -- records -----------------------------------------------------------------------------


def out_of_order(observations: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """Observations with a ``[T=iso]`` stamp before that of the last stamped one of their key."""
    stamped = observations.withColumn("stamp", F.try_to_timestamp(F.regexp_extract(text, r"\[T=([^\]]+)\]", 1))).filter("stamp is not null")
    before = F.lag("stamp").over(Window.partitionBy(key).orderBy(place))
    return stamped.withColumn("before", before).filter("stamp < before").drop("stamp", "before")


def last_sessions(events: DataFrame, key: str, ts: str, gap: str, last: int) -> DataFrame:
    """``key, session_no, n`` of the last sessions of each key."""
    from .temporal import sessions

    counted = sessions(events, key, ts, gap).groupBy(key, "session_no").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("session_no")))).filter(F.col("back") <= last).drop("back")


def due(triggers: DataFrame, now: str) -> DataFrame:
    """Adds ``state`` to triggers (status, fire_at, expires_at): pending ones are ``expired``, ``due`` or ``pending``; others stay."""
    t = F.to_timestamp(F.lit(now))
    state = F.when(F.col("status") != "pending", F.col("status")).when(F.col("expires_at") < t, "expired").when(F.col("fire_at") <= t, "due").otherwise(F.col("status"))
    return triggers.withColumn("state", state)


def artifacts(rows: DataFrame, tool: str | None = None, kind: str | None = None, since: str | None = None) -> DataFrame:
    """Artifacts of a tool and a type created since a time; undated ones fail that bound."""
    out = rows
    if tool is not None:
        out = out.filter(F.col("tool") == tool)
    if kind is not None:
        out = out.filter(F.col("artifact_type") == kind)
    return out.filter(F.col("created_at") >= F.to_timestamp(F.lit(since))) if since is not None else out


def profile_parts(observations: Column) -> tuple[Column, Column]:
    """Static and dynamic facts of a profile, by their prefix, without it."""
    part = lambda p: F.transform(F.filter(F.coalesce(observations, _empty()), lambda o: F.startswith(o, F.lit(p))), lambda o: F.trim(F.substring(o, F.lit(len(p) + 1), F.length(o))))
    return part("static:"), part("dynamic:")
