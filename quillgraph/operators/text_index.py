"""A persisted inverted index of texts with incremental upkeep, for BM25 and TF-IDF.

An index is a folder that driver and executors share.  It has immutable segments and
numbered manifests; the last manifest names the live segments and the totals.  A segment
holds signed postings, ``+1`` for a text that came and ``-1`` for one that went, in
directories by a bucket of the term, sorted by its hash: a query reads the buckets of its own
words only, and of those the row groups that can hold them.  It also holds the changed
texts' own words, so that an update finds what to take back without a scan of postings.

Sums over the signs give the current postings whatever the order of changes, so adding a
segment never rewrites another one; ``compact`` folds them into one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..session import remove_path

#: Postings of one file, about; a bucket with more has more files, so no common word is one task.
_FILE_ROWS = 2_000_000
_POSTING = "key bigint, term string, ord {kind}, tf int, words int, tokens int, sign int, bucket int"
_DOCUMENT = "ord {kind}, terms array<struct<term: string, tf: int>>, words int, tokens int, sign int, distinct int, seq bigint, part int"


# -- manifests ---------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """The last manifest of an index; nothing where there is none."""
    fs, path = _files(spark, f"{folder}/manifests")
    if not fs.exists(path):
        return None
    names = sorted(f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName().endswith(".json"))
    if not names:
        return None
    return json.loads("".join(r.value for r in spark.read.text(f"{folder}/manifests/{names[-1]}").collect()))


def _commit(spark: SparkSession, folder: str, new: dict) -> None:
    """Writes the next manifest; of two writers of one version the second fails."""
    fs, path = _files(spark, f"{folder}/manifests/{new['version']:012d}.json")
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifests/{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if fs.exists(path) or not fs.rename(draft, path):
        fs.delete(draft, False)
        raise RuntimeError(f"{folder}: version {new['version']} was written by another one")


# -- segments ----------------------------------------------------------------------------


def _analysed(docs: DataFrame) -> DataFrame:
    """``ord, terms, words, tokens`` of texts: distinct tokens with their counts, the length without stop words, and with them."""
    tokens = F.coalesce(T.tokenize(F.col("text")), F.array().cast("array<string>"))
    # Runs in the sorted tokens are the counts: texts of any length take linear time after the sort, in their own task.
    counted = docs.select("ord", F.sort_array(tokens).alias("t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    runs = counted.select("ord", "t", F.when(F.size("t") > 0, starts).otherwise(F.array().cast("array<int>")).alias("at"))
    terms = F.transform("at", lambda i, n: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("at", n + 1), F.size("t")) - i).alias("tf")))
    both = runs.select("ord", terms.alias("terms"), F.size("t").alias("tokens"), F.size(F.filter("t", lambda x: ~x.isin(T.BM25_STOP_WORDS))).alias("words"))
    return both.select("ord", "terms", "words", "tokens")


def _bucket(value: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(n)).cast("int")


def _write_segment(spark: SparkSession, folder: str, documents: DataFrame, buckets: int, seq: int) -> tuple[str, int, int, int]:
    """Writes signed ``ord, terms, words, tokens, sign``; returns the name and what texts, words and tokens it adds."""
    name = f"{seq:012d}-{uuid.uuid4().hex}"
    root = {t: f"{folder}/{t}/segment={name}" for t in ("documents", "postings")}
    placed = documents.withColumn("distinct", F.size("terms")).withColumn("seq", F.lit(seq).cast("bigint")).withColumn("part", _bucket(F.col("ord"), buckets))
    # Large buckets are dealt over more tasks, by their bytes.
    placed.hint("rebalance", "part").sortWithinPartitions("part", "ord").write.partitionBy("part").parquet(root["documents"])
    kind = documents.schema["ord"].dataType.simpleString()
    kept = spark.read.schema(_DOCUMENT.format(kind=kind)).parquet(root["documents"])
    texts, words, tokens, postings = kept.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("sign"), F.col("sign") * F.col("words"), F.col("sign") * F.col("tokens"), F.col("distinct"))]).first()
    flat = kept.select("ord", "words", "tokens", "sign", F.explode("terms").alias("t")).select("t.term", "ord", F.col("t.tf").alias("tf"), "words", "tokens", "sign", _bucket(F.col("t.term"), buckets).alias("bucket"))
    pieces = max(1, -(-postings // (_FILE_ROWS * buckets)))
    dealt = flat.repartition(buckets * pieces, "bucket", F.pmod(F.xxhash64("ord"), F.lit(pieces)))
    # Sorted by the hash alone, which takes no comparisons of rows: a task's few buckets are written side by side, not one after the other.
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, buckets)
    try:
        dealt.withColumn("key", F.xxhash64("term")).sortWithinPartitions("key").write.partitionBy("bucket").parquet(root["postings"])
    finally:
        spark.conf.set(writers, before)
    return name, int(texts), int(words), int(tokens)


def _read(spark: SparkSession, folder: str, now: dict, table: str) -> DataFrame:
    schema = {"postings": _POSTING, "documents": _DOCUMENT}[table].format(kind=now["kind"])
    paths = [f"{folder}/{table}/segment={s}" for s in now["segments"]]
    return spark.read.schema(f"{schema}, segment string").option("basePath", f"{folder}/{table}").parquet(*paths).drop("segment")


def build(docs: DataFrame, folder: str, buckets: int = 64) -> dict:
    """Indexes ``ord, text`` in an empty folder; ids must be distinct and not null. Null texts have no words."""
    spark = docs.sparkSession
    if manifest(spark, folder) is not None:
        raise ValueError(f"{folder} has an index already")
    name, n, words, tokens = _write_segment(spark, folder, _analysed(docs).withColumn("sign", F.lit(1)), buckets, 1)
    now = {"version": 1, "buckets": buckets, "kind": docs.schema["ord"].dataType.simpleString(), "segments": [name], "texts": n, "words": words, "tokens": tokens, "streams": {}}
    _commit(spark, folder, now)
    return now


def current_documents(spark: SparkSession, folder: str, now: dict, only: DataFrame | None = None) -> DataFrame:
    """``ord, terms, words, tokens`` of the texts in the index, or of those in ``only``: what came last and did not go."""
    docs = _read(spark, folder, now, "documents")
    if only is not None:
        keys = only.select("ord", _bucket(F.col("ord"), now["buckets"]).alias("part")).distinct()
        docs = docs.join(keys, ["part", "ord"], "left_semi")
    if len(now["segments"]) > 1:  # one alone has each text once
        docs = docs.withColumn("at", 2 * F.col("seq") + (F.col("sign") > 0).cast("int"))
        # The last place is found without the terms, which meet it once.
        docs = docs.join(docs.groupBy("ord").agg(F.max("at").alias("at")), ["ord", "at"])
    return docs.filter("sign > 0").select("ord", "terms", "words", "tokens")


def apply_changes(changes: DataFrame, folder: str, stream: str | None = None, batch: int | None = None) -> dict:
    """Adds a segment for ``ord, text, op, at``: op ``remove`` takes a text away, any other puts it in place of what there is.

    Of several changes of one text the one with the greatest ``at`` counts, of those the
    one with the greatest op and text.  Removing what is not there changes nothing.  A
    ``batch`` of a ``stream`` that a manifest has is left out, so a repeated micro-batch does no harm.
    """
    spark = changes.sparkSession
    now = manifest(spark, folder)
    if now is None:
        raise ValueError(f"{folder} has no index")
    if stream is not None and now["streams"].get(stream, -1) >= batch:
        return now
    last = changes.filter("ord is not null").groupBy("ord").agg(F.max_by(F.struct("op", "text"), F.struct("at", "op", "text")).alias("c")).select("ord", "c.op", "c.text")
    fresh = _analysed(last.filter("op is null or op <> 'remove'").select("ord", "text")).withColumn("sign", F.lit(1))
    stale = current_documents(spark, folder, now, last).withColumn("sign", F.lit(-1))
    seq = now["version"] + 1
    name, n, words, tokens = _write_segment(spark, folder, stale.unionByName(fresh), now["buckets"], seq)
    new = now | {"version": seq, "segments": [*now["segments"], name], "texts": now["texts"] + n, "words": now["words"] + words, "tokens": now["tokens"] + tokens}
    if stream is not None:
        new["streams"] = now["streams"] | {stream: batch}
    _commit(spark, folder, new)
    return new


def compact(spark: SparkSession, folder: str) -> dict:
    """Folds all segments into one and deletes them; readers of an older manifest must be done."""
    now = manifest(spark, folder)
    seq = now["version"] + 1
    name, n, words, tokens = _write_segment(spark, folder, current_documents(spark, folder, now).withColumn("sign", F.lit(1)), now["buckets"], seq)
    new = now | {"version": seq, "segments": [name], "texts": n, "words": words, "tokens": tokens}
    _commit(spark, folder, new)
    for s in now["segments"]:
        for table in ("documents", "postings"):
            remove_path(spark, f"{folder}/{table}/segment={s}")
    return new


def maintain(changes: DataFrame, folder: str, checkpoint: str, stream: str = "changes", **trigger: object) -> StreamingQuery:
    """Keeps an index up with a stream of changes, one segment for each micro-batch; ``trigger`` as of ``DataStreamWriter``."""

    def merge(batch: DataFrame, number: int) -> None:
        apply_changes(batch, folder, stream, number)

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(merge).start()


# -- ranking -----------------------------------------------------------------------------


def postings_of(spark: SparkSession, folder: str, words: list[str]) -> tuple[dict, DataFrame]:
    """The manifest and the current ``term, ord, tf, words, tokens`` of some words; other buckets are not read."""
    now = manifest(spark, folder)
    if now is None:
        raise ValueError(f"{folder} has no index")
    terms = list(dict.fromkeys(words))
    of = [F.struct(F.xxhash64(F.lit(t)).alias("key"), _bucket(F.lit(t), now["buckets"]).alias("bucket")) for t in terms]
    places = spark.range(1).select(F.array(*of).alias("p")).first()["p"] if terms else []
    wanted = F.col("bucket").isin(sorted({p["bucket"] for p in places})) & F.col("key").isin([p["key"] for p in places]) & F.col("term").isin(terms)
    rows = _read(spark, folder, now, "postings").filter(wanted).drop("key")
    signed = rows.groupBy("term", "ord").agg(F.sum("sign").alias("n"), *[F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("tf", "words", "tokens")])
    return now, signed.filter("n > 0").drop("n")


def _repeats(words: list[str]) -> Column:
    """How often the query has a row's term."""
    return F.element_at(F.create_map(*[F.lit(x) for w in dict.fromkeys(words) for x in (w, words.count(w))]), F.col("term")).cast("double")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    return scored.groupBy("ord").agg(F.round(F.sum("s"), 6).alias("score")).filter("score > 0").orderBy(F.desc("score"), "ord").limit(k)


def bm25(spark: SparkSession, folder: str, query: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best texts of an index by BM25: ``ord, score``; as ``search.bm25`` over the same texts."""
    words = [w for w in T.query_tokens(query) if w not in T.BM25_STOP_WORDS]
    now, rows = postings_of(spark, folder, words)
    if not words:
        return rows.select("ord", F.lit(0.0).alias("score")).limit(0)
    mean = now["words"] / now["texts"] if now["texts"] else 1.0
    idf = F.ln((now["texts"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("words") / F.lit(mean or 1.0)))
    return _ranked(_with_df(rows).select("ord", (_repeats(words) * idf * share).alias("s")), k)


def tfidf(spark: SparkSession, folder: str, query: str, k: int = 10) -> DataFrame:
    """The k best texts of an index by the sum of tf * ln(N / df); as ``search.tfidf`` over the same texts."""
    words = T.query_tokens(query)
    now, rows = postings_of(spark, folder, words)
    if not words:
        return rows.select("ord", F.lit(0.0).alias("score")).limit(0)
    return _ranked(_with_df(rows).select("ord", (_repeats(words) * F.col("tf") / F.greatest(F.col("tokens"), F.lit(1)) * F.ln(now["texts"] / F.col("df"))).alias("s")), k)


def _with_df(rows: DataFrame) -> DataFrame:
    """Postings with the number of texts of their term: a count for each word of the query."""
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return rows.join(F.broadcast(df), "term")  # a row for each word of the query
