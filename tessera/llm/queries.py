"""The queries of the training-data operators: whole tables, production parameters, contract columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm import alignment, centroids, chat, decontam, fingerprint, hilbert, packing, phrases, quality, simhash, token_counts, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and its component over links of at most two bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op5_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that recur."""
    left = phrases.without_recurring(table(spark, sf_dir, "documents"), window=35)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), capacity=2048)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by the learned embeddings."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by the learned lexicon."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest, that of its edited text, and likenesses."""
    return fingerprint.with_edited(table(spark, sf_dir, "documents"))


#: A conversation whose texts are control strings of another template.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted by the template, and what is read back from it."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PROBE, rows.schema))
    in_turn = W.partitionBy("conv_id").orderBy("turn", "role", "text")  # a conversation is one output row
    rows = rows.withColumn("node", F.row_number().over(in_turn).cast("long"))
    messages = rows.select(F.col("conv_id").alias("tree"), "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    turns = chat.conversations(messages).select(F.expr("try_cast(tree as bigint)").alias("conv_id"), "formatted", chat.masked(F.col("formatted"), F.col("mask")).alias("loss"), chat.parsed(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    turns = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), "loss", "formatted")
    return turns.select("conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op7_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g') AS er,
            regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g') AS et FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(er) + length(et) + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back from the archives by byte ranges."""
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '([0-9-]+)>', 1) as bigint)")
    return back.select(page("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"))


ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
t AS (SELECT s, max(page_id) AS top FROM p GROUP BY s),
n AS (SELECT s, list_transform([1, 11, 21, 31], lambda i: CAST('0x' || substr(s, i, 10) AS BIGINT)) AS five FROM t),
d AS (SELECT s, array_to_string(list_transform(five, lambda v: array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0],
        lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> k) & 31 AS INTEGER) + 1, 1)), '')), '') AS digest FROM n)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN t USING (s) JOIN d USING (s)
"""

ORACLES["op5_phrases"] = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT rid, unnest(list_transform(range(1, len(ws) - 33), lambda i: array_to_string(ws[i:i + 34], ' '))) AS run,
             unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY run) AS n FROM k) WHERE n > 1),
g AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM r),
x AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
f AS (SELECT x.rid, count(g.p) AS gone, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE g.p IS NULL) AS kept
      FROM x LEFT JOIN g ON g.rid = x.rid AND g.p = x.p GROUP BY x.rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN f USING (rid)
"""


@query
def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards along a Hilbert curve, by the law of rows."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = hilbert.sharded(rows, ["lang", "source", "size"], 24, ["doc_id", "size", "text_crc32"], tie="doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents into which an item of the benchmark leaked, with the item."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the word tokenizer, each distinct pre-token counted once."""
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links of byte-level and sentence-piece tokens, with the links' corpus counts."""
    return alignment.aligned(table(spark, sf_dir, "documents"))


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every complete vector's nearest of 40 centroids after five rounds."""
    return centroids.clustered(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5)


def _centroids_sql(clusters: int, rounds: int) -> str:
    """The rounds written out, one after the other."""
    near = """a{t} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.rid, m.c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - m.x[i]) * (v.x[i] - m.x[i])))::BIGINT AS d FROM v, m{t} m) GROUP BY rid)"""
    moved = """m{u} AS MATERIALIZED (
  SELECT m.c, coalesce(n.x, m.x) AS x FROM m{t} m LEFT JOIN (
    SELECT c, list(f ORDER BY i) AS x FROM (
      SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (
        SELECT c, i, sum(q)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(v.x) AS q, generate_subscripts(v.x, 1) AS i FROM a{t} a JOIN v USING (rid)) GROUP BY c, i))
    GROUP BY c) n USING (c))"""
    steps = [near.format(t=t) + (",\n" + moved.format(t=t, u=t + 1) if t < rounds else "") for t in range(rounds + 1)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda q: CAST(floor(256 * CAST(q AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda q: q IS NOT NULL AND isfinite(q))) = 64),
m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {clusters})),
{",\n".join(steps)},
t AS (SELECT c, CAST(sum(d) AS BIGINT) AS own FROM a{rounds} GROUP BY c),
w AS (SELECT CAST(sum(d) AS BIGINT) AS whole FROM a{rounds})
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, own AS cluster_inertia, whole AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN t USING (c) JOIN m{rounds} m USING (c), w
"""


ORACLES["op13_centroids"] = _centroids_sql(40, 5)
