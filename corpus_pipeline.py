"""The corpus pipeline: quality, near-duplicates, recurring passages, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read back as the next
one's ``docs``. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, packing, phrases, quality, simhash
from tessera.llm.common import columns_of, fresh, made, release, stored, sweep

#: A document whose quality score is lower goes.
LEAST_QUALITY = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled rows of ``docs``, does not reject.

    Null and empty texts have the labels' share of good ones as their score; a long text is scored
    whole; repeated rows go or stay together; an empty table gives no rows.
    """
    model = quality.fit(_table(spark, sf_dir, "labels"), docs)
    (score,) = fresh(docs.columns, "score")
    return quality.scored(docs, model, carry=tuple(docs.columns), new=score).where(F.col(score) >= LEAST_QUALITY).select(*columns_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the least id.

    Different texts of one id are documents of their own; of repeated rows of an id and text one
    stays, whatever the types of its columns; documents without an id are in no group and stay; all
    shingles of a long text count; an empty table gives no rows.
    """
    doc, hashed = fresh(docs.columns, "tessera_id", "tessera_hash")
    found = stored(simhash.similar_documents(docs, similarity=0.8, shingle=5), "groups").select(F.col("id").alias(doc), F.col("hash").alias(hashed), "kept")
    own = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(hashed, F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = found.where("not kept").select(doc, hashed).distinct()
    kept = own.join(gone, [doc, hashed], "left_anti")
    again = stored(found.where("kept").groupBy(doc, hashed).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(doc, hashed), "repeated")
    if again.isEmpty():
        return kept.select(*columns_of(docs))
    told = [F.to_json(F.struct(c)) if "map<" in kind else c for c, (_, kind) in zip(columns_of(docs), docs.dtypes, strict=True)]  # maps have no hash
    one = kept.join(again, [doc, hashed], "left_semi").groupBy(doc, hashed).agg(F.min_by(F.struct(*columns_of(docs)), F.xxhash64(*told)).alias(doc + "_row"))
    return kept.join(again, [doc, hashed], "left_anti").select(*columns_of(docs)).unionByName(one.select(doc + "_row.*"))


def recurring_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 35-word windows that recur; a text that loses none stays as it was, null included.

    ``n_chars`` follows the text where the table has it. Repeated rows lose their common windows; all
    windows of a long text count; an empty table gives no rows.
    """
    carry = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    words, removed, kept = fresh(docs.columns, "n_words", "n_removed", "kept")
    left = phrases.without_recurring(docs, window=35, carry=carry, original=True, new=(words, removed, kept))
    left = left.withColumn("text", F.col(kept)).withColumn("n_chars", F.length(kept).cast("long"))
    return left.select(*columns_of(docs))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked.

    Null texts and texts of repeated rows are judged like any other; a document without an id stays if
    its text has no leak; of several texts of one id only those with a leak go; all passages of a long
    text are looked at; an empty table gives no rows.
    """
    (key,) = fresh(docs.columns, "tessera_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    gone = decontam.leaks(keyed, _table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(gone, key, "left_anti").select(*columns_of(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, each with its sequence of at most 2048 tokens and its place there.

    Null texts are as empty; repeated rows and rows without an id are documents of their own; a long text
    has as many pieces as it needs; an empty table gives no rows.
    """
    return packing.packed(docs, capacity=2048)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", recurring_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packed_sequences),
]

#: Learned scores and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written to the shared folder and read again.

    What a stage wrote on its way is deleted once its result is written, and so is its input.
    """
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since, before = made(), docs
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, since, docs)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
