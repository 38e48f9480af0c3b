"""From raw documents to token ids: language, near copies, benchmark passages, mixture, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, mixing, simhash, token_files
from tessera.llm.common import new_folder, shuffles_freed, table, written

BUDGET = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin; what has no letter or a narrow one goes."""
    judged = langid.predict(docs.select("text", F.struct("*").alias("row")), langid.fit(docs))
    return judged.filter(~F.col("rejected")).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts alike to 0.8 in five-word shingles, that of the smallest doc_id, null ids last; the row decides, not its doc_id alone."""
    key = lambda h: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), h)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    first = simhash.text_classes(docs).groupBy("class").agg(F.min_by(key(F.col("h")), order).alias("__key")).select("__key")
    rows = docs.withColumn("__key", key(F.xxhash64(F.coalesce("text", F.lit("")))))
    return rows.dropDuplicates(["__key"]).join(written(first, "kept"), "__key", "left_semi").select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; a text is told by its hash, as a doc_id may be null or stand for several texts."""
    rows = docs.withColumn("__text", F.xxhash64("text"))
    found = decontam.contaminated(rows.select(F.col("__text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias("__text")).distinct(), "__text", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of BUDGET of the tokens, its sources, languages and forms raked to smoothed shares."""
    # the text stands beside the other columns and not among them, too, as the table of described rows holds all it gets
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    kept = mixing.mixed(docs.select("doc_id", "text", "lang", "source", others), budget=BUDGET).filter("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.read_token_files(token_files.write_token_files(docs, token_files.byte_bpe_path()))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_free),
    ("mixing", mixture),
    ("token_files", token_ids),
]

#: No SQL stands for compression sizes, connected components or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        with shuffles_freed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
