"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parsed_json(rows: DataFrame, column: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON conforms to the schema, with `parsed`, and those that do not, with `reason`: nothing is inferred and nothing is lost."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType(schema.fields).add("_corrupt", "string")
    read = rows.withColumn("parsed", F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    missing = [F.when(F.col(f"parsed.{f.name}").isNull(), F.lit(f.name)) for f in schema.fields if not f.nullable]
    reason = F.when(F.col(column).isNull(), "no document").when(F.col("parsed._corrupt").isNotNull(), "not readable")
    if missing:
        gaps = F.array_join(F.array_compact(F.array(*missing)), ",")
        reason = reason.when(gaps != "", F.concat(F.lit("missing: "), gaps))
    read = read.withColumn("reason", reason).withColumn("parsed", F.col("parsed").dropFields("_corrupt"))
    return read.filter("reason IS NULL").drop("reason"), read.filter("reason IS NOT NULL").drop("parsed")


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows, one a key, whose key is not stored; null keys are equal to each other."""
    seen = stored.select([F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return incoming.dropDuplicates(keys).join(seen, condition, "left_anti")


def append_new(incoming: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose key the Parquet table at `path` does not hold; returns how many. Stored rows are never changed."""
    spark = incoming.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = incoming.limit(0)
    fresh = new_rows(incoming, stored, keys).persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def merged(stored: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """The upserted table: columns of one key are reduced by their rule: min, max, sum, keep (first known) or replace (last known)."""
    both = stored.withColumn("__n", F.lit(0)).unionByName(incoming.withColumn("__n", F.lit(1)))
    reduce_ = {
        "min": F.min, "max": F.max, "sum": F.sum,
        "keep": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__n"))),
        "replace": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__n"))),
    }
    return both.groupBy(*keys).agg(*[reduce_[r](c).alias(c) for c, r in rules.items()])
