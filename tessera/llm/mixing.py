"""Mixing sources to target weights.

Token weights of the cells (source, language, topic) are raked to the three target marginals by
iterative proportional fitting; a document is then kept with its cell's calibrated probability.
Topics are those of `topics`. One path serves any number of cells: sources stay a table, languages and topics are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import topics
from .common import table, written

DIMENSIONS, UNKNOWN = ("source", "lang", "topic"), "unknown"
ROUNDS, STALLED, CLOSE, SMOOTH, BUDGET, SEED = 200, 5, 1e-9, 0.7, 0.5, 42


def described(text: Column, model: topics.Model) -> Column:
    """(topic, n_tokens) of a text: `t` and the number of its topic in the model, `none` for a text without a word; its white-space tokens."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            names, tokens = [], []
            for at in range(0, len(part), topics.CHUNK):
                counts, n = topics.features_of(part.iloc[at : at + topics.CHUNK].to_list())
                tokens += n.tolist()
                names += ["none" if k < 0 else f"t{k:02d}" for k in model(counts).tolist()]
            yield pd.DataFrame({"topic": names, "n_tokens": tokens})

    return F.pandas_udf(run, "topic string, n_tokens long")(text)


def smoothed_targets(cells: DataFrame, power: float = SMOOTH) -> dict[str, DataFrame]:
    """For each dimension (value, target): token shares to the given power, so that small values gain.

    Sources and topics are smoothed within each language and summed with the languages' targets, as topics nearly part the languages:
    targets smoothed one by one would contradict each other.
    """
    tokens = F.sum("tokens").cast("double")
    whole = Window.partitionBy(F.lit(0))  # over languages, which are few
    out = {"lang": cells.groupBy(F.col("lang").alias("value")).agg(F.pow(tokens, F.lit(power)).alias("part")).select("value", (F.col("part") / F.sum("part").over(whole)).alias("target"))}
    for d in ("source", "topic"):
        parts = cells.groupBy("lang", d).agg(F.pow(tokens, F.lit(power)).alias("part"))
        all_ = parts.groupBy("lang").agg(F.sum("part").alias("all")).join(out["lang"].withColumnRenamed("value", "lang"), "lang")
        out[d] = parts.join(F.broadcast(all_), "lang").groupBy(F.col(d).alias("value")).agg(F.sum(F.col("target") * F.col("part") / F.col("all")).alias("target"))
    return out


def rake_pairs(sums: np.ndarray, rows: np.ndarray, columns: np.ndarray, row_targets: np.ndarray, column_targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors of rows and columns that bring a table to both targets, from the given ones on."""
    part = lambda want, have: np.divide(want, have, out=np.zeros_like(want), where=have > 0)
    held = lambda x: np.where(x > 0, np.clip(x, 1e-9, 1e9), 0.0)  # noqa: E731  # contradicting targets drive factors without end
    for _ in range(ROUNDS):
        before = rows, columns
        rows = part(row_targets, sums @ columns)
        columns = part(column_targets, sums.T @ rows)
        size = max(columns.max(initial=0), 1e-300)  # only the product of the two counts
        rows, columns = held(rows * size), held(columns / size)
        if all(np.allclose(a, b, rtol=CLOSE, atol=0) for a, b in zip(before, (rows, columns))):
            break
    return rows, columns


def _wanted(targets: DataFrame, values: list[str]) -> np.ndarray:
    """The targets of the values that occur, scaled to 1; even ones where none has a target."""
    found = {r.value: r.target for r in targets.filter(F.col("value").isin(values)).collect()}
    t = np.array([found.get(v, 0.0) for v in values])
    return t / t.sum() if t.sum() > 0 else np.full(len(t), 1 / max(1, len(t)))


def raked(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """cells with weight, raked to the targets by iterative proportional fitting.

    Sources may be many, so they stay a table: in a round each source is scaled to its target, which needs its own cells only, and the sums over all
    sources for each (language, topic), a small matrix, are then raked to the targets of languages and topics. Targets that contradict each other
    cannot all be met: fitting ends when STALLED rounds brought the sums no nearer, and the sources' targets hold.
    """
    spark = cells.sparkSession
    langs, kinds = (sorted(r[0] for r in cells.select(d).distinct().collect()) for d in ("lang", "topic"))
    want_lang, want_topic = _wanted(targets["lang"], langs), _wanted(targets["topic"], kinds)
    wanted = cells.select(F.col("source").alias("value")).distinct().join(targets["source"], "value", "left").select(F.col("value").alias("source"), F.coalesce("target", F.lit(0.0)).alias("want"))
    total, n = wanted.agg(F.sum("want"), F.count("*")).first()
    share = F.col("want") / F.lit(total) if total and total > 0 else F.lit(1.0 / max(1, n))
    base = written(cells.join(wanted.select("source", share.alias("want")), "source"), "rake")
    by_source = Window.partitionBy("source")

    def scaled(rows: np.ndarray, columns: np.ndarray) -> DataFrame:
        factors = spark.createDataFrame([(a, b, float(x * y)) for a, x in zip(langs, rows) for b, y in zip(kinds, columns)], "lang string, topic string, factor double")
        met = base.join(F.broadcast(factors), ["lang", "topic"])
        own = F.sum(F.col("tokens") * F.col("factor")).over(by_source)
        return met.withColumn("own", own).withColumn("scale", F.when(F.col("own") > 0, F.col("want") / F.col("own")).otherwise(0.0))

    rows, columns, best, stalled = np.ones(len(langs)), np.ones(len(kinds)), np.inf, 0
    while True:
        sums = np.zeros((len(langs), len(kinds)))
        for r in scaled(rows, columns).groupBy("lang", "topic").agg(F.sum(F.col("tokens") * F.col("scale")).alias("s")).collect():
            sums[langs.index(r.lang), kinds.index(r.topic)] = r.s
        w = sums * rows[:, None] * columns[None]
        off = max(np.abs(w.sum(1) - want_lang).max(initial=0), np.abs(w.sum(0) - want_topic).max(initial=0))
        best, stalled = min(best, off), 0 if off < 0.9 * best else stalled + 1
        if off < CLOSE or stalled == STALLED:
            break
        rows, columns = rake_pairs(sums, rows, columns, want_lang, want_topic)
    found = scaled(rows, columns).withColumn("w", F.col("tokens") * F.col("factor") * F.col("scale"))
    found = written(found.select(*DIMENSIONS, "tokens", "w"), "raked")
    return found.withColumn("weight", F.col("w") / F.lit(found.agg(F.sum("w")).first()[0] or 1.0)).drop("w")


def calibrated(cells: DataFrame, budget: float) -> DataFrame:
    """cells with probability min(1, s weight / tokens), s such that the expected tokens are the share `budget` of all, or all there are.

    A cell that reaches 1 stays there, so s is solved for the others until no new one does.
    """
    wanted = budget * (cells.agg(F.sum("tokens")).first()[0] or 0)
    s, full = wanted, -1
    while True:
        sure = F.col("weight") * F.lit(s) >= F.col("tokens")
        kept, rest, n = cells.agg(F.coalesce(F.sum(F.when(sure, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~sure, F.col("weight"))), F.lit(0.0)), F.count_if(sure)).first()
        if n == full:
            break
        full, s = n, max(s, (wanted - kept) / rest) if rest > 0 else float("inf")
        if s == float("inf"):
            return cells.withColumn("probability", (F.col("weight") > 0).cast("double"))
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(s) / F.col("tokens")))


def mixed(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, text: str = "text", model: topics.Model | None = None, seed: int = SEED
) -> DataFrame:
    """docs with topic, n_tokens, weight, probability and kept.

    weight is the cell's raked share of all tokens, probability the share of it to keep so that the expected
    tokens are `budget` of all, never over 1. `targets` has for each of source, lang, topic a small table
    (value, target); values without a target get weight 0, targets of values that do not occur are left out
    and the rest scaled to 1. Null categories count as `unknown`. Documents without a token have weight null and
    probability 1. `model` tells the topics; by default it is fitted on docs. Keeping depends on doc_id, text and seed alone, so repeated rows share their fate. The columns added replace columns of
    the same names; an empty table gives an empty one.
    """
    model = topics.fit(docs, text) if model is None else model
    kinds = {f"__{d}": F.coalesce(F.col(d), F.lit(UNKNOWN)) for d in ("source", "lang")}
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.col(text), F.lit(seed)), 11) / F.lit(float(2**53))
    told = {c: F.col(f"__told.{c}") for c in ("topic", "n_tokens")}
    # texts are described once: the sums over cells and the documents' fates read the same table
    rows = written(docs.withColumns(kinds).withColumns({"__told": described(F.col(text), model), "__draw": draw}).withColumns(told).drop("__told"), "described")
    cells = written(
        rows.filter("n_tokens > 0").groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), "topic").agg(F.sum("n_tokens").alias("tokens")), "cells"
    )
    found = written(calibrated(raked(cells, smoothed_targets(cells) if targets is None else targets), budget), "probabilities")
    found = found.select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"), F.col("weight").alias("__weight"), F.col("probability").alias("__probability"))
    met = rows.join(found, (rows["__source"] == found["__source"]) & (rows["__lang"] == found["__lang"]) & (rows["topic"] == found["__topic"]) & (rows["n_tokens"] > 0), "left")
    met = met.drop(found["__source"]).drop(found["__lang"])
    met = met.withColumns({"weight": F.col("__weight"), "probability": F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.coalesce("__probability", F.lit(0.0)))})
    return met.withColumn("kept", F.col("__draw") < F.col("probability")).drop("__source", "__lang", "__topic", "__weight", "__probability", "__draw")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept")
