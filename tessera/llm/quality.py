"""Quality classification by compression.

A sample of texts of each label becomes a zstandard raw-content dictionary. A text is cut into pieces of about PIECE bytes, and each piece is
compressed with the dictionary of bad texts, with that of good ones, and alone. The difference of the sizes, as a share of their sum, over the whole
text and in its worst piece, is calibrated into a probability by a logistic curve on labelled texts that are in no dictionary; the calibration
also reads the sizes that need no label (alone and under the good dictionary, per byte, and the number of bytes), as a text that repeats
itself compresses alike under any dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, written

#: Bounds of the fit, for each label: documents of the dictionary and characters of each, documents of the calibration (their whole texts are scored).
DICTIONARY, SAMPLE_CHARS, CALIBRATION = 384, 600, 1024
PIECE, LEVEL, PLAIN_LEVEL, THRESHOLD = 512, 6, 3, 0.3
#: Strength of the ridge penalty on standardised features, and bytes added to a size so that short texts have no extreme ratios.
RIDGE, FLOOR = 0.1, 20
FEATURES = ["difference", "worst", "alone", "worst_alone", "under_good", "log_bytes"]


class Model(NamedTuple):
    """What a fit learns: dictionary contents, and the curve (centre, scale, weights; the intercept first), or the share of label 1 where there is nothing to compare."""

    bad: bytes
    good: bytes
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    share: float = 0.5


class Scorer:
    def __init__(self, model: Model):
        self.model = model

    def __reduce__(self):
        return Scorer, (self.model,)  # compressors can't be pickled

    @cached_property
    def coders(self) -> list[zstd.ZstdCompressor]:
        bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        out = []
        for content in (self.model.bad, self.model.good):
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, **bare))
        return [*out, zstd.ZstdCompressor(level=PLAIN_LEVEL, **bare)]

    def features(self, text: str) -> list[float]:
        """FEATURES of a whole text."""
        data = text.encode("utf-8", "replace")
        pieces = pieces_of(data)
        sizes = np.array([[len(c.compress(p)) for c in self.coders] for p in pieces], float)
        bytes_ = np.array([len(p) for p in pieces], float) + FLOOR
        bad, good, alone = sizes.sum(0)
        n = len(data) + FLOOR
        each = (sizes[:, 0] - sizes[:, 1]) / (sizes[:, 0] + sizes[:, 1])
        return [(bad - good) / (bad + good), each.min(), np.log(alone / n), np.log((sizes[:, 2] / bytes_).min()), np.log(good / n), np.log(n)]

    def scores(self, features: np.ndarray) -> np.ndarray:
        return curve(features, self.model) if self.model.weights else np.full(len(features), self.model.share)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.scores(np.array([self.features(t) if self.model.weights else [0.0] * len(FEATURES) for t in texts]).reshape(-1, len(FEATURES)))


def pieces_of(data: bytes) -> list[bytes]:
    """Pieces of nearly one length, of PIECE bytes where there are several; one empty piece of nothing."""
    step = -(-len(data) // max(1, round(len(data) / PIECE))) or 1
    return [data[i : i + step] for i in range(0, max(1, len(data)), step)]


def curve(features: np.ndarray, model: Model) -> np.ndarray:
    z = (features - np.array(model.centre)) / np.array(model.scale)
    return 1 / (1 + np.exp(-np.clip(z @ np.array(model.weights[1:]) + model.weights[0], -35, 35)))


def calibrated(features: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """Centre, scale and weights of the ridge logistic curve of best weighted likelihood, by Newton steps that are halved until they gain."""
    centre, scale = features.mean(0), features.std(0)
    scale[scale < 1e-9] = 1.0
    x = np.column_stack([np.ones(len(features)), (features - centre) / scale])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[0] = 1e-6
    loss = lambda w: float(weights @ np.logaddexp(0, np.where(labels == 1, -1, 1) * (x @ w)) + ridge @ w**2 / 2)
    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weights * (p - labels)) + ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        then = loss(w - size * step)
        if size <= 1e-6 or now - then < 1e-10 * (1 + abs(now)):
            break
        w, now = w - size * step, then
    return tuple(centre), tuple(scale), tuple(w)


def agreed(labels: DataFrame, label: str = "quality", id_: str = "doc_id") -> DataFrame:
    """doc_id and label (0 or 1) of labelled ids; an id whose labels disagree has none, nulls and other values say nothing."""
    known = labels.select(F.col(id_).alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    return known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("__high")).filter("label = __high").drop("__high")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", id_: str = "doc_id") -> Model:
    """The dictionaries and the curve of labelled documents.

    Fitted on a bounded sample: of each label, DICTIONARY hash classes give SAMPLE_CHARS characters from the middle of one document each, and
    CALIBRATION other classes one document each, scored whole and weighted by how many documents of the label there are. Only ids meet the labels;
    texts are fetched of the chosen ones alone. Documents without a text, an id or an agreed label are left out; of the texts of one id the first in order counts.
    A label without a document, or without one in either part, leaves nothing to compare: scores are the share of label 1, 0.5 without any document.
    """
    spark = docs.sparkSession
    ids = docs.filter(F.col(text).isNotNull()).select(F.col(id_).alias("doc_id"))
    h = F.xxhash64("doc_id")
    part, rest = F.pmod(h, F.lit(2)), F.shiftrightunsigned(h, 1)
    slot = F.when(part == 0, F.pmod(rest, F.lit(DICTIONARY))).otherwise(F.pmod(rest, F.lit(CALIBRATION)))
    known = ids.join(agreed(labels, label, id_), "doc_id").select("label", part.alias("part"), slot.alias("slot"), F.struct(h.alias("h"), "doc_id").alias("p"))
    # at most 2 x (DICTIONARY + CALIBRATION) rows, combined before the shuffle
    found = known.groupBy("label", "part", "slot").agg(F.min("p").alias("p"), F.count("*").alias("n")).collect()
    count = {k: sum(r.n for r in found if r.label == k) for k in (0, 1)}
    share = count[1] / (count[0] + count[1]) if found else 0.5
    if len({(r.label, r.part) for r in found}) < 4:
        return Model(b"", b"", share=share)
    chosen = spark.createDataFrame([(r.p.doc_id, r.p.h, r.label, r.part) for r in found], f"doc_id {docs.schema[id_].dataType.simpleString()}, h long, label int, part int")
    texts = docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    picked = written(texts.groupBy("h", "label", "part").agg(F.min("text").alias("text")), "quality-sample")
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - SAMPLE_CHARS) / 2).cast("int"))
    pieces = picked.filter("part = 0").select("label", F.substring("text", middle, F.lit(SAMPLE_CHARS)).alias("piece")).orderBy("label", "h").collect()
    content = [b"\n".join(r.piece.encode("utf-8", "replace") for r in pieces if r.label == k) for k in (0, 1)]
    scorer = Scorer(Model(*content))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "x": [scorer.features(t) for t in b["text"]]})

    spread = picked.filter("part = 1").select("label", "text").repartition(partitions(spark))
    told = sorted((r.label, r.x) for r in spread.mapInPandas(run, "label int, x array<double>").collect())
    y = np.array([k for k, _ in told])
    weights = np.where(y == 1, count[1] / max(1, (y == 1).sum()), count[0] / max(1, (y == 0).sum()))
    centre, scale, w = calibrated(np.array([x for _, x in told]), y, weights * len(y) / weights.sum())
    return Model(*content, centre, scale, w, share)


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on). Only the text is read, and all of it.

    A null text counts as empty, and an empty one is scored as any other. Equal texts get equal scores, repeated rows stay, an empty table
    gives an empty one. Columns added replace columns of the same names, others pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(model))  # two dictionaries of DICTIONARY x SAMPLE_CHARS characters at most

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value
        for part in parts:
            yield pd.Series(scorer([t or "" for t in part]), dtype="float64")

    return docs.withColumn("score", F.pandas_udf(run, "double")(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out()))
    return scored(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")
