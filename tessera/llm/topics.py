"""Topics: spherical k-means over hashed TF-IDF vectors of words, fitted on all texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Most texts that the centroids start from; topics, bins of the hashed vocabulary, rounds of k-means, parts of a unit that vectors are summed in, so that sums don't hang on their order; texts whose vectors stand in one matrix.
SAMPLE, TOPICS, BINS, ROUNDS, UNIT, CHUNK = 2_000, 12, 1024, 25, 1 << 30, 1_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes that end a word, and those that end a token: white space only.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NO_WORD = np.array([not (chr(b).isalpha() or b >= 128) for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
CUT, PIECE = 1 << 20, 1 << 15


def _powers(n: int, base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


_UP, _DOWN = _powers(CUT + 1, _BASE), _powers(CUT + 1, _INVERSE)


def runs(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of False."""
    edge = np.diff(np.concatenate([[1], gaps.view(np.int8), [1]]))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _words(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and bins of the words of at most CUT bytes."""
    starts, ends = runs(NO_WORD[part])
    # a word's hash is the difference of two sums of powers, moved to place 0
    sums = np.concatenate([[np.uint64(0)], np.cumsum(LOWER[part].astype(np.uint64) * _UP[: len(part)])])
    h = (sums[ends] - sums[starts]) * _DOWN[starts]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return starts, (h >> np.uint64(32)).astype(np.int64) % BINS


def features(text: str | None) -> tuple[np.ndarray, int]:
    """How often the text's words fall in each bin, and its number of white-space tokens. Long texts go in pieces of CUT bytes, which end with a token."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    counts, tokens, at = np.zeros(BINS, np.float32), 0, 0
    while at < len(data):
        part = data[at : at + CUT]
        if at + CUT < len(data):
            ends = np.flatnonzero(SPACE[part])
            part = part[: ends[-1] + 1] if len(ends) else part
        tokens += len(runs(SPACE[part])[0]) - bool(at and not SPACE[data[at - 1]] and not SPACE[part[0]])
        counts += np.bincount(_words(part)[1], minlength=BINS)
        at += len(part)
    return counts, tokens


def features_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """`features` of each text: a matrix of counts and the numbers of tokens. Short texts are read together, PIECE bytes at a time with a white space between them."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    counts, tokens, at = np.zeros((len(data), BINS), np.float32), np.zeros(len(data), np.int64), 0
    while at < len(data):
        end, first = at, [0]
        while end < len(data) and first[-1] + len(data[end]) < PIECE:
            first.append(first[-1] + len(data[end]) + 1)
            end += 1
        if end == at:
            counts[at], tokens[at] = features(texts[at])
            at += 1
            continue
        part = np.frombuffer(b"\n".join(data[at:end]), np.uint8)
        of = lambda places: np.searchsorted(first, places, side="right") - 1  # noqa: B023, E731
        tokens[at:end] = np.bincount(of(runs(SPACE[part])[0]), minlength=end - at)
        starts, bins = _words(part)
        counts[at:end] = np.bincount(of(starts) * BINS + bins, minlength=(end - at) * BINS).reshape(-1, BINS)
        at = end
    return counts, tokens


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(-1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Topic of each row of word counts: the centroid of the greatest cosine, the first of equal ones; -1 without a word."""
        best = (_unit(np.log1p(counts) * self.idf) @ self.centroids.T).argmax(1) if len(self.centroids) else np.zeros(len(counts), np.int64)
        return np.where(counts.any(1) & bool(len(self.centroids)), best, -1)


def _packed(row: np.ndarray, values: np.ndarray) -> list[bytes]:
    """The bytes of each row's values; every row has some."""
    return [v.tobytes() for v in np.split(values, np.flatnonzero(np.diff(row)) + 1)] if len(row) else []


def _matrices(part: pd.DataFrame, values: str, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """CHUNK packed texts at a time, so that a task's memory doesn't hang on the size of its batches: a matrix with a row for each, and the row, bin and value of each number in it."""
    for at in range(0, len(part), CHUNK):
        some = part.iloc[at : at + CHUNK]
        row = np.repeat(np.arange(len(some)), some["bins"].map(len) // 2)
        bins, found = np.frombuffer(b"".join(some["bins"]), np.int16), np.frombuffer(b"".join(some[values]), kind)
        x = np.zeros((len(some), BINS), np.float32)
        x[row, bins] = found
        yield x, row, bins, found


def _held(texts: DataFrame) -> DataFrame:
    """(h, bins, n): the bins that each text (h, text) has words in, and how many, packed; texts without a word are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), CHUNK):
                counts = features_of(part["text"].iloc[at : at + CHUNK].to_list())[0]
                some = counts.any(1)
                row, bins = np.nonzero(counts[some])
                yield pd.DataFrame({"h": part["h"].iloc[at : at + CHUNK].to_numpy()[some], "bins": _packed(row, bins.astype(np.int16)), "n": _packed(row, counts[some][row, bins].astype(np.int32))})

    return texts.mapInPandas(run, "h long, bins binary, n binary")


def _texts_of_bins(rows: DataFrame) -> np.ndarray:
    """How many texts have a word in each bin."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(BINS, np.int64)
        for part in parts:
            sums += np.bincount(np.frombuffer(b"".join(part["bins"]), np.int16), minlength=BINS)
        yield pd.DataFrame({"b": np.flatnonzero(sums), "s": sums[sums > 0]})

    held = np.zeros(BINS, np.int64)
    for r in rows.select("bins").mapInPandas(run, "b int, s long").groupBy("b").agg(F.sum("s").alias("s")).collect():
        held[r.b] = r.s
    return held


def _vectors(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """(h, bins, x): the texts' weighted vectors of unit length, packed as their counts are, so that the rounds needn't weigh them again."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for x, row, bins, _ in _matrices(part, "n", np.int32):
                found += _packed(row, _unit(np.log1p(x) * idf)[row, bins])
            yield pd.DataFrame({"h": part["h"], "bins": part["bins"], "x": found})

    return rows.mapInPandas(run, "h long, bins binary, x binary")


def _means(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The mean of the texts of each centroid, of unit length; the centroid itself where it has none. A task sends one row a centroid and bin."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(centroids.size, np.int64)
        for part in parts:
            for x, row, bins, values in _matrices(part, "x", np.float32):
                own = (x @ centroids.T).argmax(1)
                # sums of under 2**53 are exact in bincount, too
                sums += np.bincount(own[row] * BINS + bins, np.rint(values.astype(np.float64) * UNIT), centroids.size).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"at": at, "s": sums[at]})

    new = np.zeros(centroids.size, np.float64)
    for r in vectors.select("bins", "x").mapInPandas(run, "at int, s long").groupBy("at").agg(F.sum("s").alias("s")).collect():
        new[r.at] = r.s
    new = new.reshape(centroids.shape)
    return np.where(new.any(1)[:, None], _unit(new), centroids).astype(np.float32)


def _starts(vectors: DataFrame) -> np.ndarray:
    """The vectors of the SAMPLE texts of least hashes, in their order. Only hashes are sorted, so that tasks don't each send as many vectors."""
    last = vectors.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    found = pd.DataFrame([] if last is None else vectors.filter(F.col("h") <= last).collect(), columns=vectors.columns).sort_values("h")
    return np.concatenate([np.zeros((0, BINS), np.float32), *[x for x, *_ in _matrices(found, "x", np.float32)]])


def fit(docs: DataFrame, text: str = "text", topics: int = TOPICS) -> Model:
    """Weights and centroids of all different texts, told by their hashes, so that neither the order of rows nor their number of copies matters.

    Each text's words are counted and weighed once; a round of k-means is one pass over the vectors, of which only sums by centroid and bin come to the driver. The centroids start from texts far from each other among the SAMPLE texts
    of least hashes. Null texts and texts without a word are left out; fewer texts than topics give fewer topics, no text none.
    """
    texts = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h")).filter("text IS NOT NULL")
    rows = written(_held(texts).dropDuplicates(["h"]), "topic-words")
    idf = np.log((1 + rows.count()) / (1 + _texts_of_bins(rows))).astype(np.float32) + np.float32(0.1)
    vectors = written(_vectors(rows, idf), "topic-vectors")
    discard(rows)
    x = _starts(vectors)
    chosen = [0] if len(x) else []
    near = np.full(len(x), -np.inf, np.float32)
    while 0 < len(chosen) < min(topics, len(x)):  # the text farthest from all chosen ones
        near = np.maximum(near, x @ x[chosen[-1]])
        if near.min() > 1 - 1e-6:
            break
        chosen.append(int(near.argmin()))
    centroids = x[chosen]
    for _ in range(ROUNDS if len(chosen) else 0):
        new = _means(vectors, centroids)
        if np.allclose(new, centroids, atol=1e-6):
            break
        centroids = new
    discard(vectors)
    return Model(idf, centroids)
