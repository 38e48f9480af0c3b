"""Benchmark decontamination: which documents contain which test items.

A document contains an item if at least THRESHOLD of the item's distinct N-word shingles are in it. Items
are partitioned by size: by words a shingle, as one shorter than N words is one shingle of all its words, and by powers of two of their
number of shingles. Each partition has an index of its own and its own bounds: of n shingles a document must hold all but
m = floor((1 - THRESHOLD) n), so the m + 1 shingles of smallest hash, a MinHash sketch as long as the size asks for, cannot all be missing, and a
document with fewer shingles than the partition's smallest item needs is not searched. Hits are verified by exact containment of the
shingles' words. No pair is lost.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

N, THRESHOLD = 5, 0.8
#: Most words of items that are sent to the executors at once; more items are searched in more passes over the documents.
BLOCK_WORDS = 2_000_000
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters; A-Z in lower case."""
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


def shingles(words: list[bytes], n: int) -> list[bytes]:
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def sketch_size(shingle_count: int, threshold: float) -> int:
    """Shingles of which one at least is in any text that contains the item."""
    need = -int(-threshold * shingle_count // 1)  # the fewest that reach the threshold
    return shingle_count - max(1, need) + 1


class Index:
    """The items of one block: sketch hashes by shingle length, and their shingles for the exact check."""

    def __init__(self, items: list[tuple[int, bytes]], n: int, threshold: float):
        self.threshold = threshold
        self.sketch: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.least: dict[tuple[int, int], int] = {}
        self.items: dict[int, tuple[int, set[bytes]]] = {}
        for key, (_, joined) in enumerate(items):
            words = joined.split(b" ")
            size = min(n, len(words))
            own = set(shingles(words, size))
            self.items[key] = size, own
            hashes = sorted(xxhash.xxh64_intdigest(s) for s in own)
            part, m = (size, len(own).bit_length()), sketch_size(len(hashes), threshold)
            self.least[part] = min(self.least.get(part, len(own)), len(own) - m + 1)
            for h in hashes[:m]:
                self.sketch[part][h].append(key)
        self.ids = [i for i, _ in items]

    def search(self, text: str | None) -> Iterator[tuple[int, float]]:
        words = words_of(text)
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-1]]
        digest, hits = xxhash.xxh64_intdigest, set()
        hashes: dict[int, set[int]] = {}
        for (size, bits), sketch in self.sketch.items():
            if len(words) - size + 1 >= self.least[size, bits]:
                if size not in hashes:
                    hashes[size] = {digest(joined[a : b - 1]) for a, b in zip(starts, ends[size - 1 :])}
                if len(hashes[size]) >= self.least[size, bits]:
                    hits.update(k for h in sketch.keys() & hashes[size] for k in sketch[h])
        if hits:
            of_size = {n: set(shingles(words, n)) for n in {self.items[k][0] for k in hits}}
            for k in sorted(hits):
                size, own = self.items[k]
                share = len(own & of_size[size]) / len(own)
                if share >= self.threshold:
                    yield self.ids[k], share


_built: dict[str, Index] = {}


def _index(key: str, items: list[tuple[int, bytes]], n: int, threshold: float) -> Index:
    """The block's index, built once a Python process."""
    if key not in _built:
        _built.clear()
        _built[key] = Index(items, n, threshold)
    return _built[key]


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", n: int = N, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, doc_id, containment: a row for each row of docs and item row it contains at `threshold` or more.

    Items without a word are in no document, null and wordless documents contain nothing; repeated rows give repeated
    rows; ids may be null; an empty table on either side gives no row. Other columns are ignored. The items go to the executors in blocks of
    about block_words words; each block is one pass over the documents.
    """
    kept = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("text"))

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [words_of(t) for t in b["text"]]
            yield pd.DataFrame({"item_id": b["item_id"], "words": [b" ".join(w) for w in words], "n": [len(w) for w in words]})

    normed = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).mapInPandas(normal, "item_id string, words binary, n long").filter("n > 0")
    total = normed.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block_words)
    out = None
    for block in range(blocks):
        rows = normed.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block).collect()
        index_of = kept.sparkSession.sparkContext.broadcast([(r.item_id, bytes(r.words)) for r in rows])

        key = uuid.uuid4().hex

        def search(batches: Iterator[pd.DataFrame], index_of=index_of, key=key) -> Iterator[pd.DataFrame]:
            index = _index(key, index_of.value, n, threshold)
            for b in batches:
                found = [(i, d, c) for d, t in zip(b["doc_id"], b["text"]) for i, c in index.search(t)]
                yield pd.DataFrame(found, columns=["item_id", "doc_id", "containment"])

        part = kept.mapInPandas(search, "item_id string, doc_id string, containment double")
        out = part if out is None else out.union(part)
    if out is None:
        out = kept.sparkSession.createDataFrame([], "item_id string, doc_id string, containment double")
    return out.select(F.col("item_id").cast("long").alias("item_id"), F.col("doc_id").cast("long").alias("doc_id"), "containment")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "string_split(trim(regexp_replace(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ')"
ORACLE_SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM benchmark),
i AS (SELECT item_id, w, least(5, len(w)) AS size FROM iw WHERE w <> ['']),
ish AS (SELECT DISTINCT item_id, size, array_to_string(w[k : k + size - 1], ' ') AS s FROM (SELECT item_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM i)),
cnt AS (SELECT item_id, count(*) AS n FROM ish GROUP BY item_id),
dw AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS.format(t="text")} AS w FROM documents WHERE text IS NOT NULL),
dsh AS (SELECT DISTINCT row_id, doc_id, size, array_to_string(w[k : k + size - 1], ' ') AS s
        FROM (SELECT row_id, doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM dw, (SELECT DISTINCT size FROM i)))
SELECT ish.item_id, doc_id, count(*)::DOUBLE / any_value(n) AS containment
FROM ish JOIN dsh USING (size, s) JOIN cnt ON cnt.item_id = ish.item_id
GROUP BY ish.item_id, row_id, doc_id HAVING count(*)::DOUBLE / any_value(n) >= 0.8
"""
