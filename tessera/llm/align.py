"""Cross-tokenizer alignment by lockstep merging.

Two tokenizers cut the same bytes. Where a token of A and one of B end together they are linked, and the bytes are cut into groups. A batch
of documents is merged at once: one NumPy state vector holds the A and B pointers of all of them, each step compares the ends they point
at, emits the links and cuts it finds, advances the side that ends first (both where they meet), and drops what is finished. Long documents
take several places of the vector, each for a range of their bytes.

How often an id pair is linked in the corpus is counted by blocks: a block of documents sends each of its different pairs once, and gets each
one's count back once, so that neither tokens nor links are shuffled one by one.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .token_files import BYTE_LETTERS, VISIBLE, Encoder, byte_bpe_path

#: Bytes of a place in the state vector, characters merged at once, bounds of a block: characters and documents.
LANE, TOGETHER, BLOCK_CHARS, BLOCK_DOCS = 1024, 2_000_000, 8_000_000, 20_000


class ByteLevel:
    """Side A: a byte-level BPE file of the tokenizers library; encodes a space and the text. Special tokens' strings are plain text."""

    prefix = " "

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.encoder.tokenizer.encode_special_tokens = True
        self.encoder.special = []
        byte = {**{chr(b): b for b in VISIBLE}, **{chr(c): b for b, c in BYTE_LETTERS.items()}}
        self.bytes = _by_id((i, bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()) for t, i in self.encoder.tokenizer.get_vocab().items())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u4").astype(np.int64) for at in range(0, len(texts), 32) for ids in self.encoder([self.prefix + t for t in texts[at : at + 32]])]


class Pieces:
    """Side B: a sentencepiece model that adds a space itself; U+2581 is a space, <0xHH> a byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = ((i, self.model.id_to_piece(i)) for i in range(self.model.vocab_size()))
        self.bytes = _by_id((i, bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else t.replace("▁", " ").encode()) for i, t in names)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


def _by_id(pairs: Iterator[tuple[int, bytes]]) -> list[bytes]:
    found = dict(pairs)
    out = [found.get(i, b"") for i in range(max(found) + 1)]
    if not all(found.values()):
        raise ValueError("a token without bytes ends where the one before it does")
    return out


class Paths(NamedTuple):
    a: str
    b: str


def public_paths() -> Paths:
    import public_tokenizers

    return Paths(byte_bpe_path(), public_tokenizers.path("piece_bpe_32k.model"))


class Sides:
    """Both tokenizers with what merging needs of them: byte lengths, and the spellings of ids in groups."""

    def __init__(self, paths: Paths):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = ByteLevel(paths.a), Pieces(paths.b)
        self.a_length, self.b_length = (np.array([len(x) for x in s.bytes], np.int64) for s in (self.a, self.b))
        spelled = lambda n, end: [s for i in range(n) for s in (b"%d," % i, b"%d%s" % (i, end))]
        self.spelled = spelled(len(self.a.bytes), b"|") + spelled(len(self.b.bytes), b";")
        self.b_from = 2 * len(self.a.bytes)


@cache
def sides(paths: Paths) -> Sides:
    return Sides(paths)


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For each A token the B token that ends with it, or -1. Ends are ascending; marks are ascending offsets where tokens of both sides may be parted, the first 0, the last the end.

    The state vector has a place for the ends in (mark, next mark].
    """
    linked = np.full(len(a_ends), -1, np.int64)
    a_at, b_at = np.searchsorted(a_ends, marks, "right"), np.searchsorted(b_ends, marks, "right")
    a, a_stop, b, b_stop = a_at[:-1], a_at[1:], b_at[:-1], b_at[1:]
    while True:
        alive = (a < a_stop) & (b < b_stop)
        if not alive.all():
            a, a_stop, b, b_stop = a[alive], a_stop[alive], b[alive], b_stop[alive]
        if not len(a):
            return linked
        ends_a, ends_b = a_ends[a], b_ends[b]
        met = ends_a == ends_b
        linked[a[met]] = b[met]
        a, b = a + (ends_a <= ends_b), b + (ends_b <= ends_a)


class Batch:
    """The merged tokens of some texts; a text that is null, empty or spelled otherwise by one side has no tokens."""

    def __init__(self, texts: list[str | None], own: Sides):
        self.own = own
        given = [t or "" for t in texts]
        a, b = own.a.encode(given), own.b.encode(given)
        for k, t in enumerate(given):
            data = (" " + t).encode("utf-8", "replace") if t else b""
            if not t or any(b"".join(map(s.bytes.__getitem__, ids[k].tolist())) != data for s, ids in ((own.a, a), (own.b, b))):
                a[k] = b[k] = np.empty(0, np.int64)
        self.n_a, self.n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        self.a, self.b = _joined(a), _joined(b)
        self.a_starts, self.b_starts = np.append(0, np.cumsum(self.n_a)), np.append(0, np.cumsum(self.n_b))
        # both sides spell the same bytes, so offsets in the joined texts are offsets in each
        self.a_ends, self.b_ends = np.cumsum(own.a_length[self.a]), np.cumsum(own.b_length[self.b])
        self.edges = np.append(0, self.a_ends)[self.a_starts]
        last = int(self.edges[-1])
        marks = np.unique(np.concatenate([self.edges, *(np.arange(s, e, LANE) for s, e in zip(self.edges[:-1].tolist(), self.edges[1:].tolist()) if e - s > LANE)]))
        linked = lockstep(self.a_ends, self.b_ends, marks) if last else np.empty(0, np.int64)
        self.link_a = np.flatnonzero(linked >= 0)
        self.link_b = linked[self.link_a]
        self.link_starts = np.searchsorted(self.link_a, self.a_starts)

    @property
    def n_links(self) -> np.ndarray:
        return np.diff(self.link_starts)

    def spelled_groups(self) -> list[bytes]:
        """Of each text `a1,a2|b1;a3|b2,b3`, nothing if it has no tokens."""
        own, x, y = self.own, self.link_a, self.link_b
        before_x, before_y = np.append(-1, x[:-1]) if len(x) else x, np.append(-1, y[:-1]) if len(y) else y
        ends_a, ends_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        ends_a[x], ends_b[y] = 1, 1
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + np.repeat(before_y + 1, x - before_x)] = 2 * self.a + ends_a
        out[np.arange(len(self.b)) + np.repeat(x + 1, y - before_y)] = own.b_from + 2 * self.b + ends_b
        at = self.a_starts + self.b_starts
        return [b"".join(map(own.spelled.__getitem__, out[s:e].tolist()))[:-1] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def in_steps(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def alignments(docs: DataFrame, paths: Paths, text: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, links (places a and b of linked tokens) and cuts (byte offsets behind each group, in the space and the text) of each row.

    A text that is null, empty, or not spelled the same by both sides has empty arrays. Repeated rows stay, doc_ids may be null, other columns
    are ignored, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sides(paths)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for s, e in in_steps(texts, TOGETHER):
                m = Batch(texts[s:e], own)
                doc = np.repeat(np.arange(e - s), m.n_links)
                place = pa.StructArray.from_arrays([pa.array(m.link_a - m.a_starts[doc]), pa.array(m.link_b - m.b_starts[doc])], ["a", "b"])
                cuts = m.a_ends[m.link_a] - m.edges[doc]
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), v) for at, v in ((m.a_starts, pa.array(m.a)), (m.b_starts, pa.array(m.b)), (m.link_starts, place), (m.link_starts, pa.array(cuts)))]
                yield pa.RecordBatch.from_arrays([ids.slice(s, e - s), *lists], ["doc_id", "a_ids", "b_ids", "links", "cuts"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return kept.mapInArrow(run, "doc_id long, a_ids array<long>, b_ids array<long>, links array<struct<a: long, b: long>>, cuts array<long>")


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
MERGED = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()),
    ("held", pa.binary()), ("place", pa.int32()), ("pair", pa.int64()), ("n", pa.int64()),
])
MERGED_DDL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, place int, pair long, n long"


class Block:
    """Documents whose links are counted together; gives a row a document and a row a different pair."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.ids, self.counts, self.digests, self.pairs, self.docs = [], [], [], [], []

    def add(self, ids: list[int | None], texts: list[str | None], own: Sides) -> None:
        m = Batch(texts, own)
        self.digests += [hashlib.sha256(g).hexdigest() if g else "" for g in m.spelled_groups()]
        self.pairs.append(m.a[m.link_a] << 32 | m.b[m.link_b])
        self.docs.append(np.repeat(np.arange(len(ids)) + len(self.ids), m.n_links))
        self.counts.append(np.stack([m.n_a, m.n_b, m.n_links, m.n_links]))  # tokens have bytes, so a cut is one link
        self.ids += ids
        self.chars += sum(len(t or "") for t in texts)

    def rows(self) -> Iterator[pa.RecordBatch]:
        pairs, place, n = np.unique(_joined(self.pairs), return_inverse=True, return_counts=True)
        width = max(1, len(pairs))
        held, times = np.unique(_joined(self.docs) * width + place, return_counts=True)
        at = np.searchsorted(held // width, np.arange(len(self.ids) + 1))
        held %= width
        lists = [packed(held[s:e], times[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
        counts = np.concatenate(self.counts, axis=1)
        yield _rows(len(self.ids), block=self.number, doc_id=self.ids, groups_sha256=self.digests, held=lists, **dict(zip(COUNTS, counts)))
        yield _rows(len(pairs), block=self.number, place=np.arange(len(pairs)), pair=pairs, n=n)


def packed(places: np.ndarray, times: np.ndarray) -> bytes:
    """Places in the block's pairs and how often each is linked, byte by byte of all numbers, as the high ones are mostly zero."""
    return np.concatenate([places, times]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _rows(size: int, **columns) -> pa.RecordBatch:
    made = lambda f: pa.nulls(size, f.type) if (v := columns.get(f.name)) is None else pa.array(np.full(size, v) if isinstance(v, int) else v, f.type)
    return pa.RecordBatch.from_arrays([made(f) for f in MERGED], schema=MERGED)


def merged(docs: DataFrame, paths: Paths, text: str = "text") -> DataFrame:
    """Rows of documents (held: their pairs' places in the block and counts) and of each block's different pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = sides(paths), TaskContext.get().partitionId() << 32
        block = Block(first)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, e in in_steps(texts, TOGETHER):
                block.add(ids[s:e], texts[s:e], own)
                if block.chars >= BLOCK_CHARS or len(block.ids) >= BLOCK_DOCS:
                    yield from block.rows()
                    block = Block(block.number + 1)
        if block.ids:
            yield from block.rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, MERGED_DDL)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair (A id times 2^32 plus B id), count (links of the corpus) and best (whether no pair of its B id has more)."""
    counts = written(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")
    highest = counts.groupBy(b).agg(F.max("count").alias("highest"))
    # as many rows as B has ids at most
    return counts.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def linked_counts(docs: DataFrame, paths: Paths, text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    n_best counts links whose pair is linked as often, over all rows, as any pair of its B id; count_sum is the sum of the links' counts. A text that is
    null, empty, or not spelled the same by both sides counts zero, with an empty groups_sha256. Repeated rows stay and count each, doc_ids may be null,
    other columns are ignored, an empty table gives an empty one.
    """
    rows = written(merged(docs, paths, text), "merged-tokens")
    pairs = rows.filter("pair IS NOT NULL").select("block", "place", "pair", "n")
    told = pairs.join(pair_counts(pairs), "pair").select(F.col("block").alias("of_block"), "place", "count", "best")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def summed(own: pa.Table, known: pa.Table) -> pa.Table:
        place = known["place"].to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        count[place], best[place] = known["count"].to_numpy(), known["best"].to_numpy()
        sums = []
        for data in own["held"].to_pylist():
            at, times = unpacked(data)
            sums.append((int(times[best[at]].sum()), int((count[at] * times).sum())))
        n_best, count_sum = zip(*sums) if sums else ((), ())
        return own.drop_columns(["held", "block"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).select(out)

    own = rows.filter("pair IS NULL").select("block", "doc_id", *COUNTS, "groups_sha256", "held")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(summed, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_counts(table(spark, sf_dir, "documents"), public_paths())
