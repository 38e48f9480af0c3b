"""Token ids in patched frame-of-reference files.

A file holds the ids of consecutive documents. Ids stand in blocks of BLOCK: the block's minimum is
subtracted, values are packed at the bit width of their PERCENTILE, and what does not fit has its high
bits in an exception list. Behind the blocks stand the documents' ids and lengths and the block starts.

    "PFR1" | blocks | doc_id int64[n] | known uint8[n] | length uint32[n] | block start uint64[b]
    | n uint64 | b uint64 | ids uint64 | start of doc_id uint64 | "PFR1"
    block: minimum uint32 | count uint16 | exceptions uint16 | width uint8 | low bits | place uint16[] | high bits uint32[]
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, partitions, table, written
from .files import make_folder, opened, part_name

MAGIC, BLOCK, PERCENTILE, END_ID, KNOWN_PIECES, TOGETHER = b"PFR1", 4096, 90, 2, 400_000, 32

# Latin-1 texts are cut into pieces here; each piece is encoded by the tokenizer once and remembered.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
PLAIN = re.compile(r"[\n\r\t\x20-\x7e\xa1-\xff]*\Z")
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")

# Byte-level vocabularies spell a byte by its Latin-1 character where that is visible, else by the next one from U+0100 on.
VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}
SPELLED = "".join(chr(BYTE_LETTERS.get(b, b)) for b in range(256))


class Known(dict):
    """Ids of pieces as bytes; a piece asked for the first time comes back from the older generation or is encoded by the model."""

    def __init__(self, model, older: dict[str, bytes]):
        super().__init__()
        self.tokens, self.older = model.tokenize, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", [t.id for t in self.tokens(charmap_decode(piece.encode(), "strict", SPELLED)[0])]).tobytes()
        self[piece] = ids
        return ids


class Encoder:
    """ids of texts by a byte-level BPE tokenizer file, equal to tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        told = json.loads(self.tokenizer.to_str())
        # the cuts below are those of byte-level BPE without prefix space and normaliser; any other tokenizer encodes whole texts itself
        self.cuts = told.get("normalizer") is None and told["model"]["type"] == "BPE" and not told["model"].get("dropout")
        self.cuts &= {**(told.get("pre_tokenizer") or {}), "trim_offsets": 0} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": 0, "use_regex": True}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Known(self.model, {})

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        if len(self.known) > KNOWN_PIECES:  # what is still in use comes back from the older generation
            self.known.older = {}
            self.known = Known(self.model, self.known)
        of = self.known.__getitem__  # one look for each place of a piece
        return [
            b"".join(map(of, PIECE.findall(t)))
            if self.cuts and PLAIN.match(t) and not any(s in t for s in self.special)
            else array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
            for t in texts
        ]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    v = (ids - np.uint32(low)).astype("<u4")
    k = (len(v) - 1) * PERCENTILE // 100
    width = int(np.partition(v, k)[k]).bit_length()
    places = np.flatnonzero(v >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    bits = np.unpackbits(v.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return b"".join((
        struct.pack("<IHHB", low, len(v), len(places), width),
        np.packbits(bits.ravel(), bitorder="little").tobytes(),
        places.astype("<u2").tobytes(),
        (v[places] >> np.uint32(width)).astype("<u4").tobytes(),
    ))


def unpack(data: bytes) -> np.ndarray:
    low, n, extra, width = struct.unpack_from("<IHHB", data)
    at = 9 + (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, at - 9, 9), count=n * width, bitorder="little").reshape(n, width)
    v = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel().copy()
    places = np.frombuffer(data, "<u2", extra, at)
    v[places] |= np.frombuffer(data, "<u4", extra, at + 2 * extra) << np.uint32(width)
    return v + np.uint32(low)


class Writer:
    def __init__(self, uri: str):
        store, path = opened(uri)
        self.out, self.at = store.open_output_stream(path, compression=None), 0
        self.ids, self.held, self.starts = [], 0, []
        self.doc_ids, self.known, self.lengths = [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.lengths.append(len(ids) // 4)
        self.ids.append(ids)
        self.held += len(ids) // 4
        if self.held >= 16 * BLOCK:
            self._flush()

    def _flush(self, all_: bool = False) -> None:
        ids = np.frombuffer(b"".join(self.ids), "<u4")
        end = len(ids) if all_ else len(ids) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            self.starts.append(self.at)
            self._put(pack(ids[i : min(i + BLOCK, end)]))
        self.ids, self.held = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> None:
        self._flush(all_=True)
        docs = self.at
        self._put(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.known, np.uint8).tobytes() + np.array(self.lengths, "<u4").tobytes())
        self._put(np.array(self.starts, "<u8").tobytes() + struct.pack("<QQQQ", len(self.doc_ids), len(self.starts), sum(self.lengths), docs) + MAGIC)
        self.out.close()


class Reader:
    """Documents of a file, or any range of its ids by way of the block starts."""

    def __init__(self, uri: str):
        store, path = opened(uri)
        self.file = store.open_input_file(path)
        end = self.file.size() - 36
        n, b, self.n_ids, self.docs_at = struct.unpack_from("<QQQQ", self._at(end, 36))
        if self._at(0, 4) != MAGIC or self._at(end + 32, 4) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        table = self._at(self.docs_at, end - self.docs_at)
        self.doc_ids, self.known = np.frombuffer(table, "<i8", n), np.frombuffer(table, np.uint8, n, 8 * n).astype(bool)
        self.lengths = np.frombuffer(table, "<u4", n, 9 * n).astype(np.int64)
        self.starts = np.append(np.frombuffer(table, "<u8", b, 13 * n), np.uint64(self.docs_at))

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> np.ndarray:
        return unpack(self._at(int(self.starts[i]), int(self.starts[i + 1] - self.starts[i])))

    def ids(self, start: int, count: int) -> np.ndarray:
        """`count` ids from place `start` of the file; reads the blocks that hold them only."""
        if not count:
            return np.empty(0, "<u4")
        first = start // BLOCK
        found = np.concatenate([self.block(i) for i in range(first, (start + count - 1) // BLOCK + 1)])
        return found[start - first * BLOCK :][:count]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place in the file, ids), each block decoded once."""
        held, base, block, at = np.empty(0, "<u4"), 0, 0, 0
        for doc_id, known, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.lengths.tolist()):
            parts, have = [held[at - base :]], base + len(held) - at
            while have < n:
                parts.append(self.block(block))
                block, have = block + 1, have + len(parts[-1])
            held, base = np.concatenate(parts) if len(parts) > 1 else parts[0], at
            yield doc_id if known else None, at, held[:n]
            at += n

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Encodes every text, end_id behind each, into files in ascending doc_id order; returns the manifest.

    Manifest: part, path, n_docs, n_tokens, start (ids in all files before). A null text counts as empty;
    null doc_ids come first; rows with one doc_id stand by the text's hash; an empty table has no file.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    make_folder(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, encode = None, encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            if out is None and len(b):
                part, path = part_name(folder, "pfr")
                out = Writer(path)
            for at in range(0, len(b), TOGETHER):
                some = b.iloc[at : at + TOGETHER]
                for doc_id, ids in zip(some["doc_id"], encode([t or "" for t in some["text"]])):
                    out.add(None if pd.isna(doc_id) else int(doc_id), ids + end)
        if out is not None:
            out.close()
            yield pd.DataFrame({"part": [part], "path": [path], "n_docs": [len(out.lengths)], "n_tokens": [sum(out.lengths)]})

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    kept = kept.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    # pandas turns a bigint column with nulls into floats, so the id goes as text
    kept = kept.withColumn("doc_id", F.col("doc_id").cast("string"))
    parts = written(kept.mapInPandas(run, "part long, path string, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files of a manifest.

    Null doc_ids come back as null, an empty text has the end id only, repeated rows stay, an empty manifest gives no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, start in zip(b["path"], b["start"]):
                f, rows = Reader(path), []
                for doc_id, at, ids in f.documents():
                    rows.append((doc_id, int(start) + at, len(ids), zlib.crc32(ids.tobytes())))
                    if len(rows) == 10_000:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)
                f.close()

    spread = manifest.select("path", "start").repartition(partitions(manifest.sparkSession))
    return spread.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64"})


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), byte_bpe_path()))
