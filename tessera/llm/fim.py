"""Fill-in-middle transformation by piece tables.

A document is a list of descriptors (buffer, start, length) over two immutable buffers, its text and the sentinels. Cutting splits
descriptors, an arrangement permutes them, and text or hashes are streamed along them; nothing is moved in the text itself.
The inverse permutation of a document's form restores it from the arranged text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TEXT, MARKS = 0, 1
#: Sentinels of prefix, suffix and middle; percent of documents that are arranged, and of those that put the suffix first; prefix of what is hashed.
SENTINELS, RATE, SPM, SEED = ("<P>", "<S>", "<M>"), 90, 20, "1:"
#: Order of (prefix, middle, suffix, their sentinels P, S, M) in each form.
FORMS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
STREAMED = 1 << 16


class PieceTable:
    """Descriptors (buffer, start, length) over buffers that never change; lengths are code points."""

    def __init__(self, buffers: Sequence[str], pieces: Sequence[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, list(pieces)

    @classmethod
    def of(cls, text: str, marks: str = "") -> PieceTable:
        return cls((text, marks), [(TEXT, 0, len(text))])

    def cut(self, place: int) -> PieceTable:
        """Splits the last descriptor that begins at or before a place of the document; cuts at one place leave an empty piece between them."""
        at, begins = 0, []
        for _, _, n in self.pieces:
            begins.append(at)
            at += n
        k = bisect_right(begins, place) - 1
        buffer, start, n = self.pieces[k]
        here = place - begins[k]
        return PieceTable(self.buffers, [*self.pieces[:k], (buffer, start, here), (buffer, start + here, n - here), *self.pieces[k + 1 :]])

    def with_pieces(self, more: Sequence[tuple[int, int, int]]) -> PieceTable:
        return PieceTable(self.buffers, [*self.pieces, *more])

    def arranged(self, order: Sequence[int]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def stream(self, step: int = STREAMED) -> Iterator[str]:
        for buffer, start, n in self.pieces:
            source = self.buffers[buffer]
            for at in range(start, start + n, step):
                yield source[at : min(at + step, start + n)]

    def text(self) -> str:
        return "".join(self.stream())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part.encode("utf-8", "replace"))
        return digest.hexdigest()


def inverse(order: Sequence[int]) -> tuple[int, ...]:
    return tuple(sorted(range(len(order)), key=order.__getitem__))


def checked(sentinels: Sequence[str]) -> tuple[str, ...]:
    """The three sentinels, if each is found again in any arrangement: they differ, none is empty, none begins inside another or at its end."""
    begins = lambda a, b, k: a[k:].startswith(b) or b.startswith(a[k:])
    if len(set(sentinels)) != 3 or not all(sentinels) or any(begins(a, b, k) for a in sentinels for b in sentinels for k in range(a == b, len(a))):
        raise ValueError("sentinels must be three different strings that don't overlap")
    return tuple(sentinels)


def mark_pieces(sentinels: Sequence[str]) -> list[tuple[int, int, int]]:
    starts = [sum(map(len, sentinels[:i])) for i in range(3)]
    return [(MARKS, at, len(s)) for at, s in zip(starts, sentinels)]


def form_of(text: str, draws: Sequence[int], sentinels: Sequence[str], rate: int, spm: int) -> str:
    if not text or any(s in text for s in sentinels) or draws[2] % 100 >= rate:
        return "plain"
    return "spm" if draws[3] % 100 < spm else "psm"


def arrange(text: str, form: str, draws: Sequence[int], sentinels: Sequence[str]) -> tuple[PieceTable, int | None, int | None]:
    """The table of an arranged document, and the lengths of its prefix and middle (nothing for plain ones)."""
    whole = PieceTable.of(text, "".join(sentinels))
    if form == "plain":
        return whole, None, None
    low, high = sorted(d % (len(text) + 1) for d in draws[:2])
    return whole.cut(low).cut(high).with_pieces(mark_pieces(sentinels)).arranged(FORMS[form]), low, high - low


def restore(output: str, form: str, sentinels: Sequence[str]) -> PieceTable:
    """The table of the text that an output of `form` was arranged from. An output without its sentinels is an error."""
    whole = PieceTable.of(output)
    if form == "plain":
        return whole
    order, at = FORMS[form], 0
    for i, k in enumerate(order[::2]):  # a sentinel stands before each part
        found = output.find(sentinels[k - 3], at)
        if found < 0 or (i == 0 and found):
            raise ValueError(f"no {sentinels[k - 3]} where {form} has it")
        at = found + len(sentinels[k - 3])
        whole = (whole.cut(found) if i else whole).cut(at)
    return whole.arranged(inverse(order)[:3])


def draws_of(doc_id: int | None, seed: str = SEED) -> tuple[int, ...]:
    h = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


ARRANGED = "n long, form string, pieces array<struct<buffer: int, start: long, length: long>>, prefix_chars long, middle_chars long, output string, output_sha256 string"


def transformed(docs: DataFrame, text: str = "text", sentinels: Sequence[str] = SENTINELS, rate: int = RATE, spm: int = SPM, seed: str = SEED) -> DataFrame:
    """docs with n, form (plain, psm or spm), pieces, prefix_chars, middle_chars, output and output_sha256.

    pieces are the descriptors of the output: buffer 0 is the text, 1 the sentinels joined; starts and lengths are code points. A null text
    counts as empty, and an empty one is plain, as is one that holds a sentinel. The draws hang on seed and doc_id alone: rows of one doc_id
    are cut by the same numbers, a null doc_id counts as no digits. Repeated rows stay, columns added replace columns of the same names, others pass; an empty
    table gives an empty one.
    """
    marks = checked(sentinels)

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in parts:
            rows = []
            for doc_id, t in zip(ids, texts):
                t = t or ""
                draws = draws_of(doc_id, seed)
                form = form_of(t, draws, marks, rate, spm)
                made, prefix, middle = arrange(t, form, draws, marks)
                rows.append((len(t), form, [{"buffer": b, "start": s, "length": n} for b, s, n in made.pieces], prefix, middle, made.text(), made.sha256()))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in ("n", "form", "pieces", "prefix_chars", "middle_chars", "output", "output_sha256")])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return _added(docs, F.pandas_udf(run, ARRANGED)(F.col("doc_id").cast("string"), F.col(text)))


def restored(rows: DataFrame, output: str = "output", form: str = "form", sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """rows with restored and restored_sha256: the text rebuilt from an output and its form alone.

    A null output counts as empty, a null form as plain; an output that hasn't its form's sentinels is an error. Columns added replace columns of the same names.
    """
    marks = checked(sentinels)

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in parts:
            tables = [restore(o or "", f or "plain", marks) for o, f in zip(outputs, forms)]
            yield pd.DataFrame([(t.text(), t.sha256()) for t in tables], columns=["restored", "restored_sha256"])

    return _added(rows, F.pandas_udf(run, "restored string, restored_sha256 string")(output, form))


def _added(rows: DataFrame, made: Column) -> DataFrame:
    out = rows.withColumn("__made", made)
    return out.withColumns({c: F.col(f"__made.{c}") for c in out.schema["__made"].dataType.names}).drop("__made")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restored(transformed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(t, 1, lo) AS pre, substr(t, lo + 1, hi - lo) AS mid, substr(t, hi + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
