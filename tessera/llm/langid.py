"""Language identification by compression.

For each language a sample of labelled text becomes a zstandard raw-content dictionary. The letters of a
text are encoded with every dictionary, and the language with the fewest bytes wins; a narrow margin
between the best two is a reason for rejection. All runs of letters of the whole text are encoded, lower-cased and in order:
digits and punctuation compress alike under every dictionary and only blur the margin. One level serves texts of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bounds of the training sample: documents of each language (SALTS x PER_SALT), characters of each document.
SALTS, PER_SALT, SAMPLE_CHARS = 64, 6, 400
#: On held-out texts with another language predicted the margin is mostly below NARROW; above it, 1 in 1,500 is wrong or fewer.
CHUNK, LEVEL, NARROW, UNKNOWN = 4096, 6, 0.002, "und"
LETTER = r"\p{L}"
WORD = re.compile(r"[^\W\d_]+")


def letters_of(text: str) -> bytes:
    return f" {' '.join(WORD.findall(text.lower()))} ".encode("utf-8", "replace")


def chunks_of(data: bytes) -> Iterator[bytes]:
    """Pieces of at most CHUNK bytes that end with a word, or within one that is longer itself."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            end = data.rfind(b" ", at + 1, end) + 1 or end
        yield data[at:end]
        at = end


def fit(train: DataFrame, text: str = "text", lang: str = "lang", id_: str = "doc_id") -> dict[str, bytes]:
    """A dictionary of raw content for each language of the labelled rows, the most frequent language first.

    Fitted on a bounded sample: for each language one document from each of SALTS x PER_SALT hash classes,
    SAMPLE_CHARS characters from the middle of each. There is no bound on languages. Rows with a null
    language or without a letter are left out; repeated samples count once; no rows, no languages.
    """
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(id_).alias("h"))
    rows = rows.filter(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - SAMPLE_CHARS) / 2).cast("int"))
    piece = F.struct("h", F.substring("text", middle, F.lit(SAMPLE_CHARS)).alias("piece"))
    # the smallest hash of each class, combined before the shuffle
    spread = rows.select("lang", F.pmod("h", F.lit(SALTS)).alias("salt"), F.pmod(F.shiftrightunsigned("h", 7), F.lit(PER_SALT)).alias("slot"), piece.alias("p"))
    kept = spread.groupBy("lang", "salt", "slot").agg(F.min("p").alias("p")).select("lang", "p.h", "p.piece").collect()
    pieces: dict[str, dict[str, int]] = {c.lang: {} for c in counts}
    for r in sorted(kept, key=lambda r: (r.lang, r.h)):
        pieces[r.lang].setdefault(r.piece, r.h)
    return {k: b" ".join(letters_of(p) for p in v) for k, v in pieces.items() if v}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.langs = list(content)
        self.coders = []
        for v in content.values():
            d = zstd.ZstdCompressionDict(v, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        """Bytes of the whole text under each language."""
        chunks = list(chunks_of(letters_of(text)))
        return [sum(len(c.compress(x)) for x in chunks) for c in self.coders]

    def __call__(self, text: str) -> tuple[str, float, float]:
        """Language, score, margin: the best two sizes' distance as a share of the second."""
        if len(self.langs) == 1:
            return self.langs[0], 1.0, 1.0
        s = self.sizes(text)
        best = min(range(len(s)), key=s.__getitem__)
        second = min(x for i, x in enumerate(s) if i != best)
        margin = (second - s[best]) / second
        return self.langs[best], margin / (margin + NARROW), margin


_fitted: dict[int, Classifier] = {}


def predict(docs: DataFrame, content: dict[str, bytes], text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1, 0.5 at a margin of NARROW) and rejected.

    Only the text is read. A null or empty text and one without a letter get `und`, score 0 and are rejected, as all
    texts do where nothing was learned; others are rejected where the margin is under NARROW, whatever their length. Equal sizes go to the more
    frequent language, then the first in order. Equal texts get equal results, repeated rows stay, an empty table gives an empty one. The columns
    added replace columns of the same names; other columns pass.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        key = hash(tuple(content.items()))
        if key not in _fitted:
            _fitted.clear()
            _fitted[key] = Classifier(content) if content else None
        model = _fitted[key]
        for part in parts:
            out = []
            for t in part:
                if t is None or model is None or not any(map(str.isalpha, t)):
                    out.append((UNKNOWN, 0.0, True))
                else:
                    lang, score, margin = model(t)
                    out.append((lang, score, margin < NARROW))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    predict_ = F.pandas_udf(run, "lang_pred string, score double, rejected boolean")
    added = docs.withColumn("__lang", predict_(F.col(text)))
    return added.withColumns({c: F.col(f"__lang.{c}") for c in ("lang_pred", "score", "rejected")}).drop("__lang")


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    found = predict(docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), content)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
