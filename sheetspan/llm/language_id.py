"""Language identification by compression with a dictionary for each language."""

from __future__ import annotations

import math
import re

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from ..workspace import stage
from .batches import filtered, with_columns
from .sampling import bounded_sample

_NO_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """What is compressed: the letters in lower case, with one space for anything else between."""
    return _NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def dictionaries(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", documents: int = 1200, pieces: int = 300, chars: int = 400
) -> dict[str, bytes]:
    """Raw dictionary content for each language: about ``pieces`` pieces of ``chars`` characters, drawn by
    hash from all pieces of about ``documents`` labelled texts of the language, themselves drawn by
    hash.  So any place of a text may teach, and about pieces * chars characters a language are
    gathered whatever the size of the input; no language meets in one task.  Rows without text or
    language teach nothing; rows that repeat key and text teach alike; an empty table gives no languages.
    """
    known = labelled.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    picked = stage(bounded_sample(known, F.col("lang"), F.col("id"), documents), "labelled")
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chars).cast("int")))
    cut = picked.withColumn("at", at).select("lang", "id", "at", F.expr(f"substring(text, at * {chars} + 1, {chars})").alias("piece"))
    rows = bounded_sample(cut, F.col("lang"), F.concat_ws(":", "id", "at"), pieces).orderBy("lang", F.xxhash64("id", "at"), "piece").collect()
    found: dict[str, list[str]] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append(r["piece"])
    return {k: b" ".join(map(plain, v)) for k, v in sorted(found.items())}


class Compressors:
    """Sizes of texts under each dictionary.  Long texts are cut into pieces, as a dictionary says
    little once a piece has outgrown it; all pieces count."""

    def __init__(self, content: dict[str, bytes], level: int = 5, piece: int = 3000):
        self.names, self.piece = list(content), piece
        self.by = []
        for raw in content.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = plain(text)
        parts = [raw[i : i + self.piece] for i in range(0, len(raw), self.piece)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.by]


def _judge(content: dict[str, bytes], margin: float, sharpness: float):
    """``Compute`` of names, scores and rejections."""

    def compute():
        judge = Compressors(content)

        def of(texts):
            names, scores, rejected = [], [], []
            for t in texts:
                if t is None or not judge.names or not any(c.isalpha() for c in t):
                    names.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                sizes = judge.sizes(t)
                k = int(np.argmin(sizes))
                excess = [(s - sizes[k]) / sizes[k] for s in sizes]
                names.append(judge.names[k])
                scores.append(1.0 / math.fsum(math.exp(-sharpness * e) for e in excess))
                rejected.append(len(sizes) > 1 and sorted(excess)[1] < margin)
            return [names, scores, rejected]

        return of

    return compute


def identify(
    docs: DataFrame, content: dict[str, bytes], text: str = "text", margin: float = 0.005, sharpness: float = 60.0
) -> DataFrame:
    """The input with lang_pred, score and rejected.

    The language whose dictionary makes the whole text smallest; ties go to the first name.
    ``score`` is that language's share when each language weighs exp(-sharpness * excess / smallest size).
    ``rejected`` is true where the second smallest size is within ``margin`` of the smallest, as a
    part of it, and where there is nothing to judge: a text that is null or has no letter gets
    ``und`` and score 0.  With a single language every text with letters gets it, at score 1.
    Columns of the input with these names are replaced, all others stay as they are.  Rows that
    repeat are judged each by itself, very long texts in pieces that all count; an empty table gives an empty one.
    """

    return with_columns(
        docs, [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())], text, _judge(content, margin, sharpness)
    )


def known(docs: DataFrame, content: dict[str, bytes], text: str = "text", margin: float = 0.005) -> DataFrame:
    """The rows that ``identify`` does not reject, all columns as they are."""
    judge = _judge(content, margin, 1.0)

    def compute():
        of = judge()
        return lambda texts, _: [[not rejected for rejected in of(texts)[2]]]

    return filtered(docs, text, F.lit(None), compute)
