"""Secrets in texts: fixed patterns, and strings that two character Markov models tell from words.

Native column expressions throughout.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import stage
from .sampling import bounded_sample
from .spans import blocks, let, matches, of_kind, overlaps, written

#: The patterns of the base kinds, in order of rank.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
#: What the models judge: a run of key characters with a digit and a letter, of 20 characters or more.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
BASE = ("assign", "access", "hex")
#: Symbols of the models: the start of a string, one for all signs, and each letter or digit; others count as signs.
SYMBOLS = "^-" + string.digits + string.ascii_letters
START, SIGN = 1, 2
#: Share of the random model that is uniform over the alphabet: secrets come in more alphabets than a sample shows.
UNIFORM = 0.5


def _codes(text: Column) -> Column:
    """The symbols of a string as their places in SYMBOLS (from 1), the start first."""
    codes = F.transform(F.split(text, ""), lambda c: F.greatest(F.instr(F.lit(SYMBOLS), c), F.lit(SIGN)))
    return F.concat(F.array(F.lit(START)), codes)


def _cell(first: Column, second: Column) -> Column:
    """The place (from 1) of a pair of symbols in a table of all pairs."""
    return (first - 1) * len(SYMBOLS) + second


def _pairs(text: Column) -> Column:
    """The cells of a string's pairs of symbols, from the start on."""
    return let(_codes(text), lambda codes: F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), _cell))


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    assign = F.filter(
        matches(text, ASSIGN, "assign", 0, "(?i)password|passwd|secret|token|api_?key"), lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 12
    )
    access = F.filter(matches(text, ACCESS, "access", 1, "AKIA"), lambda s: F.char_length(s["match"]) >= 18)
    return assign, access, matches(text, HEX, "hex", 2)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", documents: int = 20_000) -> list[float]:
    """Log-likelihood ratio of each pair of symbols, random strings against ordinary identifiers, by ``_cell``.

    Samples are labelled by the patterns: values of assignments, access keys and hex runs are
    random, runs of at least 4 letters or underscores between blanks are ordinary.  They come from
    about ``documents`` rows, drawn by hash, that seem to have a base match, and as many without,
    which bounds the fit.  A pair that was never seen counts what an unseen pair of its first symbol
    counts; after a symbol that was never seen all pairs count 0.  Null texts and empty tables teach nothing.
    """
    size = len(SYMBOLS)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("string").alias("id"), t.alias("text"))
    likely = F.col("text").rlike(f"(?i:password|passwd|secret|token|api_?key)|AKIA|{HEX}")
    sample = stage(bounded_sample(rows, likely, F.concat_ws(":", "id", F.xxhash64("text")), documents).select("text", likely.alias("likely")), "sample")
    assign, access, hexes = base_spans(F.col("text"))
    secrets = sample.where("likely").select(
        F.explode(
            F.concat(
                F.transform(assign, lambda s: F.regexp_extract(s["match"], ASSIGN, 2)), F.transform(F.concat(access, hexes), lambda s: s["match"])
            )
        ).alias("s"),
        F.lit(1).alias("random"),
    )
    words = sample.where("NOT likely").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"(?<![^\s])[A-Za-z_]{4,}(?![^\s])"), 0)).alias("s"), F.lit(0).alias("random")
    )
    found = (
        secrets.unionByName(words)
        .select("random", F.explode(_pairs(F.col("s"))).alias("cell"))
        .groupBy("cell")
        .agg(F.sum("random").alias("random"), F.sum(1 - F.col("random")).alias("ordinary"))
        .collect()
    )
    counts = [[0, 0] for _ in range(size * size)]
    for r in found:
        counts[r["cell"] - 1] = [r["random"], r["ordinary"]]
    model = []
    for first in range(size):
        row = counts[first * size : (first + 1) * size]
        random, ordinary = (sum(c[k] for c in row) for k in (0, 1))
        chance = lambda n, own: math.log((1 - UNIFORM) * n / max(own, 1) + UNIFORM / size)
        model += [round(chance(n, random) - math.log((m + 1) / (ordinary + size)), 4) if random + ordinary else 0.0 for n, m in row]
    return model


def ratio(text: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio a character of a string that is not empty."""
    table = F.from_json(F.lit(str(model)), "array<double>")
    return F.aggregate(_pairs(text), F.lit(0.0), lambda acc, cell: acc + F.element_at(table, cell)) / F.char_length(text)


def find(docs: DataFrame, model: list[float], key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """One row per input row: key, base (spans of the base kinds), found (those and the ``markov``
    spans), each an array of (start, rank, end, kind, match), by start and then rank.

    A ``markov`` span is a candidate that overlaps no base span and whose mean log-likelihood
    ratio is at least ``least``.  A null text is empty; repeated rows and null keys are rows like
    any other; whole texts are searched however long; an empty table gives an empty one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    assign, access, hexes = base_spans(t)
    rows = docs.select(
        F.col(key).alias(key), assign.alias("_a"), access.alias("_b"), hexes.alias("_c"), matches(t, CANDIDATE, "markov", 3).alias("_m")
    )
    rows = rows.select(key, F.array_sort(F.concat("_a", "_b", "_c")).alias("base"), "_m")
    more = let(blocks(F.col("base")), lambda own: F.filter("_m", lambda s: ~overlaps(s, own) & (ratio(s["match"], model) >= least)))
    return rows.select(key, "base", F.when(F.size("_m") > 0, F.array_sort(F.concat("base", more))).otherwise(F.col("base")).alias("found"))


def digest_rows(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(
        key, *(of_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans")
    )
