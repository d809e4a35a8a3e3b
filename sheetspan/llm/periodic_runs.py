"""Periodic runs of words in texts, by a branching-tandem test over an enhanced suffix array.

The words of a batch of texts become integers and one suffix array, in which suffixes of different texts never meet.
A boundary of the LCP array at depth d splits the suffixes that share d words into those before and after it.
For each suffix i of the smaller side, the inverse array tells at once whether i + d or i - d stands on the other side:
then d words are repeated at once, and what follows differs.  Such a square is rotated to the left as far as
words agree, which gives a maximal stretch of period d; stretches of one place are merged and keep the smallest period.
No tree is built: sides are ranges of the arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small_batches

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Words of a batch that share a suffix array (one text at least), and candidates looked at together.
WORDS, AT_ONCE = 200_000, 1 << 18


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the place where each one's group begins, and whether the group has several members."""
    first = np.empty(len(keys), bool)
    first[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    begin = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    several = ~first
    several[:-1] |= ~first[1:]
    return begin, several


def _ranks(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... words, until every suffix has one of its own.  Equal ranks mean equal
    words.  Only suffixes that are not settled yet are sorted again."""
    order = np.argsort(words, kind="stable")
    begin, several = _groups(words[order])
    rank = np.empty(len(words), np.int32)
    rank[order] = begin
    levels, active, h = [rank], order[several], 1
    while len(active):
        old = rank[active].astype(np.int64)
        key = old * len(words) + rank[active + h]
        order = np.argsort(key, kind="stable")
        active, old, key = active[order], old[order], key[order]
        begin, several = _groups(key)
        rank = rank.copy()
        rank[active] = old + begin - _groups(old)[0]
        levels.append(rank)
        active, h = active[several], h * 2
    return levels


def _nearest(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """By place, for the places ``at``: the next one in the direction of ``step`` with a smaller value (to the right: or an equal one)."""
    found = np.arange(len(lcp)) + step
    while len(at):
        there = found[at]
        beyond = lcp[there] > lcp[at] if step > 0 else lcp[there] >= lcp[at]
        at, there = at[beyond], there[beyond]
        found[at] = found[there]
    return found


def squares(levels: list[np.ndarray], most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, depth) of all branching squares: ``depth`` words that are repeated at once and not followed by the first of them,
    for depths up to ``most`` of their place's text."""
    isa, n = levels[-1], len(levels[-1])
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    one, two, depth = sa[at - 1], sa[at], np.zeros(len(at), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        same = levels[k][one + depth] == levels[k][two + depth]
        depth[same] += 1 << k
    lcp = np.zeros(n + 1, np.int64)
    lcp[at] = depth
    lcp[[0, n]] = -1
    left, right = _nearest(lcp, at, -1), _nearest(lcp, at, 1)
    at = at[lcp[at] <= most[sa[at]]]
    left, right = left[at], right[at]
    fewer = at - left <= right - at
    begin, size = np.where(fewer, left, at), np.where(fewer, at - left, right - at)
    low, high = np.where(fewer, at, left), np.where(fewer, right, at)
    places, depths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    total = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(total, total[a] + AT_ONCE, "right")) - 1)
        for lo in range(0, int(size[a]) if b == a + 1 else 1, AT_ONCE):  # one very large side is looked at in parts
            own = np.minimum(size[a:b] - lo, AT_ONCE) if b == a + 1 else size[a:b]
            slot = np.repeat(begin[a:b] + lo - (np.cumsum(own) - own), own) + np.arange(own.sum())
            i, d, l, h = sa[slot], np.repeat(lcp[at[a:b]], own), np.repeat(low[a:b], own), np.repeat(high[a:b], own)
            for sign in (1, -1):
                j = i + sign * d
                inside = np.flatnonzero((j >= 0) & (j < n))
                there = isa[j[inside]]
                hit = inside[(there >= l[inside]) & (there < h[inside])]
                places.append(np.minimum(i, j)[hit])
                depths.append(d[hit])
        a = b
    return np.concatenate(places), np.concatenate(depths)


def runs(words: np.ndarray, ends: np.ndarray, times: int, least: int) -> np.ndarray:
    """Rows (start, end, period) of all maximal runs, by start and then period.

    ``words`` are non-negative numbers of the texts' words one text after the other, each with an entry more at its end (at
    ``ends``), whose value does not matter.  A run has ``times`` times its smallest period and ``least`` words at least."""
    lengths = np.diff(ends, prepend=-1) - 1
    text = np.repeat(np.arange(len(ends)), lengths + 1)
    keys = words.astype(np.int64) + text * (int(words.max(initial=0)) + 1)
    keys[ends] = -1 - np.arange(len(ends))
    levels = _ranks(keys)
    place, depth = squares(levels, lengths[text] // times)
    start = place.copy()
    for k in range(len(levels) - 2, -1, -1):
        before = start - (1 << k)
        same = (before >= 0) & (levels[k][np.maximum(before, 0)] == levels[k][np.maximum(before, 0) + depth])
        start[same] = before[same]
    found = np.column_stack([start, place + 2 * depth, depth])
    found = found[np.lexsort((depth, found[:, 1], start))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[first]
    found = found[found[:, 1] - found[:, 0] >= np.maximum(least, times * found[:, 2])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


class _Numbers(dict):
    """Numbers of words, given as they come."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def of_texts(texts: list[list[bytes]], times: int, least: int) -> list[tuple[np.ndarray, list[bytes]]]:
    """For the words of each text: its runs (start, length, period), and the words that collapsing leaves."""
    numbers, ids = _Numbers(), []
    for words in texts:
        ids += map(numbers.__getitem__, words)
        ids.append(0)
    ends = np.cumsum([len(w) + 1 for w in texts]) - 1
    found = runs(np.array(ids, np.int64), ends, times, least)
    cuts = np.searchsorted(found[:, 0], np.concatenate([[-1], ends]), "right")
    out = []
    for k, words in enumerate(texts):
        own = found[cuts[k] : cuts[k + 1]] - np.array([ends[k] - len(words)] * 2 + [0])
        if len(own):
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, own[:, 0] + own[:, 2], 1)
            np.add.at(change, own[:, 1], -1)
            gone = np.cumsum(change[:-1]) > 0
            words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        out.append((np.column_stack([own[:, 0], own[:, 1] - own[:, 0], own[:, 2]]), words))
    return out


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = 4, least: int = 6) -> DataFrame:
    """One row per input row: key, runs (array of start, length, period, in words from 0, by start and then period) and
    collapsed, the words left when of every run only the first period stays, joined by single spaces.

    Words are maximal runs outside ``[\\x20\\x09-\\x0D]``, compared as they are.  A run is a stretch of at least ``least`` words and
    ``times`` times its smallest period that no neighbour extends; runs may overlap.  Null, empty and wordless texts have no
    runs and collapse to the empty text; rows that repeat and null keys are rows like any other; an empty table gives an empty
    one; other columns are left out.  Rows are worked on where they are, nothing is shuffled.  Very long texts are taken whole: a
    task holds some 100 bytes for each word of its longest text, and 4 more for each doubling of its longest repeat.
    """
    small_batches(docs.sparkSession)
    schema = f"k {docs.schema[key].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [raw.split() if raw else [] for raw in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                held, end = len(texts[at]), at + 1
                while end < len(texts) and held + len(texts[end]) <= WORDS:
                    held, end = held + len(texts[end]), end + 1
                found = of_texts(texts[at:end], times, least)
                rows = np.concatenate([r for r, _ in found]) if found else np.empty((0, 3), np.int64)
                offsets = np.cumsum([0, *(len(r) for r, _ in found)]).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(_RUN))
                collapsed = pa.array([b" ".join(w) for _, w in found], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.ListArray.from_arrays(pa.array(offsets), structs), collapsed], names=["k", "runs", "collapsed"])
                at = end

    return docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)
