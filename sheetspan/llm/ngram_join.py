"""Set-similarity join of documents on word n-grams by vertical partitioning.

All n-grams have one global order: by the number of sets that hold them, then by hash.  It is cut
into fragments, and what a fragment tells about an overlap is counted by itself:

* the first fragment, n-grams of one set only, adds nothing to any overlap, so it bounds what a
  document can share at all.  It is counted twice: over a fixed share of the hash range first, which
  already shows most documents to be without partners, then in full over those that are left;
* the rarest of the other n-grams are a document's prefix.  Two sets that link share one of both
  prefixes, at places that leave enough n-grams behind it in either; this finds candidates;
* the other fragments count.  The overlap of a candidate pair is counted in each of them by
  itself, and the partial counts are summed per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..workspace import stage
from .batches import small_batches
from .hashing import batches_of_bytes, mix, shingle_sets

BITS = 25
#: An n-gram of more sets than this belongs to the frequent fragments.
FREQUENT = 16
#: Frequent keys of a join: more rows than this, and more than one in ``SPREAD`` of all rows, so there are ``SPREAD`` of them at most.
CROWD, SPREAD = 1000, 100_000


def set_node(own: np.ndarray) -> int:
    """A fingerprint of a set of hashes as a signed 64-bit integer."""
    return int(mix(mix(own).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own))).view(np.int64)[0])


def _bitmap(column: DataFrame) -> np.ndarray:
    """A fixed 2**BITS bits with those set whose numbers are the low bits of the one long column."""
    x = column.toDF("x").select(F.expr(f"x & {(1 << BITS) - 1}").alias("x"))
    rows = x.groupBy(F.expr("shiftright(x, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def _sets(batches, width: int):
    """(rows, set) of the texts, in parts of bounded size."""
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in batch["text"]]
        for part in batches_of_bytes(texts):
            yield batch.iloc[part], shingle_sets(texts[part], width)


def _row_hash(key: str, text: str):
    """Tells rows of one key apart by their texts: 64 bits over both."""
    return F.xxhash64(F.col(key).cast("string"), F.col(text))


def frequent(rows: DataFrame, key: str) -> DataFrame | None:
    """key, salts: the keys of very many rows of a written table (``SPREAD`` of them at most, so they may be
    broadcast) and in how many parts of about the limit their rows fall; None if there are none."""
    if (size := rows.count()) <= CROWD:
        return None
    limit = max(CROWD, size // SPREAD)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("salts")).where(F.col("salts") > limit)
    found = stage(counts.select(key, F.ceil(F.col("salts") / limit).cast("int").alias("salts")), "frequent")
    return None if found.isEmpty() else found


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Inner or left join of a written table with one that has a row per key, safe against keys of very
    many rows: the rows of ``table`` for those are broadcast, the other keys are shuffled."""
    if (crowds := frequent(rows, key)) is None:
        return rows.join(table, key, how)
    hot = stage(crowds.select(key).join(table.withColumn("_found", F.lit(True)), key, "left"), "hot")
    near = rows.join(F.broadcast(hot), key)
    near = (near.where("_found") if how == "inner" else near).drop("_found")
    return near.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key, how))


def _described(base: DataFrame, width: int, percent: int) -> DataFrame:
    """id, h, node, n of every row, and v, the whole set, of those that may have partners (once a task)."""
    share = min(1.0, 1.75 * (100 - percent) / 100)
    cut = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def write_low(batches):
        seen: set[int] = set()
        for _, sets in _sets(batches, width):
            s, nodes, n = [], [], []
            for own in sets:
                if len(own) and (node := set_node(own)) not in seen:
                    seen.add(node)
                    low = own[: int(np.searchsorted(own, cut))] >> np.uint64(16)
                    s += [low.view(np.int64), np.array([node | -(1 << 63)], np.int64)]
                    nodes.append(np.full(len(low) + 1, node, np.int64))
                    n += [np.zeros(len(low), np.int32), np.array([len(own)], np.int32)]
            if s:
                yield pd.DataFrame({"s": np.concatenate(s), "node": np.concatenate(nodes), "n": np.concatenate(n)})

    # An n-gram is its hash's upper 48 bits here: two that agree look like a shared one, which keeps a
    # document too many at worst.  A row of negative s brings the size of its set.
    low = base.select("text").mapInPandas(write_low, "s long, node long, n int")
    alone = low.groupBy("s").agg(F.min("node").alias("node"), F.max("node").alias("other"), F.max("n").alias("n")).where("s < 0 OR node = other")
    sizes = alone.groupBy("node").agg(F.max("n").alias("n"), F.count_if(F.col("s") >= 0).alias("u"))
    live = stage(sizes.where((F.col("n") - F.col("u")) * 100 >= F.col("n") * percent).select("node"), "live")
    bits = base.sparkSession.sparkContext.broadcast(_bitmap(live))

    def describe(batches):
        seen: set[int] = set()
        for rows, sets in _sets(batches, width):
            nodes, v = [set_node(x) if len(x) else None for x in sets], []
            for node, own in zip(nodes, sets, strict=True):
                at = (node or 0) & ((1 << BITS) - 1)
                first = node is not None and node not in seen and int(bits.value[at >> 6]) >> (at & 63) & 1
                seen |= {node} if first else set()
                v.append(own.view(np.int64) if first else None)
            yield pd.DataFrame({"id": rows["id"], "h": rows["h"], "node": pd.array(nodes, dtype="Int64"), "n": [len(x) for x in sets], "v": v})

    return stage(base.mapInPandas(describe, "id string, h long, node long, n long, v array<long>"), "documents")


def _segments(described: DataFrame, percent: int, parts: int) -> DataFrame:
    """node, n, unique, part, v of the sets that may have partners: their shared n-grams in the global order, cut
    into fragments 0 to 2 * parts - 1 (``parts`` hash ranges, of rare ones and of frequent ones), and as part -1 the prefix."""
    rows = described.where("v IS NOT NULL").select("node", F.explode("v").alias("s"))
    counts = rows.groupBy("s").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).cast("int").alias("c"))
    shared = stage(counts.where("lo < hi").select("s", "c"), "shared")
    limit = max(CROWD, (shared.agg(F.sum("c")).first()[0] or 0) // SPREAD)
    hot = F.broadcast(shared.where(F.col("c") > limit))
    known = rows.join(hot, "s").unionByName(rows.join(hot.select("s"), "s", "left_anti").join(shared.where(F.col("c") <= limit), "s"))
    sizes = described.where("v IS NOT NULL").groupBy("node").agg(F.max("n").alias("n"))
    own = known.groupBy("node").agg(F.collect_list("c").alias("c"), F.collect_list("s").alias("s"))

    def cut(batches):
        bits = np.uint64(64 - parts.bit_length() + 1)
        for batch in batches:
            out = []
            for node, n, c, s in zip(batch["node"], batch["n"], batch["c"], batch["s"], strict=True):
                s, at = np.unique(s, return_index=True)  # a set of several tasks brings each n-gram several times
                c, unique = c[at], n - len(s)
                if len(s) * 100 < n * percent:
                    continue
                prefix = np.lexsort((s, c))[: n + 1 - unique - -(-n * percent // 100)]
                out.append((node, n, unique, -1, s[prefix]))
                part = np.where(c > FREQUENT, parts, 0) + ((s.view(np.uint64) >> bits).astype(np.int64) if parts > 1 else 0)
                out += [(node, n, unique, int(k), s[part == k]) for k in np.unique(part)]
            yield pd.DataFrame(out, columns=["node", "n", "unique", "part", "v"])

    return stage(own.join(sizes, "node").mapInPandas(cut, "node long, n long, unique long, part int, v array<long>"), "segments")


def _prefixes(segments: DataFrame, percent: int) -> DataFrame:
    """s, node, n, j, hi: the prefix of each set.  A pair whose first common n-gram is s shares n - j of them
    at most, so a partner has hi n-grams at most."""
    rows = segments.where("part = -1").select("node", "n", "unique", F.posexplode("v").alias("at", "s"))
    rows = rows.select("s", "node", "n", (F.col("unique") + F.col("at")).alias("j"))
    return rows.withColumn("hi", F.floor((F.col("n") - F.col("j")) * (100 + percent) / percent) - F.col("n"))


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of a written table of pairs (a, b, na, nb, la, lb), nodes with their sizes and labels, the labels (la, lb) of
    those that link: overlaps are counted fragment by fragment and summed."""
    rows, sides = pairs, {}
    for side, other in ("ab", "ba"):
        own = segments.where("part >= 0").select(F.col("node").alias(side), "part", F.col("v").alias(f"v{side}"))
        crowds = frequent(pairs, side)
        if crowds is None:
            sides[side] = own.withColumn(f"salt_{side}", F.lit(0))
            rows = rows.withColumn(f"salt_{side}", F.lit(0))
            continue
        # A node with very many pairs: its pairs are dealt to salts, its set is there once for each.
        sides[side] = own.join(F.broadcast(crowds), side, "left").withColumn(f"salt_{side}", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        salt = F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1))).cast("int")
        rows = rows.join(F.broadcast(crowds), side, "left").withColumn(f"salt_{side}", salt).drop("salts")
    both = rows.join(sides["a"], ["a", "salt_a"]).join(sides["b"], ["b", "salt_b", "part"])
    one = both.select(*pairs.columns, F.size(F.array_intersect("va", "vb")).alias("common"))
    whole = one.groupBy(*pairs.columns).agg(F.sum("common").alias("common"))
    return whole.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("la", "lb").distinct()


def _merged(labels: DataFrame, linked: DataFrame) -> DataFrame:
    """Labels (node, label) after the links (la, lb) between labels."""
    edges = stage(linked, "links")
    if edges.isEmpty():
        return labels
    new = stage(components(edges, "la", "lb", node="label", component="new"), "components")
    return stage(spread_join(labels, new, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def _by_leaders(labelled: DataFrame, turn: int, percent: int) -> DataFrame:
    """a, b, na, nb, la, lb: for each node one pair at most, with the leader of one of its buckets.  A bucket's leader is
    the node with the fewest rarer n-grams before, in later turns a random one."""
    order = F.floor(F.col("j") * 1000 / F.col("n")) if turn == 0 else F.lit(0).cast("long")
    lead = F.struct(order.alias("o"), F.xxhash64("node", F.lit(turn)).alias("r"), "node", "n", "hi", "label")
    best = labelled.groupBy("s").agg(F.min(lead).alias("lead"), F.min("label").alias("lo"), F.max("label").alias("up")).where("lo < up")
    met = spread_join(labelled, stage(best.select("s", "lead"), "leaders"), "s").where(
        (F.col("label") != F.col("lead.label")) & (F.col("lead.n") <= F.col("hi")) & (F.col("n") <= F.col("lead.hi"))
        & (F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent)
    )
    one = met.groupBy(F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la")).agg(F.min("lead").alias("lead"))
    return stage(one.select("a", F.col("lead.node").alias("b"), "na", F.col("lead.n").alias("nb"), "la", F.col("lead.label").alias("lb")), "pairs")


def _across(labelled: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb, la, lb: every pair of two labels that shares a bucket and whose places and sizes allow a link.

    The smaller set of such a pair has room for one of its own size, so it waits in the cell of its
    bucket and size; the larger one asks the cells of the sizes that it has room for.  Labels meet
    before nodes do, so nodes of one label never meet.
    """
    cell = lambda n: F.floor(F.log(n) / math.log(1.03)).cast("int")
    waiting = labelled.where("hi >= n").select("s", cell(F.col("n")).alias("cell"), F.col("label").alias("label2"), F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("hi").alias("hi2"))
    kinds = waiting.groupBy("s", "cell", "label2").agg(F.min("n2").alias("least"), F.max("hi2").alias("room"))
    key = F.struct("s", "cell").alias("key")
    rivals = stage(kinds.groupBy("s", "cell").agg(F.min("label2").alias("lo"), F.max("label2").alias("up")).select(key, "lo", "up"), "rivals")
    low, high = F.ceil(F.col("n") * percent / 100), F.least("n", "hi")
    asking = labelled.where(low <= high).withColumn("cell", F.explode(F.sequence(cell(low), cell(high))))
    asking = spread_join(stage(asking.select(key, "label", "node", "n", "hi"), "asking"), rivals, "key").where("label <> lo OR label <> up").select("key.*", "label", "node", "n", "hi")
    fits = (F.col("label") != F.col("label2")) & (F.col("least") <= F.least("n", "hi")) & (F.col("n") <= F.col("room"))
    met = asking.join(kinds, ["s", "cell"]).where(fits).drop("least", "room").join(waiting, ["s", "cell", "label2"])
    met = met.where((F.col("n2") <= F.least("n", "hi")) & (F.col("n") <= F.col("hi2")) & (F.col("n2") * 100 >= F.col("n") * percent))
    one, two = F.struct("node", "n", "label"), F.struct(F.col("node2").alias("node"), F.col("n2").alias("n"), F.col("label2").alias("label"))
    pair = met.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
    return stage(pair.select(*(F.col(f"{side}.{c}").alias(to) for side, names in (("x", "a na la"), ("y", "b nb lb")) for c, to in zip(("node", "n", "label"), names.split(), strict=True))), "pairs")


def _placed(docs: DataFrame, key: str, text: str, width: int, percent: int, parts: int = 4, rounds: int = 2) -> DataFrame:
    """One row per input row, written: id, h (``_row_hash``), n (shingles) and label, which is the same for the
    rows of a component and null without words."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(key).cast("string").alias("id"), _row_hash(key, text).alias("h"), F.col(text).alias("text"))
    described = _described(base, width, percent)
    segments = _segments(described, percent, parts)
    prefixes = stage(_prefixes(segments, percent), "prefixes")
    labels = stage(segments.where("part = -1").select("node", F.col("node").alias("label")), "labels")
    for turn in range(rounds + 1):
        labelled = stage(prefixes.join(labels, "node"), "labelled")
        pairs = _by_leaders(labelled, turn, percent) if turn < rounds else _across(labelled, percent)
        if not pairs.isEmpty():
            labels = _merged(labels, _links(pairs, segments, percent))
    rows = spread_join(described.select(F.col("id").cast(docs.schema[key].dataType).alias("id"), "h", "node", "n"), labels, "node", "left")
    return stage(rows.select("id", "h", "n", F.coalesce("label", "node").alias("label")), "placed")


def similar_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, parts: int = 4, rounds: int = 2
) -> DataFrame:
    """One row per input row: key, n_shingles, component_id.

    A document's set holds its distinct shingles of ``width`` words (maximal runs outside
    ``[\\x20\\x09-\\x0D]``, A-Z lower-cased); with fewer words the whole sequence is its one shingle;
    null and wordless texts have the empty set and link with nothing.  Two documents link when
    100 * intersection >= percent * union.  ``component_id`` is the smallest key reachable by links.
    Rows that repeat a key are documents of their own; null keys take part and get the smallest
    key of their component (null if it has none).  Keys are integers or strings.  Very long texts
    are hashed in parts and compared whole; an empty table gives an empty one.  ``parts`` is a power of two.

    Documents of equal sets are one node from the start, so copies never meet in pairs.  In each of
    ``rounds`` turns a node is compared with one leader of its buckets, and what is linked by then needs no
    pairs among itself; the last turn compares all pairs of different components that the bounds
    leave.  So every link between components is found, yet a large group of near copies costs a
    multiple of its size.  A bitmap of fixed size lets the second scan keep the sets that may have
    partners; it only saves work.  Hashes have 64 bits: sets, or shingles of a pair, that differ but agree in
    theirs count as equal.
    """
    placed = _placed(docs, key, text, width, percent, parts, rounds)
    groups = stage(placed.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1"), "groups")
    return spread_join(placed, groups, "label", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("size").isNotNull(), F.col("least")).otherwise(F.col("id")).alias("component_id")
    )


def drop_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The input with one row of each component: that of the smallest key, null keys last, and of rows
    that repeat the key the one with the smallest hash of its text.  Rows without words are
    components of their own and stay.  Of rows that repeat both key and text the one whose
    columns, written as JSON, are smallest stays."""
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("h"), F.col("copies"))
    placed = _placed(docs, key, text, width, percent).where("label IS NOT NULL").select("id", "h", "label")
    rows = placed.groupBy("label", "id", "h").agg(F.count(F.lit(1)).alias("copies"))
    groups = stage(rows.groupBy("label").agg(F.min(rank).alias("best"), F.sum("copies").alias("size")).where("size > 1"), "groups")
    lost = ~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h")))
    marked = stage(
        spread_join(placed, groups, "label").where(lost | (F.col("best.copies") > 1)).select(F.col("id").alias("_id"), F.col("h").alias("_h"), lost.alias("_lost")).distinct(), "dropped"
    )
    same = lambda of: docs[key].eqNullSafe(of["_id"]) & (_row_hash(key, text) == of["_h"])
    kept = docs.join(marked, same(marked), "left_anti")
    copied = marked.where("NOT _lost")
    if copied.isEmpty():
        return kept
    row = F.struct(*(docs[c] for c in docs.columns))
    once = docs.join(copied, same(copied)).groupBy("_id", "_h").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.unionByName(once)
