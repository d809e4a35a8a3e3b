"""Merkle manifests of data sets: digests of rows rolled up into one root, and for each row the proof that leads to it.

A row's rank in its group, written in digits of base ``fan``, is its path in the group's tree.  Rows meet in blocks of
``fan ** digits``; within a block the digits are grouped away one after the other, each time nesting the structs of a run of nodes
in the struct of their parent.  What remains is a row per block, whose digests are the rows of the next tree above.
Going down again, one nested transform over a block's struct writes the proofs of all its rows, and one explode
gives them out; a block gets the proof of its own digest by grouping, not by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import stage
from .spans import let

PROOF = "array<struct<at:int,others:array<string>>>"
#: Rows of a table that may be broadcast.
SMALL = 100_000
_PLACE = (1 << 33) - 1


def framed(value: Column) -> Column:
    """``-`` for null, else the bytes of the value's text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def joined(digests: Column) -> Column:
    """The digest over hex digests, one after the other."""
    return F.sha2(F.array_join(digests, ""), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    step = lambda acc, s: joined(F.concat(F.slice(s["others"], F.lit(1), s["at"]), F.array(acc), F.slice(s["others"], s["at"] + 1, F.size(s["others"]) + 1)))
    return F.aggregate(proof, digest, step)


def siblings(proof: Column) -> Column:
    """The digest over all siblings of a proof, from the leaf's up."""
    return joined(F.flatten(F.transform(proof, lambda s: s["others"])))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows of a written table with rank (from 0, within ``group``, by ``order``) and size (rows of the group), written.

    Rows are dealt by ranges of group and order, so a group of any size spreads out; a row's rank is its place in its range
    and the count of its group's rows in earlier ranges.  ``group`` must not be null; columns _at, _part are added in between."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = stage(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(_PLACE)), "ranges")
    found = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    offsets = found.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_before"), F.sum("_n").over(whole).alias("size"))
    offsets = stage(offsets, "offsets")
    if offsets.count() <= SMALL:
        offsets = F.broadcast(offsets)
    return placed.join(offsets, [group, "_part"]).withColumn("rank", F.col("_at") + F.col("_before")).drop("_at", "_part", "_before")


def rolled(rows: DataFrame, fan: int, digits: int) -> DataFrame:
    """Blocks of rows (g, rank, size, digest, payload) as a row each, written: g, block, size, digest, tree."""
    digit = lambda d: F.pmod(F.floor(F.col("rank") / fan**d), F.lit(fan)).cast("int")
    block = F.floor(F.col("rank") / fan**digits).alias("block")
    found = rows.select("g", block, "size", *(digit(d).alias(f"d{d}") for d in range(digits)), F.struct("digest", "payload").alias("node")).repartition("g", "block")
    for d in range(digits):
        kids = F.transform(F.array_sort(F.collect_list(F.struct(f"d{d}", "node"))), lambda x: x["node"])
        found = found.groupBy("g", "block", "size", *(f"d{k}" for k in range(d + 1, digits))).agg(kids.alias("kids"))
        # A level that has one node only is none: the node passes through.
        own = F.when(F.col("size") > fan**d, joined(F.transform("kids", lambda k: k["digest"]))).otherwise(F.col("kids")[0]["digest"])
        found = found.withColumn("node", F.struct(own.alias("digest"), "kids")).drop("kids")
    return stage(found.select("g", "block", "size", F.col("node.digest").alias("digest"), F.col("node.kids").alias("tree")), "blocks")


def proofs(blocks: DataFrame, above: DataFrame, fan: int, digits: int) -> DataFrame:
    """(g, digest, payload, proof, subroot, root) of the rows in blocks, whose own proofs are ``above`` (g, block, proof, subroot, root)."""
    carried = [c for c in above.columns if c not in ("g", "block")]
    both = blocks.select("g", "block", "size", "tree").unionByName(above, allowMissingColumns=True)
    met = both.groupBy("g", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("size", "tree", *carried)))

    def below(kids: Column, d: int, proof: Column) -> Column:
        """The proofs below nodes of level ``d``, whose parent has ``proof``."""

        def of(kid: Column, i: Column) -> Column:
            others = F.transform(F.filter(kids, lambda _, j: j != i), lambda k: k["digest"])
            own = F.when(F.col("size") > fan**d, F.concat(F.array(F.struct(i.alias("at"), others.alias("others"))), proof)).otherwise(proof)
            if d == 0:
                return F.array(F.struct(kid["digest"].alias("digest"), kid["payload"].alias("payload"), own.alias("proof")))
            return let(own, lambda known: below(kid["kids"], d - 1, known))

        return F.flatten(F.transform(kids, of))

    out = met.select("g", *(c for c in carried if c != "proof"), F.explode(below(F.col("tree"), digits - 1, F.col("proof"))).alias("row"))
    return out.select("g", "row.*", *(c for c in carried if c != "proof"))


def _roots(rows: DataFrame, most: int, fan: int, digits: int) -> list[DataFrame]:
    """The blocks of ``rows``, the blocks of those, and so on, until each group is one block; ``most`` rows in a group at most."""
    tables = [rolled(rows, fan, digits)]
    while most > fan**digits:
        most = -(-most // fan**digits)
        up = tables[-1].select("g", F.col("block").alias("rank"), F.ceil(F.col("size") / fan**digits).alias("size"), "digest", F.struct("block").alias("payload"))
        tables.append(rolled(up, fan, digits))
    return tables


def _down(tables: list[DataFrame], top: DataFrame, fan: int, digits: int) -> DataFrame:
    """The proofs of the rows under the first of ``tables``; ``top`` (g, proof, ...) has those of the groups."""
    above = top.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tables[1:]):
        found = proofs(blocks, above, fan, digits)
        above = stage(found.select("payload.block", *(c for c in found.columns if c not in ("digest", "payload"))), "above")
    return proofs(tables[0], above, fan, digits)


def manifest(docs: DataFrame, digest: Column, key: str = "doc_id", group: str = "lang", extra: dict[str, Column] | None = None, fan: int = 8, digits: int = 3) -> DataFrame:
    """One row per input row: key, the ``extra`` columns, leaf (``digest`` of the row), subroot (of its group), root (of all) and proof: from
    the leaf up, the row's place among each run's nodes and the digests of the others.

    The leaves of a group ascend by key, then by digest; null keys come first, as does the group of the null value, the others
    ascend by their text's bytes.  Of each level every ``fan`` consecutive nodes (the last run: fewer, even one) become the
    digest over them, while there is more than one; the one left is the subroot.  Subroots lead to the root in the same
    way.  A lone leaf is its subroot, a lone subroot the root; their proofs are empty.  Rows that repeat are leaves of their own;
    very long and empty texts matter to ``digest`` only; an empty table gives an empty one.

    A task holds a block of ``fan ** digits`` leaves at most.  Groups and keys may hold any share of the rows: ranks come from ranges.
    """
    more = {f"x{i}": c for i, c in enumerate((extra or {}).values())}
    name = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    leaves = stage(docs.select(name.alias("g"), F.col(key).alias("k"), digest.alias("digest"), F.monotonically_increasing_id().alias("uid"), *(c.alias(n) for n, c in more.items())), "leaves")
    rows = stage(ranked(leaves, "g", ["k", "digest", "uid"]).select("g", "rank", "size", "digest", F.struct("k", *more).alias("payload")), "ranked")
    tables = _roots(rows, rows.agg(F.max("size")).first()[0] or 0, fan, digits)
    subroots = stage(tables[-1].select(F.lit("").alias("all"), "g", "digest"), "subroots")
    groups = ranked(subroots, "all", ["g"]).select(F.col("all").alias("g"), "rank", "size", "digest", F.struct("g").alias("payload"))
    upper = _roots(groups, subroots.count(), fan, digits)
    top = upper[-1].select("g", F.array().cast(PROOF).alias("proof"), F.col("digest").alias("root"))
    found = _down(upper, top, fan, digits)
    above = stage(found.select("payload.g", "proof", F.col("digest").alias("subroot"), "root"), "group-proofs")
    out = _down(tables, above, fan, digits)
    return out.select(F.col("payload.k").alias(key), *(F.col(f"payload.{n}").alias(c) for n, c in zip(more, extra or {}, strict=True)), F.col("digest").alias("leaf"), "subroot", "root", "proof")
