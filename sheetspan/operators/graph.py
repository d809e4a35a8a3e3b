"""Connected components over edge tables, and the graph operators built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..workspace import stage

#: Edges of one page that a task holds at most.
MOST = 1_000_000


def _star(edges: pd.DataFrame, whole: bool) -> pd.DataFrame:
    """u, v: every node of some edges with the smallest one that it reaches over them."""
    up: dict = {}

    def root(n):
        while (m := up.setdefault(n, n)) != n:
            up[n] = up[m]
            n = m
        return n

    for u, v in zip(edges["u"].tolist(), edges["v"].tolist(), strict=True):
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    return pd.DataFrame({"u": list(up), "v": [root(n) for n in list(up)], "whole": whole})


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_star`` over batches sorted by page, page after page; one of more than MOST edges comes in parts that are not whole."""
    rest = split = None
    for batch in batches:
        both = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(both):
            continue
        page = both["page"].to_numpy()
        cut = int(np.argmax(page == page[-1]))
        if cut:
            yield _star(both.iloc[:cut], split != page[0])
        rest = both.iloc[cut:].reset_index(drop=True)
        if len(rest) > MOST:
            split, rest = page[-1], None
            yield _star(both.iloc[cut:], False)
    if rest is not None:
        yield _star(rest, split != rest["page"].iloc[0])


def components(edges: DataFrame, left: str = "a", right: str = "b", node: str = "node", component: str = "component", page: str | None = None) -> DataFrame:
    """Component of every node that has an edge: the smallest node reachable from it.

    Rounds of large-star and small-star: every node points its larger neighbours at its smallest
    one, so chains shorten geometrically and a hub never gathers its neighbours in one row (the
    minimum of a neighbourhood is an aggregate with map-side combining).  Each round is written to
    the shared folder, and the loop ends when a round changes no edge.  Edges with a null end and
    loops are ignored; an empty table gives an empty table.

    ``page`` names a column of edges none of which share a node with those of another page.  Each
    page is then joined in its task, and there are rounds for pages of over MOST edges only.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v"), *([F.xxhash64(page).alias("page")] if page else [])).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    if page:
        ends = [f for f in e.schema.fields if f.name != "page"]
        stars = e.repartition("page").sortWithinPartitions("page").mapInPandas(_stars, StructType([*ends, StructField("whole", BooleanType())]))
        stars = stage(stars, "stars")
        if stars.where("NOT whole").isEmpty():
            return stars.select(F.col("u").alias(node), F.col("v").alias(component))
        e = stars.where("u <> v").select("u", "v")
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(low.select("u", F.col("m").alias("v")).union(small).distinct(), "edges")
        n = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == mark:
            break
        mark = n
    roots = e.select(F.col("v").alias(node), F.col("v").alias(component)).distinct()
    return e.select(F.col("u").alias(node), F.col("v").alias(component)).union(roots)


def room_clusters(rooms: DataFrame, door_rooms: DataFrame) -> DataFrame:
    """H2: private rooms joined by doors: rooms (page_id, room_id), door_rooms (via_id, room_id) with
    every room near a door.  A door joins its first room to each other one; result: room_id, cluster."""
    first = door_rooms.groupBy("via_id").agg(F.min("room_id").alias("a"))
    edges = door_rooms.join(first, "via_id").where("room_id > a").select("a", F.col("room_id").alias("b"))
    linked = components(edges, node="room_id", component="cluster")
    return rooms.join(linked, "room_id", "left").select("page_id", "room_id", F.coalesce("cluster", "room_id").alias("cluster"))


def merge_tiles(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """H4: one instance for each component of matching tile regions: the best region's attributes,
    the largest confidence, how many were stitched, and the union box."""
    linked = components(pairs, node="region_id", component="instance", page="page_id")
    own = stage(regions.select("page_id", "region_id", "type", "label", "confidence", "x", "y", "w", "h").join(linked, "region_id", "left"), "regions")
    best = F.struct("confidence", (-F.col("region_id")).alias("r"))
    side = lambda at, size: (F.col(at) + F.col(size) - F.col(at)).alias(size)
    alone = own.where("instance IS NULL").select("page_id", F.col("region_id").alias("instance"), "type", "label", "confidence", F.lit(1).cast("long").alias("stitched_from"), "x", "y", side("x", "w"), side("y", "h"))
    return alone.unionByName(own.where("instance IS NOT NULL").groupBy("page_id", "instance").agg(
        F.max_by("type", best).alias("type"), F.max_by("label", best).alias("label"), F.max("confidence").alias("confidence"), F.count("*").alias("stitched_from"),
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
    ))


def door_reach(edges: DataFrame) -> DataFrame:
    """H6: rooms that doors join, directly or through others, as component ids."""
    return components(edges.where("kind = 'door'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b")), node="room_id", component="reach")


def cross_ventilation(rooms: DataFrame, edges: DataFrame) -> DataFrame:
    """H7: whether a unit has two windowed rooms in one door component; false with fewer than two."""
    edges = stage(edges.select("kind", "from_id", "to_id"), "openings")
    lit = edges.where("kind = 'exterior_window'").select(F.col("from_id").alias("room_id")).distinct()
    own = rooms.where("unit_id IS NOT NULL").join(door_reach(edges), "room_id", "left").withColumn("reach", F.coalesce("reach", "room_id"))
    per = own.join(lit.withColumn("lit", F.lit(1)), "room_id", "left").groupBy("unit_id", "reach").agg(F.count("lit").alias("windowed"))
    return per.groupBy("unit_id").agg((F.max("windowed") >= 2).alias("cross_ventilated"))


def both_ways(edges: DataFrame) -> DataFrame:
    """room_id, other: every edge from either end, in one pass over the edges."""
    end = lambda a, b: F.struct(F.col(a).alias("room_id"), F.col(b).alias("other"))
    return edges.select(F.inline(F.array(end("from_id", "to_id"), end("to_id", "from_id"))))


def room_ego(rooms: DataFrame, walls: DataFrame, openings: DataFrame) -> DataFrame:
    """H8: each room's numbers of wall neighbours, door neighbours and windows."""
    openings = stage(openings.select("kind", "from_id", "to_id"), "openings")
    both = lambda e, name: both_ways(e).groupBy("room_id").agg(F.countDistinct("other").alias(name))
    windows = openings.where("kind = 'exterior_window'").groupBy(F.col("from_id").alias("room_id")).agg(F.count("*").alias("windows"))
    out = rooms.select("page_id", "room_id").join(both(walls, "neighbours"), "room_id", "left")
    out = out.join(both(openings.where("kind = 'door'"), "doors"), "room_id", "left").join(windows, "room_id", "left")
    return out.fillna(0, ["neighbours", "doors", "windows"])


def unit_graph(rooms: DataFrame, edges: DataFrame) -> DataFrame:
    """H9: edges with whether they cross a boundary: two units, or a shared and a private room."""
    side = lambda p: rooms.select(F.col("room_id").alias(f"{p}_id"), F.col("unit_id").alias(f"unit_{p}"), F.col("is_common").alias(f"shared_{p}"))
    both = edges.join(side("from"), "from_id").join(side("to"), "to_id")
    crossing = F.coalesce(F.col("unit_from") != F.col("unit_to"), F.lit(False)) | (F.col("shared_from") != F.col("shared_to"))
    return both.select("page_id", "kind", "from_id", "to_id", crossing.alias("boundary"))


def graph_relationships(edges: DataFrame) -> DataFrame:
    """Graph edges as relationship rows of confidence 0.85."""
    kind = F.when(F.col("kind") == "exterior_window", "room_window_exterior").when(F.col("kind").isin("door", "room_door"), "room_door_access").otherwise("room_adjacency")
    return edges.select("page_id", kind.alias("kind"), "from_id", "to_id", F.lit(0.85).alias("confidence"))
