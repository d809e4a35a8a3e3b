"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, spatial
from ..workspace import stage
from .fixtures import kept_entities
from .q_spatial import OPENINGS, ROOMS, SEAM_PAIRS, TILE_PAIRS, WALLS, room_graph, seam_regions, tiles
from .registry import query

C = F.col


def _closure(nodes: str, edges: str) -> str:
    """SQL: the smallest node that each node reaches, by a recursive walk."""
    return f"""both_ways AS (SELECT a, b FROM {edges} UNION ALL SELECT b, a FROM {edges}), walk AS (SELECT n AS root, n AS node FROM {nodes} UNION SELECT w.root, e.b FROM walk w JOIN both_ways e ON e.a = w.node),
low AS (SELECT node, min(root) AS component FROM walk GROUP BY 1)"""


@query(f"WITH RECURSIVE_MARK {ROOMS}, {WALLS}, ed AS (SELECT from_id AS a, to_id AS b FROM walls), nd AS (SELECT a AS n FROM ed UNION SELECT b FROM ed), {_closure('nd', 'ed')} SELECT node, component FROM low".replace("RECURSIVE_MARK ", ""))
def h1_components_of_walls(spark, sf_dir):
    _, walls, _ = room_graph(spark, sf_dir)
    return graph.components(walls, "from_id", "to_id")


@query(f"""WITH {ROOMS}, {OPENINGS}, dr AS (SELECT p.via_id, p.room_id FROM o_pairs p JOIN d_entities d ON d.entity_id = p.via_id WHERE p.d <= 24 AND d.label = 'Single Door' AND NOT p.is_common),
ed AS (SELECT x.room_id AS a, y.room_id AS b FROM dr x JOIN dr y ON x.via_id = y.via_id AND x.room_id < y.room_id), nd AS (SELECT room_id AS n FROM g_rooms WHERE NOT is_common), {_closure("nd", "ed")} SELECT r.page_id, r.room_id, low.component AS cluster FROM g_rooms r JOIN low ON low.node = r.room_id""")
def h2_room_clusters(spark, sf_dir):
    from ..functions import geometry as g
    from .q_spatial import rects

    df = kept_entities(spark, sf_dir)
    rooms, _, _ = room_graph(spark, sf_dir, df)
    private = rooms.where("NOT is_common")
    doors = rects(spatial.of_type(df, "door").where("label = 'Single Door'")).withColumn("m", g.vertex_mean(C("points")))
    o = doors.select("page_id", C("entity_id").alias("via_id"), "m", g.expand(g.box(C("m.x"), C("m.y"), F.lit(0), F.lit(0)), 24).alias("obox"))
    r = private.select("page_id", "room_id", C("points").alias("ring"), g.bbox_of(C("points")).alias("rbox"))
    near = stage(spatial.box_pairs(o, r, "obox", "rbox").where(g.dist_to_ring(C("m.x"), C("m.y"), C("ring")) <= 24).select("via_id", "room_id"), "near")
    return graph.room_clusters(private.select("page_id", "room_id"), near)


@query(f"""WITH {TILE_PAIRS}, nd AS (SELECT region_id AS n FROM d_tile_regions), {_closure("nd", "t_pairs")}, j AS (SELECT r.*, low.component AS instance, row_number() OVER (PARTITION BY low.component ORDER BY r.confidence DESC, r.region_id) AS k FROM d_tile_regions r JOIN low ON low.node = r.region_id)
SELECT page_id, instance, max(type) FILTER (k = 1) AS type, max(label) FILTER (k = 1) AS label, max(confidence) AS confidence, count(*) AS stitched_from, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM j GROUP BY 1, 2""")
def h4_merged_tiles(spark, sf_dir):
    df = tiles(spark, sf_dir, keep=True)
    return graph.merge_tiles(df, spatial.tile_matches(df))


@query(f"""WITH {SEAM_PAIRS}, nd AS (SELECT region_id AS n FROM d_seam_regions), {_closure("nd", "s_pairs")}, j AS (SELECT r.*, low.component AS instance, row_number() OVER (PARTITION BY low.component ORDER BY r.confidence DESC, r.region_id) AS k FROM d_seam_regions r JOIN low ON low.node = r.region_id)
SELECT page_id, instance, max(type) FILTER (k = 1) AS type, max(label) FILTER (k = 1) AS label, max(confidence) AS confidence, count(*) AS stitched_from, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM j GROUP BY 1, 2""")
def h4_seam_merged_tiles(spark, sf_dir):
    df = seam_regions(spark, sf_dir, keep=True)
    return graph.merge_tiles(df, spatial.tile_matches(df))


DOORS = "ed AS (SELECT from_id AS a, to_id AS b FROM o_edges WHERE kind = 'door')"


@query(f"WITH {ROOMS}, {OPENINGS}, {DOORS}, nd AS (SELECT a AS n FROM ed UNION SELECT b FROM ed), {_closure('nd', 'ed')} SELECT node AS room_id, component AS reach FROM low")
def h6_door_reach(spark, sf_dir):
    return graph.door_reach(room_graph(spark, sf_dir)[2])


@query(f"""WITH {ROOMS}, {OPENINGS}, {DOORS}, nd AS (SELECT room_id AS n FROM g_rooms), {_closure("nd", "ed")}, lit AS (SELECT DISTINCT from_id FROM o_edges WHERE kind = 'exterior_window'),
per AS (SELECT r.unit_id, low.component, count(lit.from_id) AS n FROM g_rooms r JOIN low ON low.node = r.room_id LEFT JOIN lit ON lit.from_id = r.room_id WHERE r.unit_id IS NOT NULL GROUP BY 1, 2) SELECT CAST(unit_id AS VARCHAR) AS unit_id, max(n) >= 2 AS cross_ventilated FROM per GROUP BY 1""")
def h7_cross_ventilation(spark, sf_dir):
    rooms, _, openings = room_graph(spark, sf_dir)
    return graph.cross_ventilation(rooms, openings)


@query(f"""WITH {ROOMS}, {WALLS}, {OPENINGS}, wn AS (SELECT from_id AS a, to_id AS b FROM walls UNION SELECT to_id, from_id FROM walls), dn AS (SELECT from_id AS a, to_id AS b FROM o_edges WHERE kind = 'door' UNION SELECT to_id, from_id FROM o_edges WHERE kind = 'door')
SELECT r.page_id, r.room_id, (SELECT count(*) FROM wn WHERE a = r.room_id) AS neighbours, (SELECT count(*) FROM dn WHERE a = r.room_id) AS doors, (SELECT count(*) FROM o_edges WHERE kind = 'exterior_window' AND from_id = r.room_id) AS windows FROM g_rooms r""")
def h8_room_ego(spark, sf_dir):
    return graph.room_ego(*room_graph(spark, sf_dir))


@query(f"""WITH {ROOMS}, {WALLS} SELECT w.page_id, w.kind, w.from_id, w.to_id, coalesce(a.unit_id <> b.unit_id, false) OR a.is_common <> b.is_common AS boundary FROM walls w JOIN g_rooms a ON a.room_id = w.from_id JOIN g_rooms b ON b.room_id = w.to_id""")
def h9_unit_graph(spark, sf_dir):
    rooms, walls, _ = room_graph(spark, sf_dir)
    return graph.unit_graph(rooms, walls)


@query(f"WITH {ROOMS}, {OPENINGS} SELECT page_id, CASE WHEN kind = 'exterior_window' THEN 'room_window_exterior' ELSE 'room_door_access' END AS kind, from_id, to_id, 0.85::DOUBLE AS confidence FROM o_edges")
def u13_graph_relationships(spark, sf_dir):
    return graph.graph_relationships(room_graph(spark, sf_dir)[2])
