"""Queries of the filters and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import filters, spatial
from ..workspace import stage, table
from .fixtures import entities, kept, kept_entities, views
from .q_columns import CX, CY
from .registry import query

C = F.col


def rects(df):
    """Regions with their rectangle as the outline."""
    return df.withColumn("points", g.rect_points(C("x"), C("y"), C("w"), C("h")))


def inside(px, py, o):
    """SQL: (px, py) in the five-point outline of table o, borders as in the even-odd test."""
    x, y, w, h = (f"{o}.{c}" for c in "xywh")
    right = f"(-({w} / 2)) * ({py} - ({y} + {h})) / ({h} / 4) + ({x} + {w})"
    left = f"(-({w} / 2)) * ({py} - ({y} + {h} * 1.25)) / (-({h} / 4)) + ({x} + {w} / 2)"
    return f"(({py} >= {y} AND {py} < {y} + {h} AND {px} >= {x} AND {px} < {x} + {w}) OR ({py} >= {y} + {h} AND {py} < {y} + {h} * 1.25 AND {px} >= {left} AND {px} < {right}))"


CENTRED = f"(SELECT *, {CX} AS cx, {CY} AS cy, (5 * x + 2.5 * w) / 5 AS mx, (5 * y + 3.25 * h) / 5 AS my FROM d_entities)"
COMMON = "label IN ('Lobby', 'Communal Outdoor Garden')"


@query("SELECT type, count(*) AS regions FROM d_entities WHERE CASE WHEN entity_id % 7 = 0 THEN 'user_edited' ELSE status END <> 'rejected' GROUP BY type")
def f1_live_regions(spark, sf_dir):
    df = entities(spark, sf_dir)
    overrides = df.where("entity_id % 7 = 0").select("entity_id", F.lit("user_edited").alias("status"))
    return filters.live(df, overrides).groupBy("type").agg(F.count("*").alias("regions"))


@query("""SELECT page_id, 'openings' AS task, count(*) AS regions FROM d_entities WHERE type IN ('door', 'window') GROUP BY 1 UNION ALL
SELECT page_id, 'rooms', count(*) FROM d_entities WHERE type IN ('room', 'unit_boundary') GROUP BY 1""")
def f2_regions_of_tasks(spark, sf_dir):
    df = entities(spark, sf_dir)
    one = lambda task: filters.for_task(df, task).groupBy("page_id").agg(F.count("*").alias("regions")).select("page_id", F.lit(task).alias("task"), "regions")
    return one("openings").unionByName(one("rooms"))


@query("""WITH l AS (SELECT page_id, ord, x + w / 2 AS cx, y + 7 AS cy FROM d_ocr_lines), f AS (SELECT *, cx BETWEEN 700 AND 1200 AND cy BETWEEN 600 AND 900 AS t FROM l)
SELECT page_id, ord, 'title' AS part FROM f WHERE t UNION ALL SELECT page_id, ord, 'drawing' FROM f WHERE CASE WHEN page_id % 2 = 0 THEN cx BETWEEN 0 AND 800 AND cy BETWEEN 0 AND 1100 ELSE NOT t END""")
def f3_title_and_drawing_text(spark, sf_dir):
    pages = views(spark, sf_dir, "d_pages")
    title = pages.select("page_id", g.box(F.lit(700), F.lit(600), F.lit(500), F.lit(300)).alias("crop"))
    drawing = pages.where("page_id % 2 = 0").select("page_id", g.box(F.lit(0), F.lit(0), F.lit(800), F.lit(1100)).alias("crop"))
    return filters.split_text(views(spark, sf_dir, "d_ocr_lines"), title, drawing).select("page_id", "ord", "part")


@query("SELECT page_id, count(*) AS regions FROM d_tile_regions WHERE x < 640 AND y < 500 AND least(x + w, 640) - x > 1 AND least(y + h, 500) - y > 1 GROUP BY 1")
def f4_regions_in_tiles(spark, sf_dir):
    df = views(spark, sf_dir, "d_tile_regions").withColumn("tile_w", F.lit(640.0)).withColumn("tile_h", F.lit(500.0))
    return filters.drop_padding(df).groupBy("page_id").agg(F.count("*").alias("regions"))


@query("""WITH r AS (SELECT concat('R', p_partkey) AS code, concat('kind_', p_partkey % 97) AS kind FROM part), g AS (SELECT CASE WHEN p_partkey % 5 <> 0 THEN concat('R', p_partkey) END AS rule_id, concat('kind_', p_partkey % 97) AS mapped_kind FROM part WHERE p_size < 10 AND p_partkey % 4 <> 0)
SELECT code, kind FROM r WHERE code IN (SELECT rule_id FROM g WHERE rule_id IS NOT NULL) OR kind IN (SELECT mapped_kind FROM g WHERE rule_id IS NULL)""")
def f5_active_part_rules(spark, sf_dir):
    key = C("p_partkey")
    own = table(spark, sf_dir, "part").select(F.concat(F.lit("R"), key.cast("string")).alias("code"), F.concat(F.lit("kind_"), (key % 97).cast("string")).alias("kind"), key.alias("k"), "p_size")
    status = F.when(C("k") % 4 != 0, "accepted").otherwise("pending")
    guidelines = own.where("p_size < 10").select(F.when(C("k") % 5 != 0, C("code")).alias("rule_id"), C("kind").alias("mapped_kind"), status.alias("status"))
    return filters.active_rules(own.select("code", "kind"), guidelines)


@query("""WITH p AS (SELECT page_id, entity_id, CASE WHEN page_id % 3 = 0 AND type = 'wall' AND entity_id % 2 = 0 THEN 1 ELSE 0 END AS head FROM d_entities WHERE type IN ('wall', 'door')), m AS (SELECT page_id, max(head) AS any_head FROM p GROUP BY 1)
SELECT page_id, entity_id FROM p JOIN m USING (page_id) WHERE any_head = 0 OR head = 1""")
def f6_structural_pool(spark, sf_dir):
    source = F.when((C("page_id") % 3 == 0) & (C("type") == "wall") & (C("entity_id") % 2 == 0), "structural").otherwise("model")
    return filters.structural_pool(entities(spark, sf_dir).withColumn("source", source)).select("page_id", "entity_id")


@query(f"""WITH e AS {CENTRED}, p AS (SELECT o.page_id, o.entity_id AS to_id, o.type, r.entity_id AS from_id, row_number() OVER (PARTITION BY o.entity_id ORDER BY greatest(1, r.w * r.h), r.ord) AS n
  FROM e o JOIN e r ON r.page_id = o.page_id AND r.type = 'room' AND o.cx BETWEEN r.x - 24 AND r.x + r.w + 24 AND o.cy BETWEEN r.y - 24 AND r.y + r.h + 24 WHERE o.type IN ('door', 'window'))
SELECT page_id, CASE WHEN type = 'door' THEN 'room_door_access' ELSE 'room_window_access' END AS kind, from_id, to_id FROM p WHERE n = 1""")
def j1_opening_room(spark, sf_dir):
    return spatial.opening_room(entities(spark, sf_dir))


@query(f"""WITH e AS {CENTRED}, p AS (SELECT o.page_id, o.entity_id AS to_id, r.entity_id AS from_id, row_number() OVER (PARTITION BY o.entity_id ORDER BY greatest(1, r.w * r.h), r.ord) AS n
  FROM e o JOIN e r ON r.page_id = o.page_id AND r.type = 'room' AND {inside("o.cx", "o.cy", "r")} WHERE o.type = 'fixture')
SELECT page_id, 'room_contains_fixture' AS kind, from_id, to_id FROM p WHERE n = 1""")
def j2_fixture_room(spark, sf_dir):
    return spatial.fixture_room(entities(spark, sf_dir))


@query("""SELECT a.page_id, 'room_adjacency' AS kind, a.entity_id AS from_id, b.entity_id AS to_id FROM d_entities a JOIN d_entities b ON a.page_id = b.page_id AND a.ord < b.ord
AND a.x - 24 <= b.x + b.w + 24 AND b.x - 24 <= a.x + a.w + 24 AND a.y - 24 <= b.y + b.h + 24 AND b.y - 24 <= a.y + a.h + 24 WHERE a.type = 'room' AND b.type = 'room'""")
def j3_room_adjacency(spark, sf_dir):
    return spatial.room_adjacency(entities(spark, sf_dir))


UNIT_ROOMS = f"""u_rooms AS (SELECT * FROM (SELECT u.page_id, u.entity_id AS unit_id, u.ord AS unit_ord, u.label AS unit_label, r.entity_id AS room_id, r.ord AS room_ord, r.label AS room_label,
  CASE WHEN {inside("r.cx", "r.cy", "u")} THEN 'polygon' WHEN r.cx BETWEEN u.x AND u.x + u.w AND r.cy BETWEEN u.y AND u.y + u.h THEN 'box'
    WHEN greatest(least(u.x + u.w, r.x + r.w) - greatest(u.x, r.x), 0) * greatest(least(u.y + u.h, r.y + r.h) - greatest(u.y, r.y), 0) / (r.w * r.h) >= 0.5 THEN 'overlap' END AS method
  FROM c_entities u JOIN c_entities r ON u.page_id = r.page_id AND u.type = 'unit_boundary' AND r.type = 'room' AND r.label NOT IN ('Lobby', 'Communal Outdoor Garden')) z WHERE method IS NOT NULL)"""


@query(f"WITH c_entities AS {CENTRED}, {UNIT_ROOMS} SELECT * FROM u_rooms")
def j4_unit_rooms(spark, sf_dir):
    return spatial.unit_rooms(entities(spark, sf_dir))


@query(f"""WITH c_entities AS {CENTRED}, {UNIT_ROOMS} SELECT page_id, entity_id AS from_id, entity_id AS to_id, label, 'unit' AS source FROM d_entities WHERE type = 'unit_boundary'
UNION ALL SELECT page_id, room_id, unit_id, unit_label, 'unit_contains_room' FROM u_rooms""")
def j5_unit_labels(spark, sf_dir):
    df = entities(spark, sf_dir)
    return spatial.unit_label_assignment(df, spatial.unit_rooms(df))


@query(f"""WITH e AS {CENTRED}, h AS (SELECT i.page_id, i.type, o.type AS outer_type, o.entity_id AS from_id, i.entity_id AS to_id, row_number() OVER (PARTITION BY i.entity_id, o.type ORDER BY o.ord) AS n
  FROM e i JOIN e o ON i.page_id = o.page_id AND {inside("i.mx", "i.my", "o")} WHERE (i.type = 'room' AND o.type = 'unit_boundary') OR (i.type IN ('door', 'window', 'fixture') AND o.type = 'room'))
SELECT page_id, CASE type WHEN 'room' THEN 'unit_contains_room' WHEN 'door' THEN 'room_door_access' WHEN 'window' THEN 'room_window_exterior' ELSE 'room_contains_fixture' END AS kind, from_id, to_id
FROM h WHERE type IN ('door', 'window') OR n = 1""")
def j6_fused_relations(spark, sf_dir):
    return spatial.fused_relations(entities(spark, sf_dir))


ROOMS = f"""c_entities AS {CENTRED}, {UNIT_ROOMS}, g_rooms AS (SELECT r.page_id, r.entity_id AS room_id, r.ord, r.label, {COMMON} AS is_common, r.x, r.y, r.w, r.h, u.unit_id, u.unit_label FROM d_entities r
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY unit_ord) AS n FROM u_rooms) z WHERE n = 1) u ON u.room_id = r.entity_id WHERE r.type = 'room')"""
SAME = "((a.is_common AND b.is_common) OR coalesce(a.unit_id = b.unit_id, false) OR coalesce(a.unit_label = b.unit_label, false))"


def _vertex_to_box(px, py, o):
    x, y, w, h = (f"{o}.{c}" for c in "xywh")
    dx, dy = f"greatest({x} - {px}, 0, {px} - {x} - {w})", f"greatest({y} - {py}, 0, {py} - {y} - {h})"
    border = f"least(abs({px} - {x}), abs({px} - {x} - {w}), abs({py} - {y}), abs({py} - {y} - {h}))"
    held = f"({px} >= {x} AND {px} < {x} + {w} AND {py} >= {y} AND {py} < {y} + {h})"
    return f"CASE WHEN {held} THEN 0 WHEN {dx} = 0 AND {dy} = 0 THEN {border} ELSE sqrt({dx} * {dx} + {dy} * {dy}) END"


def _box_gap(a, b):
    corners = lambda o: [(f"({o}.x{i})", f"({o}.y{j})") for i in ("", f" + {o}.w") for j in ("", f" + {o}.h")]
    return "least(" + ", ".join([_vertex_to_box(*p, b) for p in corners(a)] + [_vertex_to_box(*p, a) for p in corners(b)]) + ")"


WALLS = f"""walls AS (SELECT a.page_id, 'shared_wall' AS kind, a.room_id AS from_id, b.room_id AS to_id FROM g_rooms a JOIN g_rooms b ON a.page_id = b.page_id AND a.ord < b.ord AND {SAME}
  AND a.x - 12 < b.x + b.w + 12 AND b.x - 12 < a.x + a.w + 12 AND a.y - 12 < b.y + b.h + 12 AND b.y - 12 < a.y + a.h + 12 WHERE {_box_gap("a", "b")} <= 24)"""


def room_graph(spark, sf_dir, df=None):
    """(rooms, shared walls, opening edges) over rectangles; entities and rooms, each read several times, are written."""
    df = kept_entities(spark, sf_dir) if df is None else df
    nodes = spatial.room_nodes(df, spatial.unit_rooms(df)).select("*", "bbox.x", "bbox.y", C("bbox.width").alias("w"), C("bbox.height").alias("h"))
    rooms = rects(stage(nodes.drop("points", "bbox"), "rooms").withColumn("bbox", g.box(C("x"), C("y"), C("w"), C("h"))))
    openings = rects(spatial.of_type(df, "door", "window"))
    return rooms, spatial.shared_wall_edges(rooms), spatial.opening_edges(rooms, openings)


@query(f"WITH {ROOMS}, {WALLS} SELECT * FROM walls")
def j7_shared_walls(spark, sf_dir):
    return room_graph(spark, sf_dir)[1]


OPENINGS = f"""o_pairs AS (SELECT o.page_id, o.entity_id AS via_id, o.type, r.room_id, r.is_common, r.unit_id, r.unit_label, {_vertex_to_box("(o.x + o.w / 2)", "(o.y + o.h / 2)", "r")} AS d, r.ord FROM d_entities o
  JOIN g_rooms r ON o.page_id = r.page_id WHERE o.type IN ('door', 'window')), o_rank AS (SELECT *, row_number() OVER (PARTITION BY via_id ORDER BY d, ord) AS n FROM o_pairs WHERE d <= 24),
o_edges AS (SELECT a.page_id, CASE WHEN a.type = 'window' THEN 'exterior_window' WHEN b.room_id IS NOT NULL AND {SAME} THEN 'door' ELSE 'room_door' END AS kind, a.room_id AS from_id,
  CASE WHEN a.type = 'door' AND b.room_id IS NOT NULL AND {SAME} THEN b.room_id ELSE a.via_id END AS to_id, a.via_id FROM o_rank a LEFT JOIN o_rank b ON a.via_id = b.via_id AND b.n = 2 WHERE a.n = 1)"""


@query(f"WITH {ROOMS}, {OPENINGS} SELECT * FROM o_edges")
def j8_opening_edges(spark, sf_dir):
    return room_graph(spark, sf_dir)[2]


@query("""WITH p AS (SELECT i.page_id, i.entity_id AS item_id, s.entity_id AS seed_id, (i.x - s.x) * (i.x - s.x) + (i.y - s.y) * (i.y - s.y) AS d2, s.ord FROM d_entities i JOIN d_entities s ON i.page_id = s.page_id
  WHERE i.type = 'fixture' AND s.type = 'unit_boundary'), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY d2, ord) AS n FROM p WHERE d2 <= 90000) SELECT page_id, item_id, seed_id, d2 FROM r WHERE n = 1""")
def j10_nearest_seed(spark, sf_dir):
    df = entities(spark, sf_dir)
    items = spatial.of_type(df, "fixture").select("page_id", C("entity_id").alias("item_id"), "x", "y")
    seeds = spatial.of_type(df, "unit_boundary").select("page_id", C("entity_id").alias("seed_id"), C("ord").alias("seed_ord"), C("x").alias("sx"), C("y").alias("sy"))
    return spatial.nearest_seed(items, seeds, 90000.0)


@query(f"""WITH e AS {CENTRED}, s AS (SELECT page_id, ord AS seed_id, x + w / 2 AS sx, y + 7 AS sy FROM d_ocr_lines WHERE ord % 13 IN (8, 9)), p AS (SELECT s.page_id, s.seed_id, u.entity_id AS unit_id, u.ord, u.w * u.h AS area, {inside("s.sx", "s.sy", "u")} AS held,
  round(sqrt((s.sx - u.cx) * (s.sx - u.cx) + (s.sy - u.cy) * (s.sy - u.cy)), 6) AS d FROM s LEFT JOIN e u ON u.page_id = s.page_id AND u.type = 'unit_boundary'),
r AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY CASE WHEN held THEN 0 WHEN d <= 300 THEN 1 ELSE 2 END, CASE WHEN held THEN area ELSE d END, ord) AS n FROM p)
SELECT page_id, seed_id, CASE WHEN held OR d <= 300 THEN unit_id END AS unit_id, CASE WHEN held OR d <= 300 THEN held END AS inside FROM r WHERE n = 1""")
def j11_units_of_seeds(spark, sf_dir):
    seeds = views(spark, sf_dir, "d_ocr_lines").where("text IN ('BED 2', 'KITCHEN / DINING')").select("page_id", C("ord").alias("seed_id"), (C("x") + C("w") / 2).alias("sx"), (C("y") + 7).alias("sy"))
    return spatial.seed_unit(seeds, spatial.of_type(entities(spark, sf_dir), "unit_boundary"), 300.0)


@query(f"""WITH d AS (SELECT page_id, entity_id, label, x + w / 2 AS px, y + h / 2 AS py FROM d_entities WHERE type = 'door')
SELECT page_id, entity_id, 'label' AS reason FROM d WHERE label = 'Main Door' AND page_id IN (SELECT page_id FROM d_entities WHERE type = 'room' AND {COMMON}) UNION ALL
SELECT DISTINCT d.page_id, d.entity_id, 'near' FROM d JOIN d_entities r ON r.page_id = d.page_id AND r.type = 'room' AND r.{COMMON} WHERE d.label <> 'Main Door' AND {_vertex_to_box("d.px", "d.py", "r")} <= 24""")
def j21_entrance_doors(spark, sf_dir):
    df = rects(entities(spark, sf_dir))
    return spatial.doors_on_shared_area(spatial.of_type(df, "door"), spatial.of_type(df, "room").where("label IN ('Lobby', 'Communal Outdoor Garden')"))


@query(f"""SELECT DISTINCT r.page_id, r.entity_id FROM d_entities r JOIN d_entities s ON s.page_id = r.page_id AND s.label = 'External Wall' WHERE r.type = 'room' AND {_vertex_to_box("(r.x + r.w / 2)", "(r.y + r.h / 2)", "s")} <= 24""")
def j22_rooms_at_external_walls(spark, sf_dir):
    df = rects(entities(spark, sf_dir))
    return spatial.touches_external(spatial.of_type(df, "room"), spatial.of_type(df, "wall"))


@query(f"""WITH {ROOMS}, {OPENINGS} SELECT page_id, room_id, label FROM g_rooms r WHERE label IN ('Bedroom', 'master_bedroom', 'Open Living') AND NOT EXISTS (SELECT 1 FROM o_edges o WHERE o.kind = 'exterior_window' AND o.from_id = r.room_id)""")
def j23_rooms_without_window(spark, sf_dir):
    rooms, _, edges = room_graph(spark, sf_dir)
    return spatial.missing_windows(rooms, edges)


def tiles(spark, sf_dir, keep=False):
    df = views(spark, sf_dir, "d_tile_regions", kept(spark, sf_dir) if keep else None)
    return (stage(df, "tiles") if keep else df).withColumn("bbox", g.box(C("x"), C("y"), C("w"), C("h")))


_I = "(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0))"
TILE_PAIRS = f"""t_pairs AS (SELECT a.page_id, a.region_id AS a, b.region_id AS b FROM d_tile_regions a JOIN d_tile_regions b ON a.page_id = b.page_id AND a.type = b.type AND a.label = b.label AND a.region_id < b.region_id
  WHERE round({_I} / (a.w * a.h + b.w * b.h - {_I}), 9) >= 0.45 OR round({_I} / least(a.w * a.h, b.w * b.h), 9) >= 0.45)"""


@query(f"WITH {TILE_PAIRS} SELECT * FROM t_pairs")
def j25_tile_matches(spark, sf_dir):
    return spatial.tile_matches(tiles(spark, sf_dir))


def seam_regions(spark, sf_dir, keep=False):
    """Regions cut at two columns of tiles that touch and two rows that overlap, with their tile."""
    df = views(spark, sf_dir, "d_seam_regions")
    df = (stage(df, "seams") if keep else df).withColumn("bbox", g.box(C("x"), C("y"), C("w"), C("h")))
    return df.withColumn("tile", g.box(C("tx"), C("ty"), C("tw"), C("th")))


_E = "(abs({0}.x - {0}.tx) <= 8 OR abs({0}.x + {0}.w - {0}.tx - {0}.tw) <= 8 OR abs({0}.y - {0}.ty) <= 8 OR abs({0}.y + {0}.h - {0}.ty - {0}.th) <= 8)"
_EA, _EB = _E.format("a"), _E.format("b")
_TOUCH = "(a.x + a.w >= b.x AND b.x + b.w >= a.x AND a.y + a.h >= b.y AND b.y + b.h >= a.y)"
SEAM_PAIRS = f"""s_pairs AS (SELECT a.page_id, a.region_id AS a, b.region_id AS b FROM d_seam_regions a JOIN d_seam_regions b ON a.page_id = b.page_id AND a.type = b.type AND a.label = b.label AND a.region_id < b.region_id
  WHERE round({_I} / (a.w * a.h + b.w * b.h - {_I}), 9) >= 0.45 OR round({_I} / least(a.w * a.h, b.w * b.h), 9) >= 0.45 OR (({_EA} OR {_EB}) AND {_I} > 0) OR ({_EA} AND {_EB} AND {_TOUCH}))"""


@query(f"WITH {SEAM_PAIRS} SELECT * FROM s_pairs")
def j25_seam_matches(spark, sf_dir):
    return spatial.tile_matches(seam_regions(spark, sf_dir))
