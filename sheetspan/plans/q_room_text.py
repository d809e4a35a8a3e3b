"""Queries of room names in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import room_text, spatial
from ..workspace import stage
from .fixtures import kept, views
from .q_graph import _closure
from .q_spatial import rects
from .registry import query

C = F.col
#: SQL: names with the smallest unit around them, and rooms likewise by their middle.
_UNIT = "(SELECT arg_min(u.entity_id, (u.w * u.h, u.ord)) FROM d_entities u WHERE u.type = 'unit_boundary' AND u.page_id = {0}.page_id AND {0}.px >= u.x AND {0}.px < u.x + u.w AND {0}.py >= u.y AND {0}.py < u.y + u.h)"
_SEEDS = f"""nm AS (SELECT page_id, ord AS seed_id, x + w / 2 AS px, y + 7 AS py, CASE text WHEN 'BED 2' THEN 'Bedroom 2' WHEN 'KITCHEN / DINING' THEN 'Kitchen / Dining' WHEN 'Living' THEN 'Open Living' ELSE 'Bathroom' END AS label FROM d_name_lines),
sd AS (SELECT nm.*, {_UNIT.format("nm")} AS unit_id FROM nm)"""
_ROOMS = f"""rm0 AS (SELECT page_id, entity_id AS room_id, ord, label, x, y, w, h, x + w / 2 AS px, y + h / 2 AS py FROM d_entities WHERE type = 'room'), rm AS (SELECT rm0.*, {_UNIT.format("rm0")} AS unit_id FROM rm0)"""
_NEAR = """op AS (SELECT sd.*, CASE WHEN sd.unit_id IS NULL THEN 96 ELSE greatest(80, least(160, 0.16 * greatest(u.w, u.h))) END AS radius FROM sd LEFT JOIN d_entities u ON u.entity_id = sd.unit_id WHERE sd.label IN ('Kitchen / Dining', 'Open Living')),
ne AS (SELECT a.seed_id AS a, b.seed_id AS b FROM op a JOIN op b ON a.page_id = b.page_id AND a.unit_id IS NOT DISTINCT FROM b.unit_id AND a.seed_id < b.seed_id AND sqrt((a.px - b.px) ^ 2 + (a.py - b.py) ^ 2) <= a.radius), nd AS (SELECT seed_id AS n FROM op)"""


def _units(df):
    return stage(spatial.unit_rings(spatial.of_type(rects(df), "unit_boundary")), "units")


def _seeds(spark, sf_dir, df, units):
    """Names in the text, each with the smallest unit around it; df: d_entities, written."""
    lines = views(spark, sf_dir, "d_name_lines", df).select("page_id", C("ord").alias("id"), t.ocr_room_label(C("text")).alias("label"), (C("x") + C("w") / 2).alias("x"), (C("y") + 7).alias("y"))
    return spatial.unit_around(stage(lines, "names"), units).withColumnRenamed("id", "seed_id")  # written: what follows names the label very often


def _rooms(df, units):
    own = spatial.of_type(rects(df), "room").select("page_id", C("entity_id").alias("id"), "ord", "label", "points", (C("x") + C("w") / 2).alias("x"), (C("y") + C("h") / 2).alias("y"))
    return spatial.unit_around(own, units).drop("x", "y").withColumnRenamed("id", "room_id")


@query(f"""WITH {_SEEDS}, {_NEAR}, {_closure("nd", "ne")}, k AS (SELECT op.*, component, count(*) OVER (PARTITION BY component) AS merged, bool_or(label = 'Open Living') OVER (PARTITION BY component) AS l, bool_or(label <> 'Open Living') OVER (PARTITION BY component) AS kd FROM op JOIN low ON low.node = op.seed_id)
SELECT page_id, seed_id, label, unit_id, round(px, 6) AS x, round(py, 6) AS y, 1 AS merged FROM sd WHERE seed_id NOT IN (SELECT seed_id FROM op) UNION ALL
SELECT page_id, component, CASE WHEN l AND kd THEN 'Living / Dining / Kitchen' WHEN l THEN 'Open Living' ELSE 'Kitchen / Dining' END, min(unit_id), round(avg(px), 6), round(avg(py), 6), max(merged) FROM k GROUP BY page_id, component, l, kd""")
def h12_open_plan_clusters(spark, sf_dir):
    df = kept(spark, sf_dir)
    units = _units(df)
    found = room_text.cluster_open_plan(_seeds(spark, sf_dir, df, units), units.select("page_id", "unit_id", C("ring").alias("points")))
    return found.select("page_id", "seed_id", "label", "unit_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "merged")


_MATCHED = f"""{_SEEDS}, {_ROOMS}, kk AS (SELECT unnest(['Bedroom 2', 'Kitchen / Dining', 'Open Living', 'Bathroom', 'Bedroom', 'master_bedroom', 'Ensuite', 'Balcony', 'Lobby', 'Store', 'Communal Outdoor Garden', 'Room']) AS label,
  unnest(['bedroom', 'kitchen', 'living', 'bathroom', 'bedroom', 'bedroom', 'bathroom', 'other', 'other', 'other', 'other', 'other']) AS category),
ca AS (SELECT sd.page_id, sd.seed_id, sd.label AS name, rm.room_id, rm.ord, coalesce(rm.unit_id, sd.unit_id) AS unit_id, sk.category, rk.category AS old_category, sd.label IN ('Kitchen / Dining', 'Open Living') AND rm.label = 'Open Living' AS together,
  CASE WHEN sd.px >= rm.x AND sd.px < rm.x + rm.w AND sd.py >= rm.y AND sd.py < rm.y + rm.h THEN sqrt((sd.px - rm.px) ^ 2 + (sd.py - rm.py) ^ 2) WHEN sk.category NOT IN ('bedroom', 'bathroom', 'robe') THEN 4000 + sqrt((sd.px - rm.px) ^ 2 + (sd.py - rm.py) ^ 2) END AS cost, rm.label = 'Room' AS plain
  FROM sd JOIN rm ON rm.page_id = sd.page_id AND (sd.unit_id IS NULL OR sd.unit_id = rm.unit_id) JOIN kk sk ON sk.label = sd.label JOIN kk rk ON rk.label = rm.label),
se AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN name = 'Bedroom 2' THEN 0 ELSE 1 END, name, seed_id) AS i, seed_id,
  list(struct_pack(room_id := room_id, fits := plain OR category = old_category OR together, label := CASE WHEN NOT together THEN name WHEN name = 'Open Living' THEN name ELSE 'Living / Dining / Kitchen' END, unit_id := unit_id) ORDER BY round(cost, 6), ord) AS options FROM ca WHERE round(cost, 6) <= 6000 GROUP BY page_id, seed_id, name),
fo AS (SELECT DISTINCT page_id, 0::BIGINT AS i, NULL::BIGINT AS seed_id, NULL::STRUCT(room_id BIGINT, fits BOOLEAN, "label" VARCHAR, unit_id BIGINT) AS o, []::BIGINT[] AS used FROM se
  UNION ALL SELECT page_id, i, seed_id, o, CASE WHEN o.fits THEN list_append(used, o.room_id) ELSE used END FROM (SELECT se.page_id, se.i, se.seed_id, list_filter(options, lambda x: NOT list_contains(used, x.room_id))[1] AS o, used FROM fo JOIN se ON se.page_id = fo.page_id AND se.i = fo.i + 1) z),
ma AS (SELECT page_id, seed_id, o.room_id AS room_id, o."label" AS label, o.unit_id AS unit_id FROM fo WHERE o.fits)"""


@query(f"WITH RECURSIVE {_MATCHED} SELECT * FROM ma")
def j12_rooms_named_by_text(spark, sf_dir):
    df = kept(spark, sf_dir)
    units = _units(df)
    return room_text.label_rooms_from_text(_rooms(df, units), _seeds(spark, sf_dir, df, units))


@query(f"""WITH RECURSIVE {_MATCHED}, nw AS (SELECT rm.page_id, rm.x, rm.y, rm.w, rm.h, coalesce(ma.unit_id, rm.unit_id) AS unit_id, coalesce(ma.label, rm.label) AS label FROM rm LEFT JOIN ma USING (room_id))
SELECT page_id, seed_id, label, unit_id, round(px - 36, 6) AS x, round(py - 36, 6) AS y, 5184::DOUBLE AS area FROM sd WHERE unit_id IS NOT NULL AND seed_id NOT IN (SELECT seed_id FROM ma) AND NOT (label IN ('Kitchen / Dining', 'Open Living') AND EXISTS (
  SELECT 1 FROM nw WHERE nw.page_id = sd.page_id AND nw.unit_id = sd.unit_id AND nw.label IN ('Open Living', 'Kitchen / Dining', 'Living / Dining / Kitchen') AND sd.px >= nw.x AND sd.px < nw.x + nw.w AND sd.py >= nw.y AND sd.py < nw.y + nw.h))""")
def j13_anchor_rooms(spark, sf_dir):
    df = kept(spark, sf_dir)
    units = _units(df)
    rooms, seeds = stage(_rooms(df, units), "rooms"), stage(_seeds(spark, sf_dir, df, units), "seeds")  # written, with the matches: all three are read twice
    found = room_text.text_anchor_rooms(seeds, stage(room_text.label_rooms_from_text(rooms, seeds), "matches"), rooms)
    return found.select("page_id", "seed_id", "label", "unit_id", F.round(C("points")[0]["x"], 6).alias("x"), F.round(C("points")[0]["y"], 6).alias("y"), "area")
