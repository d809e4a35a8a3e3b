"""Queries of the hierarchy of a building and of the scale that a page's text states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import hierarchy
from .fixtures import kept, pentagon, views
from .q_spatial import CENTRED, COMMON, inside
from .registry import query

C = F.col
#: SQL: part of the box around room r's outline that unit u's covers.
_PART = """greatest(least(u.x + u.w, r.x + r.w) - greatest(u.x, r.x), 0) * greatest(least(u.y + u.h * 1.25, r.y + r.h * 1.25) - greatest(u.y, r.y), 0) / (r.w * (r.h * 1.25))"""
_HELD = inside("r.cx", "r.cy", "u")


@query(f"""WITH plans AS (SELECT *, concat('building-', page_id % 5) AS building FROM d_pages WHERE page_id % 9 <> 0), n AS (SELECT z.*, p.ppm, {COMMON} AS common FROM {CENTRED.replace("d_entities", "d_node_entities")} z JOIN plans p USING (page_id) WHERE status <> 'rejected'),
u AS (SELECT * FROM n WHERE type = 'unit_boundary'), r AS (SELECT *, coalesce(printed_m2, w * h * 1.125 / (ppm * ppm)) AS m2 FROM n WHERE type = 'room'),
k AS (SELECT r.entity_id AS room_id, u.entity_id AS unit_id, 1 AS p, 0.0::DOUBLE AS s, u.ord FROM r JOIN u ON u.page_id = r.page_id AND u.entity_id = r.unit_ref WHERE NOT r.common
  UNION ALL SELECT r.entity_id, u.entity_id, 2, 0, u.ord FROM r JOIN u ON u.page_id = r.page_id AND u.label = r.unit_text WHERE NOT r.common
  UNION ALL SELECT r.entity_id, u.entity_id, CASE WHEN {_HELD} THEN 3 ELSE 4 END, CASE WHEN {_HELD} THEN 0 ELSE -({_PART}) END, u.ord FROM r JOIN u ON u.page_id = r.page_id WHERE NOT r.common AND ({_HELD} OR {_PART} >= 0.5)),
placed AS (SELECT room_id, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY p, s, ord) AS i FROM k) z WHERE i = 1),
h AS (SELECT r.*, CASE WHEN common THEN NULL WHEN r.page_id IN (SELECT page_id FROM u) THEN CAST(placed.unit_id AS VARCHAR) ELSE concat('unit-fallback-', r.page_id) END AS unit FROM r LEFT JOIN placed ON room_id = entity_id),
c AS (SELECT page_id, unit, count(*) AS n, count(*) FILTER (lower(label) LIKE '%bed%') AS beds, count(*) FILTER (lower(label) LIKE '%bath%' OR lower(label) LIKE '%ensuite%' OR lower(label) LIKE '%toilet%') AS baths, sum(m2) AS m2 FROM h WHERE unit IS NOT NULL GROUP BY 1, 2),
o AS (SELECT o.page_id, o.entity_id, o.label, o.confidence, r.entity_id AS room_id, row_number() OVER (PARTITION BY o.entity_id ORDER BY r.w * r.h, r.ord) AS i FROM n o LEFT JOIN r ON o.page_id = r.page_id AND {inside("o.cx", "o.cy", "r")} WHERE o.type IN ('door', 'window', 'fixture'))
SELECT page_id, 'floor' AS kind, concat('floor-', page_id) AS node_id, building AS parent_id, NULL::VARCHAR AS unit_id, NULL::VARCHAR AS label, NULL::DOUBLE AS area_m2, (SELECT count(*) FROM r WHERE r.page_id = plans.page_id) AS rooms, NULL::BIGINT AS bedrooms, NULL::BIGINT AS bathrooms, NULL::DOUBLE AS confidence FROM plans
UNION ALL SELECT u.page_id, 'unit', CAST(entity_id AS VARCHAR), concat('floor-', u.page_id), CAST(entity_id AS VARCHAR), label, round(w * h * 1.125 / (ppm * ppm), 6), coalesce(n, 0), coalesce(beds, 0), coalesce(baths, 0), confidence FROM u LEFT JOIN c ON c.page_id = u.page_id AND unit = CAST(entity_id AS VARCHAR)
UNION ALL SELECT p.page_id, 'unit', concat('unit-fallback-', p.page_id), concat('floor-', p.page_id), concat('unit-fallback-', p.page_id), 'Unit 1', round(CASE WHEN ppm > 0 AND m2 <> 0 THEN m2 END, 6), coalesce(n, 0), coalesce(beds, 0), coalesce(baths, 0), 0.5 FROM plans p LEFT JOIN c USING (page_id) WHERE p.page_id NOT IN (SELECT page_id FROM u)
UNION ALL SELECT page_id, 'room', CAST(entity_id AS VARCHAR), coalesce(unit, concat('floor-', page_id)), unit, label, round(m2, 6), NULL, NULL, NULL, confidence FROM h
UNION ALL SELECT page_id, 'object', CAST(entity_id AS VARCHAR), coalesce(CAST(o.room_id AS VARCHAR), concat('floor-', page_id)), CAST(placed.unit_id AS VARCHAR), label, NULL, NULL, NULL, NULL, confidence FROM o LEFT JOIN placed ON placed.room_id = o.room_id WHERE i = 1""")
def j28_hierarchy(spark, sf_dir):
    df = kept(spark, sf_dir)
    pages = views(spark, sf_dir, "d_pages", df).select("page_id", "ppm", (C("page_id") % 9 != 0).alias("is_floor_plan"), F.concat(F.lit("building-"), C("page_id") % 5).alias("building_id"))
    return hierarchy.hierarchy(pentagon(views(spark, sf_dir, "d_node_entities", df)), pages)


_GAPS = """(NOT (a.boxed AND b.boxed) AND abs(a.pos - b.pos) <= 2 OR a.boxed AND b.boxed AND greatest(0, a.x - (b.x + b.w), b.x - (a.x + a.w)) <= 14 * 12 AND greatest(0, a.y - (b.y + 14), b.y - (a.y + 14)) <= 14 * 5)"""


@query(rf"""WITH l AS (SELECT *, ord % 17 <> 0 AS boxed, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS pos FROM d_scale_lines),
t AS (SELECT *, lower(text) LIKE '%scale%' AS named, CAST(nullif(regexp_extract(text, '1:(\d+)', 1), '') AS INT) AS ratio, nullif(regexp_extract(text, '@ ([AB][0-5])', 1), '') AS paper FROM l),
k AS (SELECT a.*, a.named OR EXISTS (SELECT 1 FROM t b WHERE b.named AND b.page_id = a.page_id AND {_GAPS}) AS labelled FROM t a WHERE ratio IS NOT NULL OR paper IS NOT NULL),
c AS (SELECT page_id, 1 AS n, CAST(pos AS DOUBLE) AS k0, 0.0::DOUBLE AS k1, 0.0::DOUBLE AS k2, 0.0::DOUBLE AS k3, ratio, paper, 'line' AS source FROM k WHERE ratio IS NOT NULL AND paper IS NOT NULL
  UNION ALL SELECT a.page_id, 2, -round(CASE WHEN a.labelled OR b.labelled THEN 20 ELSE 8 END + a.confidence + b.confidence - CASE WHEN a.boxed AND b.boxed THEN sqrt((a.x + a.w / 2 - b.x - b.w / 2) ^ 2 + (a.y - b.y) ^ 2) / 40 ELSE abs(a.pos - b.pos) END, 9), a.pos, b.pos, 0, a.ratio, b.paper, 'pair'
    FROM k a JOIN k b ON a.page_id = b.page_id AND {_GAPS} WHERE a.ratio IS NOT NULL AND b.paper IS NOT NULL
  UNION ALL SELECT page_id, 3, CASE WHEN labelled THEN 0 ELSE 1 END, CASE WHEN named THEN 0 ELSE 1 END, -confidence, pos, ratio, NULL, 'ratio' FROM k WHERE ratio IS NOT NULL)
SELECT page_id, ratio, paper, concat('1:', ratio, CASE WHEN paper IS NOT NULL THEN concat(' @ ', paper) ELSE '' END) AS declared, source FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n, k0, k1, k2, k3) AS i FROM c) z WHERE i = 1""")
def j17_scales_of_pages(spark, sf_dir):
    box = F.when(C("ord") % 17 != 0, g.box(C("x"), C("y"), C("w"), C("h")))
    return hierarchy.scale_of_page(views(spark, sf_dir, "d_scale_lines").withColumn("bbox", box))
