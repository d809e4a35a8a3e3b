"""Queries of entrance doors, corridor seeds and unit numbers beside their word."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import entrances as op
from ..operators import rollup, spatial
from .fixtures import entities, views
from .q_spatial import COMMON, _vertex_to_box, rects
from .registry import query

C = F.col
#: SQL: doors with their middle and whether they pass for entrances by their width.
_DOORS = """d AS (SELECT page_id, entity_id, ord, label, x + w / 2 AS px, y + h / 2 AS py, least(w, h) AS span FROM d_entities WHERE type = 'door'),
g AS (SELECT page_id, span, lead(span) OVER (PARTITION BY page_id ORDER BY span, ord) - span AS gap FROM d), m AS (SELECT page_id, count(*) AS n, min(span) AS low, max(span) AS high, max(gap) AS gap FROM g GROUP BY 1),
s AS (SELECT m.page_id, n, CASE WHEN gap >= greatest(2, low * 0.12) THEN (SELECT min(span) FROM g WHERE g.page_id = m.page_id AND g.gap = m.gap) + gap / 2 WHEN high > low * 1.12 THEN low + (high - low) * 0.35 END AS split FROM m),
wd AS (SELECT d.*, label = 'Main Door' OR n = 1 OR coalesce(span >= split, false) AS wide FROM d JOIN s USING (page_id))"""


def _doors(spark, sf_dir):
    df = rects(entities(spark, sf_dir))
    return df, spatial.of_type(df, "door").withColumn("span", g.opening_span(C("points")))


@query(f"""WITH {_DOORS}, r AS (SELECT * FROM d_entities WHERE type = 'room' AND {COMMON} AND page_id % 3 <> 0), a AS (SELECT wd.page_id, entity_id, wide, label = 'Main Door' AS main, page_id IN (SELECT page_id FROM r) AS has_area,
  (SELECT min({_vertex_to_box("wd.px", "wd.py", "r")}) FROM r WHERE r.page_id = wd.page_id) AS away FROM wd),
f AS (SELECT page_id, entity_id, has_area, wide, wide AND coalesce(away <= 60, false) AS spine, has_area AND (main OR coalesce(away <= 24, false)) AS one, has_area AND (main OR coalesce(away <= 48, false)) AS two, coalesce(away <= 60, false) AS far FROM a),
n AS (SELECT page_id, count(*) FILTER (spine) AS spines, count(*) FILTER (wide) AS wides, count(*) FILTER (one) AS ones, count(*) FILTER (two) AS twos FROM f GROUP BY 1),
z AS (SELECT f.*, CASE WHEN spines > 0 THEN 'wide_near' WHEN wides > 1 THEN 'wide' WHEN ones > 0 THEN 'near' WHEN twos > 0 THEN 'near_2' WHEN NOT has_area THEN 'wide' ELSE 'near_2.5' END AS rule FROM f JOIN n USING (page_id))
SELECT page_id, entity_id, rule FROM z WHERE CASE rule WHEN 'wide_near' THEN spine WHEN 'wide' THEN wide WHEN 'near' THEN one WHEN 'near_2' THEN two ELSE far END""")
def n10_entrances(spark, sf_dir):
    df, doors = _doors(spark, sf_dir)
    shared = spatial.of_type(df, "room").where("label IN ('Lobby', 'Communal Outdoor Garden') AND page_id % 3 <> 0")
    return op.entrances(doors, shared, 24.0)


@query("SELECT page_id, entity_id, 'wide' AS rule FROM d_entities WHERE type = 'door' AND (label = 'Main Door' OR least(w, h) >= 90)")
def n10_entrances_by_threshold(spark, sf_dir):
    """On the pages where no door passes, shared areas would decide; none are given here."""
    df, doors = _doors(spark, sf_dir)
    return op.entrances(doors, df.where("false"), 24.0, mode="threshold", least=90.0)


@query(f"""WITH {_DOORS}, o AS (SELECT * FROM (SELECT *, count(*) FILTER (wide) OVER (PARTITION BY page_id) AS wides FROM wd) z WHERE wides = 0 OR wide),
b AS (SELECT page_id, 'h' AS axis, max(px) - min(px) AS span, min(ord) AS first, min(px) AS lx, avg(px) AS mx, max(px) AS hx, min(py) AS ly, avg(py) AS my, max(py) AS hy, count(*) AS n FROM o GROUP BY page_id, floor(py / 48 + 0.5)
  UNION ALL SELECT page_id, 'v', max(py) - min(py), min(ord), min(px), avg(px), max(px), min(py), avg(py), max(py), count(*) FROM o GROUP BY page_id, floor(px / 48 + 0.5)),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY span DESC, axis, first) AS i FROM b WHERE n > 1 AND span > 0) z WHERE i = 1)
SELECT page_id, CAST(k AS INT) AS k, round(CASE WHEN axis = 'v' THEN mx + CASE WHEN k % 2 = 0 THEN -60 ELSE 60 END WHEN k < 2 THEN lx WHEN k < 4 THEN mx ELSE hx END, 6) AS x, round(CASE WHEN axis = 'h' THEN my + CASE WHEN k % 2 = 0 THEN -60 ELSE 60 END WHEN k < 2 THEN ly WHEN k < 4 THEN my ELSE hy END, 6) AS y FROM c CROSS JOIN range(6) r(k)
UNION ALL SELECT page_id, 0, round(min(px), 6), round(min(py) - 48, 6) FROM o GROUP BY page_id HAVING count(*) = 1""")
def n12_corridor_seeds(spark, sf_dir):
    doors = rollup.wide_doors(_doors(spark, sf_dir)[1]).select("page_id", "ord", (C("x") + C("w") / 2).alias("x"), (C("y") + C("h") / 2).alias("y"), "wide")
    return op.corridor_seeds(doors, 24.0)


@query(r"""WITH RECURSIVE a AS (SELECT * FROM d_number_lines WHERE text IN ('Unit', 'APT.')), b AS (SELECT *, upper(regexp_extract(text, '^#?\s*(\d{1,4}[A-Za-z]?)$', 1)) AS unit FROM d_number_lines WHERE regexp_matches(text, '^#?\s*\d{1,4}[A-Za-z]?$')),
p AS (SELECT a.page_id, a.ord AS word_ord, b.ord AS number_ord, unit, row_number() OVER (PARTITION BY a.page_id ORDER BY a.ord, (b.x - a.x) ^ 2 + (b.y - a.y) ^ 2, b.ord) AS i FROM a JOIN b ON a.page_id = b.page_id
  AND (least(a.y, b.y) + 14 - greatest(a.y, b.y) > 10 AND b.x - (a.x + 40) BETWEEN -16 AND 140 OR least(a.x, b.x) + 40 - greatest(a.x, b.x) > 10 AND b.y - (a.y + 14) BETWEEN -16 AND 140)),
s AS (SELECT DISTINCT page_id, 0::BIGINT AS i, []::BIGINT[] AS words, []::BIGINT[] AS numbers, NULL::BIGINT AS word_ord, NULL::BIGINT AS number_ord, NULL::VARCHAR AS unit FROM p
  UNION ALL SELECT p.page_id, p.i, CASE WHEN list_contains(words, p.word_ord) OR list_contains(numbers, p.number_ord) THEN words ELSE list_append(words, p.word_ord) END,
    CASE WHEN list_contains(words, p.word_ord) OR list_contains(numbers, p.number_ord) THEN numbers ELSE list_append(numbers, p.number_ord) END,
    CASE WHEN list_contains(words, p.word_ord) OR list_contains(numbers, p.number_ord) THEN NULL ELSE p.word_ord END, p.number_ord, p.unit FROM s JOIN p ON p.page_id = s.page_id AND p.i = s.i + 1)
SELECT page_id, word_ord, number_ord, unit FROM s WHERE word_ord IS NOT NULL""")
def j16_prefix_numbers(spark, sf_dir):
    lines = views(spark, sf_dir, "d_number_lines").withColumn("bbox", g.box(C("x"), C("y"), C("w"), C("h")))
    return op.prefix_numbers(lines)
