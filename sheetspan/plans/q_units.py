"""Queries of labels matched one to one and of inferred units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import spatial, units
from .fixtures import kept_entities, views
from .q_graph import _closure
from .q_spatial import CENTRED, COMMON, UNIT_ROOMS
from .registry import query

C = F.col


@query("""WITH RECURSIVE p AS (SELECT u.page_id, u.entity_id AS item_id, s.ord AS seed_id, (u.x + u.w / 2 - s.x - s.w / 2) ^ 2 + (u.y + u.h / 2 - s.y - 7) ^ 2 AS d2,
  row_number() OVER (PARTITION BY u.page_id ORDER BY (u.x + u.w / 2 - s.x - s.w / 2) ^ 2 + (u.y + u.h / 2 - s.y - 7) ^ 2, u.entity_id, s.ord) AS i FROM d_entities u JOIN d_ocr_lines s ON s.page_id = u.page_id AND u.type = 'unit_boundary' AND s.text LIKE 'UNIT %'),
f AS (SELECT DISTINCT page_id, 0::BIGINT AS i, []::BIGINT[] AS items, []::BIGINT[] AS seeds, NULL::BIGINT AS item_id, NULL::BIGINT AS seed_id, NULL::DOUBLE AS d2 FROM p
  UNION ALL SELECT p.page_id, p.i, CASE WHEN taken THEN items ELSE list_append(items, p.item_id) END, CASE WHEN taken THEN seeds ELSE list_append(seeds, p.seed_id) END, CASE WHEN taken THEN NULL ELSE p.item_id END, p.seed_id, p.d2
  FROM (SELECT f.page_id, f.i, f.items, f.seeds, p.i AS n, list_contains(items, p.item_id) OR list_contains(seeds, p.seed_id) AS taken FROM f JOIN p ON p.page_id = f.page_id AND p.i = f.i + 1) z JOIN p ON p.page_id = z.page_id AND p.i = z.n)
SELECT page_id, item_id, seed_id, d2 FROM f WHERE item_id IS NOT NULL""")
def j9_labels_of_units(spark, sf_dir):
    middle = lambda ident, x, y, h: ("page_id", C(ident[0]).alias(ident[1]), (C("x") + C("w") / 2).alias(x), (C("y") + h).alias(y))
    own = views(spark, sf_dir, "d_entities").where("type = 'unit_boundary'").select(*middle(("entity_id", "item_id"), "x", "y", C("h") / 2))
    seeds = views(spark, sf_dir, "d_ocr_lines").where("text LIKE 'UNIT %'").select(*middle(("ord", "seed_id"), "sx", "sy", F.lit(7.0)))
    return units.assign_greedy(own, seeds)


#: SQL: hull corners of a cluster: a is one if an edge from it has all points on one side and ends at the farthest point of its line.
_NEAR = "d.cx BETWEEN r.x - 24 AND r.x + r.w + 24 AND d.cy BETWEEN r.y - 24 AND r.y + r.h + 24"


@query(f"""WITH c_entities AS {CENTRED}, {UNIT_ROOMS}, rooms AS (SELECT *, {COMMON} AS shared FROM c_entities WHERE type = 'room'),
nr AS (SELECT d.page_id, d.entity_id AS via, d.label = 'Main Door' AS main, r.entity_id AS room_id, r.shared FROM c_entities d JOIN rooms r ON r.page_id = d.page_id AND d.type = 'door' AND {_NEAR}),
fi AS (SELECT via, min(room_id) AS a FROM nr WHERE NOT shared AND NOT main GROUP BY 1), ed AS (SELECT fi.a, nr.room_id AS b FROM nr JOIN fi USING (via) WHERE NOT shared AND room_id > fi.a),
nd AS (SELECT entity_id AS n FROM rooms WHERE NOT shared AND page_id IN (SELECT page_id FROM c_entities WHERE type = 'door')), {_closure("nd", "ed")},
ent AS (SELECT component, list_sort(list(DISTINCT via)) AS entrance_ids FROM nr JOIN low ON low.node = nr.room_id WHERE NOT shared AND via IN (SELECT via FROM nr WHERE main OR shared) GROUP BY 1),
fr AS (SELECT r.*, low.component FROM rooms r JOIN low ON low.node = r.entity_id WHERE entity_id NOT IN (SELECT room_id FROM u_rooms)),
pt AS (SELECT DISTINCT component, unnest([x, x + w, x + w, x + w / 2, x]) AS x, unnest([y, y, y + h, y + h + h / 4, y + h]) AS y FROM fr),
ab AS (SELECT a.component, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM pt a JOIN pt b ON a.component = b.component AND (a.x <> b.x OR a.y <> b.y)),
hu AS (SELECT e.component, ax, ay, bx, by_ FROM ab e JOIN pt c ON c.component = e.component GROUP BY 1, 2, 3, 4, 5
  HAVING min((bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax)) >= 0 AND max(CASE WHEN (bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) = 0 AND ((c.x - ax) * (c.x - bx) > 0 OR (c.y - ay) * (c.y - by_) > 0) THEN 1 ELSE 0 END) = 0),
hs AS (SELECT component, count(*) AS corners, round(sum(ax * by_ - bx * ay) / 2, 4) AS area, min(ax) AS x, min(ay) AS y, max(ax) - min(ax) AS w, max(ay) - min(ay) AS h FROM hu GROUP BY 1),
un AS (SELECT page_id, component, list_sort(list(entity_id)) AS room_ids, round(avg(round(cx, 6)), 6) AS mx FROM fr GROUP BY 1, 2)
SELECT page_id, concat('Unit ', row_number() OVER (PARTITION BY page_id ORDER BY mx, component)) AS label, component AS unit_id, corners, area, x, y, w, h, 0.55::DOUBLE AS confidence, array_to_string(room_ids, ',') AS room_ids, coalesce(array_to_string(entrance_ids, ','), '') AS entrance_ids
FROM un JOIN hs USING (component) LEFT JOIN ent USING (component)""")
def h3_inferred_units(spark, sf_dir):
    found = units.infer_units(kept_entities(spark, sf_dir))
    ids = lambda c: F.array_join(C(c).cast("array<string>"), ",").alias(c)
    return found.select(
        "page_id", "label", "unit_id", F.size("points").cast("long").alias("corners"), F.round(g.poly_area(C("points")), 4).alias("area"), "bbox.x", "bbox.y", C("bbox.width").alias("w"), C("bbox.height").alias("h"),
        "confidence", ids("room_ids"), ids("entrance_ids"),
    )
