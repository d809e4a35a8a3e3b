"""Query of apartment types in title blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import types
from .fixtures import views
from .registry import query

C = F.col


def _beds(text: str) -> str:
    return f"CASE {text} WHEN '3B' THEN 3 WHEN 'Studio' THEN 0 WHEN '1BR' THEN 1 WHEN '2 Bed' THEN 2 WHEN '2B' THEN 2 END"


def _under(a: str, b: str) -> str:
    return f"""({b}.y + {b}.h / 2 > {a}.y + {a}.h / 2 AND {b}.y - {a}.y - {a}.h <= greatest({a}.h, 12) * 8 AND (least({a}.x + {a}.w, {b}.x + {b}.w) > greatest({a}.x, {b}.x) OR abs({a}.x + {a}.w / 2 - {b}.x - {b}.w / 2) <= greatest({a}.w, {b}.w, 24)))"""


@query(rf"""WITH l AS (SELECT *, coalesce(nullif(regexp_extract(text, '^(?:UNIT|Unit|Apartment) (\d+)', 1), ''), nullif(regexp_extract(text, '^\d+[A-Z]?$', 0), '')) AS num, text LIKE 'U%T' AS word, regexp_matches(text, '^\d+[A-Z]?$') AS bare FROM d_type_lines),
n AS (SELECT *, lag(word, 1, false) OVER o AND num IS NOT NULL AS taken, CASE WHEN word THEN lead(num) OVER o END AS ahead FROM l WINDOW o AS (PARTITION BY page_id ORDER BY ord)),
r AS (SELECT page_id, ord, x, y, w, h, x + w / 2 AS cx, y + h / 2 AS cy, greatest(h, 12) AS lh, coalesce(ahead, CASE WHEN NOT bare THEN num END) AS unit, CASE WHEN text LIKE 'Unit % Type 2B' THEN 2 END AS beds, CASE WHEN text LIKE 'Type%2%' THEN 2 END AS named,
  text IN ('Type', 'types.') AS label, {_beds("text")} AS token FROM n WHERE NOT taken),
w AS (SELECT *, sum(CASE WHEN cy - pcy > 0.55 * greatest(lh, plh) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY cy, ord) AS line FROM (SELECT *, lag(cy) OVER (PARTITION BY page_id ORDER BY cy, ord) AS pcy, lag(lh) OVER (PARTITION BY page_id ORDER BY cy, ord) AS plh FROM r) z),
s AS (SELECT *, row_number() OVER o AS k, last_value(unit IGNORE NULLS) OVER o AS known, last_value(CASE WHEN beds IS NOT NULL OR named IS NOT NULL THEN false WHEN label THEN true WHEN token IS NOT NULL THEN false END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line, cx, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS waits,
  last_value(unit IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line, cx, ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM w WINDOW o AS (PARTITION BY page_id ORDER BY line, cx, ord)),
a AS (SELECT page_id, known AS unit, CASE WHEN beds IS NOT NULL THEN beds WHEN named IS NOT NULL THEN named WHEN waits AND NOT label THEN token END AS bedrooms FROM s),
b AS (SELECT t.page_id, t.ord, t.final, arg_min(u.token, (u.y, u.k)) AS bedrooms FROM s t JOIN s u ON u.page_id = t.page_id AND t.label AND u.token IS NOT NULL AND {_under("t", "u")} GROUP BY 1, 2, 3),
c AS (SELECT t.page_id, t.ord, arg_max(u.unit, u.k) AS unit FROM s t JOIN s u ON u.page_id = t.page_id AND t.label AND u.unit IS NOT NULL AND {_under("u", "t")} GROUP BY 1, 2)
SELECT page_id, unit, CASE WHEN bedrooms = 0 THEN 'Studio' ELSE concat(bedrooms, 'B') END AS apartment_type, bedrooms FROM (SELECT * FROM a WHERE bedrooms IS NOT NULL UNION SELECT b.page_id, coalesce(c.unit, b.final), b.bedrooms FROM b LEFT JOIN c USING (page_id, ord)) z""")
def n6_type_hits(spark, sf_dir):
    return types.type_hits(views(spark, sf_dir, "d_type_lines").withColumn("bbox", g.box(C("x"), C("y"), C("w"), C("h"))))
