"""Query of the rows of text on a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text_rows as op
from .fixtures import views
from .registry import query


@query(r"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, ord) AS i FROM (SELECT page_id, ord, text, x, y, w, CAST(8 + ord % 5 * 4 AS DOUBLE) AS h FROM d_ocr_lines) z),
s AS (SELECT page_id, i, 1 AS row, y + h / 2 AS mid, h AS tall FROM p WHERE i = 1
  UNION ALL SELECT p.page_id, p.i, CASE WHEN abs(y + h / 2 - mid) <= greatest(h, tall, 8) * 0.6 THEN row ELSE row + 1 END, CASE WHEN abs(y + h / 2 - mid) <= greatest(h, tall, 8) * 0.6 THEN mid ELSE y + h / 2 END,
    CASE WHEN abs(y + h / 2 - mid) <= greatest(h, tall, 8) * 0.6 THEN tall ELSE h END FROM s JOIN p ON p.page_id = s.page_id AND p.i = s.i + 1)
SELECT p.page_id, s.row, string_agg(text, ' ' ORDER BY x, y, ord) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM p JOIN s ON s.page_id = p.page_id AND s.i = p.i GROUP BY 1, 2""")
def n4_text_rows(spark, sf_dir):
    return op.text_rows(views(spark, sf_dir, "d_ocr_lines").withColumn("h", (8 + F.col("ord") % 5 * 4).cast("double")))
