"""Query of key points in three encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import keypoints
from .fixtures import views
from .registry import query

C = F.col


@query("""WITH e AS (SELECT entity_id, x, y, w, h, confidence AS c, length(label) % 3 AS k, label LIKE '%Room%' AS odd FROM d_entities WHERE type IN ('fixture', 'wall', 'door'))
SELECT entity_id, 'tip' AS role, x, y, CASE WHEN k = 0 THEN 'occluded' ELSE 'visible' END AS visibility, CASE k WHEN 0 THEN round(c, 4) WHEN 1 THEN round(c, 4) END AS confidence FROM e
UNION ALL SELECT entity_id, 'base', x + w, y + h, CASE WHEN k = 2 THEN 'not_labeled' ELSE 'visible' END, CASE k WHEN 1 THEN 0.5 END FROM e""")
def s7_north_keypoints(spark, sf_dir):
    df = views(spark, sf_dir, "d_entities").where("type IN ('fixture', 'wall', 'door')")
    x, y, c = C("x").cast("string"), C("y").cast("string"), F.round("confidence", 4).cast("string")
    right, low = (C("x") + C("w")).cast("string"), (C("y") + C("h")).cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    named = text('{"Tip": {"x": ', x, ', "y": ', y, ', "occluded": true, "confidence": ', c, '}, "the-tail": {"cx": ', right, ', "cy": ', low, '}}')
    listed = text('[{"x": ', x, ', "y": 0, "name": "tip", "score": 0.0}, {"x": ', x, ', "y": ', y, ', "class": "arrow_head", "conf": ', c, '}, {"x": ', right, ', "y": ', low, ', "label": "BASE", "v": 2, "confidence": 50}]')
    flat = text("[", right, ", ", low, ", 0, ", x, ", ", y, ", 2]")
    kind = F.char_length("label") % 3
    rows = df.select("entity_id", F.when(kind == 0, named).when(kind == 1, listed).otherwise(flat).alias("keypoints"), F.lit(None).cast("array<string>").alias("names"))
    return keypoints.read_keypoints(rows).withColumn("confidence", F.round("confidence", 4))
