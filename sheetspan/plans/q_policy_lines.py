"""Query of the places of guidelines: every document as a policy document, six lines a page, its lines that begin with A, D or S as guidelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import policy_lines as p
from .q_text import _LINES, policy_lines
from .registry import query

C = F.col
_SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def _plain(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '{_SPACE}', ' ', 'g'), '[“”\"'']', '', 'g'))"


_RECT = "concat_ws(':', {page}, CAST(x AS BIGINT), CAST(y AS BIGINT), CAST(w AS BIGINT), CAST(h AS BIGINT))"
_BOX = "min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h"


@query(rf"""WITH l AS (SELECT doc_id, line_no, text, CAST(line_no // 6 + 1 AS BIGINT) AS page, 40 + 2 * (length(text) % 5) AS x, 20 * (line_no % 6) AS y, least(6 * length(text), 500) AS w, 14 AS h FROM {_LINES} t),
a AS (SELECT *, {_plain("text")} AS a FROM l),
g AS (SELECT doc_id, line_no AS g, length(text) % 5 AS k, {_plain('''CASE length(text) % 5 WHEN 0 THEN replace(substr(text, 6, 40), 'e', 'E') WHEN 1 THEN concat(text, ' "', coalesce(after, ''), '"') ELSE array_to_string(list_reverse(string_split(text, ' ')), ' ') END''')} AS b
  FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS after FROM l) z WHERE left(text, 1) IN ('A', 'D', 'S')),
gw AS (SELECT *, list_filter(string_split(b, ' '), lambda v: length(v) > 3) AS words FROM g WHERE k < 3),
s AS (SELECT gw.doc_id, g, line_no, page, CASE WHEN a = '' OR b = '' THEN 0 WHEN contains(b, a) AND length(a) >= 16 THEN length(a) / length(b) + 0.4::DOUBLE WHEN contains(a, b) AND length(b) >= 16 THEN length(b) / length(a) + 0.35::DOUBLE
  WHEN len(words) >= 3 AND len(list_filter(words, lambda v: contains(a, v))) / len(words) >= 0.55::DOUBLE THEN len(list_filter(words, lambda v: contains(a, v))) / len(words) ELSE 0 END AS score FROM gw JOIN a USING (doc_id)),
top AS (SELECT *, first_value(page) OVER o AS tp, first_value(score) OVER o AS ts FROM s WHERE score > 0 WINDOW o AS (PARTITION BY doc_id, g ORDER BY score DESC, line_no)),
best AS (SELECT doc_id, g, line_no, n FROM (SELECT doc_id, g, line_no, row_number() OVER (PARTITION BY doc_id, g ORDER BY score DESC, line_no) AS n FROM top WHERE page = tp AND score >= ts * 0.7::DOUBLE) z WHERE n <= 4),
ids AS (SELECT doc_id, g, g + 1 AS line_no, 1 AS n FROM g WHERE k = 3 UNION ALL SELECT doc_id, g, g, 3 FROM g WHERE k = 3),
placed AS (SELECT doc_id, g, line_no, n, page, x, y, w, h FROM (SELECT * FROM best UNION ALL SELECT * FROM ids) z JOIN l USING (doc_id, line_no)),
boxes AS (SELECT doc_id, g, page, min(n) AS n, {_BOX} FROM placed GROUP BY ALL),
found AS (SELECT doc_id, g, first(page ORDER BY n) AS page, string_agg({_RECT.format(page="page")}, ' ' ORDER BY n) AS rects FROM boxes GROUP BY ALL),
names AS (SELECT doc_id, g, string_agg(concat('p', line_no), ' ' ORDER BY n) AS ids FROM placed GROUP BY ALL)
SELECT doc_id, CAST(g AS BIGINT) AS guideline_id, CASE k WHEN 0 THEN 9 ELSE found.page END AS page, CASE k WHEN 3 THEN concat('p', g + 1, ' none p', g) ELSE ids END AS line_ids,
  CASE k WHEN 4 THEN '1:250:100:500:50 2:10:20:30:40' ELSE rects END AS rects, CASE WHEN k = 4 THEN 'rects' WHEN k = 3 THEN 'ids' WHEN rects IS NULL THEN 'none' ELSE 'text' END AS source
FROM g LEFT JOIN found USING (doc_id, g) LEFT JOIN names USING (doc_id, g)""")
def j20_guideline_lines(spark, sf_dir):
    n = F.char_length("text")
    id_of = lambda c: F.concat(F.lit("p"), c.cast("string"))
    lines = policy_lines(spark, sf_dir).select(
        "doc_id", id_of(C("line_no")).alias("line_id"), C("line_no").alias("ord"), (F.floor(C("line_no") / 6) + 1).alias("page"), (40 + 2 * (n % 5)).cast("double").alias("x"), (20 * (C("line_no") % 6)).cast("double").alias("y"),
        F.least(6 * n, F.lit(500)).cast("double").alias("width"), F.lit(14.0).alias("height"), "text",
    )
    pages = lines.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(1000.0).alias("width"), F.lit(800.0).alias("height"))
    after = F.lead("text").over(Window.partitionBy("doc_id").orderBy("ord"))
    k, none = n % 5, F.lit(None)
    held = F.replace(F.substring("text", 6, 40), F.lit("e"), F.lit("E"))
    holding = F.concat("text", F.lit(' "'), F.coalesce("after", F.lit("")), F.lit('"'))
    mixed = F.array_join(F.reverse(F.split("text", " ")), " ")
    rect = lambda page, *v: F.struct(F.lit(page).cast("long").alias("page"), *(F.lit(float(x)).alias(c) for x, c in zip(v, ("x", "y", "width", "height"), strict=True)))
    guidelines = (
        lines.withColumn("after", after).where(F.substring("text", 1, 1).isin("A", "D", "S"))
        .select(
            "doc_id", C("ord").cast("long").alias("guideline_id"), F.when(k == 0, 9).cast("long").alias("page"), F.when(k == 3, F.array(id_of(C("ord") + 1), F.lit("none"), id_of(C("ord")))).alias("line_ids"),
            F.when(k == 0, held).when(k == 1, "").when(k == 2, mixed).otherwise(none).alias("source_text"), F.when(k == 1, holding).when(k == 4, "").otherwise("unused").alias("text"),
            F.when(k == 4, F.array(rect(0, 0.25, 0.125, 0.5, 0.0625), rect(2, 10, 20, 30, 40))).alias("rects"),
        )
    )
    found = p.guideline_lines(guidelines, lines, pages)
    shown = F.transform("rects", lambda r: F.concat_ws(":", *(r[c].cast("long").cast("string") for c in ("page", "x", "y", "width", "height"))))
    return found.select("doc_id", "guideline_id", "page", F.array_join("line_ids", " ").alias("line_ids"), F.array_join(shown, " ").alias("rects"), "source")
