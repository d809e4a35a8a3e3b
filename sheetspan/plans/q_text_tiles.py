"""Queries of text read in overlapping tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import text_tiles
from ..workspace import stage
from .fixtures import views
from .q_graph import _closure
from .registry import query

C = F.col


def _row(a: str, b: str) -> str:
    return f"""(greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0) >= 0.4 * greatest(least({a}.h, {b}.h), 1) AND abs({a}.y + {a}.h / 2 - {b}.y - {b}.h / 2) <= 0.65 * greatest(({a}.h + {b}.h) / 2, 1))"""


def _both(a: str, b: str) -> str:
    return f"(greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0) * greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0))"


def _covers(a: str, b: str) -> str:
    return f"{_both(a, b)} / least(greatest({a}.w * {a}.h, 1), greatest({b}.w * {b}.h, 1))"


def _rep(a: str, b: str) -> str:
    return f"""({a}.key <> '' AND {a}.key = {b}.key AND ({_covers(a, b)} >= 0.22 OR sqrt(({a}.x + {a}.w / 2 - {b}.x - {b}.w / 2) ^ 2 + ({a}.y + {a}.h / 2 - {b}.y - {b}.h / 2) ^ 2) <= greatest(18, 0.45 * greatest({a}.w, {b}.w), 0.9 * greatest({a}.h, {b}.h))))"""


def _held(a: str, b: str) -> str:
    return f"(contains({a}.plain, {b}.plain) OR contains({b}.plain, {a}.plain))"


def _same(a: str, b: str) -> str:
    iou = f"{_both(a, b)} / (greatest({a}.w * {a}.h, 1) + greatest({b}.w * {b}.h, 1) - {_both(a, b)})"
    return f"({_row(a, b)} AND ({_covers(a, b)} >= 0.55 OR {iou} >= 0.4 OR ({_held(a, b)} AND ({_rep(a, b)} OR {_covers(a, b)} >= 0.28))))"


def _letter(a: str, b: str) -> str:
    return "greatest(4, " + ", ".join(f"greatest({s}.w, 1) / greatest(length(replace({s}.plain, ' ', '')), 1)" for s in (a, b)) + ")"


def _any_cut(a: str, b: str) -> str:
    return f"({a}.cl OR {a}.cr OR {b}.cl OR {b}.cr)"


def _shared(a: str, b: str) -> str:
    least = f"CASE WHEN {_any_cut(a, b)} THEN 2 ELSE 3 END"
    return f"list_max(list_filter(range({least}, least(length({a}.text), length({b}.text)) + 1), lambda k: right(lower({a}.text), k) = left(lower({b}.text), k)))"


def _next(a: str, b: str) -> str:
    gap = f"({b}.x - {a}.x - {a}.w)"
    return f"""({gap} BETWEEN -1.2 * {_letter(a, b)} AND 2.4 * {_letter(a, b)} AND {a}.plain <> {b}.plain AND CASE WHEN {_shared(a, b)} IS NOT NULL THEN {a}.cr OR {b}.cl OR {gap} <= 1.2 * {_letter(a, b)}
    WHEN {_held(a, b)} THEN true ELSE {_any_cut(a, b)} AND {gap} <= 1.15 * {_letter(a, b)} END)"""


_LINES = r"""tl AS (SELECT page_id, line_id, confidence, x, y, w, h, cut_left AS cl, cut_right AS cr, trim(text) AS text, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS plain, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS key FROM d_tile_lines WHERE trim(text) <> '')"""
_PAIRS = f"""tp AS (SELECT a.page_id, a.line_id AS a, b.line_id AS b FROM tl a JOIN tl b ON a.page_id = b.page_id AND a.line_id < b.line_id
  WHERE abs(a.y - b.y) < 400 AND ({_same("a", "b")} OR {_rep("a", "b")} OR ({_row("a", "b")} AND NOT {_same("a", "b")} AND CASE WHEN a.x <= b.x THEN {_next("a", "b")} ELSE {_next("b", "a")} END)))"""


def _readings(spark, sf_dir):
    cuts = F.array_compact(F.array(F.when(C("cut_left"), "left"), F.when(C("cut_right"), "right")))
    return views(spark, sf_dir, "d_tile_lines").select("page_id", "line_id", "text", "confidence", g.box(C("x"), C("y"), C("w"), C("h")).alias("bbox"), cuts.alias("cuts"))


@query(f"WITH {_LINES}, {_PAIRS} SELECT * FROM tp")
def j26_text_matches(spark, sf_dir):
    return text_tiles.text_matches(_readings(spark, sf_dir))


_BETTER = """CASE WHEN s.key <> '' AND m.key <> '' AND s.key = m.key AND length(s.text) - length(s.key) <> length(m.text) - length(m.key) THEN length(s.text) - length(s.key) < length(m.text) - length(m.key)
  WHEN s.key <> '' AND m.key <> '' AND s.key <> m.key AND contains(m.key, s.key) THEN false WHEN s.key <> '' AND m.key <> '' AND s.key <> m.key AND contains(s.key, m.key) THEN true
  WHEN (s.cl OR s.cr) <> (m.cl OR m.cr) THEN NOT (s.cl OR s.cr) WHEN abs(length(s.key) - length(m.key)) >= 2 THEN length(s.key) > length(m.key)
  WHEN s.confidence <> m.confidence THEN s.confidence > m.confidence ELSE length(s.text) >= length(m.text) END"""
_LONGER = "CASE WHEN length(s.text) >= length(m.text) THEN s.text ELSE m.text END"
_TEXT = f"""CASE WHEN {_same("s", "m")} OR {_rep("s", "m")} THEN CASE WHEN {_BETTER} THEN s.text ELSE m.text END WHEN s.plain = m.plain THEN {_LONGER} WHEN contains(m.plain, s.plain) THEN m.text WHEN contains(s.plain, m.plain) THEN s.text
  WHEN {_shared("s", "m")} IS NOT NULL THEN concat(s.text, substr(m.text, CAST({_shared("s", "m")} AS INT) + 1)) WHEN m.x - s.x - s.w > 1.2 * {_letter("s", "m")} THEN {_LONGER}
  WHEN right(s.text, 1) = '-' THEN concat(left(s.text, length(s.text) - 1), m.text) WHEN right(s.text, 1) IN (':', '/') OR (lower(right(s.text, 1)) <> upper(right(s.text, 1)) AND lower(left(m.text, 1)) <> upper(left(m.text, 1))) THEN concat(s.text, m.text)
  ELSE concat(s.text, ' ', m.text) END"""


@query(rf"""WITH {_LINES}, {_PAIRS}, nd AS (SELECT line_id AS n FROM tl), {_closure("nd", "tp")},
ms AS (SELECT tl.*, component, row_number() OVER (PARTITION BY component ORDER BY x, line_id) AS i, count(*) OVER (PARTITION BY component) AS parts FROM tl JOIN low ON low.node = tl.line_id),
f AS (SELECT component, page_id, parts, i, text, plain, key, confidence, x, y, w, h, cl, cr FROM ms WHERE i = 1
  UNION ALL SELECT component, page_id, parts, i, text, trim(regexp_replace(lower(text), '\s+', ' ', 'g')), regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), confidence, x, y, w, h, false, false
  FROM (SELECT s.component, s.page_id, s.parts, m.i, {_TEXT} AS text, greatest(s.confidence, m.confidence) AS confidence, least(s.x, m.x) AS x, least(s.y, m.y) AS y,
    greatest(s.x + s.w, m.x + m.w) - least(s.x, m.x) AS w, greatest(s.y + s.h, m.y + m.h) - least(s.y, m.y) AS h FROM f s JOIN ms m ON m.component = s.component AND m.i = s.i + 1) z)
SELECT page_id, component AS line_id, text, round(confidence, 6) AS confidence, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, parts FROM f WHERE i = parts""")
def h5_merged_text(spark, sf_dir):
    lines = stage(_readings(spark, sf_dir), "readings")
    found = text_tiles.merge_text(lines, text_tiles.text_matches(lines))
    r = lambda c, name: F.round(C(c), 6).alias(name)
    return found.select("page_id", "line_id", "text", r("confidence", "confidence"), r("bbox.x", "x"), r("bbox.y", "y"), r("bbox.width", "w"), r("bbox.height", "h"), "parts")
