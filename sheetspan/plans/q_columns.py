"""Queries of the column functions: each applies one to a whole table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import regions, scale
from .fixtures import entities, views
from .registry import query

C = F.col
r6 = lambda c: F.round(c, 6)
EDGE = "sqrt(w * w / 4 + h * h / 16)"
AREA = "w * h * 9 / 8"
CX, CY = "round(x + w / 2, 6)", "round((y + h / 2) * 8 / 9 + (y + h * 13 / 12) / 9, 6)"


@query("""SELECT entity_id, CASE ord % 3 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 5 END::BIGINT AS n_points,
  CASE ord % 3 WHEN 0 THEN 4 * x + 2 * w WHEN 1 THEN x ELSE 5 * x + 2.5 * w END AS sum_x FROM d_entities""")
def c1_points_of(spark, sf_dir):
    kind = F.when(C("ord") % 3 == 0, "rect").when(C("ord") % 3 == 1, "point").otherwise("polygon")
    p = g.points_of(kind, C("x"), C("y"), C("w"), C("h"), C("points"))
    df = entities(spark, sf_dir).withColumn("p", p)
    return df.select("entity_id", F.size("p").cast("long").alias("n_points"), F.aggregate("p", F.lit(0.0), lambda a, q: a + q["x"]).alias("sum_x"))


@query("""SELECT entity_id, x, y, w AS width, h * 1.25 AS height, (w + 48) * (h * 1.25 + 48) AS padded_area,
  greatest(least(x + w, 900) - greatest(x, 100), 0) * greatest(least(y + h * 1.25, 700) - greatest(y, 100), 0) AS inside FROM d_entities""")
def c2_boxes(spark, sf_dir):
    b = g.bbox_of(C("points"))
    frame = g.box(F.lit(100), F.lit(100), F.lit(800), F.lit(600))
    df = entities(spark, sf_dir).withColumn("b", b)
    return df.select("entity_id", "b.x", "b.y", "b.width", "b.height", g.box_area(g.expand(C("b"), 24)).alias("padded_area"), g.intersect_area(C("b"), frame).alias("inside"))


@query(f"SELECT page_id, type, count(*) AS regions, round(sum({AREA}), 6) AS area FROM d_entities GROUP BY page_id, type")
def c3_region_areas(spark, sf_dir):
    return entities(spark, sf_dir).groupBy("page_id", "type").agg(F.count("*").alias("regions"), r6(F.sum(g.poly_area(C("points")))).alias("area"))


@query(f"SELECT entity_id, round(w + 2 * h + 2 * {EDGE}, 6) AS perimeter, round(w + h + 2 * {EDGE}, 6) AS line, round((w + 2 * h + 2 * {EDGE}) / 2, 6) AS wall FROM d_entities")
def c4_lengths(spark, sf_dir):
    p = g.perimeter(C("points"))
    return entities(spark, sf_dir).select("entity_id", r6(p).alias("perimeter"), r6(g.polyline_length(C("points"))).alias("line"), r6(p / 2).alias("wall"))


@query(f"SELECT entity_id, {CX} AS cx, {CY} AS cy FROM d_entities")
def c5_centroids(spark, sf_dir):
    c = g.centroid(C("points"))
    return entities(spark, sf_dir).select("entity_id", c["x"].alias("cx"), c["y"].alias("cy"))


@query("SELECT entity_id, round((5 * x + 2.5 * w) / 5, 6) AS mx, round((5 * y + 3.25 * h) / 5, 6) AS my FROM d_entities")
def c6_vertex_means(spark, sf_dir):
    c = g.vertex_mean(C("points"))
    return entities(spark, sf_dir).select("entity_id", r6(c["x"]).alias("mx"), r6(c["y"]).alias("my"))


@query("""SELECT page_id, count(*) AS holding FROM d_entities
WHERE 500.3 > x AND 500.3 < x + w AND 400.7 > y AND (400.7 < y + h OR (400.7 < y + h * 1.25 AND abs(500.3 - x - w / 2) < w / 2 * (1 - (400.7 - y - h) / (h / 4)))) GROUP BY page_id""")
def c7_regions_over_point(spark, sf_dir):
    px, py = F.lit(500.3), F.lit(400.7)
    away, half = F.abs(px - C("x") - C("w") / 2), C("w") / 2 * (1 - (py - C("y") - C("h")) / (C("h") / 4))
    # A point on a slanted side is in or out by rounding alone: there the query rounds as its SQL does.
    on_side = (py >= C("y") + C("h")) & (py < C("y") + C("h") * 1.25) & (F.abs(away - half) < 1e-9)
    held = F.when(on_side, away < half).otherwise(g.point_in_poly(px, py, C("points")))
    return entities(spark, sf_dir).where(held).groupBy("page_id").agg(F.count("*").alias("holding"))


PAIR = """SELECT page_id, entity_id, x, y, w, h, lead(x) OVER p AS x2, lead(y) OVER p AS y2, lead(w) OVER p AS w2, lead(h) OVER p AS h2
FROM d_entities WINDOW p AS (PARTITION BY page_id ORDER BY ord)"""


@query(f"""WITH q AS (SELECT *, greatest(least(x + w, x2 + w2) - greatest(x, x2), 0) * greatest(least(y + h, y2 + h2) - greatest(y, y2), 0) AS i FROM ({PAIR}) z WHERE x2 IS NOT NULL)
SELECT entity_id, round(i / (w * h + w2 * h2 - i), 6) AS iou, round(i / least(w * h, w2 * h2), 6) AS ios, round(i / (w * h), 6) AS overlap FROM q""")
def c8_overlap_with_next(spark, sf_dir):
    df = entities(spark, sf_dir).withColumn("b", F.lead("bbox").over(Window.partitionBy("page_id").orderBy("ord"))).where("b IS NOT NULL")
    a, b = C("bbox"), C("b")
    return df.select("entity_id", r6(g.iou(a, b)).alias("iou"), r6(g.ios(a, b)).alias("ios"), r6(g.overlap_frac(a, b)).alias("overlap"))


def _segment(ax, ay, bx, by, px="500.3", py="400.7"):
    dx, dy = f"(({bx}) - ({ax}))", f"(({by}) - ({ay}))"
    t = f"greatest(0, least(1, (({px} - ({ax})) * {dx} + ({py} - ({ay})) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(power({px} - (({ax}) + {t} * {dx}), 2) + power({py} - (({ay}) + {t} * {dy}), 2))"


_RING = [("x", "y"), ("x + w", "y"), ("x + w", "y + h"), ("x + w / 2", "y + h + h / 4"), ("x", "y + h")]
_NEAREST = "least(" + ", ".join(_segment(*_RING[i], *_RING[(i + 1) % 5]) for i in range(5)) + ")"
_HOLDS = "500.3 > x AND 500.3 < x + w AND 400.7 > y AND (400.7 < y + h OR (400.7 < y + h * 1.25 AND abs(500.3 - x - w / 2) < w / 2 * (1 - (400.7 - y - h) / (h / 4))))"


@query(f"SELECT entity_id, round(CASE WHEN {_HOLDS} THEN 0 ELSE {_NEAREST} END, 5) AS distance FROM d_entities")
def c9_distance_to_point(spark, sf_dir):
    return entities(spark, sf_dir).select("entity_id", F.round(g.dist_to_ring(F.lit(500.3), F.lit(400.7), C("points")), 5).alias("distance"))


@query(f"""SELECT entity_id, round(greatest(w, h, {EDGE}), 6) AS length,
  round(CASE WHEN w >= h AND w >= {EDGE} THEN x + w / 2 WHEN h >= {EDGE} THEN x + w ELSE x + w * 3 / 4 END, 6) AS mx,
  round(CASE WHEN w >= h AND w >= {EDGE} THEN y WHEN h >= {EDGE} THEN y + h / 2 ELSE y + h + h / 8 END, 6) AS my FROM d_entities""")
def c10_long_edges(spark, sf_dir):
    df = entities(spark, sf_dir).withColumn("e", g.long_edge(C("points")))
    return df.select("entity_id", r6(C("e.length")).alias("length"), r6(C("e.mx")).alias("mx"), r6(C("e.my")).alias("my"))


_CARDINAL = "['N','NE','E','SE','S','SW','W','NW'][CAST(floor({0} / 45 + 0.5) AS BIGINT) % 8 + 1]"


@query(f"""WITH e AS (SELECT entity_id, page_id, x, y, w, h, CASE WHEN w >= h THEN 0 ELSE 1 END AS side FROM d_entities WHERE type = 'window'),
f AS (SELECT entity_id, page_id, CAST(CASE WHEN side = 0 THEN CASE WHEN y < 550 THEN 270 ELSE 90 END ELSE CASE WHEN x + w > 650 THEN 0 ELSE 180 END END AS DOUBLE) AS face FROM e),
b AS (SELECT entity_id, face, CAST((page_id * 7 % 360 - face + 360) % 360 AS DOUBLE) AS bearing FROM f)
SELECT entity_id, face, bearing, {_CARDINAL.format("bearing")} AS side FROM b""")
def c11_window_bearings(spark, sf_dir):
    rect = g.rect_points(C("x"), C("y"), C("w"), C("h"))
    df = entities(spark, sf_dir).where("type = 'window'").withColumn("e", g.long_edge(rect))
    df = df.withColumn("n", g.outward_normal(C("e"), F.lit(650.0), F.lit(550.0))).withColumn("face", r6(g.heading_deg(C("n.x"), C("n.y"))))
    df = df.withColumn("bearing", g.bearing_from_north((C("page_id") * 7 % 360).cast("double"), C("face")))
    return df.select("entity_id", "face", "bearing", g.cardinal(C("bearing")).alias("side"))


@query("""WITH a AS (SELECT entity_id, CAST(entity_id % 360 AS DOUBLE) AS a, CAST(entity_id * 7 % 360 AS DOUBLE) AS b FROM d_entities), d AS (SELECT *, abs((a - b + 540) % 360 - 180) AS delta FROM a)
SELECT entity_id, delta, abs(delta - 90) <= 30 OR abs(delta - 180) <= 30 AS two_sides FROM d""")
def c12_angle_deltas(spark, sf_dir):
    a, b = (C("entity_id") % 360).cast("double"), (C("entity_id") * 7 % 360).cast("double")
    return entities(spark, sf_dir).select("entity_id", g.angle_delta(a, b).alias("delta"), g.opposite_or_perpendicular(a, b).alias("two_sides"))


@query("SELECT entity_id, CASE WHEN ord % 2 = 0 THEN least(w, h) ELSE least(w, h * 1.25) END AS span FROM d_entities WHERE type IN ('door', 'window')")
def c13_opening_spans(spark, sf_dir):
    p = F.when(C("ord") % 2 == 0, g.rect_points(C("x"), C("y"), C("w"), C("h"))).otherwise(C("points"))
    return entities(spark, sf_dir).where("type IN ('door', 'window')").select("entity_id", g.opening_span(p).alias("span"))


@query(f"SELECT entity_id, round({AREA} / greatest(w, h, {EDGE}), 6) AS thickness, least(w, h * 1.25) AS width FROM d_entities WHERE type = 'wall'")
def c14_wall_widths(spark, sf_dir):
    return entities(spark, sf_dir).where("type = 'wall'").select("entity_id", r6(g.wall_thickness(C("points"))).alias("thickness"), g.min_width(C("points")).alias("width"))


@query("""SELECT entity_id, CASE page_id % 4 WHEN 0 THEN x WHEN 1 THEN 1100 - y WHEN 2 THEN 1300 - x ELSE y END AS x0,
  CASE page_id % 4 WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 1100 - y ELSE 1300 - x END AS y0, (x + 5) * 2 AS xs, (y - 5) * 3 AS ys FROM d_entities""")
def c15_moved_points(spark, sf_dir):
    turned = g.rotate90(C("points"), F.lit(1300.0), F.lit(1100.0), C("page_id") % 4 * 90)
    moved = g.scale(g.shift(C("points"), F.lit(5.0), F.lit(-5.0)), F.lit(2.0), F.lit(3.0))
    return entities(spark, sf_dir).select("entity_id", turned[0]["x"].alias("x0"), turned[0]["y"].alias("y0"), moved[0]["x"].alias("xs"), moved[0]["y"].alias("ys"))


@query("""WITH u AS (SELECT entity_id, x, y, w, h, greatest(0, least(1, x / 700)) AS x0, greatest(0, least(1, y / 600)) AS y0, greatest(0, least(1, (x + w) / 700)) AS x1, greatest(0, least(1, (y + h) / 600)) AS y1 FROM d_entities)
SELECT entity_id, CASE WHEN x1 > x0 AND y1 > y0 THEN round((x0 + x1) / 2, 6) END AS cx, CASE WHEN x1 > x0 AND y1 > y0 THEN round(y1 - y0, 6) END AS height,
  10::BIGINT AS n_coords, CASE WHEN x1 > x0 AND y1 > y0 THEN round(x0 * 700, 4) END AS back FROM u""")
def c16_unit_coordinates(spark, sf_dir):
    w, h = F.lit(700.0), F.lit(600.0)
    df = entities(spark, sf_dir).withColumn("u", g.to_unit_box(C("bbox"), w, h)).withColumn("p", g.to_unit_poly(C("points"), w, h))
    return df.select("entity_id", r6(C("u")[0]).alias("cx"), r6(C("u")[3]).alias("height"), F.size("p").cast("long").alias("n_coords"), F.round(g.from_unit(C("u"), w, h)["x"], 4).alias("back"))


@query("""WITH p AS (SELECT entity_id, x + w / 2 AS cx, y + h / 2 AS cy, greatest(w + 0.2 * greatest(w, h), h + 0.2 * greatest(w, h), 16) AS s, x, y, w, h FROM d_entities)
SELECT entity_id, greatest(floor(cx - s / 2), 0) AS x0, greatest(floor(cy - s / 2), 0) AS y0, least(ceil(cx + s / 2), 1300) AS x1, least(ceil(cy + s / 2), 1100) AS y1,
  CASE WHEN least(x + w, 900) - x >= 16 AND least(y + h, 700) - y >= 16 THEN least(x + w, 900) - x END AS cut FROM p""")
def c17_crops(spark, sf_dir):
    df = entities(spark, sf_dir).withColumn("c", g.padded_crop(C("bbox"), F.lit(1300.0), F.lit(1100.0), square=True)).withColumn("k", g.clamp_crop(C("bbox"), F.lit(900.0), F.lit(700.0)))
    return df.select("entity_id", "c.x", "c.y", g.right(C("c")).alias("x1"), g.bottom(C("c")).alias("y1"), C("k.width").alias("cut")).toDF("entity_id", "x0", "y0", "x1", "y1", "cut")


@query(f"""SELECT e.entity_id, round({AREA} / (ppm * ppm), 6) AS area_m2, round(w / ppm, 6) AS width_m FROM d_entities e JOIN d_pages p USING (page_id)""")
def c19_metric_sizes(spark, sf_dir):
    df = entities(spark, sf_dir).join(views(spark, sf_dir, "d_pages").select("page_id", "ppm"), "page_id")
    return df.select("entity_id", r6(g.area_m2(g.poly_area(C("points")), C("ppm"))).alias("area_m2"), r6(g.len_m(C("w"), C("ppm"))).alias("width_m"))


_PAPER = "(VALUES ('A0', 841, 1189), ('A1', 594, 841), ('A2', 420, 594), ('A3', 297, 420), ('A4', 210, 297)) p(paper, a, b)"


@query(f"""WITH q AS (SELECT page_id, width_px, height_px, ['A0','A1','A2','A3','A4'][page_id % 5 + 1] AS paper, [50, 100, 200][page_id % 3 + 1] AS ratio FROM d_pages)
SELECT page_id, round(width_px / (b / 1000.0 * ratio), 6) AS ppm, round(ratio * power(2, (3 - CAST(paper[2:2] AS INT)) / 2.0), 6) AS on_a3, round((width_px / (b / 25.4) + height_px / (a / 25.4)) / 2, 6) AS dpi
FROM q JOIN {_PAPER} USING (paper)""")
def c20_page_scales(spark, sf_dir):
    df = views(spark, sf_dir, "d_pages").withColumn("paper", F.concat(F.lit("A"), (C("page_id") % 5).cast("string")))
    df = df.withColumn("ratio", F.element_at(F.array(F.lit(50.0), F.lit(100.0), F.lit(200.0)), (C("page_id") % 3 + 1).cast("int")))
    w, h = C("width_px"), C("height_px")
    long, short = scale._paper(C("paper"), 1), scale._paper(C("paper"), 0)
    return df.select("page_id", r6(scale.ppm_from_scale(C("ratio"), C("paper"), w, h)).alias("ppm"), r6(scale.effective_scale(C("ratio"), C("paper"), F.lit("A3"))).alias("on_a3"), r6(scale.dpi_of(w, h, long, short)).alias("dpi"))


@query("SELECT entity_id, round(sqrt(w * w + h * h) / (1 + entity_id % 9), 6) AS ppm FROM d_entities")
def c21_two_point_scales(spark, sf_dir):
    return entities(spark, sf_dir).select("entity_id", r6(g.two_point_ppm(C("x"), C("y"), C("x") + C("w"), C("y") + C("h"), 1 + C("entity_id") % 9)).alias("ppm"))


_P, _W = f"(w + 2 * h + 2 * {EDGE})", "(x + w / 2) / 1300"


@query(f"""SELECT entity_id, round({AREA} / 1430000, 8) AS a, round(greatest(w, h) / greatest(least(w, h), 1), 6) AS s, round(least(1.5, 4 * pi() * {AREA} / ({_P} * {_P})), 6) AS c,
  round(least({_W}, (y + h / 2) / 1100, 1 - {_W}, 1 - (y + h / 2) / 1100), 6) AS e FROM d_entities""")
def c23_region_features(spark, sf_dir):
    f = regions.region_features(C("bbox"), g.poly_area(C("points")), g.perimeter(C("points")), F.lit(1300.0), F.lit(1100.0))
    df = entities(spark, sf_dir).withColumn("f", f)
    return df.select("entity_id", F.round("f.area_frac", 8).alias("a"), r6(C("f.aspect")).alias("s"), r6(C("f.compactness")).alias("c"), r6(C("f.edge_dist")).alias("e"))


@query("""SELECT page_id, CASE WHEN vector_ops = 0 AND image_ops = 0 AND text_ops = 0 THEN 'unknown' WHEN image_ops > 0 AND vector_ops < 20 THEN 'raster'
  WHEN image_ops > 0 THEN 'hybrid' ELSE 'vector' END AS kind FROM d_pages""")
def c24_graphics_kinds(spark, sf_dir):
    return views(spark, sf_dir, "d_pages").select("page_id", scale.graphics_kind(C("vector_ops"), C("image_ops"), C("text_ops")).alias("kind"))


_SCORED = {
    "Unit": "3.4 * 12 * a + 1.2 * c + 1.6 * e + CASE WHEN a >= 0.1 AND e > 0.07 THEN 4.5 ELSE 0 END - CASE WHEN a < 0.007 THEN 4 ELSE 0 END",
    "Open Living": "2.8 * 18 * a + 1.4 * c + CASE WHEN a >= 0.045 AND e > 0.08 THEN 2.2 ELSE 0 END - CASE WHEN a < 0.007 THEN 3 ELSE 0 END",
    "Bedroom": "2.2 * 40 * (0.08 - abs(a - 0.035)) + 1.1 * c",
    "Bathroom": "2.4 * 50 * (0.025 - abs(a - 0.012)) + 0.8 * (2.2 - s)",
    "Ensuite": "2 * 45 * (0.02 - abs(a - 0.01))",
    "Laundry": "1.6 * 40 * (0.02 - abs(a - 0.014)) + 0.6 * greatest(0, s - 1.4)",
    "Closet": "2.6 * 80 * (0.012 - a) + 0.4 * s + CASE WHEN a < 0.007 THEN 3.5 ELSE 0 END + CASE WHEN d > 0.18 THEN 0.6 ELSE 0 END",
    "Store": "1.8 * 50 * (0.015 - a) + CASE WHEN d > 0.18 THEN 0.4 ELSE 0 END",
    "Balcony": "3.8 * 12 * (0.09 - e) + 1.2 * 30 * (0.05 - abs(a - 0.02)) + CASE WHEN e < 0.055 AND a < 0.09 THEN 5 ELSE 0 END",
    "Lobby": "1.2 * 20 * (0.04 - abs(a - 0.03)) + 0.5 * (1 - y)",
    "Communal Space": "1.4 * 10 * a + 0.8 * (1 - c)",
}
_Z, _N = ", ".join(f"({sql}) AS z{i}" for i, sql in enumerate(_SCORED.values())), len(_SCORED)


@query(f"""WITH f AS (SELECT entity_id, {AREA} / 1430000 AS a, greatest(w, h) / greatest(least(w, h), 1) AS s, least(1.5, 4 * pi() * {AREA} / ({_P} * {_P})) AS c,
  least({_W}, (y + h / 2) / 1100, 1 - {_W}, 1 - (y + h / 2) / 1100) AS e, (y + h / 2) / 1100 AS y, 1 - confidence AS d FROM d_entities WHERE type = 'room'),
z AS (SELECT entity_id, {_Z} FROM f), m AS (SELECT *, greatest({", ".join(f"z{i}" for i in range(_N))}) AS top FROM z)
SELECT entity_id, CASE {" ".join(f"WHEN z{i} = top THEN '{n}'" for i, n in enumerate(_SCORED))} END AS label, round(1 / ({" + ".join(f"exp(z{i} - top)" for i in range(_N))}), 5) AS confidence FROM m""")
def z3_classify_regions(spark, sf_dir):
    df = entities(spark, sf_dir).where("type = 'room'")
    df = regions.classified(df, C("bbox"), g.poly_area(C("points")), g.perimeter(C("points")), F.lit(1300.0), F.lit(1100.0), 1 - C("confidence"))
    return df.select("entity_id", "found.label", F.round("found.confidence", 5).alias("confidence"))
