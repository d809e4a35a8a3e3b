"""Column expressions over plan geometry in page pixels (y grows downward).

``points`` is array<struct<x:double,y:double>>, ``box`` struct<x,y,width,height>.  Null geometry
gives null; each function says what it does with too few points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def rect_points(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def points_of(kind: Column, x: Column, y: Column, w: Column, h: Column, points: Column) -> Column:
    """A rectangle as its corners, clockwise from the top left; a point as itself; else the points."""
    return F.when(kind == "rect", rect_points(x, y, w, h)).when(kind == "point", F.array(point(x, y))).otherwise(points)


def _next(points: Column) -> Column:
    return F.concat(F.slice(points, 2, F.greatest(F.size(points), F.lit(1))), F.slice(points, 1, 1))


def edges(points: Column, closed: bool = True) -> Column:
    """array<struct<a,b>> of consecutive points, with the edge back to the first if closed."""
    ring = F.zip_with(points, _next(points), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return ring if closed else F.slice(ring, 1, F.greatest(F.size(points) - 1, F.lit(0)))


def _length(e: Column) -> Column:
    return F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """What ``then`` makes of a value that is worked out once a row, however often ``then``, or a join on the result's fields, names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def bbox_of(points: Column) -> Column:
    """Smallest box around the points; all zero when there are none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def ends(p: Column) -> Column:
        xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
        return F.struct(*(zero(of(side)).alias(name) for name, of, side in (("x", F.array_min, xs), ("y", F.array_min, ys), ("right", F.array_max, xs), ("bottom", F.array_max, ys))))

    return _let(_let(points, ends), lambda s: box(s["x"], s["y"], s["right"] - s["x"], s["bottom"] - s["y"]))


def expand(b: Column, pad) -> Column:
    pad = pad if isinstance(pad, Column) else F.lit(float(pad))
    return box(b["x"] - pad, b["y"] - pad, b["width"] + 2 * pad, b["height"] + 2 * pad)


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def box_area(b: Column) -> Column:
    return F.greatest(b["width"], F.lit(0.0)) * F.greatest(b["height"], F.lit(0.0))


def intersect_area(a: Column, b: Column) -> Column:
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def boxes_touch(a: Column, b: Column) -> Column:
    """Overlap or shared border."""
    return (right(a) >= b["x"]) & (right(b) >= a["x"]) & (bottom(a) >= b["y"]) & (bottom(b) >= a["y"])


def boxes_overlap(a: Column, b: Column) -> Column:
    """Overlap of more than a border."""
    return (right(a) > b["x"]) & (right(b) > a["x"]) & (bottom(a) > b["y"]) & (bottom(b) > a["y"])


def in_box(px: Column, py: Column, b: Column) -> Column:
    return (px >= b["x"]) & (px <= right(b)) & (py >= b["y"]) & (py <= bottom(b))


def poly_area(points: Column) -> Column:
    """Shoelace area; 0 under three points."""
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(_total(F.transform(edges(points), _cross))) / 2)


def perimeter(points: Column) -> Column:
    return _total(F.transform(edges(points), _length))


def polyline_length(points: Column) -> Column:
    return _total(F.transform(edges(points, closed=False), _length))


def centroid(points: Column) -> Column:
    """Area-weighted centre, or the box centre under three points or without area.  Rounded to a
    millionth of a pixel, so that a comparison does not hang on the last bit."""
    def moment(ring: Column, k: str) -> Column:
        return _total(F.transform(ring, lambda e: (e["a"][k] + e["b"][k]) * _cross(e)))

    def of(p: Column, ring: Column, double: Column) -> Column:
        real = (F.size(p) >= 3) & (F.abs(double) / 2 > EPS)
        middle = _let(bbox_of(p), lambda b: point(F.round(b["x"] + b["width"] / 2, 6), F.round(b["y"] + b["height"] / 2, 6)))
        return F.when(real, point(F.round(moment(ring, "x") / (3 * double), 6), F.round(moment(ring, "y") / (3 * double), 6))).otherwise(middle)

    return _let(points, lambda p: _let(edges(p), lambda ring: _let(_total(F.transform(ring, _cross)), lambda double: of(p, ring, double))))


def vertex_mean(points: Column) -> Column:
    n = F.size(points)
    mean = lambda f: F.when(n > 0, _total(F.transform(points, f)) / n).otherwise(0.0)
    return point(mean(lambda p: p["x"]), mean(lambda p: p["y"]))


def point_in_poly(px: Column, py: Column, points: Column) -> Column:
    """Even-odd test; false under three points."""
    def crosses(e):
        a, b = e["a"], e["b"]
        dy = F.when(b["y"] == a["y"], 1e-12).otherwise(b["y"] - a["y"])
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / dy + a["x"])

    odd = F.aggregate(F.transform(edges(points), crosses), F.lit(False), lambda acc, c: acc != c)
    return F.when(F.size(points) < 3, False).otherwise(odd)


def iou(a: Column, b: Column) -> Column:
    both = intersect_area(a, b)
    union = box_area(a) + box_area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def ios(a: Column, b: Column) -> Column:
    return intersect_area(a, b) / F.greatest(F.least(box_area(a), box_area(b)), F.lit(EPS))


def overlap_frac(a: Column, b: Column) -> Column:
    """Intersection over the first box; 0 if it has no area."""
    return F.when(box_area(a) > 0, intersect_area(a, b) / box_area(a)).otherwise(0.0)


def segment_distance(px: Column, py: Column, e: Column) -> Column:
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, ((px - e["a"]["x"]) * dx + (py - e["a"]["y"]) * dy) / square).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (e["a"]["x"] + t * dx), py - (e["a"]["y"] + t * dy))


def dist_to_ring(px: Column, py: Column, points: Column) -> Column:
    """0 inside, else the least distance to a closed edge."""
    return F.when(point_in_poly(px, py, points), 0.0).otherwise(F.array_min(F.transform(edges(points), lambda e: segment_distance(px, py, e))))


def min_ring_distance(a: Column, b: Column) -> Column:
    """Least distance from a vertex of either ring to the other."""
    one = F.array_min(F.transform(a, lambda p: dist_to_ring(p["x"], p["y"], b)))
    two = F.array_min(F.transform(b, lambda p: dist_to_ring(p["x"], p["y"], a)))
    return F.least(one, two)


def long_edge(points: Column) -> Column:
    """The longest edge (the first on ties): ax, ay, bx, by, length, mx, my; null without length.
    Two points are an open line."""
    own = F.when(F.size(points) >= 3, edges(points)).otherwise(edges(points, closed=False))
    def as_row(e):
        return F.struct(
            e["a"]["x"].alias("ax"), e["a"]["y"].alias("ay"), e["b"]["x"].alias("bx"), e["b"]["y"].alias("by"), _length(e).alias("length"),
            ((e["a"]["x"] + e["b"]["x"]) / 2).alias("mx"), ((e["a"]["y"] + e["b"]["y"]) / 2).alias("my"),
        )

    rows = F.transform(own, as_row)
    most = F.array_max(F.transform(rows, lambda r: r["length"]))
    return F.when(most > EPS, F.element_at(F.filter(rows, lambda r: r["length"] == most), 1))


def heading_deg(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dy, dx)) + 360.0, F.lit(360.0))


def bearing_from_north(north: Column, face: Column) -> Column:
    return F.pmod(north - face + 360.0, F.lit(360.0))


def cardinal(bearing: Column) -> Column:
    names = F.array(*(F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    return F.element_at(names, (F.pmod(F.floor(bearing / 45.0 + 0.5), F.lit(8)) + 1).cast("int"))


def outward_normal(edge: Column, cx: Column, cy: Column) -> Column:
    """Unit normal of a long edge that points away from (cx, cy)."""
    nx, ny = -(edge["by"] - edge["ay"]) / edge["length"], (edge["bx"] - edge["ax"]) / edge["length"]
    flip = F.when(nx * (edge["mx"] - cx) + ny * (edge["my"] - cy) < 0, -1.0).otherwise(1.0)
    return point(nx * flip, ny * flip)


def angle_delta(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 540.0, F.lit(360.0)) - 180.0)


def opposite_or_perpendicular(a: Column, b: Column, tolerance: float = 30.0) -> Column:
    d = angle_delta(a, b)
    return (F.abs(d - 90.0) <= tolerance) | (F.abs(d - 180.0) <= tolerance)


def opening_span(points: Column) -> Column:
    """Four distinct corners: the shortest edge; else the shorter box side, or the one that is not 0."""
    b = bbox_of(points)
    side = F.when(b["width"] <= 0, b["height"]).when(b["height"] <= 0, b["width"]).otherwise(F.least(b["width"], b["height"]))
    distinct = F.array_distinct(points)
    return F.when(F.size(distinct) == 4, F.array_min(F.transform(edges(distinct), _length))).otherwise(side)


def wall_thickness(points: Column) -> Column:
    """Area over the longest edge; 0 under four points."""
    return F.when(F.size(points) < 4, 0.0).otherwise(F.coalesce(poly_area(points) / F.nullif(long_edge(points)["length"], F.lit(0.0)), F.lit(0.0)))


def min_width(points: Column) -> Column:
    b = bbox_of(points)
    return F.least(b["width"], b["height"])


def shift(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: point(p["x"] + dx, p["y"] + dy))


def scale(points: Column, sx: Column, sy: Column) -> Column:
    return F.transform(points, lambda p: point(p["x"] * sx, p["y"] * sy))


def rotate90(points: Column, width: Column, height: Column, degrees: Column) -> Column:
    """Clockwise quarter turns of a width x height page; other angles leave the points."""
    turn = F.pmod(degrees, F.lit(360))
    return F.transform(
        points,
        lambda p: F.when(turn == 90, point(height - p["y"], p["x"]))
        .when(turn == 180, point(width - p["x"], height - p["y"]))
        .when(turn == 270, point(p["y"], width - p["x"]))
        .otherwise(p),
    )


def _unit(v: Column, side: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / side))


def to_unit_box(b: Column, width: Column, height: Column) -> Column:
    """(cx, cy, w, h) as parts of the page after clamping; null without extent."""
    x0, y0, x1, y1 = _unit(b["x"], width), _unit(b["y"], height), _unit(right(b), width), _unit(bottom(b), height)
    return F.when((x1 > x0) & (y1 > y0), F.array((x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0))


def to_unit_poly(points: Column, width: Column, height: Column) -> Column:
    flat = F.flatten(F.transform(points, lambda p: F.array(_unit(p["x"], width), _unit(p["y"], height))))
    return F.when(F.size(points) >= 3, flat)


def from_unit(coords: Column, width: Column, height: Column) -> Column:
    """(cx, cy, w, h) parts back to a pixel box."""
    w, h = coords[2] * width, coords[3] * height
    return box(coords[0] * width - w / 2, coords[1] * height - h / 2, w, h)


def padded_crop(b: Column, width: Column, height: Column, frac: float = 0.1, least: float = 16.0, square: bool = False) -> Column:
    """A box padded by ``frac`` of its longer side (to at least ``least`` pixels), optionally
    squared about its centre, with whole-pixel borders inside the page."""
    pad = F.greatest(b["width"], b["height"]) * frac
    w, h = F.greatest(b["width"] + 2 * pad, F.lit(least)), F.greatest(b["height"] + 2 * pad, F.lit(least))
    if square:
        w = h = F.greatest(w, h)
    cx, cy = b["x"] + b["width"] / 2, b["y"] + b["height"] / 2
    x0, y0 = F.greatest(F.floor(cx - w / 2).cast("double"), F.lit(0.0)), F.greatest(F.floor(cy - h / 2).cast("double"), F.lit(0.0))
    x1, y1 = F.least(F.ceil(cx + w / 2).cast("double"), width), F.least(F.ceil(cy + h / 2).cast("double"), height)
    return box(x0, y0, x1 - x0, y1 - y0)


def clamp_crop(b: Column, width: Column, height: Column, least: float = 16.0) -> Column:
    """A box cut at the page borders; null if a side is under ``least``."""
    x0, y0 = F.greatest(b["x"], F.lit(0.0)), F.greatest(b["y"], F.lit(0.0))
    x1, y1 = F.least(right(b), width), F.least(bottom(b), height)
    return F.when((x1 - x0 >= least) & (y1 - y0 >= least), box(x0, y0, x1 - x0, y1 - y0))


def area_m2(pixels: Column, ppm: Column) -> Column:
    """Null without a positive scale."""
    return F.when(ppm > 0, pixels / (ppm * ppm))


def len_m(pixels: Column, ppm: Column) -> Column:
    return F.when(ppm > 0, pixels / ppm)


def two_point_ppm(ax: Column, ay: Column, bx: Column, by: Column, metres: Column) -> Column:
    d = F.hypot(bx - ax, by - ay)
    return F.when((metres > 0) & (d > 0), d / metres)


def compactness(area: Column, perimeter_: Column) -> Column:
    return F.when(perimeter_ > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.5), 12.566370614359172 * area / (perimeter_ * perimeter_)))).otherwise(0.0)


def map_ocr_quad(points: Column, frame: Column) -> Column:
    """Points of a crop's raster in page pixels: frame is struct<crop,raster_w,raster_h>; without a
    frame the points are in page pixels already."""
    sx, sy = frame["crop"]["width"] / frame["raster_w"], frame["crop"]["height"] / frame["raster_h"]
    moved = F.transform(points, lambda p: point(frame["crop"]["x"] + p["x"] * sx, frame["crop"]["y"] + p["y"] * sy))
    return F.when(frame.isNull(), points).otherwise(moved)


def heading_of(stored: Column, vector: Column, base: Column, tip: Column, points: Column) -> Column:
    """Heading in degrees: the stored one, then a stored vector, then from base to tip, then along
    the longest edge; null if none is known."""
    def along(dx, dy):
        return F.when((F.abs(dx) > EPS) | (F.abs(dy) > EPS), heading_deg(dx, dy))

    e = long_edge(points)
    return F.coalesce(stored, along(vector["x"], vector["y"]), along(tip["x"] - base["x"], tip["y"] - base["y"]), along(e["bx"] - e["ax"], e["by"] - e["ay"]))
