"""Text read in overlapping tiles: which readings show one line, and the whole line put together again.

A reading has page_id, line_id (unique), text, confidence, bbox and cuts, the sides of its tile that cut it (array of "left", "right",
"top", "bottom"; null: none).  Readings without text are left out.  Rules are expressions over two structs of those
fields, used for pairs of rows and inside the fold alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..workspace import stage
from .graph import components
from .spatial import box_pairs

C = F.col


def squeezed(text: Column) -> Column:
    """Lower case, blanks as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def text_key(text: Column) -> Column:
    """Only a-z and 0-9 of the lower-cased text."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def _known(lines: DataFrame) -> DataFrame:
    text = F.trim("text")
    some = lines.where(text != "").withColumn("text", text).withColumn("cuts", F.coalesce("cuts", F.array().cast("array<string>")))
    return some.withColumn("plain", squeezed(C("text"))).withColumn("key", text_key(C("text")))


_FIELDS = ("line_id", "text", "confidence", "bbox", "cuts", "plain", "key")


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _area(b: Column) -> Column:
    return F.greatest(b["width"] * b["height"], F.lit(1.0))


def _same_row(a: Column, b: Column) -> Column:
    """Whether boxes share 40 % of the lower one's height and their middles lie within 65 % of the mean height."""
    x, y = a["bbox"], b["bbox"]
    shared = F.greatest(F.least(g.bottom(x), g.bottom(y)) - F.greatest(x["y"], y["y"]), F.lit(0.0))
    apart = F.abs(x["y"] + x["height"] / 2 - y["y"] - y["height"] / 2)
    return (shared >= 0.4 * F.greatest(F.least(x["height"], y["height"]), F.lit(1.0))) & (apart <= 0.65 * F.greatest((x["height"] + y["height"]) / 2, F.lit(1.0)))


def _covered(a: Column, b: Column) -> Column:
    """The intersection over the smaller box (areas of 1 at least)."""
    return g.intersect_area(a["bbox"], b["bbox"]) / F.least(_area(a["bbox"]), _area(b["bbox"]))


def repeated(a: Column, b: Column) -> Column:
    """Whether two readings of one key are near: 22 % of the smaller box is covered, or the middles are within max(18, 45 % of
    the wider, 90 % of the higher).  Without both boxes the key decides."""
    x, y = a["bbox"], b["bbox"]
    away = F.hypot(x["x"] + x["width"] / 2 - y["x"] - y["width"] / 2, x["y"] + x["height"] / 2 - y["y"] - y["height"] / 2)
    reach = F.greatest(F.lit(18.0), 0.45 * F.greatest(x["width"], y["width"]), 0.9 * F.greatest(x["height"], y["height"]))
    near = (_covered(a, b) >= 0.22) | (away <= reach)
    return (a["key"] != "") & (a["key"] == b["key"]) & F.when(x.isNull() | y.isNull(), True).otherwise(near)


def one_instance(a: Column, b: Column) -> Column:
    """Whether two readings show the same text: boxes on one row cover each other (55 % of the smaller, or IoU 0.4), or one text holds the
    other and they are repeated or 28 % covered."""
    held = a["plain"].contains(b["plain"]) | b["plain"].contains(a["plain"])
    both = g.intersect_area(a["bbox"], b["bbox"])
    iou = both / (_area(a["bbox"]) + _area(b["bbox"]) - both)
    close = (_covered(a, b) >= 0.55) | (iou >= 0.4) | (held & (repeated(a, b) | (_covered(a, b) >= 0.28)))
    return F.when(a["bbox"].isNull() | b["bbox"].isNull(), repeated(a, b)).otherwise(_same_row(a, b) & close)


def _letter_width(a: Column) -> Column:
    """Width of a letter, blanks not counted."""
    return F.greatest(a["bbox"]["width"], F.lit(1.0)) / F.greatest(F.char_length(F.replace(a["plain"], F.lit(" "))), F.lit(1))


def _overlap(left: Column, right: Column, least: Column) -> Column:
    """The length of the longest end of ``left`` that ``right`` begins with, of ``least`` letters or more; null if there is none."""
    a, b = F.lower(left), F.lower(right)
    longest = F.least(F.char_length(a), F.char_length(b))
    fits = lambda k: F.substring(a, F.char_length(a) - k + 1, k) == F.substring(b, F.lit(1), k)
    return F.array_max(F.filter(F.when(longest >= least, F.sequence(least, longest)).otherwise(F.array().cast("array<int>")), fits))


def _ordered(a: Column, b: Column, use) -> Column:
    """``use(left, right)`` of two readings; of one place the first is left."""
    first = a["bbox"]["x"] <= b["bbox"]["x"]
    pair = F.struct(F.when(first, a).otherwise(b).alias("left"), F.when(first, b).otherwise(a).alias("right"))
    return _let(pair, lambda p: use(p["left"], p["right"]))


def _gap(left: Column, right: Column) -> Column:
    return right["bbox"]["x"] - g.right(left["bbox"])


def _widest(left: Column, right: Column) -> Column:
    return F.greatest(_letter_width(left), _letter_width(right), F.lit(4.0))


def _cut(a: Column) -> Column:
    return F.size(a["cuts"]) > 0


def _least_overlap(left: Column, right: Column) -> Column:
    return F.when(_cut(left) | _cut(right), 2).otherwise(3)


def continued(a: Column, b: Column) -> Column:
    """Whether two readings, not of one instance, are neighbouring parts of one line: on one row, with a gap of -1.2 to 2.4 letters, and with
    texts that overlap (at a cut, or within 1.2 letters), hold one another, or are cut and within 1.15 letters."""

    def of(left: Column, right: Column) -> Column:
        gap, wide = _gap(left, right), _widest(left, right)
        stitched = _overlap(left["text"], right["text"], _least_overlap(left, right)).isNotNull()
        seam = F.array_contains(left["cuts"], "right") | F.array_contains(right["cuts"], "left") | (gap <= 1.2 * wide)
        held = left["plain"].contains(right["plain"]) | right["plain"].contains(left["plain"])
        joined = F.when(stitched, seam).when(held, True).otherwise((_cut(left) | _cut(right)) & (gap <= 1.15 * wide))
        return gap.between(-1.2 * wide, 2.4 * wide) & (left["plain"] != right["plain"]) & joined

    apart = a["bbox"].isNull() | b["bbox"].isNull() | ~_same_row(a, b) | one_instance(a, b)
    return F.when(apart, False).otherwise(_ordered(a, b, of))


def text_matches(lines: DataFrame) -> DataFrame:
    """Pairs (page_id, a, b) with a < b of readings of one page that show the same text or continue each other.

    Boxes meet over grid cells, each grown by as far as any rule reaches from it; readings without a box meet those of their page that
    have the same key."""
    own = _known(lines).withColumn("r", F.struct(*(f for f in _FIELDS if f != "confidence")))  # no rule asks for it
    b = C("bbox")
    reach = F.greatest(F.lit(18.0), 0.45 * b["width"], 0.9 * b["height"], 2.4 * F.greatest(_letter_width(C("r")), F.lit(4.0)))
    boxed = own.where(b.isNotNull()).select("page_id", "r", g.expand(b, reach).alias("wide"))
    side = lambda df, p: df.select("page_id", C("r").alias(p), C("wide").alias(f"{p}box"))
    pairs = box_pairs(side(boxed, "a"), side(boxed, "b"), "abox", "bbox").where("a.line_id < b.line_id")
    # Every rule wants a row or a key in common.
    pairs = pairs.where(_same_row(C("a"), C("b")) | (C("a.key") == C("b.key")))
    near = pairs.where(one_instance(C("a"), C("b")) | repeated(C("a"), C("b")) | continued(C("a"), C("b"))).select("page_id", C("a.line_id").alias("a"), C("b.line_id").alias("b"))
    # Each line without a box meets the others of its key through the smallest of them that has none.
    keyed = own.where("key <> ''").select("page_id", "key", "line_id", b.isNull().alias("bare"))
    hubs = keyed.where("bare").groupBy("page_id", "key").agg(F.min("line_id").alias("hub"))
    unplaced = keyed.join(hubs, ["page_id", "key"]).where("line_id <> hub").select("page_id", F.least("hub", "line_id").alias("a"), F.greatest("hub", "line_id").alias("b"))
    return near.unionByName(unplaced)


def _better(a: Column, b: Column) -> Column:
    """Whether the first of two readings is the better one: of one key the one with fewer other signs; else the one that holds the
    other's key, that is not cut, whose key is longer by two, that is surer, that is longer, or the first."""
    ka, kb, known = a["key"], b["key"], (a["key"] != "") & (b["key"] != "")
    signs = lambda r, k: F.char_length(r["text"]) - F.char_length(k)
    longer = F.char_length(ka) - F.char_length(kb)
    return (
        F.when(known & (ka == kb) & (signs(a, ka) != signs(b, kb)), signs(a, ka) < signs(b, kb))
        .when(known & (ka != kb) & kb.contains(ka), False).when(known & (ka != kb) & ka.contains(kb), True)
        .when(_cut(a) != _cut(b), ~_cut(a)).when(F.abs(longer) >= 2, longer > 0)
        .when(a["confidence"] != b["confidence"], a["confidence"] > b["confidence"]).otherwise(F.char_length(a["text"]) >= F.char_length(b["text"]))
    )


def _put_together(left: Column, right: Column) -> Column:
    """The text of two neighbouring parts: the one that holds the other, else stitched at their overlap, else, if near, one after the other
    (without the hyphen at a break, without a space after a colon or slash or between letters), else the longer one."""
    a, b = left["text"], right["text"]
    longer = F.when(F.char_length(a) >= F.char_length(b), a).otherwise(b)
    shared = _overlap(a, b, _least_overlap(left, right))
    last, first = F.substring(a, -1, 1), F.substring(b, 1, 1)
    letters = (F.lower(last) != F.upper(last)) & (F.lower(first) != F.upper(first))
    return (
        F.when(left["plain"] == right["plain"], longer).when(right["plain"].contains(left["plain"]), b).when(left["plain"].contains(right["plain"]), a)
        .when(shared.isNotNull(), F.concat(a, F.substring(b, shared + 1, F.char_length(b))))
        .when(_gap(left, right) > 1.2 * _widest(left, right), longer)
        .when(last == "-", F.concat(F.substring(a, F.lit(1), F.char_length(a) - 1), b)).when(last.isin(":", "/") | letters, F.concat(a, b)).otherwise(F.concat_ws(" ", a, b))
    )


def _merged(a: Column, b: Column) -> Column:
    """One reading of two: the better one's text where they show the same, else both put together; both boxes, the larger confidence, no cuts."""
    x, y = a["bbox"], b["bbox"]
    left, top = F.least(x["x"], y["x"]), F.least(x["y"], y["y"])
    around = g.box(left, top, F.greatest(g.right(x), g.right(y)) - left, F.greatest(g.bottom(x), g.bottom(y)) - top)
    chosen = F.when(_better(a, b), a).otherwise(b)
    text = F.when(one_instance(a, b) | repeated(a, b), chosen["text"]).otherwise(_ordered(a, b, _put_together))
    bare = x.isNull() | y.isNull()

    def made(text: Column) -> Column:
        return F.struct(
            a["line_id"].alias("line_id"), text.alias("text"), F.greatest(a["confidence"], b["confidence"]).alias("confidence"), around.alias("bbox"),
            F.array().cast("array<string>").alias("cuts"), squeezed(text).alias("plain"), text_key(text).alias("key"),
        )

    return F.when(bare, chosen).otherwise(_let(text, made))


def merge_text(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """H5: one line for each component of matching readings: page_id, line_id (of the smallest reading), text, confidence, bbox, parts.

    The readings of a component are put together from left to right (ties: the smaller line_id; those without a box first).  The fold runs over
    the readings of one component."""
    linked = components(matches, node="line_id", component="line", page="page_id")
    own = _known(lines).select("page_id", "line_id", "text", "confidence", "bbox", "cuts")
    parts = stage(own.join(linked, "line_id", "left"), "parts")  # written: readings that match none are not grouped
    some = _known(parts.where("line IS NOT NULL")).withColumn("r", F.struct(*_FIELDS)).select("page_id", "line", F.struct(F.coalesce(C("bbox.x"), F.lit(0.0)).alias("x"), "line_id", "r").alias("o"))
    grouped = some.groupBy("page_id", "line").agg(F.sort_array(F.collect_list("o")).alias("o"), F.count("*").alias("parts"))
    rows = F.transform("o", lambda o: o["r"])
    whole = grouped.select("page_id", "line", F.aggregate(F.slice(rows, F.lit(2), F.size("o")), F.get(rows, F.lit(0)), _merged).alias("r"), "parts").select("page_id", "line", "r.text", "r.confidence", "r.bbox", "parts")
    alone = parts.where("line IS NULL").select("page_id", C("line_id").alias("line"), "text", "confidence", "bbox", F.lit(1).cast("long").alias("parts"))
    return whole.unionByName(alone).withColumnRenamed("line", "line_id")
