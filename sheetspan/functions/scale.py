"""Column expressions about drawing scales, paper sizes and page kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short and long side of the A sheets in mm.
PAPER_MM = {"A0": (841, 1189), "A1": (594, 841), "A2": (420, 594), "A3": (297, 420), "A4": (210, 297)}


def _paper(paper: Column, k: int) -> Column:
    out = F.lit(None).cast("double")
    for name, sides in PAPER_MM.items():
        out = F.when(paper == name, float(sides[k])).otherwise(out)
    return out


def ppm_from_scale(ratio: Column, paper: Column, width: Column, height: Column) -> Column:
    """Page pixels per metre on site for a sheet printed at 1:ratio; the sheet lies as the page
    does.  Null without ratio or known paper."""
    side = F.when(width >= height, _paper(paper, 1)).otherwise(_paper(paper, 0))
    return F.when((ratio > 0) & (width > 0), width / (side / 1000.0 * ratio))


def effective_scale(ratio: Column, printed_for: Column, printed_on: Column) -> Column:
    """The ratio when a sheet for one A size is printed on another: times the square root of 2 a step."""
    number = lambda p: F.when(p.isin(*PAPER_MM), F.substring(p, 2, 1).cast("int"))
    return ratio * F.pow(F.lit(2.0), (number(printed_on) - number(printed_for)) / 2.0)


def paper_from_px(width: Column, height: Column, dpi: Column, tolerance_mm: float = 12.0) -> Column:
    """The A size nearest to the page at a resolution, within a total difference of both sides."""
    short, long = F.least(width, height) / dpi * 25.4, F.greatest(width, height) / dpi * 25.4
    sizes = F.array(*(F.struct((F.abs(short - a) + F.abs(long - b)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, (a, b)) in enumerate(PAPER_MM.items())))
    best = F.array_min(sizes)
    return F.when((dpi > 0) & (best["d"] <= tolerance_mm), best["name"])


def dpi_of(width_px: Column, height_px: Column, width_mm: Column, height_mm: Column) -> Column:
    """Mean of the two axes' resolutions; null without paper."""
    return F.when((width_mm > 0) & (height_mm > 0), (width_px / (width_mm / 25.4) + height_px / (height_mm / 25.4)) / 2)


def graphics_kind(vector: Column, image: Column, text: Column) -> Column:
    """unknown without operators; with images raster under 20 vector operators, else hybrid; else vector."""
    nothing = (vector == 0) & (image == 0) & (text == 0)
    pictured = F.when(vector < 20, "raster").otherwise("hybrid")
    return F.when(nothing, "unknown").when(image > 0, pictured).otherwise("vector")
