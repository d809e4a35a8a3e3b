"""Hooks for a user's batch predictor over tiles."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

REGIONS = "page_id long, type string, label string, confidence double, x double, y double, w double, h double"


def score_tiles(tiles: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``predict`` gets a batch of tile rows (page_id, x, y, w, h) and returns regions in tile
    coordinates with the tile's place in tx, ty; they come out in page coordinates."""

    def run(batches):
        for batch in batches:
            out = predict(batch)
            yield out.assign(x=out["x"] + out["tx"], y=out["y"] + out["ty"])[[c.split()[0] for c in REGIONS.split(", ")]]

    return tiles.mapInPandas(run, REGIONS)


def middle_box(tiles: pd.DataFrame) -> pd.DataFrame:
    """A stand-in predictor: one room in the middle half of every tile."""
    return pd.DataFrame(
        {"page_id": tiles["page_id"], "tx": tiles["x"], "ty": tiles["y"], "type": "room", "label": "Room", "confidence": 0.5, "x": tiles["w"] / 4, "y": tiles["h"] / 4, "w": tiles["w"] / 2, "h": tiles["h"] / 2}
    )
