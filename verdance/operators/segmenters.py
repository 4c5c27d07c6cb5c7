"""Named segmenters: from pixels to the mask table, so that settings can name the method and users can add their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pixels import bgr_to_hsv, hsv_in_ranges, threshold_mask, tile_scores

#: name -> segment(pixels, settings): the target pixels, with the columns of pixels that are not colours.
SEGMENTERS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}


def register_segmenter(name: str, segment: Callable[[DataFrame, dict], DataFrame]) -> None:
    SEGMENTERS[name] = segment


def segment(pixels: DataFrame, method: str, settings: dict) -> DataFrame:
    """Target pixels by the named method; an unknown one is refused."""
    if method not in SEGMENTERS:
        raise ValueError(f"unknown segmentation method {method!r}; known: {sorted(SEGMENTERS)}")
    return SEGMENTERS[method](pixels, settings)


def _color(pixels: DataFrame, settings: dict) -> DataFrame:
    """settings: ranges."""
    h, s, v = bgr_to_hsv()
    return pixels.where(hsv_in_ranges(h, s, v, settings["ranges"])).drop("b", "g", "r")


def _model(pixels: DataFrame, settings: dict) -> DataFrame:
    """settings: score, width, height, tile, overlap, threshold."""
    prob = tile_scores(pixels, settings["score"], settings["width"], settings["height"], settings["tile"], settings["overlap"], settings.get("key", ["frame"]))
    return threshold_mask(prob, settings.get("threshold", 0.5)).where(F.col("variant") == "nominal").drop("variant", "p")


register_segmenter("color", _color)
register_segmenter("model", _model)
