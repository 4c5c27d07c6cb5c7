"""Settings variants carried out: every variant of a table of settings measured from one scan of the pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import settled
from .pixels import KEY, Range, apply_gains, bgr_to_hsv, extent_along_axis, hsv_in_ranges, mask_cleanup, shift_ranges

#: Variants that one run takes; they become columns of one scan.
MAX_VARIANTS = 200
DEFAULTS = {"hsv_step": "0", "cleanup": "on", "lighting": "on", "front_percentile": "50"}


def measure_variants(
    pixels: DataFrame, variants: DataFrame, ranges: Sequence[Range], base: tuple[float, float], tip: tuple[float, float], width: int, height: int,
    radius: int = 1, min_area: int = 4, delta: tuple[int, int, int] = (4, 20, 20), gains: DataFrame | None = None, background: DataFrame | None = None, key: Sequence[str] = KEY,
) -> DataFrame:
    """variant, its settings (hsv_step, cleanup, lighting, front_percentile), key, target_px, coverage_pct and extent_px (null
    without a target) of every image of pixels(key, x, y, b, g, r), width x height, for every row of variants(variant,
    overrides), as variant_grid has them. hsv_step moves the ranges by delta; lighting `on` applies gains, `background` those
    of background, `off` none. Variants that see an image alike share its mask: pixels are read once, a mask is cleaned once,
    and fronts are taken from it at each percentile. An unknown setting is refused."""
    rows = variants.limit(MAX_VARIANTS + 1).collect()
    if len(rows) > MAX_VARIANTS:
        raise ValueError(f"more than {MAX_VARIANTS} variants")
    asked = []
    for r in rows:
        over = dict(r["overrides"] or {})
        if unknown := set(over) - set(DEFAULTS):
            raise ValueError(f"variant {r['variant']}: unknown settings {sorted(unknown)}")
        asked.append((r["variant"], DEFAULTS | over))
    looks = sorted({(s["hsv_step"], s["cleanup"], s["lighting"]) for _, s in asked})
    place = {look: i for i, look in enumerate(looks)}
    # the images as each kind of lighting shows them, side by side
    seen = {"off": pixels.select(*key, "x", "y", "b", "g", "r")}
    lights = sorted({s["lighting"] for _, s in asked})
    for name, table in (("on", gains), ("background", background)):
        seen[name] = seen["off"] if table is None else apply_gains(seen["off"], table, key)
    hits = []
    for light in lights:
        h, s, v = bgr_to_hsv()
        each = seen[light].select(*key, "x", "y", h.alias("h"), s.alias("s"), v.alias("v"))
        on = [(i, hsv_in_ranges(F.col("h"), F.col("s"), F.col("v"), shift_ranges(ranges, int(step), delta))) for (step, _, of), i in place.items() if of == light]
        hits.append(each.select(*key, "x", "y", F.explode(F.filter(F.array(*(F.when(hit, F.lit(i)) for i, hit in on)), lambda x: x.isNotNull())).alias("look")))
    raw = hits[0]
    for more in hits[1:]:
        raw = raw.unionByName(more)
    raw = settled(raw)
    cleaned = [i for (_, cleanup, _), i in place.items() if cleanup == "on"]
    both = [raw.where(~F.col("look").isin(cleaned)), mask_cleanup(raw.where(F.col("look").isin(cleaned)), width, height, radius, min_area, ["look", *key])]
    mask = settled(both[0].select("look", *key, "x", "y").unionByName(both[1].select("look", *key, "x", "y")))
    area = mask.groupBy("look", *key).agg(F.count(F.lit(1)).alias("target_px"))
    fronts = None
    for p in sorted({s["front_percentile"] for _, s in asked}):
        with_p = [place[s["hsv_step"], s["cleanup"], s["lighting"]] for _, s in asked if s["front_percentile"] == p]
        got = extent_along_axis(mask.where(F.col("look").isin(with_p)), base, tip, float(p) / 100, key=["look", *key]).select("look", *key, F.lit(p).alias("front_percentile"), "extent_px")
        fronts = got if fronts is None else fronts.unionByName(got)
    table = pixels.sparkSession.createDataFrame([(name, place[s["hsv_step"], s["cleanup"], s["lighting"]], s["hsv_step"], s["cleanup"], s["lighting"], s["front_percentile"]) for name, s in asked], "variant string, look int, hsv_step string, cleanup string, lighting string, front_percentile string")
    cells = F.explode(F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(table.columns, r, strict=True))) for r in table.collect())))
    every = pixels.select(*key).distinct().withColumn("v", cells).select(*key, "v.*")
    out = every.join(area, ["look", *key], "left").join(fronts, ["look", *key, "front_percentile"], "left")
    return out.select("variant", "hsv_step", "cleanup", "lighting", "front_percentile", *key, F.coalesce("target_px", F.lit(0)).alias("target_px"), (100.0 * F.coalesce("target_px", F.lit(0)) / (width * height)).alias("coverage_pct"), "extent_px")
