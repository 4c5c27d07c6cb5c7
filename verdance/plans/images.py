"""Queries over images: pixels, masks, labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.shared import settled, shared_dir
from ..operators import masks, pixels, series, variants
from ..sources.tables import coco_annotations, coco_read, coco_tables, coco_write, image_pixels
from ..streaming import live
from .sample import LB, PX, labelled, query, table
from .sample import pixels as px_table

HSV = f"""{PX}, hv as (select *, greatest(b, g, r) v, greatest(b, g, r) - least(b, g, r) dl from px),
hs as (select *, (floor((case when hu < 0 then hu + 360 else hu end) / 2 + 0.5)::int) % 180 h, case when v = 0 then 0 else floor(255.0 * dl / v + 0.5)::int end s from (select *, case when dl = 0 then 0 when v = r then 60.0 * (g - b) / dl when v = g then 120 + 60.0 * (b - r) / dl else 240 + 60.0 * (r - g) / dl end hu from hv))"""
GREEN = [((35, 40, 20), (85, 255, 255))]
BROWN = [((5, 30, 20), (40, 255, 255))]
MASK = "mk as (select frame, grp, x, y from px where g >= 110)"


def _mask(spark, d):
    """Pixels of strong green as a mask; each image group's images in id order are its frames."""
    return px_table(spark, d).where("g >= 110").select("frame", "grp", "x", "y")


def _hsv(spark, d):
    h, s, v = pixels.bgr_to_hsv()
    return px_table(spark, d).select("frame", "grp", "x", "y", h.alias("h"), s.alias("s"), v.alias("v"))


@query("bgr_to_hsv", f"with {HSV}\n;;\nselect frame, x, y, h, s, v from hs", "", "frame x y h s v")
def _(spark, d):
    return _hsv(spark, d).drop("grp")


#: The ranges wider (1) and narrower (-1), as numbers: the SQL must not lean on what it tests.
SHIFTED = {"green": {0: "h between 35 and 85 and s >= 40 and v >= 20", 1: "h between 31 and 89 and s >= 20", -1: "h between 39 and 81 and s >= 60 and v >= 40"}, "brown": {0: "h between 5 and 40 and s >= 30 and v >= 20", 1: "h between 1 and 44 and s >= 10", -1: "h between 9 and 36 and s >= 50 and v >= 40"}}


def _in(r):
    (a, b, c), (e, f, g) = r
    return f"(h between {a} and {e} and s between {b} and {f} and v between {c} and {g})"


@query("hsv_in_ranges", f"with {HSV}\n;;\nselect frame, count(*) n from hs where {_in(GREEN[0])} group by 1")
def _(spark, d):
    return _hsv(spark, d).where(pixels.hsv_in_ranges(F.col("h"), F.col("s"), F.col("v"), GREEN)).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query("shift_ranges", f"with {HSV}\n;;\nselect frame, count(*) filter ({SHIFTED['green'][1]}) wider, count(*) filter ({SHIFTED['green'][-1]}) narrower from hs group by 1")
def _(spark, d):
    on = lambda step: F.count_if(pixels.hsv_in_ranges(F.col("h"), F.col("s"), F.col("v"), pixels.shift_ranges(GREEN, step)))
    return _hsv(spark, d).groupBy("frame").agg(on(1).alias("wider"), on(-1).alias("narrower"))


@query("hsv_range_from_samples")
def _(spark, d):
    return pixels.hsv_range_from_samples(_hsv(spark, d).where("v > 0"), ["grp"])


def _disc_sql(name, source, grow):
    """A disc of radius 1 in 8 x 8 images: grown, or what keeps its whole disc."""
    inside = "x + dx between 0 and 7 and y + dy between 0 and 7"
    if grow:
        return f"{name} as (select distinct frame, (x + dx)::int x, (y + dy)::int y from {source}, off where {inside})"
    return f"{name} as (select frame, x, y from (select m.frame, m.x, m.y, count(*) need, count(n.x) got from (select * from {source}, off where {inside}) m left join {source} n on n.frame = m.frame and n.x = m.x + dx and n.y = m.y + dy group by all) where need = got)"


CLEAN = f"""off as (select * from (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy)), {_disc_sql("c1", "mk", False)}, {_disc_sql("c2", "c1", True)}, {_disc_sql("c3", "c2", True)}, {_disc_sql("c4", "c3", False)},
rc as (select frame, x, y, y * 8 + x l from c4 union select n.frame, n.x, n.y, rc.l from rc join c4 n on n.frame = rc.frame and abs(n.x - rc.x) <= 1 and abs(n.y - rc.y) <= 1), bl as (select frame, x, y, min(l) l from rc group by all), cl as (select frame, x, y, l from bl join (select frame, l, count(*) n from bl group by all) using (frame, l) where n >= 4)"""


@query("mask_cleanup", f"with recursive {PX}, {MASK}, {CLEAN}\n;;\nselect frame, x, y from cl")
def _(spark, d):
    return pixels.mask_cleanup(_mask(spark, d).select("frame", "x", "y"), 8, 8, 1, 4)


@query("label_blobs", f"with recursive {PX}, {MASK}, rc as (select frame, x, y, y * 8 + x l from mk union select n.frame, n.x, n.y, rc.l from rc join mk n on n.frame = rc.frame and abs(n.x - rc.x) <= 1 and abs(n.y - rc.y) <= 1)\n;;\nselect frame, x, y, (min(l) // 8) * 4294967296 + min(l) % 8 blob from rc group by frame, x, y", "", "frame x y blob")
def _(spark, d):
    return pixels.label_blobs(_mask(spark, d).select("frame", "x", "y"), tile=4, block=8)


@query("erode", f"with {PX}, {MASK}, off as (select * from (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy)), {_disc_sql('c1', 'mk', False)}\n;;\nselect frame, x, y from c1")
def _(spark, d):
    return pixels.erode(_mask(spark, d).select("frame", "x", "y"), 1, 8, 8)


PLOTS = [("left", [(0.5, 0.5), (4.2, 0.9), (3.7, 6.5), (0.6, 6.1)]), ("star", [(4.5, 0.5), (7.6, 3.2), (5.8, 3.4), (7.1, 7.3), (4.4, 4.6)])]


def _plots(spark):
    return spark.createDataFrame(PLOTS, "plot string, polygon array<struct<x: double, y: double>>")


def _inside(poly):
    parts = []
    for (x1, y1), (x2, y2) in zip(poly, poly[1:] + poly[:1], strict=True):
        parts.append(f"(case when ({y1} <= y) <> ({y2} <= y) and x < {x1} + (y - {y1}) * {(x2 - x1)} / {(y2 - y1)} then 1 else 0 end)")
    return f"({' + '.join(parts)}) % 2 = 1"


@query("polygon_mask", f"with {PX}\n;;\n" + " union all ".join(f"select frame, '{n}' as plot, x, y from px where {_inside(p)}" for n, p in PLOTS))
def _(spark, d):
    return pixels.polygon_mask(px_table(spark, d), _plots(spark)).select("frame", "plot", "x", "y")


@query("plots_hull")
def _(spark, d):
    h = pixels.plots_hull(_mask(spark, d), ["frame"], 1.0)
    return h.select("frame", F.size("hull").alias("n"), F.aggregate("hull", F.lit(0.0), lambda a, p: a + p["x"]).alias("sx"))


@query("crop_window", f"with {PX}, b as (select frame, grp, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from px where g >= 110 group by all)\n;;\nselect frame as plot, greatest(x0 - 2, 0) x0, least(x1 + 3, 8) x1, greatest(y0 - 2, 0) y0, least(y1 + 3, 8) y1 from b", "", "plot x0 x1 y0 y1")
def _(spark, d):
    poly = _mask(spark, d).groupBy(F.col("frame").alias("plot")).agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("polygon"))
    return pixels.crop_window(poly, 2, 8, 8)


@query("color_indices", f"with {PX}, i as (select frame, g / (r + g + b) gcc, r / (r + g + b) rcc, (2.0 * g - r - b) / (r + g + b) exg from px where greatest(b, g, r) > 0)\n;;\nselect frame, avg(gcc) gcc, quantile_cont(gcc, 0.9) gcc_p90, avg(rcc) rcc, avg(exg) exg from i group by 1", "gcc gcc_p90 rcc exg", "frame")
def _(spark, d):
    return pixels.color_indices(px_table(spark, d))


def _share(c, before=()):
    cols = [f"100 * avg(case when ({SHIFTED[c][step]}){''.join(f' and not ({SHIFTED[b][step]})' for b in before)} then 1.0 else 0.0 end)" for step in (0, 1, -1)]
    return f"{cols[0]} class_{c}_pct, (greatest({', '.join(cols)}) - least({', '.join(cols)})) / (2 * sqrt(3)) class_{c}_pct_unc"


@query("class_shares", f"with {HSV}\n;;\nselect frame, {_share('green')}, {_share('brown', ('green',))} from hs where v > 0 group by 1", "class_green_pct class_green_pct_unc class_brown_pct class_brown_pct_unc", "frame")
def _(spark, d):
    return pixels.class_shares(px_table(spark, d), {"green": GREEN, "brown": BROWN})


LUMA = f"{PX}, lu as (select *, floor(0.299::double * r + 0.587::double * g + 0.114::double * b + 0.5::double) l from px)"
LAP = f"{LUMA}, lp as (select *, coalesce(lag(l) over c, lead(l) over c) + coalesce(lead(l) over c, lag(l) over c) + coalesce(lag(l) over w, lead(l) over w) + coalesce(lead(l) over w, lag(l) over w) - 4 * l lap from lu window c as (partition by frame, x order by y), w as (partition by frame, y order by x))"


@query("frame_brightness", f"with {LUMA}\n;;\nselect frame, avg(l) mean_brightness from lu group by 1", "mean_brightness", "frame")
def _(spark, d):
    return pixels.frame_brightness(px_table(spark, d))


@query("frame_sharpness", f"with {LAP}\n;;\nselect frame, var_pop(lap) sharpness from lp group by 1", "sharpness", "frame")
def _(spark, d):
    return pixels.frame_sharpness(px_table(spark, d))


@query("normalized_sharpness", f"with {LAP}\n;;\nselect frame, var_pop(lap) filter (x >= 2) / var_pop(l) filter (x >= 2) norm_sharpness from lp group by 1", "norm_sharpness", "frame")
def _(spark, d):
    return pixels.normalized_sharpness(px_table(spark, d), F.col("x") >= 2, 20)


@query("lighting_region", f"with {PX}, {MASK}\n;;\nselect frame, count(*) n from px where not exists (select 1 from mk where mk.frame = px.frame and abs(mk.x - px.x) + abs(mk.y - px.y) <= 1) group by 1")
def _(spark, d):
    p = px_table(spark, d)
    return pixels.lighting_region(p, _mask(spark, d), 8, 8, grow=1).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


GAINS = f"""{PX}, md as (select frame, count(*) n, median(b) mb, median(g) mg, median(r) mr, avg(case when greatest(b, g, r) >= 250 then 1.0 else 0.0 end) saturated from px group by 1), rf as (select * from md where frame = (select min(frame) from px)),
gn as (select md.frame, case when rf.mb >= 5 then least(greatest(rf.mb / greatest(md.mb, 1), 1 / 3.0::double), 3) end gain_b, case when rf.mg >= 5 then least(greatest(rf.mg / greatest(md.mg, 1), 1 / 3.0::double), 3) end gain_g, case when rf.mr >= 5 then least(greatest(rf.mr / greatest(md.mr, 1), 1 / 3.0::double), 3) end gain_r, md.saturated, greatest(md.saturated - rf.saturated, 0) saturated_rise from md, rf)"""


def _gains(spark, d):
    return pixels.lighting_gains(px_table(spark, d), F.col("frame") == 0)


@query("lighting_gains", f"with {GAINS}\n;;\nselect * from gn", "gain_b gain_g gain_r saturated saturated_rise", "frame")
def _(spark, d):
    return _gains(spark, d)


@query("lighting_gains_by_experiment", f"with {GAINS.replace('rf as (select * from md where frame = (select min(frame) from px))', 'rf as (select * from md where frame < 4)').replace('from md, rf)', 'from md join rf on md.frame % 4 = rf.frame)')}\n;;\nselect frame % 4 exp, * from gn", "gain_b gain_g gain_r saturated saturated_rise", "exp frame")
def _(spark, d):
    p = px_table(spark, d).withColumn("exp", F.col("frame") % 4)
    return pixels.lighting_gains(p, F.col("frame") < 4, ["exp", "frame"], by=["exp"])


@query("apply_gains", f"with {GAINS}\n;;\nselect frame, sum(floor(least(255, b * coalesce(gain_b, 1))))::bigint sb, sum(floor(least(255, r * coalesce(gain_r, 1))))::bigint sr from px join gn using (frame) group by 1")
def _(spark, d):
    return pixels.apply_gains(px_table(spark, d), _gains(spark, d)).groupBy("frame").agg(F.sum("b").alias("sb"), F.sum("r").alias("sr"))


FLAGS = f"""{LAP}, q as (select frame, avg(l) br, var_pop(lap) / var_pop(l) ns, frame % 11 <> 0 ok, frame % 3 rms, count(*) filter (g >= 110) target from lp group by 1), rf as (select * from q where frame = 1)"""


@query("frame_flags", f"with {FLAGS}\n;;\nselect q.frame, list_filter([case when not q.ok then 'align_failed' end, case when q.ok and q.rms > 1.5 then 'align_poor' end, case when abs(q.br / rf.br - 1) > 0.2 then 'brightness_changed' end, case when q.ns < 0.5 * rf.ns then 'blurry' end, case when q.frame % 13 = 0 then 'saturated' end, case when q.target = 0 then 'no_target' end], lambda x: x is not null) flags from q, rf")
def _(spark, d):
    p = px_table(spark, d)
    q = pixels.frame_brightness(p).withColumnRenamed("mean_brightness", "brightness").join(pixels.normalized_sharpness(p), "frame").join(p.groupBy("frame").agg(F.count_if(F.col("g") >= 110).alias("target_px")), "frame")
    q = q.withColumns({"align_ok": F.col("frame") % 11 != 0, "align_rms": F.when(F.col("frame") % 3 > 1.5, 3.0).otherwise(0.0), "align_ecc": F.lit(1.0), "lighting_changed": F.lit(False), "saturated_rise": F.when(F.col("frame") % 13 == 0, 0.1).otherwise(0.0)})
    return pixels.frame_flags(q, F.col("frame") == 1).select("frame", "flags")


@query("target_area", f"with {PX}, t as (select frame, count(*) filter (g >= 110) target_px, count(*) roi_area_px from px group by 1)\n;;\nselect frame, target_px, roi_area_px, 100.0 * target_px / roi_area_px coverage_pct, target_px * 0.25 target_area_mm2, sqrt(target_px * 0.25 / pi()) equivalent_radius_mm from t", "coverage_pct target_area_mm2 equivalent_radius_mm", "frame target_px roi_area_px")
def _(spark, d):
    return pixels.target_area(px_table(spark, d).withColumn("target", F.col("g") >= 110), F.lit(0.5))


@query("extent_along_axis", f"""with {PX}, {MASK}, c as (select frame, (x - 1.0) * 0.6 + (y - 7.0) * -0.8 al, (y - 7.0) * 0.6 - (x - 1.0) * -0.8 ac from mk), s as (select frame, floor(ac) st, greatest(max(al + 0.7), 0) fr from c where abs(ac) <= 2.9 group by all),
f as (select frame, median(fr) extent_px, max(fr) extent_max_px, count(*) width_px from s group by 1), k as (select frame, count(*) target_px, least(count(distinct case when al >= 0 and al < 5 then floor(al) end), 5)::double covered_length_px from c where abs(ac) <= 2.9 group by 1)
;;
select * from f join k using (frame)""", "extent_px extent_max_px covered_length_px", "frame width_px target_px")
def _(spark, d):
    return pixels.extent_along_axis(_mask(spark, d), (1.0, 7.0), (4.0, 3.0), 0.5, 2.9)


@query("extent_along_path")
def _(spark, d):
    return pixels.extent_along_path(_mask(spark, d), [(0.0, 7.0), (3.0, 5.0), (6.0, 0.0)], 0.5, 3.0)


@query("reference_coverage", f"with {PX}, {MASK}\n;;\nselect frame, avg(case when g >= 110 then 1.0 else 0.0 end) reference_coverage from px where x >= 2 and y < 6 group by 1", "reference_coverage", "frame")
def _(spark, d):
    ref = px_table(spark, d).withColumns({"along": F.col("x") - 2.0, "inside": F.col("y") < 6})
    return pixels.reference_coverage(ref, _mask(spark, d))


SPREAD = f"{PX}, vr as (select frame, t, count(*) filter (g >= t) n from px, (select unnest([100, 110, 120]) t) group by all), sg as (select frame, (max(n) - min(n)) / (2 * sqrt(3)) seg, max(n) filter (t = 110) n from vr group by 1)"


def _spread(spark, d):
    v = px_table(spark, d).withColumn("t", F.explode(F.array(F.lit(100), F.lit(110), F.lit(120)))).groupBy("frame", "t").agg(F.count_if(F.col("g") >= F.col("t")).alias("value"))
    return pixels.segmentation_spread(v, ["frame"]).join(v.where("t = 110").select("frame", F.col("value").alias("n")), "frame")


@query("segmentation_spread", f"with {SPREAD}\n;;\nselect frame, seg seg_unc from sg", "seg_unc", "frame")
def _(spark, d):
    return _spread(spark, d).select("frame", "seg_unc")


@query("extent_uncertainty", f"with {SPREAD}\n;;\nselect frame, sqrt((n * 0.01) ** 2 + (0.5 / sqrt(12)) ** 2 + 0.2 ** 2 + seg ** 2) unc from sg", "unc", "frame")
def _(spark, d):
    return _spread(spark, d).select("frame", pixels.extent_uncertainty(F.col("n"), F.lit(0.01), F.lit(0.5), F.lit(0.2), F.col("seg_unc")).alias("unc"))


@query("area_uncertainty", f"with {SPREAD}\n;;\nselect frame, sqrt((2 * n * 0.5 * 0.01) ** 2 + (seg * 0.25) ** 2) unc from sg", "unc", "frame")
def _(spark, d):
    return _spread(spark, d).select("frame", pixels.area_uncertainty(F.col("n"), F.lit(0.5), F.lit(0.01), F.col("seg_unc")).alias("unc"))


CR = "cr as (select vec_id frame, m marker, c corner, (case when c in (1, 2) then 40 else 0 end) + m * 100 + embedding[m * 8 + c * 2 + 1]::double x, (case when c >= 2 then 40 else 0 end) + embedding[m * 8 + c * 2 + 2]::double y from embeddings, range(3) a(m), range(4) b(c))"


def _corners(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).select("frame", "embedding", F.floor(F.col("i") / 4).alias("marker"), (F.col("i") % 4).cast("int").alias("corner"))
    at = lambda k: F.get("embedding", (F.col("marker") * 8 + F.col("corner") * 2 + k).cast("int")).cast("double")
    return e.select("frame", "marker", "corner", (F.when(F.col("corner").isin(1, 2), 40).otherwise(0) + F.col("marker") * 100 + at(0)).alias("x"), (F.when(F.col("corner") >= 2, 40).otherwise(0) + at(1)).alias("y"))


@query("scale_from_corners", f"with {CR}, ed as (select p.frame, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) e from cr p join cr q on p.frame = q.frame and p.marker = q.marker and q.corner = (p.corner + 1) % 4)\n;;\nselect frame, 20.0 / avg(e) mm_per_px, stddev_samp(20.0 / e) sd, stddev_samp(20.0 / e) / sqrt(count(*)) se, count(*) n from ed group by 1", "mm_per_px sd se", "frame n")
def _(spark, d):
    return pixels.scale_from_corners(_corners(spark, d), 20.0)


@query("drift_from_corners", f"""with {CR}, j as (select c.frame, c.x, c.y, r.x u, r.y v from cr c join cr r on r.frame = 0 and r.marker = c.marker and r.corner = c.corner), m as (select frame, count(*) n, avg(x) mx, avg(y) my, avg(u) mu, avg(v) mv from j group by 1),
s as (select frame, n, mx, my, mu, mv, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) a, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) b, sum((x - mx) ** 2 + (y - my) ** 2) q, sum((u - mu) ** 2 + (v - mv) ** 2) w from j join m using (frame) group by all)
;;
select frame, n, sqrt(a * a + b * b) / q zoom, degrees(atan2(b, a)) turn_deg, mu - a / q * mx + b / q * my shift_x, mv - b / q * mx - a / q * my shift_y, sqrt(greatest(w - (a * a + b * b) / q, 0) / n) rms from s where frame > 0""", "zoom turn_deg shift_x shift_y rms", "frame n")
def _(spark, d):
    c = _corners(spark, d)
    return pixels.drift_from_corners(c, c.where("frame = 0")).where("frame > 0")


@query("drift_by_experiment", f"with {CR}, j as (select c.frame, c.x, c.y, r.x u, r.y v from cr c join cr r on r.frame = c.frame % 2 and r.marker = c.marker and r.corner = c.corner)\n;;\nselect frame, count(*) n, avg(u) - avg(x) mean_u, avg(v) - avg(y) mean_v from j group by 1", "mean_u mean_v", "frame n")
def _(spark, d):
    c = _corners(spark, d).withColumn("exp", F.col("frame") % 2)
    out = pixels.drift_from_corners(c, c.where("frame < 2"), ["exp", "frame"], ["exp"])
    zoom = F.radians("turn_deg")
    m = c.groupBy("exp", "frame").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    a, b = F.col("zoom") * F.cos(zoom), F.col("zoom") * F.sin(zoom)  # the mean of the reference follows from the fit
    return out.join(m, ["exp", "frame"]).select("frame", "n", (F.col("shift_x") + a * F.col("mx") - b * F.col("my") - F.col("mx")).alias("mean_u"), (F.col("shift_y") + b * F.col("mx") + a * F.col("my") - F.col("my")).alias("mean_v"))


# --- spread: the images of a group are frames in id order --------------------------------------------------------------



def _frames(spark, d):
    return px_table(spark, d).select("grp", "frame").distinct().select("grp", "frame", F.col("frame").cast("double").alias("t"), (F.col("frame") % 7 != 0).alias("usable"))


@query("edge_advance", f"""with {PX}, {MASK}, fu as (select distinct grp, frame, frame % 7 <> 0 usable from px), b as (select grp, min(frame) base from mk join fu using (grp, frame) where usable group by 1),
bp as (select mk.grp, x, y from mk join b on b.grp = mk.grp and b.base = mk.frame), nw as (select mk.grp, mk.frame, mk.x, mk.y from mk join fu using (grp, frame) join b on b.grp = mk.grp where usable and mk.frame > base and not exists (select 1 from bp where bp.grp = mk.grp and bp.x = mk.x and bp.y = mk.y)),
dd as (select nw.grp, frame, nw.x, nw.y, min(sqrt((nw.x - bp.x) ** 2 + (nw.y - bp.y) ** 2)) d from nw join bp on bp.grp = nw.grp group by all), ad as (select grp, frame, quantile_cont(d, 0.95) p, max(d) m from dd group by all)
;;
select grp, frame, case when usable and frame >= base then coalesce(p, 0) end advance_p95, case when usable and frame >= base then coalesce(m, 0) end advance_max from fu left join b using (grp) left join ad using (grp, frame)""", "advance_p95 advance_max", "grp frame")
def _(spark, d):
    return pixels.edge_advance(_mask(spark, d), _frames(spark, d), ["grp"]).select("grp", "frame", "advance_p95", "advance_max")


ARR = f"""{PX}, {MASK}, od as (select grp, frame, frame::double t, row_number() over (partition by grp order by frame) i from (select distinct grp, frame from px where frame % 7 <> 0)),
rn as (select grp, x, y, t, i - row_number() over (partition by grp, x, y order by i) rn from mk join od using (grp, frame)), ar as (select grp, x, y, min(t) arrival from (select grp, x, y, rn, min(t) t from rn group by all having count(*) >= 2) group by all)"""


def _arrivals(spark, d):
    return pixels.arrival_times(_mask(spark, d), _frames(spark, d).where("usable").drop("usable"), ["grp"], 2)


@query("arrival_times", f"with {ARR}\n;;\nselect grp, x, y, arrival from ar", "arrival", "grp x y")
def _(spark, d):
    return _arrivals(spark, d)


ORI = "og as (select grp, avg(x) x0, avg(y) y0 from ar where (grp, arrival) in (select (grp, min(arrival)) from ar group by grp) group by 1)"


@query("spread_origin", f"with {ARR}, {ORI}\n;;\nselect * from og", "x0 y0", "grp")
def _(spark, d):
    return pixels.spread_origin(_arrivals(spark, d), ["grp"])


SEC = f"""{ARR}, {ORI}, sp as (select grp, arrival, sqrt((x - x0) ** 2 + (y - y0) ** 2) d, (degrees(atan2(y - y0, x - x0)) + 360) % 360 a from ar join og using (grp)),
se as (select *, (floor(a / 90 + 0.5)::int) % 4 sector from sp), sf as (select * from se where abs((a - sector * 90 + 540) % 360 - 180) <= 45 or d = 0), tt as (select distinct grp, arrival t from ar),
fr as (select grp, sector, t, quantile_cont(d, 0.95) front from sf join tt using (grp) where arrival <= t group by all), ss as (select grp, sector, count(*) n, regr_slope(front, t) speed, regr_r2(front, t) r2, sqrt(greatest(regr_syy(front, t) - regr_slope(front, t) ** 2 * regr_sxx(front, t), 0) / (count(*) - 2) / regr_sxx(front, t)) se from fr where front > 0 group by all having count(*) >= 3)"""


def _speeds(spark, d):
    return pixels.sector_speeds(_arrivals(spark, d), ["grp"], 1.0, 4, 45.0)


@query("sector_speeds", f"with {SEC}\n;;\nselect grp, sector, n, speed, r2, se from ss", "speed r2 se", "grp sector n")
def _(spark, d):
    return _speeds(spark, d)


@query("radius_speed", f"with {ARR}, c as (select grp, arrival, sum(count(*)) over (partition by grp order by arrival) n from ar group by grp, arrival)\n;;\nselect grp, regr_slope(sqrt(n / pi()), arrival) radius_speed from c group by 1", "radius_speed", "grp")
def _(spark, d):
    return pixels.radius_speed(_arrivals(spark, d), ["grp"])


@query("anisotropy", f"with {SEC}\n;;\nselect grp, max(speed) filter (speed > 0) / min(speed) filter (speed > 0) ratio, avg(speed) mean_speed from ss group by 1", "ratio mean_speed", "grp")
def _(spark, d):
    return pixels.anisotropy(_speeds(spark, d), ["grp"]).drop("fastest")


@query("tile_scores")
def _(spark, d):
    return pixels.tile_scores(px_table(spark, d).select("frame", "x", "y", "g"), lambda pdf: (pdf["g"].to_numpy() - 110) / 20.0, 8, 8, 5, 2)


PROB = "pb as (select frame, grp, x, y, g / 255.0::double p, g >= 110 truth, r / 255.0::double p2 from px)"


def _prob(spark, d):
    return px_table(spark, d).select("frame", "grp", "x", "y", (F.col("g") / 255.0).alias("p"), (F.col("g") >= 110).alias("truth"), (F.col("r") / 255.0).alias("p2"))


@query("threshold_mask", f"with {PX}, {PROB}\n;;\nselect frame, variant, count(*) n from pb, (values ('nominal', 0.45::double), ('narrower', 0.6::double), ('wider', 0.3::double)) v(variant, t) where p >= t group by all")
def _(spark, d):
    return pixels.threshold_mask(_prob(spark, d).select("frame", "p"), 0.45, 0.15).groupBy("frame", "variant").agg(F.count(F.lit(1)).alias("n"))


# --- masks and labels --------------------------------------------------------------------------------------------------

CMP = f"{PX}, cm as (select frame, count(*) filter (g >= 110) area_a, count(*) filter (r >= 110) area_b, count(*) filter (g >= 110 and r >= 110) b2 from px where frame % 5 > 0 and frame % 3 > 0 group by 1), ci as (select frame, case when area_a + area_b - b2 = 0 then 1 else b2 / (area_a + area_b - b2) end iou, area_a, area_b, area_b - area_a difference from cm)"


def _compared(spark, d):
    p = px_table(spark, d)
    f = p.select("frame").distinct()
    return masks.compare_runs(p.where("g >= 110"), p.where("r >= 110"), f.where("frame % 5 > 0"), f.where("frame % 3 > 0"))


@query("compare_runs", f"with {CMP}\n;;\nselect frame, iou, area_a, area_b, difference from ci", "iou", "frame area_a area_b difference")
def _(spark, d):
    return _compared(spark, d)


@query("compare_summary", f"with {CMP}\n;;\nselect count(*) n, avg(iou) mean_iou, median(iou) median_iou, min(iou) min_iou, arg_min(frame, (iou, frame)) worst, avg(difference) mean_difference, stddev_samp(difference) sd_difference from ci", "mean_iou median_iou min_iou mean_difference sd_difference", "n worst")
def _(spark, d):
    return masks.compare_summary(_compared(spark, d))


MM = f"{LB}, mm as (select grp, source, count(*) filter (pred and truth) tp, count(*) filter (pred and not truth) fp, count(*) filter (not pred and truth) fn from lb group by all), mx as (select *, case when tp + fp + fn = 0 then 1 else tp / (tp + fp + fn) end iou, case when 2 * tp + fp + fn = 0 then 1 else 2 * tp / (2 * tp + fp + fn) end dice, case when tp + fn = 0 then 1 else tp / (tp + fn) end recall, case when tp + fp = 0 then case when tp + fn = 0 then 1 else 0 end else tp / (tp + fp) end as prec from mm)"


def _metrics(spark, d):
    return masks.mask_metrics(labelled(spark, d), ["grp", "source"], F.col("pred"), F.col("truth")).withColumnRenamed("precision", "prec")


@query("mask_metrics", f"with {MM}\n;;\nselect grp, source, tp, fp, fn, iou, dice, recall, prec from mx", "iou dice recall prec", "grp source tp fp fn")
def _(spark, d):
    return _metrics(spark, d)


@query("boundary_f1")
def _(spark, d):
    p = px_table(spark, d)
    return masks.boundary_f1(p.where("g >= 110"), p.where("r >= 110"), p.select("frame"), ["frame"], 1)


@query("metric_summary", f"with {MM}\n;;\nselect grp, count(*) n, avg(iou) mean_iou, min(iou) min_iou, avg(dice) mean_dice, min(dice) min_dice from mx group by 1", "mean_iou min_iou mean_dice min_dice", "grp n")
def _(spark, d):
    return masks.metric_summary(_metrics(spark, d), ["iou", "dice"], ["grp"])


@query("evaluate_labels", f"with {MM}, e as (select grp as class, source like 'src1%' in_train, iou from mx)\n;;\nselect class, in_train, grouping_id(class, in_train)::bigint level, count(*) n, avg(iou) mean_iou, min(iou) min_iou from e group by grouping sets ((), (in_train), (class), (class, in_train))", "mean_iou min_iou", "class in_train level n")
def _(spark, d):
    m = _metrics(spark, d).withColumn("class", F.col("grp")).withColumn("in_train", F.col("source").like("src1%"))
    return masks.evaluate_labels(m.select("class", "in_train", "iou"), ["iou"]).withColumn("level", F.col("level").cast("long"))


@query("tune_threshold", f"with {PX}, {PROB}, t as (select grp, t, count(*) filter (p2 * 100 >= t and truth) i, count(*) filter (p2 * 100 >= t or truth) u from pb, range(20, 81, 5) x(t) group by all), s as (select grp, t, case when u = 0 then 1 else i / u end iou from t)\n;;\nselect grp, t threshold_pct, iou from (select *, row_number() over (partition by grp order by iou desc, t) n from s) where n = 1", "iou", "grp threshold_pct")
def _(spark, d):
    return masks.tune_threshold(_prob(spark, d).select("grp", F.col("p2").alias("p"), "truth"), ["grp"]).withColumn("threshold_pct", F.col("threshold_pct").cast("long"))


@query("tta_disagreement", f"with {PX}, v as (select frame, count(*) filter (g >= 128 and r >= 128) i1, count(*) filter (g >= 128 or r >= 128) u1, count(*) filter (g >= 128 and b >= 128) i2, count(*) filter (g >= 128 or b >= 128) u2 from px group by 1)\n;;\nselect frame, 1 - ((case when u1 = 0 then 1 else i1 / u1 end) + (case when u2 = 0 then 1 else i2 / u2 end)) / 2 disagreement from v", "disagreement", "frame")
def _(spark, d):
    p = px_table(spark, d).select("frame", "x", "y", F.explode(F.create_map(F.lit("base"), F.col("g") / 256.0, F.lit("flip"), F.col("r") / 256.0, F.lit("turn"), F.col("b") / 256.0)).alias("variant", "p"))
    return masks.tta_disagreement(p, ["frame"])


@query("ambiguous_fraction", f"with {PX}, a as (select frame, count(*) filter (g between 65 and 191) a, count(*) filter (g >= 65) u from px group by 1)\n;;\nselect frame, case when a < 1 then 0 else a / greatest(u, 1) end ambiguous from a", "ambiguous", "frame")
def _(spark, d):
    return masks.ambiguous_fraction(px_table(spark, d).select("frame", "x", "y", (F.col("g") / 256.0).alias("p")), ["frame"])


SCORE = f"{PX}, cc as (select frame, any_value(grp) grp, count(*) filter (g >= 110 and r >= 110) i, count(*) filter (g >= 110 or r >= 110) u, count(*) filter (g between 65 and 191) a, count(*) filter (g >= 65) w from px group by 1), sc as (select frame, grp, 1 - case when u = 0 then 1 else i / u end dis, case when frame % 4 = 0 then null when a < 1 then 0 else a / greatest(w, 1) end amb from cc), su as (select frame, grp, case when amb is null then dis else (dis + amb) / 2 end score from sc)"


def _scores(spark, d):
    p = px_table(spark, d)
    f = p.select("frame").distinct()
    dis = masks.compare_runs(p.where("g >= 110"), p.where("r >= 110"), f, f).select("frame", (1 - F.col("iou")).alias("dis"))
    amb = masks.ambiguous_fraction(p.select("frame", "x", "y", (F.col("g") / 256.0).alias("p")), ["frame"]).withColumn("ambiguous", F.when(F.col("frame") % 4 != 0, F.col("ambiguous")))
    return p.select("frame", "grp").distinct().join(dis, "frame").join(amb, "frame").select("frame", "grp", "dis", masks.uncertainty_score(F.col("dis"), F.col("ambiguous")).alias("score"))


@query("uncertainty_score", f"with {SCORE}\n;;\nselect frame, score from su", "score", "frame")
def _(spark, d):
    return _scores(spark, d).select("frame", "score")


@query("run_disagreement", f"with {SCORE}\n;;\nselect frame, dis from sc", "dis", "frame")
def _(spark, d):
    return _scores(spark, d).select("frame", "dis")


@query("pick_diverse")
def _(spark, d):
    return masks.pick_diverse(_scores(spark, d).select("grp", F.col("frame").alias("pos"), "score"), ["grp"], 5, 3)


@query("rank_items", "select conv_id, turn, row_number() over (partition by conv_id order by case when turn % 3 > 0 then length(text) end desc nulls last, turn, role, text) as rank from conversations")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 > 0, F.length("text")).alias("priority"), F.struct("turn", "role", "text").alias("pos"))
    return masks.rank_items(c, ["conv_id"]).select("conv_id", "turn", F.col("rank").cast("long").alias("rank"))


@query("input_distance")
def _(spark, d):
    h, s, v = pixels.bgr_to_hsv()
    f = px_table(spark, d).withColumns({"h": h, "s": s, "v": v}).groupBy("frame").agg(F.avg("v").alias("f0"), F.stddev_pop("v").alias("f1"), F.avg("s").alias("f2"), F.stddev_pop("s").alias("f3"))
    cols = ["f0", "f1", "f2", "f3"]
    return masks.input_distance(f, cols, masks.input_profile(f.where("frame % 2 = 0"), cols)).select("frame", "distance", "flag")


@query("split_items", f"with {LB}, z as (select grp, count(*) n from lb group by 1), o as (select grp, n, coalesce(sum(n) over (order by n, grp rows between unbounded preceding and 1 preceding), 0) before, row_number() over (order by n, grp) i, count(*) over () k, sum(n) over () as total from z)\n;;\nselect id, before < greatest(round_even(0.2 * total, 0), 1) and i < k validation from lb join o using (grp)")
def _(spark, d):
    return masks.split_items(labelled(spark, d).withColumn("ts", F.col("id")), 0.2).select("id", "validation")


@query("dataset_stats", f"with {LB}\n;;\nselect grp, count(*) items, count(*) filter (truth) reviewed, avg(n_chars / 100.0) mean_target_pct from lb group by 1", "mean_target_pct", "grp items reviewed")
def _(spark, d):
    return masks.dataset_stats(labelled(spark, d).select("grp", F.col("truth").alias("reviewed"), (F.col("n_chars") / 100.0).alias("target_pct")))


@query("dataset_fingerprint", "with h as (select source, substr(sha256(doc_id::varchar), 1, 2) b, doc_id::varchar || ':' || sha256(text) x from documents), g as (select source, b, sha256(string_agg(x, chr(10) order by x)) h from h group by all)\n;;\nselect source, sha256(string_agg(h, chr(10) order by b)) fingerprint from g group by 1")
def _(spark, d):
    i = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"))
    return masks.dataset_fingerprint(i, ["source"])


@query("pair_labels", "select 'img/d' || d.doc_id || '.jpg' file, case when l.doc_id is not null then 'mask/d' || d.doc_id || '.png' end mask, l.doc_id is null missing from documents d left join (select distinct doc_id from labels) l using (doc_id)")
def _(spark, d):
    images = table(spark, d, "documents").select(F.concat(F.lit("img/d"), "doc_id", F.lit(".jpg")).alias("file"))
    m = table(spark, d, "labels").select(F.concat(F.lit("mask/d"), "doc_id", F.lit(".png")).alias("file"))
    return masks.pair_labels(images, m).select("file", "mask", "missing")


@query("export_labels_from_run", f"with {PX}, h as (select grp, frame, row_number() over (partition by grp order by frame) - 1 pos, count(*) over (partition by grp) n from (select distinct grp, frame from px where g >= 110)), c as (select distinct grp, round_even(i * (n - 1) / 5.0, 0)::bigint pos from (select distinct grp, n from h), range(6) r(i))\n;;\nselect grp, frame id, false reviewed from h where (n <= 6 or exists (select 1 from c where c.grp = h.grp and c.pos = h.pos)) and frame % 4 <> 0")
def _(spark, d):
    p = px_table(spark, d)
    f = p.select("grp", "frame").distinct().withColumn("ts", F.col("frame"))
    return masks.export_labels_from_run(f, p.where("g >= 110").select("frame"), f.where("frame % 4 = 0").select(F.col("frame").alias("id")), ["grp"], 6).select("grp", "id", "reviewed")


@query("pack_class_bits", f"with {PX}\n;;\nselect frame, x, y, (g >= 110)::int + 2 * (r >= 110)::int + 4 * (b >= 110)::int raw from px where g >= 110 or r >= 110 or b >= 110", "", "frame x y raw")
def _(spark, d):
    p = px_table(spark, d).select("frame", "x", "y", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate("grb")))).alias("c")).where("c.v >= 110")
    return masks.pack_class_bits(p.select("frame", "x", "y", "c.k"), ["frame", "x", "y"])


@query("class_layer", f"with {PX}\n;;\nselect frame, count(*) filter (b % 8 >= 4) layer2, sum((b % 8) & 5 | case when g >= 110 then 2 else 0 end)::bigint replaced from px group by 1")
def _(spark, d):
    raw = F.col("b") % 8
    return px_table(spark, d).groupBy("frame").agg(F.count_if(masks.class_layer(raw, 2)).alias("layer2"), F.sum(masks.replace_class(raw, 1, F.col("g") >= 110)).alias("replaced"))


RLE = f"{PX}, pp as (select frame, x::bigint * 8 + y p from px where g >= 110), rr as (select frame, p - row_number() over (partition by frame order by p) q, p from pp), rl as (select frame, min(p) s, count(*) n from rr group by frame, q)"


@query("rle_runs", f"with {RLE}\n;;\nselect frame, s as start, n as length from rl", "", 'frame "start" "length"')
def _(spark, d):
    return masks.rle_runs(_mask(spark, d), 8, ["frame"]).select("frame", "start", "length")


@query("rle_to_pixels", f"with {PX}\n;;\nselect frame, x, y from px where g >= 110", "", "frame x y")
def _(spark, d):
    return masks.rle_to_pixels(masks.rle_counts(masks.rle_runs(_mask(spark, d), 8, ["frame"]), 64, ["frame"]), 8, ["frame"])


#: The variants' looks as a mask each (frame * 10 + look), cleaned, and the axis from (0, 7) up to (0, 0).
_LOOKS = " union all ".join(f"select frame * 10 + {i} frame, x, y from hs where {SHIFTED['green'][step]}" for i, step in enumerate((0, 1, -1)))
_SEEN = " union all ".join(f"select '{name}' variant, {p} p, frame // 10 frame, x, y from {source} where frame % 10 = {i}" for name, source, i, p in (("baseline", "cl", 0, 0.5), ("hsv_wider", "cl", 1, 0.5), ("hsv_narrower", "cl", 2, 0.5), ("no_cleanup", "mk", 0, 0.5), ("front_25", "cl", 0, 0.25), ("front_75", "cl", 0, 0.75)))
VARIANTS = f"""with recursive {HSV}, mk as ({_LOOKS}), {CLEAN}, sn as ({_SEEN}),
st as (select variant, p, frame, x, greatest(max(7.5::double - y), 0) front, count(*) n from sn group by all), ex as (select variant, frame, sum(n)::bigint target_px, case any_value(p) when 0.25 then quantile_cont(front, 0.25) when 0.75 then quantile_cont(front, 0.75) else quantile_cont(front, 0.5) end extent_px from st group by all),
vs as (select * from (values ('baseline'), ('hsv_wider'), ('hsv_narrower'), ('no_cleanup'), ('front_25'), ('front_75')) v(variant)), fm as (select distinct frame, grp from px),
vr as (select variant, frame, grp, coalesce(target_px, 0)::bigint target_px, 100.0 * coalesce(target_px, 0) / 64 coverage_pct, extent_px from (select * from vs, fm) left join ex using (variant, frame))"""


def _variant_rows(spark, d):
    grid = series.variant_grid(spark, ["hsv", "cleanup", "front"])
    return variants.measure_variants(px_table(spark, d), grid, GREEN, (0.0, 7.0), (0.0, 0.0), 8, 8, key=["frame", "grp"])


@query("variant_runs", f"{VARIANTS}\n;;\nselect variant, frame, target_px, coverage_pct, extent_px from vr", "coverage_pct extent_px", "variant frame target_px")
def _(spark, d):
    return _variant_rows(spark, d).select("variant", "frame", "target_px", "coverage_pct", "extent_px")


@query("variant_sensitivity", f"""{VARIANTS}, vb as (select v.variant, v.grp, v.frame, v.extent_px - b.extent_px dd from vr v join vr b on b.frame = v.frame and b.variant = 'baseline' where v.variant <> 'baseline' and v.extent_px is not null and b.extent_px is not null)
;;
select grp, variant, count(*) n, avg(abs(dd)) mean_abs, max(abs(dd)) max_abs, avg(dd) mean_change, arg_max(dd, frame) last_change from vb group by all""", "mean_abs max_abs mean_change last_change", "grp variant n")
def _(spark, d):
    rows = _variant_rows(spark, d).select("grp", "variant", F.col("frame").cast("string").alias("frame_file"), F.col("frame").alias("ts"), F.col("extent_px").alias("y"), F.lit(None).cast("double").alias("unc"), F.lit(False).alias("excluded"))
    return series.sensitivity_compare(rows, "baseline", ["grp"]).where("n > 0").select("grp", "variant", "n", "mean_abs", "max_abs", "mean_change", "last_change")


_BEND = "(case when {0} > 0.008856 then cbrt({0}) else 7.787 * {0} + 16.0 / 116 end)"
_SRGB = ", ".join(f"case when {c} / 255.0 > 0.04045 then pow(({c} / 255.0 + 0.055) / 1.055, 2.4) else {c} / 255.0 / 12.92 end l{c}" for c in "bgr")
LAB = f"""xy as (select *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 cx, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb cy, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 cz from (select *, {_SRGB} from hs)),
la as (select frame, x, y, s, floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5) gr, greatest(least(floor((case when cy > 0.008856 then 116 * cbrt(cy) - 16 else 903.3 * cy end) * 2.55 + 0.5), 255), 0) l1, floor(500 * ({_BEND.format("cx")} - {_BEND.format("cy")}) + 128.5) a1, floor(200 * ({_BEND.format("cy")} - {_BEND.format("cz")}) + 128.5) b1 from xy),
sd as (select a.*, u.gr gu, o.gr go, l.gr gl, i.gr gi from la a join la u on u.frame = a.frame and u.x = a.x and u.y = abs(a.y - 1) join la o on o.frame = a.frame and o.x = a.x and o.y = 7 - abs(6 - a.y) join la l on l.frame = a.frame and l.y = a.y and l.x = abs(a.x - 1) join la i on i.frame = a.frame and i.y = a.y and i.x = 7 - abs(6 - a.x))"""


@query("image_features", f"with {HSV}, {LAB}\n;;\nselect frame, avg(l1) lightness_mean, stddev_pop(l1) lightness_sd, avg(a1) a_mean, stddev_pop(a1) a_sd, avg(b1) b_mean, stddev_pop(b1) b_sd, avg(s) saturation_mean, avg(abs(gu + go + gl + gi - 4 * gr)) texture from sd group by 1", " ".join(masks.FEATURES), "frame")
def _(spark, d):
    return masks.image_features(px_table(spark, d))


@query("unfamiliar_images")
def _(spark, d):
    """Distance of every image from the even ones, by all eight features."""
    f = settled(masks.image_features(px_table(spark, d)))
    return masks.input_distance(f, masks.FEATURES, masks.input_profile(f.where("frame % 2 = 0"), masks.FEATURES)).select("frame", "distance", "flag")


_TWO = "ml as (select frame, 'green' class, 1 category_id, x, y from px where g >= 110 union all select frame, 'red', 2, x, y from px where r >= 128)"


@query("coco_tables", f"""with {PX}, {_TWO},
al as (select k.frame, k.category_id, i, case when ml.x is null then 0 else 1 end v from (select distinct frame, category_id from ml) k cross join (select unnest(range(64)) i) left join ml on ml.frame = k.frame and ml.category_id = k.category_id and ml.x * 8 + ml.y = i),
ch as (select *, case when v <> lag(v, 1, 0) over (partition by frame, category_id order by i) then 1 else 0 end c from al), il as (select *, sum(c) over (partition by frame, category_id order by i) k from ch),
rn as (select frame, category_id, k, count(*) n, min(v) v from il group by all), ct as (select frame, category_id, case when min(k) = 0 then '' else '0 ' end || string_agg(n::varchar, ' ' order by k) counts from rn group by all),
im as (select frame, row_number() over (order by 'f' || frame)::bigint image_id from (select distinct frame from ml))
;;
select row_number() over (order by image_id, category_id)::bigint id, image_id, category_id, area, bbox, counts from (select frame, category_id, count(*) area, [min(x), min(y), max(x) - min(x) + 1, max(y) - min(y) + 1] bbox from ml group by all) join ct using (frame, category_id) join im using (frame)""", "", "id image_id category_id area bbox counts")
def _(spark, d):
    p = px_table(spark, d).withColumn("class", F.explode(F.filter(F.array(F.when(F.col("g") >= 110, F.lit("green")), F.when(F.col("r") >= 128, F.lit("red"))), lambda c: c.isNotNull())))
    marks = coco_tables(p.select(F.concat(F.lit("f"), "frame").alias("file"), "class", "x", "y"), ["green", "red"], 8, 8, 1000)[1]
    return marks.select("id", "image_id", "category_id", "area", "bbox", F.array_join("counts", " ").alias("counts"))


@query("coco_read", f"with {PX}, {_TWO}\n;;\nselect 'f' || frame as file, case category_id when 1 then 'green' else 'red' end as class, x, y from ml", "", "file class x y")
def _(spark, d):
    """Masks written as COCO documents with compressed run lengths and read back: the pixels they were made of."""
    p = px_table(spark, d).withColumn("class", F.explode(F.filter(F.array(F.when(F.col("g") >= 110, F.lit("green")), F.when(F.col("r") >= 128, F.lit("red"))), lambda c: c.isNotNull())))
    path = f"{shared_dir(spark)}/verdance-coco-{uuid.uuid4().hex}"
    coco_write(p.select(F.concat(F.lit("f"), "frame").alias("file"), "class", "x", "y"), ["green", "red"], 8, 8, path, 1000, compressed=True)
    return coco_read(spark, path, ["green", "red"])[0].select("file", "class", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


@query("stream_measure", f"with {PX}, st as (select 'g110' settings_hash, 110 low union all select 'g140', 140)\n;;\nselect settings_hash, frame::varchar as frame_file, sum(case when g >= low then 1 else 0 end)::bigint n from px cross join st group by all", "", "settings_hash frame_file n")
def _(spark, d):
    """Frames that arrive twice, measured once for each of two settings, by streams that are started again after more came."""
    home = f"{shared_dir(spark)}/measure-{uuid.uuid4().hex}"
    px = px_table(spark, d).select(F.col("frame").cast("string").alias("frame_file"), "g")
    frames = settled(px.select("frame_file").distinct())

    def run(low: int) -> None:
        def measure(df):
            return df.select("frame_file").join(px, "frame_file").groupBy("frame_file").agg(F.count_if(F.col("g") >= low).alias("n"))

        stream = spark.readStream.schema(frames.schema).parquet(f"{home}/frames")
        live.stream_measure(stream, measure, f"{home}/out/{low}", f"g{low}", f"{home}/checkpoint/{low}", "frame_file string, n long").awaitTermination()

    with live.keyed_state(spark):
        frames.where(F.crc32("frame_file") % 2 == 0).write.parquet(f"{home}/frames")
        run(110)
        frames.write.mode("append").parquet(f"{home}/frames")
        run(110)
        run(140)
    return spark.read.option("recursiveFileLookup", True).parquet(f"{home}/out").select("settings_hash", "frame_file", "n")


@query("image_pixels", "with dt as (select doc_id, hex(encode(text)) h from documents where length(text) > 0), sz as (select *, 1 + doc_id % 7 w, length(h) // 2 n from dt)\n;;\nselect path, count(*) n, sum(b * (1 + x))::bigint by_x, sum(b * (1 + y))::bigint by_y, max(y) last from (select doc_id as path, (i % w)::int x, (i // w)::int y, ('0x' || substr(h, 2 * i + 1, 2))::int b from (select doc_id, h, w, unnest(range(w * (n // w))) i from sz)) group by 1", "", "path n by_x by_y last")
def _(spark, d):
    """Every text's bytes as a grey image of 1 to 7 columns, taken apart in strips of 16 pixels."""
    size = table(spark, d, "documents").where("length(text) > 0").select(F.col("doc_id").alias("path"), (1 + F.col("doc_id") % 7).cast("int").alias("width"), F.encode("text", "UTF-8").alias("data"))
    grey = size.withColumns({"height": F.floor(F.length("data") / F.col("width")).cast("int"), "channels": F.lit(1)})
    grey = grey.withColumn("data", F.substring("data", F.lit(1), F.col("width") * F.col("height")))
    px = image_pixels(grey, 16)
    return px.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b") * (1 + F.col("x"))).alias("by_x"), F.sum(F.col("b") * (1 + F.col("y"))).alias("by_y"), F.max("y").alias("last"))


@query("tile_predictions", f"with {PX}\n;;\nselect frame, x, y, 1 / (1 + exp(-((g - 110) / 32.0))) p from px", "p", "frame x y")
def _(spark, d):
    """A model that looks at one pixel at a time gives the same logit in every tile, so blending leaves it."""
    return pixels.tile_predictions(px_table(spark, d), lambda: lambda tiles: (tiles[..., 1] - 110) / 32, 8, 8, 6, 2, batch=64)


@query("coco_annotations", f"with {PX}\n;;\nselect frame, count(*) area, [min(x), min(y), max(x) - min(x) + 1, max(y) - min(y) + 1] bbox from px where g >= 110 group by 1", "", "frame area bbox")
def _(spark, d):
    return coco_annotations(_mask(spark, d), ["frame"], 8, 8).select("frame", "area", "bbox")
