"""Comparing masks, scoring labels, choosing what to label next, splitting and exporting label sets."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick_evenly


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / F.nullif(b, F.lit(0)))


def compare_runs(a: DataFrame, b: DataFrame, frames_a: DataFrame, frames_b: DataFrame) -> DataFrame:
    """Per frame that both runs have: intersection over union (both empty: 1), areas and their difference."""
    both = frames_a.select("frame").intersect(frames_b.select("frame"))
    side = lambda m, n: m.select("frame", "x", "y").distinct().withColumn(n, F.lit(1))
    px = side(a, "a").join(side(b, "b"), ["frame", "x", "y"], "full").groupBy("frame").agg(F.count("a").alias("area_a"), F.count("b").alias("area_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))
    out = both.join(px, "frame", "left").fillna(0, ["area_a", "area_b", "both"])
    return out.select("frame", _ratio(F.col("both"), F.col("area_a") + F.col("area_b") - F.col("both"), 1.0).alias("iou"), "area_a", "area_b", (F.col("area_b") - F.col("area_a")).alias("difference"))


def compare_summary(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count(F.lit(1)).alias("n"), F.avg("iou").alias("mean_iou"), F.percentile("iou", 0.5).alias("median_iou"), F.min("iou").alias("min_iou"), F.min(F.struct("iou", "frame"))["frame"].alias("worst"), F.avg("difference").alias("mean_difference"), F.stddev_samp("difference").alias("sd_difference"))


def mask_metrics(rows: DataFrame, by: Sequence[str], predicted: Column, truth: Column) -> DataFrame:
    """tp, fp, fn, iou, dice, precision, recall of rows that are pixels (or items) with two booleans."""
    g = rows.groupBy(*by).agg(F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & truth).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.withColumns({
        "iou": _ratio(tp, tp + fp + fn, 1.0), "dice": _ratio(2 * tp, 2 * tp + fp + fn, 1.0), "recall": _ratio(tp, tp + fn, 1.0),
        "precision": F.when(tp + fp == 0, F.when(tp + fn == 0, 1.0).otherwise(0.0)).otherwise(tp / F.nullif(tp + fp, F.lit(0))),
    })


def boundary(mask: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mask pixels that have one of their eight neighbours outside the mask."""
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    m = mask.select(*by, "x", "y").distinct()
    votes = m.select(*by, "x", "y", around.alias("o")).select(*by, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return m.join(votes.where("n = 9"), [*by, "x", "y"], "left_anti")


def boundary_f1(predicted: DataFrame, truth: DataFrame, items: DataFrame, by: Sequence[str], reach: int = 2) -> DataFrame:
    """F1 of the boundaries' pixels that have one of the other boundary within `reach` pixels, by the finite list of such
    offsets and equality joins. Both empty: 1, one empty: 0."""
    offs = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a * a + b * b <= reach * reach]
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in offs)))
    p, t = boundary(predicted, by), boundary(truth, by)
    grown = lambda m: m.select(*by, "x", "y", o.alias("o")).select(*by, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).distinct()
    count = lambda m, n: m.groupBy(*by).agg(F.count(F.lit(1)).alias(n))
    out = items.select(*by).distinct()
    for m, n in ((p, "np"), (t, "nt"), (p.join(grown(t), [*by, "x", "y"], "left_semi"), "hp"), (t.join(grown(p), [*by, "x", "y"], "left_semi"), "ht")):
        out = out.join(count(m, n), list(by), "left")
    out = out.fillna(0, ["np", "nt", "hp", "ht"])
    pr, rc = F.col("hp") / F.nullif("np", F.lit(0)), F.col("ht") / F.nullif("nt", F.lit(0))
    f1 = F.when((F.col("np") == 0) & (F.col("nt") == 0), 1.0).when((F.col("np") == 0) | (F.col("nt") == 0) | (pr + rc == 0), 0.0).otherwise(2 * pr * rc / F.nullif(pr + rc, F.lit(0.0)))
    return out.select(*by, f1.alias("boundary_f1"))


def metric_summary(metrics: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("min", F.min))))


def evaluate_labels(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Summary over all items, those outside the training set and in it, and per class: grouping sets in one job.
    metrics(class, in_train, ...)."""
    sets = metrics.groupingSets([[], [F.col("in_train")], [F.col("class")], [F.col("class"), F.col("in_train")]], F.col("class"), F.col("in_train"))
    return sets.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("min", F.min))))


def tune_threshold(scores: DataFrame, by: Sequence[str] = (), low: int = 20, high: int = 80, step: int = 5) -> DataFrame:
    """scores(by, p, truth): the threshold (percent) with the best pooled intersection over union, the lowest on ties."""
    t = F.explode(F.array(*(F.lit(k) for k in range(low, high + 1, step))))
    hit = F.col("p") * 100 >= F.col("t")
    g = scores.withColumn("t", t).groupBy(*by, "t").agg(F.count_if(hit & F.col("truth")).alias("i"), F.count_if(hit | F.col("truth")).alias("u")).withColumn("iou", _ratio(F.col("i"), F.col("u"), 1.0))
    return g.groupBy(*by).agg(F.max(F.struct("iou", (-F.col("t")).alias("t"))).alias("b")).select(*by, (-F.col("b.t")).alias("threshold_pct"), F.col("b.iou").alias("iou"))


def tta_disagreement(prob: DataFrame, by: Sequence[str], base: str = "base", threshold: float = 0.5) -> DataFrame:
    """1 - the mean intersection over union of the base mask and each augmented prediction's. prob(by, variant, x, y, p)."""
    own = prob.where(F.col("variant") == base).select(*by, "x", "y", (F.col("p") >= threshold).alias("m0"))
    other = prob.where(F.col("variant") != base).join(own, [*by, "x", "y"]).withColumn("m", F.col("p") >= threshold)
    g = other.groupBy(*by, "variant").agg(F.count_if(F.col("m") & F.col("m0")).alias("i"), F.count_if(F.col("m") | F.col("m0")).alias("u"))
    return g.groupBy(*by).agg((1 - F.avg(_ratio(F.col("i"), F.col("u"), 1.0))).alias("disagreement"))


def ambiguous_fraction(prob: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pixels of mean p in (0.25, 0.75), over them and the predicted ones (a floor of 0.1 % of all, 1 at least); 0 under
    the floor."""
    m = prob.groupBy(*by, "x", "y").agg(F.avg("p").alias("p"))
    mid = (F.col("p") > 0.25) & (F.col("p") < 0.75)
    g = m.groupBy(*by).agg(F.count_if(mid).alias("a"), F.count_if(mid | (F.col("p") >= 0.5)).alias("u"), F.greatest(F.lit(1), F.floor(0.001 * F.count(F.lit(1)))).alias("floor"))
    return g.select(*by, F.when(F.col("a") < F.col("floor"), 0.0).otherwise(F.col("a") / F.greatest("u", "floor")).alias("ambiguous"))


def uncertainty_score(*parts: Column) -> Column:
    """Mean of the parts that aren't null."""
    have = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda a, b: a + b) / F.size(have))


def pick_diverse(scored: DataFrame, by: Sequence[str], k: int, min_gap: int) -> DataFrame:
    """Up to k rows of each group (item, whole pos, score) by score, no two within min_gap positions; the gap is given up
    if too few are left. A pick shuts out 2 min_gap - 1 positions and of a position only the best row is picked with the
    gap, so that the rows kept for picking are enough for the same picks as from all."""
    best = F.desc_nulls_last("score")
    w, own = Window.partitionBy(*by).orderBy(best, "pos"), Window.partitionBy(*by, "pos").orderBy("r")
    ranked = scored.where("score is not null").withColumn("r", F.row_number().over(w)).withColumn("lead", F.row_number().over(own) == 1)
    leads = F.sum(F.col("lead").cast("int")).over(Window.partitionBy(*by).orderBy("r"))
    top = ranked.withColumn("leads", leads).where((F.col("r") <= k) | F.col("lead") & (F.col("leads") <= (k - 1) * max(2 * min_gap - 1, 1) + 1)).drop("lead", "leads")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, chosen = pdf.sort_values("r"), []
        for gap in (min_gap, 0):
            for i, p in zip(pdf.index, pdf["pos"], strict=True):
                if len(chosen) < k and i not in chosen and all(abs(p - pdf["pos"][j]) >= gap for j in chosen):
                    chosen.append(i)
        return pdf.loc[chosen].assign(pick=range(1, len(chosen) + 1)).drop(columns="r")

    schema = top.drop("r").schema.add("pick", "integer")
    return top.groupBy(*by).applyInPandas(pick, schema)


def rank_items(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last("priority"), "pos")
    return items.withColumn("rank", F.row_number().over(w))


FEATURES = ["f0", "f1", "f2", "f3", "f4", "f5", "f6", "f7"]


FEATURES = ("lightness_mean", "lightness_sd", "a_mean", "a_sd", "b_mean", "b_sd", "saturation_mean", "texture")


def shrink_images(pixels: DataFrame, key: Sequence[str] = ("frame",), side: int = 512) -> DataFrame:
    """pixels(key, x, y, b, g, r) of images whose longer side is at most `side`: larger ones by area averaging, each new pixel
    the mean of what it covers, in parts where it cuts pixels, rounded."""
    size = pixels.groupBy(*key).agg((F.max("x") + 1).alias("__w"), (F.max("y") + 1).alias("__h"))
    long = F.greatest("__w", "__h")
    new = lambda c: F.when(long > side, F.greatest(F.bround(F.col(c) * (F.lit(float(side)) / long)), F.lit(1))).otherwise(F.col(c)).cast("double")
    fit = pixels.join(size, list(key)).withColumns({"__fx": new("__w") / F.col("__w"), "__fy": new("__h") / F.col("__h")})
    # a pixel lies in one or two new columns, and rows; the last place keeps what rounding moves beyond the edge
    def parts(c: str, f: str) -> Column:
        lo, hi = F.col(c) * F.col(f), (F.col(c) + 1) * F.col(f)
        cut = F.floor(lo + 1e-9) + 1
        whole = F.array(F.struct((cut - 1).cast("int").alias("at"), F.least(hi, cut).alias("end"), lo.alias("start")))
        rest = F.array(F.struct(cut.cast("int").alias("at"), hi.alias("end"), cut.cast("double").alias("start")))
        return F.when(hi > cut + 1e-9, F.concat(whole, rest)).otherwise(whole)

    split = fit.withColumn("__x", F.explode(parts("x", "__fx"))).withColumn("__y", F.explode(parts("y", "__fy")))
    weight = (F.col("__x.end") - F.col("__x.start")) * (F.col("__y.end") - F.col("__y.start"))
    mean = lambda c: F.bround(F.round(F.sum(F.col(c) * weight) / F.sum(weight), 9)).cast("int").alias(c)
    return split.groupBy(*key, F.col("__x.at").alias("x"), F.col("__y.at").alias("y")).agg(mean("b"), mean("g"), mean("r"))


def bgr_to_lab(b: str = "b", g: str = "g", r: str = "r") -> tuple[Column, Column, Column]:
    """8-bit L (0-255 for 0-100), a and b (each plus 128) of sRGB values under D65."""
    line = lambda c: F.when(F.col(c) / 255 > 0.04045, F.pow((F.col(c) / 255 + 0.055) / 1.055, F.lit(2.4))).otherwise(F.col(c) / 255 / 12.92)
    red, green, blue = line(r), line(g), line(b)
    # fixed values: sRGB to XYZ, divided by the white point
    x = (0.412453 * red + 0.357580 * green + 0.180423 * blue) / 0.950456
    y = 0.212671 * red + 0.715160 * green + 0.072169 * blue
    z = (0.019334 * red + 0.119193 * green + 0.950227 * blue) / 1.088754
    bend = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    light = F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    byte = lambda v: F.least(F.greatest(F.floor(v + 0.5), F.lit(0)), F.lit(255)).cast("int")
    return byte(light * 255 / 100), byte(500 * (bend(x) - bend(y)) + 128), byte(200 * (bend(y) - bend(z)) + 128)


def image_features(pixels: DataFrame, key: Sequence[str] = ("frame",), side: int = 512) -> DataFrame:
    """key and FEATURES of every image of pixels(key, x, y, b, g, r), seen at most `side` pixels large: mean and spread of
    lightness and the two colour axes (8-bit Lab), mean saturation, and mean size of the grey level's Laplacian."""
    from .pixels import bgr_to_hsv, laplacian

    small = laplacian(shrink_images(pixels.select(*key, "x", "y", "b", "g", "r"), key, side), list(key))
    (light, a, b), (_, s, _) = bgr_to_lab(), bgr_to_hsv()
    each = small.select(*key, light.alias("l"), a.alias("a_"), b.alias("b_"), s.alias("s"), "lap")
    values = [F.avg("l"), F.stddev_pop("l"), F.avg("a_"), F.stddev_pop("a_"), F.avg("b_"), F.stddev_pop("b_"), F.avg("s"), F.avg(F.abs("lap"))]
    return each.groupBy(*key).agg(*(v.alias(n) for v, n in zip(values, FEATURES, strict=True)))


def input_profile(features: DataFrame, columns: Sequence[str]) -> tuple[list[float], list[list[float]], float]:
    """Mean, inverse covariance (shrunk to its diagonal by min(1, d/n), with 1e-6 max(trace, 1) added) and distance limit of
    training images: sums of products in Spark, a d x d matrix on the driver."""
    import numpy as np

    d = len(columns)
    sums = features.agg(F.count(F.lit(1)), *(F.avg(c) for c in columns), *(F.covar_samp(a, b) for a in columns for b in columns)).first()
    n, mean, cov = sums[0], list(sums[1 : d + 1]), np.array(sums[d + 1 :], dtype=float).reshape(d, d)
    cov = np.nan_to_num(cov)
    shrink = min(1.0, d / max(n, 1))
    cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + 1e-6 * max(np.trace(cov), 1.0) * np.eye(d)
    inverse = np.linalg.inv(cov).tolist()
    top = features.agg(F.max(mahalanobis(columns, mean, inverse))).first()[0] or 0.0
    return mean, inverse, max(1.5 * top, 26.12**0.5)


def mahalanobis(columns: Sequence[str], mean: Sequence[float], inverse: Sequence[Sequence[float]]) -> Column:
    z = [F.col(c) - m for c, m in zip(columns, mean, strict=True)]
    total = F.lit(0.0)
    for i, a in enumerate(z):
        for j, b in enumerate(z):
            total = total + a * b * float(inverse[i][j])
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def input_distance(features: DataFrame, columns: Sequence[str], profile: tuple) -> DataFrame:
    mean, inverse, limit = profile
    return features.withColumn("distance", mahalanobis(columns, mean, inverse)).withColumn("flag", F.when(F.col("distance") > limit, F.lit("unfamiliar_input")))


def split_items(items: DataFrame, fraction: float, groups: Sequence[str] | None = None) -> DataFrame:
    """items(id, grp, ts) with validation: the given groups; or whole groups, the smallest first, until round(fraction n)
    items, one group at least stays; a single group gives its last share in time."""
    if groups is not None:
        return items.withColumn("validation", F.col("grp").isin(list(groups)))
    sizes = items.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    w = Window.orderBy("n", "grp")  # counts, one row a group: the order over all groups is what is asked for
    need = F.greatest(F.bround(fraction * F.col("all")), F.lit(1))
    marked = sizes.crossJoin(F.broadcast(total)).withColumns({"before": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "i": F.row_number().over(w)})
    marked = marked.select("grp", F.col("n").alias("__n"), "k", "all", ((F.col("before") < need) & (F.col("i") < F.col("k"))).alias("chosen"))
    last = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("ts"), F.desc("id")))
    out = items.join(marked, "grp").withColumn("__r", F.when(F.col("k") == 1, last))
    return out.withColumn("validation", F.when(F.col("k") == 1, F.col("__r") <= need).otherwise(F.col("chosen"))).drop("__n", "k", "all", "chosen", "__r")


def dataset_stats(items: DataFrame) -> DataFrame:
    return items.groupBy("grp").agg(F.count(F.lit(1)).alias("items"), F.count_if("reviewed").alias("reviewed"), F.avg("target_pct").alias("mean_target_pct"))


def dataset_fingerprint(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """SHA-256 over the ids and content hashes in id order; one hash per bucket of ids first, so that no task holds a whole
    data set's strings."""
    bucket = items.withColumn("__b", F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 2)).groupBy(*by, "__b").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", F.col("id").cast("string"), "sha")))), 256).alias("h"))
    return bucket.groupBy(*by).agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("__b", "h"))), lambda x: x["h"])), 256).alias("fingerprint"))


def pair_labels(images: DataFrame, masks: DataFrame) -> DataFrame:
    """images(file) with mask: the file of the same stem, and missing where there is none."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")
    m = masks.groupBy(stem(F.col("file")).alias("stem")).agg(F.min("file").alias("mask"))
    return images.withColumn("stem", stem(F.col("file"))).join(m, "stem", "left").select("file", "stem", "mask", F.col("mask").isNull().alias("missing"))


def export_labels_from_run(frames: DataFrame, masked: DataFrame, present: DataFrame, by: Sequence[str], count: int) -> DataFrame:
    """Evenly spaced frames that have a mask and are not in the set yet, as items that nobody has reviewed."""
    have = frames.join(masked.select("frame").distinct(), "frame", "left_semi")
    picked = pick_evenly(have, by, ["ts", "frame"], count)
    return picked.join(present.select(F.col("id").alias("frame")), "frame", "left_anti").select(*by, F.col("frame").alias("id"), "ts", F.lit(False).alias("reviewed"))


def pack_class_bits(layers: DataFrame, by: Sequence[str], class_index: str = "k") -> DataFrame:
    """One integer per pixel, a bit for each class (0 to 7) that covers it."""
    return layers.groupBy(*by).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col(class_index).cast("int"))).alias("raw"))


def class_layer(packed: Column, k: int) -> Column:
    return F.shiftright(packed, k).bitwiseAND(1) == 1


def replace_class(packed: Column, k: int, value: Column) -> Column:
    """The bits with one class replaced."""
    return packed.bitwiseAND(~(1 << k) & 0xFF).bitwiseOR(F.when(value, F.lit(1 << k)).otherwise(0))


def rle_runs(mask: DataFrame, height: int, by: Sequence[str]) -> DataFrame:
    """by, start, length: runs of target pixels in column-major order (x * height + y)."""
    p = mask.select(*by, (F.col("x").cast("long") * height + F.col("y")).alias("p")).distinct()
    p = p.withColumn("run", F.col("p") - F.row_number().over(Window.partitionBy(*by).orderBy("p")))
    return p.groupBy(*by, "run").agg(F.min("p").alias("start"), F.count(F.lit(1)).alias("length")).drop("run")


def rle_counts(runs: DataFrame, size: int, by: Sequence[str]) -> DataFrame:
    """by and counts: lengths of background and target in turn, background first, for an image of `size` pixels."""
    w = Window.partitionBy(*by).orderBy("start")
    gap = runs.withColumn("gap", F.col("start") - F.coalesce(F.lag(F.col("start") + F.col("length")).over(w), F.lit(0)))
    g = gap.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "gap", "length"))).alias("r"), F.max(F.col("start") + F.col("length")).alias("end"))
    flat = F.flatten(F.transform("r", lambda x: F.array(x["gap"], x["length"])))
    return g.select(*by, F.when(F.col("end") < size, F.concat(flat, F.array(size - F.col("end")))).otherwise(flat).alias("counts"))


def rle_to_pixels(counts: DataFrame, height: int, by: Sequence[str]) -> DataFrame:
    """Target pixels (x, y) of counts(by, counts)."""
    each = counts.select(*by, F.posexplode("counts").alias("i", "n"), "counts").withColumn("start", F.aggregate(F.slice("counts", 1, F.col("i")), F.lit(0).cast("long"), lambda a, b: a + b))
    on = each.where("i % 2 = 1 and n > 0").select(*by, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("p"))
    return on.select(*by, F.floor(F.col("p") / height).cast("int").alias("x"), (F.col("p") % height).cast("int").alias("y"))
