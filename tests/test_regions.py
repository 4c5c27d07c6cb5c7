"""Shapes in large masks against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.operators import pixels, regions


def image(spark, grid, frame=1, **extra):
    y, x = np.nonzero(grid)
    df = spark.createDataFrame(__import__("pandas").DataFrame({"frame": frame, "x": x.astype("int32"), "y": y.astype("int32"), **extra}))
    return df


def back(df, shape, value=None):
    got = df.select("x", "y", *([value] if value else [])).toPandas()
    out = np.zeros(shape, np.int64)
    out[got["y"], got["x"]] = got[value] if value else 1
    assert len(got) == len(set(zip(got["x"], got["y"], strict=True)))
    return out


def eroded(grid, radius):
    h, w = grid.shape
    out = grid.copy()
    for dx in range(-radius, radius + 1):
        for dy in range(-radius, radius + 1):
            if dx * dx + dy * dy <= radius * radius:
                moved = np.ones_like(grid)
                moved[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = grid[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
                out &= moved
    return out


def blobs(grid):
    """Canonical label (y << 32 | x of the first pixel) of each pixel's 8-connected blob, by spreading minima."""
    h, w = grid.shape
    name = np.where(grid > 0, (np.arange(h)[:, None] << 32) | np.arange(w), np.int64(1) << 60)
    out = np.zeros((h, w), np.int64)
    seen = np.zeros((h, w), bool)
    for y, x in zip(*np.nonzero(grid)):
        if seen[y, x]:
            continue
        stack, seen[y, x] = [(y, x)], True
        while stack:
            a, b = stack.pop()
            out[a, b] = name[y, x]
            for c in range(max(a - 1, 0), min(a + 2, h)):
                for d in range(max(b - 1, 0), min(b + 2, w)):
                    if grid[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        stack.append((c, d))
    return out


def noise(shape, share, seed):
    return (np.random.default_rng(seed).random(shape) < share).astype(np.int64)


@pytest.mark.parametrize(("radius", "share"), [(0, 0.5), (1, 0.9), (3, 0.99), (7, 0.998), (40, 0.9999)])
def test_erode(spark, radius, share):
    grid = noise((90, 130), share, radius)
    assert (back(regions.erode(image(spark, grid), radius, 130, 90), grid.shape) == eroded(grid, radius)).all()


def test_erode_full_empty_and_outside(spark):
    full = np.ones((20, 30), np.int64)
    assert (back(regions.erode(image(spark, full), 5, 30, 20), full.shape) == 1).all()
    assert regions.erode(image(spark, full).limit(0), 5, 30, 20).count() == 0
    assert regions.erode(image(spark, full).select("frame", F.expr("x + 100").alias("x"), "y"), 1, 30, 20).count() == 0
    two = image(spark, full).unionByName(image(spark, noise((20, 30), 0.7, 1), 2))
    got = regions.erode(two, 1, 30, 20)
    assert got.where("frame = 1").count() == 600 and (back(got.where("frame = 2"), full.shape) == eroded(noise((20, 30), 0.7, 1), 1)).all()


@pytest.mark.parametrize(("share", "tile", "block"), [(0.3, 4, 8), (0.4, 8, 16), (0.45, 7, 21), (0.6, 5, 5), (0.42, 64, 128)])
def test_blobs_across_tiles(spark, share, tile, block):
    grid = noise((61, 83), share, 7)
    got = regions.label_blobs(image(spark, grid), tile=tile, block=block)
    assert (back(got, grid.shape, "blob") == blobs(grid)).all()


def test_blobs_of_a_large_frame(spark):
    """One spiral over 4,000 x 4,000 pixels, and blocks between its arms: one component over all tiles, others within one."""
    n = 4000
    grid = np.zeros((n, n), np.uint8)
    lo, hi, step = 0, n - 1, 250
    grid[lo, lo : hi + 1] = 1
    while hi - lo > step:
        grid[lo : hi + 1, hi] = 1
        grid[hi, lo : hi + 1] = 1
        grid[lo + step : hi + 1, lo] = 1
        grid[lo + step, lo : hi - step + 1] = 1
        lo, hi = lo + step, hi - step
    squares = [(y, x) for y in range(120, n, 250) for x in range(130, n, 500)]
    for y, x in squares:
        if not grid[y - 3 : y + 24, x - 3 : x + 24].any():
            grid[y : y + 20, x : x + 20] = 1
    got = regions.label_runs(regions.to_runs(image(spark, grid)))
    sizes = {r.blob: r.n for r in got.groupBy("blob").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n")).collect()}
    squares = {(y << 32) | x for y, x in squares if grid[y : y + 20, x : x + 20].all()}
    assert sizes == {s: 400 for s in squares} | {0: int(grid.sum()) - 400 * len(squares)}
    assert got.where("b div 256 <> a div 256").count() == 0


def test_cleanup_against_brute_force(spark):
    grid = noise((70, 64), 0.75, 3)
    swell = lambda g, r: 1 - eroded(1 - g, r)
    want = eroded(swell(swell(eroded(grid, 1), 1), 1), 1)
    name = blobs(want)
    labels, counts = np.unique(name, return_counts=True)
    keep = set(labels[(counts >= 30) & (labels >= 0)].tolist())
    want = want * np.isin(name, list(keep))
    assert (back(regions.mask_cleanup(image(spark, grid), 64, 70, 1, 30), grid.shape) == want).all() and 0 < want.sum() < grid.sum()


@pytest.mark.parametrize("share", [0.0005, 0.01, 0.3])
def test_distances(spark, monkeypatch, share):
    rng = np.random.default_rng(4)
    patch, asked = noise((300, 280), share, 5), noise((300, 280), 0.05, 6)
    got = regions.distances(image(spark, asked), image(spark, patch), ["frame"]).toPandas()
    py, px = np.nonzero(patch)
    want = {(x, y): np.sqrt(((px - x) ** 2 + (py - y) ** 2).min()) for y, x in zip(*np.nonzero(asked))}
    assert len(got) == len(want) and all(want[x, y] == d for x, y, d in zip(got.x, got.y, got.d))
    rng.random()


def test_distances_far_apart_negative_and_none(spark):
    spots = spark.createDataFrame([(1, -700, 5), (1, 900, -333), (2, 0, 0)], "g int, x int, y int")
    patch = spark.createDataFrame([(1, 3, 4), (1, -5, 2000), (3, 1, 1)], "g int, x int, y int")
    got = sorted(tuple(r) for r in regions.distances(spots, patch, ["g"]).collect())
    assert got == [(1, -700, 5, np.hypot(703, 1)), (1, 900, -333, np.hypot(897, 337))]


def test_advance_of_a_growing_disc(spark):
    """A disc of radius 200 that grows to 260 in a 1,000 x 1,000 image."""
    y, x = np.mgrid[0:1000, 0:1000]
    r2 = (x - 480) ** 2 + (y - 510) ** 2
    masks = [r2 <= 200**2, r2 <= 230**2, r2 <= 260**2]
    mask = image(spark, masks[0], 0, by=1).unionByName(image(spark, masks[1], 1, by=1)).unionByName(image(spark, masks[2], 2, by=1))
    frames = spark.createDataFrame([(1, 0, 0.0, True), (1, 1, 1.0, True), (1, 2, 2.0, True), (1, 3, 3.0, False)], "by int, frame int, t double, usable boolean")
    got = {r.frame: (r.advance_p95, r.advance_max) for r in pixels.edge_advance(mask, frames, ["by"]).collect()}
    assert got[0] == (0, 0) and got[3] == (None, None)
    assert abs(got[1][1] - 30) < 1 and abs(got[2][1] - 60) < 1 and abs(got[2][0] - 57.4) < 1.5


def test_running_quantile():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 1), (2, 5), (300, 7), (1000, 10**6)):
        v = rng.integers(0, kinds, n) / 3
        ends = np.unique(rng.integers(1, n + 1, 60))
        for q in (0.0, 0.5, 0.95, 1.0):
            assert np.allclose(regions.running_quantile(v, ends, q), [np.percentile(v[:e], 100 * q) for e in ends], rtol=0, atol=1e-12)


def test_variants_are_measured_as_each_alone(spark):
    """Six settings, with and without light correction, against one run a setting."""
    from verdance.operators import series, variants

    rng = np.random.default_rng(12)
    n = 24
    grid = rng.integers(0, 256, (3, n, n, 3))
    grid[:, 4:18, 5:20] = rng.integers([0, 140, 0], [60, 255, 60], (3, 14, 15, 3))
    pd = __import__("pandas")
    f, y, x = np.mgrid[0:3, 0:n, 0:n].reshape(3, -1)
    px = spark.createDataFrame(pd.DataFrame({"frame": f, "x": x, "y": y, **dict(zip("bgr", grid.reshape(-1, 3).T))}))
    gains = spark.createDataFrame([(0, 1.2, 0.9, 1.0), (1, 0.8, 1.1, 1.0)], "frame long, gain_b double, gain_g double, gain_r double")
    green = [((35, 40, 20), (85, 255, 255))]
    grid_of = series.variant_grid(spark, ["hsv", "cleanup", "front", "lighting"]).where("variant <> 'lighting_background'")
    run = lambda v: variants.measure_variants(px, v, green, (12.0, 23.0), (12.0, 0.0), n, n, 1, 6, gains=gains)
    all_ = {(r.variant, r.frame): (r.target_px, r.extent_px) for r in run(grid_of).collect()}
    assert len(all_) == 3 * grid_of.count() and run(grid_of).where("lighting = 'off'").count() == 3
    for name in ("lighting_off",):
        alone = {(r.variant, r.frame): (r.target_px, r.extent_px) for r in run(grid_of.where(F.col("variant") == name)).collect()}
        assert alone == {k: v for k, v in all_.items() if k[0] == name}
    h, s, v = pixels.bgr_to_hsv()
    lit = pixels.apply_gains(px, gains).withColumns({"h": h, "s": s, "v": v})
    mask = lit.where(pixels.hsv_in_ranges(F.col("h"), F.col("s"), F.col("v"), green))
    assert {r.frame: r["count"] for r in regions.mask_cleanup(mask, n, n, 1, 6).groupBy("frame").count().collect()} == {f: c for (name, f), (c, _) in all_.items() if name == "baseline"}
    with pytest.raises(ValueError, match="unknown settings"):
        run(spark.createDataFrame([("x", {"zoom": "2"})], "variant string, overrides map<string,string>"))


def test_images_shrink_by_area(spark):
    """A 90 x 60 image to 64 x 43 by brute force; one of 40 x 64 stays."""
    from verdance.operators import masks

    rng = np.random.default_rng(3)
    pd = __import__("pandas")

    def table(frame, a):
        y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]].reshape(2, -1)
        return pd.DataFrame({"frame": frame, "x": x, "y": y, **dict(zip("bgr", a.reshape(-1, 3).T))})

    large, small = rng.integers(0, 256, (60, 90, 3)), rng.integers(0, 256, (64, 40, 3))
    got = masks.shrink_images(spark.createDataFrame(pd.concat([table(1, large), table(2, small)])), side=64).toPandas()
    same = got[got.frame == 2].sort_values(["y", "x"])
    assert (same[["b", "g", "r"]].to_numpy() == small.reshape(-1, 3)).all()

    def cover(n, m):
        w = np.zeros((m, n))
        for i in range(m):
            for j in range(n):
                w[i, j] = max(0, min((i + 1) * n / m, j + 1) - max(i * n / m, j))
        return w / w.sum(1, keepdims=True)

    want = np.round(np.einsum("ij,jkc,lk->ilc", cover(60, 43), large, cover(90, 64)).round(9))
    one = got[got.frame == 1].sort_values(["y", "x"])
    assert len(one) == 43 * 64 and (one[["b", "g", "r"]].to_numpy() == want.reshape(-1, 3)).all()


def test_lab_of_known_colours(spark):
    from verdance.operators import masks

    known = {(255, 255, 255): (255, 128, 128), (0, 0, 0): (0, 128, 128), (0, 0, 255): (136, 208, 195), (0, 255, 0): (224, 42, 211), (255, 0, 0): (82, 207, 20), (128, 128, 128): (137, 128, 128)}
    df = spark.createDataFrame(list(known), "b int, g int, r int")
    l, a, b = masks.bgr_to_lab()  # noqa: E741
    assert {tuple(r)[:3]: tuple(r)[3:] for r in df.select("b", "g", "r", l.alias("l1"), a.alias("a1"), b.alias("b1")).collect()} == known


def test_tiles_in_batches_are_scored_as_one_by_one(spark):
    """A model that looks at neighbours, so overlapping tiles differ; images of two sizes of batch."""
    pd = __import__("pandas")
    rng = np.random.default_rng(6)
    y, x = np.mgrid[0:10, 0:13].reshape(2, -1)
    px = spark.createDataFrame(pd.concat([pd.DataFrame({"frame": f, "x": x, "y": y, "b": rng.integers(0, 256, 130), "g": rng.integers(0, 256, 130), "r": rng.integers(0, 256, 130)}) for f in range(5)]))
    blur = lambda a: (a[..., 1] + np.roll(a[..., 2], 1, axis=-1)) / 200 - 1
    one = {(r.frame, r.x, r.y): r.p for r in pixels.tile_scores(px, lambda t: blur(t[["b", "g", "r"]].to_numpy(float).reshape(1, 6, 6, 3)).ravel(), 13, 10, 6, 2).collect()}
    for batch in (1, 4):
        got = {(r.frame, r.x, r.y): r.p for r in pixels.tile_predictions(px, lambda: blur, 13, 10, 6, 2, batch=batch).collect()}
        assert got.keys() == one.keys() and all(got[k] == pytest.approx(one[k], abs=1e-5) for k in one)
    with pytest.raises(Exception, match="lacks pixels"):
        pixels.tile_predictions(px.where("x <> 3"), lambda: blur, 13, 10, 6, 2).collect()


def test_tiles_are_scored_one_by_one_across_batches(spark):
    """Tiles that go on over several Arrow batches are whole when scored; keys may be null; no call to Python a group."""
    pd = __import__("pandas")
    rng = np.random.default_rng(8)
    y, x = np.mgrid[0:7, 0:9].reshape(2, -1)
    px = spark.createDataFrame(pd.concat([pd.DataFrame({"frame": f, "x": x, "y": y, "g": rng.integers(0, 256, 63)}) for f in range(4)])).withColumn("frame", F.when(F.col("frame") > 0, F.col("frame")))

    def score(t):
        a = t["g"].to_numpy(float).reshape(4, 4)  # a part of a tile has no such shape
        return ((a - a.mean()) / 50 + np.arange(4)).ravel()

    def reference():
        out = {}
        for r in px.select("frame").distinct().collect():
            g = {(p.x, p.y): p.g for p in px.where(F.col("frame").eqNullSafe(r.frame)).collect()}
            top, low = {}, {}
            for tx in (0, 3, 5):
                for ty in (0, 3):
                    a = np.array([[g[tx + i, ty + j] for i in range(4)] for j in range(4)], float)
                    l = (a - a.mean()) / 50 + np.arange(4)  # noqa: E741
                    for j in range(4):
                        for i in range(4):
                            w = min(i + 1, 4 - i, 1) * min(j + 1, 4 - j, 1)
                            k = (tx + i, ty + j)
                            top[k], low[k] = top.get(k, 0) + w * l[j, i], low.get(k, 0) + w
            out |= {(r.frame, *k): 1 / (1 + np.exp(-top[k] / low[k])) for k in top}
        return out

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, want = spark.conf.get(key), reference()
    try:
        for rows in ("5", "37", before):
            spark.conf.set(key, rows)
            df = pixels.tile_scores(px, score, 9, 7, 4, 1)
            got = {(r.frame, r.x, r.y): r.p for r in df.collect()}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    finally:
        spark.conf.set(key, before)
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().analyzed().toString()
    small = pixels.tile_scores(px.where("x < 3 and y < 2"), lambda t: np.full(len(t), len(t)), 3, 2, 4, 1).select(F.round("p", 6).alias("p")).distinct().collect()
    assert [r.p for r in small] == [pytest.approx(1 / (1 + np.exp(-6)), abs=1e-6)]
