import datetime as dt
import json
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.operators import series
from verdance.sources import tables
from verdance.streaming import live


def png(path, w, h, rgb):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + bytes(rgb) * w for _ in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_ingest_images(spark, tmp_path):
    png(tmp_path / "img_20240101_101500.png", 3, 2, (255, 10, 20))
    log, pixels = tables.ingest_images(spark, str(tmp_path), "Europe/Berlin")
    row = log.first()
    assert row["ts"] == dt.datetime(2024, 1, 1, 9, 15) and row["source"] == "import:filename" and (row["width"], row["height"]) == (3, 2)
    assert {(r.b, r.g, r.r) for r in pixels.collect()} == {(20, 10, 255)} and pixels.count() == 6


def test_image_strips(spark):
    """Strips of any size give the pixels of the whole image, whatever its width; images of other kinds have none."""
    data = bytes(range(1, 1 + 5 * 7 * 3))
    rows = [("a", 5, 7, 3, data), ("b", 3, 2, 1, bytes(range(6))), ("c", 2, 1, 4, bytes(range(8))), ("d", 0, 0, 3, b""), ("e", 2, 2, 2, bytes(8)), ("f", None, 1, 3, None)]
    images = spark.createDataFrame(rows, "path string, width int, height int, channels int, data binary")
    want = {("a", i % 5, i // 5, *data[3 * i : 3 * i + 3]) for i in range(35)} | {("b", i % 3, i // 3, i, i, i) for i in range(6)} | {("c", 0, 0, 0, 1, 2), ("c", 1, 0, 4, 5, 6)}
    for strip in (1, 10, 12, 1 << 16):
        got = [tuple(r) for r in tables.image_pixels(images, strip).collect()]
        assert len(got) == len(want) and set(got) == want
    assert tables.image_pixels(images.limit(0)).count() == 0


def test_frame_log_round_trip(spark, tmp_path):
    (tmp_path / "frames.csv").write_text("timestamp_utc,camera,status,file,sha256,width,height,source,scheduled_utc,lag_s,mean_brightness,sharpness,camera_settings,notes\n2024-01-01T00:00:00.250Z,a,ok,f.png,,3,2,capture,,0.5,200,500,\"{\"\"iso\"\": \"\"100\"\"}\",\n")
    r = tables.read_frames(spark, str(tmp_path / "frames.csv")).first()
    assert r["timestamp_utc"] == dt.datetime(2024, 1, 1, 0, 0, 0, 250000) and r["sha256"] is None


def test_append_and_export(spark, tmp_path):
    df = spark.createDataFrame([("e", "c", 1, 0.123456789, ["a", "b"])], "experiment string, camera string, k int, v double, flags array<string>")
    tables.append_frames(df, str(tmp_path / "log"))
    tables.append_frames(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    tables.export_csv(df, str(tmp_path / "csv"))
    r = spark.read.csv(str(tmp_path / "csv"), header=True).first()
    assert r["v"] == "0.123457" and r["flags"] == "a;b"


def test_coco(spark, tmp_path):
    doc = {"categories": [{"id": 1, "name": "moss"}, {"id": 2, "name": "other"}], "images": [{"id": 5, "file_name": "a.png", "width": 2, "height": 2}], "annotations": [{"id": 1, "image_id": 5, "category_id": 1, "segmentation": {"size": [2, 2], "counts": [1, 3]}}, {"id": 2, "image_id": 5, "category_id": 2, "segmentation": {"size": [2, 2], "counts": [0, 4]}}, {"id": 3, "image_id": 5, "category_id": 1, "segmentation": {"size": [3, 2], "counts": [6]}}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    px, bad = tables.coco_read(spark, str(tmp_path / "c.json"), ["moss", "dye"])
    assert sorted((r.x, r.y) for r in px.collect()) == [(0, 1), (1, 0), (1, 1)]
    assert {(r.id, r.reason) for r in bad.collect()} == {(2, "unknown category"), (3, "size differs")}


def test_stream_measure_is_idempotent(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a",), ("b",)], "frame_file string").write.parquet(src)
    run = lambda cp, h: live.stream_measure(spark.readStream.schema("frame_file string").parquet(src), lambda f: f.withColumn("value", F.length("frame_file")), target, h, str(tmp_path / cp), "frame_file string, value int").awaitTermination()
    run("c1", "h1")
    spark.createDataFrame([("c",)], "frame_file string").write.mode("append").parquet(src)
    run("c1", "h1")
    run("c2", "h1")  # a lost checkpoint measures nothing twice
    run("c3", "h2")
    got = sorted((r.frame_file, r.settings_hash) for r in spark.read.parquet(target).collect())
    assert got == [(f, h) for f in "abc" for h in ("h1", "h2")]


def test_stream_import(spark, tmp_path):
    folder, log = tmp_path / "photos", str(tmp_path / "log")
    folder.mkdir()
    for n, c in (("a", b"1"), ("b", b"1"), ("c", b"2")):
        (folder / n).write_bytes(c)
    live.stream_import(spark, str(folder), log, str(tmp_path / "cp"), 5.0, "2100-01-01 00:00:00").awaitTermination()
    (folder / "d").write_bytes(b"2")
    live.stream_import(spark, str(folder), log, str(tmp_path / "cp"), 5.0, "2100-01-01 00:00:00").awaitTermination()
    assert spark.read.parquet(log).count() == 2


def test_stream_import_waits_for_files_to_settle(spark, tmp_path):
    """A file that is still new waits over runs; of equal contents the earliest is logged; a lost checkpoint logs nothing twice."""
    folder, log = tmp_path / "photos", str(tmp_path / "log")
    folder.mkdir()
    for n, c, age in (("a", b"1", 100), ("b", b"1", 200), ("young", b"2", 3)):
        (folder / n).write_bytes(c)
        import os
        os.utime(folder / n, (1_700_000_000 - age, 1_700_000_000 - age))
    at = lambda s: str(dt.datetime.fromtimestamp(1_700_000_000 + s, dt.UTC).replace(tzinfo=None))
    run = lambda cp, s: live.stream_import(spark, str(folder), log, str(tmp_path / cp), 5.0, at(s)).awaitTermination()
    names = lambda: sorted(r.path[-5:] for r in spark.read.parquet(log).collect())
    run("cp", 0)
    assert names() == ["tos/b"]
    run("cp", 1)
    assert names() == ["tos/b"]
    run("cp", 10)
    run("cp", 11)
    assert names() == ["tos/b", "young"]
    run("lost", 20)
    assert names() == ["tos/b", "young"]


def test_batches_do_not_read_the_target_again(spark, tmp_path, monkeypatch):
    """Only a new checkpoint reads the target; a known one starts from its state though the target is gone."""
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a",), ("b",)], "frame_file string").write.parquet(src)
    run = lambda: live.stream_measure(spark.readStream.schema("frame_file string").parquet(src), lambda f: f.withColumn("value", F.length("frame_file")), target, "h", str(tmp_path / "cp"), "frame_file string, value int").awaitTermination()
    run()
    (tmp_path / "out").rename(tmp_path / "moved")
    spark.createDataFrame([("a",), ("c",)], "frame_file string").write.mode("append").parquet(src)
    run()
    assert [r.frame_file for r in spark.read.parquet(target).collect()] == ["c"]


def _days(spark, src, schema, tmp_path, zone, how):
    days = live.stream_daily(spark.readStream.schema(schema).parquet(src), ["s"], zone, how, "3 days")
    live.write_days(days, str(tmp_path / "days"), str(tmp_path / "cp")).awaitTermination()


@pytest.mark.parametrize(("zone", "how"), [("UTC", "median"), ("Europe/Berlin", "p90"), ("America/New_York", "mean")])
def test_stream_days_equal_batch(spark, tmp_path, zone, how):
    """Days over the change to summer time, rows out of order and late, excluded ones and ones without a value, in three runs."""
    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 3, 29)
    rows = [("ab"[i % 2], start + dt.timedelta(minutes=int(m)), None if i % 17 == 0 else float(rng.normal()), i % 11 == 0) for i, m in enumerate(np.sort(rng.uniform(0, 4 * 1440, 240)))]
    early, late = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if i % 5 == 0]
    schema, src = "s string, ts timestamp, y double, excluded boolean", str(tmp_path / "pts")
    for part in (early[:100], early[100:] + late[:20], late[20:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        _days(spark, src, schema, tmp_path, zone, how)
    got = {(r.s, r.day): (r.y, r.ts_mid, r.n_frames) for r in live.latest_days(spark.read.parquet(str(tmp_path / "days")), ["s"]).collect()}
    want = {(r.s, r.day): (r.y, r.ts_mid, r.n_frames) for r in series.daily_series(spark.createDataFrame(rows, schema), ["s"], zone, how).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    touched = spark.read.parquet(str(tmp_path / "days")).groupBy("batch").count().orderBy("batch").collect()
    assert len(touched) >= 3


def test_late_rows_touch_their_day_alone_and_closed_days_go(spark, tmp_path):
    schema, src = "s string, ts timestamp, y double, excluded boolean", str(tmp_path / "pts")
    put = lambda *days: (spark.createDataFrame([("s", dt.datetime(2024, 1, d, h), float(d), False) for d in days for h in (1, 2)], schema).write.mode("append").parquet(src), _days(spark, src, schema, tmp_path, "UTC", "median"))
    put(1, 2, 3)
    put(2)
    put(20)
    put(21)
    put(1, 22)  # the first is behind the watermark
    rows = sorted((int(r.batch), r.day.day, r.n_frames) for r in spark.read.parquet(str(tmp_path / "days")).collect())
    per = {}
    for b, d, n in rows:
        per.setdefault(b, []).append((d, n))
    assert [v for _, v in sorted(per.items())] == [[(1, 2), (2, 2), (3, 2)], [(2, 4)], [(20, 2)], [(21, 2)], [(22, 2)]]


def test_days_stay_open_to_their_end_and_are_kept_without_python(spark, tmp_path):
    """A row behind the watermark counts while its day's end is before it; many days are one aggregation."""
    schema, src = "s string, ts timestamp, y double, excluded boolean", str(tmp_path / "pts")
    for batch in ([(1, 1), (1, 5)], [(4, 12)], [(1, 3)], [(5, 1), (1, 4)], [(1, 6)]):
        spark.createDataFrame([("s", dt.datetime(2024, 1, d, h), float(h), False) for d, h in batch], schema).write.mode("append").parquet(src)
        _days(spark, src, schema, tmp_path, "UTC", "median")
    got = {(r.batch, r.day.day): (r.y, r.n_frames) for r in spark.read.parquet(str(tmp_path / "days")).collect()}
    assert [v for (_, d), v in sorted(got.items()) if d == 1] == [(3.0, 2), (3.0, 3), (3.5, 4)]
    plan = live.stream_daily(spark.readStream.schema(schema).parquet(src), ["s"])._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_stream_window(spark, tmp_path):
    src = str(tmp_path / "w")
    spark.createDataFrame([("s", dt.datetime(2024, 1, 1, h), float(h)) for h in (1, 3)], "s string, ts timestamp, y double").write.parquet(src)
    q = live.stream_series_window(spark.readStream.schema("s string, ts timestamp, y double").parquet(src), ["s"]).writeStream.outputMode("update").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.y, r.n_frames) for r in spark.table("win").collect()] == [(2.0, 2)]


def test_stream_health(spark, tmp_path):
    src = str(tmp_path / "beats")
    schema = "experiment string, ts timestamp, interval_s double, level string"
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    spark.createDataFrame([("a", now, 3600.0, "ok"), ("b", now, 3600.0, "problem"), ("c", now - dt.timedelta(seconds=1000), 10.0, "ok")], schema).write.parquet(src)
    q = live.stream_health(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("update").format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "cp")).start()
    # timers keep the query busy, so wait for rows and not for the query
    def wait(n):
        end = time.time() + 40
        while time.time() < end and spark.table("alerts").count() < n:
            time.sleep(0.5)

    wait(2)
    spark.createDataFrame([("b", now + dt.timedelta(seconds=1), 3600.0, "ok")], schema).write.mode("append").parquet(src)
    wait(3)
    q.stop()
    got = {(r.experiment, r.event) for r in spark.table("alerts").collect()}
    assert {("b", "problem"), ("b", "recovered"), ("c", "problem")} <= got and not any(e == "a" for e, _ in got)


def test_logger_clocks_and_delimiters(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Logger 7\nTime,Temp (°C),Note\n1/2/2024 9:05:00 AM,20.5,x\n1/31/2024 9:05:00 PM,21,y\n")
    (tmp_path / "b.csv").write_text("Time;RH %\n31/01/24 13:00;40,5\n02/01/24 13:30;41\n")
    (tmp_path / "c.csv").write_text("a title, of two cells\nDate,Time,CO2\n2024-01-05,10:00,400\nbroken, line, with, many, cells\nanother, one, with, five, cells\n2024-01-05,11:00,410\nx,y\nz,1\n")
    got = sorted((r.file[-5:], str(r.ts), r.name, r.value) for r in tables.read_logger(spark, str(tmp_path / "[ab].csv")).collect())
    assert got == [("a.csv", "2024-01-02 09:05:00", "temp_c", 20.5), ("a.csv", "2024-01-31 21:05:00", "temp_c", 21.0), ("b.csv", "2024-01-02 13:30:00", "rh_pct", 41.0), ("b.csv", "2024-01-31 13:00:00", "rh_pct", 40.5)]
    line = tmp_path / "d.csv"
    line.write_text("Time,T\n2024-01-05 10:00,1,5\n2024-01-05 11:00,2,5,9\n2024-01-05 12:00,3\n")
    assert [r.value for r in tables.read_logger(spark, str(line)).where("name = 't'").orderBy("ts").collect()] == [1.0, 2.0, 3.0]


def test_logger_heads_by_line_and_times_parsed_once(spark, tmp_path):
    """Titles with one filled cell, of quotes and blanks beside it, are no head; the rows' plan parses no time again."""
    (tmp_path / "q.csv").write_text('a title," "\n"", ,\n"Time","T 1",\n2024-01-05 10:00,1.5,x\n2024-01-05 11:00,2.5,y\n')
    rows = tables.read_logger(spark, str(tmp_path))
    assert [(str(r.ts), r.name, r.value) for r in rows.orderBy("ts").collect()] == [("2024-01-05 10:00:00", "t_1", 1.5), ("2024-01-05 11:00:00", "t_1", 2.5)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "gettimestamp" not in plan and "regexp" not in plan


def test_coco_exchange(spark, tmp_path):
    mask = spark.createDataFrame([(f"{f}.png", c, x, y) for f in "abc" for c in ("mold", "dye") for x in range(2, 5) for y in range(1, 4 if c == "dye" else 2)], "file string, class string, x int, y int")
    tables.coco_write(mask, ["mold", "dye"], 6, 8, str(tmp_path / "out"), 2)
    px, refused = tables.coco_read(spark, str(tmp_path / "out"), ["mold", "dye"])
    assert refused.count() == 0 and sorted(map(tuple, px.collect())) == sorted(map(tuple, mask.collect()))
    doc = {"categories": [{"id": 3, "name": "mold"}], "images": [{"id": 1, "file_name": "p.png", "width": 8, "height": 6}], "annotations": [
        {"id": 1, "image_id": 1, "category_id": 3, "iscrowd": 0, "segmentation": [[1, 1, 4, 1, 4, 3, 1, 3], [6, 4, 7, 4, 7.2, 5.1]]},
        {"id": 2, "image_id": 1, "category_id": 3, "iscrowd": 1, "segmentation": {"size": [6, 8], "counts": "T1L"}},
        {"id": 3, "image_id": 1, "category_id": 9, "iscrowd": 1, "segmentation": {"size": [6, 7], "counts": [0, 42]}}]}
    (tmp_path / "poly.json").write_text(json.dumps(doc))
    px, refused = tables.coco_read(spark, str(tmp_path / "poly.json"), ["mold"])
    assert refused.first().reason == "size differs"
    drawn = {(x, y) for x in range(1, 5) for y in range(1, 4)} | {(6, 4), (7, 4), (7, 5)}
    assert {(r.x, r.y) for r in px.collect()} >= drawn


def test_compressed_run_lengths(spark):
    def encode(counts):
        out = ""
        for i, n in enumerate(counts):
            n -= counts[i - 2] if i > 2 else 0
            more = True
            while more:
                c, n = n & 31, n >> 5
                more = n != -1 if c & 16 else n != 0
                out += chr((c | 32 if more else c) + 48)
        return out

    lists = [[0, 42], [5, 3, 100, 7, 2000, 1, 64], [70000, 1], [12, 1, 9, 3, 2]]
    got = spark.createDataFrame([(i, encode(x)) for i, x in enumerate(lists)] + [(9, None)], "i int, s string").select("i", tables._decoded("s").alias("c")).collect()
    assert {r.i: r.c for r in got} == {**dict(enumerate(lists)), 9: None}


def test_baseline_and_registries(spark, tmp_path):
    from verdance.operators import checks, segmenters

    checks.register_evaluator("mean", lambda rows, settings: rows.agg(F.avg("v").alias("value")).select(F.lit(settings["check"]).alias("check"), F.lit("mean").alias("metric"), "value"))
    values = checks.run_suite([("one", "mean", spark.createDataFrame([(1.0,), (3.0,)], "v double"), {"check": "c"}), ("two", "mean", spark.createDataFrame([], "v double"), {"check": "c"})])
    checks.save_baseline(values, str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    assert [(r.case, r.value) for r in base.collect()] == [("one", 2.0)]
    bounds = spark.createDataFrame([("one", "c", "mean", None, None, None, 0.5), ("two", "c", "mean", None, None, None, 0.5)], "case string, check string, metric string, min double, max double, abs_max double, max_drift double")
    moved = values.withColumn("value", F.col("value") + 1)
    assert {r.case: r.failures for r in checks.evaluate_bounds(moved, bounds, base).collect()} == {"one": ["drift"], "two": ["no value", "no baseline"]}
    px = spark.createDataFrame([(0, 0, 0, 0, 200, 0), (0, 1, 0, 0, 0, 200)], "frame int, x int, y int, b int, g int, r int")
    assert [r.x for r in segmenters.segment(px, "color", {"ranges": [((35, 40, 20), (85, 255, 255))]}).collect()] == [0]
    segmenters.register_segmenter("all", lambda p, settings: p.drop("b", "g", "r"))
    assert segmenters.segment(px, "all", {}).count() == 2
    with pytest.raises(ValueError):
        segmenters.segment(px, "none", {})


def _logger(spark, path, zone="UTC", **kw):
    rows, refused = tables.read_loggers(spark, str(path), zone, **kw)
    return sorted((r.file.rsplit("/", 1)[1], str(r.ts), r.name, r.value) for r in rows.collect()), {r.file.rsplit("/", 1)[1]: r.reason for r in refused.collect()}


def test_iso_times_and_refusal_per_file(spark, tmp_path):
    stamps = {
        "z": ("2024-01-05T10:00:00Z", "2024-01-05 10:00:00"), "offset": ("2024-01-05T10:00:00+01:00", "2024-01-05 09:00:00"), "minus": ("2024-01-05 10:00-0530", "2024-01-05 15:30:00"), "fraction": ("2024-01-05T10:00:00.5", "2024-01-05 08:00:00.500000"),
        "micro": ("2024-01-05 10:00:00.123456Z", "2024-01-05 10:00:00.123456"), "short": ("2024-01-05T10:00", "2024-01-05 08:00:00"), "basic": ("20240105T100000Z", "2024-01-05 10:00:00"), "day": ("2024-01-05", "2024-01-04 22:00:00"), "hour": ("2024-01-05T10+02", "2024-01-05 08:00:00"),
    }
    for name, (text, _) in stamps.items():
        (tmp_path / f"{name}.csv").write_text(f"Time,T\n{text},1.5\n{text},2.5\n")
    (tmp_path / "mixed.csv").write_text("Time,T\n2024-01-05T10:00:00Z,1\n2024-01-05 11:00,2\n")
    (tmp_path / "bad.csv").write_text("Time,T\nyesterday,1\n2024-01-05T10:00:00Z,2\n")
    (tmp_path / "which.csv").write_text("Time,T\n01/02/2024 10:00,1\n03/04/2024 10:00,2\n")
    (tmp_path / "head.csv").write_text("Time,T\n")
    (tmp_path / "text.csv").write_text("only a title\nand another line\n")
    (tmp_path / "nonday.csv").write_text("Time,T\n2024-02-30T10:00:00Z,1\n")
    got, refused = _logger(spark, tmp_path, "Etc/GMT-2")
    assert refused == {"bad.csv": "no time layout fits", "which.csv": "day or month first? the times fit both", "head.csv": "no data rows", "text.csv": "no data rows", "nonday.csv": "no time layout fits"}
    want = [(f"{n}.csv", at, "t", v) for n, (_, at) in stamps.items() for v in (1.5, 2.5)] + [("mixed.csv", "2024-01-05 10:00:00", "t", 1.0), ("mixed.csv", "2024-01-05 09:00:00", "t", 2.0)]
    assert got == sorted(want)
    assert "which.csv" not in _logger(spark, tmp_path, month_first=True)[1]


def test_large_logger_file_is_read_by_several_tasks(spark, tmp_path):
    n = 30_000
    lines = [f"{1 + i // 1440 % 28:02d}.{1 + i // 40320:02d}.2024;{i // 60 % 24:02d}:{i % 60:02d};{i % 50},5;x;{'' if i % 3 else i}" for i in range(n)]
    (tmp_path / "big.csv").write_text("A long title, with a mark\n\nDatum;Zeit;Temp;Note;Rare\n" + "\n".join(lines) + "\n")
    (tmp_path / "small.csv").write_text("Time\tX\n2024-01-01 00:00\t1\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "65536")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        rows, refused = tables.read_loggers(spark, str(tmp_path))
        assert refused.count() == 0
        got = {r.name: (r.n, r.s) for r in rows.groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
        assert got == {"temp": (n, sum(i % 50 + 0.5 for i in range(n))), "x": (1, 1.0)}
        first = rows.where("name = 'temp'").agg(F.min("ts"), F.max("ts")).first()
        assert str(first[0]) == "2024-01-01 00:00:00" and first[1] == max(dt.datetime(2024, 1 + i // 40320, 1 + i // 1440 % 28, i // 60 % 24, i % 60) for i in range(n))
    finally:
        spark.conf.set(key, before)


def test_coco_ids_count_over_documents(spark, tmp_path):
    """Many documents of bounded size, ids dense over all of them, compressed run lengths read back."""
    rng = np.random.default_rng(4)
    rows = [(f"f{i:03d}.png", c, int(x), int(y)) for i in range(60) for c in ("mold", "dye") if (i + len(c)) % 3 for x, y in set(map(tuple, rng.integers(0, [20, 15], (40, 2)).tolist()))]
    mask = spark.createDataFrame(rows, "file string, class string, x int, y int").repartition(7)
    for compressed in (False, True):
        out = str(tmp_path / f"out{compressed}")
        tables.coco_write(mask, ["mold", "dye"], 15, 20, out, 500, compressed)
        docs = [json.loads(line) for f in sorted(__import__("glob").glob(out + "/part-*")) for line in open(f)]
        assert len(docs) > 3 and all(sum(len(a["segmentation"]["counts"]) for a in d["annotations"]) < (3000 if compressed else 700) for d in docs)
        images = sorted(((i["id"], i["file_name"]) for d in docs for i in d["images"]))
        assert images == [(k + 1, name) for k, name in enumerate(sorted({r[0] for r in rows}))]
        marks = sorted((a["id"], a["image_id"], a["category_id"]) for d in docs for a in d["annotations"])
        assert [m[0] for m in marks] == list(range(1, len(marks) + 1)) and [m[1:] for m in marks] == sorted(m[1:] for m in marks)
        assert all({a["image_id"] for a in d["annotations"]} == {i["id"] for i in d["images"]} for d in docs)
        px, refused = tables.coco_read(spark, out, ["mold", "dye"])
        assert refused.count() == 0 and sorted(map(tuple, px.collect())) == sorted(rows)


def test_run_lengths_as_text_and_back():
    rng = np.random.default_rng(1)
    assert tables._as_text([1, 3]) == "13"
    for _ in range(200):
        counts = rng.integers(0, 10 ** int(rng.integers(1, 8)), rng.integers(1, 12)).tolist()
        assert tables._run_lengths(tables._as_text(counts)) == counts


def test_numbers_over_ranges(spark):
    from verdance.functions.numbering import numbered

    rows = [(f"k{i * 7919 % 1000:04d}", i % 5) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "k string, w int").repartition(6), ["k"], weight=F.col("w")).collect()
    total = 0
    for i, (k, w) in enumerate(sorted(rows)):
        r = next(x for x in got if x.n == i + 1)
        assert (r.k, r.before) == (k, total)
        total += w
    assert numbered(spark.createDataFrame([], "k string"), ["k"]).count() == 0
