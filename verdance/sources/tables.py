"""Sources, sinks and incremental runs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.shared import settled
from ..schemas import FRAMES


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame logs (CSV with a header; blank is null), camera_settings as a map."""
    raw = spark.read.schema(FRAMES).csv(path, header=True, nullValue="", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSX")
    return raw.withColumn("camera_settings", F.from_json("camera_settings", "map<string,string>"))


def append_frames(frames: DataFrame, path: str) -> None:
    """Adds rows to the log, a folder of Parquet by experiment and camera."""
    frames.write.mode("append").partitionBy("experiment", "camera").parquet(path)


IMAGE_TYPES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")


#: Pixels of an image that travel as one row on their way from the decoder.
STRIP = 1 << 16


def image_pixels(images: DataFrame, strip: int = STRIP) -> DataFrame:
    """path, x, y, b, g, r of decoded images(path, width, height, channels, data: rows of interleaved bytes). Each image is
    cut into strips of whole lines, at most about `strip` pixels, which are dealt out by hash, so that one large image
    spreads over tasks and no row or array holds more pixels than a strip. Images of 1, 3 or 4 channels count; grey ones
    have equal b, g and r, a fourth channel is left out; images without pixels have no rows."""
    lines = F.greatest(F.lit(1), F.floor(F.lit(strip) / F.col("width"))).cast("int")
    sized = images.where("channels in (1, 3, 4) and width > 0 and height > 0").withColumn("lines", lines)
    line = F.col("width") * F.col("channels")
    cut = sized.withColumn("top", F.explode(F.expr("sequence(0, height - 1, lines)")))
    strips = cut.select("path", "width", "channels", "top", F.substring("data", F.col("top") * line + 1, F.col("lines") * line).alias("bytes")).repartition("path", "top")
    px = strips.withColumn("i", F.explode(F.sequence(F.lit(0), (F.length("bytes") / F.col("channels")).cast("int") - 1)))
    at = lambda c: F.conv(F.hex(F.substring("bytes", F.col("i") * F.col("channels") + 1 + F.least(F.lit(c), F.col("channels") - 1), F.lit(1))), 16, 10).cast("int")
    return px.select("path", (F.col("i") % F.col("width")).alias("x"), (F.col("top") + F.floor(F.col("i") / F.col("width"))).cast("int").alias("y"), at(0).alias("b"), at(1).alias("g"), at(2).alias("r"))


def ingest_images(spark: SparkSession, path: str, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Files (path, bytes, sha256, size, time and its source) and pixels (path, x, y, b, g, r) of the readable images under
    a folder. Neither is in an order; a report sorts the files by ts and path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(*IMAGE_TYPES))
    image = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(path).select("image.*").withColumn("path", F.regexp_replace("origin", "^file:/+", "file:/"))
    log = frame_time_from_name(files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "modificationTime"), "path", "modificationTime", zone)
    pixels = image_pixels(image.select("path", "width", "height", F.col("nChannels").alias("channels"), "data"))
    return log.join(image.select("path", "width", "height"), "path"), pixels


def frame_time_from_name(files: DataFrame, path: str = "path", modified: str = "modified", zone: str | Column = "UTC") -> DataFrame:
    """files with ts and source: YYYYMMDD and HHMMSS in the name (parts may be apart by -, _, blank, : or T; no digit before),
    local to the zone, else the file's time."""
    name = F.element_at(F.split(path, "/"), -1)
    pattern = r"(?<![0-9])([0-9]{4})[-_]?([0-9]{2})[-_]?([0-9]{2})[ _T-]?([0-9]{2})[-_:]?([0-9]{2})[-_:]?([0-9]{2})"
    part = [F.regexp_extract(name, pattern, k) for k in range(1, 7)]
    local = F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", *part[:3]), F.concat_ws(":", *part[3:])), F.lit("yyyy-MM-dd HH:mm:ss"))
    named = F.to_utc_timestamp(local, zone)
    return files.withColumn("ts", F.coalesce(named, F.col(modified).cast("timestamp"))).withColumn("source", F.when(named.isNotNull(), "import:filename").otherwise("import:mtime"))


def dedupe_by_content(files: DataFrame, log: DataFrame, order: Sequence[str] = ("ts", "path")) -> DataFrame:
    """files(sha256, ...) whose content the log lacks, the first in time of equal ones."""
    new = files.join(log.select("sha256").where("sha256 is not null"), "sha256", "left_anti")
    first = new.groupBy("sha256").agg(F.min(F.struct(*order)).alias("__first"))
    return new.join(first, "sha256").where(F.struct(*order) == F.col("__first")).drop("__first")


def list_frame_names(frames: DataFrame, ext: str = "png", order: Sequence[str] = ()) -> DataFrame:
    """frames(camera, ts) with a sortable name; equal ones get ~1, ~2 by time and the `order` columns, which should tell
    frames of one time apart (without them all columns that can be ordered do)."""
    order = list(order) or [c for c, t in frames.dtypes if not t.startswith("map") and c != "ts"]
    base = F.concat_ws("_", F.date_format("ts", "yyyyMMdd'T'HHmmss"), "camera")
    k = F.row_number().over(Window.partitionBy("__base").orderBy("ts", *order)) - 1
    named = frames.withColumn("__base", base).withColumn("__k", k)
    return named.withColumn("name", F.concat("__base", F.when(F.col("__k") > 0, F.concat(F.lit("~"), F.col("__k"))).otherwise(""), F.lit(f".{ext}"))).drop("__base", "__k")


#: Files whose layouts are sent to every task; beyond, lines meet their file's layout by a shuffle.
MAX_LAYOUTS = 100_000


def _meet(lines: DataFrame, per_file: DataFrame) -> DataFrame:
    """lines with the columns of per_file (file, ...), a settled table."""
    return lines.join(F.broadcast(per_file) if per_file.limit(MAX_LAYOUTS + 1).count() <= MAX_LAYOUTS else per_file, "file")


def read_loggers(spark: SparkSession, path: str, zone: str = "UTC", month_first: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Sensor logger files of unknown layout: the rows (file, ts in UTC, name, value) of those that can be read, and the
    others (file, reason). Per file, the delimiter is the first of tab, `;`, `,` with a constant count on 70 % of the last 30
    lines, else `,`; lines before the first row with two cells are titles; the time is a Date and a Time column or the first
    header with a time word; `;` means decimal commas; columns under 50 % numeric and rows without a time are left out. Times
    with an offset or Z keep it, others are of `zone`. Refused are files without data rows, with times that no layout fits,
    or with day- or month-first dates that fit both ways.

    Files are read by blocks, so a large one is many tasks: lines are ordered by their block and place, and only the last 30
    lines, the head and sums over columns are gathered per file."""
    marks = ["\t", ";", ","]
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), F.regexp_replace("value", "\ufeff", "").alias("line")).where(F.trim("line") != "")
    late = lines.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy(F.col("place").desc()))).where("k <= 30")
    count = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.length("line") - F.length(F.replace("line", F.lit(d)))).alias("n")) for i, d in enumerate(marks))))
    alike = late.select("file", count.alias("c")).groupBy("file", "c").agg(F.count(F.lit(1)).alias("same"))
    steady = alike.withColumn("all", F.sum("same").over(Window.partitionBy("file", "c.i"))).where("c.n > 0 and same >= 0.7 * all").groupBy("file").agg(F.min("c.i").alias("i"))
    cells = lambda d: F.transform(F.split("line", d, -1), lambda c: F.trim(F.replace(c, F.lit('"'))))
    # two cells with something in them, told from the line alone; the cells of a file's first such line are taken apart later
    filled = lambda d: F.contains("line", F.lit(d)) & F.col("line").rlike(f'(?s)[^ "{d}][^{d}]*{d}.*[^ "{d}]')
    first = lambda d: F.min(F.when(filled(d), F.struct("place", "line")))
    heads = lines.groupBy("file").agg(*(first(d).alias(f"h{i}") for i, d in enumerate(marks)))
    heads = heads.join(steady, "file", "left").withColumn("i", F.coalesce("i", F.lit(2)))
    head = heads.select("file", F.element_at(F.array(*map(F.lit, marks)), F.col("i") + 1).alias("d"), F.element_at(F.array("h0", "h1", "h2"), F.col("i") + 1).alias("h")).select("file", "d", F.col("h.place").alias("top"), F.col("h.line").alias("line"))
    by_mark = lambda form: F.when(F.col("d") == marks[0], form(marks[0])).when(F.col("d") == marks[1], form(marks[1])).otherwise(form(marks[2]))
    head = head.select("file", "d", "top", by_mark(lambda d: F.transform(cells(d), F.lower)).alias("head"))
    find = lambda words: F.array_min(F.filter(F.transform("head", lambda x, i: F.when(x.rlike(words), i)), lambda i: i.isNotNull()))
    head = settled(head.withColumns({"di": find(r"^(date|datum)$"), "ti": find(r"^(time|zeit|uhrzeit)$"), "wi": find(r"time|date|zeit|datum|timestamp")}))
    body = _meet(lines, head).where("place > top").withColumn("cells", by_mark(cells)).where(F.size("cells") >= 2)
    stamp = F.when(F.col("di").isNotNull() & F.col("ti").isNotNull(), F.concat_ws(" ", F.get("cells", F.col("di")), F.get("cells", F.col("ti")))).otherwise(F.get("cells", F.coalesce("wi", F.lit(0))))
    body = settled(body.select("file", "cells", F.trim(stamp).alias("stamp")))
    formats = settled(head.select("file").join(time_layouts(body.select("file", F.col("stamp").alias("sample")), ["file"], month_first), "file", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("format").isNull(), F.lit("no data rows")))))
    layout = settled(head.drop("top").join(formats.where("problem is null").select("file", "format"), "file"))
    # times and numbers are worked out once a line, and kept
    number = lambda c: F.when(F.col("d") == ";", F.replace(c, F.lit(","), F.lit("."))).otherwise(c).try_cast("double")
    timed = settled(_meet(body, layout).select("file", parse_time(F.col("stamp"), F.col("format"), zone).alias("ts"), F.transform("cells", number).alias("numbers"))).where("ts is not null")
    share = timed.select("file", F.posexplode("numbers").alias("i", "value")).groupBy("file", "i").agg(F.avg(F.when(F.col("value").isNotNull(), 1.0).otherwise(0.0)).alias("share")).where("share >= 0.5")
    named = share.join(layout, "file").where("not (i <=> di) and not (i <=> ti) and not (di is null and i <=> coalesce(wi, 0))")
    columns = settled(named.groupBy("file").agg(F.collect_list(F.struct("i", safe_name(F.get("head", F.col("i"))).alias("name"))).alias("columns")))
    each = _meet(timed, columns).select("file", "ts", "numbers", F.explode("columns").alias("c"))
    rows = each.select("file", "ts", "c.name", F.get("numbers", F.col("c.i")).alias("value")).where("value is not null")
    return rows, formats.where("problem is not null").select("file", F.col("problem").alias("reason"))


def read_logger(spark: SparkSession, path: str, zone: str = "UTC", month_first: bool | None = None) -> DataFrame:
    """file, ts, name, value of the logger files that can be read; read_loggers also tells of the others."""
    return read_loggers(spark, path, zone, month_first)[0]


#: Time layouts, tried in this order; which of day and month comes first.
TIME_FORMATS = [(f"{d}{t}", order) for order, dates in (("iso", ["yyyy-MM-dd", "yyyy/MM/dd"]), ("day", ["dd.MM.yyyy", "dd/MM/yyyy", "dd-MM-yyyy"]), ("month", ["MM/dd/yyyy", "MM-dd-yyyy"])) for d in dates for t in (" HH:mm:ss", " HH:mm", "'T'HH:mm:ss")]
TIME_FORMATS += [(f"{d}{t}", "day") for d in ("dd/MM/yy", "dd.MM.yy") for t in (" HH:mm:ss", " HH:mm")]
TIME_FORMATS += [(f"{d}{t}", "month") for d, times in (("MM/dd/yyyy", (" hh:mm:ss a", " hh:mm a")), ("MM/dd/yy", (" HH:mm:ss", " HH:mm", " hh:mm:ss a", " hh:mm a"))) for t in times]


def two_digits(stamp: Column) -> Column:
    """A time's single digits with a zero before them, as the layouts want them."""
    return F.regexp_replace(F.trim(stamp), r"(?<![0-9])([0-9])(?![0-9])", "0$1")


#: A time in ISO 8601: date, time to the hour, minute, second or its fraction, offset; with or without separators.
ISO = r"^([0-9]{4})-?([0-9]{2})-?([0-9]{2})(?:[T ]([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]{1,9}))?)?)?)?\s*(Z|z|[+-][0-9]{2}(?::?[0-9]{2})?)?$"


def iso_time(stamp: Column, zone: str) -> Column:
    """UTC time of an ISO stamp; null for anything else. One without an offset is of `zone`."""
    def read(part: Column) -> Column:
        at = lambda k: F.get(part, F.lit(k - 1))
        or_zero = lambda k: F.when(at(k) == "", F.lit("00")).otherwise(at(k))
        clock = F.concat(at(1), F.lit("-"), at(2), F.lit("-"), at(3), F.lit(" "), or_zero(4), F.lit(":"), or_zero(5), F.lit(":"), or_zero(6), F.lit("."), F.rpad(F.substring(at(7), 1, 6), 6, "0"))
        naive = F.try_to_timestamp(clock, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
        offset = F.replace(at(8), F.lit(":"))
        minutes = F.substring(offset, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(offset, 4, 2).try_cast("int"), F.lit(0))
        shifted = naive - F.make_dt_interval(mins=F.coalesce(F.when(F.substring(offset, 1, 1) == "-", -minutes).otherwise(minutes), F.lit(0)))
        return F.when(offset == "", F.to_utc_timestamp(naive, zone)).otherwise(shifted)

    # one match a stamp: its groups in one text, taken apart once, as an array of one
    groups = F.split(F.regexp_replace(stamp, ISO, "$1|$2|$3|$4|$5|$6|$7|$8"), "[|]", -1)
    return F.when(stamp.rlike(ISO), F.get(F.transform(F.array(groups), read), F.lit(0)))


def parse_time(stamp: Column, layout: Column, zone: str) -> Column:
    """UTC time of stamps in their layouts (time_layouts)."""
    return F.when(layout == "iso", iso_time(F.trim(stamp), zone)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(two_digits(stamp), F.when(layout != "iso", layout)), zone))


def _shape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "(?i)[ap]m$", "a")


def time_layouts(samples: DataFrame, by: Sequence[str], month_first: bool | None = None) -> DataFrame:
    """by, format and problem of samples(by, sample): ISO if all samples are (one layout of TIME_FORMATS if it fits all, else
    `iso`), else the first day-first or month-first layout that fits all. Both fitting (unless month_first decides) or none is
    a problem. A layout is only tried on samples of its shape."""
    stamp = samples.where("sample is not null").select(*by, F.trim("sample").alias("raw"), two_digits(F.col("sample")).alias("stamp")).withColumn("shape", _shape(F.col("stamp")))
    look = lambda f: "".join("9" if c in "yMdHhms" else c for c in f.replace("'", ""))
    fits = lambda f: F.bool_and((F.col("shape") == look(f)) & F.try_to_timestamp("stamp", F.lit(f)).isNotNull())
    every = stamp.groupBy(*by).agg(F.bool_and(iso_time(F.col("raw"), "UTC").isNotNull()).alias("any_iso"), *(fits(f).alias(f"f{i}") for i, (f, _) in enumerate(TIME_FORMATS)))
    best = lambda kind: F.coalesce(*(F.when(F.col(f"f{i}"), F.lit(f)) for i, (f, k) in enumerate(TIME_FORMATS) if k == kind))
    found = every.select(*by, F.coalesce(best("iso"), F.when(F.col("any_iso"), F.lit("iso"))).alias("iso"), best("day").alias("day"), best("month").alias("month"))
    both = F.col("iso").isNull() & F.col("day").isNotNull() & F.col("month").isNotNull() & F.lit(month_first is None)
    chosen = F.coalesce("iso", *(("month", "day") if month_first else ("day", "month")))
    problem = F.when(both, F.lit("day or month first? the times fit both")).when(chosen.isNull(), F.lit("no time layout fits"))
    return found.select(*by, F.when(problem.isNull(), chosen).alias("format"), problem.alias("problem"))


def choose_time_format(samples: DataFrame, by: Sequence[str], month_first: bool | None = None) -> DataFrame:
    """by and format (time_layouts); a problem ends the job."""
    found = time_layouts(samples, by, month_first)
    return found.select(*by, F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem"))).otherwise(F.col("format")).alias("format"))


def safe_name(text: Column) -> Column:
    """Lower case, no degree sign, `pct` for %, _ for what is no letter or digit; `value` if nothing is left."""
    t = F.replace(F.replace(F.lower(text), F.lit("°")), F.lit("%"), F.lit("pct"))
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("value"))


def merge_covariates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Long logs(name, ts, value) merged: a new finite value replaces the old one of its time and name."""
    finite = F.col("value").isNotNull() & ~F.isnan("value")
    both = old.withColumn("v", F.lit(0)).unionByName(new.withColumn("v", F.lit(1))).where(finite)
    return both.groupBy("name", "ts").agg(F.max(F.struct("v", "value"))["value"].alias("value"))


def read_measurements(rows: DataFrame, plot: str | None = None) -> DataFrame:
    """A blank plot is `main`; one plot alone if asked."""
    out = rows.withColumn("plot", F.coalesce(F.nullif("plot", F.lit("")), F.lit("main")))
    return out.where(F.col("plot") == plot) if plot is not None else out


def settings_hash(settings: Column) -> Column:
    """First 12 hex digits of the SHA-256 of a map's entries in key order."""
    entries = F.array_sort(F.transform(F.map_entries(settings), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.substring(F.sha2(F.concat_ws("\n", entries), 256), 1, 12)


def pending_frames(frames: DataFrame, measured: DataFrame, settings: str) -> DataFrame:
    """Frames without rows under these settings; rows of other settings stay where they are."""
    return frames.join(measured.where(F.col("settings_hash") == settings).select("frame_file"), "frame_file", "left_anti")


def multi_camera_runs(frames: DataFrame) -> DataFrame:
    """Per camera: frames measured and what went wrong (camera is a key, not a loop)."""
    return frames.groupBy("camera").agg(F.count_if(F.col("status") == "ok").alias("measured"), F.when(F.count_if(F.col("status") == "ok") == 0, F.lit("no usable frame")).alias("error"))


def list_runs(masks: DataFrame) -> DataFrame:
    """run, number of frames with masks, first time; oldest first by position."""
    return masks.groupBy("run_id").agg(F.countDistinct("frame_file").alias("frames"), F.min("ts").alias("created"))


def resolve_run(runs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix and its only run; null if none or several begin so. Every run is listed under each of its beginnings that is
    as long as some prefix, so that they meet by equality."""
    lengths = prefixes.select(F.length("prefix").alias("__k")).distinct()
    starts = runs.select("run_id").crossJoin(lengths).where("length(run_id) >= __k").select(F.expr("left(run_id, __k)").alias("prefix"), "run_id")  # a handful of lengths
    only = starts.groupBy("prefix").agg(F.when(F.count("run_id") == 1, F.min("run_id")).alias("run_id"))
    return prefixes.select("prefix").distinct().join(only, "prefix", "left")


def run_metadata(measured: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows with their run's scale and settings, by hash."""
    return measured.join(runs, "settings_hash", "left")


def exclude_frames(current: DataFrame, changes: DataFrame) -> DataFrame:
    """current(frame_file, plot, reason, created) after changes: the newest row of a frame and plot counts, a blank reason
    is refused, a null one takes the exclusion away."""
    good = changes.where("reason is null or trim(reason) <> ''")
    both = current.unionByName(good)
    last = both.groupBy("frame_file", "plot").agg(F.max(F.struct("created", "reason")).alias("n"))
    return last.where("n.reason is not null").select("frame_file", "plot", "n.reason", "n.created")


def integrity_manifest(files: DataFrame, log: DataFrame | None = None, include: str = "%", exclude: str | None = None) -> DataFrame:
    """path, bytes, sha256 of files(path, content) by LIKE patterns; the log's own hash is kept where it has one."""
    f = files.where(F.col("path").like(include))
    f = f.where(~F.col("path").like(exclude)) if exclude else f
    f = f.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    return f if log is None else f.join(log.select("path", F.col("sha256").alias("__h")), "path", "left").withColumn("sha256", F.coalesce("__h", "sha256")).drop("__h")


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path and status: ok, changed, missing (only in the manifest), extra (only now)."""
    j = manifest.select("path", F.col("sha256").alias("a")).join(files.select("path", F.col("sha256").alias("b")), "path", "full")
    return j.select("path", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed").otherwise("ok").alias("status"))


def manifest_ok(verified: DataFrame) -> DataFrame:
    return verified.agg(F.count_if(F.col("status") == "changed").alias("changed"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "extra").alias("extra"), F.bool_and(~F.col("status").isin("changed", "missing")).alias("ok"))


COCO = "categories array<struct<id: long, name: string>>, images array<struct<id: long, file_name: string, width: int, height: int>>, annotations array<struct<id: long, image_id: long, category_id: long, area: double, bbox: array<double>, iscrowd: int, segmentation: string>>"


def _run_lengths(s: str | None) -> list[int] | None:
    """Run lengths of their compressed text: six-bit characters from 48 on, five bits each, low ones first, the sixth: more
    follow; from the fourth number on the difference to the number two before."""
    if s is None:
        return None
    out: list[int] = []
    value = shift = 0
    for c in s.encode():
        c -= 48
        value |= (c & 31) << shift
        shift += 5
        if not c & 32:
            value -= (1 << shift) if c & 16 else 0
            out.append(value + out[-2] if len(out) > 2 else value)
            value = shift = 0
    return out


def _decoded(text: str | Column) -> Column:
    @F.pandas_udf("array<long>")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(_run_lengths)

    return decode(text)


def polygon_pixels(polygons: DataFrame, by: Sequence[str], width: str = "width", height: str = "height") -> DataFrame:
    """by, x, y: the pixels in the image whose centre lies in, or on the outline of, polygons(by, points (x, y in turn),
    width, height), with points rounded to whole pixels."""
    n = F.size("points") / 2
    point = lambda i: F.struct(F.round(F.get("points", (2 * i).cast("int"))).alias("x"), F.round(F.get("points", (2 * i + 1).cast("int"))).alias("y"))
    p = polygons.where(F.size("points") >= 6).withColumn("p", F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), point))
    p = p.withColumn("q", F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1)))
    ends = lambda c, top: F.sequence(F.greatest(F.array_min(F.transform("p", lambda v: v[c])), F.lit(0)).cast("int"), F.least(F.array_max(F.transform("p", lambda v: v[c])), F.col(top) - 1).cast("int"))
    inside = lambda c, top: (F.array_max(F.transform("p", lambda v: v[c])) >= 0) & (F.array_min(F.transform("p", lambda v: v[c])) <= F.col(top) - 1)
    box = p.where(inside("x", width) & inside("y", height)).withColumn("x", F.explode(ends("x", width))).withColumn("y", F.explode(ends("y", height)))
    turn = lambda a, b: (b["x"] - a["x"]) * (F.col("y") - a["y"]) - (b["y"] - a["y"]) * (F.col("x") - a["x"])
    on = F.zip_with("p", "q", lambda a, b: (turn(a, b) == 0) & F.col("x").between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & F.col("y").between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])))
    cross = F.zip_with("p", "q", lambda a, b: F.when((a["y"] <= F.col("y")) != (b["y"] <= F.col("y")), F.when(F.col("x") < a["x"] + (F.col("y") - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]), 1)).otherwise(0))
    hit = F.array_contains(on, True) | (F.aggregate(cross, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 2 == 1)
    return box.where(hit).select(*by, "x", "y").distinct()


def coco_read(spark: SparkSession, path: str, classes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Target pixels (file, class, x, y) of polygons and of plain or compressed run lengths, and refused annotations with the
    reason: an unknown category (unless there is but one class, which takes all) or a size that differs from the image's.
    Ids hold within a document; there may be many."""
    from ..operators.masks import rle_to_pixels

    doc = spark.read.schema(COCO).json(path, multiLine=True).withColumn("doc", F.input_file_name())
    ann = doc.select("doc", F.explode("annotations").alias("a")).select("doc", "a.*")
    img = doc.select("doc", F.explode("images").alias("i")).select("doc", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    cat = doc.select("doc", F.explode("categories").alias("c")).select("doc", F.col("c.id").alias("category_id"), "c.name")
    j = ann.join(img, ["doc", "image_id"]).join(cat, ["doc", "category_id"], "left")
    rle = F.from_json("segmentation", "size array<int>, counts string")
    known = F.lit(classes[0]) if len(classes) == 1 else F.when(F.col("name").isin(*classes), F.col("name"))
    j = j.withColumns({"class": known, "polygons": F.when(F.col("segmentation").startswith("["), F.from_json("segmentation", "array<array<double>>")), "rle": F.when(F.col("segmentation").startswith("{"), rle)})
    differs = F.col("rle").isNotNull() & ((F.get("rle.size", F.lit(0)) != F.col("height")) | (F.get("rle.size", F.lit(1)) != F.col("width")))
    j = j.withColumn("reason", F.when(F.col("class").isNull(), "unknown category").when(differs, "size differs"))
    good = j.where("reason is null").withColumnRenamed("file_name", "file")
    plain = F.when(F.col("rle.counts").startswith("["), F.from_json("rle.counts", "array<long>")).otherwise(_decoded("rle.counts"))
    counts = good.where("rle is not null").select("file", "class", "height", plain.alias("counts")).withColumn("key", F.monotonically_increasing_id())
    px = rle_to_pixels(counts, F.col("height"), ["file", "class", "height", "key"]).select("file", "class", "x", "y")
    drawn = polygon_pixels(good.where("polygons is not null").select("file", "class", "width", "height", F.explode("polygons").alias("points")), ["file", "class"])
    return px.unionByName(drawn).distinct(), j.where("reason is not null").select("id", "file_name", "reason")


def _as_text(counts: list[int]) -> str:
    """Run lengths in their compressed text (see _run_lengths)."""
    out = []
    for i, n in enumerate(counts):
        v, size = n - (counts[i - 2] if i > 2 else 0), 1
        while not -(16 << 5 * (size - 1)) <= v < 16 << 5 * (size - 1):
            size += 1
        out += [chr(48 + (v >> 5 * k & 31) + (32 if k < size - 1 else 0)) for k in range(size)]
    return "".join(out)


def compressed_counts(counts: str | Column) -> Column:
    @F.pandas_udf("string")
    def encode(column: pd.Series) -> pd.Series:
        return column.map(lambda c: _as_text([int(x) for x in c]))

    return encode(counts)


#: Run lengths that one COCO document holds, but for one larger image alone.
RUNS_A_DOCUMENT = 1_000_000


def coco_tables(mask: DataFrame, classes: Sequence[str], height: int, width: int, runs: int = RUNS_A_DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """Images (id, file_name, document) and annotations (id, image_id, category_id, area, bbox, counts, document) of
    mask(file, class, x, y). Ids count on over all documents, images by name, annotations by image and category (place of the
    class). Images lie in documents by the runs of those before them."""
    code = F.array_position(F.array(*map(F.lit, classes)), F.col("class")).cast("int")
    ann = settled(coco_annotations(mask.where(F.col("class").isin(*classes)), ["file", "class"], height, width).withColumn("category_id", code))
    images = numbered(ann.groupBy("file").agg(F.sum(F.size("counts")).alias("runs")), ["file"], "id", F.col("runs"))
    images = settled(images.select("id", F.col("file").alias("file_name"), F.floor(F.col("before") / runs).alias("document")))
    of = images.select(F.col("id").alias("image_id"), F.col("file_name").alias("file"), "document")
    marks = numbered(ann.join(of, "file"), ["image_id", "category_id"], "id")
    return images, marks.select("id", "image_id", "category_id", F.col("area").cast("long").alias("area"), "bbox", "counts", "document")


def coco_write(mask: DataFrame, classes: Sequence[str], height: int, width: int, path: str, runs: int = RUNS_A_DOCUMENT, compressed: bool = False) -> None:
    """mask(file, class, x, y) as COCO documents, a JSON file each of about `runs` run lengths, plain or compressed; see
    coco_tables. A document's images and annotations are gathered in one row; no row holds more than a document."""
    images, marks = coco_tables(mask, classes, height, width, runs)
    counts = compressed_counts("counts") if compressed else F.col("counts")
    item = F.struct("id", "image_id", "category_id", "area", "bbox", F.lit(1).alias("iscrowd"), F.struct(F.array(F.lit(height), F.lit(width)).alias("size"), counts.alias("counts")).alias("segmentation"))
    named = F.struct("id", "file_name", F.lit(width).alias("width"), F.lit(height).alias("height"))
    names = F.array(*(F.struct(F.lit(i + 1).alias("id"), F.lit(c).alias("name")) for i, c in enumerate(classes)))
    left = images.select("document", named.alias("i")).groupBy("document").agg(F.array_sort(F.collect_list("i")).alias("images"))
    right = marks.select("document", item.alias("a")).groupBy("document").agg(F.array_sort(F.collect_list("a")).alias("annotations"))
    left.join(right, "document").select(names.alias("categories"), "images", "annotations").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def coco_annotations(mask: DataFrame, by: Sequence[str], height: int, width: int) -> DataFrame:
    """by, area, bbox (x, y, width, height), counts: one annotation for each item and class of mask(by, x, y)."""
    from ..operators.masks import rle_counts, rle_runs

    box = mask.groupBy(*by).agg(F.count(F.lit(1)).alias("area"), F.array(F.min("x"), F.min("y"), F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1).alias("bbox"))
    return box.join(rle_counts(rle_runs(mask, height, by), height * width, by), list(by))


def export_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """A CSV sink: doubles are rounded here and only here; lists are joined by `;`."""
    cols = [F.round(c, digits).alias(c) if t in ("double", "float") else F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSX")


def export_parquet(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)
