"""Queries over rows: sources, frames, series, covariates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..operators import checks, covariates, frames, series
from ..sources import tables
from ..streaming import live
from .sample import FR, P, query, readings, table
from .sample import frames as frame_log
from .sample import points

SEC = "cast(ts as double)"
USED = "u as (select *, list_has_any(flags, ['align_failed', 'blurry']) x from p)"


def _axis(spark, d, **more):
    return series.build_series(points(spark, d), ["series_id"], **more)


AXIS = f"""with {P}, b as (select *, min(s) over w s0, max(s) over w - min(s) over w span from p window w as (partition by series_id)),
a as (select * exclude (s0, span), (s - s0) / case when span < 7200 then 60.0 when span < 259200 then 3600.0 else 86400.0 end t, list_has_any(flags, ['align_failed', 'blurry']) excluded from b)"""


# --- sources ---------------------------------------------------------------------------------------------------------


@query("frame_time_from_name", """
with v as (select page_id, url, case when page_id % 3 = 0 then 'img_' || strftime(timestamp '2024-01-01' + to_seconds(page_id * 977), '%Y%m%d_%H%M%S') || '.png' when page_id % 3 = 1 then 'IMG-' || strftime(timestamp '2024-06-01' + to_seconds(page_id * 977), '%Y-%m-%d %H%M%S') || '.jpg' else '9' || strftime(timestamp '2024-01-01', '%Y%m%d%H%M%S') || '.png' end path from pages)
;;
select page_id, epoch(case when page_id % 3 = 2 then timestamp '2023-05-05 05:05:05' else (case when page_id % 3 = 0 then timestamp '2024-01-01' else timestamp '2024-06-01' end) + to_seconds(page_id * 977) end) s, case when page_id % 3 = 2 then 'import:mtime' else 'import:filename' end source from v""", "s", "page_id source")  # fmt: skip
def _(spark, d):
    p = table(spark, d, "pages").select("page_id")
    at = lambda day: F.expr(f"timestamp_seconds(unix_timestamp(timestamp '{day} 00:00:00') + page_id * 977)")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a/img_"), F.date_format(at("2024-01-01"), "yyyyMMdd_HHmmss"), F.lit(".png"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("a/IMG-"), F.date_format(at("2024-06-01"), "yyyy-MM-dd HHmmss"), F.lit(".jpg"))).otherwise(F.lit("a/920240101000000.png"))
    f = p.select("page_id", name.alias("path"), F.lit("2023-05-05 05:05:05").cast("timestamp").alias("modified"))
    return tables.frame_time_from_name(f).select("page_id", "source", F.col("ts").cast("double").alias("s"))


@query("dedupe_by_content", "with f as (select doc_id, sha256(coalesce(text, '')) sha256 from documents), l as (select distinct sha256 from f where doc_id % 7 = 0)\n;;\nselect sha256, min(doc_id) doc_id from f where sha256 not in (select sha256 from l) group by 1")
def _(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return tables.dedupe_by_content(f, f.where("doc_id % 7 = 0"), ["doc_id"]).select("sha256", "doc_id")


@query("list_frame_names", f"with {FR}, n as (select event_id, strftime(date_trunc('hour', ts), '%Y%m%dT%H%M%S') || '_' || camera b, row_number() over (partition by date_trunc('hour', ts), camera order by event_id) - 1 k from fr)\n;;\nselect event_id, b || case when k > 0 then '~' || k else '' end || '.png' as name from n")
def _(spark, d):
    f = frame_log(spark, d).withColumn("ts", F.date_trunc("hour", "ts"))
    return tables.list_frame_names(f, order=["event_id"]).select("event_id", "name")


@query("safe_name", r"select doc_id, coalesce(nullif(regexp_replace(regexp_replace(replace(replace(lower(n), '°', ''), '%', 'pct'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'value') as name from (select doc_id, case doc_id % 4 when 0 then 'Temp (°C) ' || source when 1 then 'RH % ' || lang when 2 then '' else text end n from documents)")
def _(spark, d):
    n = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Temp (°C) "), "source")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("RH % "), "lang")).when(F.col("doc_id") % 4 == 2, F.lit("")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", tables.safe_name(n).alias("name"))


#: What a logger's times look like, by the customer's market segment, and the layout that they have.
LAYOUTS = {"AUTOMOBILE": ("dd.MM.yyyy HH:mm", "dd.MM.yyyy HH:mm"), "BUILDING": ("MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy hh:mm:ss a"), "FURNITURE": ("d/M/yy HH:mm", "dd/MM/yy HH:mm"), "HOUSEHOLD": ("M-d-yyyy H:mm:ss", "MM-dd-yyyy HH:mm:ss")}


@query("choose_time_format", f"select c_mktsegment as segment, case c_mktsegment {' '.join(f"when '{k}' then '{v[1]}'" for k, v in LAYOUTS.items())} else 'yyyy-MM-dd HH:mm' end as format from customer join orders on c_custkey = o_custkey group by all")
def _(spark, d):
    o = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    at = F.col("o_orderdate").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, o_orderkey % 1440, 0)")
    sample = F.lit(None).cast("string")
    for segment, (layout, _) in LAYOUTS.items():
        sample = F.when(F.col("c_mktsegment") == segment, F.date_format(at, layout)).otherwise(sample)
    sample = F.when(F.col("c_mktsegment").isin(*LAYOUTS), sample).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm"))
    return tables.choose_time_format(o.select(F.col("c_mktsegment").alias("segment"), sample.alias("sample")), ["segment"])


#: How the times of each kind of event are written into logger files; errors are not.
STAMPS = {"purchase": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "view": "yyyy-MM-dd'T'HH:mm:ss'+01:00'", "click": "yyyy-MM-dd HH:mm:ss.SSSSSS", "signup": "yyyyMMdd'T'HHmmss'Z'"}


@query("read_logger", f"""with {P}, w as (select event_type, case event_type when 'purchase' then date_trunc('millisecond', ts) when 'click' then ts else date_trunc('second', ts) end ts, y from p)
\n;;\nselect event_type, epoch_us(case event_type when 'view' then ts - interval 1 hour when 'click' then ts - interval 2 hour else ts end)::bigint us, 'temp_c' as name, y as value, null as reason from w where event_type <> 'error' and y is not null
union all select 'error', null, null, null, 'no time layout fits' from (select distinct event_id // 50000 from p where event_type = 'error')""".replace("\\n", "\n"), "value", "event_type us name reason")
def _(spark, d):
    """events as logger files, one for each kind and 50,000 ids, written and read again."""
    p = points(spark, d).select("event_type", F.floor(F.col("event_id") / 50000).alias("part"), "ts", "y")
    stamp = F.concat(F.lit("some time in "), F.date_format("ts", "yyyy"))
    for kind, layout in STAMPS.items():
        stamp = F.when(F.col("event_type") == kind, F.date_format("ts", layout)).otherwise(stamp)
    lines = p.select("event_type", "part", F.lit(1).alias("k"), F.concat_ws(",", stamp, F.coalesce(F.col("y").cast("string"), F.lit(""))).alias("line"))
    heads = p.select("event_type", "part").distinct().select("*", F.lit(0).alias("k"), F.lit("Time,Temp (°C)").alias("line"))
    out = f"{shared_dir(spark)}/logger-{uuid.uuid4().hex}"
    lines.unionByName(heads).repartition("event_type", "part").sortWithinPartitions("event_type", "part", "k").select("event_type", "part", "line").write.partitionBy("event_type", "part").text(out)
    rows, refused = tables.read_loggers(spark, f"{out}/*/*", "Etc/GMT-2")
    kind = F.regexp_extract("file", "event_type=([a-z]+)", 1).alias("event_type")
    return rows.select(kind, F.unix_micros("ts").alias("us"), "name", "value", F.lit(None).cast("string").alias("reason")).unionByName(refused.select(kind, "reason"), allowMissingColumns=True)



@query("merge_covariates", f"with {P}, r as (select event_type as name, date_trunc('hour', ts) h, y, k, event_id from p), o as (select name, h, arg_max(y, event_id) v from r where k % 2 = 0 group by all), n as (select name, h, arg_max(y, event_id) v from r where k % 2 = 1 group by all)\n;;\nselect name, epoch(h) s, coalesce(n.v, o.v) as value from o full join n using (name, h)", "s value", "name")
def _(spark, d):
    r = points(spark, d).select(F.col("event_type").alias("name"), F.date_trunc("hour", "ts").alias("ts"), "y", "k", "event_id")
    last = lambda x: x.groupBy("name", "ts").agg(F.max(F.struct("event_id", "y"))["y"].alias("value"))
    return tables.merge_covariates(last(r.where("k % 2 = 0")), last(r.where("k % 2 = 1"))).select("name", F.col("ts").cast("double").alias("s"), "value")


@query("read_measurements", f"with {P}\n;;\nselect case when plot = 'p0' then 'main' else plot end as plot, count(*) n, sum(y) total from p group by 1", "total", "plot n")
def _(spark, d):
    rows = points(spark, d).withColumn("plot", F.when(F.col("plot") == "p0", "").otherwise(F.col("plot")))
    return tables.read_measurements(rows).groupBy("plot").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))


@query("settings_hash", "select p_partkey, substr(sha256('brand=' || p_brand || chr(10) || 'size=' || p_size || chr(10) || 'type=' || p_type), 1, 12) settings_hash from part")
def _(spark, d):
    m = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", tables.settings_hash(m).alias("settings_hash"))


@query("pending_frames", f"with {P}\n;;\nselect event_id from p where not (k < 50 and event_type = 'view')")
def _(spark, d):
    p = points(spark, d)
    return tables.pending_frames(p, p.where("k < 50").select("frame_file", F.col("event_type").alias("settings_hash")), "view").select("event_id")


@query("multi_camera_runs", f"with {FR}\n;;\nselect camera, count(*) filter (status = 'ok') measured, case when count(*) filter (status = 'ok') = 0 then 'no usable frame' end error from fr group by 1")
def _(spark, d):
    return tables.multi_camera_runs(frame_log(spark, d))


@query("list_runs", f"with {P}\n;;\nselect event_type run_id, count(distinct frame_file) frames, epoch(min(ts)) s from p group by 1", "s", "run_id frames")
def _(spark, d):
    runs = tables.list_runs(points(spark, d).withColumnRenamed("event_type", "run_id"))
    return runs.select("run_id", "frames", F.col("created").cast("double").alias("s"))


@query("resolve_run", "with r as (select distinct p_name run_id from part), q as (select distinct left(p_name, 5) prefix from part)\n;;\nselect prefix, case when count(run_id) = 1 then min(run_id) end run_id from q left join r on starts_with(run_id, prefix) group by 1")
def _(spark, d):
    p = table(spark, d, "part")
    return tables.resolve_run(p.select(F.col("p_name").alias("run_id")).distinct(), p.select(F.left("p_name", F.lit(5)).alias("prefix")).distinct())


@query("run_metadata", "select l_orderkey, l_linenumber, sum(p_retailprice) scale from lineitem left join part on l_partkey = p_partkey group by all", "scale", "l_orderkey l_linenumber")
def _(spark, d):
    runs = table(spark, d, "part").select(F.col("p_partkey").alias("settings_hash"), "p_retailprice")
    return tables.run_metadata(table(spark, d, "lineitem").withColumnRenamed("l_partkey", "settings_hash"), runs).groupBy("l_orderkey", "l_linenumber").agg(F.sum("p_retailprice").alias("scale"))


@query("exclude_frames", f"with {P}, c as (select 'f' || (event_id % 500) frame_file, plot, event_id, case when event_type = 'view' then null when event_type = 'click' then ' ' else 'r' || event_id end reason from p), g as (select * from c where reason is null or trim(reason) <> '')\n;;\nselect frame_file, plot, reason from (select frame_file, plot, reason, row_number() over (partition by frame_file, plot order by event_id desc) n from g) where n = 1 and reason is not null")
def _(spark, d):
    c = points(spark, d).select(F.concat(F.lit("f"), F.col("event_id") % 500).alias("frame_file"), "plot", F.when(F.col("event_type") == "view", None).when(F.col("event_type") == "click", " ").otherwise(F.concat(F.lit("r"), "event_id")).alias("reason"), F.col("event_id").alias("created"))
    return tables.exclude_frames(c.where("false"), c).select("frame_file", "plot", "reason")


@query("integrity_manifest", "select doc_id::varchar path, strlen(text)::bigint bytes, sha256(text) sha256 from documents")
def _(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return tables.integrity_manifest(f)


VERIFY = "with a as (select doc_id::varchar path, sha256(text) h from documents where doc_id % 11 <> 0), b as (select doc_id::varchar path, sha256(case when doc_id % 13 = 0 then text || '!' else text end) h from documents where doc_id % 17 <> 0), v as (select path, case when b.h is null then 'missing' when a.h is null then 'extra' when a.h <> b.h then 'changed' else 'ok' end status from a full join b using (path))"


def _verified(spark, d):
    f = table(spark, d, "documents")
    one = lambda x, t: tables.integrity_manifest(x.select(F.col("doc_id").cast("string").alias("path"), t.alias("content")))
    return tables.verify_manifest(one(f.where("doc_id % 11 <> 0"), F.col("text")), one(f.where("doc_id % 17 <> 0"), F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))


@query("verify_manifest", f"{VERIFY}\n;;\nselect * from v")
def _(spark, d):
    return _verified(spark, d)


@query("manifest_ok", f"{VERIFY}\n;;\nselect count(*) filter (status = 'changed') changed, count(*) filter (status = 'missing') missing, count(*) filter (status = 'extra') extra, bool_and(status not in ('changed', 'missing')) ok from v")
def _(spark, d):
    return tables.manifest_ok(_verified(spark, d))


# --- frames ----------------------------------------------------------------------------------------------------------


@query("choose_camera", f"with {FR}, c as (select experiment, camera, count(*) n, min(ts) seen from fr where status = 'ok' group by all)\n;;\nselect experiment, camera, n n_frames from (select *, row_number() over (partition by experiment order by n desc, seen) r from c) where r = 1")
def _(spark, d):
    return frames.choose_camera(frame_log(spark, d), ["experiment"])


@query("cameras_with_frames", f"with {FR}\n;;\nselect camera, row_number() over (order by case camera when 'view' then 1 when 'click' then 2 else 3 end, camera) as position from (select distinct camera from fr where status = 'ok')")
def _(spark, d):
    return frames.cameras_with_frames(frame_log(spark, d), ["view", "click"]).withColumn("position", F.col("position").cast("long"))


@query("frames_for_analysis", f"with {FR}, a as (select * from fr where status = 'ok' and camera = 'view' and event_id % 3 <> 0)\n;;\nselect event_id, (ts, file) = (select min((ts, file)) from a) is_reference from a")
def _(spark, d):
    f = frame_log(spark, d)
    return frames.frames_for_analysis(f, f.where("event_id % 3 <> 0").select("file"), "view").select("event_id", "is_reference")


@query("frames_for_analysis_by_experiment", f"with {FR}, a as (select * from fr where status = 'ok' and camera = 'view')\n;;\nselect event_id, (ts, file) = min((ts, file)) over (partition by experiment) is_reference from a")
def _(spark, d):
    f = frame_log(spark, d)
    return frames.frames_for_analysis(f, f.select("file"), "view", ["experiment"]).select("event_id", "is_reference")


@query("flag_filter", f"with {P}, {USED}\n;;\nselect event_id, x excluded_by_flag from u")
def _(spark, d):
    return frames.flag_filter(points(spark, d)).select("event_id", "excluded_by_flag")


EXCL = "e as (select 'f' || (event_id - k) frame_file, case when event_id % 2 = 0 then '' else plot end plot, 'r' || event_id reason, event_id pos from p where k < 20)"


def _exclusions(spark, d):
    return points(spark, d).where("k < 20").select(F.concat(F.lit("f"), F.col("event_id") - F.col("k")).alias("frame_file"), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("plot")).alias("plot"), F.concat(F.lit("r"), "event_id").alias("reason"), F.col("event_id").alias("pos"))


@query("manual_filter", f"with {P}, {EXCL}\n;;\nselect event_id, (select arg_min(reason, pos) from e where e.frame_file = p.frame_file and (e.plot = '' or e.plot = p.plot)) manual from p")
def _(spark, d):
    return frames.manual_filter(points(spark, d), _exclusions(spark, d)).select("event_id", "manual")


@query("hours_filter", f"with {P}, h as (select event_id, hour(ts + interval 1 hour) + minute(ts) / 60.0 + floor(second(ts)) / 3600.0 h from p)\n;;\nselect event_id, not (h >= 22 or h < 6.5) outside_hours from h")
def _(spark, d):
    return frames.hours_filter(points(spark, d), "22-6:30", "Europe/Berlin").select("event_id", "outside_hours")


@query("time_axis", f"{AXIS}\n;;\nselect event_id, t from a", "t", "event_id")
def _(spark, d):
    return frames.time_axis(points(spark, d), ["series_id"]).select("event_id", "t")


@query("default_metric", f"with {P}, f as (select series_id, arg_min(k, ts) k from p group by 1)\n;;\nselect series_id, case when k % 4 = 0 then 'extent_mm' when k % 4 = 1 then 'extent_px' when k % 4 = 2 then 'target_area_mm2' else 'coverage_pct' end metric from f")
def _(spark, d):
    p = points(spark, d)
    m = ["extent_mm", "extent_px", "target_area_mm2", "coverage_pct"]
    return frames.default_metric(p.withColumns({c: F.when(F.col("k") % 4 <= i, F.col("y")) for i, c in enumerate(m)}), ["series_id"], m)


@query("metric_unc_pairing", f"with {P}, q as (select *, case when k % 97 = 0 and event_type <> 'error' then null else unc end u from p)\n;;\nselect series_id, coalesce(bool_and(coalesce(u > 0, false)) filter (event_type <> 'error'), false) weighted from q group by 1")
def _(spark, d):
    p = points(spark, d).withColumn("unc", F.when((F.col("k") % 97 == 0) & (F.col("event_type") != "error"), None).otherwise(F.col("unc")))
    return frames.metric_unc_pairing(p, ["series_id"], F.col("event_type") != "error").select("series_id", "weighted").distinct()


@query("pick_evenly", f"with {P}, r as (select series_id, event_id, row_number() over w - 1 pos, count(*) over (partition by series_id) n from p window w as (partition by series_id order by ts)), c as (select distinct series_id, round_even(i * (n - 1) / 6.0, 0)::bigint pos from (select distinct series_id, n from r), range(7) t(i))\n;;\nselect series_id, event_id, r.pos as pos from r where n <= 7 or exists (select 1 from c where c.series_id = r.series_id and c.pos = r.pos)")
def _(spark, d):
    return frames.pick_evenly(points(spark, d), ["series_id"], ["ts"], 7).select("series_id", "event_id", F.col("pos").cast("long").alias("pos"))


@query("validation_template", f"with {P}, r as (select plot, series_id, frame_file, row_number() over w - 1 pos, count(*) over (partition by series_id) n from p window w as (partition by series_id order by ts)), c as (select distinct series_id, round_even(i * (n - 1) / 3.0, 0)::bigint pos from (select distinct series_id, n from r), range(4) t(i))\n;;\nselect series_id, frame_file, plot from r where n <= 4 or exists (select 1 from c where c.series_id = r.series_id and c.pos = r.pos)")
def _(spark, d):
    return frames.validation_template(points(spark, d), ["series_id"], 4).select("series_id", "frame_file", "plot")


@query("frame_key_match", f"""with {FR}, h as (select event_id hand_id, case event_id % 4 when 0 then file when 1 then 'f' || event_id when 2 then 'f' || event_id || '.png' else left(strftime(ts, '%Y-%m-%d %H:%M:%S'), 13 + (k % 7)) end as key from fr),
n as (select hand_id, key, min(f.event_id) m from h left join fr f on key in (f.file, 'f' || f.event_id, 'f' || f.event_id || '.png') group by all),
t as (select hand_id, count(*) c, min(f.event_id) e from n join fr f on m is null and starts_with(strftime(f.ts, '%Y-%m-%d %H:%M:%S'), key) group by 1)
;;
select hand_id, coalesce(m, case when c = 1 then e end) frame_id from n left join t using (hand_id)""")
def _(spark, d):
    f = frame_log(spark, d).withColumn("ts_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    key = F.when(F.col("event_id") % 4 == 0, F.col("file")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("f"), "event_id")).when(F.col("event_id") % 4 == 2, F.concat(F.lit("f"), "event_id", F.lit(".png"))).otherwise(F.left("ts_text", F.lit(13) + F.col("k") % 7))
    return frames.frame_key_match(f.select(F.col("event_id").alias("hand_id"), key.alias("key")), f.select(F.col("event_id").alias("frame_id"), "file", "ts_text")).select("hand_id", "frame_id")


@query("frame_status", f"with {FR}, g as (select *, case when status = 'ok' then s - lag(s) over (partition by camera, status order by ts) end gap from fr)\n;;\nselect camera, count(*) filter (status = 'ok') saved, count(*) filter (status = 'failed') failed, epoch(min(ts)) first_s, epoch(max(ts)) last_s, list_sort(list(gap) filter (gap is not null))[(count(gap) // 2) + 1] median_gap, max(gap) largest_gap from g group by 1", "first_s last_s median_gap largest_gap", "camera saved failed")
def _(spark, d):
    s = frames.frame_status(frame_log(spark, d))
    return s.select("camera", "saved", "failed", F.col("first").cast("double").alias("first_s"), F.col("last").cast("double").alias("last_s"), "median_gap", "largest_gap")


@query("list_plots", f"with {P}\n;;\nselect distinct series_id, case when plot = 'p0' then 'main' else plot end as plot from p")
def _(spark, d):
    return frames.list_plots(points(spark, d).withColumn("plot", F.nullif("plot", F.lit("p0"))), ["series_id"])


@query("experiment_facts", f"with {P}\n;;\nselect 'e' || (series_id % 5) experiment, count(distinct frame_file) frames, epoch(min(ts)) first_s, epoch(max(ts)) last_s, list_sort(list(distinct plot)) plots from p group by 1", "first_s last_s", "experiment frames plots")
def _(spark, d):
    f = frames.experiment_facts(points(spark, d).withColumn("experiment", F.concat(F.lit("e"), F.col("series_id") % 5)))
    return f.select("experiment", "frames", "plots", F.col("first").cast("double").alias("first_s"), F.col("last").cast("double").alias("last_s"))


@query("parse_duration", f"with {P}\n;;\nselect event_id, case event_id % 5 when 0 then (k + 1)::double when 1 then (k + 1) * 60.0 when 2 then 3600.0 + (k % 60) * 60 when 3 then (k + 1) * 86400.0 else null end secs from p", "secs", "event_id")
def _(spark, d):
    k = F.col("k")
    t = F.when(F.col("event_id") % 5 == 0, (k + 1).cast("string")).when(F.col("event_id") % 5 == 1, F.concat(k + 1, F.lit(" min"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit("1h"), k % 60, F.lit("m"))).when(F.col("event_id") % 5 == 3, F.concat(k + 1, F.lit(" days"))).otherwise(F.concat(k, F.lit(" parsecs")))
    return points(spark, d).select("event_id", frames.parse_duration(t).alias("secs"))


@query("flag_counts", f"with {P}\n;;\nselect series_id, flag, count(*) n from (select series_id, unnest(flags) flag from p) group by all")
def _(spark, d):
    return frames.flag_counts(points(spark, d), ["series_id"])


# --- series ----------------------------------------------------------------------------------------------------------

BUILT = f"""with {P}, {EXCL}, m as (select p.event_id, min(pos) pos from p join e on e.frame_file = p.frame_file and (e.plot = '' or e.plot = p.plot) group by 1),
q as (select p.*, s - min(s) over (partition by series_id) ds, max(s) over (partition by series_id) - min(s) over (partition by series_id) span, hour(ts + interval 1 hour) h, m.pos from p left join m using (event_id)),
bs as (select series_id, event_id, s, y, unc, ds / case when span < 7200 then 60.0 when span < 259200 then 3600.0 else 86400.0 end t, case when pos is not null then 'r' || pos end manual, not (h >= 5 and h < 23) outside_hours, list_has_any(flags, ['align_failed', 'blurry']) or pos is not null or not (h >= 5 and h < 23) excluded from q)"""


def _built(spark, d):
    return series.build_series(points(spark, d), ["series_id"], _exclusions(spark, d), "5-23", "Europe/Berlin")


@query("build_series", f"{BUILT}\n;;\nselect series_id, event_id, t, y, unc, manual, outside_hours, excluded from bs", "t y unc", "series_id event_id manual outside_hours excluded")
def _(spark, d):
    return _built(spark, d).select("series_id", "event_id", "t", "y", "unc", "manual", "outside_hours", "excluded")


JUMPS = """u as (select * from {src} where not excluded),
n as (select *, max(abs(y)) over (partition by series_id) top, list({{'t': t, 'y': y}}) over (partition by series_id order by t rows between 3 preceding and 1 preceding) b, list({{'t': t, 'y': y}}) over (partition by series_id order by t rows between 1 following and 3 following) f from u),
nb as (select *, list_concat(coalesce(b, []), coalesce(f, [])) pts from n),
sl as (select event_id, median((q.y - r.y) / (q.t - r.t)) m from (select event_id, unnest(pts) r, pts from nb) x, lateral (select unnest(x.pts) q) where q.t > r.t group by 1),
ic as (select event_id, m, median(r.y - m * r.t) c from (select event_id, unnest(pts) r from nb) join sl using (event_id) group by all),
rs as (select event_id, m, c, r.y - m * r.t - c e from (select event_id, unnest(pts) r from nb) join ic using (event_id)),
md as (select event_id, m, c, mad(e) mad from rs group by all),
jp as (select nb.event_id, coalesce(len(b) > 0 and len(f) > 0 and len(pts) >= 3 and abs(y - m * t - c) > 4 * greatest(1.4826 * mad, coalesce(unc, 0), 1e-9 + 1e-6 * top), false) jump from nb join md using (event_id))"""


@query("detect_jumps", f"{AXIS}, {JUMPS.format(src='a')}\n;;\nselect a.event_id, coalesce(jump, false) jump from a left join jp using (event_id)")
def _(spark, d):
    return series.detect_jumps(_axis(spark, d), ["series_id"]).select("event_id", "jump")


RETREATS = "select event_id, not excluded and max(case when not excluded then y end) over (partition by series_id order by t) - y > greatest(3 * coalesce(unc, 0), 1e-9) retreat from a"


@query("mark_retreats", f"{AXIS}\n;;\nselect event_id, coalesce(retreat, false) retreat from ({RETREATS})")
def _(spark, d):
    return series.mark_retreats(_axis(spark, d), ["series_id"]).select("event_id", "retreat")


for _how, _agg in (("median", "median(y)"), ("mean", "avg(y)"), ("p90", "quantile_cont(y, 0.9)")):

    @query(f"daily_series_{_how}" if _how != "median" else "daily_series", f"{AXIS}\n;;\nselect series_id, (ts + interval 1 hour)::date as day, {_agg} y, median(s) ts_mid, count(*) n_frames from a where not excluded group by all", "y ts_mid", "series_id day n_frames")
    def _(spark, d, how=_how):
        return series.daily_series(_axis(spark, d), ["series_id"], "Europe/Berlin", how)


@query("stream_daily", f"{AXIS}\n;;\nselect series_id, (ts + interval 1 hour)::date as day, median(y) y, median(s) ts_mid, count(*) n_frames from a where not excluded group by all", "y ts_mid", "series_id day n_frames")
def _(spark, d):
    """The same from a stream: the series' rows as files, read as they come, with state."""
    home = f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}"
    rows = _axis(spark, d).select("series_id", "ts", "y", "excluded")
    rows.write.parquet(f"{home}/rows")
    with live.keyed_state(spark):
        live.write_days(live.stream_daily(spark.readStream.schema(rows.schema).parquet(f"{home}/rows"), ["series_id"], "Europe/Berlin"), f"{home}/days", f"{home}/checkpoint").awaitTermination()
    return live.latest_days(spark.read.parquet(f"{home}/days"), ["series_id"])


@query("daily_uncertainty")
def _(spark, d):
    return series.daily_uncertainty(_axis(spark, d), ["series_id"], draws=400)


DAILY = f"{AXIS}, dd as (select series_id, epoch(ts::date)::bigint event_id, median(y) y, (epoch(ts::date) / 86400) t, null::double unc, false excluded from a where not excluded group by series_id, ts::date)"


@query("local_day_rerun", f"{DAILY}, {JUMPS.format(src='(select series_id * 100000000000 + event_id event_id, series_id, y, t, unc, excluded from dd)')}, rt as (select series_id * 100000000000 + event_id event_id, series_id, t, y, max(y) over (partition by series_id order by t) - y > 1e-9 retreat from dd)\n;;\nselect series_id, t, y, coalesce(jump, false) jump, retreat from rt left join jp using (event_id)", "t y", "series_id jump retreat")
def _(spark, d):
    day = series.daily_series(_axis(spark, d), ["series_id"]).withColumns({"t": F.unix_date("day").cast("double"), "unc": F.lit(None).cast("double"), "excluded": F.lit(False)})
    return series.mark_retreats(series.detect_jumps(day, ["series_id"]), ["series_id"]).select("series_id", "t", "y", "jump", "retreat")


VIEWS = f"""with {P}, o as (select series_id, s s0, y y0, row_number() over (partition by series_id order by ts, y) v from p where event_type = 'view'),
nr as (select o.series_id, v, event_type camera, p.y y1, row_number() over (partition by o.series_id, v, event_type order by abs(p.s - s0), p.s) r from o join p on p.series_id = o.series_id and event_type in ('click', 'signup') and abs(p.s - s0) <= 7200),
al as (select series_id, v, camera, y1 y from nr where r = 1 union all select series_id, v, 'view', y0 from o),
cv as (select series_id, v as "view", max(y) y, count(*) n_views, arg_min(camera, (-y, case when camera = 'view' then '' else camera end)) best, max(y) - min(y) spread from al group by all)"""


def _views(spark, d):
    p = points(spark, d).where("event_type in ('view', 'click', 'signup')").withColumnRenamed("event_type", "camera")
    return series.combine_views(p, ["series_id"], "view", "max", 7200.0)


@query("combine_views", f"{VIEWS}\n;;\nselect series_id, \"view\", y, n_views, best, spread from cv", "y spread", 'series_id "view" n_views best')
def _(spark, d):
    return _views(spark, d).select("series_id", F.col("view").cast("long").alias("view"), "y", "n_views", "best", "spread")


@query("mean_spread", f"{VIEWS}\n;;\nselect series_id, avg(spread) filter (n_views > 1) mean_spread from cv group by 1", "mean_spread", "series_id")
def _(spark, d):
    return series.mean_spread(_views(spark, d), ["series_id"])


def _variants(spark, d):
    p = points(spark, d).withColumn("excluded", F.lit(False))
    return p.withColumn("variant", F.lit("baseline")).unionByName(p.withColumns({"variant": F.lit("wider"), "y": F.col("y") * (1 + (F.col("k") - 50) / 1000), "excluded": F.col("k") % 9 == 0})).unionByName(p.withColumns({"variant": F.lit("nothing"), "excluded": F.lit(True)}))


@query("sensitivity_compare", f"with {P}, j as (select series_id, ts, unc, y * (1 + (k - 50) / 1000.0) - y dd from p where k % 9 <> 0), w as (select series_id, count(*) n, avg(abs(dd)) mean_abs, max(abs(dd)) max_abs, avg(dd) mean_change, arg_max(dd, ts) last_change, avg(abs(dd)) / avg(unc) in_units from j group by 1), s as (select distinct series_id from p)\n;;\nselect series_id, 'wider' variant, n, mean_abs, max_abs, mean_change, last_change, in_units, null error from w union all select series_id, 'nothing', 0, null, null, null, null, null, 'no shared frame' from s", "mean_abs max_abs mean_change last_change in_units", "series_id variant n error")
def _(spark, d):
    return series.sensitivity_compare(_variants(spark, d), "baseline", ["series_id"])


@query("quality_long", f"with {P}\n;;\nselect event_id, 'unc' quantity, unc as value from p union all select event_id, 'y', y from p", "value", "event_id quantity")
def _(spark, d):
    return series.quality_long(points(spark, d), ["event_id"], ["unc", "y"])


@query("gap_detection", f"with {P}, g as (select event_id, s - lag(s) over (partition by series_id order by ts) - 7200 late_s from p)\n;;\nselect event_id, late_s, floor(late_s / 7200)::bigint missed from g where late_s >= 7200", "late_s", "event_id missed")
def _(spark, d):
    return checks.gap_detection(points(spark, d), ["series_id"], 7200.0).select("event_id", "late_s", F.col("missed").cast("long").alias("missed"))


@query("capture_sessions", f"with {P}, g as (select *, case when s - lag(s) over w < 14400 then 0 else 1 end n from p window w as (partition by series_id order by ts)), i as (select *, sum(n) over (partition by series_id order by ts) i from g)\n;;\nselect series_id, count(*) frames, epoch(min(ts)) first_s, epoch(max(ts)) last_s from i group by series_id, i", "first_s last_s", "series_id frames")
def _(spark, d):
    s = checks.capture_sessions(points(spark, d), ["series_id"], 7200.0)
    return s.select("series_id", "frames", F.col("first").cast("double").alias("first_s"), F.col("last").cast("double").alias("last_s"))


# --- covariates ------------------------------------------------------------------------------------------------------

RD = f"""with {P}, r as (select series_id, s, y v from p where event_type = 'purchase'), g as (select series_id, 3 * median(gap) max_gap from (select series_id, s - lag(s) over (partition by series_id order by s) gap from r) group by 1)"""


@query("covariate_max_gap", f"{RD}\n;;\nselect series_id, max_gap from g", "max_gap", "series_id")
def _(spark, d):
    return covariates.covariate_max_gap(readings(spark, d), ["series_id"])


AT = """atx as (select q.id, q.series_id, q.s, lo.s ls, lo.v lv, hi.s hs, hi.v hv, max_gap from {q} q asof left join r lo on q.series_id = lo.series_id and q.s >= lo.s asof left join r hi on q.series_id = hi.series_id and q.s <= hi.s left join g on g.series_id = q.series_id),
cv as (select id, series_id, s, case when ls = s then lv when hs = s then hv when hs - ls <= max_gap then lv + (hv - lv) * (s - ls) / (hs - ls) end v from atx)"""


@query("covariate_at", f"{RD}, {AT.format(q='(select event_id id, series_id, s from p where event_type = ' + chr(39) + 'view' + chr(39) + ')')}\n;;\nselect id event_id, v as value from cv", "value", "event_id")
def _(spark, d):
    t = points(spark, d).where("event_type = 'view'").select("series_id", "ts", "event_id")
    return covariates.covariate_at(t, readings(spark, d), ["series_id"]).select("event_id", "value")


SUMMARY = """wi as (select series_id, w, a, a + 432000 b from {src}),
ends as (select series_id * 100 + w * 2 id, series_id, a s from wi union all select series_id * 100 + w * 2 + 1, series_id, b from wi), {at},
pt as (select distinct series_id, w, s, v from (select wi.series_id, w, r.s, r.v from wi join r on r.series_id = wi.series_id and r.s between a and b union all select series_id, (id % 100) // 2, s, v from cv where v is not null)),
st as (select *, lead(s) over x - s ds, lead(v) over x v2 from pt window x as (partition by series_id, w order by s)),
su as (select st.series_id, w, sum(ds) filter (ds <= max_gap) covered, sum(ds * (v + v2) / 2) filter (ds <= max_gap) area, min(v) lo, max(v) hi from st left join g on g.series_id = st.series_id group by all)"""


@query("covariate_summary", f"{RD}, {SUMMARY.format(src='(select series_id, unnest([0, 1, 2]) w, epoch(timestamp ' + chr(39) + '2024-01-03' + chr(39) + ') + 604800 * unnest([0, 1, 2]) a from (select distinct series_id from p))', at=AT.format(q='ends'))}\n;;\nselect wi.series_id, w as win, area / covered as mean, lo as low, hi as high, coalesce(covered / 432000, 0) coverage from wi left join su using (series_id, w)", "mean low high coverage", "series_id win")
def _(spark, d):
    s = points(spark, d).select("series_id").distinct()
    w = s.withColumn("window", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    start = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-03").cast("timestamp")) + 604800 * F.col("window"))
    w = w.withColumn("start", start).withColumn("end", F.timestamp_seconds(F.unix_timestamp("start") + 432000))
    out = covariates.covariate_summary(w, readings(spark, d), ["series_id"])
    return out.select("series_id", F.col("window").alias("win"), "mean", F.col("min").alias("low"), F.col("max").alias("high"), "coverage")


@query("covariate_inventory", f"{RD}\n;;\nselect series_id, count(*) n, min(v) low, max(v) high, median(gap) interval_s from (select *, s - lag(s) over (partition by series_id order by s) gap from r) group by 1", "low high interval_s", "series_id n")
def _(spark, d):
    return covariates.covariate_inventory(readings(spark, d), ["series_id"])


@query("covariate_over_fit")
def _(spark, d):
    out = covariates.covariate_over_fit(_axis(spark, d), readings(spark, d), ["series_id"], ["purchase"])
    return out.select("series_id", "name", "mean", "coverage", "warning")
