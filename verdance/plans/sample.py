"""The driver tables as canonical tables: events are measurements, frames and sensor readings; orders are a study;
embeddings are 8 x 8 images; documents and pages are files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 digits, so that another engine's order of summation doesn't show."""
    return df.select(*((F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def query(name: str, sql: str | None = None, doubles: str = "", rest: str = "") -> Callable[[Query], Query]:
    """Registers a query and, if SQL can express it, its SQL; doubles and rest name the result's columns."""

    def put(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql is not None:
            cols = [*rest.split(), *(f"round({c}, 6) + 0.0 as {c}" for c in doubles.split())]
            with_, _, body = sql.strip().rpartition("\n;;\n")
            ORACLE_SQL[name] = f"{with_}\nselect {', '.join(cols)} from ({body})" if cols else f"{with_}\n{body}"
        return f

    return put


#: SQL of the tables below.
P = """p as (select user_id series_id, event_id, 'f' || event_id frame_file, 'p' || (cast(props->>'$.k' as int) % 3) plot, ts, epoch(ts) s, event_type, value y, cast(props->>'$.k' as int) k, (cast(props->>'$.k' as int) + 1) / 100.0 unc,
 case event_type when 'error' then ['blurry'] when 'signup' then ['align_poor'] else [] end flags from events)"""
FR = """fr as (select event_id, 'e' || (user_id % 5) experiment, event_type camera, ts, epoch(ts) s, case when cast(props->>'$.k' as int) % 10 = 0 then 'failed' else 'ok' end status, 'cam/' || event_type || '/f' || event_id || '.png' file, value mean_brightness, cast(props->>'$.k' as int) k from events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as rows of a metric: series_id (the user), frame_file, plot, ts, y, unc, flags."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    flags = F.when(F.col("event_type") == "error", F.array(F.lit("blurry"))).when(F.col("event_type") == "signup", F.array(F.lit("align_poor"))).otherwise(F.array().cast("array<string>"))
    return e.select(F.col("user_id").alias("series_id"), "event_id", F.concat(F.lit("f"), "event_id").alias("frame_file"), F.concat(F.lit("p"), k % 3).alias("plot"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("y"), k.alias("k"), ((k + 1) / 100.0).alias("unc"), flags.alias("flags"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a frame log: experiment, camera (the event type), ts, status, file."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.concat(F.lit("e"), F.col("user_id") % 5).alias("experiment"), F.col("event_type").alias("camera"), F.col("ts").cast("timestamp").alias("ts"), F.when(k % 10 == 0, "failed").otherwise("ok").alias("status"), F.concat(F.lit("cam/"), "event_type", F.lit("/f"), "event_id", F.lit(".png")).alias("file"), F.col("value").alias("mean_brightness"), k.alias("k"))


def readings(spark: SparkSession, sf_dir: str, by_user: bool = True) -> DataFrame:
    """Purchases as sensor readings: (series_id,) name, ts, value."""
    p = points(spark, sf_dir).where("event_type = 'purchase'")
    return p.select("series_id", F.lit("purchase").alias("name"), "ts", F.col("y").alias("value"))


def study_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per month as replicates: condition (market segment), replicate (nation), t (months), y (cumulative price in
    millions)."""
    from pyspark.sql import Window

    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows by definition
    month = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")
    m = j.groupBy(F.col("c_mktsegment").alias("condition"), F.col("n_name").alias("replicate"), month.cast("double").alias("t")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")) / 1_000_000).cast("double").alias("dy"))
    w = Window.partitionBy("condition", "replicate").orderBy("t")
    return m.withColumn("y", F.sum("dy").over(w)).withColumn("unc", F.lit(None).cast("double")).withColumn("excluded", F.lit(False)).drop("dy")


S = """m as (select c_mktsegment condition, n_name replicate, ((year(o_orderdate) - 1992) * 12 + month(o_orderdate))::double t, sum(o_totalprice::decimal(18,2))::double / 1000000 dy from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all),
sp as (select condition, replicate, t, sum(dy) over (partition by condition, replicate order by t) y from m)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 images: frame (vec_id), grp (label), x, y, b, g, r."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("grp"), F.posexplode("embedding").alias("i", "v"))
    ch = lambda k: F.pmod(F.floor(F.abs(F.col("v").cast("double")) * k), F.lit(256)).cast("int")
    return e.select("frame", "grp", (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), ch(1000).alias("b"), ch(1700).alias("g"), ch(2300).alias("r"))


PX = """px as (select vec_id frame, label grp, ((i - 1) % 8)::int x, ((i - 1) // 8)::int y, (floor(abs(v) * 1000)::bigint % 256)::int b, (floor(abs(v) * 1700)::bigint % 256)::int g, (floor(abs(v) * 2300)::bigint % 256)::int r
 from (select vec_id, label, unnest(range(1, 65)) i, unnest(embedding)::double v from embeddings))"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with documents as scored items: id, grp (language), quality and toxic as two masks' bits."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), "source", "n_chars", F.col("quality").cast("boolean").alias("pred"), F.col("toxic").cast("boolean").alias("truth"))


LB = "lb as (select doc_id id, lang grp, source, n_chars, quality::boolean pred, toxic::boolean truth from labels join documents using (doc_id))"
