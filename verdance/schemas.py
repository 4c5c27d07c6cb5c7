"""Schemas and fixed names of the canonical tables."""

from pyspark.sql import types as T

FRAMES = T.StructType([
    T.StructField("timestamp_utc", T.TimestampType()), T.StructField("camera", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("file", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("scheduled_utc", T.TimestampType()),
    T.StructField("lag_s", T.DoubleType()), T.StructField("mean_brightness", T.DoubleType()), T.StructField("sharpness", T.DoubleType()),
    T.StructField("camera_settings", T.StringType()), T.StructField("notes", T.StringType()),
])

# Fixed values that results must agree on.
STATUS = ["ok", "failed"]
FLAGS = ["align_failed", "align_poor", "brightness_changed", "blurry", "lighting_changed", "saturated", "unfamiliar_input", "no_target", "no_reference", "centerline_failed"]
EXCLUDED_BY_DEFAULT = ["align_failed", "blurry"]
METRICS = ["extent_mm", "extent_px", "target_area_mm2", "coverage_pct"]
TIME_UNITS = {"s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0}
Z95 = 1.959964
