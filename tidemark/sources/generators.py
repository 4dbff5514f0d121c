"""Deterministic metric and log generators, static dimensions and clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import interval_minutes

#: Base, first step, slope and ceiling of the generated metrics.
RAMPS = {"cpu": (10.0, 0.5, 8.5, 96.0), "memory": (30.0, 1.0, 5.5, 85.0)}
TOTAL_GB = 8.0
#: Regions and log topics.
REGIONS = [("北京", "ap-beijing", True), ("上海", "ap-shanghai", True), ("广州", "ap-guangzhou", True)]
TOPICS = [
    ("topic-001", "数据同步服务日志", "data-sync-service", "ap-beijing"),
    ("topic-002", "数据同步服务错误日志", "data-sync-service", "ap-beijing"),
    ("topic-003", "API网关服务日志", "api-gateway-service", "ap-shanghai"),
]


def ramp(index: Column, kind: str) -> Column:
    base, first, slope, top = RAMPS[kind]
    return F.when(index < 3, base + index * first).otherwise(F.least(base + (index - 2) * slope, F.lit(top)))


def metric_points(asked: DataFrame, kind: str = "cpu", noise: float = 0.0, seed: int = 7) -> DataFrame:
    """Points of asked(service_name, start, end, interval) on a grid that includes both ends."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), interval_minutes(F.col("interval")))
    rows = asked.where("start <= end").select("service_name", F.posexplode(F.sequence("start", "end", step)).alias("ix", "ts"))
    value = ramp(F.col("ix"), kind) + (F.rand(seed) * 2 - 1) * noise
    value = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(value, 1)))
    out = rows.select("service_name", "ix", "ts", F.date_format("ts", "HH:mm").alias("timestamp"), value.alias("value"))
    return out.withColumn("used_gb", F.round(F.col("value") / 100.0 * TOTAL_GB, 2)).withColumn("total_gb", F.lit(TOTAL_GB)) if kind == "memory" else out


def log_lines(spark: SparkSession, start_ms: int, end_ms: int, limit: int = 100, message: str = "sync") -> DataFrame:
    """One INFO line a minute, both ends included, at most limit."""
    n = max(0, min(limit, (end_ms - start_ms) // 60_000 + 1))
    return spark.range(n).select(F.timestamp_millis(F.lit(start_ms) + F.col("id") * 60_000).alias("ts"), F.lit("INFO").alias("level"), F.lit(message).alias("message"))


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "region_name string, region_code string, available boolean")


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPICS, "topic_id string, topic_name string, service_name string, region_code string")


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def now_text(zone: str = "Asia/Shanghai") -> Column:
    return F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), zone), "yyyy-MM-dd HH:mm:ss")
