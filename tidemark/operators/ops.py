"""Metric statistics, alerts, log search and dimension look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small


def order_statistic(df: DataFrame, group: str, value: str, index: Column) -> DataFrame:
    """group, value: the value at `index` (from 0, an expression over n) of each group's sorted values, exactly.

    Equal values are counted map-side; distinct ones are range-partitioned and ranked by
    running totals within and across partitions, so a group may be of any size.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    dealt = counts.repartitionByRange(parts, group, value).withColumn("part", F.spark_partition_id())
    # one row per group and partition
    totals = dealt.groupBy(group, "part").agg(F.sum("c").alias("c"))
    whole = Window.partitionBy(group)
    bases = totals.select(group, "part", (F.sum("c").over(whole.orderBy("part")) - F.col("c")).alias("base"), F.sum("c").over(whole).alias("n"), F.col("c").alias("own"))
    hit = bases.withColumn("at", F.least(index, F.col("n") - 1).cast("long")).where("at >= base AND at < base + own").drop("own", "n")
    run = F.sum("c").over(Window.partitionBy(group, "part").orderBy(value))
    ranked = dealt.join(hit, [group, "part"]).withColumn("end", F.col("base") + run)
    return ranked.where("end > at AND end - c <= at").select(group, value)


def metric_stats(points: DataFrame, group: str, value: str, threshold: float) -> DataFrame:
    """group, n, avg, max, min, p95 (sorted value at n * 0.95) and whether the threshold was passed."""
    plain = points.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"))
    p95 = order_statistic(points, group, value, F.floor(F.col("n") * F.lit(0.95))).withColumnRenamed(value, "p95")
    return plain.join(p95, group, "left").withColumn("triggered", F.col("max") > threshold)


def metric_report(points: DataFrame, metric: str, threshold: float, message: str, fine: str, group: str = "service_name", value: str = "value", order: str = "ix") -> DataFrame:
    """One row per service of points(service_name, ix, timestamp, value): metric_name, its points in order, statistics to two
    decimals and the alert with its message. A service's points are those of one asked range, so they are gathered."""
    nested = points.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "timestamp", value))).alias("_p"))
    stats = metric_stats(points, group, value, threshold)
    two = lambda c: F.round(c, 2)
    statistics = F.struct(two(F.col("avg")).alias("avg"), F.col("max"), F.col("min"), two(F.col("p95")).alias("p95"), F.col("triggered").alias("spike_detected"))
    alert = F.struct(F.col("triggered"), F.lit(threshold).alias("threshold"), F.when(F.col("triggered"), message).otherwise(fine).alias("message"))
    shown = F.transform("_p", lambda x: F.struct(x["timestamp"], x[value].alias("value")))
    return nested.join(stats, group).select(group, F.lit(metric).alias("metric_name"), shown.alias("data_points"), statistics.alias("statistics"), alert.alias("alert_info"))


#: Messages of the two metrics' alerts.
CPU_MESSAGES = ("CPU 使用率持续超过 80% 阈值", "CPU 使用率正常")
MEMORY_MESSAGES = ("内存使用率超过 70% 阈值，存在内存压力", "内存使用率正常")


def windowed_alerts(points: DataFrame, group: str, value: str, threshold: float, width: str = "5 minutes") -> DataFrame:
    """Extension: tumbling windows in which every point is above the threshold."""
    w = points.groupBy(group, F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.min(value).alias("lowest"))
    return w.select(group, F.col("w.start").alias("window_start"), "n", (F.col("lowest") > threshold).alias("sustained"))


def search_logs(logs: DataFrame, start: Column, end: Column, topic: str | None = None, limit: int | None = 100) -> DataFrame:
    """Lines of logs(ts, topic, ...) from start to end, both included, oldest first."""
    own = logs.where(F.col("ts").between(start, end))
    if topic is not None:
        own = own.where(F.col("topic") == topic)
    return own if limit is None else own.orderBy("ts", "event_id").limit(limit)


def match_topics(topics: DataFrame, asked: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Topics for each row of asked(service_name, region_code): fuzzy matches if either name holds the
    other, case aside; a missing or empty region admits all."""
    t, a = small(topics).alias("t"), asked.alias("a")
    mine, theirs = F.col("a.service_name"), F.col("t.service_name")
    low, other = F.lower(mine), F.lower(theirs)
    same = (F.contains(other, low) | F.contains(low, other)) if fuzzy else (mine == theirs)
    region = F.coalesce(F.col("a.region_code"), F.lit("")).isin("") | (F.col("a.region_code") == F.col("t.region_code"))
    return a.join(t, same & region).select(mine.alias("asked"), F.col("a.region_code").alias("asked_region"), "t.topic_id", "t.topic_name", "t.service_name", "t.region_code")


def find_topic(topics: DataFrame, asked: DataFrame) -> DataFrame:
    """The first topic of each asked(topic_name, region_code); a row with a null topic_id where there is none."""
    a, t = asked.alias("a"), topics.alias("t")
    joined = a.join(t, (F.col("a.topic_name") == F.col("t.topic_name")) & (F.col("a.region_code").isNull() | (F.col("a.region_code") == F.col("t.region_code"))), "left")
    return joined.groupBy(F.col("a.topic_name").alias("topic_name"), F.col("a.region_code").alias("asked_region")).agg(F.min("t.topic_id").alias("topic_id"))


def find_region(regions: DataFrame, asked: DataFrame) -> DataFrame:
    """region_code and available of each asked(region_name); unknown names are not available."""
    return asked.join(small(regions), "region_name", "left").select("region_name", "region_code", F.coalesce("available", F.lit(False)).alias("available"))
