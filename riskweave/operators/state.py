"""Tables of current values (settings, limits, latencies) and what reads them: state that changes between batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .events import DAY, LIMIT, WINDOW_MS

KEEP_EVENTS_DAYS = 90
KEEP_SENT_HOURS = 24
STATE = "key string, value string, changed_at long"


def upsert(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state (key, value, changed_at) after the changes: of a key the newest value counts, a null one removes it.

    Of equal times a change counts over the state, then the greater value. A null key is no key.
    """
    both = state.withColumn("_new", F.lit(0)).unionByName(changes.select("key", "value", "changed_at").withColumn("_new", F.lit(1)))
    newest = both.filter(F.col("key").isNotNull()).groupBy("key").agg(F.max(F.struct("changed_at", "_new", F.col("value").isNull().alias("_gone"), "value")).alias("s"))
    return newest.filter(F.col("s.value").isNotNull()).select("key", "s.value", "s.changed_at")


def write_state(state: DataFrame, path: str, version: int) -> None:
    """A state is written whole under its version; readers of an older one are not disturbed."""
    state.select("key", "value", "changed_at").write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_state(spark: SparkSession, path: str, keys: tuple[str, ...] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    """The newest version, or of it the rows of some keys; keys that it lacks have their default."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version")).first()[0]
    found = versions.filter(F.col("version") == F.lit(newest)).select("key", "value", "changed_at")
    return lookup(found, keys, defaults) if keys or defaults else found


def lookup(state: DataFrame, keys: tuple[str, ...] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    wanted = [(k, (defaults or {}).get(k)) for k in dict.fromkeys([*keys, *(defaults or {})])]
    asked = state.sparkSession.createDataFrame(wanted, "key string, _default string")
    return F.broadcast(asked).join(state, "key", "left").select("key", F.coalesce("value", "_default").alias("value"), "changed_at")


def configured(events: DataFrame, state: DataFrame, key: Column, default: str | None = None) -> DataFrame:
    """Adds ``setting``: what the state says of ``key`` now, else the default. The state is read anew with each batch."""
    known = state.select(F.col("key").alias("_key"), F.col("value").alias("setting"))
    return events.withColumn("_key", key).join(known, "_key", "left").drop("_key").withColumn("setting", F.coalesce("setting", F.lit(default)))


def limiter_state(accepted: DataFrame, key: str, ts_ms: str, now_ms: Column, limit: int = LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """Of each key: how many accepted events its window holds now, and how many it may hold."""
    used = F.count_if((F.col(ts_ms) > now_ms - window_ms) & (F.col(ts_ms) <= now_ms))
    return accepted.groupBy(key).agg(used.alias("used")).select(key, "used", F.lit(limit).alias("max"), F.lit(window_ms // 1000).alias("window_seconds"))


def retained_events(events: DataFrame, now: Column, days: int = KEEP_EVENTS_DAYS, sent_hours: int = KEEP_SENT_HOURS) -> DataFrame:
    """Events (timestamp, user_action) within ``days``; those that were sent anyway go after ``sent_hours``."""
    age = now - F.col("timestamp")
    return events.filter((age <= days * DAY) & ~((F.col("user_action") == "send_anyway") & (age > sent_hours * 3600)))


def stats(events: DataFrame, by: tuple[str, ...] = ("category", "severity")) -> DataFrame:
    """Events, hosts and the newest time of each group."""
    return events.groupBy(*by).agg(F.count("*").alias("n_events"), F.count_distinct("domain_hash").alias("n_hosts"), F.max("timestamp").alias("newest"))


def health(events: DataFrame, now: Column, quiet_s: int = DAY) -> DataFrame:
    """One row: ``ok`` while an event came within ``quiet_s``, else ``error``; how many there are, and the newest's time."""
    return events.agg(F.count("*").alias("n_events"), F.max("timestamp").alias("newest")).select(F.when(F.coalesce(now - F.col("newest") <= quiet_s, F.lit(False)), "ok").otherwise("error").alias("status"), "n_events", "newest")


def latency(runs: DataFrame, ms: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Runs, their mean and longest time."""
    return runs.groupBy(*by).agg(F.count(ms).alias("n"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"))


def live_entries(entries: Column, now: Column, cap: int) -> Column:
    """A map of key to (dismissed_at, created_at, expires_at) without the expired, and of the others the newest ``cap``."""
    when = lambda v: F.coalesce(F.nullif(v["dismissed_at"], F.lit(0)), v["created_at"], F.lit(0))
    live = F.map_entries(F.map_filter(entries, lambda _, v: v["expires_at"] > now))
    order = F.array_sort(F.transform(live, lambda e: F.struct((-when(e["value"])).alias("age"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.map_from_entries(F.transform(F.slice(order, 1, cap), lambda e: F.struct(e["key"], e["value"])))
