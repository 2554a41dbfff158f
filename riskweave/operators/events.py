"""Finding events: building, validating, auditing, dismissing and rate-limiting them in batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules
from ..functions import dismiss_key, facet, host_hash

REQUIRED = ("event_version", "domain_hash", "facet", "category", "severity", "user_action", "timestamp", "model_version", "app_version", "confidence")
OPTIONAL = ("id", "fp_reason", "match_count")
FIELDS = (*REQUIRED, *OPTIONAL)
TYPES = dict(zip(FIELDS, ("int", "string", "int", "string", "string", "string", "bigint", "string", "string", "double", "string", "string", "int"), strict=True))
DAY = 86_400
TTL, DISMISSALS_CAP, AUDIT_CAP, BUFFER_CAP = 24 * 3600, 1000, 1000, 200
LIMIT, WINDOW_MS = 100, 60_000


def build_events(findings: DataFrame, *, host: Column, action: Column, at: Column, app_version: str = "1.0", keys: tuple[str, ...] = ()) -> DataFrame:
    """One version-1 event for each finding row (category, severity, facet); confidence 1 unless a column has it."""
    confidence = F.coalesce("confidence", F.lit(1.0)) if "confidence" in findings.columns else F.lit(1.0)
    return findings.select(
        *keys, F.lit(1).alias("event_version"), host_hash(host).alias("domain_hash"), facet(F.col("category")).alias("facet"), "category", "severity", action.alias("user_action"),
        at.cast("bigint").alias("timestamp"), F.lit(f"{app_version}+regex-v1").alias("model_version"), F.lit(app_version).alias("app_version"), confidence.cast("double").alias("confidence"),
    )


def false_positive_event(events: DataFrame, reason: Column, opted_in: Column) -> DataFrame:
    """Of the opted-in, the event without facet, with its reason cut to 200 characters."""
    return events.filter(opted_in).drop("facet").withColumns({"user_action": F.lit("dismiss_false_positive"), "fp_reason": F.substring(reason, 1, 200)})


def queue_event(df: DataFrame) -> DataFrame:
    """The wider queue form: defaults for what is missing, empty extras absent. Not to be mixed with wire events."""
    or_ = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c)
    texts, numbers = ("attack_keywords_hash", "attack_pattern_id", "bundle_signature"), ("model_consensus", "similar_attack_count_30d")
    extras = [F.nullif(F.col(c), F.lit("" if c in texts else 0)).alias(c) for c in (*texts, *numbers) if c in df.columns]
    return df.select("timestamp", "domain_hash", "category", or_("severity", "info"), or_("user_action", "detect"), or_("model_version", "unknown"), or_("app_version", "unknown"), *extras)


def json_event() -> Column:
    """Canonical JSON: the fields in their fixed order, absent ones left out."""
    return F.to_json(F.struct(*FIELDS))


def validate(raw: DataFrame, now: Column, json_col: str = "json") -> DataFrame:
    """Adds ``reason`` (null: valid) to rows of raw JSON; the first failed check counts, in a fixed order.

    Codes hold no values. ``now``: epoch seconds; a timestamp may be a day off either way.
    """
    j = F.col(json_col)
    parsed = F.array(F.struct(F.try_parse_json(j).alias("event"), F.json_object_keys(j).alias("keys")))
    # bound once for all checks; as plain columns both would be parsed anew for each of them
    return raw.withColumn("reason", F.get(F.transform(parsed, lambda p: _first_failed(p["event"], p["keys"], now)), F.lit(0)))


def _first_failed(variant: Column, keys: Column, now: Column) -> Column:
    kind = lambda f: F.schema_of_variant(F.try_variant_get(variant, f"$.{f}", "variant"))
    text = lambda f: F.try_variant_get(variant, f"$.{f}", "string")
    number = lambda f: F.try_variant_get(variant, f"$.{f}", "double")
    is_int = lambda f: kind(f).rlike("^(BIGINT|DECIMAL|DOUBLE)") & (number(f) == F.floor(number(f)))
    is_text = lambda f: F.coalesce(kind(f) == "STRING", F.lit(False))
    has = lambda f: F.array_contains(keys, f)
    null = lambda f: F.coalesce(kind(f) == "VOID", F.lit(True))
    v1 = F.coalesce(is_int("event_version") & (number("event_version") == 1), F.lit(False))
    missing = F.coalesce(*(F.when(~has(f) & (~v1 if f == "facet" else F.lit(True)), F.lit(f"missing_{f}")) for f in REQUIRED))
    unknown = F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) > 0
    no = lambda c: ~F.coalesce(c, F.lit(False))
    checks = [
        (keys.isNull(), "not_an_object"),
        (unknown, "unknown_field"),
        (missing.isNotNull(), missing),
        (no(is_int("event_version") & number("event_version").isin(1, 2)), "bad_event_version"),
        (no(is_text("domain_hash")), "domain_hash_not_string"),
        (no(F.length(text("domain_hash")) == 16), "domain_hash_length"),
        (no(text("domain_hash").rlike(r"^[0-9a-f]{16}\z")), "domain_hash_not_hex"),
        (F.when(null("facet"), ~v1).otherwise(no(is_int("facet") & number("facet").between(1, 6))), "bad_facet"),
        (no(is_text("category") & text("category").isin(*rules.WIRE_CATEGORIES)), "bad_category"),
        (no(is_text("severity") & text("severity").isin(*rules.SEVERITIES)), "bad_severity"),
        (no(is_text("user_action") & text("user_action").isin(*rules.ACTIONS)), "bad_user_action"),
        (no(is_int("timestamp")), "timestamp_not_integer"),
        (no(F.abs(number("timestamp") - now) <= DAY), "timestamp_out_of_range"),
        (no(is_text("model_version") & (text("model_version") != "")), "bad_model_version"),
        (no(is_text("app_version") & (text("app_version") != "")), "bad_app_version"),
        (no(kind("confidence").rlike("^(BIGINT|DECIMAL|DOUBLE)") & number("confidence").between(0, 1)), "bad_confidence"),
        (has("id") & no(is_text("id") & (text("id") != "")), "bad_id"),
        (has("fp_reason") & no(is_text("fp_reason")), "fp_reason_not_string"),
        (has("fp_reason") & (F.length(text("fp_reason")) > 200), "fp_reason_too_long"),
        (has("fp_reason") & text("fp_reason").rlike(r"https?://|//[A-Za-z0-9]"), "fp_reason_has_url"),
        (has("match_count") & no(is_int("match_count") & (number("match_count") >= 1)), "bad_match_count"),
    ]
    reason = F.when(F.lit(False), F.lit(""))
    for failed, code in checks:
        reason = reason.when(F.coalesce(failed, F.lit(False)), code)
    return reason


def parse_valid(valid: DataFrame, json_col: str = "json") -> DataFrame:
    """The fields of valid events; a missing facet follows from the category."""
    parsed = valid.filter("reason is null").select(F.from_json(json_col, ", ".join(f"{f} {t}" for f, t in TYPES.items())).alias("e")).select("e.*")
    return parsed.withColumn("facet", F.coalesce("facet", facet(F.col("category"))))


def accept(raw: DataFrame, now: Column, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """(the valid events, parsed, with their facet; the rows that are not, with their reason)."""
    checked = validate(raw, now, json_col)
    return parse_valid(checked, json_col), checked.filter("reason is not null")


def audit(events: DataFrame) -> DataFrame:
    return events.select("timestamp", "domain_hash", "category", "severity", "user_action")


def opted_in(events: DataFrame, consent: DataFrame, key: str) -> DataFrame:
    """Events whose consent holds: the first version's flag or either tier; no consent row, no event."""
    agreed = consent.filter(F.coalesce("enabled", F.lit(False)) | F.coalesce("tier1_enabled", F.lit(False)) | F.coalesce("tier2_enabled", F.lit(False)))
    return events.join(agreed.select(key), key, "left_semi")


def consent_at(events: DataFrame, states: DataFrame, key: str, at: str = "timestamp", since: str = "last_changed_at") -> DataFrame:
    """Adds ``enabled`` as it stood at the event: one union and one window over (key, time), no range join."""
    both = events.select(key, F.col(at).alias("_t"), F.lit(1).alias("_is"), F.struct(*events.columns).alias("_e"), F.lit(None).cast("boolean").alias("_on"))
    both = both.unionByName(states.select(key, F.col(since).alias("_t"), F.lit(0).alias("_is"), F.lit(None).cast(both.schema["_e"].dataType).alias("_e"), F.col("enabled").alias("_on")))
    order = Window.partitionBy(key).orderBy("_t", "_is").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("enabled", F.last("_on", ignorenulls=True).over(order)).filter("_is = 1").select("_e.*", F.coalesce("enabled", F.lit(False)).alias("enabled"))


def newest(df: DataFrame, n: int, *order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` newest rows, of each key if there are keys; a global cap is a distributed top-n, not one sorted partition."""
    desc = [F.col(c).desc() for c in order]
    if not keys:
        return df.orderBy(*desc).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*desc))).filter(F.col("_n") <= n).drop("_n")


def dismissals(stored: DataFrame, fresh: DataFrame, now: Column, cap: int = DISMISSALS_CAP) -> DataFrame:
    """Upsert by key, drop the expired, keep the newest ``cap``; ``dismissed_at`` or else ``created_at`` is the age."""
    when = F.coalesce(F.nullif("dismissed_at", F.lit(0)), "created_at", F.lit(0))
    both = stored.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    latest = both.groupBy("key").agg(F.max_by(F.struct(*stored.columns), F.struct("_fresh", when)).alias("r")).select("r.*")
    return latest.filter(F.col("expires_at") > now).orderBy(when.desc(), F.col("key")).limit(cap)


def undismissed(findings: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Findings (domain_hash, category, match) without a live dismissal."""
    live = stored.filter(F.col("expires_at") > now).select(F.col("key").alias("_key"))
    return findings.withColumn("_key", dismiss_key(F.col("domain_hash"), F.col("category"), F.col("match"))).join(live, "_key", "left_anti").drop("_key")


def rate_limit(events: DataFrame, key: str, ts_ms: str, *, order: str | None = None, limit: int = LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """Adds ``accepted``: fewer than ``limit`` accepted events of the key in the ``window_ms`` before. Refused ones do not count.

    A fold in order of time: a key's rows pass one task, sorted by Spark (which spills), and the fold holds at most
    ``limit`` times. Every group is read as a stream, so a hot key needs no more memory than a cold one; but its events pass
    one task, as each verdict follows from those before.
    """
    columns = [*events.columns]
    at_key, at_ts = columns.index(key), columns.index(ts_ms)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = fold
        recent: deque = deque()
        for batch in batches:
            out = []
            for k, t in zip(batch.iloc[:, at_key], batch.iloc[:, at_ts], strict=True):
                if k != now:
                    now, recent = k, deque()
                while recent and recent[0] <= t - window_ms:
                    recent.popleft()
                out.append(len(recent) < limit)
                if out[-1]:
                    recent.append(t)
            yield batch.assign(accepted=out)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields), "accepted boolean"])
    return events.repartition(F.col(key)).sortWithinPartitions(key, ts_ms, *([order] if order else [])).mapInPandas(fold, schema)


def throttle(events: DataFrame, key: str, ts_ms: str, gap_ms: int = 300) -> DataFrame:
    """Events at least ``gap_ms`` after the last one that passed."""
    return rate_limit(events, key, ts_ms, limit=1, window_ms=gap_ms).filter("accepted").drop("accepted")


def retained(buffer: DataFrame, sent: DataFrame, key: str = "seq", cap: int = BUFFER_CAP) -> DataFrame:
    """What stays in the buffer after a flush: the rows that were not sent, whatever their place; at most the newest ``cap``."""
    return buffer.join(sent.select(key), key, "left_anti").orderBy(F.col(key).desc()).limit(cap)
