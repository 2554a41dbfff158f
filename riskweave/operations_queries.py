"""Queries of the operators on state, registries, reports and evaluation, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as S
from . import rules as R
from .catalog_queries import _EVENT_SQL, _SCORED_SQL, NOW, _t, raw_events, scored
from .operators import corpus, detect, evaluate, events, reports, state, windows
from .sources import corpora, registry

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _q(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def _seconds(col: str) -> Column:
    return F.unix_timestamp(F.col(col).cast("timestamp"))


# ---------------------------------------------------------------- state


@query("""with c as (select event_type || ':' || (user_id % 50)::varchar as key, case when event_id % 9 = 0 then null else event_id::varchar end as value, floor(epoch(ts))::bigint as changed_at, event_id % 3 = 0 as fresh from events),
r as (select *, row_number() over (partition by key order by changed_at desc, fresh desc, value is null desc, value desc) as n from c)
select key, value, changed_at from r where n = 1 and value is not null""")
def state_upsert(spark, sf):
    """Key-value state after changes, some of them removals."""
    e = _t(spark, sf, "events").select(F.concat("event_type", F.lit(":"), (F.col("user_id") % 50).cast("string")).alias("key"), F.when(F.col("event_id") % 9 != 0, F.col("event_id").cast("string")).alias("value"), _seconds("ts").alias("changed_at"), "event_id")
    return state.upsert(e.filter("event_id % 3 <> 0").drop("event_id"), e.filter("event_id % 3 = 0").drop("event_id"))


@query("""with c as (select (user_id % 50)::varchar as key, arg_max(event_type, ts) as value from events where user_id % 50 < 40 group by 1)
select e.event_id, coalesce(c.value, 'none') as setting from events e left join c on c.key = (e.user_id % 50)::varchar""")
def configured_events(spark, sf):
    """Events with the setting that the state has for their user's group."""
    e = _t(spark, sf, "events")
    known = e.filter("user_id % 50 < 40").groupBy((F.col("user_id") % 50).cast("string").alias("key")).agg(F.max_by("event_type", "ts").alias("value"))
    return state.configured(e, known, (F.col("user_id") % 50).cast("string"), "none").select("event_id", "setting")


@query("""with e as (select user_id, (epoch_ms(ts))::bigint as t from events), n as (select max(t) as now from e)
select user_id, count(*) filter (t > now - 86400000)::bigint as used, 100 as max, 86400 as window_seconds from e, n group by user_id""")
def limiter_state(spark, sf):
    e = _t(spark, sf, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    now = e.agg(F.max("t")).first()[0]
    return state.limiter_state(e, "user_id", "t", F.lit(now), window_ms=86_400_000)


_ACTION_SQL = "a as (select event_id, event_type, user_id, value, floor(epoch(ts))::bigint as timestamp, case when event_id % 4 = 0 then 'send_anyway' else 'edit' end as user_action, (select max(floor(epoch(ts))::bigint) from events) as now from events)"


def _actions(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    e = _t(spark, sf, "events").select("event_id", "event_type", "user_id", "value", _seconds("ts").alias("timestamp"), F.when(F.col("event_id") % 4 == 0, "send_anyway").otherwise("edit").alias("user_action"))
    return e, F.lit(e.agg(F.max("timestamp")).first()[0])


@query(f"with {_ACTION_SQL} select event_id from a where now - timestamp <= 10 * 86400 and not (user_action = 'send_anyway' and now - timestamp > 24 * 3600)")
def retained_events(spark, sf):
    e, now = _actions(spark, sf)
    return state.retained_events(e, now, days=10).select("event_id")


@query(f"with {_ACTION_SQL} select event_type as category, user_action as severity, count(*)::bigint as n_events, count(distinct user_id)::bigint as n_hosts, max(timestamp) as newest from a group by 1, 2")
def event_stats(spark, sf):
    e, _ = _actions(spark, sf)
    return state.stats(e.select(F.col("event_type").alias("category"), F.col("user_action").alias("severity"), F.col("user_id").cast("string").alias("domain_hash"), "timestamp"))


@query(f"with {_ACTION_SQL} select 'ok' as status, count(*)::bigint as n_events, max(timestamp) as newest from a")
def service_health(spark, sf):
    e, now = _actions(spark, sf)
    return state.health(e, now)


@query("select event_type, count(value)::bigint as n, round(avg(value), 6) as mean_ms, max(value) as max_ms from events group by event_type")
def latency_by_type(spark, sf):
    return state.latency(_t(spark, sf, "events"), "value", ("event_type",)).withColumn("mean_ms", F.round("mean_ms", 6))


@query("""with d as (select user_id, event_id::varchar as key, floor(epoch(ts))::bigint as t from events), n as (select max(t) - 20 * 86400 as now from d),
r as (select user_id, key, t, row_number() over (partition by user_id order by t desc, key) as k from d, n where t > now) select user_id, key, t as dismissed_at from r where k <= 3""")
def live_entries(spark, sf):
    """Dismissals held in a map: the expired go, the newest three stay."""
    e = _t(spark, sf, "events").select("user_id", F.col("event_id").cast("string").alias("key"), _seconds("ts").alias("t"))
    now = e.agg(F.max("t")).first()[0] - 20 * 86_400
    entry = F.struct("key", F.struct(F.col("t").alias("dismissed_at"), F.col("t").alias("created_at"), F.col("t").alias("expires_at")).alias("value"))
    held = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(entry)).alias("entries"))
    live = held.select("user_id", F.explode(state.live_entries(F.col("entries"), F.lit(now), 3)).alias("key", "v"))
    return live.select("user_id", "key", F.col("v.dismissed_at").alias("dismissed_at"))


# ---------------------------------------------------------------- events


@query(f"""with {_EVENT_SQL}, m as (select max(t) as now from e) select h as domain_hash, facet::int as facet, category, severity, t as timestamp, confidence::double as confidence, event_id
from e, m where length(h) = 16 and facet between 1 and 6 and category <> 'prompt' and severity <> 'no' and abs(t - now) <= 86400 and confidence <= 1""")
def accepted_events(spark, sf):
    """What a validating sink keeps, parsed."""
    raw = raw_events(spark, sf)
    now = raw.agg(F.max("t")).first()[0]
    good = events.validate(raw, F.lit(now)).filter("reason is null")
    parsed = good.select("event_id", F.from_json("json", ", ".join(f"{f} {t}" for f, t in events.TYPES.items())).alias("e")).select("event_id", "e.*")
    return parsed.select("domain_hash", "facet", "category", "severity", "timestamp", "confidence", "event_id")


def _event_json(**changes) -> str:
    import json

    event = {
        "event_version": 1, "domain_hash": "0123456789abcdef", "facet": 1, "category": "pii_email", "severity": "high", "user_action": "edit",
        "timestamp": NOW, "model_version": "m-1", "app_version": "1.0", "confidence": 0.5,
    }
    event |= changes
    return json.dumps({k: v for k, v in event.items() if v is not ...})


# (name, event, what validation says): one at least for each check, in the order of the checks.
EVENT_CASES = [
    ("valid", _event_json(), None), ("valid, version 2", _event_json(event_version=2), None), ("valid, version 1 without facet", _event_json(facet=...), None), ("valid, null facet", _event_json(facet=None), None),
    ("valid, optional fields", _event_json(id="x", fp_reason="no", match_count=2), None), ("valid, a day off", _event_json(timestamp=NOW - 86_400), None), ("valid, confidence 0", _event_json(confidence=0), None),
    ("null", "null", "not_an_object"), ("string", '"event"', "not_an_object"), ("number", "7", "not_an_object"), ("array", "[]", "not_an_object"), ("broken", '{"event_version": 1', "not_an_object"),
    ("a text", _event_json(prompt_text="x"), "unknown_field"), ("a url", _event_json(url="https://x"), "unknown_field"),
    *((f"no {f}", _event_json(**{f: ...}), f"missing_{f}") for f in events.REQUIRED if f != "facet"), ("version 2 without facet", _event_json(event_version=2, facet=...), "missing_facet"),
    ("version 0", _event_json(event_version=0), "bad_event_version"), ("version 3", _event_json(event_version=3), "bad_event_version"), ("version as text", _event_json(event_version="1"), "bad_event_version"),
    ("hash is a number", _event_json(domain_hash=1), "domain_hash_not_string"), ("hash too short", _event_json(domain_hash="0123"), "domain_hash_length"), ("hash in upper case", _event_json(domain_hash="0123456789ABCDEF"), "domain_hash_not_hex"),
    ("facet 0", _event_json(facet=0), "bad_facet"), ("facet 7", _event_json(facet=7), "bad_facet"), ("facet 1.5", _event_json(facet=1.5), "bad_facet"), ("version 2, null facet", _event_json(event_version=2, facet=None), "bad_facet"),
    ("category", _event_json(category="prompt"), "bad_category"), ("severity", _event_json(severity="urgent"), "bad_severity"), ("action", _event_json(user_action="detect"), "bad_user_action"),
    ("time is no integer", _event_json(timestamp=NOW + 0.5), "timestamp_not_integer"), ("too old", _event_json(timestamp=NOW - 86_401), "timestamp_out_of_range"), ("too new", _event_json(timestamp=NOW + 86_401), "timestamp_out_of_range"),
    ("model version", _event_json(model_version=""), "bad_model_version"), ("app version", _event_json(app_version=""), "bad_app_version"), ("confidence 1.5", _event_json(confidence=1.5), "bad_confidence"), ("confidence -0.1", _event_json(confidence=-0.1), "bad_confidence"),
    ("confidence as text", _event_json(confidence="1"), "bad_confidence"), ("id", _event_json(id=""), "bad_id"), ("reason is a number", _event_json(fp_reason=1), "fp_reason_not_string"), ("reason too long", _event_json(fp_reason="x" * 201), "fp_reason_too_long"),
    ("reason has a url", _event_json(fp_reason="see https://x.org"), "fp_reason_has_url"), ("count 0", _event_json(match_count=0), "bad_match_count"), ("count 1.5", _event_json(match_count=1.5), "bad_match_count"),
]


@query("select * from (values " + ", ".join(f"({_q(n)}, {_q(r)})" for n, _, r in EVENT_CASES) + ") as t(name, reason)")
def validation_codes(spark, sf):
    """Every code of validation, each on an event that fails that check first."""
    rows = spark.createDataFrame([(n, j) for n, j, _ in EVENT_CASES], "name string, json string")
    return events.validate(rows, F.lit(NOW)).select("name", "reason")


# ---------------------------------------------------------------- registries

_REGISTRY = [(4, "injection", 300), (5, "toxicity", 550), (6, "injection-ml", 147)]
_REGISTRY_SQL = "g(facet, bundle, size_bytes) as (values " + ", ".join(f"({f}, '{b}', {s}::bigint)" for f, b, s in _REGISTRY) + ")"


def _registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_REGISTRY, "facet int, bundle string, size_bytes long")


@query(f"with {_REGISTRY_SQL}, r as (select event_id, (1 + event_id % 6)::int as facet from events) select event_id, r.facet, bundle, size_bytes from r left join g using (facet)")
def facet_bundles(spark, sf):
    e = _t(spark, sf, "events").select("event_id", (1 + F.col("event_id") % 6).cast("int").alias("facet"))
    return registry.facet_bundles(e, _registry(spark))


@query(f"with {_REGISTRY_SQL} select sum(size_bytes)::bigint as total_bytes from g")
def bundle_size(spark, sf):
    return registry.total_size(_registry(spark))


@query("""with k as (select s_suppkey, sha256(s_name) as h from supplier) select s_suppkey, case when s_suppkey % 5 = 4 then null when s_suppkey % 7 < 3 then 'key-' || (s_suppkey)::varchar end as key_id from k""")
def signing_keys(spark, sf):
    """Bundles whose public key is in the ring, given in hex (either case), in base64, or badly."""
    k = _t(spark, sf, "supplier").select("s_suppkey", F.sha2("s_name", 256).alias("h"))
    m = F.col("s_suppkey") % 5
    b64 = F.base64(F.unhex("h"))
    headers = k.select("s_suppkey", F.when(m == 0, F.col("h")).when(m == 1, F.upper("h")).when(m == 4, F.substring("h", 1, 63)).alias("signing_public_key"), F.when(m.isin(2, 3), b64).when(m == 4, F.lit("%%")).alias("signing_pub_key_b64"))
    ring = k.filter("s_suppkey % 7 < 3").select(F.concat(F.lit("key-"), F.col("s_suppkey").cast("string")).alias("key_id"), b64.alias("b64"))
    return registry.signing_keys(headers, ring).select("s_suppkey", "key_id")


_MODELS = [("b1", "lr", "lr", 0), ("b1", "mlp_a", "mlp", 2), ("b2", "lr", "lr", 0), ("b3", "odd", "tree", 0)]
_FILES = [("b1", f) for f in ("lr_config.json", "lr_vocabulary.json", "lr_idf.json", "lr_coefficients.json", "mlp_a_config.json", "mlp_a_vocabulary.json", "mlp_a_idf.json", "mlp_a_weights_0.json", "mlp_a_weights_1.json", "mlp_a_biases_0.json")] + [("b2", "lr_config.json"), ("b3", "odd_config.json"), ("b3", "odd_vocabulary.json"), ("b3", "odd_idf.json")]


@query("select * from (values ('b1', 'lr', true, ''), ('b1', 'mlp_a', false, 'mlp_a_biases_1.json'), ('b2', 'lr', false, 'lr_coefficients.json,lr_idf.json,lr_vocabulary.json'), ('b3', 'odd', false, '')) as t(bundle, model, complete, missing)")
def model_files(spark, sf):
    """Which models have all their files; one of an unknown type has not."""
    needed = registry.model_files(spark.createDataFrame(_MODELS, "bundle string, model string, type string, n_layers int"), spark.createDataFrame(_FILES, "bundle string, name string"))
    return registry.complete_models(needed).withColumn("missing", F.array_join("missing", ","))


@query("""with i as (select distinct substr(sha256('u' || user_id::varchar), 1, 16) as h, user_id % 4 as n from events where user_id % 2 = 0)
select e.event_id, coalesce(i.n, 0)::bigint as ioc_count, coalesce(i.n, 0) > 0 as has_iocs, case when i.n > 0 then 'type' || i.n::varchar else '' end as top from events e left join i on i.h = substr(sha256('u' || e.user_id::varchar), 1, 16)""")
def threat_intel(spark, sf):
    h = F.substring(F.sha2(F.concat(F.lit("u"), F.col("user_id").cast("string")), 256), 1, 16)
    e = _t(spark, sf, "events").select("event_id", "user_id", h.alias("domain_hash"))
    n = F.col("user_id") % 4
    intel = e.filter("user_id % 2 = 0").select("domain_hash", n.alias("ioc_count"), F.when(n > 0, F.array(F.concat(F.lit("type"), n.cast("string")))).otherwise(F.array().cast("array<string>")).alias("top_categories")).distinct()
    return corpora.threat_intel(e, intel).select("event_id", "ioc_count", "has_iocs", F.array_join("top_categories", ",").alias("top"))


# ---------------------------------------------------------------- scalars


@query("select c_custkey, 'https://t.example/check?domain=' || url_encode(c_name || ' é&' || c_mktsegment) as url, length(c_name)::int as n, from_base64(to_base64(c_name::blob))::varchar as back from customer")
def encoded_urls(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", S.check_url("https://t.example/", F.concat("c_name", F.lit(" é&"), "c_mktsegment")).alias("url"), F.length("c_name").alias("n"), S.base64_bytes(F.base64(F.col("c_name").cast("binary"))).cast("string").alias("back"))


_LICENSES = ("Apache-2.0", " MIT ", "GPL-3.0", "proprietary", "", "cc0-1.0", "SSPL", None)
_VERDICTS = ("allowed", "allowed", "rejected", "unknown", "missing", "allowed", "rejected", "missing")


@query("select p_partkey, ([" + ", ".join(map(_q, _VERDICTS)) + "])[1 + p_partkey % 8] as verdict, ([true, false, false, false, false, false, false, true])[1 + p_partkey % 8] as bundle_ok from part")
def license_verdicts(spark, sf):
    x = F.get(F.array(*map(F.lit, _LICENSES)), (F.col("p_partkey") % 8).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", S.license_verdict(x).alias("verdict"), S.bundle_license_ok(x).alias("bundle_ok"))


_URLS = ("https://a.example/x", "http://a.example", "http://localhost:8080/", "http://127.0.0.1", "http://[::1]/x", "ftp://a.example", "a.example", "HTTPS://A.EXAMPLE", "http://localhost.example", "https://")


@query("select p_partkey, ([true, false, true, true, true, false, false, true, false, false])[1 + p_partkey % 10] as allowed from part")
def allowed_urls(spark, sf):
    x = F.get(F.array(*map(F.lit, _URLS)), (F.col("p_partkey") % 10).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", S.url_allowed(x).alias("allowed"))


def _label(category: str) -> str:
    return S.LABELS.get(category) or next((b + category[len(a) :] for a, b in S.LABEL_PREFIXES if category.startswith(a)), category)


@query("select * from (values " + ", ".join(f"({r.ord}, {_q(_label(r.category))}, {_q(S.SHORT_LABELS.get(r.category, r.category))})" for r in R.catalog()) + ") as t(ord, label, short)")
def category_labels(spark, sf):
    rows = spark.createDataFrame([(r.ord, r.category) for r in R.catalog()], "ord int, category string")
    return rows.select("ord", S.label(F.col("category")).alias("label"), S.short_label(F.col("category")).alias("short"))


@query("""select event_id, round(exp(b) / (exp(a) + exp(b)), 9) as attack, round(1 / (1 + exp(-a)), 9) as p from (select event_id, (event_id % 17 - 8) / 3.0 as a, (event_id % 11 - 5) / 2.0 as b from events)""")
def probabilities(spark, sf):
    e = _t(spark, sf, "events").select("event_id", ((F.col("event_id") % 17 - 8) / 3.0).alias("a"), ((F.col("event_id") % 11 - 5) / 2.0).alias("b"))
    return e.select("event_id", F.round(S.softmax2(F.array("a", "b")), 9).alias("attack"), F.round(S.sigmoid(F.col("a")), 9).alias("p"))


# ---------------------------------------------------------------- windows and models


@query("""with d as (select doc_id, coalesce(length(text), 0) as n from documents), w as (select doc_id, n, least(4, ceil((n - 2048) / 1024.0)::int + 1) as c from d),
x as (select doc_id, n, case when n <= 2048 then 0 else least(k * 1024, n - 2048) end as s, case when n <= 2048 then n else 2048 end as len from w, range(0, 4) as r(k) where k < case when n <= 2048 then 1 else c end)
select doc_id, s::int as start, case when n > 0 then (s + 1) % 1000 + 3 end::int as first_id, case when n > 0 then (s + len) % 1000 + 3 end::int as last_id, len::int as width, len::int as n_mask from x""")
def benchmark_windows(spark, sf):
    """Windows of the benchmark, by their first and last id; a text's ids are its characters' places."""
    return _windows(windows.benchmark_windows(_ids(spark, sf)), lambda k, w: F.when(F.col("n") <= windows.LENGTH, F.lit(0)).otherwise(F.least(k * windows.STRIDE, F.col("n") - windows.LENGTH)), 0)


@query("""with d as (select doc_id, coalesce(length(text), 0) as n from documents),
x as (select doc_id, n, case when n <= 2048 then 0 else k * 1024 end as s, k from d, range(0, 4) as r(k) where k = 0 or (n > 2048 and k * 1024 < n))
select doc_id, s::int as start, case when n > 0 then (s + 1) % 1000 + 3 end::int as first_id, case when n > 0 then (s + least(2048, n - s)) % 1000 + 3 end::int as last_id, (least(n, 2048) + 2)::int as width, (least(2048, n - s) + 2)::int as n_mask from x""")
def sizing_windows(spark, sf):
    """Windows of the sizing experiment, likewise; special ids stand at both ends, zeros behind them."""
    return _windows(windows.sizing_windows(_ids(spark, sf)), lambda k, w: F.when(F.col("n") <= windows.LENGTH, F.lit(0)).otherwise(k * windows.STRIDE), 1)


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    n = F.coalesce(F.length("text"), F.lit(0))
    return _t(spark, sf, "documents").select("doc_id", n.alias("n"), F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: (k % 1000 + 3).cast("int"))).otherwise(F.array().cast("array<int>")).alias("ids"))


def _windows(df: DataFrame, start, specials: int) -> DataFrame:
    w = df.select("doc_id", "n", F.posexplode("windows").alias("k", "w"))
    ids, mask = F.col("w.input_ids"), F.aggregate("w.attention_mask", F.lit(0), lambda a, x: a + x)
    some = F.col("n") > 0
    return w.select("doc_id", start(F.col("k"), None).cast("int").alias("start"), F.when(some, F.get(ids, F.lit(specials))).alias("first_id"), F.when(some, F.get(ids, mask - specials - 1)).alias("last_id"), F.size(ids).alias("width"), mask.alias("n_mask"))


@query("""with d as (select doc_id, coalesce(length(text), 0) as n from documents)
select doc_id, 512 as width, (case when n = 0 then 0 else least(n, 510) + 2 end)::int as n_mask, (case when n = 0 then 0 else 101 end)::int as first_id, (case when n = 0 then 0 else 102 end)::int as last_id from d""")
def toxicity_inputs(spark, sf):
    w = windows.toxicity_input(_ids(spark, sf))
    mask = F.aggregate("window.attention_mask", F.lit(0), lambda a, x: a + x)
    return w.select("doc_id", F.size("window.input_ids").alias("width"), mask.alias("n_mask"), F.get("window.input_ids", F.lit(0)).alias("first_id"), F.get("window.input_ids", F.greatest(mask - 1, F.lit(0))).alias("last_id"))


def _logits(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    return e.select("event_id", F.array(*(((F.col("event_id") * (k + 3)) % 13 - 6).cast("double") / 2 for k in range(6))).alias("logits"))


@query("""with l as (select event_id, k, ((event_id * (k + 3)) % 13 - 6) / 2.0 as x from events, range(0, 6) as r(k))
select (['toxic', 'severe_toxic', 'obscene', 'threat', 'insult', 'identity_hate'])[k + 1] as label, (count(*) filter (1 / (1 + exp(-x)) >= 0.5))::bigint as flagged, count(*)::bigint as n from l group by k""")
def toxicity_flags(spark, sf):
    scored_ = _logits(spark, sf).withColumn("toxicity", windows.toxicity(F.col("logits")))
    return windows.flag_counts(scored_)


@query("""with w as (select doc_id, list_filter(string_split(lower(coalesce(text, '')), ' '), lambda x: x <> '') as ws from documents), s as (select doc_id, len(ws) as n, list_sum([0.0] || list_transform(ws, lambda w: case w when 'the' then 0.5 when 'and' then -0.25 when 'of' then 1.5 else 0 end))::double as t from w),
p as (select doc_id, 1 / (1 + exp(-(0.1 + t / greatest(n, 1)))) as a, 1 / (1 + exp(-(0.6 + t / greatest(n, 1)))) as b from s)
select doc_id, round((a + b) / 2, 9) as score, (a + b) / 2 >= 0.6 as attack from p""")
def ensemble_scores(spark, sf):
    """The mean of two linear models over the words of a text."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda w: w != "")
    weights = F.create_map(*(F.lit(x) for kv in {"the": 0.5, "and": -0.25, "of": 1.5}.items() for x in kv))
    s = _t(spark, sf, "documents").select("doc_id", words.alias("w")).select("doc_id", registry.ensemble(F.array(registry.tfidf_score(F.col("w"), weights, F.lit(0.1)), registry.tfidf_score(F.col("w"), weights, F.lit(0.6))), 0.6).alias("e"))
    return s.select("doc_id", F.round("e.score", 9).alias("score"), "e.attack")


# ---------------------------------------------------------------- evaluation


def _sweep_sql(name: str, where: str) -> str:
    return f"""{name}_t as (select unnest([{', '.join(map(str, evaluate.THRESHOLDS))}]::double[]) as threshold), {name}_c as (select threshold, count(*) filter (score >= threshold and label = 1) as tp, count(*) filter (score >= threshold and label <> 1) as fp, count(*) filter (score < threshold and label = 1) as fn, count(*) filter (score < threshold and label <> 1) as tn from scored, {name}_t where {where} group by threshold),
{name} as (select threshold, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end as f1, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall, case when fp + tn > 0 then fp / (fp + tn)::double else 0 end as fpr from {name}_c)"""


@query(f"""with {_SCORED_SQL}, {_sweep_sql('a', 'true')}, {_sweep_sql('s', 'length(text) < 2000')}, {_sweep_sql('l', 'length(text) >= 2000')}
select threshold, round(f1, 6) as f1 from (select a.threshold, a.f1, row_number() over (order by a.f1 desc, a.threshold) as n from a join s using (threshold) join l using (threshold) where s.recall >= 0.95 and l.fpr <= 0.5) where n = 1""")
def hard_threshold(spark, sf):
    rows = scored(spark, sf)
    swept, short, long_ = (evaluate.sweep(x) for x in (rows, rows.filter(F.length("text") < 2000), rows.filter(F.length("text") >= 2000)))
    return evaluate.hard_threshold(swept, short, long_, most_fpr=0.5).select("threshold", F.round("f1", 6).alias("f1"))


@query(f"with {_SCORED_SQL}, f as (select *, doc_id % 7 = 0 and label = 1 as fix from scored) select count(*) filter (fix)::bigint as n, (count(*) filter (fix and score >= 0.5))::bigint as found, round((count(*) filter (fix and score >= 0.5)) / (count(*) filter (fix))::double, 9) as recall from f")
def relabelled_recall(spark, sf):
    rows = scored(spark, sf).withColumn("fix_applied", (F.col("doc_id") % 7 == 0) & (F.col("label") == 1))
    return evaluate.relabelled_recall(rows, 0.5).withColumn("recall", F.round("recall", 9))


@query("select n_name as corpus from nation where n_regionkey = 2 and n_nationkey % 2 = 0")
def corpora_again(spark, sf):
    n = _t(spark, sf, "nation")
    results = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("corpus"), F.when(F.col("n_regionkey") == 2, "timeout").when(F.col("n_regionkey") == 3, "killed").alias("error"))
    return evaluate.to_evaluate_again(results, n.select(F.col("n_name").alias("corpus")))


@query(f"with {_SCORED_SQL} select source, round(n / 7.3, 2) as per_second from (select source, count(*) as n from scored group by source)")
def throughput_by_source(spark, sf):
    return evaluate.confusion(scored(spark, sf), 0.5, ("source",)).select("source", evaluate.throughput(F.col("n"), F.lit(7.3)).alias("per_second"))


@query(f"""with {_SCORED_SQL} select source, count(*)::bigint as n, round(coalesce((count(*) filter (label = 1 and score >= 0.5)) / nullif(count(*) filter (label = 1), 0)::double, 0), 9) as recall, round(coalesce((count(*) filter (label <> 1 and score >= 0.5)) / nullif(count(*) filter (label <> 1), 0)::double, 0), 9) as fpr,
round(avg(score), 9) as mean_score, min(score) as min_score, max(score) as max_score from scored group by source""")
def metrics_by_source(spark, sf):
    return evaluate.by_source(scored(spark, sf), 0.5).withColumns({c: F.round(c, 9) for c in ("recall", "fpr", "mean_score")})


@query(f"""with {_SCORED_SQL} select lang as corpus, label, count(*)::bigint as size, count(*) filter (score >= 0.5)::bigint as flagged, case when label = 1 then 'recall' else 'fpr' end as rate_of, round(count(*) filter (score >= 0.5) / count(*)::double, 9) as rate,
round(avg(score), 9) as mean_score, min(score) as min_score, max(score) as max_score from scored group by lang, label""")
def single_class_metrics(spark, sf):
    found = evaluate.single_class(scored(spark, sf).withColumnRenamed("lang", "corpus"), 0.5)
    return found.withColumns({c: F.round(c, 9) for c in ("rate", "mean_score")})


@query(f"""with {_SCORED_SQL} select lang, (count(*) filter (score >= 0.5 and label = 1))::bigint as tp, (count(*) filter (score >= 0.5 and label <> 1))::bigint as fp, (count(*) filter (score < 0.5 and label = 1))::bigint as fn, (count(*) filter (score < 0.5 and label <> 1))::bigint as tn from scored group by rollup (lang)""")
def totals_by_language(spark, sf):
    return evaluate.totals(scored(spark, sf), 0.5, "lang")


@query("""with r as (select event_id % 40 as item, value / 1000 as score from events), g as (select item, max(score) - min(score) as range, avg(score) as mean from r group by item) select item, round(range, 9) as range, range < 0.000001 as stable, (mean >= 0.5)::int as predicted from g""")
def determinism(spark, sf):
    runs = _t(spark, sf, "events").select((F.col("event_id") % 40).alias("item"), (F.col("value") / 1000).alias("score"))
    return evaluate.determinism(runs, "item").select("item", F.round("range", 9).alias("range"), "stable", "predicted")


# ---------------------------------------------------------------- corpora and reports


@query("""with d as (select doc_id, source, quality as label, regexp_matches(lower(text), 'the|act as') as hit from documents join labels using (doc_id)) select source, count(*)::bigint as n, count(*) filter (source = 'src0' and hit and label <> 1)::bigint as fixed, count(*) filter (label = 1 or (source = 'src0' and hit and label <> 1))::bigint as attacks from d group by source""".replace("'the|act as'", _q("|".join(corpus.ATTACK_PHRASES))))
def relabelled(spark, sf):
    """Rows of one source that hold any of the attack phrases are relabelled."""
    rows = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id").select("source", F.col("quality").alias("label"), "text")
    return corpus.relabel_summary(corpus.relabel(rows, "src0"))


@query("select " + " + ".join(f"sum((contains(lower(text), {_q(p)}))::int * {k + 1})" for k, p in enumerate(corpus.ATTACK_PHRASES)) + "::bigint as weighted, count(*) filter (regexp_matches(lower(text), " + _q("|".join(corpus.ATTACK_PHRASES)) + "))::bigint as attacks from documents")
def all_attack_phrases(spark, sf):
    """All phrases: which of them stand in how many texts (weighted by their place in the list), and texts with any."""
    low = F.lower("text")
    weighted = sum((F.sum(low.contains(p).cast("int") * (k + 1)) for k, p in enumerate(corpus.ATTACK_PHRASES)), F.lit(0))
    return _t(spark, sf, "documents").agg(weighted.cast("long").alias("weighted"), F.count_if(corpus.has_attack(F.col("text"))).alias("attacks"))


@query("select (count(*) * 0.05)::int::bigint - 0 as n_val, count(*)::bigint as n from labels".replace("(count(*) * 0.05)::int::bigint - 0", "floor(count(*) * 0.05)::bigint"))
def held_out_sizes(spark, sf):
    split = corpus.hold_out(_t(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"))
    return split.agg(F.count_if(F.col("split") == "val").alias("n_val"), F.count("*").alias("n"))


@query("select s_suppkey, case when mb > 30 then 21600 when mb > 10 then 7200 when mb > 1 then 1800 else 600 end as timeout_s, case when mb > 30 then 4 when mb > 10 then 8 when mb > 1 then 16 else 32 end as batch from (select s_suppkey, s_acctbal / 200 as mb from supplier)")
def run_configs(spark, sf):
    return _t(spark, sf, "supplier").select("s_suppkey", corpus.run_config(F.col("s_acctbal") / 200).alias("c")).select("s_suppkey", "c.timeout_s", "c.batch")


@query("""with f as (select n_name as name, sha256(n_name) as s, n_nationkey as k from nation) select name, case when k % 5 = 0 then 'missing' when k % 5 = 1 then 'new' when k % 5 = 2 then 'changed' else 'same' end as state from f""")
def file_drift(spark, sf):
    f = _t(spark, sf, "nation").select(F.col("n_name").alias("name"), F.sha2("n_name", 256).alias("sha256"), F.col("n_nationkey").alias("k"))
    files = f.filter("k % 5 <> 0").withColumn("sha256", F.when(F.col("k") % 5 == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return corpus.drift(files.drop("k"), f.filter("k % 5 <> 1").drop("k"))


@query("""select name, sha256 from (select n_name as name, sha256(n_name || case when n_nationkey % 2 = 0 then '!' else '' end) as sha256 from nation)""")
def locked_files(spark, sf):
    """A lockfile after some of its lines were replaced."""
    n = _t(spark, sf, "nation")
    old = n.select(F.col("n_name").alias("name"), F.sha2("n_name", 256).alias("sha256"))
    new = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.sha2(F.concat("n_name", F.lit("!")), 256).alias("sha256"))
    return corpora.lockfile(old.unionByName(old), new)


@query("""with r as (select r_regionkey, r_name, count(*) as n from region join nation on n_regionkey = r_regionkey group by all), l as (select 2 + row_number() over (order by r_regionkey) - 1 as place, '| ' || r_regionkey || ' | ' || r_name || ' | ' || n || ' |' as line from r)
select place::bigint as place, line from l union all values (0, '| r_regionkey | r_name | n |'), (1, '|-|-|-|')""")
def markdown_report(spark, sf):
    r, n = _t(spark, sf, "region"), _t(spark, sf, "nation")
    counted = r.join(n, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_regionkey", "r_name").agg(F.count("*").alias("n"))
    return reports.markdown(counted, "r_regionkey")


@query("select label, count(*)::bigint as n from (select quality as label from labels) group by label")
def class_balance(spark, sf):
    return corpus.balance(_t(spark, sf, "labels").select(F.col("quality").alias("label")))


@query("""select event_id, regexp_matches(t, '(?m)^From: |^Subject: |^> |^---[ ]*Original Message') or contains(t, ' wrote:') as mail from (select event_id, case event_id % 6 when 0 then 'a' || chr(10) || 'From: b' when 1 then 'say From: b' when 2 then 'On Monday a@b.c wrote:' when 3 then 'x' || chr(10) || '> y' when 4 then '---Original Message' else 'plain' end as t from events)""")
def email_like(spark, sf):
    k = F.col("event_id") % 6
    t = F.when(k == 0, "a\nFrom: b").when(k == 1, "say From: b").when(k == 2, "On Monday a@b.c wrote:").when(k == 3, "x\n> y").when(k == 4, "---Original Message").otherwise("plain")
    return _t(spark, sf, "events").select("event_id", S.email_like(t).alias("mail"))
