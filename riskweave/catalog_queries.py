"""Queries over the supplied tables, for each operator group, and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as S
from . import rules as R
from .operators import corpus, detect, evaluate, events, reports, windows
from .plans import findings_to_events
from .rules.samples import sample

NOW = 1_719_000_000
#: Rules whose finds the SQL oracle can follow: no lookaround, and no checksum.
PLAIN = tuple(r for r in R.catalog() if r.re2 is not None and r.category != detect.CARD)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _hex(width: int, *cols: str) -> Column:
    """A number in [0, 1) from an MD5, the same in Spark and DuckDB."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, width), 16, 10).cast("double") / float(16**width)


_SCORED_SQL = """scored as (select d.doc_id, d.source, d.lang, l.quality as label, d.text, ('0x' || substr(md5(d.doc_id::varchar || ':' || d.source), 1, 6))::bigint::double / 16777216.0 * 0.6 + 0.4 * l.quality as score
from documents d join labels l using (doc_id))"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a synthetic score that leans to the label; the model's weights are not public."""
    d, l = _t(spark, sf, "documents"), _t(spark, sf, "labels")
    return d.join(l, "doc_id").select("doc_id", "source", "lang", F.col("quality").alias("label"), "text", (_hex(6, "doc_id", "source") * 0.6 + F.lit(0.4) * F.col("quality")).alias("score"))


def _metrics_sql(by: str) -> str:
    return f"""select {by}, tp, fp, fn, tn, tp + fp + fn + tn as n, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall, case when fp + tn > 0 then fp / (fp + tn) else 0.0 end as fpr,
case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end as f1"""


QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Rules that look around, which RE2 cannot: (what stands before a match, the pattern up to where it looks ahead, what
#: follows it, a further condition on the match m). A match is tried at each place of a text.
_AROUND = {
    "phone_na_v1": (r"[0-9A-Za-z_]", r"\+?1?[-.\s]?\(?[2-9][0-9]{2}\)?[-.\s]?[2-9][0-9]{2}[-.\s]?[0-9]{4}", r"(?:[^0-9]|\z)", None),
    "ssn_v1": (None, r"\d{3}[-\s]\d{2}[-\s]\d{4}", "", "m[1:1] <> '9' and m[1:3] not in ('000', '666') and m[5:6] <> '00' and m[8:11] <> '0000'"),
    "pii_scanner_pii_phone_v1": (r"[0-9A-Za-z_]", r"\+?1?[-.\s]?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}", r"(?:[^0-9]|\z)", None),
    "pii_health_v3": (r"[0-9A-Za-z_]", r"(?:diagnosis|dx|condition|hx|history|medical\s*history|health\s*record)\s*[:\-]?\s*", "[A-Za-z]", None),
    "xss_script_v2": (None, r"<\s*script[^>]*>(?:[\x00-\x{10FFFF}])*?(?:alert|eval|prompt|confirm|document\.write|window\.location|fetch\s*\(|new\s+Function|atob\s*\()", "", r"not regexp_matches(m, '(?i)^<\s*script[^>]*>(?s:.*)</\s*script\s*>')"),
    "jwt_none_empty_signature_v1": (None, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"(?:[^A-Za-z0-9_-]|\z)", None),
}


def _around_sql(rules, table: str, key: str, text: str) -> str:
    """CTEs that end in ``around`` (k, ord, neg, i, s, match): the matches of the rules that look around."""
    parts = []
    for r in rules:
        before, core, after, further = _AROUND[r.name]
        core = R._rewritten(core, "", False)
        fold = "(?i)" if "i" in r.flags else ""
        alone = f"regexp_extract(substr({text}, p::bigint), {_q(f'{fold}^({core}){after}')}, 1)"
        where = [f"not regexp_matches(substr({text}, p::bigint - 1, 1), {_q(f'^{before}$')})" if before else "true", further or "true"]
        tried = f"select {key} as k, {text}, unnest(range(1, length({text}) + 1)) as p from {table} where regexp_matches({text}, {_q(fold + core)})"
        parts.append(f"select k, {r.ord} as ord, {-r.rank} as neg, p, m from (select k, {text}, p, {alone} as m from ({tried}) where p = 1 or {where[0]}) where m <> '' and {where[1]}")
    return f"""place as ({' union all '.join(parts)}),
step as (select k, ord, neg, min(p) as p, 1::bigint as i from place group by k, ord, neg union all
  select x.k, x.ord, x.neg, (select min(q.p) from place q where q.k = x.k and q.ord = x.ord and q.p >= x.p + length((select m from place w where w.k = x.k and w.ord = x.ord and w.p = x.p))), x.i + 1 from step x where x.p is not null),
around as (select step.k, step.ord, step.neg, step.i, step.p - 1 as s, place.m as match from step join place on place.k = step.k and place.ord = step.ord and place.p = step.p)"""


_DIGITS_SQL = "list_reverse(list_transform(regexp_extract_all(match, '[0-9]'), lambda c: c::int))"
_LUHN_SQL = f"(len({_DIGITS_SQL}) >= 2 and list_sum(list_transform({_DIGITS_SQL}, lambda d, j: case when j % 2 = 1 then d when d > 4 then 2 * d - 9 else 2 * d end)) % 10 = 0)"
_INFO_SQL = "info(ord, category, severity, rank, facet, name) as (values " + ", ".join(f"({r.ord}, {_q(r.category)}, {_q(r.severity)}, {r.rank}, {r.facet}, {_q(r.name)})" for r in R.catalog()) + ")"


def _findings_sql(table: str, key: str, text: str, policy: str = "earliest", rules=R.catalog()) -> str:
    """CTEs that end in ``finding`` (k, ord, category, severity, rank, facet, name, start, end, match): the whole catalog."""
    cards = ", ".join(str(r.ord) for r in rules if r.category == detect.CARD)
    rows = " union all ".join(
        f"select {key} as k, {r.ord} as ord, {-r.rank} as neg, regexp_extract_all({text}, {_q(r.re2)}) as m, regexp_split_to_array({text}, {_q(r.re2)}) as p from {table} where regexp_matches({text}, {_q(r.re2)})" for r in rules if r.re2 is not None
    )
    clash = "len(list_filter(w.kept, lambda o: o.s < x.e and x.s < o.e)) = 0"
    walks = {
        "earliest": """walk(k, n, last, kept, taken) as (select k, 0::bigint, 0::bigint, false, 0 from (select distinct k from sorted)
  union all select w.k, w.n + 1, case when x.s >= w.last and w.taken < 50 then x.e else w.last end, x.s >= w.last and w.taken < 50, w.taken + case when x.s >= w.last and w.taken < 50 then 1 else 0 end from walk w join sorted x on x.k = w.k and x.n = w.n + 1),
chosen as (select x.* from sorted x join walk w on w.k = x.k and w.n = x.n where w.kept)""",
        "severity": f"""walk(k, n, kept, took) as (select k, 0::bigint, []::struct(s bigint, e bigint)[], false from (select distinct k from sorted)
  union all select w.k, w.n + 1, case when {clash} then list_append(w.kept, {{'s': x.s, 'e': x.e}}) else w.kept end, {clash} from walk w join sorted x on x.k = w.k and x.n = w.n + 1),
chosen as (select * from (select x.*, row_number() over (partition by x.k order by x.s, x.neg, x.ord, x.i) as place from sorted x join walk w on w.k = x.k and w.n = x.n where w.took) where place <= 50)""",
    }
    order = "s, neg, ord, i" if policy == "earliest" else "neg, s, s - e, ord, i"
    return f"""{_INFO_SQL}, {_around_sql([r for r in rules if r.re2 is None], table, key, text)}, found as ({rows}),
spans as (select k, ord, neg, i, length(array_to_string(p[1:i], '')) + coalesce(length(array_to_string(m[1:i - 1], '')), 0) as s, m[i] as match from (select *, unnest(generate_series(1, len(m))) as i from found) union all select k, ord, neg, i, s, match from around),
counted as (select * from spans where ord not in ({cards}) or {_LUHN_SQL}),
capped as (select *, s + length(match) as e from (select *, row_number() over (partition by k order by ord, i) as c from counted) where c <= 200),
sorted as (select *, row_number() over (partition by k order by {order}) as n from capped), {walks[policy]},
finding as (select k, ord, category, severity, rank, facet, name, s::int as start, e::int as "end", match from chosen join info using (ord))"""


_FOUND_SQL = f"with recursive {_findings_sql('documents', 'doc_id', 'text')}"
_COLUMNS = 'ord, category, severity, rank, facet, name, start, "end", match'


@query(f"{_FOUND_SQL} select k as doc_id, {_COLUMNS} from finding")
def detect_all(spark, sf):
    """Every finding of every document: the full catalog, checksums, overlaps and caps."""
    return reports.scan_table(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query(f"{_FOUND_SQL} select category, severity, count(*)::bigint as n_findings, max(rank) as worst_rank from finding group by category, severity")
def detect_summary(spark, sf):
    return reports.summary(detect_all(spark, sf), "category", "severity")


@query(f"""{_FOUND_SQL}, o as (select k, count(*)::bigint as n from finding group by k) select k as doc_id, n as n_findings, false as any_long, 'Riskweave: ' || n || ' sensitive item' || case when n = 1 then '' else 's' end || ' detected in your prompt.' as title from o""")
def findings_overview(spark, sf):
    return reports.overview(detect_all(spark, sf), "doc_id")


def _spans_sql(rules, table: str, key: str, text: str) -> str:
    rows = " union all ".join(
        f"select {key} as k, {r.ord} as ord, {-r.rank} as neg, regexp_extract_all({text}, {_q(r.re2)}) as m, regexp_split_to_array({text}, {_q(r.re2)}) as p from {table} where regexp_matches({text}, {_q(r.re2)})" for r in rules
    )
    return f"""found as ({rows}),
spans as (select k, ord, neg, i, length(array_to_string(p[1:i], '')) + coalesce(length(array_to_string(m[1:i - 1], '')), 0) as s, m[i] as match from (select *, unnest(generate_series(1, len(m))) as i from found)),
capped as (select * from (select *, row_number() over (partition by k order by ord, i) as c from spans) where c <= 200),
sorted as (select *, s + length(match) as e, row_number() over (partition by k order by s, neg, ord, i) as n from capped),
walk(k, n, last, kept, taken) as (
  select k, 0::bigint, 0::bigint, false, 0 from (select distinct k from sorted)
  union all select w.k, w.n + 1, case when x.s >= w.last and w.taken < 50 then x.e else w.last end, x.s >= w.last and w.taken < 50, w.taken + case when x.s >= w.last and w.taken < 50 then 1 else 0 end from walk w join sorted x on x.k = w.k and x.n = w.n + 1)"""


@query(f"with recursive {_spans_sql(PLAIN, 'documents', 'doc_id', 'text')} select x.k as doc_id, x.ord, x.s as start, x.e as \"end\", x.match from sorted x join walk w on w.k = x.k and w.n = x.n where w.kept")
def detect_plain_rules(spark, sf):
    """Findings of all rules that RE2 can read, checked span by span."""
    found = reports.scan_table(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id", rules=PLAIN)
    return found.select("doc_id", "ord", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "match")


_PAGE_RULES = tuple(r for r in PLAIN if r.category.startswith(("xss", "owasp_insecure_output", "sqli", "xml", "xxe")))


@query(f"with recursive {_spans_sql(_PAGE_RULES, 'pages', 'page_id', 'html')} select x.k as page_id, x.ord, x.s as start, x.e as \"end\", x.match from sorted x join walk w on w.k = x.k and w.n = x.n where w.kept")
def detect_page_markup(spark, sf):
    pages = _t(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    found = reports.scan_table(pages, "page_id", rules=_PAGE_RULES)
    return found.select("page_id", "ord", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "match")


@query(f"with recursive {_findings_sql('documents', 'doc_id', 'text', 'severity')} select k as doc_id, {_COLUMNS} from finding")
def detect_severity_policy(spark, sf):
    return reports.scan_table(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id", policy="severity")


@query(f"with recursive {_findings_sql('c', 'cid', 'text')} select role, category, count(*)::bigint as n from finding join c on c.cid = k group by role, category".replace("with recursive ", "with recursive c as (select row_number() over () as cid, role, text from conversations), ", 1))
def detect_conversations(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    found = detect.detect(c)
    return found.select("role", F.explode("findings").alias("f")).groupBy("role", F.col("f.category").alias("category")).agg(F.count("*").alias("n"))


@query(f"""{_FOUND_SQL}, w as (select k, count(*)::int as n, arg_min(category, (-rank, start, ord)) as category, arg_min(severity, (-rank, start, ord)) as severity from finding group by k)
select doc_id, coalesce(n, 0) as n_findings, category as top_category, severity as top_severity, length(text) >= 2000 as is_long from documents left join w on k = doc_id""")
def risk_per_text(spark, sf):
    return reports.per_text(detect.detect(_t(spark, sf, "documents").select("doc_id", "text")), "doc_id")


@query(f"""{_FOUND_SQL}, l(category, label, short) as (values """ + ", ".join(f"({_q(c)}, {_q(S.LABELS.get(c) or next((y + c[len(x):] for x, y in S.LABEL_PREFIXES if c.startswith(x)), c))}, {_q(S.SHORT_LABELS.get(c, c))})" for c in dict.fromkeys(r.category for r in R.catalog())) + """)
select k as doc_id, start, case when length(match) > 8 then substr(match, 1, 4) || '…' || right(match, 4) else match end as masked, label || ' (severity: ' || severity || ')' as description, short from finding join l using (category)""")
def mask_findings(spark, sf):
    found = detect_all(spark, sf)
    return found.select("doc_id", "start", S.mask(F.col("match")).alias("masked"), S.describe(F.col("category"), F.col("severity")).alias("description"), S.short_label(F.col("category")).alias("short"))


#: A text for each rule, made from its pattern.
_SAMPLES = [(r.ord, sample(r)) for r in R.catalog()]
_SAMPLES_SQL = "samples(id, text) as (values " + ", ".join(f"({k}, {_q(t)})" for k, t in _SAMPLES if t) + ")"


def _samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([x for x in _SAMPLES if x[1]], "id int, text string")


@query(f"with recursive {_SAMPLES_SQL}, {_findings_sql('samples', 'id', 'text')} select k as id, {_COLUMNS} from finding")
def detect_samples(spark, sf):
    """The full catalog over a text for each of its rules."""
    return reports.scan_table(_samples(spark), "id")


@query(f"with recursive {_SAMPLES_SQL}, {_findings_sql('samples', 'id', 'text')} select ord, count(*)::bigint as n from sorted where ord = k group by ord")
def rule_hits(spark, sf):
    """How often each rule matches its own text, before overlaps are resolved: every rule does."""
    rows = spark.createDataFrame([(r.ord, r.java, r.category == detect.CARD, t) for r, (_, t) in zip(R.catalog(), _SAMPLES, strict=True) if t], "ord int, pattern string, card boolean, text string")
    found = F.regexp_extract_all("text", F.col("pattern"), 0)
    return rows.select("ord", F.size(F.filter(found, lambda m: ~F.col("card") | S.luhn(m))).cast("long").alias("n"))


@query("select " + ", ".join(f"count(*) filter (length(text) >= 0 and regexp_matches(text, '{x}'))::bigint as {n}" for n, x in (("n_email", "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9-]+[.][a-zA-Z]{2,}"), ("n_quad", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"))) + " from documents")
def shape_counts(spark, sf):
    x = F.col("text")
    return _t(spark, sf, "documents").agg(F.count_if(x.rlike("[a-zA-Z0-9._%+-]+@[a-zA-Z0-9-]+[.][a-zA-Z]{2,}")).alias("n_email"), F.count_if(x.rlike("[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}")).alias("n_quad"))


def _values(rows: list[str]) -> str:
    return ", ".join(f"({k}, '{c}', '{s}', {r}, {f}, {str(w).lower()})" for k, c, s, r, f, w in rows)


@query("select * from (values " + _values([(r.ord, r.category, r.severity, r.rank, r.facet, r.wire_valid) for r in R.catalog()]) + ") as t(ord, category, severity, rank, facet, wire_valid)")
def rule_catalog(spark, sf):
    """The catalog with ranks and facets by expression, against the same by lookup."""
    rows = spark.createDataFrame([(r.ord, r.category, r.severity) for r in R.catalog()], "ord int, category string, severity string")
    return rows.select("ord", "category", "severity", S.severity_rank(F.col("severity")).alias("rank"), S.facet(F.col("category")).alias("facet"), F.coalesce(F.col("category").isin(*R.WIRE_CATEGORIES), F.lit(False)).alias("wire_valid"))


@query("select c_custkey, substr(sha256(lower(c_name)), 1, 16) as domain_hash from customer")
def host_hashes(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", S.host_hash(F.col("c_name")).alias("domain_hash"))


@query(f"""{_FOUND_SQL} select k as doc_id, 1 as event_version, substr(sha256(lower(source || '.example.com')), 1, 16) as domain_hash, facet, category, severity, 'send_anyway' as user_action, {NOW}::bigint + k as timestamp, '1.0+regex-v1' as model_version, '1.0' as app_version, 1.0::double as confidence
from finding join documents on doc_id = k where category in (""" + ", ".join(map(_q, R.WIRE_CATEGORIES)) + ")")
def finding_events(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text", "source")
    return findings_to_events(docs, "doc_id", F.concat("source", F.lit(".example.com")), F.lit(NOW) + F.col("doc_id"))


_EVENT_SQL = """e as (select event_id, user_id, event_type, floor(epoch(ts))::bigint as t,
 case when event_id % 7 = 0 then 'no' else 'critical' end as severity, case when event_id % 11 = 0 then 'prompt' else 'pii_email' end as category, case when event_id % 5 = 0 then 7 else 1 + event_id % 6 end as facet,
 substr(sha256('u' || user_id::varchar), 1, case when event_id % 13 = 0 then 15 else 16 end) as h, case when event_id % 17 = 0 then 1.5 else 0.5 end as confidence from events)"""


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Wire events as JSON, made from the event table; some are broken, each in a known way."""
    e, k = _t(spark, sf, "events"), F.col("event_id")
    body = F.struct(
        F.lit(1).alias("event_version"), F.substring(F.sha2(F.concat(F.lit("u"), F.col("user_id").cast("string")), 256), 1, 16).alias("_h"),
        F.when(k % 5 == 0, 7).otherwise(1 + k % 6).alias("facet"), F.when(k % 11 == 0, "prompt").otherwise("pii_email").alias("category"), F.when(k % 7 == 0, "no").otherwise("critical").alias("severity"),
        F.lit("edit").alias("user_action"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp"), F.lit("m").alias("model_version"), F.lit("1").alias("app_version"), F.when(k % 17 == 0, 1.5).otherwise(0.5).alias("confidence"),
    )
    body = body.withField("domain_hash", F.when(k % 13 == 0, F.substring(body["_h"], 1, 15)).otherwise(body["_h"])).dropFields("_h")
    return e.select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.to_json(body).alias("json"))


@query(f"""with {_EVENT_SQL} select event_id, case when length(h) <> 16 then 'domain_hash_length' when facet not between 1 and 6 then 'bad_facet' when category = 'prompt' then 'bad_category' when severity = 'no' then 'bad_severity'
 when abs(t - (select max(floor(epoch(ts))::bigint) from events)) > 86400 then 'timestamp_out_of_range' when confidence > 1 then 'bad_confidence' end as reason from e""")
def validate_events(spark, sf):
    raw = raw_events(spark, sf)
    now = raw.agg(F.max("t").alias("_now"))
    return events.validate(raw.crossJoin(F.broadcast(now)), F.col("_now")).select("event_id", "reason")


@query("""with recursive e as (select event_id, user_id, (epoch_ms(ts))::bigint as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
w(user_id, n, recent, ok) as (select distinct user_id, 0::bigint, []::bigint[], false from e union all
 select w.user_id, e.n, case when len(list_filter(w.recent, lambda x: x > e.t - 3600000)) < 3 then list_append(list_filter(w.recent, lambda x: x > e.t - 3600000), e.t) else list_filter(w.recent, lambda x: x > e.t - 3600000) end,
  len(list_filter(w.recent, lambda x: x > e.t - 3600000)) < 3 from w join e on e.user_id = w.user_id and e.n = w.n + 1)
select e.event_id, w.ok as accepted from w join e using (user_id, n)""")
def rate_limited(spark, sf):
    """Three accepted events an hour and user; refused events do not count."""
    e = _t(spark, sf, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return events.rate_limit(e, "user_id", "t", order="event_id", limit=3, window_ms=3_600_000).select("event_id", "accepted")


@query("select event_id, user_id, floor(epoch(ts))::bigint as timestamp from events order by ts desc, event_id desc limit 1000")
def audit_newest(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return events.newest(e, 1000, "ts", "event_id").select("event_id", "user_id", F.unix_timestamp("ts").alias("timestamp"))


_DISMISS_SQL = "d as (select user_id::varchar || '::' || event_type as key, max(floor(epoch(ts))::bigint) as dismissed_at from events group by 1)"


@query(f"with {_DISMISS_SQL} select key, dismissed_at from d where dismissed_at + 86400 > (select max(dismissed_at) from d) order by dismissed_at desc, key limit 1000")
def live_dismissals(spark, sf):
    e = _t(spark, sf, "events").select(F.concat_ws("::", F.col("user_id").cast("string"), "event_type").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("dismissed_at"))
    e = e.select("key", "dismissed_at", (F.col("dismissed_at") + events.TTL).alias("expires_at"), F.col("dismissed_at").alias("created_at"))
    now = e.agg(F.max("dismissed_at")).first()[0]
    return events.dismissals(e.limit(0), e, F.lit(now)).select("key", "dismissed_at")


@query("""with c as (select user_id, ts, event_type = 'purchase' as enabled from events where event_id % 10 = 0), e as (select event_id, user_id, ts from events where event_id % 10 <> 0)
select event_id, coalesce((select arg_max(enabled, c.ts) from c where c.user_id = e.user_id and c.ts <= e.ts), false) as enabled from e""")
def consent_as_of(spark, sf):
    e = _t(spark, sf, "events")
    states = e.filter("event_id % 10 = 0").select("user_id", F.col("ts").alias("last_changed_at"), (F.col("event_type") == "purchase").alias("enabled"))
    rows = e.filter("event_id % 10 <> 0").select("event_id", "user_id", F.col("ts").alias("timestamp"))
    return events.consent_at(rows, states, "user_id").select("event_id", "enabled")


@query(f"""with {_SCORED_SQL}, c as (select source, (count(*) filter (score >= 0.5 and label = 1))::double as tp, (count(*) filter (score >= 0.5 and label <> 1))::double as fp, (count(*) filter (score < 0.5 and label = 1))::double as fn,
 (count(*) filter (score < 0.5 and label <> 1))::double as tn from scored group by source), m as ({_metrics_sql('source')} from c)
select source, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, n::bigint as n, round(recall, 4) as recall, round(fpr, 4) as fpr, round(precision, 4) as precision, round(f1, 4) as f1 from m""")
def confusion_by_source(spark, sf):
    m = evaluate.confusion(scored(spark, sf), 0.5, ("source",))
    return m.select("source", "tp", "fp", "fn", "tn", "n", *(F.round(c, 4).alias(c) for c in ("recall", "fpr", "precision", "f1")))


@query(f"""with {_SCORED_SQL}, t as (select unnest([{', '.join(map(str, evaluate.THRESHOLDS))}]::double[]) as threshold),
c as (select threshold, (count(*) filter (score >= threshold and label = 1)) as tp, (count(*) filter (score >= threshold and label <> 1)) as fp, (count(*) filter (score < threshold and label = 1)) as fn, (count(*) filter (score < threshold and label <> 1)) as tn from scored, t group by threshold)
select threshold, tp, fp, fn, tn, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end, 6) as f1 from c""")
def threshold_sweep(spark, sf):
    return evaluate.sweep(scored(spark, sf)).select("threshold", "tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"))


@query(f"""with {_SCORED_SQL}, t as (select unnest([{', '.join(map(str, evaluate.THRESHOLDS))}]::double[]) as threshold), c as (select lang, threshold, count(*) filter (score >= threshold and label = 1) as tp, count(*) filter (score >= threshold and label <> 1) as fp, count(*) filter (score < threshold and label = 1) as fn from scored, t group by lang, threshold),
f as (select lang, threshold, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end as f1 from c) select lang, threshold, round(f1, 6) as f1 from (select *, row_number() over (partition by lang order by f1 desc, threshold) as n from f) where n = 1""")
def best_thresholds(spark, sf):
    swept = evaluate.sweep(scored(spark, sf), by=("lang",))
    return evaluate.best_threshold(swept, ("lang",)).select("lang", "threshold", F.round("f1", 6).alias("f1"))


@query(f"""with {_SCORED_SQL}, r as (select lang, list_sort(list(score)) as s, count(*) as n from scored group by lang)
select lang, n, case when n >= 10 then s[n // 10 + 1] else s[1] end as p10, s[n // 2 + 1] as p50, case when n >= 10 then s[n * 9 // 10 + 1] else s[n] end as p90 from r""")
def score_percentiles(spark, sf):
    return evaluate.percentiles(scored(spark, sf), ("lang",))


@query(f"""with {_SCORED_SQL}, w as (select doc_id, case when score >= 0.5 then 'fp' else 'fn' end as kind, text from scored where (score >= 0.5) <> (label = 1))
select kind, doc_id, substr(text, 1, 100) as snippet from (select *, row_number() over (partition by kind order by doc_id) as n from w) where n <= 5""")
def worst_five(spark, sf):
    return evaluate.worst_cases(scored(spark, sf), 0.5, "doc_id").select("kind", "doc_id", "snippet")


@query("select doc_id, case when length(text) // 4 <= 128 then 128 when length(text) // 4 <= 256 then 256 when length(text) // 4 <= 512 then 512 else 1024 end as bucket from documents")
def length_buckets(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", S.length_bucket(F.col("text")).alias("bucket"))


@query("select quality as label, doc_id from (select *, row_number() over (partition by quality order by doc_id) as n from labels) where n <= 20")
def capped_per_label(spark, sf):
    rows = _t(spark, sf, "labels").select(F.col("quality").alias("label"), "doc_id")
    return corpus.cap_per_label(rows, 20, "doc_id").select("label", "doc_id")


@query("""with r as (select source, quality, count(*) as n from documents d join labels l using (doc_id) where length(text) <= 2000 group by all), s as (select source, sum(n) filter (quality = 1) as o, sum(n) filter (quality = 0) as z from r group by source)
select source, least(20, coalesce(o, 0) + coalesce(z, 0))::bigint as n from s""")
def quota_sample_sizes(spark, sf):
    rows = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("id"), "source", F.col("quality").alias("label"), "text")
    quotas = {f"src{k}": 20 for k in range(20)}
    return corpus.sample_to_quota(rows, spark, quotas).groupBy("source").agg(F.count("*").alias("n"))


@query("select doc_id, regexp_matches(text, '(?i)act as|you are now|jailbreak|no restrictions') as attack from documents")
def attack_phrases(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", S.contains_any(F.col("text"), ("act as", "you are now", "jailbreak", "no restrictions")).alias("attack"))


@query("""with d as (select doc_id, coalesce(length(text), 0) as n from documents), c as (select *, case when n <= 2048 then 1 else least(4, ceil((n - 2048) / 1024.0)::int + 1) end as c from d),
x as (select doc_id, n, case when n <= 2048 then 0 when k = c then n - 2048 else k * 1024 end as s from c, range(0, 5) as r(k) where k < c or (k = c and n > 4096)),
y as (select doc_id, n, s, case when n <= 512 then 512 else 2048 end as width, case when n <= 512 then least(n, 510) else least(2046, n - s) end as len from x)
select doc_id, s::int as start, case when n > 0 then (s + 1) % 1000 + 3 end::int as first_id, case when n > 0 then (s + len) % 1000 + 3 end::int as last_id, width, (len + 2)::int as n_mask from y""")
def token_windows(spark, sf):
    """Windows over a text's characters as ids, by their first and last id, size and mask."""
    n = F.coalesce(F.length("text"), F.lit(0))
    d = _t(spark, sf, "documents").select("doc_id", n.alias("n"), F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: (k % 1000 + 3).cast("int"))).otherwise(F.array().cast("array<int>")).alias("ids"))
    starts = F.when(F.col("n") <= windows.SHORT, F.array(F.lit(0))).otherwise(windows.window_starts(F.col("n")))
    w = windows.extract_windows(d).select("doc_id", "n", F.explode(F.arrays_zip(starts.alias("start"), F.col("windows").alias("w"))).alias("x"))
    ids, used = F.col("x.w.input_ids"), F.array_position(F.col("x.w.input_ids"), windows.SEP).cast("int")
    some = F.col("n") > 0
    return w.select("doc_id", F.col("x.start").alias("start"), F.when(some, F.get(ids, F.lit(1))).alias("first_id"), F.when(some, F.get(ids, used - 2)).alias("last_id"), F.size(ids).alias("width"), F.aggregate("x.w.attention_mask", F.lit(0), lambda a, m: a + m).alias("n_mask"))


@query("""select doc_id, case when length(text) >= 2000 then 'prompt_injection_ml_long' else 'prompt_injection_ml' end as category, case when length(text) >= 2000 then 'medium' else 'high' end as severity, substr(text, 1, 80) as match from scored where score >= 0.05""".replace("select doc_id", f"with {_SCORED_SQL} select doc_id", 1))
def ml_findings(spark, sf):
    found = scored(spark, sf).withColumn("f", S.ml_finding(F.col("text"), F.col("score"))).filter("f is not null")
    return found.select("doc_id", "f.category", "f.severity", "f.match")
