"""Queries against their SQL on small tables, and operators that no query covers."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from riskweave import catalog_queries, operations_queries
from riskweave import rules as R
from riskweave.functions import url_encoded
from riskweave.operators import corpus, detect, events, evaluate, reports, state, windows
from riskweave.rules.samples import sample
from riskweave.sources import corpora, registry
from riskweave.streaming import pipelines

SF = "/root/testdata/sf0.001"
QUERIES = catalog_queries.QUERIES | operations_queries.QUERIES
SQL = catalog_queries.ORACLE_SQL | operations_queries.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = want.fetchall()
    assert sorted(str(tuple(r[c] for c in sorted(names))) for r in got.collect()) == sorted(str(tuple(r[names.index(c)] for c in sorted(names))) for r in rows)


def test_every_rule_has_a_text_that_the_prefilter_lets_through():
    rules = R.catalog()
    before = detect.prefilter(rules)
    for rule in rules:
        text = sample(rule)
        assert text and any(detect.matches(rule, text)) and rule in before(text)


def test_prefilter_without_its_automaton():
    rules = R.catalog()
    plain = detect.Prefilter(rules)
    plain.automaton = None
    for rule in rules[::7]:
        assert plain(sample(rule)) == detect.prefilter(rules)(sample(rule))


def test_windows(spark):
    df = spark.createDataFrame([(n, list(range(n))) for n in (0, 100, 2048, 2049, 3000, 3072, 3073, 5120, 5121, 7169)] + [(None, None)], "n int, ids array<int>")
    for r in windows.benchmark_windows(df).collect():
        if r.n is None:
            assert r.windows is None
            continue
        count = min(4, -(-(r.n - 2048) // 1024) + 1) if r.n > 2048 else 1
        starts = [min(k * 1024, r.n - 2048) for k in range(count)] if r.n > 2048 else [0]
        assert [list(w.input_ids) for w in r.windows] == [list(range(s, min(s + 2048, r.n))) for s in starts] and all(set(w.attention_mask) <= {1} for w in r.windows)
    for r in windows.sizing_windows(df.filter("n is not null")).collect():
        parts = [list(range(s, min(s + 2048, r.n))) for s in range(0, r.n, 1024)][:4] if r.n > 2048 else [list(range(r.n))]
        size = max(map(len, parts)) + 2
        assert [list(w.input_ids) for w in r.windows] == [[0, *p, 2] + [0] * (size - len(p) - 2) for p in parts]
        assert [sum(w.attention_mask) for w in r.windows] == [len(p) + 2 for p in parts]


def test_state(spark, tmp_path):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 5), (None, "x", 1)], state.STATE)
    new = spark.createDataFrame([("a", "3", 2), ("b", "9", 4), ("c", "4", 1), ("a", None, 0)], state.STATE)
    now = state.upsert(old, new)
    assert sorted(map(tuple, now.collect())) == [("a", "3", 2), ("b", "2", 5), ("c", "4", 1)]
    state.write_state(old.filter("key is not null"), f"{tmp_path}/s", 1)
    state.write_state(now, f"{tmp_path}/s", 2)
    assert sorted(r.value for r in state.read_state(spark, f"{tmp_path}/s").collect()) == ["2", "3", "4"]
    assert {r.key: r.value for r in state.read_state(spark, f"{tmp_path}/s", ("a", "z"), {"y": "0"}).collect()} == {"a": "3", "z": None, "y": "0"}
    assert state.health(spark.createDataFrame([], "timestamp long"), F.lit(5)).first().status == "error"


def test_hold_out(spark):
    rows = spark.createDataFrame([(k % 900,) for k in range(1000)], "id long")
    split = corpus.hold_out(rows).collect()
    hashed = {r.id: r.h for r in rows.distinct().select("id", F.xxhash64(F.lit(42), F.col("id").cast("string")).alias("h")).collect()}
    val = [r.id for r in split if r.split == "val"]
    first = sorted((hashed[r.id], r.id) for r in split)[:50]
    assert set(val) == {i for _, i in first} and len(val) >= 50
    assert corpus.hold_out(rows.limit(5)).filter("split = 'val'").count() == 0


def test_registry(spark):
    needed = registry.model_files(spark.createDataFrame([("b", "lr", "lr", 0)], "bundle string, model string, type string, n_layers int"), spark.createDataFrame([], "bundle string, name string"))
    with pytest.raises(Exception, match="missing files of model lr"):
        registry.complete_models(needed, strict=True).collect()
    assert spark.range(1).select(registry.ensemble(F.array().cast("array<double>")).alias("e")).first().e is None
    assert spark.range(1).select(url_encoded(F.lit("a b/é~!'()*+%")).alias("u")).first().u == "a%20b%2F%C3%A9~!'()*%2B%25"


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, "x|y"), (1, None)], "k int, v string")
    reports.write_report(df, str(tmp_path), "k")
    read = lambda kind: "".join(p.read_text() for p in sorted((tmp_path / kind).glob("part-*")))
    assert read("markdown") == "| k | v |\n|-|-|\n| 1 |  |\n| 2 | x y |\n" and read("csv").splitlines()[0] == "k,v" and json.loads(read("json").splitlines()[1]) == {"k": 2, "v": "x|y"}
    found = spark.createDataFrame([(1, "pii_email"), (2, "pii_email"), (2, "prompt_injection_ml_long")], "id int, category string")
    assert {r.id: r.title for r in reports.overview(found, "id").collect()} == {1: "Riskweave: 1 sensitive item detected in your prompt.", 2: "Riskweave: This long prompt looks unusual — please confirm before sending."}


def test_lockfile(spark, tmp_path):
    old = spark.createDataFrame([("b", "0" * 64), ("a", "1" * 64), ("a", "1" * 64)], "name string, sha256 string")
    corpora.write_lockfile(old, spark.createDataFrame([("b", "2" * 64)], "name string, sha256 string"), f"{tmp_path}/l")
    assert sorted(map(tuple, corpora.read_lockfile(spark, f"{tmp_path}/l").collect())) == [("a", "1" * 64), ("b", "2" * 64)]


def test_relabelled_and_timed_out(spark):
    rows = spark.createDataFrame([(True, 0.9), (True, 0.1), (False, 0.9), (None, 0.9)], "fix_applied boolean, score double")
    assert tuple(evaluate.relabelled_recall(rows, 0.5).first()) == (2, 1, 0.5)
    assert evaluate.relabelled_recall(rows.limit(0), 0.5).first().recall == 0


def test_sink_and_dismissals_stream(spark, tmp_path):
    good = json.dumps(json.loads(operations_queries._event_json()) | {"timestamp": spark.range(1).select(F.unix_timestamp(F.current_timestamp()).alias("t")).first().t})
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(good + "\n{}\n")
    raw = spark.readStream.format("text").load(f"{tmp_path}/in").withColumnRenamed("value", "json")
    state.write_state(spark.createDataFrame([("opt_in", "true", 1)], state.STATE), f"{tmp_path}/state", 1)
    pipelines.accepted_events(raw, f"{tmp_path}/out", f"{tmp_path}/c", state_path=f"{tmp_path}/state", once=True).awaitTermination()
    assert spark.read.json(f"{tmp_path}/out/events").first().facet == 1 and spark.read.json(f"{tmp_path}/out/rejected").first().reason == "missing_event_version"
    state.write_state(spark.createDataFrame([("opt_in", "false", 2)], state.STATE), f"{tmp_path}/state", 2)
    (tmp_path / "in/b.txt").write_text(good + "\n")
    pipelines.accepted_events(raw, f"{tmp_path}/out", f"{tmp_path}/c", state_path=f"{tmp_path}/state", once=True).awaitTermination()
    assert spark.read.json(f"{tmp_path}/out/events").count() == 1

    rows = spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 01:00:00"), ("l", "2024-01-01 02:00:00")], "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/d")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/d").withWatermark("ts", "1 hour")
    out = pipelines.dismissals(stream, "key", "ts")
    out.writeStream.format("memory").queryName("dismissed").outputMode("append").option("checkpointLocation", f"{tmp_path}/dc").trigger(availableNow=True).start().awaitTermination()
    got = {r.key: (str(r.dismissed_at), str(r.expires_at)) for r in spark.table("dismissed").collect()}
    assert got == {"k": ("2024-01-01 01:00:00", "2024-01-02 01:00:00"), "l": ("2024-01-01 02:00:00", "2024-01-02 02:00:00")}


def test_queue_event_extras(spark):
    row = spark.createDataFrame([(1, "h", "c", None, None, None, None, "", "p", None, 0.5, 0)], "timestamp long, domain_hash string, category string, severity string, user_action string, model_version string, app_version string, attack_keywords_hash string, attack_pattern_id string, bundle_signature string, model_consensus double, similar_attack_count_30d int")
    got = events.queue_event(row).first()
    assert (got.severity, got.user_action, got.attack_keywords_hash, got.attack_pattern_id, got.model_consensus, got.similar_attack_count_30d) == ("info", "detect", None, "p", 0.5, None)


def test_bundles(spark, tmp_path):
    import hashlib

    files = {"a.json": b"{}", "m.onnx": b"\x00{\x01", "v.txt": b"words"}
    listed, payload = [], b""
    for name, body in files.items():
        listed.append({"name": name, "size": len(body), "sha256": hashlib.sha256(body).hexdigest(), "offset": len(payload)})
        payload += body
    header = {"files": listed, "license": "MIT", "magic": "M1", "note": 'a "}" in it', "payload_sha256": hashlib.sha256(payload).hexdigest(), "signing_public_key": "AB" * 32, "total_payload_size": len(payload)}
    (tmp_path / "good").write_bytes(b"\x7f{ no json }" + json.dumps(header).encode() + payload + b"s" * 64)
    (tmp_path / "bad").write_bytes(json.dumps(header).encode() + payload[:-1] + b"?" + b"s" * 64)
    (tmp_path / "none").write_bytes(b"{}")
    got = {(os.path.basename(r.path), r.file): r for r in corpora.read_bundles(spark, str(tmp_path), "M1").collect()}
    assert [got["good", f].kind for f in files] == ["json", "binary", "text"] and all(got["good", f].ok and got["good", f].payload_ok for f in files)
    assert not got["bad", "v.txt"].ok and got["bad", "a.json"].ok and not got["bad", "a.json"].payload_ok and got["none", None].ok is None
    ring = spark.createDataFrame([("k", "q" * 42 + "s=")], "key_id string, b64 string")
    keyed = registry.signing_keys(corpora.read_bundles(spark, str(tmp_path), "M1"), ring)
    assert {r.key_id for r in keyed.collect()} <= {"k", None}
    assert corpora.read_bundles(spark, str(tmp_path), "other").filter("file is not null").count() == 0


def test_least_chars(spark):
    df = spark.createDataFrame([("a@b.cc",), ("a@",), (None,)], "text string")
    for engine in ("arrow", "expressions"):
        rules = R.by_name(R.catalog(), "email_v1")
        assert [len(r.findings) for r in detect.detect(df, rules=rules, engine=engine, least_chars=3).collect()] == [1, 0, 0]
        assert [len(r.findings) for r in detect.detect(df, rules=rules, engine=engine, least_chars=7).collect()] == [0, 0, 0]
