"""Events, evaluation, corpora and windows on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from riskweave import functions as S
from riskweave.operators import corpus, evaluate, events, windows
from riskweave.sources import corpora

GOOD = {"event_version": 1, "domain_hash": "b5d56b87a192a38e", "facet": 1, "category": "pii_email", "severity": "high", "user_action": "edit", "timestamp": 1000, "model_version": "m", "app_version": "1", "confidence": 0.5}
BROKEN = [
    ({}, None), ({"prompt": "x"}, "unknown_field"), ({"severity": None, "category": 3}, "bad_category"), ({"event_version": 3}, "bad_event_version"), ({"event_version": "1"}, "bad_event_version"),
    ({"domain_hash": "B5D56B87A192A38E"}, "domain_hash_not_hex"), ({"domain_hash": "ab"}, "domain_hash_length"), ({"domain_hash": 5}, "domain_hash_not_string"), ({"facet": 7}, "bad_facet"), ({"facet": None}, None),
    ({"event_version": 2, "facet": None}, "bad_facet"), ({"severity": "worst"}, "bad_severity"), ({"user_action": "detect"}, "bad_user_action"), ({"timestamp": 1.5}, "timestamp_not_integer"),
    ({"timestamp": 1000 + 86401}, "timestamp_out_of_range"), ({"timestamp": 1000 + 86400}, None), ({"model_version": ""}, "bad_model_version"), ({"app_version": 1}, "bad_app_version"), ({"confidence": 1.01}, "bad_confidence"),
    ({"id": ""}, "bad_id"), ({"fp_reason": "x" * 201}, "fp_reason_too_long"), ({"fp_reason": "see http://a"}, "fp_reason_has_url"), ({"match_count": 0}, "bad_match_count"),
]


def test_validation(spark):
    rows = [(k, json.dumps(GOOD | change)) for k, (change, _) in enumerate(BROKEN)]
    rows += [(100, "no json"), (101, json.dumps({k: v for k, v in GOOD.items() if k != "category"})), (102, None), (103, "[1]")]
    out = {r.k: r.reason for r in events.validate(spark.createDataFrame(rows, "k int, json string"), F.lit(1000)).collect()}
    assert [out[k] for k in range(len(BROKEN))] == [reason for _, reason in BROKEN]
    assert (out[100], out[101], out[102], out[103]) == ("not_an_object", "missing_category", "not_an_object", "not_an_object")


def test_host_hash(spark):
    got = spark.createDataFrame([("chat.openai.com",), ("CLAUDE.ai",), ("",), (None,)], "h string").select(S.host_hash(F.col("h"))).collect()
    assert [r[0] for r in got] == ["b5d56b87a192a38e", "743e483ae01f1fa2", None, None]


def test_rate_limit(spark):
    rows = [("a", k) for k in range(105)] + [("a", 60_000 + k) for k in range(3)] + [("b", 5)]
    out = events.rate_limit(spark.createDataFrame(rows, "k string, t long"), "k", "t").filter("accepted").groupBy("k").count().collect()
    assert dict(out) == {"a": 103, "b": 1}


def test_dismissals(spark):
    schema = "key string, category string, reason string, dismissed_at long, expires_at long, created_at long"
    stored = spark.createDataFrame([(f"o{k}", "c", "r", 1, 5, 1) for k in range(50)] + [(f"n{k}", "c", "r", 10, 99, 10) for k in range(50)], schema)
    fresh = spark.createDataFrame([("x", "c", "r", 20, 99, 20)], schema)
    assert events.dismissals(stored, fresh, F.lit(20)).count() == 51
    assert events.dismissals(stored, fresh, F.lit(20), cap=10).filter("key = 'x'").count() == 1


def test_windows(spark):
    sizes = {0: 1, 100: 1, 512: 1, 513: 1, 2048: 1, 2049: 2, 3000: 2, 3072: 2, 3073: 3, 4096: 3, 4097: 5, 5121: 5, 10000: 5}
    df = spark.createDataFrame([(n, list(range(3, n + 3))) for n in sizes], "n int, ids array<int>")
    got = {r.n: r.windows for r in windows.extract_windows(df).collect()}
    assert {n: len(w) for n, w in got.items()} == sizes
    assert got[10000][4].input_ids[1] == 7952 + 3 and len(got[100][0].input_ids) == 512 and sum(got[100][0].attention_mask) == 102
    bounded = {r.n: len(r.windows) for r in windows.benchmark_windows(df).collect()}
    assert bounded[10000] == 4 and bounded[3000] == 2


def test_tokenize(spark):
    df = spark.createDataFrame([("Hello,  helloworld x",), (None,)], "text string")
    got = [r.ids for r in windows.tokenize(df, {"hello": 5, "world": 6, ",": 7}, unknown=9).collect()]
    assert [list(got[0]), got[1]] == [[5, 7, 5, 6, 9], None]


def test_toxicity(spark):
    got = spark.createDataFrame([([5.0, -5.0, 0.0, -800.0, 800.0, -1.0],), ([1.0],)], "x array<double>").select(windows.toxicity(F.col("x")).alias("t")).collect()
    assert got[1].t is None and got[0].t.any_toxic and [c.flagged for c in got[0].t.categories] == [True, False, True, False, True, False]


def test_evaluation(spark):
    rows = [("s", k % 2, k / 20) for k in range(20)]
    df = spark.createDataFrame(rows, "source string, label int, score double")
    swept = {r.threshold: r for r in evaluate.sweep(df).collect()}
    for t in (0.05, 0.5, 0.95):
        one = evaluate.confusion(df, t).first()
        assert (one.tp, one.fp, one.fn, one.tn) == (swept[t].tp, swept[t].fp, swept[t].fn, swept[t].tn)
    s = sorted(r[2] for r in rows)
    p = evaluate.percentiles(df, ("source",)).first()
    assert (p.p10, p.p50, p.p90) == (s[2], s[10], s[18])
    assert evaluate.best_threshold(evaluate.sweep(df)).first().threshold == min(t for t, r in swept.items() if r.f1 == max(x.f1 for x in swept.values()))


def test_corpora(spark, tmp_path):
    lines = ['{"text": "", "prompt": "hi", "label": 0}', "", "broken", '{"text": "yo", "expected_label": 1}', '{"text": "no label"}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    got = {(r.text, r.label) for r in corpora.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()}
    assert got == {("hi", 0), ("yo", 1)}
    df = spark.createDataFrame([(k, "s", k % 3 == 0, "t") for k in range(100)], "id int, source string, y boolean, text string").withColumn("label", F.col("y").cast("int"))
    assert corpus.sample_to_quota(df, spark, {"s": 80}).count() == 80
    assert corpus.hold_out(df).filter("split = 'val'").count() == 5
    assert corpora.header_end(b'x{"a": "}\\""}rest', 1) == 13
    assert len(corpora.checksums(spark, str(tmp_path)).collect()) == 1


@pytest.mark.parametrize("url,ok", [("https://a.b/c", True), ("http://localhost:80", True), ("http://a.b", False), ("nonsense", False), (None, False)])
def test_urls(spark, url, ok):
    assert spark.createDataFrame([(url,)], "u string").select(S.url_allowed(F.col("u"))).first()[0] is ok


def test_stream(spark, tmp_path):
    from riskweave.streaming import pipelines

    spark.createDataFrame([("a", k) for k in range(105)], "k string, t long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t long").parquet(str(tmp_path / "in"))
    pipelines.write_events(pipelines.limited(stream, "k", "t"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("accepted").count() == 100
