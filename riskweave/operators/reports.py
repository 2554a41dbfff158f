"""Summaries of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .detect import detect, explode_findings, top_finding


def summary(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by).agg(F.count("*").alias("n_findings"), F.max("rank").alias("worst_rank"))


def per_text(found: DataFrame, key: str, text_col: str = "text", long_at: int = 2000) -> DataFrame:
    """Per text: how many findings, the worst category and severity, and whether the text is long."""
    top = top_finding(F.col("findings"))
    return found.select(key, F.size("findings").alias("n_findings"), top["category"].alias("top_category"), top["severity"].alias("top_severity"), (F.length(text_col) >= long_at).alias("is_long"))


LONG_CATEGORIES = ("prompt_injection_ml_long", "prompt_injection_transformer_long")  # fixed values


def title(n: Column, any_long: Column, product: str = "Riskweave") -> Column:
    """What is told of a text's findings."""
    items = F.concat(n.cast("string"), F.lit(" sensitive item"), F.when(n == 1, "").otherwise("s"), F.lit(" detected in your prompt."))
    return F.concat(F.lit(f"{product}: "), F.when(any_long, "This long prompt looks unusual — please confirm before sending.").otherwise(items))


def overview(findings: DataFrame, key: str) -> DataFrame:
    """Per text: its findings, whether one is an advisory on long texts, and the title."""
    out = findings.groupBy(key).agg(F.count("*").alias("n_findings"), F.bool_or(F.col("category").isin(*LONG_CATEGORIES)).alias("any_long"))
    return out.withColumn("title", title(F.col("n_findings"), F.col("any_long")))


def markdown(df: DataFrame, order: str) -> DataFrame:
    """(place, line) of a table in Markdown: its head, then a line for each row in order. For reports, which are small."""
    cell = lambda c: F.coalesce(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"[|\n]", " "), F.lit(""))
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = df.select((F.row_number().over(Window.orderBy(order)) + 1).cast("long").alias("place"), line([cell(c) for c in df.columns]).alias("line"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "-|" * len(df.columns))], "place long, line string")
    return head.unionByName(body)


def write_report(df: DataFrame, path: str, order: str) -> None:
    """A report as JSON, CSV and Markdown, one file each in a folder of its kind."""
    df = df.orderBy(order).coalesce(1)
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    markdown(df, order).orderBy("place").coalesce(1).select("line").write.mode("overwrite").text(f"{path}/markdown")


def overlapping_pairs(spans: DataFrame, key: str) -> DataFrame:
    """Pairs of spans of a text that overlap: a range join inside each key."""
    a, b = (spans.select(F.col(key), *(F.col(c).alias(f"{c}_{s}") for c in ("ord", "start", "end"))) for s in "ab")
    return a.join(b, key).filter((F.col("start_a") < F.col("end_b")) & (F.col("start_b") < F.col("end_a")) & (F.struct("start_a", "ord_a") < F.struct("start_b", "ord_b")))


def scan_table(df: DataFrame, key: str, **how) -> DataFrame:
    """One row for each finding of each text."""
    return explode_findings(detect(df, **how), [key])
