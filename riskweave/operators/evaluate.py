"""Evaluation of scored, labelled rows (label 0 or 1, score) with grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

THRESHOLDS = tuple(round(0.05 * k, 2) for k in range(1, 20))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, threshold: Column | float, by: tuple[str, ...] = (), label: str = "label", score: str = "score") -> DataFrame:
    """tp, fp, fn, tn and rates at ``score >= threshold``; a rate without cases is 0."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit, is_ = F.col(score) >= t, F.col(label) == 1
    counts = df.groupBy(*by).agg(F.count_if(hit & is_).alias("tp"), F.count_if(hit & ~is_).alias("fp"), F.count_if(~hit & is_).alias("fn"), F.count_if(~hit & ~is_).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by, "tp", "fp", "fn", "tn", (tp + fp + fn + tn).alias("n"), _ratio(tp, tp + fn).alias("recall"), _ratio(fp, fp + tn).alias("fpr"), _ratio(tp, tp + fp).alias("precision"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), _ratio(fn, tp + fn).alias("fnr"),
    )


def throughput(n: Column, seconds: Column) -> Column:
    """Records a second to two digits (half to even); null without time."""
    return F.when(seconds > 0, F.bround(n / seconds, 2))


def rounded(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """Rates rounded half to even."""
    return metrics.withColumns({c: F.bround(c, digits) for c in ("recall", "fpr", "precision", "f1", "accuracy", "fnr") if c in metrics.columns})


def sweep(df: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, by: tuple[str, ...] = (), label: str = "label", score: str = "score") -> DataFrame:
    """A confusion row for each threshold. Scores are first counted by the thresholds they reach, so rows are not copied."""
    reached = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    counted = df.groupBy(*by, reached.alias("_r"), (F.col(label) == 1).alias("_y")).agg(F.count("*").alias("_n"))
    each = counted.select(*by, "_r", "_y", "_n", F.posexplode(F.array(*map(F.lit, thresholds))).alias("_k", "threshold"))
    hit, n = F.col("_r") > F.col("_k"), F.col("_n")
    total = lambda c: F.sum(F.when(c, n).otherwise(0))
    out = each.groupBy(*by, "threshold").agg(total(hit & F.col("_y")).alias("tp"), total(hit & ~F.col("_y")).alias("fp"), total(~hit & F.col("_y")).alias("fn"), total(~hit & ~F.col("_y")).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select(*by, "threshold", "tp", "fp", "fn", "tn", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(fp, fp + tn).alias("fpr"), _ratio(fn, tp + fn).alias("fnr"))


def best_threshold(swept: DataFrame, by: tuple[str, ...] = (), least_recall: float | None = None, most_fpr: float | None = None, least: str | None = None) -> DataFrame:
    """The row of greatest f1, or of least ``least``, among those within bounds; of equals the lowest threshold."""
    rows = swept
    if least_recall is not None:
        rows = rows.filter(F.col("recall") >= least_recall)
    if most_fpr is not None:
        rows = rows.filter(F.col("fpr") <= most_fpr)
    first = F.col(least).asc() if least else F.col("f1").desc()
    order = Window.partitionBy(*by).orderBy(first, "threshold") if by else Window.partitionBy(F.lit(0)).orderBy(first, "threshold")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def hard_threshold(swept: DataFrame, short: DataFrame, long_benign: DataFrame, least_recall: float = 0.95, most_fpr: float = 0.10) -> DataFrame:
    """The row of ``swept`` of greatest f1 among the thresholds at which short attacks are found and long harmless texts are
    not: sweeps over all rows, over short attacks and over long harmless texts; of equals the lowest threshold."""
    within = swept.join(short.select("threshold", F.col("recall").alias("short_recall")), "threshold").join(long_benign.select("threshold", F.col("fpr").alias("long_fpr")), "threshold")
    return best_threshold(within.filter((F.col("short_recall") >= least_recall) & (F.col("long_fpr") <= most_fpr)))


def relabelled_recall(df: DataFrame, threshold: float) -> DataFrame:
    """Of the rows whose label was mended: how many, and the share that the score finds."""
    fixed = F.coalesce(F.col("fix_applied"), F.lit(False))
    hit = F.col("score") >= threshold
    return df.agg(F.count_if(fixed).alias("n"), F.count_if(fixed & hit).alias("found"), _ratio(F.count_if(fixed & hit), F.count_if(fixed)).alias("recall"))


def to_evaluate_again(results: DataFrame, corpora: DataFrame, name: str = "corpus", error: str = "error") -> DataFrame:
    """The corpora that ran out of time, of those that are there."""
    return corpora.join(results.filter(F.col(error) == "timeout").select(name), name, "left_semi")


def percentiles(df: DataFrame, by: tuple[str, ...], score: str = "score") -> DataFrame:
    """p10, p50, p90 by index of the sorted scores (n // 10, n // 2, 9n // 10; ends for fewer than ten), exactly.

    Scores are counted by value and ranked with running sums, so that no group is gathered in an array.
    """
    counted = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumns({"_to": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy(*by))})
    n = F.col("_n")
    at = lambda k: F.min(F.when(F.col("_to") > k, F.col(score)))
    small = n < 10
    return ranked.groupBy(*by).agg(
        F.max("_n").alias("n"), at(F.when(small, 0).otherwise(F.expr("_n div 10"))).alias("p10"), at(F.expr("_n div 2")).alias("p50"), at(F.when(small, n - 1).otherwise(F.expr("_n * 9 div 10"))).alias("p90")
    )


def by_source(df: DataFrame, threshold: float, source: str = "source") -> DataFrame:
    """Per source: recall of its attacks, false-positive rate of the rest, score range."""
    hit, is_ = F.col("score") >= threshold, F.col("label") == 1
    return df.groupBy(source).agg(
        F.count("*").alias("n"), _ratio(F.count_if(hit & is_), F.count_if(is_)).alias("recall"), _ratio(F.count_if(hit & ~is_), F.count_if(~is_)).alias("fpr"),
        F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
    )


def single_class(df: DataFrame, threshold: float, corpus: str = "corpus") -> DataFrame:
    """Per corpus and label (a corpus is all attacks or all harmless): size, how many reach the threshold, the share of these
    (recall of attacks, false-positive rate of the rest), score range."""
    hit = F.col("score") >= threshold
    return df.groupBy(corpus, "label").agg(
        F.count("*").alias("size"), F.count_if(hit).alias("flagged"), F.when(F.col("label") == 1, "recall").otherwise("fpr").alias("rate_of"), _ratio(F.count_if(hit), F.count("*")).alias("rate"),
        F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
    )


def worst(per_source: DataFrame, source: str = "source") -> DataFrame:
    """The source of least recall and the one of greatest false-positive rate, first by name of equals."""
    return per_source.agg(F.min_by(source, F.struct("recall", source)).alias("worst_recall"), F.min_by(source, F.struct(-F.col("fpr"), F.col(source))).alias("worst_fpr"))


def worst_cases(df: DataFrame, threshold: float, order: str, by: tuple[str, ...] = (), n: int = 5) -> DataFrame:
    """The first ``n`` wrong rows of each kind in input order, with the first 100 characters of their text."""
    hit, is_ = F.col("score") >= threshold, F.col("label") == 1
    wrong = df.filter(hit != is_).withColumn("kind", F.when(hit, "fp").otherwise("fn"))
    ranked = wrong.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "kind").orderBy(order)))
    return ranked.filter(F.col("_n") <= n).select(*by, "kind", order, "score", F.substring("text", 1, 100).alias("snippet"))


def determinism(runs: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """Per text, over repeated runs: range of the score, whether it is stable, and the label its mean gives at 0.5."""
    return runs.groupBy(key).agg((F.max("score") - F.min("score")).alias("range"), F.avg("score").alias("mean")).withColumns({"stable": F.col("range") < tolerance, "predicted": (F.col("mean") >= 0.5).cast("int")})


def totals(df: DataFrame, threshold: float, by: str) -> DataFrame:
    """Confusion of each value of ``by`` and, under null, of all together."""
    hit, is_ = F.col("score") >= threshold, F.col("label") == 1
    return df.rollup(by).agg(F.count_if(hit & is_).alias("tp"), F.count_if(hit & ~is_).alias("fp"), F.count_if(~hit & is_).alias("fn"), F.count_if(~hit & ~is_).alias("tn"))
