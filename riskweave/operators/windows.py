"""Token windows for classifiers, pooling of their scores, and toxicity decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CLS, SEP, PAD = 0, 2, 1
TOXIC_LENGTH, TOXIC_PAD, TOXIC_CLS, TOXIC_SEP = 512, 0, 101, 102
SHORT, LENGTH, STRIDE, MOST = 512, 2048, 1024, 4
TOXIC_LABELS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")
TOXIC_SEVERITY = {"toxic": "medium", "severe_toxic": "critical", "obscene": "medium", "threat": "high", "insult": "medium", "identity_hate": "high"}
LONGEST_PREFIX = 20
_SPLIT = r"(\s+|[.,!?;:'\"()\[\]{}<>])"


def _window(ids: Column, length: int) -> Column:
    """[CLS] + at most length - 2 ids + [SEP], padded, with its mask."""
    body = F.concat(F.array(F.lit(CLS)), F.slice(ids, 1, length - 2), F.array(F.lit(SEP)))
    pad = F.lit(length) - F.size(body)
    return F.struct(F.concat(body, F.array_repeat(F.lit(PAD), pad)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), F.size(body)), F.array_repeat(F.lit(0), pad)).alias("attention_mask"))


def window_starts(n: Column) -> Column:
    """Starts of the windows of ``n`` ids: four at most, and a fifth, right-aligned, where ids are left."""
    count = F.least(F.lit(MOST), F.ceil((n - LENGTH) / STRIDE).cast("int") + 1)
    starts = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: k * STRIDE)
    many = F.when(n > LENGTH + (MOST - 2) * STRIDE, F.array_append(starts, n - LENGTH)).otherwise(starts)
    return F.when(n <= LENGTH, F.array(F.lit(0))).otherwise(many)


def extract_windows(df: DataFrame, ids_col: str = "ids", out_col: str = "windows") -> DataFrame:
    """``df`` and an array of (input_ids, attention_mask). Up to 512 ids make one short window; a null array none."""
    ids, n = F.col(ids_col), F.size(ids_col)
    long_ = F.transform(window_starts(n), lambda s: _window(F.slice(ids, s + 1, LENGTH), LENGTH))
    return df.withColumn(out_col, F.when(ids.isNull(), None).when(n <= SHORT, F.array(_window(ids, SHORT))).otherwise(long_))


def _masked(ids: Column, pad: Column) -> Column:
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), pad))
    return F.struct(F.concat(ids, F.array_repeat(F.lit(0), pad)).alias("input_ids"), mask.alias("attention_mask"))


def benchmark_windows(df: DataFrame, ids_col: str = "ids", out_col: str = "windows", length: int = LENGTH, stride: int = STRIDE, most: int = MOST) -> DataFrame:
    """Windows of the benchmark: the ids as they are, without special ids or padding. Up to ``length`` ids make one window;
    else ``most`` at most, the last one right-aligned if it would be short, so of a long text the ids behind are not read."""
    ids, n = F.col(ids_col), F.size(ids_col)
    count = F.least(F.lit(most), F.ceil((n - length) / stride).cast("int") + 1)
    starts = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.least(k * stride, n - length))
    many = F.transform(starts, lambda s: _masked(F.slice(ids, s + 1, length), F.lit(0)))
    return df.withColumn(out_col, F.when(ids.isNull(), None).when(n <= length, F.array(_masked(ids, F.lit(0)))).otherwise(many))


def sizing_windows(df: DataFrame, ids_col: str = "ids", out_col: str = "windows", length: int = LENGTH, stride: int = STRIDE, most: int = MOST) -> DataFrame:
    """Windows of the sizing experiment: ``length`` ids each between special ids, one at each stride as long as there are ids,
    ``most`` at most; all are filled with zeros to the size of the first. Up to ``length`` ids make one window."""
    ids, n = F.col(ids_col), F.size(ids_col)
    framed = lambda x: F.concat(F.array(F.lit(CLS)), x, F.array(F.lit(SEP)))
    starts = F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(stride)), 1, most)
    chunk = lambda s: F.slice(ids, s + 1, length)
    many = F.transform(starts, lambda s: _masked(framed(chunk(s)), F.lit(length) - F.size(chunk(s))))
    return df.withColumn(out_col, F.when(ids.isNull(), None).when(n <= length, F.array(_masked(framed(ids), F.lit(0)))).otherwise(many))


def toxicity_input(df: DataFrame, ids_col: str = "ids", out_col: str = "window", length: int = TOXIC_LENGTH) -> DataFrame:
    """The toxicity model's input: special ids around as many ids as fit, filled to ``length``; of no ids all filling."""
    ids = F.slice(ids_col, 1, length - 2)
    body = F.when(F.coalesce(F.size(ids_col), F.lit(0)) <= 0, F.array().cast("array<int>")).otherwise(F.concat(F.array(F.lit(TOXIC_CLS)), ids, F.array(F.lit(TOXIC_SEP))))
    pad = F.lit(length) - F.size(body)
    window = F.struct(F.concat(body, F.array_repeat(F.lit(TOXIC_PAD), pad)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), F.size(body)), F.array_repeat(F.lit(0), pad)).alias("attention_mask"))
    return df.withColumn(out_col, window)


def flag_counts(df: DataFrame, col: str = "toxicity") -> DataFrame:
    """(label, flagged, n): in how many rows each category was flagged, of how many were scored."""
    each = df.select(F.explode(f"{col}.categories").alias("c"))
    return each.groupBy(F.col("c.label").alias("label")).agg(F.count_if("c.flagged").alias("flagged"), F.count("*").alias("n"))


def pooled(scores: Column, how: str = "max") -> Column:
    return F.array_max(scores) if how == "max" else F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)


def tokenize(df: DataFrame, vocab: dict[str, int], *, text_col: str = "text", out_col: str = "ids", unknown: int | None = None) -> DataFrame:
    """Greedy ids: lower case, single blanks, words and marks apart; a word in the vocabulary, else its longest known
    prefix of at most 20 characters again and again, else ``unknown`` a character (nothing if there is none).

    The vocabulary is a bounded parameter. Null texts have no ids.
    """
    import re

    cut = re.compile(_SPLIT)

    def word(w: str) -> list[int]:
        if w in vocab:
            return [vocab[w]]
        out, k = [], 0
        while k < len(w):
            for e in range(min(len(w), k + LONGEST_PREFIX), k, -1):
                if w[k:e] in vocab:
                    out.append(vocab[w[k:e]])
                    k = e
                    break
            else:
                out += [unknown] if unknown else []
                k += 1
        return out

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[t for w in cut.split(" ".join(x.lower().split())) if w.strip() for t in word(w)] if isinstance(x, str) else None for x in batch[text_col]]
            yield batch.assign(**{out_col: found})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out_col}` array<int>"])
    return df.mapInPandas(rows, schema)


def score_windows(df: DataFrame, scorer, *, windows_col: str = "windows", out_col: str = "scores") -> DataFrame:
    """Scores of every window by ``scorer(list of windows) -> list of floats``, a batch of rows at a time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flat = [w for ws in batch[windows_col] for w in (ws if ws is not None else [])]
            scores = iter(scorer(flat) if flat else [])
            yield batch.assign(**{out_col: [None if ws is None else [float(next(scores)) for _ in ws] for ws in batch[windows_col]]})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out_col}` array<double>"])
    return df.mapInPandas(rows, schema)


def toxicity(logits: Column, threshold: float = 0.5) -> Column:
    """Struct of six categories (label, probability to four digits, flagged, severity), whether any is flagged, and whether
    the general label is. Null for other than six logits."""
    from ..functions import half_up4, sigmoid

    probability = lambda k: sigmoid(F.get(logits, F.lit(k)))
    each = F.array(*(F.struct(F.lit(name).alias("label"), half_up4(probability(k)).alias("probability"), (probability(k) >= threshold).alias("flagged"), F.lit(TOXIC_SEVERITY[name]).alias("severity")) for k, name in enumerate(TOXIC_LABELS)))
    return F.when(F.size(logits) == len(TOXIC_LABELS), F.struct(each.alias("categories"), F.exists(each, lambda c: c["flagged"]).alias("any_flagged"), (probability(0) >= threshold).alias("any_toxic")))
