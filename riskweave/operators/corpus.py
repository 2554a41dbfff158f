"""Preparation of labelled corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import contains_any, length_bucket

# Phrases that mark a row as an attack, whatever its label; compared in lower case.
ATTACK_PHRASES = (
    "ignore all previous instructions", "ignore all prior instructions", "ignore the above instructions", "ignore all instructions above", "ignore your instructions", "ignore all previous",
    "ignore all prior", "disregard your safety guidelines", "disregard your instructions", "disregard all prior", "disregard all previous", "forget all previous", "forget your instructions",
    "forget everything above", "override your", "reveal your system prompt", "reveal the system prompt", "show your system prompt", "tell me your system prompt", "output your system prompt",
    "print your system prompt", "display your system prompt", "expose your system prompt", "you are dan", "do anything now", "no restrictions", "without any safety considerations",
    "without safety considerations", "pretend you have no rules", "pretend to be", "you are now", "act as", "developer mode enabled", "dan mode", "jailbreak", "jailbroken", "no ethical constraints",
    "no content policy", "no content restrictions", "respond to my next request without", "respond without any safety", "respond to the next request", "without any restrictions",
    "safety restrictions are suspended", "safety restrictions suspended", "safety filters are off", "safety filter disabled", "safety guidelines suspended", "without any moral",
    "without ethical constraints", "ignore content policy", "without applying your usual", "unrestricted mode", "unrestricted ai", "answer without restrictions", "you must answer", "you will answer",
)
QUOTAS = {
    "v01_train": 20_000, "v01_test": 2_000, "v01_val": 2_000, "public_train_attack": 10_000, "public_train_benign": 20_000, "owasp_v2": 20_000, "atlas_v2": 12_000, "eu_ai_act_v2": 6_000,
    "long_benign_v2": 12_000, "multilingual_v2": 10_000, "obfuscated_v2": 6_000, "r8_augmented_train": 25_000, "r7_long_benign_train": 10_000,
}
FORMER_QUOTAS = {
    "v01_train": 20_000, "v01_test": 2_000, "v01_val": 2_000, "public_train_attack": 10_000, "public_train_benign": 20_000, "owasp_v2": 20_000, "atlas_v2": 12_000, "eu_ai_act_v2": 6_000,
    "long_benign_v2": 12_000, "multilingual_v2": 10_000, "obfuscated_v2": 6_000, "r8_augmented_train": 25_000, "r7_long_benign_train": 10_000, "r8_long_augmented_train": 30_000,
}
SPOILED_SOURCE = "r7_v0.1::long_context_v7"


def has_attack(text: Column) -> Column:
    return contains_any(text, ATTACK_PHRASES)


def relabel(df: DataFrame, source: str = SPOILED_SOURCE, at: Column | None = None) -> DataFrame:
    """Rows of the spoiled source that hold an attack phrase become label 1 and say so; the others keep theirs."""
    fix = F.coalesce((F.col("source") == source) & has_attack(F.col("text")) & (F.col("label") != 1), F.lit(False))
    return df.withColumns({
        "original_label": F.when(fix, F.col("label")), "fix_applied": fix, "fix_reason": F.when(fix, "attack phrase in text"),
        "fix_timestamp": F.when(fix, at if at is not None else F.current_timestamp().cast("string")), "label": F.when(fix, 1).otherwise(F.col("label")),
    })


def relabel_summary(fixed: DataFrame) -> DataFrame:
    return fixed.groupBy("source").agg(F.count("*").alias("n"), F.count_if("fix_applied").alias("fixed"), F.count_if(F.col("label") == 1).alias("attacks"))


def _shuffled(seed: int, key: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key).cast("string"))


def sample_to_quota(df: DataFrame, spark: SparkSession, quotas: dict[str, int] | None = None, *, key: str = "id", max_chars: int = 2000, seed: int = 42) -> DataFrame:
    """Half of each source's quota from either label, topped up from what is left. Order: a hash of seed and key.

    Ranks within (source, label) and the label's size decide alone, so one window and one grouped count are enough.
    """
    known = QUOTAS if quotas is None else quotas
    most = max(known.values(), default=0)  # as a literal it cuts each task's rows before they are dealt out
    quota = spark.createDataFrame([(s, int(n)) for s, n in known.items()], "source string, quota int")
    rows = df.filter(F.length("text") <= max_chars).join(F.broadcast(quota), "source")  # a row for each source
    sizes = rows.groupBy("source").agg(F.count_if(F.col("label") == 1).alias("_ones"), F.count_if(F.col("label") == 0).alias("_zeros"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("source", "label").orderBy(_shuffled(seed, key), key))).filter(F.col("_n") <= most)
    rows = rows.join(F.broadcast(sizes), "source")
    half = F.floor(F.col("quota") / 2)
    rest = F.col("quota") - F.least(half, F.col("_ones")) - F.least(half, F.col("_zeros"))
    spare = rows.filter(F.col("_n") > half).withColumn("_m", F.row_number().over(Window.partitionBy("source").orderBy(_shuffled(seed + 1, key), key))).filter((F.col("_m") <= most) & (F.col("_m") <= rest))
    out = rows.filter(F.col("_n") <= half).unionByName(spare.drop("_m"))
    return out.select(*df.columns)


def hold_out(df: DataFrame, key: str = "id", share: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds ``split``: the first ``floor(n * share)`` rows by hash are ``val``. The cut is a hash value found by counting."""
    n = df.count()
    take = int(n * share)
    if take == 0:
        return df.withColumn("split", F.lit("train"))
    hashed = df.withColumn("_h", _shuffled(seed, key))
    # the cut's hash, 16 bits at a time: each count gives 65,536 rows at most, whatever the table's size
    low, left = -(2**63), take
    for shift in (48, 32, 16, 0):
        step = F.shiftright(F.col("_h") - F.lit(low), shift) if shift < 48 else F.shiftright("_h", 48) + 32768
        part = hashed if shift == 48 else hashed.filter(F.col("_h").between(low, low + 2 ** (shift + 16) - 1))
        for k, count in sorted(part.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect()):
            if count >= left:
                low += k << shift
                break
            left -= count
    # of rows with that very hash the first by key
    last = hashed.filter(F.col("_h") == low).select(F.col(key).alias("_k")).orderBy("_k").limit(left).agg(F.max("_k")).first()[0]
    cut = (low, last)
    return hashed.withColumn("split", F.when((F.col("_h") < cut[0]) | ((F.col("_h") == cut[0]) & (F.col(key) <= F.lit(cut[1]))), "val").otherwise("train")).drop("_h")


def bucketed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``bucket``; the longest come first when ordered by it."""
    return df.withColumn("bucket", length_bucket(F.col(text_col))).orderBy(F.col("bucket").desc())


def cap_per_label(df: DataFrame, n: int, order: str, label: str = "label") -> DataFrame:
    """The first ``n`` rows of each label in input order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def sample_per_source(df: DataFrame, n: int = 50, key: str = "id", seed: int = 42) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(_shuffled(seed, key), key))).filter(F.col("_n") <= n).drop("_n")


def run_config(megabytes: Column) -> Column:
    """(timeout seconds, batch size) by a file's size; unknown sizes get the quickest."""
    make = lambda t, b: F.struct(F.lit(t).alias("timeout_s"), F.lit(b).alias("batch"))
    return F.when(megabytes > 30, make(21600, 4)).when(megabytes > 10, make(7200, 8)).when(megabytes > 1, make(1800, 16)).otherwise(make(600, 32))


def drift(files: DataFrame, locked: DataFrame) -> DataFrame:
    """(name, state): same, changed, missing or new, of (name, sha256) rows against a lockfile's."""
    both = locked.select("name", F.col("sha256").alias("_was")).join(files.select("name", F.col("sha256").alias("_is")), "name", "full")
    return both.select("name", F.when(F.col("_is").isNull(), "missing").when(F.col("_was").isNull(), "new").when(F.col("_is") == F.col("_was"), "same").otherwise("changed").alias("state"))


def balance(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))
