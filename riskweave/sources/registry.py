"""Registries of model bundles, and what is joined with them: facets, signing keys, configurations and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BYTES = 32
ENSEMBLE = {"model_names": ("lr", "mlp_a", "mlp_b", "mlp_c", "mlp_d"), "threshold": 0.85}  # fixed values: without a configuration


def facet_bundles(rows: DataFrame, registry: DataFrame, facet: str = "facet") -> DataFrame:
    """Rows with the registry's bundle (facet, bundle, size_bytes) of their facet; null where it has none."""
    known = registry.select(F.col("facet").alias("_facet"), "bundle", "size_bytes")
    return rows.join(known, rows[facet] == known["_facet"], "left").drop("_facet")


def total_size(registry: DataFrame) -> DataFrame:
    return registry.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def key_hex(hex_col: Column, b64_col: Column) -> Column:
    """A public key of 32 bytes in lower-case hex, from a field in hex or else one in base64; null if neither has one."""
    raw = F.try_to_binary(b64_col, F.lit("base64"))
    return F.when(hex_col.rlike(rf"^[0-9a-fA-F]{{{2 * KEY_BYTES}}}\z"), F.lower(hex_col)).when(F.length(raw) == KEY_BYTES, F.lower(F.hex(raw)))


def signing_keys(headers: DataFrame, ring: DataFrame) -> DataFrame:
    """Headers (signing_public_key, signing_pub_key_b64) with the ``key_id`` of the ring (key_id, b64), null if not in it."""
    known = ring.select(F.col("key_id"), key_hex(F.lit(None).cast("string"), F.col("b64")).alias("_hex")).filter("_hex is not null")
    return headers.withColumn("_hex", key_hex(F.col("signing_public_key"), F.col("signing_pub_key_b64"))).join(known, "_hex", "left").drop("_hex")


def model_files(configs: DataFrame, files: DataFrame) -> DataFrame:
    """(bundle, model, type, file, there) of the files that each model of a bundle needs.

    ``configs``: (bundle, model, type, n_layers); ``files``: (bundle, name). Every model has a configuration, vocabulary
    and idf; ``lr`` has coefficients, ``mlp`` weights and biases of each layer. An unknown type needs ``None``.
    """
    part = lambda *names: F.array(*(F.concat(F.col("model"), F.lit(f"_{n}.json")) for n in names))
    layer = lambda kind: F.transform(F.when(F.col("n_layers") > 0, F.sequence(F.lit(0), F.col("n_layers") - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.concat(F.col("model"), F.lit(f"_{kind}_"), j.cast("string"), F.lit(".json")))
    own = F.when(F.col("type") == "lr", part("coefficients")).when(F.col("type") == "mlp", F.concat(layer("weights"), layer("biases"))).otherwise(F.array(F.lit(None).cast("string")))
    wanted = configs.select("bundle", "model", "type", F.explode(F.concat(part("config", "vocabulary", "idf"), own)).alias("file"))
    known = files.select("bundle", F.col("name").alias("file"), F.lit(True).alias("there"))
    return wanted.join(known, ["bundle", "file"], "left").select("bundle", "model", "type", "file", F.coalesce("there", F.lit(False)).alias("there"))


def complete_models(needed: DataFrame, strict: bool = False) -> DataFrame:
    """(bundle, model, complete, missing); ``strict``: a missing file fails the job."""
    out = needed.groupBy("bundle", "model").agg(F.bool_and("there").alias("complete"), F.array_sort(F.collect_set(F.when(~F.col("there"), F.col("file")))).alias("missing"))
    if strict:
        out = out.withColumn("complete", F.when(F.col("complete"), True).otherwise(F.raise_error(F.concat(F.lit("missing files of model "), F.col("model"))).cast("boolean")))
    return out


def tfidf_score(words: Column, weights: Column, bias: Column) -> Column:
    """Logistic score of a text's ``words`` under a map of word to idf times weight: the linear model of the legacy ensemble."""
    from ..functions import sigmoid

    total = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(weights, w), F.lit(0.0)))
    return sigmoid(bias + total / F.greatest(F.size(words), F.lit(1)))


def ensemble(scores: Column, threshold: float = ENSEMBLE["threshold"]) -> Column:
    """Struct (score: the mean of the models' scores, attack: whether it reaches the threshold); null without scores."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.size(scores)
    return F.when(F.size(scores) > 0, F.struct(mean.alias("score"), (mean >= threshold).alias("attack")))
