"""Sources and sinks of labelled records, checksums, batches and model bundles."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "text string, prompt string, input string, label string, expected_label string, source string, license string, id string"
BAD = "_bad"


def read_jsonl(spark: SparkSession, path: str, mode: str = "tolerant", labels: tuple[int, ...] | None = None) -> DataFrame:
    """(text, label, source, license, source_id) of JSON lines.

    ``tolerant``: blank and broken lines are dropped; ``strict``: a broken line fails the job; ``benchmark``: tolerant,
    and texts of fewer than five characters (ends trimmed) go. The text is the first of text, prompt and input that is
    not empty; the label is ``label`` or, where that is null, ``expected_label``. Rows without either are dropped.
    """
    reader = spark.read.schema(f"{RECORD}, {BAD} string").option("columnNameOfCorruptRecord", BAD)
    rows = reader.option("mode", "FAILFAST" if mode == "strict" else "PERMISSIVE").json(path)
    rows = rows.withColumn("_file", F.input_file_name()).filter(F.col(BAD).isNull()) if mode != "strict" else rows.withColumn("_file", F.input_file_name())
    return normalised(rows, stem=mode == "strict", least=5 if mode == "benchmark" else 1, labels=labels)


def normalised(rows: DataFrame, stem: bool = False, least: int = 1, labels: tuple[int, ...] | None = None) -> DataFrame:
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    file = F.col("_file") if "_file" in rows.columns else F.lit("")
    name = F.regexp_extract(file, r"([^/]*?)(?:\.jsonl?)?$", 1)
    label = F.expr("try_cast(coalesce(label, expected_label) as int)")
    out = rows.select(
        F.coalesce(filled("text"), filled("prompt"), filled("input")).alias("text"), label.alias("label"), F.coalesce(filled("source"), name if stem else F.lit("unknown")).alias("source"),
        F.coalesce(filled("license"), F.lit("unknown")).alias("license"), F.coalesce(filled("id"), F.concat(name, F.lit(":"), F.xxhash64("text", "prompt", "input").cast("string"))).alias("source_id"),
    )
    out = out.filter(F.col("label").isNotNull() & (F.length(F.trim("text") if least > 1 else F.col("text")) >= least))
    return out.filter(F.col("label").isin(*labels)) if labels else out


def batches(df: DataFrame, size: int) -> DataFrame:
    """Adds ``batch``, the number of its batch of ``size`` rows within its partition; the last may be smaller."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for part in parts:
            yield part.assign(batch=[(n + k) // size for k in range(len(part))])
            n += len(part)

    return df.mapInPandas(rows, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "batch long"]))


def write_split(df: DataFrame, path: str) -> None:
    """JSON lines in one folder for each label."""
    df.write.mode("overwrite").partitionBy("label").json(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def lockfile(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sorted distinct lines: those of the fresh names replaced. (name, sha256) in and out."""
    return old.join(fresh.select("name"), "name", "left_anti").select("name", "sha256").unionByName(fresh.select("name", "sha256")).distinct().orderBy("name", "sha256")


BUNDLE_FILE = "path string, version string, license string, signing_public_key string, signing_pub_key_b64 string, payload_ok boolean, file string, kind string, size long, sha256 string, ok boolean"


def read_bundles(spark: SparkSession, path: str, magic: str | None = None) -> DataFrame:
    """Bundles: anything, a JSON header that lists files (name, size, sha256, offset), their bytes, a 64-byte signature.

    A row for each file: whether the payload and the file have the checksums that the header says, the file's kind (json,
    binary or text, by its name), and the header's public key in either form (see ``registry.signing_keys``). The header is
    the first JSON object with a list of ``files`` and, if a ``magic`` is asked for, that value under its name; a bundle
    without one gives a row without a file. Signatures are not verified here: that needs a library for Ed25519.
    """
    import hashlib

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for p, raw in zip(part["path"], map(bytes, part["content"]), strict=True):
                header, end = find_header(raw, magic)
                if header is None:
                    out.append((p, *[None] * 10))
                    continue
                size, digest = header.get("total_payload_size"), header.get("payload_sha256")
                whole = None if digest is None else hashlib.sha256(raw[end : end + size] if size is not None else raw[end:-64]).hexdigest() == digest
                about = (p, header.get("bundle_version"), header.get("license"), header.get("signing_public_key"), header.get("signing_pub_key_b64"), whole)
                for f in header["files"]:
                    body = raw[end + f["offset"] : end + f["offset"] + f["size"]]
                    kind = "json" if f["name"].endswith(".json") else "binary" if f["name"].endswith((".onnx", ".bin")) else "text"
                    out.append((*about, f["name"], kind, f["size"], f["sha256"], hashlib.sha256(body).hexdigest() == f["sha256"]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in BUNDLE_FILE.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, BUNDLE_FILE)


def find_header(raw: bytes, magic: str | None = None) -> tuple[dict | None, int]:
    """The header of a bundle and where it ends."""
    last = len(raw) if magic is None else raw.find(magic.encode())
    start = raw.find(b"{")
    while 0 <= start < last:
        try:
            end = header_end(raw, start)
            header = json.loads(raw[start:end])
            if isinstance(header.get("files"), list) and (magic is None or header.get("magic") == magic):
                return header, end
        except ValueError:  # a brace that begins no JSON
            pass
        start = raw.find(b"{", start + 1)
    return None, 0


def header_end(raw: bytes, start: int) -> int:
    """Where the JSON object that begins at ``start`` ends; braces in strings do not count."""
    depth, quoted, k = 0, False, start
    while k < len(raw):
        c = raw[k]
        if quoted:
            if c == 0x5C:
                k += 1
            elif c == 0x22:
                quoted = False
        elif c == 0x22:
            quoted = True
        elif c == 0x7B:
            depth += 1
        elif c == 0x7D:
            depth -= 1
            if not depth:
                return k + 1
        k += 1
    raise ValueError("the header does not end")


def threat_intel(findings: DataFrame, intel: DataFrame, key: str = "domain_hash") -> DataFrame:
    """Adds has_iocs, ioc_count and top_categories by host; hosts that the table does not know have none."""
    known = intel.select(key, "ioc_count", *(["top_categories"] if "top_categories" in intel.columns else []))
    out = findings.join(known, key, "left").withColumn("ioc_count", F.coalesce("ioc_count", F.lit(0))).withColumn("has_iocs", F.col("ioc_count") > 0)
    none = F.array().cast("array<string>")
    return out.withColumn("top_categories", F.coalesce("top_categories", none) if "top_categories" in known.columns else none)


def write_lockfile(old: DataFrame, fresh: DataFrame, path: str) -> None:
    """The lockfile's lines (checksum, two blanks, name) as one sorted text file; the old one must not lie at ``path``."""
    lines = lockfile(old, fresh).select(F.concat_ws("  ", "sha256", "name").alias("line"))
    lines.coalesce(1).sortWithinPartitions("line").write.mode("overwrite").text(path)


def read_lockfile(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of a lockfile; lines of another form are left out."""
    parts = lambda k: F.regexp_extract("value", r"^([0-9a-f]{64})[ ]{1,2}[*]?(.+)$", k)
    return spark.read.text(path).select(parts(2).alias("name"), parts(1).alias("sha256")).filter("sha256 <> ''")


def message_allowed(kind: Column, sender: Column, own: str, kinds: tuple[str, ...]) -> Column:
    """Messages of a known kind from ourselves."""
    return F.coalesce(kind.isin(*kinds) & (sender == own), F.lit(False))
