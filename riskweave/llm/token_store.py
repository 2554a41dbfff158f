"""Token ids in raw binary shards, found by key through minimal perfect hash indexes.

Layout of a store (a folder):

* ``shard-NNNNN-A.bin``: the ids of its documents, little-endian unsigned (16 or 32 bit), one after the other;
* ``shard-NNNNN-A.idx``: little-endian 64-bit offsets of its documents, in ids, one more than documents;
* ``keys-NNNNN.mph``: of the keys that hash there: a minimal perfect hash (levels of bit arrays; a key's slot is the rank
  of the first bit that it alone had set) and per slot a 32-bit fingerprint, the shard, the row in it and how many rows;
* ``store.json``: what else is needed to open the store: shards and their attempts, ids and rows in each, the null key's rows.

``A`` is the attempt of the task that wrote a shard. Two attempts never share a file, and the manifest names those whose
rows were committed, so a late or repeated task cannot change a store. Key indexes do not depend on the order of rows.

A key costs one hash to pick the index, a few bit tests, one comparison of fingerprints and two positional reads. Rows
lie in ascending order of key, null first, then of the text's hash, so equal keys stand together; those of one key may go
on in the next shard, so a key that a third of all rows share is no larger task than others.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, table
from .files import Reader, opened, whole_file

MEMO_WORDS = 1_000_000
ROWS_AT_ONCE = 1024  # of one key
GAMMA = 2
LEVELS = 40
# a letter (ASCII or Latin-1), marks, white space: the marks are a word of their own
_MARKS = re.compile(rb"([a-z]|\xc3[\xa0-\xb6\xb8-\xbf])([.,!?;:*&#%$]+)([ \n])")
MAGIC, MANIFEST = b"MPHIDX01", "store.json"


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """A bijection of the distinct ``keys`` it was built from to 0 .. n-1. Other keys get -1 or any slot."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        sums = [np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in levels]
        bases = np.concatenate(([0], np.cumsum([s[-1] for s in sums]))) if levels else [0]
        self.ranks = [s + b for s, b in zip(sums, bases, strict=False)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(8, GAMMA * len(keys))
            at = (mix(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for seed, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (mix(keys[open_], seed) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(x)) + np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes, at: int) -> tuple[PerfectHash, int]:
        (n,) = struct.unpack_from("<I", raw, at)
        at, levels = at + 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", raw, at)
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at + 8), count=size).astype(bool))
            at += 8 + width
        return cls(levels), at


class KeyIndex:
    FIELDS = (("print", "<u4"), ("shard", "<u4"), ("row", "<u8"), ("rows", "<u4"))

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a key index")
        (n,) = struct.unpack_from("<Q", raw, len(MAGIC))
        self.hash, at = PerfectHash.load(raw, len(MAGIC) + 8)
        for name, kind in self.FIELDS:
            setattr(self, name, np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize

    @classmethod
    def dump(cls, keys: np.ndarray, shard: np.ndarray, row: np.ndarray, rows: np.ndarray) -> bytes:
        perfect = PerfectHash.build(keys)
        slots = perfect.slots(keys)
        out = MAGIC + struct.pack("<Q", len(keys)) + perfect.dump()
        for (_, kind), values in zip(cls.FIELDS, (fingerprints(keys), shard, row, rows), strict=True):
            placed = np.empty(len(keys), kind)
            placed[slots] = values
            out += placed.tobytes()
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """(found, shard, row, rows) of each key."""
        if not len(self.print):
            none = np.zeros(len(keys), np.int64)
            return none.astype(bool), none, none, none
        slots = self.hash.slots(keys)
        found = (slots >= 0) & (self.print[slots] == fingerprints(keys))
        return found, self.shard[slots], self.row[slots], self.rows[slots]


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 9999) >> np.uint64(32)).astype("<u4")


def index_of(keys: np.ndarray, indexes: int) -> np.ndarray:
    return (mix(keys, 7777) % np.uint64(indexes)).astype(np.int32)


# How a tokenizer must cut words for its texts to be encoded a word at a time.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})


def cuts_words(tokenizer) -> bool:
    """Whether the tokenizer lower-cases, drops white space before it cuts, and cuts letters from digits and marks."""
    config = json.loads(tokenizer.to_str())
    steps, cutters = ((x or {}).get(k) or ([x] if x else []) for x, k in ((config["normalizer"], "normalizers"), (config["pre_tokenizer"], "pretokenizers")))
    splits = [x for x in cutters if x["type"] != "ByteLevel" or x.get("use_regex") or x.get("add_prefix_space")]
    added = all(t.special and not (t.lstrip or t.rstrip or t.single_word) and t.content.startswith("<|") for t in tokenizer.get_added_tokens_decoder().values())
    return added and {"type": "Lowercase"} in steps and all(x in WORD_NORMALIZERS for x in steps) and splits == [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}]


class WordEncoder:
    """Ids by the tokenizers library, a word between ASCII white space at a time where ``cuts_words``, else a text at a time.

    Of a tokenizer that cuts words a text's ids are its words' ids in order, a word's case does not matter, and marks behind
    a letter are a word of their own. (Texts with ``<|`` stay as they are: they may hold special tokens.) New words go to the
    library many at a time, as one text with a special token between them. Remembered words are bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), {}
        self.dtype = id_type(self.tokenizer)
        self.by_word = cuts_words(self.tokenizer)
        special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark = next(iter(special.items()), None) if self.by_word else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _words(raw: bytes) -> list[bytes]:
        return (raw if b"<|" in raw else _MARKS.sub(rb"\1 \2\3", raw.lower())).split()

    def _learn(self, words: list[bytes]) -> None:
        own = words if self.mark is None else [w for w in words if b"<|" in w]
        self.memo.update(zip(own, self._ids([w.decode("utf-8", "replace") for w in own]), strict=True))
        if self.mark is None:
            return
        mark, mark_id = self.mark
        plain = [w for w in words if b"<|" not in w] if own else words
        parts = [plain[k : k + 1000] for k in range(0, len(plain), 1000)]
        found = self.tokenizer.encode_batch_fast([mark.join(b"\n".join(p).decode("utf-8", "replace").split("\n")) for p in parts], add_special_tokens=False)
        for part, one in zip(parts, found, strict=True):
            ids = np.array(one.ids, np.int64)
            kept = ids != mark_id
            ends = np.cumsum(kept)[~kept]
            at = (np.concatenate(([0], ends, [kept.sum()])) * self.dtype.itemsize).tolist()
            raw = ids[kept].astype(self.dtype).tobytes()
            self.memo.update(zip(part, (raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as ``dtype``."""
        if not self.by_word:
            return self._ids([t.decode("utf-8", "replace") for t in texts])
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out: list[bytes | None] = []
        new: dict[int, list[bytes]] = {}
        for raw in texts:
            words = self._words(raw)
            try:
                out.append(b"".join(map(memo.__getitem__, words)))
            except KeyError:
                new[len(out)] = words
                out.append(None)
        if new:
            self._learn(list(set().union(*new.values()).difference(memo)))
            for k, words in new.items():
                out[k] = b"".join(map(memo.__getitem__, words))
        return out


def id_type(tokenizer) -> np.dtype:
    return np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TokenStore:
    """``TokenStore.write(...)`` makes a store, ``TokenStore(spark, folder)`` opens one; ``lookup`` and ``read`` find the keys
    of a DataFrame in it, ``get`` one key."""

    def __init__(self, spark: SparkSession, folder: str):
        system, root = opened(folder)
        with system.open_input_file(f"{root}/{MANIFEST}") as f:
            known = json.loads(f.read())
        self.spark, self.folder = spark, folder
        self.dtype, self.indexes, self.null = known["dtype"], known["indexes"], known["null"]
        shards = sorted(known["shards"])  # without those that have no rows
        self.names = [f"shard-{n:05d}-{attempt}" for n, attempt, _, _ in shards]
        self.starts, self.ranks = (np.concatenate(([0], np.cumsum([x[k] for x in shards], dtype=np.int64))) for k in (2, 3))
        self.shards = np.array([x[0] for x in shards], np.int64)

    @classmethod
    def write(cls, spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, folder: str | None = None, shards: int | None = None) -> TokenStore:
        """Encode every text, append ``end_id``, write in ascending order of key (nulls first).

        A null or empty text is its end id alone. Rows that repeat a key are all kept, side by side. An empty
        table gives a store without keys. Extra columns are not stored, whatever their names. Texts of any length are
        encoded whole, 512 at a time in a task's memory. A store has ``shards`` shards and as many key indexes, by default
        one for each shuffle partition.
        """
        path = tokenizer or default_tokenizer()
        folder = folder or scratch_path(spark, "tokens")
        shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        dtype = _dtype(path)

        def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context, enc, offset, row = TaskContext.get(), encoder(path), 0, 0
            number, attempt = context.partitionId(), context.taskAttemptId()
            tail, offsets = np.array([end_id], dtype).tobytes(), []
            name = f"shard-{number:05d}-{attempt}"
            with whole_file(folder, f"{name}.bin") as out:
                for batch in batches:
                    for k in range(0, len(batch), 512):
                        part = batch.slice(k, 512)
                        ids = enc.encode([t or b"" for t in part.column(1).to_pylist()])
                        n = np.fromiter(map(len, ids), np.int64, len(ids)) // dtype.itemsize + 1
                        out.write(tail.join([*ids, b""]))
                        offsets.append(offset + np.cumsum(n) - n)
                        same = [pa.array(np.full(len(n), x)) for x in (number, attempt)]
                        yield pa.RecordBatch.from_arrays([part.column(0), *same, pa.array(row + np.arange(len(n))), pa.array(n)], names=["key", "shard", "attempt", "row", "n_tokens"])
                        offset, row = offset + int(n.sum()), row + len(n)
            with whole_file(folder, f"{name}.idx") as out:
                out.write(np.concatenate([*offsets, [offset]]).astype("<u8").tobytes())

        ordered = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").cast("binary").alias("text"))
        ordered = ordered.withColumn("tie", F.xxhash64("text"))
        ordered = ordered.repartitionByRange(shards, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
        rows = materialize(spark, ordered.mapInArrow(shard, "key long, shard long, attempt long, row long, n_tokens long"), "token-rows")
        totals = rows.groupBy("shard", "attempt").agg(F.sum("n_tokens"), F.count("*")).collect()  # a row for each shard
        first, n = rows.filter("key is null").agg(F.min(F.struct("shard", "row")), F.count("*")).first()
        places = rows.filter("key is not null").groupBy("key").agg(F.min(F.struct("shard", "row")).alias("at"), F.count("*").alias("rows"))
        places = places.select("key", F.col("at.shard").alias("shard"), F.col("at.row").alias("row"), "rows")

        def index(group: pd.DataFrame) -> pd.DataFrame:
            number = int(group["part"].iloc[0])
            with whole_file(folder, f"keys-{number:05d}.mph") as out:
                out.write(KeyIndex.dump(*(group[c].to_numpy() for c in ("key", "shard", "row", "rows"))))
            return pd.DataFrame({"part": [number], "keys": [len(group)]})

        part = cls._part(shards)
        places.withColumn("part", part("key")).groupBy("part").applyInPandas(index, "part int, keys long").agg(F.sum("keys")).collect()
        with whole_file(folder, MANIFEST) as out:
            out.write(json.dumps({"dtype": dtype.str, "indexes": shards, "shards": sorted(map(list, totals)), "null": [*first, n] if n else None}).encode())
        return cls(spark, folder)

    @staticmethod
    def _part(indexes: int):
        @F.pandas_udf("int")
        def part(keys: pd.Series) -> pd.Series:
            return pd.Series(index_of(keys.to_numpy(np.int64), indexes))

        return part

    def lookup(self, keys: DataFrame, key_col: str = "key") -> DataFrame:
        """(key, shard, row, rows) of each distinct key that the store has, null included."""
        folder = self.folder

        def find(group: pd.DataFrame) -> pd.DataFrame:
            system, root = opened(folder)
            name = f"{root}/keys-{int(group['part'].iloc[0]):05d}.mph"
            if not system.get_file_info(name).is_file:
                return group.iloc[:0].assign(shard=0, row=0, rows=0)[["key", "shard", "row", "rows"]]
            with system.open_input_file(name) as f:
                index = KeyIndex(f.read())
            k = group["key"].to_numpy(np.int64)
            found, shard, row, rows = index.find(k)
            return pd.DataFrame({"key": k[found], "shard": shard[found], "row": row[found], "rows": rows[found]})

        keys = keys.select(F.col(key_col).cast("long").alias("key"))
        named = keys.filter("key is not null").distinct().withColumn("part", self._part(self.indexes)("key"))
        found = named.groupBy("part").applyInPandas(find, "key long, shard long, row long, rows long")
        if self.null is None:
            return found
        own = (F.lit(x).cast("long").alias(c) for c, x in zip(("shard", "row", "rows"), self.null, strict=True))
        return found.unionByName(keys.filter("key is null").limit(1).select("key", *own))

    def read(self, keys: DataFrame, key_col: str = "key", with_ids: bool = True) -> DataFrame:
        """(key, start, n_tokens, ids_crc32[, ids]) of every row of the keys; reads are sorted and coalesced."""
        folder, dtype, shards, starts, ranks, names = self.folder, np.dtype(self.dtype), self.shards, self.starts, self.ranks, self.names
        schema = "key long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(folder)
            index = Reader(folder)
            for batch in batches:
                shard, row, n = (batch.column(c).to_numpy() for c in (1, 2, 3))
                key = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))).to_pylist()
                rank = np.repeat(ranks[np.searchsorted(shards, shard)] + row, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                nth = np.searchsorted(ranks, rank, side="right") - 1
                row, nth = (rank - ranks[nth]).tolist(), nth.tolist()
                spans = [(f"{names[s]}.idx", r * 8, 16) for s, r in zip(nth, row, strict=True)]
                offsets = list(index.runs(spans, lambda _, raw: struct.unpack("<QQ", raw)))
                spans = [(f"{names[s]}.bin", a * dtype.itemsize, (b - a) * dtype.itemsize, k, int(starts[s]) + a) for k, s, (a, b) in zip(key, nth, offsets, strict=True)]

                def one(span: tuple, raw: memoryview) -> tuple:
                    ids = np.frombuffer(raw, dtype).astype("<u4").tobytes()
                    return (span[3], span[4], len(ids) // 4, zlib.crc32(ids), *[ids] * with_ids)

                out = list(reader.runs(spans, one))
                columns = list(zip(*out, strict=True)) or [()] * (4 + with_ids)
                kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
            reader.close()
            index.close()

        step = F.lit(ROWS_AT_ONCE).cast("long")
        places = self.lookup(keys, key_col).withColumn("more", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, step)))
        places = places.select("key", "shard", (F.col("row") + F.col("more")).alias("row"), F.least(step, F.col("rows") - F.col("more")).alias("rows"))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return places.repartitionByRange(n, "shard", "row").sortWithinPartitions("shard", "row").mapInArrow(rows, schema)

    def _place(self, key: int | None) -> tuple[int, int, int] | None:
        if key is None:
            return self.null
        k = np.array([key], np.int64)
        system, root = opened(self.folder)
        name = f"{root}/keys-{int(index_of(k, self.indexes)[0]):05d}.mph"
        if not system.get_file_info(name).is_file:
            return None
        with system.open_input_file(name) as f:
            found, shard, row, rows = KeyIndex(f.read()).find(k)
        return (int(shard[0]), int(row[0]), int(rows[0])) if found[0] else None

    def get(self, key: int | None) -> Iterator[np.ndarray]:
        """The ids of each row of one key, by positional reads: of its index and, for each shard that it stands in, two."""
        place = self._place(key)
        if place is None:
            return
        shard, row, left = place
        rank = int(self.ranks[np.searchsorted(self.shards, shard)]) + row
        reader, dtype = Reader(self.folder), np.dtype(self.dtype)
        while left:
            nth = int(np.searchsorted(self.ranks, rank, side="right")) - 1
            n = min(left, int(self.ranks[nth + 1]) - rank, ROWS_AT_ONCE)
            offsets = np.frombuffer(reader.at(f"{self.names[nth]}.idx", (rank - int(self.ranks[nth])) * 8, 8 * (n + 1)), "<u8").tolist()
            raw = reader.at(f"{self.names[nth]}.bin", offsets[0] * dtype.itemsize, (offsets[-1] - offsets[0]) * dtype.itemsize)
            ids = np.frombuffer(raw, dtype)
            yield from (ids[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets[:-1], offsets[1:], strict=True))
            rank, left = rank + n, left - n
        reader.close()


def _dtype(path: str) -> np.dtype:
    from tokenizers import Tokenizer

    return id_type(Tokenizer.from_file(path))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, from the store's files: where its ids start, how many, and their checksum. A null id is one key."""
    docs = table(spark, sf_dir, "documents")
    store = TokenStore.write(spark, docs.select("doc_id", "text"))
    return store.read(docs.select("doc_id"), "doc_id", with_ids=False).withColumnRenamed("key", "doc_id")
