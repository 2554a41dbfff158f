"""Byte-level BPE by recursive DuckDB queries, one in-memory database per task.

Encoding: a text is cut by the tokenizer's pattern; a piece that is itself in the vocabulary is its id, as in the public
library. The other distinct pieces of a batch go to DuckDB as (word, position, token) rows. Each step of the recursive
query joins neighbouring tokens with the merge table and contracts, per word, the leftmost pair of least rank; words
without such a pair leave the recursion, which ends at the fixpoint. As each step's rows are kept until then, the squared
lengths of a batch are bounded. Long pieces go through recursive queries of a bounded number of steps, each fed with the
last rows of the one before; there a step contracts every place of the least rank, from the left, up to the first that
makes a pair of a lesser rank, which is the same as one place after the other. Decoding takes each id's bytes and
aggregates them per document in order of position.

Nothing is shuffled: every document is encoded and decoded in the task that read it. A task remembers the pieces it
has met, up to a fixed number, after which it starts afresh; DuckDB's memory is bounded too.
"""

from __future__ import annotations

import base64
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, table, with_field

MEMO_PIECES = 400_000
STEP_BYTES = 400_000
STEP_SQUARES = 8_000_000  # of a batch's squared lengths; about half as many rows
LONG_PIECE = 1_000
LONG_ROWS = 2_000_000
DECODE_TOKENS = 400_000
MAX_IDS_ROWS = 1024

# A row holds its token and the next one's (-1: none), so a step needs no sort: only the word's contracted pair, the
# token before it and the places behind it change.
_ENCODE = """
with recursive step(word, pos, tok, nxt, turn) as (
  select word, pos, tok, nxt, 0 from base
  union all
  select word, pos, tok, nxt, turn from (
    with best as (select s.word, min((m.rank::bigint << 40) | s.pos) as least from step s join merges m on m.pair = (s.tok::bigint << 32) | s.nxt group by s.word),
    pair as (select s.word, s.pos - 1 as at, (b.least >> 40)::int as rank, s.nxt as beyond from step s join best b on b.word = s.word and s.pos = (b.least & 1099511627775) + 1)
    select s.word, case when s.pos > p.at then s.pos - 1 else s.pos end as pos, case when s.pos = p.at then p.rank else s.tok end as tok,
      case when s.pos = p.at then p.beyond when s.pos = p.at - 1 then p.rank else s.nxt end as nxt, s.turn + 1 as turn
    from step s join pair p on p.word = s.word where s.pos <> p.at + 1
  )
)
select word, list(tok order by pos) as toks from step join (select word, max(turn) as turn from step group by word) using (word, turn) group by word
"""

_CONTRACT = """
with recursive step(word, pos, tok, nxt, turn) as (
  select word, pos, tok, nxt, 0 from base
  union all
  select word, pos, tok, nxt, turn from (
    with ranked as (select s.word, s.pos, m.rank from step s join merges m on m.pair = (s.tok::bigint << 32) | s.nxt where s.turn < {steps}),
    best as (select word, min(rank) as rank from ranked group by word),
    same as (select r.word, r.pos, r.rank, r.pos - row_number() over (partition by r.word order by r.pos) as run from ranked r join best b on b.word = r.word and b.rank = r.rank),
    parted as (select word, pos, rank, (pos - min(pos) over (partition by word, run)) % 2 as odd from same),
    places as (select word, pos, rank, lag(pos) over (partition by word order by pos) as before from parted where odd = 0),
    sides as (select p.word, p.pos, p.rank, case when p.before = p.pos - 2 then p.rank else l.tok end as lft, r.nxt as rgt
      from places p left join step l on l.word = p.word and l.pos = p.pos - 1 join step r on r.word = p.word and r.pos = p.pos + 1),
    stop as (select d.word, min(d.pos) as pos from sides d join merges m on (m.pair = (d.lft::bigint << 32) | d.rank) where m.rank < d.rank group by d.word
      union all select d.word, min(d.pos) as pos from sides d join merges m on (m.pair = (d.rank::bigint << 32) | d.rgt) where m.rank < d.rank group by d.word),
    last as (select word, min(pos) as pos from stop group by word),
    chosen as (select p.word, p.pos, p.rank from places p left join last l on l.word = p.word where l.pos is null or p.pos <= l.pos),
    marked as (select s.word, s.pos, coalesce(c.rank, s.tok) as tok, s.turn, c.rank is not null as own, lag(c.rank is not null, 1, false) over w as gone,
        sum((c.rank is not null)::int) over (partition by s.word order by s.pos rows between unbounded preceding and 1 preceding) as less
      from step s join best b on b.word = s.word left join chosen c on c.word = s.word and c.pos = s.pos window w as (partition by s.word order by s.pos))
    select word, (pos - coalesce(less, 0))::bigint as pos, tok, lead(tok, 1, -1) over (partition by word order by pos) as nxt, turn + 1 as turn from marked where not gone
  )
)
select word, pos, tok, nxt, top from step join (select word, max(turn) as top from step group by word) using (word) where turn = top order by word, pos
"""

_DECODE = "select doc, string_agg(bytes, '' order by pos) as text from tokens group by doc"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """What a file of ranks says. It never changes, so a Python worker keeps the last one (some 30 MB for 50,000 tokens)."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        bytes_of: list[str | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            bytes_of[rank] = token.decode("latin-1")
        self.bytes_of = pa.array(bytes_of, pa.string())
        # pieces by their UTF-8 text; most ids end whole words
        self.whole: dict[str, bytes] = {}
        for token, rank in ranks.items():
            try:
                self.whole[token.decode("utf-8")] = rank.to_bytes(4, "little")
            except UnicodeDecodeError:
                pass
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [((ranks[t[:k]] << 32) | ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        keys, ranked = (np.array(x) for x in zip(*pairs, strict=True))
        self.merges = pa.table({"pair": keys.astype(np.int64), "rank": ranked.astype(np.int32)})


vocabulary = lru_cache(1)(Vocabulary)


class ByteBpe:
    """Encoder and decoder of one task. ``path``: a file of base64 token and rank a line; ``pattern``: what cuts texts, or
    None if it only decodes."""

    def __init__(self, path: str, pattern: str | None):
        import duckdb
        import regex

        # DuckDB makes the folder when it spills and takes it away with the database
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": os.path.join(tempfile.gettempdir(), f"bpe-{uuid.uuid4().hex}")})
        known = vocabulary(path)
        self.bytes_of, self.byte_id, self.whole = known.bytes_of, known.byte_id, known.whole
        if pattern is None:
            return
        self.pattern = regex.compile(pattern)
        self.memo = dict(self.whole)
        self.db.register("m", known.merges).execute("create table merges as select * from m")

    def _learn(self, pieces: list[str]) -> None:
        """Add the ids of pieces that are not remembered, some at a time."""
        raws = [p.encode("utf-8", "surrogatepass") for p in pieces]
        start = 0
        while start < len(pieces):
            raw, n, squares, end = [], 0, 0, start
            while end < len(pieces) and (end == start or n < STEP_BYTES and squares + len(raws[end]) ** 2 <= STEP_SQUARES):
                raw.append(raws[end])
                n += len(raw[-1])
                squares += len(raw[-1]) ** 2
                end += 1
            base = self._rows(raw)
            if len(raw) == 1 and n > LONG_PIECE:
                self.memo[pieces[start]] = self._contract(base)
                start = end
                continue
            self.db.register("base", base)
            found = self.db.sql(_ENCODE).to_arrow_table()
            lists = found.column("toks").combine_chunks()
            lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
            offsets, raw_ids = lists.offsets.to_numpy().tolist(), lists.values.to_numpy().astype("<i4").tobytes()
            for w, a, b in zip(found.column("word").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                self.memo[pieces[start + w]] = raw_ids[4 * a : 4 * b]
            start = end

    def _rows(self, raw: list[bytes]) -> pa.Table:
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        word = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        pos = np.arange(len(word), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
        tok = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        nxt = np.append(tok[1:], np.int32(-1))
        nxt[np.cumsum(size) - 1] = -1
        return pa.table({"word": word, "pos": pos, "tok": tok, "nxt": nxt})

    def _contract(self, base: pa.Table) -> bytes:
        """The ids of one long piece."""
        while True:
            steps = max(1, LONG_ROWS // len(base))
            self.db.register("base", base)
            found = self.db.sql(_CONTRACT.format(steps=steps)).to_arrow_table()
            base = found.drop_columns("top")
            if found.column("top")[0].as_py() < steps:
                return base.column("tok").to_numpy().astype("<i4").tobytes()

    def encode(self, texts: list[str]) -> pa.ListArray:
        if len(self.memo) > MEMO_PIECES + len(self.whole):
            self.memo = dict(self.whole)
        get, ids = self.memo.__getitem__, []
        new: dict[int, list[str]] = {}
        for text in texts:
            pieces = self.pattern.findall(text)
            try:
                ids.append(b"".join(map(get, pieces)))
            except KeyError:
                new[len(ids)] = pieces
                ids.append(b"")
        if new:
            self._learn(list(set().union(*new.values()).difference(self.memo)))
            for k, pieces in new.items():
                ids[k] = b"".join(map(get, pieces))
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))

    def decode(self, ids: pa.Array) -> list[bytes]:
        """The bytes of each list of ids; an id outside the vocabulary is an error."""
        out: list[bytes] = []
        ends = ids.offsets.to_numpy()
        start = 0
        while start < len(ids):
            end = max(start + 1, int(np.searchsorted(ends, ends[start] + DECODE_TOKENS, side="right")) - 1)
            size = np.diff(ends[start : end + 1])
            tokens = self.bytes_of.take(ids.values.slice(ends[start], ends[end] - ends[start]))
            if tokens.null_count:
                raise KeyError("an id is not in the vocabulary")
            self.db.register("tokens", pa.table({"doc": np.repeat(np.arange(end - start, dtype=np.int32), size), "pos": np.arange(len(tokens)), "bytes": tokens}))
            found = dict(self.db.execute(_DECODE).fetchall())
            out += [found.get(k, "").encode("latin-1") for k in range(end - start)]
            start = end
        return out


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """``df`` and a column of token ids (array of int; a null or empty text has none).

    Repeated rows each get their own; an empty table stays empty. Texts and pieces of any length are encoded whole, in
    bounded memory. A column named ``out_col`` is replaced, all others stay, whatever their names.
    """
    path, pattern = tokenizer or default_tokenizer()
    df = df.drop(out_col)
    at = df.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, pattern)  # the task's own: a Python worker that goes on to other work keeps nothing of it
        for batch in batches:
            for k in range(0, len(batch), MAX_IDS_ROWS):
                part = batch.slice(k, MAX_IDS_ROWS)
                yield _with_column(part, out_col, bpe.encode([t or "" for t in part.column(at).to_pylist()]))

    return df.mapInArrow(releasing(rows), with_field(df, out_col, "array<int>"))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """``df`` and a binary column of the decoded bytes (null or empty ids: empty; an id outside the vocabulary is an error).
    Rows, repeats, empty tables and other columns are treated as in ``encode``."""
    path, _ = tokenizer or default_tokenizer()
    df = df.drop(out_col)
    at = df.columns.index(ids_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, None)
        for batch in batches:
            for k in range(0, len(batch), MAX_IDS_ROWS):
                part = batch.slice(k, MAX_IDS_ROWS)
                lists = part.column(at)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))), pa.int32()), lists.flatten())
                yield _with_column(part, out_col, pa.array(bpe.decode(flat), pa.binary()))

    return df.mapInArrow(releasing(rows), with_field(df, out_col, "binary"))


def round_trip(df: DataFrame, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """``decode(encode(df))`` in one pass: the ids go from the encoder to the decoder of the same task."""
    path, pattern = tokenizer or default_tokenizer()
    df = df.drop(ids_col, out_col)
    at = df.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, pattern)
        for batch in batches:
            for k in range(0, len(batch), MAX_IDS_ROWS):
                part = batch.slice(k, MAX_IDS_ROWS)
                ids = bpe.encode([t or "" for t in part.column(at).to_pylist()])
                yield _with_column(_with_column(part, ids_col, ids), out_col, pa.array(bpe.decode(ids), pa.binary()))

    return df.mapInArrow(releasing(rows), with_field(df, ids_col, "array<int>") + f", `{out_col}` binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of the bytes that they decode to."""
    done = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
