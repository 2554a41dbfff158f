"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

Shingles are 64-bit hashes. The join runs in these steps, none of which gathers a key's documents in one task:

1. *Token lists.* Each task packs the distinct shingles of a chunk of documents into one row per hash range. A shingle
   counts once per chunk, so one that stands in a third of all documents still costs one entry per chunk. A row of the
   chunk's documents (ids, sizes, digests of their sets) goes along, so texts are read and shingled once.
2. *Document frequencies.* The rows of a hash range meet; shingles found in one document only are dropped (they cannot
   be shared), the others go back to their chunks with their global frequency. There are as many ranges as keep one small.
3. *Adaptive prefixes.* A document of ``n`` shingles shares at least ``need = ceil(t * n)`` with any partner, so two
   partners share ``k`` of the rarest ``n - need + k`` shingles of either, for every ``k``. Each document takes the
   ``k`` with the least estimated cost (entries to scan, plus candidates that reach ``k`` matches, times the cost of a
   check). A pair is then held to the smaller ``k`` of the two, counted over the prefixes of that length, before its sets
   are compared.
4. *Links.* Documents with equal sets are one class from the start, and so are documents with as many shingles and the
   same shared ones: what they share with any document is the same, so they have the same links. A pair's overlap is at
   most the shared shingles of either, less those whose bit (of 512) the other has not set, which decides most pairs
   without a look at the sets. A round comes first in which each list compares its members with one pivot (linear,
   whatever its length); verified links are folded into components, and only lists that still span several components go
   on. When the pairs left are few beside the prefixes, or the round is over, all pairs left across components are
   enumerated, each once (at the first shared token of its prefixes), held to the shared-prefix count and verified. A list
   of more than ``LIST_BLOCK`` members is enumerated by pairs of blocks, each a group of its own. Pairs inside one component
   need no check: their connection is known. So components are exact. Where many pairs are left, a share of the members
   meets all others first, then ``GROWTH`` times as many, until all have: the links of a share join most members of a large
   group, so those found after it grow with the group and not with its square. Only links between components are kept.

A collision of 64-bit shingle hashes inside one pair of documents (about 1e-14 for a pair of 600 words) is the only
source of error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, release_shuffles, releasing, table

WORDS_MEMO = 200_000
CHUNK_TOKENS = 1_500_000
CHUNK_DOCS = 60_000
INLINE = 64
MAX_MATCHES = 16
CHECK_COST = 20.0
ROUNDS = 1
LIST_BLOCK = 1_000
RANGE_TOKENS = 2_000_000
ROWS_PER_TASK = 50_000
PAIRS_PER_ROW = 8
SLICES = 1 << 20
GROWTH = 8
_UNSETTLED = re.compile(r"Exchange|\b(?:rand|randn|uuid|shuffle)\(|Sample|TableCache|InMemoryTableScan")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Shingler:
    """Distinct sorted shingle hashes of a text: A-Z lower-cased, words between ASCII white space."""

    def __init__(self, size: int):
        self.size, self.memo = size, {}

    def words(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass").lower().split()
        memo = self.memo
        if len(memo) > WORDS_MEMO:
            memo.clear()
        for w in set(raw).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, raw), np.uint64, len(raw))

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        size = min(self.size, len(w))
        h = np.full(len(w) - size + 1, size, np.uint64)
        for k in range(size):
            h = (h ^ w[k : len(w) - size + 1 + k]) * _M1
            h ^= h >> np.uint64(29)
            h *= _M2
            h ^= h >> np.uint64(32)
        return np.unique(h * _M3)


def signature(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else b""


def need(n, percent: int):
    """Least overlap of a set of ``n`` with any partner."""
    return -(-percent * n // 100)


# ---------------------------------------------------------------- packing of sorted tokens


def pack(tokens: np.ndarray) -> bytes:
    """Sorted distinct tokens as fixed-width differences; the first byte is the width."""
    if not len(tokens):
        return b""
    d = np.diff(tokens, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(d[1:].max()).bit_length() + 7) // 8) if len(d) > 1 else 1
    return bytes([width]) + d[:1].tobytes() + d[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.uint64)
    width, rest = raw[0], np.frombuffer(raw, np.uint8, offset=9)
    d = np.zeros((len(rest) // width + 1, 8), np.uint8)
    d[0] = np.frombuffer(raw, np.uint8, 8, 1)
    d[1:, :width] = rest.reshape(-1, width)
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


def settled(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with partitions that hold the same rows in the same order whenever they are read: as it is without a shuffle
    or chance in its plan, else as a table."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return materialize(spark, docs, name) if _UNSETTLED.search(plan) else docs


PACKED = "key long, chunk string, tokens binary, counts binary, docs binary, sigs binary, sizes binary, ids binary, hashes binary"
PACKED_NAMES = tuple(x.split()[0] for x in PACKED.split(", "))


class Chunk:
    """Documents whose shingles are packed together. Those without words have size 0 and no signature."""

    def __init__(self) -> None:
        self.sets: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.hashes: list[int] = []
        self.sizes: list[int] = []
        self.tokens = 0

    def add(self, tokens: np.ndarray, doc_id: int | None, text_hash: int) -> None:
        if len(tokens):
            self.sets.append(tokens)
            self.tokens += len(tokens)
        self.ids.append(doc_id)
        self.hashes.append(text_hash)
        self.sizes.append(len(tokens))

    @property
    def full(self) -> bool:
        return self.tokens >= CHUNK_TOKENS or len(self.ids) >= CHUNK_DOCS

    def rows(self, buckets: int, partition: int, nth: int) -> Iterator[dict]:
        """One row per hash range, and one of the documents themselves and of the lists too long to send along. A chunk is
        named by its place, so a task that runs again gives the same rows."""
        name = f"{partition}-{nth}"
        tokens = np.concatenate([np.empty(0, np.uint64), *self.sets])
        sizes = np.array([len(x) for x in self.sets], "<u4")
        docs = np.repeat(np.arange(len(self.sets), dtype="<u2"), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, docs = tokens[order], docs[order]
        del order
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, np.int64)
        counts = np.diff(np.append(starts, len(tokens))).astype("<u4")
        distinct = tokens[starts]
        width = (1 << 64) // buckets + 1
        edges = np.searchsorted(distinct, np.array([k * width for k in range(buckets)], np.uint64))
        edges = np.append(edges, len(distinct))
        long_lists = np.repeat(counts > INLINE, counts)
        for k in range(buckets):
            a, b = edges[k], edges[k + 1]
            if a == b:
                continue
            lo, hi = starts[a], starts[b - 1] + counts[b - 1]
            c = counts[a:b]
            many = np.flatnonzero(c > 1).astype("<u4")
            yield {"key": k, "chunk": name, "tokens": pack(distinct[a:b]), "counts": np.concatenate((many, c[many])).astype("<u4").tobytes(), "docs": docs[lo:hi][~long_lists[lo:hi]].tobytes()}
        hot = counts > INLINE
        named = np.array([i is not None for i in self.ids], np.uint8)
        yield {
            "key": -1 - (partition << 31 | nth), "chunk": name, "tokens": pack(distinct[hot]), "counts": counts[hot].tobytes(), "docs": docs[long_lists].tobytes(),
            "sigs": b"".join(map(signature, self.sets)), "sizes": np.array(self.sizes, "<u4").tobytes(), "ids": named.tobytes() + np.array([i or 0 for i in self.ids], "<i8").tobytes(), "hashes": np.array(self.hashes, "<i8").tobytes(),
        }


def _token_lists(shingle_size: int, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, chunk, nth = Shingler(shingle_size), Chunk(), 0
        context = TaskContext.get()
        partition = context.partitionId() if context else 0

        def flush():
            out = list(chunk.rows(buckets, partition, nth))
            return pa.RecordBatch.from_arrays([pa.array([r["key"] for r in out], pa.int64()), pa.array([r["chunk"] for r in out]), *(pa.array([r.get(k) for r in out], pa.binary()) for k in PACKED_NAMES[2:])], names=PACKED_NAMES)

        for batch in batches:
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                chunk.add(shingle(text.as_py()), doc_id, text_hash)
                if chunk.full:
                    yield flush()
                    chunk, nth = Chunk(), nth + 1
        if chunk.ids:
            yield flush()

    return releasing(rows)


def _expand(counts: bytes, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    many = np.frombuffer(counts, "<u4")
    out[many[: len(many) // 2]] = many[len(many) // 2 :]
    return out


SHARED = "chunk string, tokens binary, dfs binary, counts binary, docs binary, sigs binary, sizes binary, ids binary, hashes binary"
SHARED_NAMES = [x.split()[0] for x in SHARED.split(", ")]


def _frequencies(group: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range: to each chunk its tokens that stand in two documents or more. Other rows go through."""
    out = []
    if group["key"].iloc[0] < 0:
        out = [{"chunk": r.chunk, "tokens": unpack(r.tokens).tobytes(), "counts": r.counts, "docs": r.docs, "sigs": r.sigs, "sizes": r.sizes, "ids": r.ids, "hashes": r.hashes} for r in group.itertuples()]
    else:
        lists = [unpack(x) for x in group["tokens"]]
        counts = [_expand(c, len(t)) for c, t in zip(group["counts"], lists, strict=True)]
        tokens = np.concatenate(lists)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        sums = np.add.reduceat(np.concatenate(counts)[order], starts)
        df = np.empty(len(tokens), "<u4")
        df[order] = np.repeat(np.minimum(sums, 2**32 - 1).astype("<u4"), np.diff(np.append(starts, len(tokens))))
        del tokens, order, starts, sums
        at = 0
        for chunk, t, c, docs in zip(group["chunk"], lists, counts, group["docs"], strict=True):
            mine, at = df[at : at + len(t)], at + len(t)
            if (keep := mine > 1).any():
                inline = np.where(c > INLINE, 0, c)
                d = np.frombuffer(docs, "<u2")[np.repeat(keep, inline)]
                out.append({"chunk": chunk, "tokens": t[keep].tobytes(), "dfs": mine[keep].tobytes(), "counts": c[keep].astype("<u4").tobytes(), "docs": d.tobytes()})
    return pd.DataFrame(out, columns=SHARED_NAMES)


def choose(dfs: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """(required matches k, length of the prefix among the shared tokens) at the least estimated cost; (0, 0): no partner.

    ``dfs``: ascending frequencies of the tokens that others have too; the ``n - len(dfs)`` own tokens come before.
    """
    base = n - need(n, percent) + 1 - (n - len(dfs))
    if base <= 0:
        return 0, 0
    reach = min(MAX_MATCHES, len(dfs) - base + 1)
    entries = np.cumsum(dfs.astype(np.float64) - 1)[base - 1 : base - 1 + reach]
    k = int(np.argmin(entries * (1 + CHECK_COST / np.arange(1, reach + 1)))) + 1
    return k, base + k - 1


# A row for each document, and one (``node`` not null) for each set of a chunk that may have a partner; its prefix for k
# matches is the first base + k - 1 of its tokens, which are its shared shingles, the rarest first.
FOUND = "sig binary, doc_id long, text_hash long, n_shingles long, node binary, size int, matches int, base int, bits array<long>, tokens array<long>"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]
FOUND_NUMBERS = frozenset(x.split()[0] for x in FOUND.split(", ") if x.split()[1] in ("long", "int"))
BITS = 512


def _prefixes(percent: int):
    def rows(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group["sigs"].notna()].iloc[0]
        every, sigs = np.frombuffer(head["sizes"], "<u4"), head["sigs"]
        sizes = every[every > 0]
        named, ids = np.frombuffer(head["ids"], np.uint8, len(every)).astype(bool), np.frombuffer(head["ids"], "<i8", offset=len(every))
        at = np.where(every > 0, np.cumsum(every > 0) - 1, -1)
        out = [(b"" if d < 0 else sigs[16 * d : 16 * d + 16], i if known else None, h, n, *[None] * 6) for d, i, known, h, n in zip(at.tolist(), ids.tolist(), named.tolist(), np.frombuffer(head["hashes"], "<i8").tolist(), every.tolist(), strict=True)]
        hot, hot_counts, hot_docs = np.frombuffer(head["tokens"], "<u8"), np.frombuffer(head["counts"], "<u4").astype(np.int64), np.frombuffer(head["docs"], "<u2")
        hot_starts = np.concatenate(([0], np.cumsum(hot_counts)))
        toks, dfs, docs = [], [], []
        for r in group[group["dfs"].notna()].itertuples():
            t, f, c = np.frombuffer(r.tokens, "<u8"), np.frombuffer(r.dfs, "<u4"), np.frombuffer(r.counts, "<u4").astype(np.int64)
            few = c <= INLINE
            toks.append(np.repeat(t[few], c[few]))
            dfs.append(np.repeat(f[few], c[few]))
            docs.append(np.frombuffer(r.docs, "<u2"))
            for x, fx in zip(t[~few], f[~few], strict=True):
                j = np.searchsorted(hot, x)
                d = hot_docs[hot_starts[j] : hot_starts[j + 1]]
                toks.append(np.full(len(d), x))
                dfs.append(np.full(len(d), fx))
                docs.append(d)
        if toks:
            toks, dfs, docs = np.concatenate(toks), np.concatenate(dfs), np.concatenate(docs)
            order = np.lexsort((toks, dfs, docs))
            toks, dfs, docs = toks[order], dfs[order], docs[order]
            del order
            starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
            seen = set()
            for a, b in zip(starts, np.append(starts[1:], len(docs)), strict=True):
                d = int(docs[a])
                sig = sigs[16 * d : 16 * d + 16]
                k, length = choose(dfs[a:b], int(sizes[d]), percent)
                if k and sig not in seen:
                    seen.add(sig)
                    signed = toks[a:b].view(np.int64)
                    node = xxhash.xxh3_128_digest(np.append(np.sort(toks[a:b]), np.uint64(sizes[d])).tobytes())
                    bits = np.zeros(BITS, bool)
                    bits[(toks[a:b] % np.uint64(BITS)).astype(np.int64)] = True
                    out.append((sig, None, None, None, node, int(sizes[d]), k, length - k + 1, np.packbits(bits).view("<i8"), signed))
        columns = dict(zip(FOUND_NAMES, zip(*out, strict=True), strict=True))
        return pd.DataFrame({c: pd.array(x, "Int64") if c in FOUND_NUMBERS else pd.Series(x, dtype=object) for c, x in columns.items()})

    return rows


# ---------------------------------------------------------------- components


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most so many small rows in as many partitions as these need."""
    return df.coalesce(rows // ROWS_PER_TASK + 1)


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, comp): the least node that ``links`` (a, b) reach, for every node of a link. Lineage is cut each round."""
    n = 2 * links.count()
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(spark, _few(both, n), "links")
    labels = materialize(spark, _few(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), n), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        step = near.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("far", "comp")).alias("comp"))
        step = materialize(spark, _few(step, n), "labels")
        changed = step.filter(F.col("was") != F.col("comp")).limit(1).count()
        discard(spark, labels)
        labels = step.select("node", "comp")
        labels.scratch = step.scratch
        if not changed:
            discard(spark, both)
            return labels


def _merged(spark: SparkSession, comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp), or none yet, after ``links`` (a, b) between its components; a node that it lacks is one by itself.
    Only the components that are linked anew are labelled again."""
    if comps is not None and not links.limit(1).count():
        return comps
    joined = components(spark, links)
    if comps is None:
        return joined
    farther = joined.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
    known = comps.join(farther, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp"))
    both = known.unionByName(joined.join(comps, "node", "left_anti").select("node", "comp"))
    out = materialize(spark, _few(both, comps.count() + joined.count()), "labels")
    discard(spark, comps)
    discard(spark, joined)
    return out


def _reach(na, nb, overlap, percent: int):
    return overlap * 100 >= (na + nb - overlap) * percent


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, and more columns), those whose sets reach the threshold. Their prefixes for the smaller number of
    matches must share that many tokens first; then the overlap is counted on all shared tokens."""
    a, b = (nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("size", "matches", "base", "tokens"))) for x in "ab")
    k = F.least("a_matches", "b_matches")
    common = lambda x, y: F.size(F.array_intersect(x, y))
    head = lambda x: F.slice(f"{x}_tokens", F.lit(1), F.col(f"{x}_base") + k - 1)
    both = pairs.join(a, "a").join(b, "b").filter(common(head("a"), head("b")) >= k)
    return both.filter(_reach(F.col("a_size"), F.col("b_size"), common("a_tokens", "b_tokens"), percent)).select(pairs.columns)


def link_components(spark: SparkSession, nodes: DataFrame, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, comp) of every node (size, matches, base, bits, tokens) that links with another one."""
    prefix = F.slice("tokens", F.lit(1), F.col("base") + F.col("matches") - 1)
    rows = nodes.select("node", "size", F.size("tokens").alias("m"), F.explode(prefix).alias("token"))
    alone = rows.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token")
    rows = materialize(spark, rows.join(alone, "token", "left_semi").withColumn("comp", F.col("node")), "prefix")
    total = rows.count()  # and of later rounds at most
    comps = None

    def fold(pairs: DataFrame) -> DataFrame:
        """``comps`` after the links among ``pairs`` (a, b, and their components a_comp, b_comp)."""
        linked = _verified(pairs, nodes, percent).select(F.least("a_comp", "b_comp").alias("a"), F.greatest("a_comp", "b_comp").alias("b")).distinct()
        linked = materialize(spark, linked, "links-found")
        out = _merged(spark, comps, linked)
        discard(spark, linked)
        return out

    words = [F.col("bits")[k].alias(f"b{k}") for k in range(BITS // 64)]

    def less_apart(x: str, y: str):
        """Upper bound of the overlap: a bit of one that the other lacks stands for a shingle that it lacks."""
        apart = lambda a, b: sum((F.bit_count(F.col(f"{a}b{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}b{k}")))) for k in range(BITS // 64)), F.lit(0))
        return F.least(F.col(f"{x}m") - apart(x, y), F.col(f"{y}m") - apart(y, x))

    def possible(x: str, y: str):
        size, m = (lambda s: F.col(f"{s}size")), (lambda s: F.col(f"{s}m"))
        return _reach(size(x), size(y), F.least(m(x), m(y)), percent)

    r, done = 0, 0  # done: members with a slice below it have met all others of their lists
    while True:
        per_comp = rows.groupBy("token", "comp").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(r)), "node", "comp", "size", "m")).alias("pivot"))
        lists = per_comp.groupBy("token").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.min("pivot").alias("pivot"))
        lists = materialize(spark, _few(lists.filter("comps > 1"), total), "lists")
        left = lists.agg(F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2)).first()[0] or 0
        if left == 0:
            discard(spark, lists)
            break
        few = left <= PAIRS_PER_ROW * total
        if (r and few) or r >= rounds:
            upto = SLICES if few else max(GROWTH * done, int(SLICES * PAIRS_PER_ROW * total / left), 1)
            upto = SLICES if 3 * upto > SLICES else upto
            # a list's members by blocks; each pair of blocks is a group (one block, as nearly all lists have: one group)
            block = lambda of: F.floor(of * F.col("blocks") / SLICES).cast("int")
            blocks = lists.select("token", F.ceil(F.col("n") / LIST_BLOCK).cast("int").alias("blocks"))
            open_ = rows.join(blocks, "token").select("token", "node", "comp", "blocks", F.pmod(F.xxhash64("node"), F.lit(SLICES)).alias("slice"))
            open_ = open_.withColumn("block", block(F.col("slice")))
            open_ = open_.join(nodes.select("node", "size", F.size("tokens").alias("m"), "matches", "base", prefix.alias("prefix"), *words), "node")
            place = F.array_position("prefix", F.col("token")).cast("int")
            before, after = F.slice("prefix", F.lit(1), place - 1), F.slice("prefix", place, F.size("prefix"))
            bits = [f"b{k}" for k in range(BITS // 64)]
            open_ = materialize(spark, open_.select("token", "blocks", "slice", "block", "node", "comp", "size", "m", "matches", "base", before.alias("before"), F.when(F.col("matches") > 1, after).alias("rest"), *bits), "open")
            own = ("slice", "node", "comp", "size", "m", "matches", "base", "before", "rest", *bits)
            met = open_.filter(F.col("slice").between(done, upto - 1))
            x = met.select("token", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), *(F.col(c).alias(f"x{c}") for c in own))
            first, last = block(F.lit(done)), F.least(F.col("block"), block(F.lit(upto - 1)))
            y = open_.filter(first <= F.col("block")).select("token", F.explode(F.sequence(first, last)).alias("i"), F.col("block").alias("j"), *(F.col(c).alias(f"y{c}") for c in own))
            k = F.least("xmatches", "ymatches")
            head = lambda s: F.slice(F.col(f"{s}rest"), F.lit(1), F.greatest(F.lit(0), F.col(f"{s}base") + k - 1 - F.size(f"{s}before")))
            enough = F.when(k == 1, True).otherwise(F.size(F.array_intersect(head("x"), head("y"))) >= k)
            once = F.struct("xslice", "xnode") < F.struct("yslice", "ynode")  # blocks are ranges of slices
            wanted = once & (F.col("xcomp") != F.col("ycomp")) & possible("x", "y") & _reach(F.col("xsize"), F.col("ysize"), less_apart("x", "y"), percent) & ~F.arrays_overlap("xbefore", "ybefore") & enough
            same = (x["token"] == y["token"]) & (x["i"] == y["i"]) & (x["j"] == y["j"])
            pairs = x.join(y, same & wanted).select(F.col("xnode").alias("a"), F.col("ynode").alias("b"), F.col("xcomp").alias("a_comp"), F.col("ycomp").alias("b_comp"))
            pairs = materialize(spark, pairs, "pairs")
            discard(spark, open_)  # before the sets are brought to the pairs
            comps = fold(pairs)
            discard(spark, pairs)
            done = upto
            if done == SLICES:
                discard(spark, lists)
                break
            starred = rows.join(lists.select("token"), "token")
        else:
            starred = rows.join(lists.select("token", "pivot"), "token")
            stars = starred.select("*", *(F.col(f"pivot.{c}").alias(f"p{c}") for c in ("node", "comp", "size", "m"))).filter((F.col("comp") != F.col("pcomp")) & possible("", "p"))
            comps = fold(stars.select(F.col("node").alias("a"), F.col("pnode").alias("b"), F.col("comp").alias("a_comp"), F.col("pcomp").alias("b_comp")).distinct())
        left_open = starred.drop("pivot", "comp").join(comps, "node", "left").select("node", "size", "m", "token", F.coalesce("comp", "node").alias("comp"))
        left_open = materialize(spark, _few(left_open, total), "prefix")
        discard(spark, rows)
        discard(spark, lists)
        rows, r = left_open, r + 1
    discard(spark, rows)
    return comps if comps is not None else spark.createDataFrame([], "node binary, comp binary")


def _groups(spark: SparkSession, docs: DataFrame, shingle: int, percent: int, buckets: int | None) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id long, text string): a row (doc_id, text_hash, n_shingles, sig) for each, and of each class of equal
    sets that holds several rows or links with another class (sig, least), the row of its component that stays: the one of
    least id (null last), then text hash, as (unnamed, doc_id, text_hash)."""
    docs = settled(spark, docs, "documents")  # chunks are named by place
    if buckets is None:  # a word of five characters and a space stands for a shingle
        chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // (6 * RANGE_TOKENS)))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    lists = hashed.mapInArrow(_token_lists(shingle, buckets), PACKED)
    shared = lists.groupBy("key").applyInPandas(_frequencies, SHARED)
    found = materialize(spark, shared.groupBy("chunk").applyInPandas(_prefixes(percent), FOUND), "found")
    del lists, shared  # with them go the shuffle files of the token lists, the largest of the join
    release_shuffles(spark)
    base = found.filter("node is null").select("doc_id", "text_hash", "n_shingles", "sig")
    active = found.filter("node is not null")
    nodes = materialize(spark, active.select("node", "size", "matches", "base", "bits", "tokens").dropDuplicates(["node"]), "nodes")
    release_shuffles(spark)
    comps = link_components(spark, nodes, percent)

    # a class of equal sets belongs to the component of its node, to its node if the node's sets reach each other, or to itself
    mutual = _reach(F.col("size"), F.col("size"), F.size("tokens"), percent)
    members = active.select("sig", "node", mutual.alias("mutual")).distinct().join(comps, "node", "left")
    members = members.select("sig", F.when(F.col("comp").isNotNull(), F.col("comp")).when(F.col("mutual"), F.col("node")).alias("comp")).filter("comp is not null")
    members = materialize(spark, members, "members")
    discard(spark, nodes)
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    classes = base.filter("n_shingles > 0").groupBy("sig").agg(F.min(first).alias("least"), F.count("*").alias("n"))
    named = classes.join(members, "sig", "left").filter("n > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "sig"))
    # tables of their own, so that the classes of a large component can be dealt to several tasks in the join
    named = materialize(spark, named.select("sig", "comp", "least"), "classes")
    least = materialize(spark, named.groupBy("comp").agg(F.min("least").alias("least")), "least")
    return base, named.drop("least").join(least, "comp").select("sig", "least")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def jaccard_components(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85, buckets: int | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Null or empty texts (or white space only) have n_shingles 0 and are their own component. Repeated rows each get a
    row; equal texts always share a component. A null id counts as no id: its component is the least id it reaches, null
    if there is none. An empty table gives an empty one. Texts of any length are shingled whole. Extra columns are ignored,
    whatever their names. ``buckets``: hash ranges of the token lists, by default as many as keep each at about
    ``RANGE_TOKENS`` tokens, and one for each shuffle partition.
    """
    base, groups = _groups(spark, _documents(docs, id_col, text_col), shingle, percent, buckets)
    out = base.join(groups, "sig", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingles and component: links at a Jaccard similarity of 0.85 on four-word shingles."""
    return jaccard_components(spark, table(spark, sf_dir, "documents"))


BROADCAST_ROWS = 1_000_000  # of 17 bytes and a hash table's overhead


def drop_rows(spark: SparkSession, docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows that ``gone`` (doc_id, text_hash; of any rows, once or often) names: by id, null included, and
    text. ``gone`` is broadcast while it has at most ``BROADCAST_ROWS`` rows, else joined."""
    gone = materialize(spark, gone.select("doc_id", "text_hash").distinct(), "gone")
    there = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = docs[f"`{id_col}`"].cast("long").eqNullSafe(there["doc_id"]) & (F.xxhash64(docs[f"`{text_col}`"].cast("string")) == there["text_hash"])
    return docs.join(there, same, "left_anti")


def deduplicate(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group that links, directly or not: the one of least id.

    Null ids come last; of rows with the same least id the one whose text has the least hash stays, whatever else stands
    under that id. Rows that repeat an id and its text are one document. Documents without words (null, empty, white space)
    link with nothing and all stay, as do columns of any name. An empty table stays empty.
    """
    base, groups = _groups(spark, _documents(docs, id_col, text_col), shingle, percent, None)
    grouped = base.filter("n_shingles > 0").join(groups, "sig").select("doc_id", "text_hash", "least")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    grouped = materialize(spark, grouped.select("doc_id", "text_hash", stays.alias("stays")), "grouped")
    out = drop_rows(spark, docs, grouped.filter("not stays"), id_col, text_col)
    repeated = grouped.filter("stays").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = materialize(spark, repeated.select("doc_id", "text_hash"), "repeated")
    if repeated.limit(1).count():
        same = out[f"`{id_col}`"].cast("long").eqNullSafe(repeated["doc_id"]) & (F.xxhash64(out[f"`{text_col}`"].cast("string")) == repeated["text_hash"])
        once = out.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col])
        out = drop_rows(spark, out, repeated, id_col, text_col).unionByName(once)
    return out.select(*(f"`{c}`" for c in docs.columns))
