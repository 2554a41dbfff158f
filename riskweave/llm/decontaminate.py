"""Benchmark decontamination: a BM25 index of test items, queried with every training passage by block-max WAND.

The index holds the items' words with their BM25 impacts, each divided by the score that its item must reach
(``ratio`` times its score for its own text), so that one threshold, 1, holds for all items. Posting lists are cut into
blocks of neighbouring items, each with its largest impact.

Every document is cut into passages of twice the longest item's words, one every half passage, so an item that stands in
a document stands whole in a passage. A passage's distinct words are one query, its words in order of their largest impact.
The pivot is the first word by which these impacts add up to the threshold: an item that reaches it holds the pivot word or
one behind it, so their lists must be opened, and blocks in none of them are skipped. Lists of words before the pivot are
opened too, unless one is more than ``MORE`` times as long as those together or its word and the ones before it add up to
less than ``OPEN``: what the other words could add is then small, and few blocks need to have words looked up in them. Blocks
that are left are held to ever closer bounds: the largest impacts in them of the opened lists with all there could be of the
others (WAND), the largest impacts in them of all words (block-max), then their items' scores. Nothing grows with passages
times blocks. All items at or above the threshold are retrieved, no matter how many.

A retrieved pair is verified: the item's question (all but its last sentence) and answer (its last sentence) must each
have their share of word triples in the passage.

The index goes to every task, ``SHARD_CHARS`` characters of items at a time; a larger benchmark takes more passes over
the documents. Documents are not shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, releasing, table
from .license_scan import folded

K1, B = 1.2, 0.75
RATIO, QUESTION, ANSWER, GRAM = 0.6, 0.6, 0.5, 3
BLOCK = 8
LEAST = 1 - 1e-9
BOUND = LEAST - 1e-6  # bounds are sums in another order than scores
MORE, OPEN = 2, 0.2
SHARD_CHARS = 8_000_000
DOCS_AT_ONCE = 256
MEMO = 500_000


def words_of(text: str | None) -> list[bytes]:
    return folded(text).split()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of all sentences but the last, and of the last; of a single sentence, its first two thirds and the rest."""
    sentences = [w for s in re.split(r"(?<=[.!?])\s+", text.strip()) if (w := words_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = max(1, len(words) * 2 // 3)
    return words[:cut], words[cut:]


def grams(words: list[bytes]) -> set[tuple]:
    n = min(GRAM, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def share(wanted: list[bytes], there: dict[int, set[tuple]], words: list[bytes]) -> float:
    """Share of the wanted words' triples (all of fewer words) that ``words`` have; 1 if nothing is wanted."""
    own = grams(wanted)
    if not own:
        return 1.0
    n = min(GRAM, len(wanted))
    if n not in there:
        there[n] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    return len(own & there[n]) / len(own)


class Bm25Index:
    """``items``: (id, text) with words; ``total``, ``df`` and ``mean`` describe the whole benchmark, not this part of it."""

    def __init__(self, items: list[tuple[int, str]], total: int, df: dict[bytes, int], mean: float, ratio: float = RATIO):
        self.ids = [i for i, _ in items]
        self.parts = [question_answer(t) for _, t in items]
        self.longest = max(len(words_of(t)) for _, t in items)
        lists: dict[bytes, list[tuple[int, float]]] = {}
        for at, (_, text) in enumerate(items):
            tf = Counter(words_of(text))
            n = sum(tf.values())
            impact = {w: log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * n / mean)) for w, c in tf.items()}
            least = ratio * sum(impact.values())
            for w, x in impact.items():
                lists.setdefault(w, []).append((at, x / least))
        words = sorted(lists, key=lambda w: max(x for _, x in lists[w]))  # by their largest impact, as passages need them
        self.vocabulary = {w: t for t, w in enumerate(words)}
        self.words = pa.array(words, pa.large_binary())
        postings = [lists[w] for w in words]
        self.blocks = ceil(len(items) / BLOCK)
        sizes = np.array([len(p) for p in postings])
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.item = np.array([i for p in postings for i, _ in p], np.int64)
        self.impact = np.array([x for p in postings for _, x in p])
        # of each word: its blocks (key: word and block), the largest impact in each, and its place in the lists
        term = np.repeat(np.arange(len(postings)), sizes)
        self.key, self.key_starts = np.unique(term * self.blocks + self.item // BLOCK, return_index=True)
        self.block_max = np.maximum.reduceat(self.impact, self.key_starts)
        self.key_starts = np.append(self.key_starts, len(self.item))
        self.block = self.key % self.blocks
        self.block_starts = np.searchsorted(self.key // self.blocks, np.arange(len(postings) + 1))
        self.list_max = np.maximum.reduceat(self.impact, self.starts[:-1])

    def search(self, passage: np.ndarray, term: np.ndarray, passages: int) -> list[tuple[int, int, float]]:
        """(passage, item, score) of all at or above the threshold, from distinct (passage, word) rows in ascending order."""
        most = self.list_max[term]
        keep = np.bincount(passage, most, passages)[passage] >= BOUND
        passage, term, most = passage[keep], term[keep], most[keep]
        if not len(term):
            return []
        total = np.cumsum(most)
        first = np.searchsorted(passage, np.arange(passages + 1))  # of each passage: its rows
        upto = total - np.append(0.0, total)[first[passage]]
        behind = upto >= BOUND  # at the pivot or behind it
        length = self.block_starts[term + 1] - self.block_starts[term]
        must = np.bincount(passage, np.where(behind, length, 0), passages)
        behind |= (upto >= OPEN) & (length <= MORE * must[passage])
        rest = np.bincount(passage, np.where(behind, 0.0, most), passages)
        low_term = term[~behind]
        low_first = np.searchsorted(passage[~behind], np.arange(passages + 1))
        opened = np.where(behind, length, 0)
        out = []
        for a, b in _runs(opened, first):
            rows = a + np.flatnonzero(behind[a:b])
            at = _places(self.block_starts[term[rows]], opened[rows])
            least = int(passage[a])
            cell = np.repeat((passage[rows] - least) * self.blocks, opened[rows]) + self.block[at]
            width = (int(passage[b - 1]) - least + 1) * self.blocks
            if width <= len(at):  # most blocks are in an opened list
                bound = np.bincount(cell, self.block_max[at], width)
                cell = np.flatnonzero(bound)
                bound = bound[cell]
            else:
                cell, where = np.unique(cell, return_inverse=True)
                bound = np.bincount(where, self.block_max[at])
            p = cell // self.blocks + least
            live = bound + rest[p] >= BOUND
            bound, p, block = bound[live], p[live], cell[live] % self.blocks
            n = first[p + 1] - first[p]
            for c, d in _runs(n, np.arange(len(n) + 1)):
                low = low_first[p[c:d] + 1] - low_first[p[c:d]]
                own, at = self._look_up(low_term[_places(low_first[p[c:d]], low)], block[c:d], low)
                k = c + np.flatnonzero(bound[c:d] + np.bincount(own, self.block_max[at], d - c) >= BOUND)
                out += self._score(p[k], block[k], *self._look_up(term[_places(first[p[k]], n[k])], block[k], n[k]))
        return out

    def _look_up(self, term: np.ndarray, block: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which block, place in the keys) of the words that stand in their block; each block has ``n`` words."""
        own = np.repeat(np.arange(len(block)), n)
        key = term * self.blocks + block[own]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        there = self.key[at] == key
        return own[there], at[there]

    def _score(self, p: np.ndarray, block: np.ndarray, own: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float]]:
        """Of all items of blocks whose words stand at ``at`` of the keys."""
        m = self.key_starts[at + 1] - self.key_starts[at]
        at = _places(self.key_starts[at], m)
        scores = np.bincount(np.repeat(own, m) * BLOCK + self.item[at] % BLOCK, self.impact[at], len(p) * BLOCK)
        return [(int(p[k // BLOCK]), int(block[k // BLOCK] * BLOCK + k % BLOCK), float(scores[k])) for k in np.flatnonzero(scores >= LEAST).tolist()]


def _places(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of ``n``."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _runs(n: np.ndarray, first: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows, cut between the groups that begin at ``first``, of about ``most`` in all."""
    sums = np.append(0, np.cumsum(n))[first]
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(sums, sums[a] + most, side="right")) - 1)
        if first[a] < first[b]:
            yield int(first[a]), int(first[b])
        a = b


def _cut(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as one array, and how many each text has; as ``words_of`` would cut them."""
    parts = [folded(t) for t in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    inside = data > 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # starts and ends in turn
    starts = edges[::2]
    offsets = np.append(0, np.cumsum(edges[1::2] - starts))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


def _distinct(key: np.ndarray) -> np.ndarray:
    key = np.sort(key)
    return key[np.append(True, key[1:] != key[:-1])] if len(key) else key


def _leaks(texts: list[str | None], index: Bm25Index, question: float, answer: float) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question share, answer share) of every verified pair; of several passages the best."""
    half = max(1, index.longest)
    words, counts = _cut(texts)
    text_starts = np.cumsum(counts) - counts
    term = pc.index_in(words, value_set=index.words).fill_null(-1).to_numpy()
    pieces = np.maximum(1, -(-counts // half))  # half passages of each text
    piece_starts = np.cumsum(pieces) - pieces
    known = np.flatnonzero(term >= 0)
    owner = np.repeat(np.arange(len(texts)), pieces)
    begins = text_starts[owner] + (np.arange(len(owner)) - piece_starts[owner]) * half  # of each half passage
    sizes = np.minimum(begins + half, (text_starts + counts)[owner]) - begins
    piece, term = np.repeat(np.arange(len(owner)), sizes)[known], term[known].astype(np.int64)
    total, v = int(pieces.sum()), len(index.vocabulary)
    # a passage is a half passage and the next one of the same text
    back = (piece > 0) & (owner[np.maximum(piece - 1, 0)] == owner[piece])
    key = piece * v + term
    key = _distinct(np.concatenate((key, key[back] - v)))
    best: dict[tuple[int, int], tuple] = {}
    memo: dict[int, tuple] = {}
    for passage, item, score in index.search(key // v, key % v, total):
        k = int(owner[passage])
        if passage not in memo:
            a, b = int(begins[passage]), int(text_starts[k] + counts[k])
            memo = {passage: (words.slice(a, min(2 * half, b - a)).to_pylist(), {})}
        own, there = memo[passage]
        q, a = (share(part, there, own) for part in index.parts[item])
        if q >= question and a >= answer:
            best[k, item] = max(best.get((k, item), (0.0, 0.0, 0.0)), (q, a, score))
    return [(k, item, s, q, a) for (k, item), (q, a, s) in sorted(best.items())]


def _indexes(spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str, ratio: float) -> Iterator[Bm25Index]:
    """Indexes of bounded parts of the benchmark; the collection's statistics are over all of it."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in found], pa.int64()), pa.array([[w.decode("utf-8", "surrogatepass") for w in dict.fromkeys(x)] for x in found], pa.list_(pa.string()))], names=["id", "text", "n", "words"])

    counted = items.mapInArrow(count, "id long, text string, n long, words array<string>").filter("n > 0")
    total, chars, mean = counted.agg(F.count("*"), F.sum(F.length("text")), F.avg("n")).first()
    shards = ceil((chars or 0) / SHARD_CHARS)
    for k in range(shards):
        part = counted.filter(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k)
        rows = part.select("id", "text").collect()  # about SHARD_CHARS characters
        if rows:
            df = counted.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).join(part.select(F.explode("words").alias("w")).distinct(), "w").collect()
            rows.sort(key=lambda r: (r.id is not None, r.id or 0, r.text))
            yield Bm25Index([(r.id, r.text) for r in rows], total, {w.encode("utf-8", "surrogatepass"): n for w, n in df}, mean, ratio)


LEAK = "item_id long, bm25_ratio double, question_share double, answer_share double"


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", ratio: float = RATIO, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """(columns of ``docs`` but its text, item_id, bm25_ratio, question_share, answer_share), a row for each leak.

    ``bm25_ratio``: the passage's score over the item's for its own text. Null and empty texts and items leak nothing;
    repeated rows of documents or items give repeated rows; an empty table of either gives an empty result. Texts of any
    length are searched whole. Columns of ``docs`` that clash with the result's are dropped.
    """
    kept = [c for c in docs.columns if c not in (text_col, "item_id", "bm25_ratio", "question_share", "answer_share")]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("string").alias(fresh("text", docs)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]), LEAK])
    out = None
    for index in _indexes(spark, benchmark, item_id, item_text, ratio):
        sent = spark.sparkContext.broadcast(index)  # about SHARD_CHARS characters of items and their postings

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for at in range(0, len(batch), DOCS_AT_ONCE):
                    part = batch.slice(at, DOCS_AT_ONCE)
                    found = _leaks(part.column(len(kept)).to_pylist(), index, question, answer)
                    if found:
                        which = pa.array([f[0] for f in found], pa.int64())
                        extra = [pa.array([index.ids[f[1]] for f in found], pa.int64()), *(pa.array([f[k] * (ratio if k == 2 else 1) for f in found], pa.float64()) for k in (2, 3, 4))]
                        yield pa.RecordBatch.from_arrays([*(c.take(which) for c in part.columns[: len(kept)]), *extra], names=[*kept, "item_id", "bm25_ratio", "question_share", "answer_share"])

        found = docs.mapInArrow(releasing(rows), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair in which the item's question and answer stand in the document."""
    return leaks(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
