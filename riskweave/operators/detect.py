"""Detection: every rule over every text, overlaps resolved.

A rule's pattern runs only over texts that may hold a match: its literals are known (sets of which each match has one of
each), and so is the longest run of digits or of letters and digits that it needs. One pass of an Aho-Corasick automaton
finds the literals of all rules in a lower-cased text; the few rules left run. Spans of all rules are capped, sorted and
folded inside the row: nothing is shuffled, but that a table of fewer partitions than cores is dealt out first.

There are two engines with the same results. ``arrow`` hands batches of texts to Python's ``re``: one pass with early
ends, no recursion in the matcher, and a plan of one node. ``expressions`` stays in the JVM; the full catalog is then an
expression of thousands of nodes, which costs seconds to build and several times the CPU to run (see the README), but
for a few rules it is the lighter plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import facet, luhn

MAX_DETECTIONS = 50
SPAN = "struct<start:int,negrank:int,ord:int,seq:int,end:int,match:string>"
CARD = "pii_credit_card"
FINDINGS = "array<struct<ord:int,category:string,severity:string,rank:int,facet:int,name:string,start:int,end:int,match:string>>"


def _spans(text: Column, low: Column, rule: R.Rule, raw_cap: int) -> Column:
    pattern = F.lit(rule.java)
    found = F.regexp_extract_all(text, pattern, 0)
    pieces = F.split(text, rule.java, -1)
    if rule.category != CARD:  # a card must pass its checksum before it counts
        found = F.slice(found, 1, raw_cap)
    before = lambda i: F.length(F.array_join(F.slice(pieces, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(found, F.lit(1), i), ""))
    spans = F.transform(
        found,
        lambda m, i: F.struct(before(i).alias("start"), F.lit(-rule.rank).alias("negrank"), F.lit(rule.ord).alias("ord"), i.alias("seq"), (before(i) + F.length(m)).alias("end"), m.alias("match")),
    )
    if rule.category == CARD:
        spans = F.filter(spans, lambda s: luhn(s["match"]))
    may = text.rlike(rule.java)
    if rule.needles:
        may = reduce(lambda a, b: a | b, (low.contains(n) for n in rule.needles)) & may
    return F.when(may, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


class Prefilter:
    """Which of the rules may match a text."""

    def __init__(self, rules: tuple[R.Rule, ...]):
        flat = {w for r in rules for s in r.required for w in s}
        bits = {w: 1 << k for k, w in enumerate(sorted(flat))}
        self.marks = [(w, bit) for w, bit in bits.items() if len(w) == 1]
        self.words = {w: bits.get(w, 0) for w in sorted(flat.union(*(R.literals_of(r.formula) for r in rules))) if len(w) > 1}
        self.needs = [(r, r.least_digits, r.least_run if r.least_run >= LONG_RUN else 0, [sum(bits[w] for w in s) for s in r.required]) for r in rules]
        self.automaton = None
        try:
            import ahocorasick
        except ImportError:
            return
        if self.words:
            self.automaton = ahocorasick.Automaton()
            for w in self.words:
                self.automaton.add_word(w, w)
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[R.Rule]:
        low = text.lower()
        words = {w for _, w in self.automaton.iter(low)} if self.automaton is not None else {w for w in self.words if w in low}
        there = 0
        for w in words:
            there |= self.words[w]
        for w, bit in self.marks:
            if w in low:
                there |= bit
        digits = max(map(len, _DIGITS.findall(text)), default=0)
        run = max(map(len, _RUNS.findall(text)), default=0)
        return [r for r, d, n, sets in self.needs if d <= digits and n <= run and all(map(there.__and__, sets)) and R.holds(r.formula, words)]


LONG_RUN = 11
_DIGITS, _RUNS = re.compile("[0-9]+"), re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LONG_RUN)
prefilter = lru_cache(16)(Prefilter)


def matches(rule: R.Rule, text: str) -> Iterator[re.Match]:
    """The matches of one rule; a card must pass its checksum."""
    return (m for m in rule.python.finditer(text) if rule.category != CARD or _luhn(m[0]))


def find(text: str | None, rules: tuple[R.Rule, ...], most: int = MAX_DETECTIONS, policy: str = "earliest") -> list[dict]:
    """The findings of one text."""
    if not text:
        return []
    raw = []
    for rule in prefilter(rules)(text):
        for seq, m in enumerate(matches(rule, text)):
            raw.append((m.start(), -rule.rank, rule.ord, seq, m.end(), m[0], rule))
            if len(raw) >= 4 * most:
                break
        if len(raw) >= 4 * most:
            break
    raw.sort(key=lambda s: s[:4])
    kept: list[tuple] = []
    if policy == "earliest":
        last = 0
        for s in raw:
            if s[0] >= last and len(kept) < most:
                kept.append(s)
                last = s[4]
    else:
        for s in sorted(raw, key=lambda s: (s[1], s[0], s[0] - s[4], s[:4])):
            if not any(k[0] < s[4] and s[0] < k[4] for k in kept):
                kept.append(s)
        kept = sorted(kept, key=lambda s: s[:4])[:most]
    return [{"ord": o, "category": r.category, "severity": r.severity, "rank": -n, "facet": r.facet, "name": r.name, "start": a, "end": b, "match": m} for a, n, o, _, b, m, r in kept]


def _luhn(match: str) -> bool:
    digits = [int(c) for c in match if "0" <= c <= "9"]
    if len(digits) < 2:
        return False
    doubled = [d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it has fewer partitions than there are cores (a small file is one partition)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def _arrow(df: DataFrame, text_col: str, out_col: str, rules: tuple[R.Rule, ...], most: int, policy: str, least_chars: int) -> DataFrame:
    import pyarrow as pa

    df = spread(df)
    at = df.columns.index(text_col)
    kind = pa.list_(pa.struct([("ord", pa.int32()), ("category", pa.string()), ("severity", pa.string()), ("rank", pa.int32()), ("facet", pa.int32()), ("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("match", pa.string())]))

    def rows(batches):
        for batch in batches:
            found = pa.array([find(t, rules, most, policy) if t and len(t) >= least_chars else [] for t in batch.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out_col])

    return df.mapInArrow(rows, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out_col}` {FINDINGS}"]))


def _fold(spans: Column, most: int, policy: str) -> Column:
    """Greedy from the left: a span stays if it overlaps none that stayed. ``severity``: the worse of two overlapping ones."""
    if policy == "earliest":
        start = F.struct(F.lit(0).alias("last"), F.array().cast(f"array<{SPAN}>").alias("kept"))
        take = lambda acc, s: F.when((s["start"] >= acc["last"]) & (F.size(acc["kept"]) < most), F.struct(s["end"].alias("last"), F.array_append(acc["kept"], s).alias("kept"))).otherwise(acc)
        return F.aggregate(spans, start, take, lambda acc: acc["kept"])
    worst = F.array_sort(F.transform(spans, lambda s: F.struct(s["negrank"].alias("negrank"), s["start"].alias("start"), (s["start"] - s["end"]).alias("size"), s.alias("s"))))
    clash = lambda kept, s: F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
    kept = F.aggregate(worst, F.array().cast(f"array<{SPAN}>"), lambda acc, w: F.when(clash(acc, w["s"]), acc).otherwise(F.array_append(acc, w["s"])))
    return F.slice(F.array_sort(kept), 1, most)


def detect(df: DataFrame, *, text_col: str = "text", out_col: str = "findings", rules: tuple[R.Rule, ...] | None = None, disabled: tuple[str, ...] = (), max_detections: int = MAX_DETECTIONS, policy: str = "earliest", engine: str = "arrow", least_chars: int = 1) -> DataFrame:
    """``df`` and an array of findings: ord, category, severity, rank, facet, name, start, end, match.

    Offsets are code points, end exclusive. Null texts and those of fewer than ``least_chars`` characters have none. Rules of ``disabled`` categories are not
    part of the plan. ``policy``: which of two overlapping spans stays, the ``earliest`` (ties: the worse, then catalog
    order) or the one of worse ``severity``. At most ``4 * max_detections`` raw spans count, in catalog order.
    """
    rules = tuple(r for r in (R.catalog() if rules is None else rules) if r.category not in disabled)
    own = [c for c in df.columns if c != out_col]
    if not rules:
        return df.select(*own, F.array().cast(FINDINGS).alias(out_col))
    if engine == "arrow":
        return _arrow(df.select(*own), text_col, out_col, rules, max_detections, policy, least_chars)
    x = df.select(*own, F.when(F.length(text_col) >= max(1, least_chars), F.lower(F.col(text_col))).alias("_low"))
    # the lower-cased text is bound once for all rules; as a plain column it would be computed anew for each of them
    each = lambda low: F.flatten(F.array(*(_spans(F.col(text_col), low, r, 4 * max_detections) for r in rules)))
    raw = F.when(F.col("_low").isNotNull(), F.get(F.transform(F.array("_low"), each), F.lit(0))).otherwise(F.array().cast(f"array<{SPAN}>"))
    x = x.select(*own, F.array_sort(F.slice(raw, 1, 4 * max_detections)).alias("_raw"))
    x = x.select(*own, _fold(F.col("_raw"), max_detections, policy).alias("_kept"))
    known = F.create_map(*(c for r in rules for c in (F.lit(r.ord), F.struct(F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.name).alias("name"), F.lit(r.facet).alias("facet")))))
    of = lambda s, f: F.element_at(known, s["ord"])[f].alias(f)
    return x.select(
        *own,
        F.transform("_kept", lambda s: F.struct(s["ord"].alias("ord"), of(s, "category"), of(s, "severity"), (-s["negrank"]).alias("rank"), of(s, "facet"), of(s, "name"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"))).alias(out_col),
    )


def explode_findings(found: DataFrame, keys: list[str], col: str = "findings") -> DataFrame:
    return found.select(*keys, F.explode(col).alias("f")).select(*keys, "f.*")


def top_finding(col: Column) -> Column:
    """The worst finding of an array, of equals the first; null of none."""
    return F.aggregate(col, F.get(col, F.lit(0)), lambda a, f: F.when(f["rank"] > a["rank"], f).otherwise(a))


def with_facet(df: DataFrame) -> DataFrame:
    """Adds ``facet`` where a row has none."""
    return df.withColumn("facet", F.coalesce("facet", facet(F.col("category"))) if "facet" in df.columns else facet(F.col("category")))


def cascade(df: DataFrame, score: Column, *, text_col: str = "text", always: bool = False) -> DataFrame:
    """Adds ``ml``: the model's finding, for texts in which the rules found nothing (or ``always``)."""
    from ..functions import ml_finding

    finding = ml_finding(F.col(text_col), score)
    return df.withColumn("ml", finding if always else F.when(F.size("findings") == 0, finding))
