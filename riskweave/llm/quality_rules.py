"""Quality rules, line first, with built-in functions only.

Each line is judged by itself: it must end in a mark of punctuation or hold the end of a sentence, must not be a row of navigation links, shouted,
strewn with symbols or a boilerplate phrase. Lines that fail are removed; a document that loses more than ``most_lost``
of its characters (white space aside) is rejected, as is one that the base counts reject.

Everything happens inside a row: words, lines and windows are arrays, repeated windows are found by sorting the windows'
64-bit hashes with their places, in n log n. Nothing is exploded or shuffled, so a hot source or very long text costs
no more than its own length.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
MOST_LOST = 0.5
MIN_WORDS, MOST_REPEATED = 50, 50

# The line rules as regular expressions that Java and RE2 read alike.
ENDS = r"""[.!?:;"'\)\]”»…][ \t\r]*$|[.!?] """
BARS = r"[ \t][|>»·•/][ \t]?"
SHOUT_MARKS = r"[!?]{2}"
BOILERPLATE = r"(?i)^[ \t]*(javascript is (disabled|required)|enable javascript|accept (all )?cookies|we use cookies|all rights reserved|skip to (main )?content|sign (in|up)|log ?in|subscribe( now)?|click here|read more|share (this|on)|back to top|privacy policy|terms of (use|service)|lorem ipsum)"
MOST_BARS, MOST_SHOUTS, MOST_SYMBOLS = 2, 2, 2


def _size(array) -> Column:
    return F.size(array).cast("long")


def _count(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def line_passes(line: Column) -> Column:
    """Whether a line that has a word stays. Counts of marks may grow with its length: so many, or one in ten characters / 60."""
    n = F.length(line)
    most = lambda least: F.greatest(F.lit(least), (n / 60).cast("int"))
    return (
        line.rlike(ENDS)
        & (_count(line, SYMBOLS) <= most(MOST_SYMBOLS))
        & (_count(line, BARS) <= most(MOST_BARS))
        & (_count(line, SHOUT_MARKS) <= most(MOST_SHOUTS))
        & ~line.rlike(BOILERPLATE)
    )


def quality(docs: DataFrame, *, text_col: str = "text", most_lost: float = MOST_LOST, out_col: str = "quality") -> DataFrame:
    """``docs`` and a struct ``quality`` of counts, verdicts and the cleaned text; a column of that name is replaced.

    Null and empty texts have no words and are rejected. Repeated rows each get their own; of an empty table there are no
    rows. Other columns stay, whatever their names. Texts of any length are judged whole, within one row. The counts:
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in 3-word windows that the text has twice or more),
    base_failed, lost (share of characters on failing lines), kept, cleaned.
    """
    own = [f"`{x}`" for x in docs.columns if x != out_col]
    prefix = "_"
    while any(x.lower().startswith(prefix) for x in docs.columns):
        prefix += "_"
    c = SimpleNamespace(**{x: prefix + x for x in "text words lines windows good again n chars symbols dup repeat left cleaned".split()})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    x = docs.select(*own, text.alias(c.text))
    x = x.select(*own, c.text, F.array_remove(F.split(c.text, SPACE), "").alias(c.words), F.filter(F.split(c.text, "\n", -1), lambda s: s.rlike(r"[^ \t-\r]")).alias(c.lines))
    at = lambda k: F.get(c.words, k)
    windows = F.when(F.size(c.words) < 3, F.expr("array()").cast("array<struct<h: bigint, i: int>>")).otherwise(
        F.sort_array(F.transform(F.slice(c.words, 1, F.greatest(F.size(c.words) - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, at(i + 1), at(i + 2)).alias("h"), i.alias("i"))))
    )
    x = x.select(*own, c.text, c.words, c.lines, windows.alias(c.windows), F.filter(c.lines, line_passes).alias(c.good))
    near = lambda k: F.get(c.windows, k)["h"]
    again = F.sort_array(F.transform(F.filter(c.windows, lambda s, k: F.coalesce(s["h"] == near(k - 1), F.lit(False)) | F.coalesce(s["h"] == near(k + 1), F.lit(False))), lambda s: s["i"]))
    x = x.select(*own, c.text, c.words, c.lines, c.good, again.alias(c.again))
    covered = F.aggregate(
        c.again,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).cast("long").alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    chars = lambda lines: F.length(F.regexp_replace(F.array_join(lines, ""), SPACE, ""))
    x = x.select(
        *own,
        _size(c.words).alias(c.n), F.length(F.array_join(c.words, "")).cast("long").alias(c.chars),
        F.regexp_count(c.text, F.lit(SYMBOLS)).cast("long").alias(c.symbols),
        (_size(c.lines) - _size(F.array_distinct(c.lines))).alias(c.dup), covered.alias(c.repeat),
        chars(F.col(c.good)).alias(c.left), F.array_join(c.good, "\n").alias(c.cleaned),
    )
    failed = (F.col(c.n) < MIN_WORDS) | (F.col(c.repeat) * 100 > F.col(c.n) * MOST_REPEATED)
    lost = F.when(F.col(c.chars) > 0, 1 - F.col(c.left) / F.col(c.chars)).otherwise(0.0)
    return x.select(
        *own,
        F.struct(
            F.col(c.n).alias("n_words"), F.col(c.chars).alias("word_chars"), F.col(c.symbols).alias("n_symbols"), F.col(c.dup).alias("n_dup_lines"),
            F.col(c.repeat).alias("n_repeat_words"), failed.alias("base_failed"), lost.alias("lost"), (~failed & (lost <= most_lost)).alias("kept"), F.col(c.cleaned).alias("cleaned"),
        ).alias(out_col),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; a null or empty text has zeros and is not kept."""
    found = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    count = lambda p: f"len(regexp_extract_all(s, {quoted(p)}))"
    most = lambda n: f"greatest({n}, (length(s) // 60))"
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) as ls from d),
p as (select r, generate_subscripts(ws, 1) as i, ws from w),
g as (select r, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from p where i + 2 <= len(ws)),
m as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from g) where n > 1),
q as (select r, count(distinct i + k) as n_repeat_words from m, (values (0), (1), (2)) as o(k) group by r),
l as (select r, sum(length(regexp_replace(s, '[ \\t-\\r]+', '', 'g'))) as chars from (select r, unnest(ls) as s from w)
  where regexp_matches(s, {quoted(ENDS)}) and {count(SYMBOLS)} <= {most(MOST_SYMBOLS)} and {count(BARS)} <= {most(MOST_BARS)} and {count(SHOUT_MARKS)} <= {most(MOST_SHOUTS)} and not regexp_matches(s, {quoted(BOILERPLATE)}) group by r),
f as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(chars, 0) as chars
  from w left join q using (r) left join l using (r)),
v as (select *, (n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * {MOST_REPEATED}) as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and (word_chars = 0 or 1 - chars::double / word_chars <= {MOST_LOST})) as kept from v
"""


OP2_SQL = _sql()
