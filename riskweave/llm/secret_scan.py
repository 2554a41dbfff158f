"""Secret scans: base patterns, and a guess-cost dynamic programme over values in a credential context.

The programme finds the cheapest way to guess a value, in powers of ten, as a sequence of dictionary words, dates,
repeated characters, keyboard walks and brute-force stretches. A value that stands after a credential word and costs at
least ``least_cost`` is a secret, whatever its letters; cheap ones (``password: changeme``) are placeholders. Only after a loose "is" (``the key is
understandable``) a value that could be a plain word is none. Time and memory grow linearly with
a value's length. A value is read whole: in quotes up to the closing one, and also where a base span holds a part of it, so
that spans together cover it. Every document is scanned whole, in the task that read it, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_field

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of fewer has no place in it where 24 stand together
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login")
# A quoted value goes to its closing quote, on its line; any other to the first mark that usually ends one.
_QUOTED = "|".join(rf"""{q}(?:bearer[ \t]{{1,4}})?((?:[^{q}\\\r\n]|\\.)++){q}""" for q in "\"'`")
CONTEXT = re.compile(
    r"""(?:(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret(?:[ _-]?key)?|(?:auth|access)?[ _-]?token|(?:api|private|access)[ _-]?key|credentials?|auth(?:orization)?|bearer|login)["']?[ \t]{0,8}(?::=|=>|->|[:=]|(?P<loose>[ \t]is[ \t]))[ \t]{0,8}"""
    r"""|(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*)"""  # whatever the base pattern takes, inside a word too
    rf"""(?:{_QUOTED}|["'`]?(?:bearer[ \t]{{1,4}})?([^\s"'`<>,;|(){{}}\[\]]+))""",
    re.A | re.I,
)
UNQUOTED = CONTEXT.groups
LEAST_COST, LEAST_LENGTH = 9.0, 6
LONGEST_LEAD = 32  # characters without white space from a credential word to its value, at most

# Words that passwords are made of, the most usual first; a word's rank is its number of guesses.
WORDS = (
    "password qwerty letmein welcome admin login dragon monkey master football baseball superman batman shadow sunshine princess "
    "trustno iloveyou hello freedom whatever starwars computer michelle jordan hunter ranger thomas robert soccer killer george "
    "pepper daniel access love secret summer winter spring autumn flower silver golden orange banana cheese coffee cookie pass user "
    "test guest root changeme default example sample dummy placeholder your token api key value string none null true false here "
    "insert enter foo bar baz my the and new old home work family money happy lucky magic angel tiger eagle falcon phoenix matrix "
    "internet server system network security private public manager office london paris berlin monday friday january march april "
    "june july august october november december red green blue black white yellow purple one two three four five "
    "required expired invalid missing unknown optional disabled enabled hidden redacted removed description information "
    "authentication authorization credentials username account accounts address service services application database "
    "administrator development production testing staging available undefined nothing something anything everything before "
    "after about other which their there would could should people because through between another without however important "
    "different following including question number program government company business group problem school state world "
    "country place point water night story right study book word fact month side kind head house page letter mother father "
    "friend brother sister child children woman person history change reason research moment teacher education health "
    "interest result morning community market policy process music member report minute mountain forest river ocean garden "
    "window table chair kitchen picture dinner breakfast lunch weather september february sunday saturday tuesday wednesday "
    "thursday yesterday tomorrow birthday holiday christmas always never sometimes together forever remember forgotten "
    "forgot changed generated generate encrypted encryption protected protection shared stored storage session request "
    "response message content settings config configuration connection connected identifier identity reference resource "
    "template variable variables environment function parameter parameters property properties integer boolean object array "
    "element attribute character characters strong weak simple complex random temporary permanent basic bearer digest oauth "
    "anonymous automatic automatically manual external remote local global domain support customer contact email phone "
    "mobile telephone website keyboard mouse screen printer software hardware update upgrade download upload document "
    "documents folder understanding understand knowledge learning training practice experience success failure happiness "
    "justice silence beauty courage wisdom patience honesty trust truth future present essential necessary possible "
    "impossible incorrect correct correctly wrong longer shorter minimum maximum length uppercase lowercase letters numbers "
    "numeric alphanumeric symbols special allowed forbidden denied granted accepted rejected verified unverified confirmed "
    "pending active inactive current previous existing original replaced replacement chocolate butterfly elephant dolphin "
    "penguin monkeys horse battery staple rainbow diamond crystal thunder lightning hurricane champion warrior knight "
    "basketball volleyball hockey tennis liverpool arsenal chelsea barcelona madrid america england germany france passwort "
    "kennwort benutzer geheim schluessel willkommen hallo contrasena usuario secreto bienvenido clave bonjour motdepasse "
    "secrete bienvenue utilisateur soleil"
).split()
KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@3105$7!", "aaeiosstl".ljust(9, "l")[:9])
_RANK = {w: k + 1 for k, w in reversed(list(enumerate(WORDS)))}
_LONGEST = max(map(len, WORDS))
_KEY_AT = {c: (r, k) for r, row in enumerate(KEYS) for k, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d", re.A)
SHORTEST_DATE, LONGEST_DATE = 4, 10
SEGMENT = log10(2)
LEAST_REPEAT, LEAST_WALK, WALK_STEP = 3, 4, log10(1.6)
_UNSAID = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}", re.I)


def _near(a: str, b: str) -> bool:
    p, q = _KEY_AT.get(a), _KEY_AT.get(b)
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else log10(26) if c.isascii() and c.isalpha() else log10(33)


def word_cost(own: str, lower: str, plain: str) -> float | None:
    """Of a dictionary word as it stands (``lower``: in lower case, ``plain``: without digits for letters); None: no word."""
    rank, extra = min(((r, x) for r, x in ((_RANK.get(lower), 0.0), (_RANK.get(plain), log10(2))) if r), key=lambda x: log10(x[0] + 1) + x[1], default=(0, 0.0))
    if not rank:
        return None
    case = 0.0 if own == lower else log10(2) if own.istitle() or own.isupper() else log10(2) * 3
    return SEGMENT + log10(rank + 1) + case + extra


def date_cost(length: int) -> float:
    return SEGMENT + (log10(365 * 120) if length > 4 else log10(120))


def repeat_cost(c: str, length: int) -> float:
    return SEGMENT + _brute(c) + log10(length)


def walk_cost(length: int) -> float:
    return SEGMENT + log10(47) + (length - 1) * WALK_STEP


def folded(value: str) -> tuple[str, str]:
    """The value in lower case, and that with letters for the digits and marks that stand for them; of equal length."""
    lower = value.lower()
    if len(lower) != len(value):  # a letter whose lower case is longer
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    return lower, lower.translate(LEET)


def guess_cost(value: str) -> tuple[float, list[tuple[str, int, int]]]:
    """Least log10 of guesses and the segments (kind, start, end) that reach it. The empty value costs nothing.

    Every segment that ends at a place is tried with each start that can be the best: words and dates by their bounded
    lengths; brute force and walks cost so much a character, so their cheapest start is carried along; a repeat's best
    start lies within a word's length of its run's, as what else ends inside the run is dearer a character than the repeat.
    """
    n = len(value)
    lower, plain = folded(value)
    cost, back = [0.0] * (n + 1), [("", 0)] * (n + 1)
    brute, brute_from, walk, walk_from = 0.0, 0, 0.0, -1
    run, keys = 0, 0  # starts of the runs of one character, and of neighbouring keys
    for i in range(1, n + 1):
        c = value[i - 1]
        fresh = cost[i - 1] + SEGMENT
        if i == 1 or fresh < brute:
            brute, brute_from = fresh, i - 1
        brute += _brute(c)
        best, how = brute, ("brute", brute_from)
        if i > 1 and c != value[i - 2]:
            run = i - 1
        for k in range(run, min(run + _LONGEST, i - LEAST_REPEAT) + 1):
            if (x := cost[k] + repeat_cost(c, i - k)) < best:
                best, how = x, ("repeat", k)
        if i > 1 and not _near(lower[i - 2], lower[i - 1]):
            keys, walk_from = i - 1, -1
        if i - keys >= LEAST_WALK:
            walk += WALK_STEP
            if walk_from < 0 or cost[i - LEAST_WALK] + walk_cost(LEAST_WALK) < walk:
                walk, walk_from = cost[i - LEAST_WALK] + walk_cost(LEAST_WALK), i - LEAST_WALK
            if walk < best:
                best, how = walk, ("walk", walk_from)
        for k in range(max(0, i - _LONGEST), i - 1):
            if ((lower[k:i] in _RANK) or (plain[k:i] in _RANK)) and (x := cost[k] + word_cost(value[k:i], lower[k:i], plain[k:i])) < best:
                best, how = x, ("word", k)
        if "0" <= c <= "9":
            for k in range(max(0, i - LONGEST_DATE), i - SHORTEST_DATE + 1):
                if "0" <= value[k] <= "9" and (x := cost[k] + date_cost(i - k)) < best and _DATE.fullmatch(value, k, i):
                    best, how = x, ("date", k)
        cost[i], back[i] = best, how
    parts, i = [], n
    while i:
        kind, k = back[i]
        parts.append((kind, k, i))
        i = k
    return cost[n], parts[::-1]


def base_spans(text: str, lower: str | None = None) -> list[tuple[str, int, int]]:
    """The base matches, leftmost and non-overlapping per kind, as (kind, start, end) in code points."""
    lower = text.lower() if lower is None else lower
    out = []
    if any(w in lower for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


class _Held:
    """Whether one of the spans holds all of a stretch."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        known = sorted(spans)
        self.starts, self.ends = [s for s, _ in known], list(accumulate((e for _, e in known), max))

    def __call__(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return k > 0 and self.ends[k - 1] >= end


def find_spans(text: str, least_cost: float = LEAST_COST) -> list[tuple[str, int, int, float | None]]:
    """All spans by start, then kind: the base ones (of ``assign`` with their value's cost), and the guess-cost ones of whole
    values, where no base span holds all of the value."""
    lower = text.lower()
    spans = [(*s, guess_cost(ASSIGN.match(text, s[1])[2])[0] if s[0] == "assign" else None) for s in base_spans(text, lower)]
    if any(w in lower for w in CONTEXT_WORDS):
        held = _Held((s, e) for _, s, e, _ in spans)
        at = 0
        while m := CONTEXT.search(text, at):
            s, e = m.span(m.lastindex)
            at = m.end()
            if m.lastindex == UNQUOTED:
                while e > s and text[e - 1] in ".,:;?":
                    e -= 1
            if held(s, e):
                at = max(m.start(m.lastindex), at - LONGEST_LEAD)  # its end may begin the next context
                continue
            if e - s >= LEAST_LENGTH and (cost := guess_cost(text[s:e])[0]) >= least_cost and not (m["loose"] and _like_a_word(text[s:e])):
                spans.append(("guess", s, e, cost))
            else:
                at = m.start(m.lastindex)  # what is no secret may hold a credential word
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _like_a_word(value: str) -> bool:
    """What may follow "is" in plain prose: letters of one case or a title's, that can be said (no five consonants in a row)."""
    return value.isalpha() and (value.islower() or value.isupper() or value.istitle()) and _UNSAID.search(value) is None


SPANS = "array<struct<kind: string, start: int, end: int, cost: double>>"


def scan_secrets(docs: DataFrame, *, text_col: str = "text", out_col: str = "secrets", least_cost: float = LEAST_COST) -> DataFrame:
    """``docs`` and an array of its spans (code points, end exclusive); none for a null or empty text.

    Repeated rows each get their own; an empty table stays empty. A text of any length is scanned whole, in time that grows
    with its length and its number of spans. A column named ``out_col`` is replaced, all others stay, whatever their names.
    """
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "cost"), s, strict=True)) for s in find_spans(t.as_py() or "", least_cost)] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(rows, with_field(docs, out_col, SPANS))


def redact(docs: DataFrame, *, text_col: str = "text", least_cost: float = LEAST_COST, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans become one mark. Nulls stay null, empty texts
    empty, repeated rows alike, other columns as they are; an empty table stays empty."""
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for _, s, e, _ in find_spans(text, least_cost):
            if s >= done:
                out += [text[done:s], mark]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(rows, docs.schema)


def digest(spans: list[tuple]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans, their digest, and all spans of every document; zeros and empty lists for a null or empty text."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    is_base = lambda s: s["kind"] != "guess"
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.filter("secrets", is_base)), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
