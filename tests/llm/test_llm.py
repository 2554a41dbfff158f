"""The training-data operators against brute force, on small tables with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from riskweave.llm import byte_bpe, decontaminate, html_template, jaccard_join, license_scan, quality_classifier, quality_rules, secret_scan, token_store, warc
from riskweave.llm.common import scratch_path

DOCS = "doc_id long, text string"
ODD = [(None, None), (900, None), (901, ""), (902, " \n\t "), (903, "x"), (903, "x"), (904, "é😀 " * 30), (905, "word " * 30_000)]
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "to") for b in ("ba", "de", "fi", "go", "hu")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:
            w = rnd.choice(texts).split()
            for _ in range(rnd.choice((0, 1, 1, 2, 5))):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            texts.append(" ".join(w))
        else:
            texts.append(prose(rnd, rnd.choice((3, 30, 60, 120))))
    return [*enumerate(texts), *ODD]


def brute_components(rows, size, percent):
    lower = {i: chr(i + 32) for i in range(65, 91)}
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(lower)) if x]
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    find = lambda x: x if group[x] == x else find(group[x])
    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k), i)) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, size, percent):
    rows = corpus()
    got = jaccard_join.jaccard_components(spark, spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", component_id string"), shingle=size, percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, size, percent)


def test_jaccard_hot_groups(spark):
    rnd = random.Random(5)
    base = prose(rnd, 60).split()
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(k % 3):
            w[rnd.randrange(60)] = f"u{k}"
        rows.append((k, " ".join(w)))
    got = jaccard_join.jaccard_components(spark, spark.createDataFrame(rows, DOCS).coalesce(1))  # more documents of a token in one chunk than are sent along
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, 4, 85)


def test_jaccard_empty_and_choice(spark):
    assert jaccard_join.jaccard_components(spark, spark.createDataFrame([], DOCS)).count() == 0
    t = np.unique(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64))
    assert (jaccard_join.unpack(jaccard_join.pack(t)) == t).all()
    assert jaccard_join.choose(np.array([2] * 10), 100, 85) == (0, 0) and jaccard_join.choose(np.full(100, 9), 100, 85)[0] > 1


def test_jaccard_chunks_of_a_task_that_runs_again(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_DOCS", 7)
    docs = spark.createDataFrame(corpus(), DOCS).selectExpr("doc_id", "xxhash64(text)", "text")
    batches = [pa.RecordBatch.from_pylist([r.asDict() for r in docs.collect()])]
    first, again = ([b.to_pylist() for b in jaccard_join._token_lists(4, 3)(batches)] for _ in range(2))
    assert first == again and len({r["chunk"] for b in first for r in b}) == len(first) > 10
    assert len({r["key"] for b in first for r in b if r["key"] < 0}) == len(first)
    lists = docs.repartition(3).mapInArrow(jaccard_join._token_lists(4, 3), jaccard_join.PACKED).select("chunk")
    names = [sorted(r.chunk for r in lists.collect()) for _ in range(2)]
    assert names[0] == names[1] and {c.split("-")[0] for c in names[0]} == {"0", "1", "2"}
    assert jaccard_join.settled(spark, docs, "x") is docs and "Exchange" not in jaccard_join.settled(spark, docs.repartition(3), "x")._jdf.queryExecution().executedPlan().toString()


def test_deduplicate_rows(spark):
    """Rows go by id and text: a text under an id that goes with another text stays; null ids come last."""
    rnd = random.Random(16)
    a, b, c, d = (prose(rnd, 60) for _ in range(4))
    near = a + " tail"
    rows = [(1, a), (5, a), (5, b), (None, a), (7, c), (7, c), (None, d), (None, d), (0, near), (8, None), (8, None), (9, ""), (9, " "), (None, None)]
    docs = spark.createDataFrame([(*r, r[0], "x") for r in rows], DOCS + ", text_hash long, least string")
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.deduplicate(spark, docs).collect()), key=str)
    assert kept == sorted([(0, near), (5, b), (7, c), (None, d), (8, None), (8, None), (9, ""), (9, " "), (None, None)], key=str)
    assert jaccard_join.deduplicate(spark, docs.limit(0)).count() == 0


def test_jaccard_common_token(spark):
    """One shingle in all documents, near copies among them."""
    rnd = random.Random(17)
    rows = []
    for k in range(150):
        w = prose(rnd, 40).split() if k % 3 or not rows else rows[rnd.randrange(len(rows))][1].split()[:-4] + [f"u{k}"]
        rows.append((k, " ".join([*w, *"one and the same".split()])))
    got = jaccard_join.jaccard_components(spark, spark.createDataFrame(rows, DOCS).repartition(7))
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, 4, 85)


def near_group(n, words, slots, edits):
    """Copies of one text, each with unlike words at some of the slots."""
    rnd, base, picks = random.Random(23), [f"w{k}" for k in range(words)], []
    while len(picks) < n:
        if (at := sorted(rnd.sample(slots, edits))) not in picks:
            picks.append(at)
    return [(k, " ".join(f"u{k}" if i in at else w for i, w in enumerate(base))) for k, at in enumerate(picks)]


def test_jaccard_near_group_makes_few_links(spark, monkeypatch):
    """Of a group in which all link, the pairs and links grow with its size and not with the square."""
    made, whole = {}, jaccard_join.materialize

    def counted(spark, df, name):
        out = whole(spark, df, name)
        made[name] = made.get(name, 0) + (out.count() if name in ("pairs", "links-found", "links") else 0)
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    monkeypatch.setattr(jaccard_join, "link_components", partial(jaccard_join.link_components, rounds=0))
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_ROW", 1)
    rows = near_group(150, 240, range(240), 2)
    got = jaccard_join.jaccard_components(spark, spark.createDataFrame(rows, DOCS))
    assert {r.component_id for r in got.collect()} == {0}
    assert 149 <= made["pairs"] < 20 * len(rows) and made["links-found"] < 20 * len(rows) and made["links"] < 40 * len(rows)


def test_jaccard_near_group_by_shares(spark, monkeypatch):
    """A group in which one pair in 25 links, over several shares and blocks."""
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_ROW", 1)
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 16)
    rows = near_group(120, 300, range(10, 290, 7), 4)
    got = jaccard_join.jaccard_components(spark, spark.createDataFrame(rows, DOCS), shingle=5, percent=80)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, 5, 80)


def test_warc(spark):
    big = "<p>é</p>" * 30
    rows = [(1, "http://a/%0A", big), (2, "u\nv", big), (3, None, "small"), (4, "w", "small"), (5, "x", None), (None, "y", big), (7, " z ", "\r\n\r\n" * 100)]
    folder = scratch_path(spark, "warc")
    index = warc.write(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = {r.key: r for r in warc.read(spark, index, folder).collect()}
    assert [got[k].record_type for k in (1, 2, 3, 4, 5, None, 7)] == ["response", "revisit", "response", "response", "response", "revisit", "response"]
    assert got[2].refers_to == 1 and got[2].payload_bytes == len(big.encode()) and got[2].payload is None and got[7].payload == b"\r\n\r\n" * 100
    assert got[1].payload_digest == hashlib.sha256(big.encode()).hexdigest() and got[1].url == "http://a/%0A" and got[2].url == "u%0Av" and got[5].payload == b""
    some = warc.read(spark, index.filter("key in (3, 7)"), folder).collect()
    assert {r.key for r in some} == {3, 7}


def test_quality_rules(spark):
    words = "alpha beta gamma delta. "
    rows = [(1, None), (2, ""), (3, prose(random.Random(2), 60) + "."), (4, words * 20), (5, "\n".join(f"Home {k} | About {k} | News {k} | Contact {k} | Shop {k}" for k in range(20)))]
    got = {r.doc_id: r.quality for r in quality_rules.quality(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", quality int")).collect()}
    assert not got[1].kept and got[1].n_words == 0 and got[3].kept and got[4].base_failed and got[4].n_repeat_words == 80 and not got[5].base_failed and not got[5].kept
    for d, t in rows:
        w = (t or "").split()
        seen = {}
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        assert got[d].n_repeat_words == len({p + o for v in seen.values() if len(v) > 1 for p in v for o in range(3)})
        assert got[d].n_words == len(w) and got[d].word_chars == sum(map(len, w))


def test_licenses(spark):
    rows = [(1, "Released under the MIT License. CC-BY? Apache license; apache LICENSE"), (2, None), (3, "gnu general\npublic license"), (4, "mitlicense mit licenses"), (5, "x " * 500 + license_scan.TEMPLATES[3][1] + " y" * 500)]
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    assert [(p.label, p.word) for p in got[1].places] == [("mit", 3), ("cc-by", 5), ("apache", 7), ("apache", 9)]
    assert got[2].n_words == 0 and [p.label for p in got[3].places] == ["gpl"] and not got[4].places and {b.label for b in got[5].blocks} == {"mit"}
    join = license_scan.TemplateJoin(license_scan.TEMPLATES, 0.8, {})
    vocabulary, rnd = sorted(join.rank), random.Random(3)
    for _ in range(300):
        block = set(rnd.sample(vocabulary, rnd.randrange(1, 30))) | set(license_scan.folded(rnd.choice(license_scan.TEMPLATES)[1]).split()[: rnd.randrange(1, 40)])
        want = [(label, len(t & block) / len(t)) for label, x in license_scan.TEMPLATES if len((t := set(license_scan.folded(x).split())) & block) >= 0.8 * len(t) - 1e-9]
        assert sorted(join.block(block)) == sorted(want)


def test_license_blocks_against_brute_force(spark):
    rnd = random.Random(15)
    words = [f"w{k}" for k in range(60)]
    templates = tuple((f"t{k}", " ".join(rnd.choice(words) for _ in range(n))) for k, n in enumerate((3, 8, 20, 61, 110, 130, 400)))
    rows = []
    for k in range(40):
        parts = [rnd.choice([*words, *["zz", "cc", "by"] * 20]) for _ in range(rnd.randrange(600))]
        at = rnd.randrange(len(parts) + 1)
        parts[at:at] = templates[k % 7][1].split()
        rows.append((k, "".join(w + rnd.choice("   \n-") for w in parts)))
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows + ODD[1:], DOCS).selectExpr("*", "1 as licenses"), templates=templates).collect()}
    for d, text in rows:
        lines = [[w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", line) if w] for line in text.lower().split("\n")]
        all_words, want = [w for line in lines for w in line], set()
        starts = np.cumsum([0, *map(len, lines)]).tolist()
        for label, t in templates:
            n, size, goal = len(t.split()), 120, set(t.split())
            while size < 2 * n:
                size *= 2
            blocks = [*zip(starts, lines), *((a, all_words[a : a + size]) for a in range(0, max(1, len(all_words) - size // 2), size // 2))]
            want |= {(label, a, len(b), len(goal & set(b)) / len(goal)) for a, b in blocks if len(goal & set(b)) >= 0.9 * len(goal) - 1e-9}
        assert {tuple(b) for b in got[d].licenses.blocks} == want and f"t{d % 7}" in {b[0] for b in want}
        assert [p.word for p in got[d].licenses.places] == [k for k in range(len(all_words)) if all_words[k : k + 2] == ["cc", "by"]]
    none = license_scan.scan_licenses(spark.createDataFrame(rows[:2], DOCS), templates=()).collect()
    assert all(not r.licenses.blocks for r in none) and license_scan.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_html_salted(spark, monkeypatch):
    rows = [(k, f"http://h.org/{k}", f"<div class=top>Site</div><div class=c><p>text {k} {'word ' * 30}</p></div>") for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = sorted(html_template.extract(pages).collect())
    monkeypatch.setattr(html_template, "BROADCAST_TOKENS", 0)
    assert sorted(html_template.extract(pages).collect()) == plain and plain[0].text.startswith("text 0")


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one\n two<p>three<br></article><div id=comments>no</div><footer>f</footer>"
    assert html_template.main_text(page) == "A & B\none two\nthree"
    assert html_template.main_text("") == "" and html_template.main_text("plain <b>text</b> &lt;") == "plain text <" and html_template.main_text("<p>cut <") == "cut"
    rows = [(k, f"http://h.org/{k}", f"<html><body><div class=top>Site</div><div class=c><p>text {k} {'word ' * 30}</p></div><div class=b>Imprint</div></body></html>") for k in range(30)] + [(99, None, None)]
    got = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()}
    assert got[99] == "" and all(got[k] == f"text {k} " + "word " * 29 + "word" for k in range(30))
    assert len(html_template.main_text("<div>" * 5000 + "x" * 100_000)) == 100_000


def test_html_long_template_texts(spark):
    note = "We keep what you tell us for as long as the law of the land asks. " * 6
    rows = [(k, f"http://h.org/{k}", f"<div class=x><p>{note}</p></div><div class=c><p>text {k} {'word ' * 60}</p><p>{k} {'more ' * 60}</p></div>") for k in range(30)]
    got = html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"text {r.page_id} {'word ' * 60}".strip() + "\n" + f"{r.page_id} {'more ' * 60}".strip() for r in got)


def plain_site(host, n, rnd):
    """Pages without telling elements: a menu, a title, paragraphs with a label after each, sometimes a notice, a foot."""
    rows = []
    for k in range(n):
        body = [f"{k} " + prose(rnd, 30) for _ in range(rnd.randrange(1, 5))]
        menu = "".join(f"<div class=z{j}><a href=/{j}>{prose(rnd, 1)}</a></div>" for j in range(rnd.randrange(3, 6)))
        notice = f"<div class=q><p>{'We keep what you tell us. ' * 12}</p></div>" if k % 5 < 3 else ""
        title = f"About {k} {prose(rnd, 2)}"
        page = f"<body><div class=a>{menu}</div>{notice}<div class=b><h1>{title}</h1>{''.join(f'<p>{x}</p><i>Told by us</i>' for x in body)}</div><div class=c>Imprint <a href=/i>here</a></div></body>"
        rows.append((f"http://{host}/{k}", page, "\n".join([title, *body])))
    return rows


def test_html_template_decides(spark):
    rnd = random.Random(11)
    rows = plain_site("h.org", 40, rnd) + [("http://h.org/e", "<h2>Not found</h2>", "Not found"), ("http://h.org/n", None, ""), ("http://h.org/b", " \n", ""), ("http://few.org/1", "<div class=a>x</div><p>y", "x\ny")]
    pages = spark.createDataFrame([(k, u, p, 1, "c") for k, (u, p, _) in enumerate(rows)], "page_id long, url string, html string, text int, host string")
    got = {r.page_id: r for r in html_template.extract(pages).collect()}
    assert {k: r.text for k, r in got.items()} == {k: t for k, (_, _, t) in enumerate(rows)} and got[0].host == "c"
    alone = {k: html_template.main_text(p or "") for k, (_, p, _) in enumerate(rows)}
    assert all("Imprint" in alone[k] and "Told by us" in alone[k] and alone[k] != got[k].text for k in range(40))
    assert html_template.extract(pages.limit(0)).count() == 0


def test_html_classes_against_brute_force(spark):
    rnd = random.Random(12)
    rows = []
    for h in range(4):
        bits = [f"<div class=k{j}>{prose(rnd, 2)}</div>" for j in range(8)]
        rows += [(f"http://{h}.org/{k}", "".join(rnd.choice(bits) * rnd.randrange(3) for _ in range(10)) + f"<p>{prose(rnd, 40)}</p>" + "<u><div>always</div></u>") for k in range(12)]
    rows += rows[:6]
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: set(r.texts) for r in html_template.templates(pages, "url", "html").collect()}
    for h in range(4):
        own = [p for u, p in rows if u.startswith(f"http://{h}.org/")]
        counts = [Counter([(1, t.token) for t in x[0]] + [(2, b.token) for b in x[1]]) for x in map(html_template.read_page, own)]
        classes = {}
        for token in set().union(*counts):
            classes.setdefault(tuple(c[token] for c in counts), []).append(token)
        valid = [tokens for v, tokens in classes.items() if len(tokens) > 1 and any(k == 1 for k, _ in tokens) and 2 * sum(map(bool, v)) >= len(own) and len({p for p, n in zip(own, v) if n}) >= 5]
        assert got[f"{h}.org"] == {t for tokens in valid for k, t in tokens if k == 2}


def test_html_copies_are_no_template(spark):
    """Most pages of a host are copies of one article, or nearly: its text stays."""
    rnd = random.Random(13)
    body = "".join(f"<p>{prose(rnd, 30)}</p>" for _ in range(4))
    rows = [(k, f"http://h.org/{k}", f"<div class=m><h1>Title</h1>{body}<p>{k}</p></div>") for k in range(12)] + [(k, f"http://g.org/{k}", f"<h1>One</h1>{body}") for k in range(12)]
    for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text.count("\n") >= 4


def test_html_odd_pages():
    text = html_template.main_text
    assert text("<article><div class='search-engine'>a</div><p class=share-price>b<p id=side-effects>c<div class='share-buttons'>no</div><div class=cookieBanner>no</div></article>") == "a\nb\nc"
    assert text("<p data-a=it's>Hello it's</p>") == "Hello it's" and text('<p>a<a href="x>y</a> b</p>tail') == "ay b\ntail" and text("<p>1 < 2</p><") == "1 < 2"
    began = time.time()
    for page in ('<a b="' * 50_000, "<a " * 100_000, "<div>" * 20_000 + "</b>" * 20_000, "<b>" * 5_000 + "<div>" * 5_000 + "</b>" * 5_000, "<script>" * 50_000, "<!--" * 100_000, "</" * 100_000, "<p title='>" * 50_000, "x" * 1_000_000):
        text(page)
    assert time.time() - began < 20


def test_secrets(spark):
    text = "password = hunter22secret; token:abc AKIA" + "A" * 16 + " " + "0a" * 12 + ' pwd: "Xk9$vLq2!zQ" login is changeme'
    spans = secret_scan.find_spans(text)
    assert [s[0] for s in spans] == ["assign", "access", "hex", "guess"] and text[spans[3][1] : spans[3][2]] == "Xk9$vLq2!zQ"
    assert secret_scan.find_spans("") == [] and secret_scan.guess_cost("")[0] == 0
    for value in ("password1", "qwerty123", "aaaaaaaa", "2024-01-02"):
        cost, parts = secret_scan.guess_cost(value)
        assert cost < 6 and parts[0][1] == 0 and parts[-1][2] == len(value)
    assert secret_scan.guess_cost("İ" * 20_000)[0] > 0
    out = {r.doc_id: r.text for r in secret_scan.redact(spark.createDataFrame([(1, text), (2, None), (3, "")], DOCS)).collect()}
    assert "hunter22" not in out[1] and out[2] is None and out[3] == ""
    assert secret_scan.scan_secrets(spark.createDataFrame(ODD, DOCS)).count() == len(ODD)


def reference_cost(value):
    """The least cost over all ways to cut the value, each segment priced by itself."""
    lower, plain = secret_scan.folded(value)
    cost = [0.0] + [float("inf")] * len(value)
    for i in range(1, len(value) + 1):
        for k in range(i):
            prices = [secret_scan.SEGMENT + sum(map(secret_scan._brute, value[k:i]))]
            if i - k >= secret_scan.LEAST_REPEAT and len(set(value[k:i])) == 1:
                prices.append(secret_scan.repeat_cost(value[k], i - k))
            if i - k >= secret_scan.LEAST_WALK and all(map(secret_scan._near, lower[k:i], lower[k + 1 : i])):
                prices.append(secret_scan.walk_cost(i - k))
            if i - k > 1 and (word := secret_scan.word_cost(value[k:i], lower[k:i], plain[k:i])) is not None:
                prices.append(word)
            if secret_scan._DATE.fullmatch(value, k, i):
                prices.append(secret_scan.date_cost(i - k))
            cost[i] = min(cost[i], cost[k] + min(prices))
    return cost[-1]


def test_guess_cost_is_least():
    rnd = random.Random(14)
    bit = lambda: rnd.choice([
        lambda: rnd.choice(secret_scan.WORDS), lambda: rnd.choice(secret_scan.WORDS).title(), lambda: rnd.choice("a1x!s0") * rnd.randrange(1, 20),
        lambda: rnd.choice(secret_scan.KEYS)[(k := rnd.randrange(6)) : k + rnd.randrange(2, 8)], lambda: f"{rnd.randrange(1890, 2040)}{rnd.choice(['', '-', '/'])}{rnd.randrange(1, 13):02}",
        lambda: f"{rnd.randrange(1, 32)}.{rnd.randrange(1, 13)}.{rnd.randrange(100):02}", lambda: "".join(rnd.choice("aeiouqwx19$@") for _ in range(rnd.randrange(1, 5))),
    ])()
    for value in ["cookie1234rtyu", *("".join(bit() for _ in range(rnd.randrange(1, 5))) for _ in range(4_000))]:
        cost, parts = secret_scan.guess_cost(value)
        assert cost == pytest.approx(reference_cost(value), abs=1e-9) and [p[1] for p in parts] == [0, *(p[2] for p in parts[:-1])]
    assert secret_scan.guess_cost("-" * 50_000)[0] < 10


def test_secrets_planted(spark):
    """What the method adds in contexts that the base patterns do not read, and what it leaves."""
    planted = {
        "login: Xk9vLq2zQ7": "Xk9vLq2zQ7", "my credentials = vT7#pLm2@xQ": "vT7#pLm2@xQ", "Authorization: Bearer q8Zt.4Lmx-92Kd": "q8Zt.4Lmx-92Kd", "private key => `zR8 kk2 Lp0 w`": "zR8 kk2 Lp0 w",
        "access token -> u7Yh2Nw9": "u7Yh2Nw9", "pwd='qmzrtkvbxwplha'": "qmzrtkvbxwplha", "passcode: 8f3kq0z1": "8f3kq0z1", "pass: hunter1": None, "login: password123": None, "auth = 2024-01-02": None, "pwd: qwertyuiop": None, "no context Xk9vLq2zQ7": None,
    }
    docs = spark.createDataFrame([(k, "Before it. " + t + " , after") for k, t in enumerate(planted)], DOCS)
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs.withColumn("secrets", docs.doc_id)).collect()}
    for k, want in enumerate(planted.values()):
        assert [got[k].text[s.start : s.end] for s in got[k].secrets if s.kind == "guess"] == ([want] if want else [])
    text = "pwd: Xk9vLq2zQ7 " * 4_000
    assert len(secret_scan.find_spans(text)) == 4_000
    for r in spark.createDataFrame(corpus() + [(999, text)], DOCS).transform(secret_scan.scan_secrets).collect():  # the base patterns as stated
        base = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r.text or "", re.A | re.I) if len(m[2]) >= 6]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", r.text or "") if len(m[0]) >= 20] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", r.text or "") if len(m[0]) >= 24]
        assert sorted(base) == sorted((s.kind, s.start, s.end) for s in r.secrets if s.kind != "guess")


def test_secrets_whole_values(spark):
    for text, value in (
        ('password: "Summer19!kQ#77z" x', "Summer19!kQ#77z"), ("token = Summer19!kQ#77z x", "Summer19!kQ#77z"), ('pwd: "Xk9,vLq2!zQ" x', "Xk9,vLq2!zQ"),
        ("dbPassword: 'Summer19; kQ#(77z)' x", "Summer19; kQ#(77z)"), ('secret is password: "Summer19!kQ#77z" x', "Summer19!kQ#77z"), ('pwd: "Xk9|vLq2!zQ', "vLq2"),
    ):
        out = secret_scan.redact(spark.createDataFrame([(1, text)], DOCS)).first().text
        spans = secret_scan.find_spans(text)
        if text.endswith(" x"):
            assert out.endswith(("[secret] x", '[secret]" x', "[secret]' x")) and value in {text[s:e] for k, s, e, _ in spans if k == "guess"}
        else:
            assert spans == []  # a quote that never closes
    assert [s[0] for s in secret_scan.find_spans('password: "hunter22secret"')] == ["assign"]


def test_secrets_of_letters():
    for text in ("pwd: qmzrtkvbxwplha", "bearer: QMZRTKVBXWPLHA", "passphrase = Qmzrtkvbxwplha", "the password is qmzrtkvbxwplha"):
        assert [(s[0], text[s[1] : s[2]].lower()) for s in secret_scan.find_spans(text)] == [("guess", "qmzrtkvbxwplha")]
    for text in ("pwd: understanding", "auth: required", "login: AUTHENTICATION", "the key is understandable", "the key is Perseverance"):
        assert secret_scan.find_spans(text) == []


def test_classifier(spark):
    rnd = random.Random(4)
    rows = [(k, prose(rnd, 40) + "." if k % 3 else " ".join(w + "***" for w in prose(rnd, 40).split())) for k in range(400)]
    docs = spark.createDataFrame([*rows, *ODD], DOCS)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(400)] + [(None, 1), (5, None)], "doc_id long, quality int")
    weights = quality_classifier.train(spark, docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, weights).collect()}
    assert all((got[k] >= 0.3) == (k % 3 > 0) for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0) and 0 < got[901] < 1
    empty = quality_classifier.train(spark, docs, labels.limit(0))
    assert quality_classifier.score(docs.limit(3), empty).first().score == 0.5


def test_classifier_fits_whole_texts(spark):
    rows = [(k, "same " * 2500 + ("good tail " if k % 2 else "junk### end### ") * 50) for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = quality_classifier.train(spark, docs, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, weights).collect()}
    assert min(got[k] for k in got if k % 2) > max(got[k] for k in got if k % 2 == 0)


def test_decontamination(spark):
    rnd = random.Random(6)
    items = [(k, prose(rnd, 20) + ". " + prose(rnd, 10) + ".") for k in range(30)] + [(90, None), (91, ""), (92, "tiny")]
    rows = [(k, prose(rnd, 100) + (" " + items[k][1] + " " if k < 30 else " ") + prose(rnd, 100)) for k in range(60)] + ODD
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, docs, bench).collect()}
    assert got == {(k, k) for k in range(30)}
    assert decontaminate.leaks(spark, docs, bench.limit(0)).count() == 0 and decontaminate.leaks(spark, docs.limit(0), bench).count() == 0
    # every pair at the threshold is retrieved: against scores of all pairs
    index = next(decontaminate._indexes(spark, bench, "item_id", "text", 0.3))
    passages = [decontaminate.words_of(t)[:60] for _, t in rows[:40]]
    keys = sorted({(p, index.vocabulary[w]) for p, ws in enumerate(passages) for w in ws if w in index.vocabulary})
    found = {(p, i) for p, i, _ in index.search(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), len(passages))}
    score = np.zeros((len(passages), len(index.ids)))
    for p, t in keys:
        a, b = index.starts[t], index.starts[t + 1]
        score[p, index.item[a:b]] += index.impact[a:b]
    assert found == {(int(p), int(i)) for p, i in zip(*np.nonzero(score >= 1 - 1e-9), strict=True)}


def uneven(rnd, words, n):
    """Of the words, few are common and most are rare."""
    return " ".join(words[int(len(words) * rnd.random() ** 3)] for _ in range(n))


def benchmark_index(rnd, items, words, ratio):
    texts = [uneven(rnd, words, rnd.randrange(20, 45)) + ". " + uneven(rnd, words, 12) + "." for _ in range(items)]
    cut = [decontaminate.words_of(t) for t in texts]
    df = Counter(w for c in cut for w in set(c))
    return texts, decontaminate.Bm25Index([*enumerate(texts)], items, df, sum(map(len, cut)) / items, ratio)


def test_decontamination_against_all_pairs():
    """Of texts together and one by one, every pair is found that scores of all passages and items give, with its shares."""
    rnd = random.Random(23)
    words = [f"{w}{k}" for k in range(40) for w in WORDS]
    items, index = benchmark_index(rnd, 150, words, 0.4)
    texts = ["", None, " \n", "é😀 " * 30, *(" ".join([uneven(rnd, words, 150), *items[k].split()[: 60 - k], uneven(rnd, words, rnd.choice((0, 90)))]) for k in range(30)), " ".join(items[30:50])]
    want = {}
    for k, text in enumerate(texts):
        own, half = decontaminate.words_of(text), index.longest
        for a in range(0, max(1, len(own)), half):
            passage = own[a : a + 2 * half]
            score = np.zeros(len(items))
            for w in set(passage) & set(index.vocabulary):
                at = slice(*index.starts[index.vocabulary[w] :][:2])
                score[index.item[at]] += index.impact[at]
            for item in np.flatnonzero(score >= decontaminate.LEAST).tolist():
                q, e = (decontaminate.share(part, {}, passage) for part in index.parts[item])
                if q >= 0.3 and e >= 0.3:
                    want[k, item] = max(want.get((k, item), (0.0, 0.0, 0.0)), (q, e, score[item]))
    want = [(k, item, s, q, e) for (k, item), (q, e, s) in sorted(want.items())]
    got = decontaminate._leaks(texts, index, 0.3, 0.3)
    single = [(k, *found[1:]) for k, t in enumerate(texts) for found in decontaminate._leaks([t], index, 0.3, 0.3)]
    assert len(want) > 30 and [w[:2] for w in want] == [g[:2] for g in got] == [g[:2] for g in single]
    assert np.allclose(want, got) and np.allclose(want, single)


def test_decontamination_look_ups(monkeypatch):
    """A passage without an item costs far less than looking each of its words up in each block."""
    rnd, places, done = random.Random(24), decontaminate._places, []
    words = [f"{w}{k}" for k in range(100) for w in WORDS]
    _, index = benchmark_index(rnd, 200, words, decontaminate.RATIO)
    texts = [uneven(rnd, words, 8 * index.longest) for _ in range(40)]
    monkeypatch.setattr(decontaminate, "_places", lambda starts, n: done.append(int(n.sum())) or places(starts, n))
    assert decontaminate._leaks(texts, index, 0.6, 0.5) == []
    assert 0 < sum(done) < 25 * len(texts) * 8 * index.blocks


def test_byte_bpe(spark):
    import tiktoken

    path, pattern = byte_bpe.default_tokenizer()
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    rnd = random.Random(7)
    rows = [*ODD, *((k, "".join(rnd.choice("abcdefgh  ,.'\n0123éß日😀s") for _ in range(rnd.randrange(200)))) for k in range(200)), (999, "abcdefghij" * 100)]
    got = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", ids int"))).collect()
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=str) == sorted(((i, public.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)


def test_byte_bpe_round_trip(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in [*corpus(), (77, "é😀 " * 30)]], DOCS + ", ids int, decoded int")
    one = sorted((r.doc_id or -1, r.ids, bytes(r.decoded)) for r in byte_bpe.round_trip(docs).collect())
    assert one == sorted((r.doc_id or -1, r.ids, bytes(r.decoded)) for r in byte_bpe.decode(byte_bpe.encode(docs)).collect())
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0


def test_byte_bpe_long_pieces(monkeypatch):
    import tiktoken

    path, pattern = byte_bpe.default_tokenizer()
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    rnd = random.Random(9)
    bpe = byte_bpe.ByteBpe(path, pattern)
    texts = ["-" * 100_000, "日本語漢字" * 7_000, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9_000)), " ".join("".join(rnd.choice("etaoinsh") for _ in range(100)) for _ in range(4_000))]
    for text in texts:
        assert bpe.encode([text]).values.to_pylist() == public.encode_ordinary(text)
    monkeypatch.setattr(byte_bpe, "LONG_PIECE", 1)
    monkeypatch.setattr(byte_bpe, "STEP_SQUARES", 0)  # every piece by bounded queries
    for letters in ("ab", "aeinst", "-=", "étà日", "abcdefghijklmnopqrstuvwxyz"):
        text = " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 120))) for _ in range(25))
        assert bpe.encode([text]).values.to_pylist() == public.encode_ordinary(text)


def test_token_store(spark):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(token_store.default_tokenizer())
    rows = [*((k * 7, t) for k, t in corpus()[:100]), *ODD, (5000, "<|endoftext|>. A<|ENDOFTEXT|>, b.c")]
    docs = spark.createDataFrame(rows, DOCS)
    store = token_store.TokenStore.write(spark, docs)
    got = sorted(((r.key, r.start, r.n_tokens, r.ids_crc32) for r in store.read(docs, "doc_id").collect()), key=lambda r: r[1])
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*public.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(list(store.get(903))) == 2 and list(store.get(123456)) == [] and next(store.get(None)).tolist() == [2]
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    keys = np.unique(keys)
    assert sorted(token_store.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))


def test_token_store_keys(spark):
    """The least id beside null, a key of more rows than a shard holds, a store opened again, an empty one, clashing columns."""
    rows = [(None, "a b"), (-(2**63), "c"), *((4, f"w{k % 7} x") for k in range(3000)), (9, None), (9, ""), (10, "y " * 50_000)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], DOCS + ", key long, shard string")
    store = token_store.TokenStore(spark, token_store.TokenStore.write(spark, docs, shards=5).folder)
    assert len(store.names) > 2 and [x.tolist()[-1] for x in store.get(None)] == [2] and len(list(store.get(-(2**63)))) == 1 and len(list(store.get(4))) == 3000
    got = sorted((r.start, r.key, r.n_tokens) for r in store.read(docs.selectExpr("doc_id as key"), with_ids=False).collect() if r.key is not None)
    assert [g[1] for g in got] == sorted(i for i, _ in rows if i is not None) and all(a[0] + a[2] == b[0] for a, b in zip(got[:-1], got[1:], strict=True))
    assert sorted(len(x) for x in store.get(4)) == sorted(g[2] for g in got if g[1] == 4)
    assert [r.key for r in store.read(docs.filter("doc_id is null"), "doc_id").collect()] == [None]
    empty = token_store.TokenStore.write(spark, docs.limit(0))
    assert empty.read(docs, "doc_id").count() == 0 and list(empty.get(4)) == [] and list(empty.get(None)) == []


def test_token_store_other_tokenizers():
    """A tokenizer that keeps white space and case is given whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(18)
    texts = ["".join(rnd.choice("aB é.,;'s<|>1\n ") for _ in range(rnd.randrange(120))) for _ in range(300)] + ["<|endoftext|>. A<|ENDOFTEXT|>, b.c"]
    for name, by_word in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        encoder, public = token_store.WordEncoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        assert encoder.by_word == by_word
        for _ in range(2):
            assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode([t.encode() for t in texts])] == [public.encode(t, add_special_tokens=False).ids for t in texts]


def test_decontamination_stage_rows(spark, tmp_path):
    """What leaks goes, with an id or without; another text under the same id stays."""
    import corpus_pipeline

    rnd = random.Random(19)
    item, other = prose(rnd, 25) + ". " + prose(rnd, 8) + ".", prose(rnd, 60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, item, 1), (3, item, 1), (3, other, 1), (None, other, 1), (4, None, 1)], DOCS + ", text_hash int")
    got = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, other), (None, other), (4, None)], key=str)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_empty_tables_and_clashing_columns(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = scratch_path(spark, "warc")
    assert warc.read(spark, warc.write(spark, pages, folder), folder).count() == 0
    docs = spark.createDataFrame([(1, "some words here. " * 20, 2, 3, 4)], DOCS + ", _text int, _n int, _words int")
    got = quality_rules.quality(docs).first()
    assert (got._text, got._n, got._words, got.quality.n_words) == (2, 3, 4, 60) and quality_rules.quality(docs.limit(0)).count() == 0
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0 and byte_bpe.decode(byte_bpe.encode(docs.limit(0))).count() == 0
    assert quality_classifier.score(docs.limit(0), np.zeros(5, np.float32)).count() == 0
    more = spark.createDataFrame([(1, "u", "<p>x" * 100_000, "k", 5, 6)], "page_id long, url string, html string, key string, digest int, first int")
    folder = scratch_path(spark, "warc")
    assert warc.read(spark, warc.write(spark, more, folder), folder).first().payload_bytes == 400_000
    item = spark.createDataFrame([(1, "what is the long road to the sea called. the sand way.")], "item_id long, text string")
    leak = decontaminate.leaks(spark, spark.createDataFrame([(5, item.first().text, 7, "s")], DOCS + ", item_id int, question string"), item).first()
    assert (leak.doc_id, leak.item_id, leak.question) == (5, 1, "s")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(8)
    good = [prose(rnd, 60) + "." for _ in range(150)]
    item = prose(rnd, 25) + ". " + prose(rnd, 8) + "."
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(good)] + [(200 + k, " ".join(w + "###" for w in good[k].split()), "en", "s", 1) for k in range(60)]
    docs += [(300, good[3], "en", "s", 1), (301, good[4] + " " + item, "en", "s", 1), (302, good[5].replace(".", " token = abcdef0123456789abcdef01."), "en", "s", 1), (303, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], int(d[0] < 200)) for d in docs if d[0] < 300], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(150)) <= set(out) | {5} and not set(out) & {300, 301, *range(200, 260)} and all(r.exact for r in out.values())
    assert out[0].n_tokens == len(out[0].ids) > 0
    stage = corpus_pipeline.secret_stage(spark, spark.createDataFrame(docs[-2:-1], "doc_id long, text string, lang string, source string, n_chars long"), "").first()
    assert "abcdef0123" not in stage.text and stage.n_chars == len(stage.text)
