"""Ranked search, importance resampling and HTML extraction against plain restatements and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from echoline.llm import html_text, importance, lexical

WORDS = [f"w{i}" for i in range(60)] + ["É漢", "x" * 3000, "9a"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS[: rng.randint(1, 63)]).upper() if rng.random() < 0.2 else rng.choice(WORDS) for _ in range(rng.randint(0, 80))), "t", 1) for i in range(300)]
    rows += [(300, None, "t", 1), (301, "", "t", 1), (302, "--- ... ---", "t", 1), (None, "w1 w2 É漢 " * 9, "t", 1), (7, "w3 " * 30, "t", 1), (7, "w3 " * 30, "t", 1), rows[0], rows[1]]
    rows += [(400 + i, "the same text w5 w6 w7 " * 6, "t", 1) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, term string, n int").repartition(5), [r[:2] for r in rows]


def tokens(pattern, text):
    return re.findall(pattern, "".join(c.lower() if c in lexical.UPPER else c for c in text or ""))


def test_ranked_search(spark, corpus):
    docs, rows = corpus
    items = [(1, "w1 W2 w2 É漢"), (2, None), (3, ""), (4, "unknown"), (5, "the same text w5 " + "x" * 3000), (5, "w3"), (6, " ".join(WORDS[:40]))]
    counted = [(i, Counter(tokens(lexical.TERM, t))) for i, t in rows]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n, total, df = len(counted), sum(x[2] for x in counted), Counter(t for _, c, _ in counted for t in c)
    want = []
    for item, text in items:
        scores = []
        for i, c, size in counted:
            m = 100 - 25 + (25 * size * n) // total
            parts = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in tokens(lexical.TERM, text) if t in c]
            if sum(parts) > 0:
                scores.append((-sum(parts), i is None, i or 0))
        want += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:20], 1)]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    assert Counter(map(tuple, lexical.search(docs, asked).collect())) == Counter(want)
    assert lexical.search(docs.limit(0), asked).count() == 0 and lexical.search(docs, asked.limit(0)).count() == 0


def test_pruning_loses_nothing(spark, monkeypatch):
    """With few first postings and small k the bounds do cut; the rows stay those of scoring everything."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"t{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(rng.randint(1, 60)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"t{min(int(rng.paretovariate(0.5)), 400)}" for _ in range(25))) for i in range(12)], "item_id long, text string")
    every = sorted(map(tuple, lexical.search(docs, items, k=600).where("rank <= 3").collect()))
    monkeypatch.setattr(lexical, "FIRST", 30)
    for share in (1, 4):
        monkeypatch.setattr(lexical, "SHARE", share)
        assert sorted(map(tuple, lexical.search(docs, items, k=3).collect())) == every


@pytest.mark.parametrize("runs", [1, 3])
def test_importance(spark, corpus, runs, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 2000)
    docs, rows = corpus
    target, buckets, least = ["w1 w2 w3 w4", None, "W5 w6"], 97, 20

    def features(text):
        w = tokens(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        return len(w), [zlib.crc32(" ".join(w[i : i + r]).encode()) % buckets for r in range(1, runs + 1) for i in range(len(w) - r + 1)]

    of_docs, of_target = Counter(f for _, t in rows for f in features(t)[1]), Counter(f for t in target for f in features(t)[1])
    big, small = of_docs.total() + buckets, of_target.total() + buckets
    gain = [math.floor(1000 * math.log((of_target[b] + 1) * big / ((of_docs[b] + 1) * small))) for b in range(buckets)]
    scored = []
    for i, t in rows:
        words, found = features(t)
        weight = sum(gain[f] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    able = sorted((r for r in scored if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for rank, r in enumerate(able[: 10 * len(able) // 100], 1):
        r[4] = rank
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), buckets=buckets, runs=runs)
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r[:5]) for r in scored)
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), none).count() == 0 and importance.resample(docs, none).where("rank IS NOT NULL").count() == 10 * len(able) // 100


CASES = {
    "": "", "plain a < b &lt; c &amp;amp; d": "plain a < b < c &amp; d", "<p>a<p>b<b>c</b>d<br>e</p>f": "a bcd e f",
    '<div class="ad">x<p>y</div><div>k</div>': "k", '<div class="has-sidebar"><article>A</article><aside>q</aside></div>': "A",
    'y <span class="ad"><span>in</span>no</span> z': "y z", "<p>x</p><!-- <p>open": "x", '<script>if(a<b){"</p>"}</script>z<style>': "z",
    "<p title=\"a>b\">t</p><a href='x'>l</a><p class=cookie-notice>n</p>": "t l", "<form><input>f<p>g</form>h": "h", "<form id=f><main>m</main>side</form>": "m",
    "<div id=comments><article>c</article></div><p>body</p>": "body", "<header>site</header><p>t</p>": "t", "<div hidden>h</div>k": "k",
    "<article><header>by</header><p>a&nbsp;\n b</p><section class='comments'><article>c</article></section><footer>f</footer></article>out": "by a b",
    "<article>one two</article><div>" + "long text " * 20 + "</div><article>x</article>": "one two " + "long text " * 20 + "x",
    "<ul><li>x<li>y<ul><li>z</ul></ul><table><tr><td>1<td>2<tr><td>3</table>t": "x y z 1 2 3 t", "<div>" * 5000 + "deep": "deep", "é&eacute;&#x4e00;&quot": 'éé一"',
    "a <a href='unfinished": "a",
}


@pytest.mark.parametrize("source", CASES)
def test_one_page(source):
    page = html_text.Page(source)
    assert " ".join(html_text.main_blocks(page.blocks, [n[1:] for n in page.nodes], page.mains, [])) == CASES[source].strip()


def test_odd_markup_takes_linear_time():
    for source in ("<a " * 200_000, "<!--" * 100_000, "<div>" * 20_000 + "x" + "</div>" * 20_000, '<a b="' * 50_000, "<div><b>" * 20_000 + "</i>" * 20_000, "<" * 300_000):
        html_text.Page(source)


def test_site_templates(spark):
    rng = random.Random(4)
    adverts = [f"Buy item {i} now" for i in range(4)]

    def page(i, body):
        return f"<html><body><div><div><b>Site of things</b></div><div>Home</div><p>News</p></div><div>{body}</div><div>{adverts[i % 4]}<p>Only today</p></div><p>All rights kept</p></body></html>"

    article = ["<p>" + " ".join(rng.choice(WORDS[:60]) for _ in range(12)) + "</p>" for _ in range(90)]
    shared = "<p>A licence line that many articles share with each other</p>"
    rows = [(i, f"http://big.example.com/{i}", page(i, "".join(article[2 * i : 2 * i + 2]))) for i in range(30)]
    rows += [(100 + i, "https://copy.example.com/x", f"<div>{article[70]}{article[71]}{article[72]}</div><p>shown {i} times</p>") for i in range(40)]  # copies are no template
    rows += [(200 + i, "http://marked.example.com", f"<article>{article[30 + i]}{shared}<div>Share this page</div></article>") for i in range(20)]
    rows += [(300, "http://alone.example.com", page(0, article[3])), (301, None, page(1, article[4])), (None, "not an address", page(2, article[5])), (302, "http://big.example.com/n", None), (0, "http://big.example.com/0", rows[0][2])]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, host string, k int").repartition(6)
    text = lambda x: re.sub(r"<[^>]*>", " ", x).split()
    for r in html_text.extract(df).collect():
        i = r.page_id
        assert r.n_chars == len(r.text)
        if i is None or i in (300, 301):
            assert "Home" in r.text and r.template_subtrees == 0
        elif i < 30:
            assert r.text.split() == text("".join(article[2 * i : 2 * i + 2])) and r.template_subtrees >= 5
        elif 100 <= i < 140:
            assert r.text.split() == [*text(article[70] + article[71] + article[72]), "shown", str(i - 100), "times"]
        elif 200 <= i < 220:
            assert r.text.split() == text(article[i - 170] + shared)
        else:
            assert r.text == ""
    assert html_text.extract(df).count() == len(rows) and html_text.extract(df.limit(0)).count() == 0
