"""Ranked search, clustering and HTML extraction against brute force; test_operators.py holds the first two against SQL."""

from __future__ import annotations

import hashlib
import html as entities
import itertools
import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from trovesift.llm import clustering, html_extract, ranked_search
from trovesift.llm.page_samples import labelled_page


# Ranked search


def ranked(docs, items, most):
    """Brute force: [(place of the item, rank, doc_id, score)]."""
    words = lambda t: [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    out = []
    for k, (_, text) in enumerate(items):
        scores = []
        for i, c in counted:
            m = 75 + (25 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in d for _, d in counted) + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text))
            if score > 0:
                scores.append((-score, (i is not None, i or 0), i))
        out += [(k, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:most], 1)]
    return out


def test_ranking_by_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["the", "Ein", "é1", "x" * 300, "x" * 299 + "y", "ab", "ABC", "日本", "a_b", "z9"]
    text = lambda n: " ".join(rng.choice(vocabulary, n)) if n else ""
    docs = [(int(i), text(int(rng.integers(0, 30)))) for i in range(60)]
    docs += [(None, "ein abc"), (None, "ein abc"), (7, docs[7][1]), (90, None), (91, " .,-_ "), (92, "the " * 5000)]
    items = [(i, text(int(n))) for i, n in enumerate((0, 1, 3, 8, 20))] + [(3, "abc ein ein"), (None, "ABC"), (8, None), (9, "nowhere")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int").repartition(5)
    for most in (1, 4, 1000):
        got = ranked_search.rank_documents(frame, spark.createDataFrame(items, "item_id long, text string"), most).collect()
        want = Counter((items[k][0], r, i, s) for k, r, i, s in ranked(docs, items, most))
        assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == want and got


def test_ranking_in_blocks_and_parts(spark, monkeypatch):
    docs = [(i, " ".join(f"w{i * k % 11}" for k in range(i % 9 + 1))) for i in range(80)]
    items = [(i, f"w{i % 11} w{i % 5} w{i % 7}") for i in range(30)]
    want = Counter((items[k][0], r, i, s) for k, r, i, s in ranked(docs, items, 5))
    monkeypatch.setattr(ranked_search, "BLOCK_PAIRS", 40)
    monkeypatch.setattr(ranked_search, "ENTRIES", 7)
    got = ranked_search.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == want


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert ranked_search.rank_documents(docs.limit(0), items).collect() == []
    assert ranked_search.rank_documents(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in ranked_search.rank_documents(docs, items).collect()] == [("q", 1, 1, 287 * (10**9 // (1000 + 1200)))]


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 50, 3000).astype(np.uint64)
    keys[::3] = keys[0]
    assert ranked_search.radix_order(keys).tolist() == np.argsort(keys, kind="stable").tolist()
    assert ranked_search.radix_order(keys[:0]).tolist() == []


# Clustering


def clustered(vectors, k, rounds):
    """Brute force on whole numbers: {row: (cluster, distance)}, places."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    places = [p for _, p in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    own = lambda p: min((far(p, c), j) for j, c in enumerate(places))
    for _ in range(rounds):
        groups = {}
        for _, p in kept:
            groups.setdefault(own(p)[1], []).append(p)
        places = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(places)]
    return [(i, *own(p)[::-1]) for i, p in kept], places


@pytest.mark.parametrize(("kind", "k"), [("normal", 9), ("ties", 16), ("large", 5)])
def test_clusters_by_brute_force(spark, kind, k):
    rng = np.random.default_rng(k)
    values = {"normal": rng.normal(size=(400, 4)), "ties": rng.integers(-2, 3, size=(400, 4)) / 2, "large": rng.normal(size=(400, 4)) * 2**18}[kind].astype(np.float32)
    vectors = [(int(i), v.tolist()) for i, v in enumerate(values)]
    vectors += [(None, [0.5] * 4), (3, vectors[3][1]), (3, vectors[3][1]), (500, None), (501, [1.0]), (502, [1.0, None, 1.0, 1.0]), (503, [1.0, float("nan"), 0.0, 0.0]), (504, [float("inf"), 0.0, 0.0, 0.0]), (505, [])]
    frame = spark.createDataFrame([(i, v, 7) for i, v in vectors], "vec_id long, embedding array<float>, cluster int").repartition(3)
    got = clustering.cluster(frame, k=k, rounds=4, dimensions=4).collect()
    want, places = clustered(vectors, k, 4)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter(want)
    inertia = Counter()
    for _, c, d in want:
        inertia[c] += d
    assert {(r.cluster, r.cluster_inertia, r.inertia) for r in got} == {(c, d, sum(inertia.values())) for c, d in inertia.items()} | {(c, 0, sum(inertia.values())) for _, c, _ in want if not inertia[c]}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, places[r.cluster])).encode()).hexdigest() for r in got)


def test_few_vectors_and_none(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.distance) for r in clustering.cluster(frame, k=5, dimensions=2).collect()) == [(1, 0), (2, 0)]
    assert clustering.cluster(frame.limit(0), k=5, dimensions=2).collect() == []
    assert clustering.cluster(frame, k=1, dimensions=2).count() == 2


def test_bounds_spare_distances(monkeypatch):
    """Later rounds look at few centroids."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 8)) * 1000
    points = np.floor(centers[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 8)) * 20).astype(np.int64)
    told = clustering.Centroids(np.floor(centers).astype(np.int64))
    looked = []
    plain = clustering.distances
    monkeypatch.setattr(clustering, "distances", lambda x, c: looked.append(len(x) * len(c)) or plain(x, c))
    none = np.full(2000, -1)
    cluster, upper, lower = clustering.assign(points, none, np.zeros(2000), np.zeros(2000), told)
    first, looked[:] = sum(looked), []
    again, *_ = clustering.assign(points, cluster, upper + 30, lower - 30, told)
    assert again.tolist() == plain(points, told.places).argmin(1).tolist() and sum(looked) < first / 10


# HTML extraction


class Article(HTMLParser):
    """The text inside <article>, by Python's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "br"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"

    def handle_data(self, text):
        if self.inside:
            self.out.append(text)


def article(page):
    parser = Article()
    parser.feed(page)
    parser.close()
    return " ".join("".join(parser.out).split())


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.fit(html_extract.labelled_pages(spark))


def test_every_page_of_the_table(spark, data, model):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = html_extract.extract_text(pages, model).collect()
    assert len(rows) == pages.count() and all(r.text == article(r.html) and r.n_chars == len(r.text) for r in rows)


def test_pages_that_were_not_learned(model):
    """Held-out invented pages of other layouts."""
    right = total = whole = 0
    for k in range(200):
        page, text = labelled_page(31, k)
        found = html_extract.blocks(page)
        want, got = html_extract.label_blocks(found, text), model.decode(html_extract.blocks(page, model.weights))
        right, total, whole = right + sum(map(int.__eq__, want, got)), total + len(want), whole + (want == got)
    assert right / total > 0.99 and whole > 170


def test_parts_that_are_no_article(model):
    page = """<html><head><title>No</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
    <header class=top><h1>The Daily Page</h1><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav></header>
    <div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
    <main><article><h1>Rivers &amp; lakes</h1><p>Water flows down the hills, and in time it finds the sea.<p>Short one.
    <ul><li>first thing that matters here</li><li>second thing that matters</li></ul>
    <div class="ad">Buy our boats now, cheap!</div><p>After the rain the meadows were green again&hellip; and the birds came back.</p></article>
    <section id="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>What a lovely text, I read it twice today.</p></div></section></main>
    <aside class="sidebar"><h3>Most read</h3><p>Ten ways to boil an egg that you did not know.</p></aside>
    <form class="newsletter"><label>Mail</label><input><button>Subscribe</button></form>
    <footer><p>&copy; 2024 The Daily Page. All rights reserved.</p></footer></body></html>"""
    assert model.extract(page) == "Rivers & lakes Water flows down the hills, and in time it finds the sea. Short one. first thing that matters here second thing that matters After the rain the meadows were green again… and the birds came back."


def test_blocks_of_odd_markup():
    text = lambda page: [x.text for x in html_extract.blocks(page)]
    assert text("a<br>b &amp;c&nbsp; d<p>e<b>f</b>g") == ["a b &c d", "efg"]
    assert text("<p title='a > b' x=it's>one</p><!-- <p>no --><p>two < three<p") == ["one", "two < three"]
    assert text("<SCRIPT>no</p></Script ><style>no</style>yes<svg><p>no</svg> <noscript>no") == ["yes no"]
    assert text("<script>never ends <p>no") == [] and text("<p>a<!-- never ends <p>no") == ["a"] and text("") == [] and text("<div></div>") == []
    assert text("<ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == list("abcdefg")
    assert text("</div></p>x&#0;&#x41;&bogus;") == ["x�A&bogus;"]


def test_long_and_deep_pages_in_one_pass(model):
    deep = "<div class=sidebar>" * 50_000 + "x" + "</p>" * 50_000
    assert len(html_extract.blocks(deep, model.weights)) == 1
    assert len(html_extract.blocks("<svg>" * 20_000 + "<a href='" * 20_000)) <= 1
    long = "<article>" + "<p>" + "Water flows down the hills, and in time it finds the sea. " * 50_000 + "</article>"
    assert len(model.extract(long)) == 50_000 * len("Water flows down the hills, and in time it finds the sea. ") - 1


def test_nulls_repeats_and_names(spark, model):
    rows = [(1, None, "a"), (1, "", "b"), (1, "<article><p>Water flows, and finds the sea at last.</p></article>", "c"), (None, "<nav><a href=x>Home</a></nav>", "c")]
    frame = spark.createDataFrame([*rows, rows[2]], "page_id long, html string, text string").withColumn("n_chars", html_extract.F.lit("x"))
    got = html_extract.extract_text(frame, model)
    water = "Water flows, and finds the sea at last."
    assert sorted((r.text, r.n_chars) for r in got.collect()) == sorted([("", 0), ("", 0), (water, len(water)), ("", 0), (water, len(water))])
    assert html_extract.extract_text(frame.limit(0), model).collect() == []


def test_no_labelled_pages(spark):
    empty = html_extract.fit(spark.createDataFrame([], "html string, text string"))
    assert empty.extract("<p>all</p>") == "" and html_extract.train([]).extract("<p>all</p>") == ""


def test_field_by_brute_force():
    """Sums, chances and the best row of states, over all rows of states."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 5):
        emissions, bonds = rng.normal(size=(n, 2)).tolist(), rng.normal(size=(n, 2, 2)).tolist()
        score = lambda s: sum(emissions[k][x] for k, x in enumerate(s)) + sum(bonds[k][s[k - 1]][s[k]] for k in range(1, n))  # noqa: E731, B023
        rows = list(itertools.product((0, 1), repeat=n))
        total, chances, pairs = html_extract.marginals(emissions, bonds)
        weight = [math.exp(score(s)) for s in rows]
        assert math.isclose(total, math.log(sum(weight)))
        assert np.allclose([c[1] for c in chances], [sum(w for w, s in zip(weight, rows, strict=True) if s[k]) / sum(weight) for k in range(n)])
        for k in range(1, n):
            assert np.allclose(pairs[k], [[sum(w for w, s in zip(weight, rows, strict=True) if s[k - 1 : k + 1] == (a, b)) / sum(weight) for b in (0, 1)] for a in (0, 1)])
        assert tuple(html_extract.viterbi(emissions, bonds)) == max(rows, key=score)


def test_labels_of_repeated_blocks():
    page = "<nav>Home</nav><h1>Home</h1><p>One more. <p>Home"
    labels = html_extract.label_blocks(html_extract.blocks(page), "Home One more. Home")
    assert sum(labels) == 3 and labels[2] == labels[3] == 1 and entities.unescape("&amp;") == "&"
