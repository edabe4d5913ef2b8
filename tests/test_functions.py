"""Functions against plain Python, and properties."""

import datetime as dt
import fnmatch
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovesift.functions import paths, text
from trovesift.operators import learning, understanding
from trovesift.operators.fulltext import bm25, sanitize_relaxed, sanitize_strict


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n\té", max_size=4000))
def test_chunks_make_up_the_text(s):
    cuts = text.chunk_offsets(s)
    assert "".join(s[a:b] for a, b in cuts) == s
    assert all(0 < b - a <= 2000 for a, b in cuts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=7), st.text(alphabet="abc", max_size=7))
def test_osa(a, b):
    def slow(i, j):
        if not i or not j:
            return i + j
        best = min(slow(i - 1, j) + 1, slow(i, j - 1) + 1, slow(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, slow(i - 2, j - 2) + 1)
        return best

    assert text.osa_distance(a, b, 2) == min(3, slow(len(a), len(b)))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab*?", min_size=1, max_size=6), st.text(alphabet="ab", min_size=1, max_size=6))
def test_glob_of_one_component(pattern, name):
    found = re.search(paths.glob_regex(pattern), "/" + name) is not None
    assert found == fnmatch.fnmatchcase(name, pattern.replace("**", "*"))


def test_globs():
    match = lambda g, p: re.search(paths.glob_regex(g), p) is not None
    assert match("node_modules/**", "/a/node_modules/x/y.js") and not match("node_modules/**", "/a/my_node_modules/x")
    assert match("*.pyc", "/a/b.pyc") and not match("*.pyc", "/a/b.py") and match("Thumbs.db", "/x/Thumbs.db")
    assert match("a/*/c", "/r/a/b/c") and not match("a/*/c", "/r/a/b/d/c")
    assert paths.parse_ignore("# c\n\n*.o\n!keep.o\n build/ \n") == ["*.o", "build/"]


def test_porter_published_examples():
    pairs = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop tanned tan falling fall hissing hiss filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal hopefulness hope triplicate triplic formative form electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    for word, stem in zip(pairs[::2], pairs[1::2], strict=True):
        assert text.porter_stem(word) == stem, word


def test_snippets_and_highlights():
    s = text.snippet_of("one two three four five", {"three"}, 3)
    assert "<b>three</b>" in s and text.highlights(s.replace("...", "")) == [(8, 5)]


def test_sanitizers():
    assert sanitize_relaxed("How to find the Tax-Return 2023 for my taxes") == [("find", True), ("tax", False), ("return", True), ("2023", True), ("taxes", True)]
    assert sanitize_strict('tax "bank statement" (2023)') == [["tax"], ["bank", "statement"], ["2023"]]


def test_temporal():
    now = dt.datetime(2024, 1, 31, 12)
    assert understanding.temporal("notes from yesterday", now) == (dt.datetime(2024, 1, 30), dt.datetime(2024, 1, 30, 23, 59, 59))
    assert understanding.temporal("december 2022", now) == (dt.datetime(2022, 12, 1), dt.datetime(2022, 12, 31, 23, 59, 59))
    assert understanding.temporal("winter 2023", now) == (dt.datetime(2023, 12, 1), dt.datetime(2024, 2, 29, 23, 59, 59))
    assert understanding.temporal("2 weeks ago", now)[0] == dt.datetime(2024, 1, 17)
    assert understanding.temporal("maybe later", now) is None


def test_bm25_against_fts5(spark):
    import sqlite3

    rows = [(k, 0, f"n{k % 3}", f"/p/{k}", " ".join(["apple"] * (k % 4) + ["pear"] * (k % 3) + ["plum", "fig"] * (k % 5))) for k in range(40)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(name, path, chunk_text, tokenize='unicode61')")
    db.executemany("insert into t(rowid, name, path, chunk_text) values (?, ?, ?, ?)", [(r[0], *r[2:]) for r in rows])
    want = {i: round(v, 9) for i, v in db.execute("select rowid, bm25(t, 10.0, 5.0, 0.5) from t where t match 'apple OR pear'")}
    df = spark.createDataFrame(rows, "item_id long, chunk_index int, name string, path string, chunk_text string")
    got = {r.item_id: round(r.rank, 9) for r in bm25(df, ["apple", "pear"], every=False).collect()}
    assert got == want


def test_promotion_gates():
    assert learning.promote({"loss": 0.7}, {"loss": 0.6}, 100, 50) is None
    assert learning.promote({"loss": 0.7}, {"loss": 0.6995}, 100, 50) == "no_improvement"
    assert learning.promote({"loss": 0.7}, {"loss": 0.1}, 100, 3) == "too_few_positives"


def test_normalize_is_idempotent(spark):
    rows = [('  "Tax - Return!!  2023" ',), ("a—b  --  c",), ("",), ("Ünï  Cødé",)]
    df = spark.createDataFrame(rows, "t string").select(text.normalize_query(F.col("t")).alias("a"))
    df = df.withColumn("b", text.normalize_query(F.col("a")))
    assert [tuple(r) for r in df.collect()] == [("tax-return 2023",) * 2, ("a-b-c",) * 2, ("",) * 2, ("ünï cødé",) * 2]
