"""Operators of the engine against plain Python."""

import dataclasses
import datetime as dt
import io
import itertools
import random
import unicodedata
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovesift import catalog
from trovesift.functions import text
from trovesift.operators import answers, embedding, fulltext, health, indexing, learning, requests, rewrite, understanding, vector
from trovesift.sources import files, readers, stores
from trovesift.sources.scratch import shared_folder
from trovesift.sources.snapshots import Snapshots
from trovesift.streaming import pipelines


def cuts(s, target=1000, least=500, most=2000):
    """The rules of chunking, place by place."""
    out, pos = [], 0
    while pos < len(s):
        if len(s) - pos <= target:
            end = len(s)
        else:
            stop = pos + target
            low = pos + least
            places = range(stop, low, -1)
            end = next((i for i in places if s[i - 2 : i] == "\n\n"), None)
            if end is None:
                end = next((i for i in places if s[i - 1] == "." and s[i : i + 1] == " " or s[i - 1] in "!?" and s[i : i + 1] == "\n"), None)
            if end is None:
                end = next((i for i in places if s[i - 1] == " "), stop)
        if len(s) - end < least and len(s) - pos <= most:
            end = len(s)
        out.append((pos, end))
        pos = end
    return out


def test_chunks_by_the_rules(spark):
    rnd = random.Random(1)
    for alphabet in ("ab .", "ab\n", "abc", "a! \n", "ab. \n?é"):
        for size in (0, 1, 999, 1000, 1001, 1499, 1501, 1999, 2500, 6000):
            s = "".join(rnd.choice(alphabet) for _ in range(size))
            assert text.chunk_offsets(s) == cuts(s)
    rows = spark.createDataFrame([("é. " * 1500,)], "t string").select(F.inline(text.chunks("t"))).orderBy("chunk_index").collect()
    assert [r.byte_offset for r in rows] == [0, *itertools.accumulate(len(r.chunk_text.encode()) for r in rows[:-1])]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 0, "Report.pdf", "/a/Report.pdf", "the quick brown fox licensed under the terms"), (2, 0, "notes.txt", "/a/notes.txt", "quickly licensed terms under the fox"), (3, 0, "x.md", "/b/x.md", ""), (4, 0, "y.md", "/b/y.md", "Crème brûlée release released")]
    return spark.createDataFrame(rows, "item_id long, chunk_index int, name string, path string, chunk_text string")


def test_index_equals_the_scan(spark, small):
    index = fulltext.Index.build(small, shared_folder(spark, "index"))
    assert index.whole() and index.n == 4
    for terms, every in ((["fox", "the"], True), ([("quick", True), "md"], False), ([("relea", True)], False), (["nothing"], False), ([f"w{k}" for k in range(100)] + ["fox"], False)):
        got, want = ({(r.item_id, round(r.rank, 9)) for r in f(terms, every).collect()} for f in (index.bm25, lambda t, e: fulltext.bm25(small, t, e)))
        assert got == want
    assert {r.item_id for r in index.bm25([("quick", True)], False).collect()} == {1, 2} and index.bm25([], True).count() == 0
    assert {r.item_id for r in index.strict(small, '"licensed under" terms').collect()} == {1}
    again = index.compact(shared_folder(spark, "compact"))
    assert again.whole() and again.bm25(["fox"], False).count() == 2
    folded = fulltext.Index.build(small, shared_folder(spark, "folded"), stemming=True, folding=True)
    assert {r.item_id for r in folded.bm25(["brule"], False).collect()} == {4} and folded.bm25(["releas"], False).first().item_id == 4


def test_rewrite_rules(spark):
    terms = spark.createDataFrame([("license", 60, "l"), ("released", 30, "r"), ("public", 2, "p"), ("aardvark", 3, "a"), ("balloon", 40, "b")], "term string, df long, first string")
    sure = rewrite.decide("the lisense relesaed", terms, 2)
    assert sure.rewritten == "the license released" and sure.sure and sure.considered == 2 and sure.least <= sure.confidence <= 1
    assert rewrite.decide("the lisense relesaed", terms, 1).rewritten == "the license relesaed"
    assert rewrite.decide("license", terms, 2).replaced == [] and rewrite.decide("", terms, 2).reason == "empty_query_tokens"
    assert rewrite.decide("aardvrak", terms, 2).replaced == []  # two edits, but in too few documents
    assert rewrite.decide("baloooon", terms, 2).rewritten == "balloon"  # runs as one letter
    assert rewrite.eligible("API for abc x1y word") == ["api", "x1y", "word"]


def test_transposition_counts_once(spark):
    rows = [("form", "from", 1, 2), ("fomr", "from", 1, 2), ("abcd", "dcba", 1, 2)]
    got = [r[0] for r in spark.createDataFrame(rows, "token string, term string, df long, distance int").select(fulltext.typo_confidence()).collect()]
    base = 0.48 + 0.10 + 0.05
    assert got == pytest.approx([base + 0.06 + 0.06, base + 0.06, base - 0.08])


def test_quantizer(spark):
    rng = np.random.default_rng(0)
    rows = [([float(x) for x in rng.normal(size=32)],), ([0.5] * 32,), ([float(x) for x in np.linspace(0, 1, 32)],), ([float(x) for x in np.linspace(-1, 0, 32)],)]
    out = spark.createDataFrame(rows, "v array<double>").select("v", vector.quantize(F.col("v")).alias("q")).select("v", "q", vector.dequantize(F.col("q")).alias("back")).collect()
    assert (out[1].q.scale, out[1].q.zero, set(out[1].q.data)) == (0.0, 0, {0})
    for r in out[:1] + out[2:]:
        assert isinstance(r.q.zero, int) and 0 <= r.q.zero <= 255 and min(r.q.data) >= -128 and max(r.q.data) <= 127
        assert max(abs(a - b) for a, b in zip(r.v, r.back, strict=True)) <= r.q.scale * 1.01


def test_personal_ranker():
    w = learning.personal_weights(0.5, 1000)
    assert learning.personal_weights(0.5, 199) is None
    assert (w["semantic"], w["cross"], w["feedback"], w["router"], w["need"], w["bias"]) == pytest.approx((2.3, 2.6, 1.4, 1.2, 1.6, -2.0))


def test_word_pieces():
    v = {p: k for k, p in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "cafe", "!", "a", "##a"])}
    assert embedding.word_pieces("unaffable", v) == ["un", "##aff", "##able"] and embedding.word_pieces("unx", v) == ["[UNK]"]
    assert embedding.basic_tokens("Café!\x00 " + unicodedata.normalize("NFD", "é")) == ["cafe", "!", "e"]
    assert len(embedding.encode_text("a " * 2000, v)) == 512
    ids, segments = embedding.encode_pair("a " * 300, "a " * 400, v)
    assert len(ids) == len(segments) == 512 and segments.count(0) == 302
    ids, segments = embedding.encode_pair("a " * 600, "a " * 5, v)
    assert len(ids) == 512 and segments.count(1) == 1


def test_word_pieces_of_a_batch(spark):
    v = {p: k for k, p in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "a", "##a", "!"])}
    texts = ["unaffable a!", "", None, "a" * 201, "a" * 199 + " unx un", "a " * 600]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", embedding.wordpiece(v)("t").alias("ids")).collect()
    assert {r.id: r.ids for r in got} == {k: embedding.encode_text(t or "", v) for k, t in enumerate(texts)}


def test_breaker_closes_again():
    now = [0.0]
    breaker = embedding.Breaker(2, 30.0, lambda: now[0])
    breaker.report(False)
    assert breaker.state == "closed" and breaker.ready()
    breaker.report(False)
    assert breaker.state == "open" and not breaker.ready()
    now[0] = 30.0
    assert breaker.state == "half_open" and breaker.ready()
    breaker.report(False)  # one try is enough to open it again
    assert breaker.state == "open"
    now[0] = 61.0
    breaker.report(True)
    assert breaker.state == "closed" and breaker.failures == 0


def test_missing_vectors_are_taken_up_again(spark):
    log = Snapshots(spark, shared_folder(spark, "embedded"), {"vectors": "item_id long, passage int, embedding array<double>"})
    chunks = spark.createDataFrame([(1, 0, "ok"), (2, 0, "bad"), (2, 1, "ok")], "item_id long, passage int, text string").coalesce(1)

    def model(bad):
        def run(texts):
            if any(t in bad for t in texts):
                raise ValueError("bad")
            return np.ones((len(texts), 2))

        return run

    failed = spark.sparkContext.accumulator(0)
    assert embedding.embed(chunks, model(["bad"]), 2, failed=failed).where("embedding is null").count() == 1 and failed.value == 1
    assert embedding.embed_missing(spark, log, "vectors", chunks, model(["bad"]), 2, ("embed", 0)) == 1
    assert embedding.embed_missing(spark, log, "vectors", chunks, model([]), 2, ("embed", 0)) == 1  # the same batch once more
    assert embedding.embed_missing(spark, log, "vectors", chunks, model([]), 2, ("embed", 1)) == 0 and log.read("vectors").count() == 3


def test_embed_falls_back_row_by_row(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad")
        return np.ones((len(texts), 4))

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "id long, text string").coalesce(1)
    assert {r.id: r.embedding for r in embedding.embed(df, model, 4).collect()} == {1: [1.0] * 4, 2: None, 3: [1.0] * 4}
    chunks = spark.createDataFrame([(1, k, "x" * 9000) for k in range(5)] + [(2, 0, " ")], "item_id long, chunk_index int, chunk_text string")
    assert sorted((r.item_id, r.passage) for r in embedding.rebuild(chunks, lambda t: np.array([[len(x)] * 4 for x in t]), 4).where("embedding[0] = 8192").collect()) == [(1, 0), (1, 1), (1, 2)]


def test_index_of_vectors_finds_nine_of_ten(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding")
    index = embedding.InvertedFile.build(v, shared_folder(spark, "lists"))
    assert spark.read.parquet(f"{index.path}/vectors").count() == v.count()
    found = wanted = 0
    for row in v.where("item_id % 100 = 0").collect():
        want = {r.item_id for r in vector.knn(v, list(row.embedding), 10).collect()}
        found += len(want & {r.item_id for r in index.search(list(row.embedding), 10).collect()})
        wanted += len(want)
    assert found >= 0.9 * wanted
    assert index.search([1.0] * 64, 10, probes=16).count() == 10


def test_requests():
    r = requests.parse({"query": " a ", "limit": 900, "mode": "STRICT", "types": [".PDF", "md"], "include": ["/a"]})
    assert (r.query, r.limit, r.mode, r.types) == ("a", 200, "strict", ("pdf", "md")) and requests.parse({"query": "a", "limit": -3, "mode": "x"}).limit == 1
    for bad in ({}, {"query": " "}, {"query": "a", "limit": "x"}, {"query": "a", "after": 2, "before": 1}, {"query": "a", "least": 2, "most": 1}):
        with pytest.raises(ValueError):
            requests.parse(bad)
    now = [0.0]
    cache = requests.Cache(2, 30, lambda: now[0])
    cache.put(r, 1)
    assert cache.get(requests.parse({"query": "a", "limit": 200, "mode": "strict", "types": ["md", "pdf"], "include": ["/a"]})) == 1
    now[0] = 31
    assert cache.get(r) is None and (cache.hits, cache.misses) == (1, 1)
    for q in "abc":
        cache.put(requests.Request(q), q)
    assert cache.get(requests.Request("a")) is None and cache.get(requests.Request("c")) == "c"


def test_clipboard_and_manifest():
    assert requests.clipboard("file:///Users/x/Docs/Plan.PDF\nmore") == {"name": "plan.pdf", "extension": "pdf", "folder": "docs"}
    assert requests.clipboard("~/a/b.txt", "/home/u") == {"name": "b.txt", "extension": "txt", "folder": "a"}
    assert requests.clipboard("see report_v2.docx today") == {"name": "report_v2.docx", "extension": "docx"}
    assert requests.clipboard("file://host/x") == requests.clipboard("plain words") == requests.clipboard("") == requests.clipboard("x" * 3000) == {}
    found = requests.load_manifest('{"models": [{"role": "embed", "name": "a", "path": "p", "dimensions": 384, "more": 1}, {"role": "embed", "name": "b", "path": "q"}]}')
    assert found["embed"].name == "a" and found["embed"].dimensions == 384
    with pytest.raises(ValueError):
        requests.load_manifest('{"models": [{"role": "embed"}]}')


def test_semantic_rules_by_class():
    assert understanding.semantic_rules("natural_language", 1.0, True).threshold == pytest.approx(0.56)
    assert understanding.semantic_rules("path_or_code", limit=2).cap == 1 and understanding.semantic_rules("short_ambiguous").lexical_weight == 0.65


def test_admission_needs_weak_natural_queries(spark):
    hits = spark.createDataFrame([(1, 0.9, 0), (2, 0.7, 0), (3, 0.2, 1), (4, 0.1, 0)], "item_id long, similarity double, overlap int")
    reasons = lambda weak: {r.item_id: r.reason for r in vector.admit(hits, 0.78, 0.66, 8, weak).collect()}
    assert reasons(True) == {1: "high_similarity", 2: "weak_lexical_semantic", 3: "lexical_overlap"} and reasons(False) == {1: "high_similarity", 3: "lexical_overlap"}


def test_best_span_by_brute_force(spark):
    rnd = random.Random(5)
    rows = [([rnd.gauss(0, 3) for _ in range(n)], [rnd.gauss(0, 3) for _ in range(n)]) for n in (1, 2, 40, 90)]
    for (a, b), r in zip(rows, spark.createDataFrame(rows, "a array<double>, b array<double>").coalesce(1).select(answers.best_span(F.col("a"), F.col("b")).alias("s")).collect(), strict=True):
        score, s, e = max((a[s] + b[e], -s, -e) for s in range(len(a)) for e in range(s, min(len(a) - 1, s + 30) + 1))
        assert (r.s.first, r.s.last) == (-s, -e) and r.s.score == pytest.approx(score) and r.s.confidence == pytest.approx(1 / (1 + np.exp(-score / 6)))
    assert answers.sentence_around("One here. Two there! Three.", 0.5) == "Two there!"


def test_learning_by_brute_force(spark, data):
    samples = {r.sample_id: r for r in catalog.queries()["online_rank_boost"](spark, data).collect()}
    batch = catalog.queries()["training_batch"](spark, data).collect()
    positives = sum(r.label for r in batch)
    assert len({r.sample_id for r in batch}) == len(batch) <= 1200 and all(r.sample_id in samples for r in batch) and len(batch) - positives <= 3 * positives
    kept = catalog.queries()["reservoir"](spark, data).collect()
    assert len({r.sample_id for r in kept}) == min(256, len(samples))
    rows = [(k, [float(k % 3), 1.0], k % 2, 1.0) for k in range(30)]
    got = learning.train(spark.createDataFrame(rows, "sample_id long, features array<double>, label int, weight double"), [0.1, -0.1], 0.0).first()
    w, b = np.array([0.1, -0.1]), 0.0
    for _ in range(3):
        for _, x, y, weight in rows:
            x = np.array(x)
            g = (1 / (1 + np.exp(-(w @ x + b))) - y) * max(0.05, weight)
            w, b = w - 0.05 * (g * x + 1e-4 * w), b - 0.05 * g
    assert list(got.weights) == pytest.approx(w.tolist()) and got.bias == pytest.approx(b)


def test_learning_gates_and_mix(spark):
    good, better = {"loss": 0.6}, {"loss": 0.5}
    assert learning.promote(good, better, 100, 20) is None
    for reason, args in (("too_few_examples", (good, better, 10, 20)), ("too_few_positives", (good, better, 100, 5)), ("invalid_loss", (good, {"loss": float("nan")}, 100, 20)), ("regression", (better, good, 100, 20)),
                         ("failure_rate", (good, {"loss": 0.5, "failures": 0.1}, 100, 20)), ("saturated", (good, {"loss": 0.5, "saturation": 0.99}, 100, 20)), ("no_improvement", (good, {"loss": 0.599}, 100, 20))):
        assert learning.promote(*args) == reason
    assert learning.promote(good, better, 100, 20, latency_ms=99) == "latency"
    assert [learning.attribution_gate(*x) for x in ((10, 1, 1), (90, 0.4, 1), (90, 0.9, 0.05), (90, 0.9, 0.2))] == ["too_few_positives", "attribution_rate", "context_digest_rate", None]
    fresh, replay = (spark.createDataFrame([(k, k % 2) for k in r], "sample_id long, label int") for r in (range(50), range(40, 200)))
    mixed = learning.training_mix(fresh, replay, 60).collect()
    assert len(mixed) == 60 and len({r.sample_id for r in mixed}) == 60 and sum(r.origin == "replay" for r in mixed) == 30


def test_cycle_promotes_what_learns(spark):
    rnd = random.Random(3)
    rows = [(k, [rnd.random(), 1.0], int(rnd.random() < 0.5)) for k in range(400)]
    rows = [(k, [x[0] + y, 1.0], y, 1.0, 0, False) for k, x, y in rows]
    examples = spark.createDataFrame(rows, "sample_id long, features array<double>, label int, weight double, created_at long, consumed boolean")
    none = examples.select("sample_id", "features", "label", "weight").limit(0)
    out = learning.cycle(examples, none, [0.0, 0.0], 0.0, F.lit("2024-01-31").cast("timestamp"), True)
    assert out["promoted"] and out["weights"][0] > 0 and out["candidate"]["loss"] < out["active"]["loss"] and out["consumed"].count() > 100
    assert learning.cycle(examples, none, [0.0, 0.0], 0.0, F.lit("2024-01-31").cast("timestamp"), False)["reason"] == "no_consent"
    assert learning.cycle(examples.limit(10), none, [0.0, 0.0], 0.0, F.lit("2024-01-31").cast("timestamp"), True)["reason"] == "too_few_samples"


def test_behaviour_hashes_are_blanked(spark):
    e = spark.createDataFrame([("click", "a", False, "h")], "event_type string, app string, private boolean, window_hash string")
    assert learning.admit_events(e, True, ["click"], [], False, ("window_hash",)).first().window_hash is None
    assert learning.admit_events(e, True, ["click"], [], True, ("window_hash",)).first().window_hash == "h"


def test_stores(spark):
    t = stores.VersionedTable(spark, shared_folder(spark, "table"), "id long, v string")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], t.schema)
    t.append(rows, ("events", 0))
    t.append(rows, ("events", 0))  # the same append once more
    t.append(rows.limit(1).unionByName(spark.createDataFrame([(3, None)], t.schema)), ("events", 1))
    t.append(spark.createDataFrame([(3, None)], t.schema))
    assert sorted(map(repr, t.read().collect())) == sorted(map(repr, [*rows.collect(), rows.first(), *t.read().where("id = 3").collect()])) and t.read().where("id = 3").count() == 2
    stores.clear_all(t)
    assert t.read().count() == 0
    old = spark.createDataFrame([(1, True)], "item_id long, is_pinned boolean")
    new, version = stores.migrate(old, 1)
    assert version == 4 and new.first().asDict() == {"item_id": 1, "is_pinned": True, "sensitivity": "normal", "content_hash": None, "indexed_at": 0}
    with pytest.raises(ValueError):
        stores.migrate(old, 3, 2)
    path = shared_folder(spark, "settings")
    from trovesift.config import DEFAULTS

    kept = stores.SettingsStore(spark, path)
    assert kept.load() == DEFAULTS
    kept.save(dataclasses.replace(DEFAULTS, rrf_k=7, frequency_tiers=(1.0, 2.0, 3.0)))
    assert (kept.load().rrf_k, kept.load().frequency_tiers) == (7, (1.0, 2.0, 3.0))
    assert kept.remove("rrf_k") and not kept.remove("rrf_k") and kept.load().rrf_k == DEFAULTS.rrf_k


def test_observed_counts(spark):
    df, seen = health.observed(spark.range(100), "seen", even=F.col("id") % 2 == 0)
    df.collect()
    assert seen.get == {"rows": 100, "even": 50}


def test_lanes_share_slots(spark):
    work = spark.createDataFrame([("p", k, "live" if k % 2 else "rebuild") for k in range(400)], "path string, seq long, lane string")
    rows = indexing.lanes(work).orderBy("slot").collect()
    assert len({r.slot for r in rows}) == 400 and sum(r.lane == "live" for r in rows[:100]) == 70


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, body in parts.items():
            archive.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def a_pdf(pages, flate=True):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [] >>"}
    for k, text in enumerate(pages):
        content = f"BT /F1 12 Tf 72 700 Td ({text}) Tj ET".encode("latin-1")
        packed = zlib.compress(content) if flate else content
        objects[10 + 2 * k] = f"<< /Type /Page /Contents {11 + 2 * k} 0 R >>".encode()
        objects[11 + 2 * k] = b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(packed), b"/Filter /FlateDecode " if flate else b"", packed)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>"


def test_readers():
    w = 'xmlns:w="http://w"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>"
    assert readers.docx(zipped(word__document_xml=body)) == ("ok", "One\ttwo\nThree", None)
    assert readers.odt(zipped(content_xml='<d xmlns:t="http://t"><t:h>Head</t:h><t:p>a<t:s/>b <t:span>c</t:span> d</t:p></d>'))[1] == "Head\na b c d"
    assert readers.pptx(zipped(ppt__slides__slide2_xml="<s><p>two</p></s>", ppt__slides__slide10_xml="<s><p>ten</p></s>"))[1] == "two\n\nten"
    sheet = '<s><row><c t="s"><v>1</v></c><c><v>3.5</v></c></row><row/><row><c t="inlineStr"><is><t>x</t></is></c></row></s>'
    assert readers.xlsx(zipped(xl__sharedStrings_xml="<s><si><t>a</t></si><si><t>b b</t></si></s>", xl__worksheets__sheet1_xml=sheet))[1] == "b b\t3.5\nx"
    assert readers.rtf(rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}Caf\'e9 \u8364? \b bold\b0 .\par next \{x\}}")[1] == "Café € bold.\nnext {x}"
    assert readers.rtf(b"plain")[0] == "failed" and readers.pdf(b"plain")[0] == "failed"
    for flate in (True, False):
        assert readers.pdf(a_pdf(["Hello \\(you\\)", "Caf\\351"], flate))[1] == "--- Page 1 ---\nHello (you)\n\n--- Page 2 ---\nCafé"
    assert readers.pdf(a_pdf(["x"]) + b"<< /Encrypt 5 0 R >>")[2] == "PDF is encrypted or password-protected"


def test_extraction_by_extension(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_TEXT", 2000)
    (tmp_path / "a.pdf").write_bytes(a_pdf(["page"]))
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("x" * 3000)
    (tmp_path / "d.md").write_text("# t")
    (tmp_path / "e.png").write_bytes(b"\0")
    deep = tmp_path / "p" / "q" / "node_modules"
    deep.mkdir(parents=True)
    (deep / "f.txt").write_text("deep")
    got = {r.path.rpartition("/")[2]: (r.status, r.text, r.error) for r in files.extract(spark, str(tmp_path)).collect()}
    assert got["a.pdf"][:2] == ("ok", "--- Page 1 ---\npage") and got["b.docx"][0] == "failed" and got["e.png"][0] == "unsupported"
    assert got["c.txt"] == ("too_large", None, "File size 3000 exceeds configured limit 2000") and got["d.md"][1] == "# t"
    names = lambda **k: {r.name for r in files.scan(spark, str(tmp_path), **k).collect()}
    assert "f.txt" in names() and "f.txt" not in names(deepest=1) and names(deepest=1) >= {"a.pdf", "d.md"} and "f.txt" not in names(prune=True, roots=[str(tmp_path)])


def test_understanding_as_a_whole():
    now = dt.datetime(2024, 1, 31)
    u = understanding.understand("signed lease agreement  for John Smith from december 2023 pdf", now)
    assert (u.kind, u.type_hint, u.document, u.extensions[0]) == ("natural_language", "pdf", "legal_document", "pdf")
    assert u.range == (dt.datetime(2023, 12, 1), dt.datetime(2023, 12, 31, 23, 59, 59)) and ("John Smith", "person") in u.entities and "lease" in u.words
    assert understanding.prefilter("tax stuff in downloads", "/h") == ["/h/Downloads"]
    assert understanding.prefilter("budget meeting notes", "/h") == ["/h/Documents", "/h/Desktop", "/h/Downloads"]
    assert understanding.prefilter("src/main.cpp parse error", "/h") == [] == understanding.prefilter("x", "/h") == understanding.prefilter("budget meeting notes", "/h", filtered=True)


def test_payload_has_all(spark):
    from trovesift.config import DEFAULTS

    path = shared_folder(spark, "payload")
    stores.export_payload(spark, {"a": spark.range(3), "b": spark.range(2)}, DEFAULTS, path)
    rows = spark.read.json(path)
    assert {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()} == {"a": 3, "b": 2, "settings": 1}


def test_changes_survive_lost_and_repeated_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "catalog")
    schema = pipelines.CHANGE
    seen = lambda: {tuple(r) for r in pipelines.catalog(spark, out).collect()}
    spark.createDataFrame([("a", "new", 1), ("b", "new", 2)], schema).coalesce(1).write.parquet(f"{source}/0")
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
    pipelines.merge_changes(stream(), out, str(tmp_path / "c1"))
    pipelines.merge_changes(stream(), out, str(tmp_path / "c2"))  # a new checkpoint numbers from 0 again
    assert seen() == {("a", "new", 1), ("b", "new", 2)}
    spark.createDataFrame([("a", "delete", 3), ("b", "modified", 1), ("c", "new", 4)], schema).coalesce(1).write.parquet(f"{source}/1")
    pipelines.merge_changes(stream(), out, str(tmp_path / "c1"))
    assert seen() == {("b", "new", 2), ("c", "new", 4)}


def test_a_late_change_brings_no_path_back(spark, tmp_path):
    """Five changes of a path, each in a batch of its own, in many orders: the catalog has what the latest one says."""
    orders = list(itertools.permutations([("new", 1), ("modified", 2), ("delete", 5), ("modified", 3), ("rescan", 4)]))
    rows = [(f"p{k}", kind, seq, step) for k, order in enumerate(orders) for step, (kind, seq) in enumerate(order)]
    rows += [(f"q{k}", "modified" if kind == "delete" else "delete" if seq == 3 else kind, seq, step) for k, order in enumerate(orders) for step, (kind, seq) in enumerate(order)]
    whole = spark.createDataFrame(rows, "path string, kind string, seq long, step int")
    source, out = str(tmp_path / "in"), str(tmp_path / "catalog")
    for step in range(5):
        whole.where(whole.step == step).select("path", "kind", "seq").coalesce(1).write.parquet(f"{source}/{step}")
        stream = spark.readStream.schema(pipelines.CHANGE).option("recursiveFileLookup", True).parquet(source)
        pipelines.merge_changes(stream, out, str(tmp_path / "c"))
    assert {tuple(r) for r in pipelines.catalog(spark, out).collect()} == {(f"q{k}", "modified", 5) for k in range(120)}
    pipelines.merge_changes(spark.readStream.schema(pipelines.CHANGE).option("recursiveFileLookup", True).parquet(source), out, str(tmp_path / "again"), late=0)
    assert pipelines.catalog(spark, out).count() == 120
