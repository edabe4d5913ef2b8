"""run() against a brute-force version of its stages."""

import collections
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_operators import components, contaminated, naive_language, related

corpus_pipeline = pytest.importorskip("corpus_pipeline")


SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
NOTICE = re.compile(r"(?:^|[^A-Za-z])(?:all rights reserved|licensed under|released under|general public license|copyright|cookies?|privacy policy|terms of (?:use|service)|subscribe|sign (?:in|up)|log ?in|click here|skip to content|javascript)(?:[^A-Za-z]|$)", re.I | re.A)


def bad_line(line):
    words = re.findall(f"[^{SPACE}]+", line)
    if not words:
        return False
    bars = sum(w in "|>" and len(w) == 1 for w in words)
    noise = len(re.findall(r"[#*$%&|<>]", line)) * 10 > sum(map(len, words))
    shout = len(words) >= 3 and sum(w.endswith("!!") for w in words) * 10 >= 3 * len(words)
    mark = re.search(rf"[.!?…:;\x22”»)][\x27\x22)\]]*[{SPACE}]*\Z", line)
    return noise or shout or (bars >= 2 and bars * 5 >= len(words)) or (len(words) <= 40 and (not mark or bool(NOTICE.search(line))))


def cleaned(text):
    """The text without failed lines, or None if the document goes."""
    words = re.findall(f"[^{SPACE}]+", text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times = collections.Counter(windows)
    repeated = {p for k, w in enumerate(windows) if times[w] > 1 for p in range(k, k + 8)}
    if len(words) < 20 or 100 * len(repeated) > 30 * len(words):
        return None
    left = "\n".join(x for x in text.split("\n") if not bad_line(x))
    size = lambda t: sum(map(len, re.findall(f"[^{SPACE}]+", t)))
    return left if 100 * (size(text) - size(left)) <= 50 * size(text) else None


def pieces(doc, text, encode):
    ids = [*encode(text), 2]
    first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
    cuts = [0, *range(first, len(ids) + 1, 1024)]
    return [(doc, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def test_pipeline_against_brute_force(spark, data):
    """Only the fitted language model comes from the library; its predictions are computed gram by gram."""
    from tokenizers import Tokenizer

    from trovesift.llm import langid, shared

    docs = shared.documents(spark, data)
    model = langid.fit(docs)
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    tokenizer = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    kept, near = {}, set()
    for r in docs.collect():
        if re.search(r"[^\W\d_]", r.text or ""):
            score = naive_language(model, r.text)[1] if len(r.text) < 3000 else model.predict(pa.array([r.text]))[1][0]
            near |= {r.doc_id} if abs(score - 0.5) < 1e-3 else set()
            if score >= 0.5:
                kept[r.doc_id] = r.text
    clean = {d: c for d, t in kept.items() if (c := cleaned(t)) is not None}
    groups = components(list(clean.items()), n=5, percent=80)
    alone = {d: t for d, t in clean.items() if groups[d][1] == d}
    last = {}
    for d, t in alone.items():
        n, hit, _ = contaminated(t, items)
        if not (hit and 20 * hit >= n):
            last[d] = t
    rows = corpus_pipeline.run(spark, data).collect()
    want = [p for d, t in last.items() for p in pieces(d, t, lambda t: tokenizer.encode(t, add_special_tokens=False).ids)]
    assert not near and sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert 0 < len(last) < docs.count()
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(own))]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024


def test_language_keeps_a_family_of_four(spark, data):
    rows = [(k, text, lang, "s", 1) for k, (text, lang) in enumerate(related(("fr", "es", "it", "pt"))[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language(spark, docs, data).count() >= 0.95 * len(rows)


def test_near_duplicates_by_five_words_at_four_fifths(spark, data):
    """Two edits apart in 100 words: 86 of 106 five-word shingles are shared, but 89 of 105 four-word ones."""
    words = [[f"t{k}w{i}" for i in range(100)] for k in range(2)]
    edited = [*words[0][:30], "x", *words[0][31:60], "y", *words[0][61:]]
    more = [*edited[:80], "z", *edited[81:]]
    rows = [(k, " ".join(w), "en", "s", 1) for k, w in enumerate((words[0], edited, words[1], [*words[1][:20], "a", *words[1][21:50], "b", *words[1][51:80], "c", *words[1][81:]], more))]
    groups = components([r[:2] for r in rows], n=5, percent=80)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, data).collect()} == {d for d in groups if groups[d][1] == d} == {0, 2, 3}


def test_stages_with_odd_rows(spark, data):
    """Null ids and texts, repeated ids, clashing and extra columns go through all stages."""
    good = ("The quick brown fox jumps over the lazy dog and then rests near the old barn for a while before the rain begins again today. "
            "Nobody had seen such a creature here before, so people came from far away to look at it with their own eyes.")  # fmt: skip
    texts = [f"{good} Number {k} of them went home by the {k}th road to the town of {chr(97 + k) * 5}." for k in range(6)]
    rows = [(k % 4 if k else None, t, "en", "s", 7, "x", 1.0) for k, t in enumerate(texts)] + [(None, None, None, None, None, None, None), (3, "", "en", "s", 0, "y", 2.0)]
    rows += [(100 + k, t + f" More words {k}.", "de" if k % 2 else "en", "s", 7, "x", 1.0) for k, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score double")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        assert name == "pack" or out.columns == docs.columns
        found = out.collect()
        assert found
        docs = spark.createDataFrame(found, out.schema)


def test_near_duplicates_with_repeated_and_null_ids(spark, data):
    """Other texts under one doc_id stay, copies go, whatever their ids."""
    text = [" ".join(f"t{k}w{i}" for i in range(60)) for k in range(4)]
    rows = [(7, text[0]), (7, text[1]), (7, text[1]), (None, text[2]), (None, text[2]), (8, text[0]), (9, None), (9, None), (10, ""), (None, text[3])]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, data).collect()]
    assert sorted(t for _, t in got if t) == sorted(text) and len(got) == 4 + 3


def test_run_leaves_one_table(spark, data):
    from trovesift.llm import shared

    since = shared.made()
    out = corpus_pipeline.run(spark, data)
    assert shared._MADE[since:] == [out._scratch] and out.count()


def test_stages_keep_columns_and_empty_tables(spark, data):
    from trovesift.llm import shared

    docs = shared.documents(spark, data).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
