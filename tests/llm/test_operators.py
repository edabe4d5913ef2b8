"""The operators against SQL, brute force, round trips and held-out accuracy, with odd rows of every kind."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from trovesift.llm import decontam, langid, lm, ngram_join, packing, quality_clf, quality_rules, queries, sharding, shared, textops, token_counts, tokens, warc
from trovesift.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
WORD = r"[^\x20\x09-\x0D]+"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def odd_rows():
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three."
    return [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 6), (4, base, "en", "s", len(base)), (5, base, "en", "s", len(base)),
        (6, base.replace("two", "2"), "en", "s", len(base)), (6, base.replace("two", "2"), "en", "s", len(base)), (7, "word", "en", "s", 4), (8, "it's 12 «ça» — 日本語 😀", "fr", "s", 20),
        (9, " ".join(f"w{k % 997}" for k in range(30000)), "de", "s", 150000), (10, "x " * 5000, "es", "s", 10000), (11, base.upper(), "en", "s", len(base)), (None, base, "en", "s", 3),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).withColumn("score", F.lit(1)).withColumn("text_", F.lit("x"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, data, name):
    assert_same(queries.queries()[name](spark, data), queries.oracle_sql()[name], data)


# 1


def test_language_held_out_accuracy(spark, data):
    rows = queries.op1_language_id(spark, data).join(shared.documents(spark, data).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_language_odd_rows(spark, odd, empty):
    model = langid.train([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr"), ("der Hund ist nicht im Haus", "de"), ("el perro de la casa", "es")] * 5)
    got = {(r.doc_id, r.lang_pred): r.score for r in langid.identify(odd, model).collect()}
    assert len(langid.identify(odd, model).collect()) == len(odd_rows())
    assert {k[1] for k in got if k[0] in (1, 2, 3)} == {"und"} and all(0 <= v <= 1 for v in got.values())
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.train([])).collect()} == {"und"}
    alone, together = model.predict(pa.array(["der Hund"])), model.predict(pa.array(["le chat", "der Hund", "x"]))
    assert alone[0][0] == together[0][1] and alone[1][0] == pytest.approx(together[1][1], abs=1e-9)


def naive_mix(x):
    mask = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & mask
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & mask
    return x ^ x >> 31


def naive_language(model, text):
    """The prediction, gram by gram: the language, its score, and the margins."""
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
    data = [32, *(fold(b) for b in (text or "").encode()), 32, 32, 32, 32]
    total, used = np.zeros(len(model.bias)), 0
    shift = 65 - langid.DIMENSIONS.bit_length()
    for k in range(len(data)):
        code = 0
        for n in range(1, 5):
            if data[k] == 32 and (k + 1 >= len(data) or data[k + 1] == 32):
                continue
            code = (code * 257 + (data[k + n - 1] if k + n - 1 < len(data) else 32) + 1) & ((1 << 64) - 1)
            total += model.weights[max(1, naive_mix((code * 8 + n) & ((1 << 64) - 1)) >> shift)]
            used += 1
    margins = total / max(1, used) + model.bias
    chance = 1 / (1 + np.exp(-np.clip(model.slope * margins, -30, 30)))
    shares = chance[: len(model.families)] / chance[: len(model.families)].sum()
    family = model.families[int(shares.argmax())] if len(model.families) > 1 else model.families[0]
    members = [x for x in model.languages if langid.family_of(x) == family]
    votes, odds = dict.fromkeys(members, 0.0), dict.fromkeys(members, 0.0)
    for k, (a, b) in enumerate(model.pairs):
        if a in votes:
            p = chance[len(model.families) + k]
            votes[a], votes[b] = votes[a] + p, votes[b] + 1 - p
            odds[a], odds[b] = odds[a] + (1 - p) / p, odds[b] + p / (1 - p)
    coupled = {m: 1 / (1 + odds[m]) for m in members}
    best = max(members, key=lambda m: votes[m])
    return best, shares[model.families.index(family)] * coupled[best] / sum(coupled.values()), margins


def test_language_scores_against_brute_force(spark, data):
    docs = shared.documents(spark, data)
    model = langid.fit(docs)
    texts = [r.text for r in docs.select("text").limit(25).collect()] + ["Ünï çødé — 12 ab", "x", "a  b\n\nc"]
    margins = model.margins(pa.array(texts))
    for text, label, score, own in zip(texts, *model.predict(pa.array(texts)), margins, strict=True):
        if label != langid.UNKNOWN:
            want, share, exact = naive_language(model, text)
            assert own == pytest.approx(exact, abs=1e-4) and label == want and score == pytest.approx(share, abs=1e-3)


def related(members, seed=3, words=80):
    """A trainer's rows and fresh texts of languages that share half of their words."""
    rnd = random.Random(seed)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(3, 7)))
    common = [word("aeiourst") for _ in range(50)]
    own = {m: common + [word(f"aeiourst{letters}") for _ in range(50)] for m, letters in zip(members, ("bcdbcd", "fghfgh", "jklmjk", "npqnpq", "vwxvwx"), strict=False)}
    text = lambda m: " ".join(rnd.choice(own[m]) for _ in range(words))
    return [(text(m), m) for m in members for _ in range(40)], [(text(m), m) for m in members for _ in range(10)]


@pytest.mark.parametrize("members", [("fr", "es", "it", "pt"), ("en", "de", "nl", "sv", "da")])
def test_language_score_of_large_families(members):
    rows, fresh = related(members)
    labels, scores = langid.train(rows).predict(pa.array([t for t, _ in fresh]))
    right = [s for a, (_, b), s in zip(labels, fresh, scores, strict=True) if a == b]
    assert len(right) >= 0.95 * len(fresh) and np.median(right) > 0.9 and max(scores) <= 1


# 2


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t, rnd = Tokenizer.from_file(TOKENIZER), random.Random(1)
    texts = [r[1] or "" for r in odd_rows()] + ["".join(rnd.choice("ab '.\n\t 1é日!s  '") for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    ids, bounds = tokens.BpeEncoder.load(TOKENIZER).encode(pa.array(texts))
    for k, want in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want.ids


def test_packing(spark, data, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    for docs in (shared.documents(spark, data), odd):
        rows = packing.pack_documents(docs, TOKENIZER).collect()
        texts = collections.Counter((r.doc_id, r.text or "") for r in docs.collect())
        by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            by_doc[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
        for (doc, text), n in texts.items():
            ids = [*t.encode(text, add_special_tokens=False).ids, 2]
            first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
            cuts = [0, *range(first, len(ids) + 1, 1024)]
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                crc = zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
                assert sum((r.piece, r.start, r.length, r.ids_crc32) == (p, a, b - a, crc) for r in by_doc[doc]) >= n
        for own in sequences.values():
            at = 0
            for r in sorted(own, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 1024
        assert len(sequences) <= 1.02 * math.ceil(sum(r.length for r in rows) / 1024) + 1
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


def test_bin_completion_is_optimal_on_small_cases():
    rnd = random.Random(5)
    for _ in range(60):
        capacity, items = 12, [rnd.randint(1, 12) for _ in range(rnd.randint(1, 8))]
        best = [len(items)]

        def place(k, bins, items=items, capacity=capacity, best=best):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= capacity:
                    place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
            place(k + 1, [*bins, items[k]])

        place(0, [])
        counts = dict(collections.Counter(items))
        plan = packing.bin_completion(counts, capacity)
        used = collections.Counter()
        for filling, n in plan:
            assert sum(a * b for a, b in filling) <= capacity
            for a, b in filling:
                used[a] += b * n
        assert dict(used) == counts and sum(n for _, n in plan) == best[0]


def test_bin_completion_beats_best_fit_on_thousands_of_pieces():
    """The search reaches whole packings, and the best of them is the result."""
    rnd = random.Random(1)
    for number, low, high in ((60, 100, 500), (5000, 300, 600), (30000, 150, 500)):
        counts = dict(collections.Counter(rnd.randint(low, high) for _ in range(number)))
        seen = []
        plan = packing.bin_completion(counts, 1024, seen=seen)
        used = collections.Counter()
        for filling, n in plan:
            assert sum(a * b for a, b in filling) <= 1024
            for a, b in filling:
                used[a] += b * n
        assert dict(used) == counts
        assert len(seen) > 1 and sum(n for _, n in plan) == min(seen) < seen[0] and min(seen) >= packing.least_bins(counts, 1024)


def test_fillings_are_undominated():
    rnd = random.Random(2)
    for _ in range(40):
        counts = dict(collections.Counter(rnd.randint(1, 20) for _ in range(12)))
        every = list(packing.fillings(counts, 24, looks=10**6))
        wastes = [24 - sum(x * n for x, n in f) for f in every]
        assert wastes == sorted(wastes) and all(f[0][0] == max(counts) for f in every) and len({tuple(f) for f in every}) == len(every)
        for f, waste in zip(every, wastes, strict=True):
            left = collections.Counter(counts)
            left.subtract(dict(f))
            assert all(x > waste for x, n in left.items() if n > 0)  # nothing more would fit
            rest = [x for x, n in f for _ in range(n)][1:]
            assert not any(x < y <= x + waste for x in rest for y, n in left.items() if n > 0)
            assert not any(0 <= y - a - b <= waste for k, a in enumerate(rest) for b in rest[:k] for y, n in left.items() if n > 0)


# 3


def test_sharding(spark, data, odd, empty):
    for docs in (shared.documents(spark, data), odd):
        rows = sharding.shuffle_into_shards(docs, 4, bucket_bytes=20_000).collect()
        count = lambda rs: collections.Counter((r.doc_id, r.text) for r in rs)
        assert count(rows) == count(docs.collect())
        for s in range(4):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        grown = {(r.doc_id, r.shard) for r in sharding.shuffle_into_shards(docs, 5, bucket_bytes=20_000).collect()}
        assert {(r.doc_id, r.grown_shard) for r in rows} == grown and all(r.grown_shard in (r.shard, 4) for r in rows)
    ids = [r.doc_id for r in sorted(sharding.shuffle_into_shards(shared.documents(spark, data), 1).collect(), key=lambda r: r.slot)]
    assert ids != sorted(ids)
    assert sharding.shuffle_into_shards(empty, 4).count() == 0


def test_query_sharding_against_brute_force(spark, data):
    docs = {r.doc_id: (r.text or "").encode() for r in shared.documents(spark, data).collect()}
    rows = queries.op3_sharding(spark, data).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in docs.items()} and len(rows) == len(docs)
    assert {r.law for r in rows} == {"key"} and {r.shard for r in rows} == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows) and any(r.grown_shard == 8 for r in rows)


def test_sharding_replaces_clashing_columns(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "x", 5, 9) for k in range(50)], "doc_id long, text string, law string, slot int, _bucket int")
    out = sharding.shuffle_into_shards(docs, 2)
    assert set(out.columns) == {"doc_id", "text", "law", "shard", "grown_shard", "slot"} and {r.law for r in out.collect()} == {"key"}


# 4


def test_rules_on_odd_rows(odd, empty):
    rows = quality_rules.clean_documents(odd).collect()
    assert len(rows) == len(odd_rows()) and all(not r.kept for r in rows if not (r.text or "").strip())
    ten = next(r for r in rows if r.doc_id == 10)
    assert (ten.n_words, ten.n_repeat_words, ten.base_failed) == (5000, 5000, True)
    assert quality_rules.clean_documents(empty).count() == 0


def test_rules_line_by_line(spark):
    good = "The quick brown fox jumps over the lazy dog and then it rests for a while near the old barn door."
    other = "Nobody had seen such a creature in these parts before, so people came from far away to look at it."
    text = "\n".join([good, "Home | About | News | Contact", other, "All rights reserved.", "#### $$$$ &&&& x.", "no mark here"])
    r = quality_rules.clean_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.cleaned_text == good + "\n" + other and r.kept


def test_long_lines_are_prose(spark):
    """A long line without an end mark, or about cookies, stays; words that only begin like a notice do."""
    long = " ".join(f"word{k}" for k in range(60)) + " accept cookies here and go on"
    rows = [(1, long), (2, "The log interest of a cookieless sign indicates a rise in trade between the two old towns on the river for many long years."), (3, long + "\nAccept cookies\n" + long + " again.")]
    got = {r.doc_id: r for r in quality_rules.clean_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].cleaned_text == long and got[2].kept and got[3].cleaned_text == long + "\n" + long + " again."


# 5


def test_ledger(spark):
    ledger = token_counts.Ledger(spark, shared.scratch(spark, "ledger"))
    rows = lambda *r: spark.createDataFrame(list(r), "source string, lang string, tokenizer_version string, n_tokens long")
    assert ledger.totals().count() == 0
    first = rows(("a", "en", "v1", 3), ("a", "en", "v1", 4), (None, None, "v1", 5), ("b", "de", "v1", None))
    assert ledger.commit("1", token_counts.inserts(first)) and not ledger.commit("1", token_counts.inserts(first))
    assert ledger.commit("2", token_counts.deletes(rows(("a", "en", "v1", 3))))
    before = spark.createDataFrame([(1, "a", "en", "v1", 4)], "doc_id long, source string, lang string, tokenizer_version string, n_tokens long")
    assert ledger.commit("3", token_counts.revisions(before, before.withColumn("n_tokens", F.lit(9).cast("long"))))
    assert ledger.commit("4", token_counts.inserts(rows()))
    assert {tuple(r) for r in ledger.totals().collect()} == {("a", "en", "v1", 1, 9), (None, None, "v1", 1, 5), ("b", "de", "v1", 1, 0)}


def test_ledger_ignores_what_is_not_committed(spark):
    """A batch whose marker is missing, or was never filled, counts for nothing and can be committed again."""
    path = shared.scratch(spark, "ledger")
    ledger = token_counts.Ledger(spark, path)
    rows = spark.createDataFrame([("a", "en", "v1", 1, 3)], "source string, lang string, tokenizer_version string, sign int, n_tokens long")
    assert ledger.commit("1", rows)
    name = ledger._named("1")
    ledger.files.delete(ledger._at("commits", "1"), False)
    assert ledger.totals().count() == 0 and not ledger.committed("1")
    ledger.files.create(ledger._at("commits", "1"), False).close()
    assert not ledger.committed("1") and ledger.totals().count() == 0
    assert ledger.commit("1", rows) and not ledger.commit("1", rows) and ledger._named("1") != name
    assert not ledger._mark("1", "other") and token_counts.Ledger(spark, path).totals().first().n_tokens == 3


def test_bpe_counts(spark, odd):
    files = {"a": TOKENIZER, "b": pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")}
    for r in token_counts.bpe_counts(odd.withColumn("a", F.lit("clash")), files).collect():
        for name, path in files.items():
            assert r[name] == len(tokens.BpeEncoder.load(path).encoding.encode_ordinary(r.text or ""))


def test_query_token_counts_against_brute_force(spark, data):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.defaultdict(lambda: [0, 0])
    for r in shared.documents(spark, data).collect():
        n = len(plain.encode(r.text or "", add_special_tokens=False).ids)
        if n >= 10:
            for version, c in (("byte_bpe_50k", n), ("byte_bpe_multi_50k", len(multi.encode_ordinary(r.text or "")) + 1)):
                own = want[r.source, r.lang, version]
                own[0] += 1
                own[1] += c
    got = queries.op5_token_counts(spark, data).collect()
    assert {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in got} == dict(want) and len(got) == len(want)


# 6


def test_quality_held_out(spark, data):
    docs = shared.documents(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = queries.op6_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert docs.count() and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_quality_odd_rows(odd, empty):
    model = quality_clf.train([("good words here.", 1), ("$$$ ### bad", 0)] * 10)
    rows = quality_clf.score_quality(odd, model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1 and quality_clf.score_quality(empty, model).count() == 0
    texts = [r[1] for r in odd_rows()]
    assert model.score(pa.array(texts)) == pytest.approx(np.concatenate([model.score(pa.array([t], pa.string())) for t in texts]))


def test_quality_scores_against_brute_force():
    """Means of bucket weights, feature by feature."""
    rng = np.random.default_rng(3)
    model = quality_clf.QualityModel(np.concatenate([[0.0], rng.normal(size=quality_clf.BUCKETS - 1)]), -0.2)
    texts = ["good words 12 here here.", "x", "", "tab\tnew\nline  ünï $$$ ###", "a b " * 50]
    shift, mask = 65 - quality_clf.BUCKETS.bit_length(), (1 << 64) - 1
    for text, got in zip(texts, model.score(pa.array(texts)), strict=True):
        data = bytes(0x30 if 0x30 <= b <= 0x39 else 0x20 if 9 <= b <= 13 else b for b in text.encode())
        words = [w for w in data.split(b" ") if w]
        ends = np.cumsum([len(w) for w in words]).astype(int)
        hashes = [int(h) for h in textops.span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)] if words else []
        ids = [naive_mix((h + 1) & mask) >> shift for h in hashes]
        ids += [1 if a == b else naive_mix((b * textops.BASE + a) & mask) >> shift for a, b in zip(hashes[:-1], hashes[1:], strict=True)]
        for n in quality_clf.GRAMS:
            for k in range(len(data) - n + 1):
                code = n
                for b in data[k : k + n]:
                    code = (code * 257 + b) & mask
                ids.append(naive_mix(code) >> shift)
        ids = [max(1, i) for i in ids]
        mean = np.mean([model.weight[i] for i in ids]) if ids else 0.0
        assert got == pytest.approx(1 / (1 + np.exp(-(mean + model.bias))), abs=1e-9)


def test_quality_sample_takes_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1), (2, 7), (None, 1)], "doc_id long, quality int")
    assert sorted(tuple(r) for r in quality_clf.labelled_sample(docs, labels).collect()) == [(1, "a", 1), (2, "c", 0)]


def test_quality_sample_of_repeated_labels(spark):
    """Twenty thousand labels of one id count once, and don't drive out others."""
    labels = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(1).alias("quality")).unionByName(spark.createDataFrame([(6, 0), (7, 1)], "doc_id long, quality int"))
    docs = spark.createDataFrame([(5, "x"), (6, "y"), (7, "z")], "doc_id long, text string")
    assert {r.doc_id for r in quality_clf.labelled_sample(docs, labels, most=3).collect()} == {5, 6, 7}
    assert quality_clf.labelled_sample(docs, labels, most=2).count() == 2
    model = quality_clf.fit(quality_clf.labelled_sample(docs, labels))
    same = quality_clf.train([("x", 1), ("y", 0), ("z", 1)])
    assert np.array_equal(model.weight, same.weight) and model.bias == same.bias
    assert quality_clf.fit(quality_clf.labelled_sample(docs, labels.limit(0))).bias == 0.0


@pytest.mark.parametrize("doc_id", [None, 3])
def test_language_sample_of_null_and_repeated_ids(spark, doc_id):
    """Rows of one id are rows like others: none of their languages is without a text."""
    one = spark.range(4000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.when(F.col("id") % 4 == 0, "fr").otherwise("en").alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    other = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("de").alias("lang"), F.concat(F.lit("wort "), "id").alias("text"))
    found = langid.labelled_sample(one.unionByName(other).withColumn("order", F.lit(1)).withColumn("rank", F.lit(1)), per_language=60).collect()
    assert collections.Counter(r.lang for r in found) == {"en": 60, "fr": 60, "de": 50}
    assert set(langid.fit(one.unionByName(other), per_language=60).languages) == {"en", "fr", "de"}


def test_many_languages_are_all_learned(spark):
    rows = spark.range(1200).select("id", F.format_string("l%03d", F.col("id") % 300).alias("lang")).select(F.col("id").alias("doc_id"), "lang", F.concat("lang", F.lit(" text")).alias("text"))
    assert langid.labelled_sample(rows, per_language=2).groupBy("lang").count().where("count = 2").count() == 300


def test_addresses_of_stores():
    assert [warc.address_of(x) for x in ("s3a://b/x", "gs://b/x", "abfs://c@a/x", "hdfs://n/x", "/tmp/x", "file:/tmp/x")] == ["s3://b/x", "gs://b/x", "abfss://c@a/x", "hdfs://n/x", "file:///tmp/x", "file:///tmp/x"]


def test_items_without_words_are_not_told(spark, monkeypatch):
    monkeypatch.setattr(decontam, "build_index", lambda ids, *a, f=decontam.build_index: f(ids, *a) if len(ids) < 10 else pytest.fail("too many items"))
    items = spark.range(1000).select(F.col("id").alias("item_id"), F.when(F.col("id") == 3, "one two").otherwise(F.when(F.col("id") % 2 == 0, " .,- ")).alias("text"))
    docs = spark.createDataFrame([(1, "zero one two three")], "doc_id long, text string")
    assert decontam.contamination(docs, items).first().n_hit == 2


# 7


def contaminated(text, items, window=13):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(word, lower(text or ""))
    hit, found = set(), set()
    for item, t in items:
        b = re.findall(word, lower(t or ""))
        n = min(window, len(b))
        grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("told", [1 << 20, 0])
def test_contamination_against_brute_force(spark, told):
    rnd = random.Random(9)
    vocabulary = [f"v{k}" for k in range(6)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(words(n))) for k, n in enumerate((40, 20, 13, 12, 5, 3, 1, 0, 30))] + [(20, None), (21, "v1 v2 v3 v4 v5 v0 v1 v2 v3 v4 v5 v0 v1 v2")]
    docs = [(k, " ".join(words(30) + items[k % 9][1].upper().split() + words(20) + items[(k + 1) % 9][1].split()[: 5 + k])) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "v1,v2;v3"), (40, docs[3][1]), (40, docs[3][1]), (103, " ".join(words(3000)))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontam.contamination(d, b, told_bytes=told).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, found = contaminated(r.text, items)
        assert (r.n_words, r.n_hit, list(r.item_ids)) == (n, hit, found), r.doc_id
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest() and r.contaminated == (hit > 0 and 20 * hit >= n)
    assert decontam.contamination(d.limit(0), b, told_bytes=told).count() == 0
    assert not any(r.n_hit for r in decontam.contamination(d, b.limit(0), told_bytes=told).collect())


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    for _ in range(200):
        shared_part = rng.integers(0, 5, 13).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 5, rng.integers(0, 20)).astype(np.uint64), shared_part])
        b = np.concatenate([shared_part, rng.integers(0, 5, rng.integers(0, 20)).astype(np.uint64)])
        prints = [set(g[decontam.winnow(g, 9)].tolist()) for g in (decontam.textops.ngram_hashes(a, 5), decontam.textops.ngram_hashes(b, 5))]
        assert prints[0] & prints[1]


# 8


def test_lm_base_and_gain(spark, odd, empty):
    data = "/root/testdata/sf0.001"
    rows = queries.op8_lm_scoring(spark, data).collect()
    texts = {r.doc_id: [*re.findall(WORD, lower(r.text or "")), None] for r in shared.documents(spark, data).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    count = collections.Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    for r in rows:
        t = texts[r.doc_id]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(count[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    got = lm.score_documents(odd.withColumn("held_out", F.col("doc_id") == 4)).collect()
    assert len(got) == len(odd_rows()) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_documents(empty.withColumn("held_out", F.lit(False))).count() == 0
    none = lm.score_documents(odd.withColumn("held_out", F.lit(True))).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 for r in none)


def test_lm_gains_on_held_out_documents(spark):
    """Nearly every held-out text is likelier than by its base, and tokens gain in the mean."""
    rows = [r for r in queries.op8_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.n_tokens > 1]
    assert np.mean([r.score > r.base_score for r in rows]) >= 0.85
    assert sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows) > 0.05


def vocabulary_of(counts, other_counts, discount=0.4):
    """Told tokens with falling counts, others with theirs, and the hashes of both."""
    rng = np.random.default_rng(0)
    hashes = rng.permutation(np.unique(rng.integers(1, 1 << 63, len(counts) + len(other_counts) + 9).astype(np.uint64) * np.uint64(2)))
    told, others = hashes[: len(counts)], hashes[len(counts) : len(counts) + len(other_counts)]
    leaf = (others >> np.uint64(48)).astype(np.int64)
    mass, types = np.bincount(leaf, other_counts, 1 << 16).astype(int), np.bincount(leaf, minlength=1 << 16)
    n, v = int(np.sum(counts) + np.sum(other_counts)), len(counts) + len(other_counts)
    return lm.Vocabulary(told, np.array(counts), mass, types, n, v, discount), told, others


def shares(vocabulary, hashes, counts):
    """log10 of the share of its leaf that each other token has; counts of 0 are unknown words."""
    codes = vocabulary.codes(hashes)
    leaf = vocabulary.leaf(codes)
    own = np.where(counts > 0, np.log10(np.maximum(counts - vocabulary.discount, 1e-9)), vocabulary.unknown[leaf])
    return codes, own - np.log10(vocabulary.weight[leaf])


def after(model, history, codes):
    """log10 of each code's probability after the history."""
    if not len(codes):
        return np.zeros(0)
    text = np.concatenate([np.append(history, c) for c in codes]).astype(np.int32)
    width = len(history) + 1
    return model.log10(text, np.arange(0, len(text), width))[width - 1 :: width]


@pytest.mark.parametrize("n_others", [0, 3, 90])
def test_lm_probabilities_sum_to_one(n_others):
    rng = np.random.default_rng(3)
    counts, other_counts = np.sort(rng.integers(2, 500, 3000))[::-1], rng.integers(1, 4, n_others)
    vocabulary, told, others = vocabulary_of(counts, other_counts)
    model = lm.MaxEnt.start(vocabulary)
    seen = [np.zeros(len(x)) for x in model.tables]
    codes = vocabulary.codes(told)
    assert codes.tolist() == list(range(3000))
    for _ in range(5):
        text = np.concatenate([rng.choice(codes, 3000), vocabulary.codes(rng.choice(others, 200))]) if n_others else rng.choice(codes, 3000)
        model.update(text.astype(np.int32), np.array([0]), 1.0, seen, rng)
    other_codes, own = shares(vocabulary, others, other_counts)
    leaves = np.arange(lm.SLOTS**vocabulary.levels)
    unknown = (lm.OTHER + (leaves << (30 - 4 * vocabulary.levels))).astype(np.int32)
    rest = vocabulary.unknown - np.log10(vocabulary.weight)
    total = sum((10.0 ** (after(model, [7, 3], c) + x)).sum() for c, x in ((codes, 0.0), (other_codes, own), (unknown, rest)))
    assert total == pytest.approx(1.0, abs=1e-4)


def test_lm_starts_from_exact_shares():
    """Without weights a told token has its share of the corpus, another its discounted one."""
    rng = np.random.default_rng(4)
    counts, other_counts = np.sort(rng.integers(5, 5000, 20000))[::-1], rng.integers(1, 4, 700)
    vocabulary, told, others = vocabulary_of(counts, other_counts)
    model = lm.MaxEnt.start(vocabulary)
    total = vocabulary.weight.sum() + counts.sum()
    assert after(model, [], vocabulary.codes(told)) == pytest.approx(np.log10(counts / total), abs=1e-4)
    codes, own = shares(vocabulary, others, other_counts)
    assert after(model, [], codes) + own == pytest.approx(np.log10((other_counts - vocabulary.discount) / total), abs=1e-4)


def test_lm_learns_words_of_every_class():
    """Words of each class, told or not, have softmaxes that histories change, which know words by themselves."""
    rng = np.random.default_rng(1)
    counts = 100000 - np.arange(30000)
    vocabulary, told, others = vocabulary_of(counts, np.full(5000, 3))
    ranks = [int(x) for k in range(lm.RARE) for x in (lm.Layout(vocabulary).first[k] + np.arange(2)) if x < 30000]
    first = np.concatenate([ranks, vocabulary.codes(others[:8])]).astype(np.int32)
    second = rng.permutation(first)
    pairs = np.stack([first, second], 1)
    model = lm.MaxEnt.start(vocabulary)
    before = np.array([after(model, [a], [b])[0] for a, b in pairs])
    seen = [np.zeros(len(x)) for x in model.tables]
    for _ in range(400):
        model.update(np.tile(pairs, (20, 1)).ravel(), np.arange(0, 40 * len(pairs), 2), 0.7, seen, rng)
    now = np.array([after(model, [a], [b])[0] for a, b in pairs])
    assert (now > before + 1).mean() >= 0.9
    assert np.mean([after(model, [a], [b])[0] > after(model, [a], [second[k - 1]])[0] for k, (a, b) in enumerate(pairs) if second[k - 1] != b]) >= 0.9


def test_lm_finds_told_tokens():
    rng = np.random.default_rng(6)
    hashes = np.unique(np.concatenate([rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), np.arange(1 << 20, (1 << 20) + 300).astype(np.uint64)]))
    hashes = rng.permutation(hashes)
    told = hashes[:4000]
    vocabulary = lm.Vocabulary(told, np.arange(4000)[::-1] + 1, np.zeros(1 << 16, int), np.zeros(1 << 16, int), 10**7, 4000, 0.5)
    codes = vocabulary.codes(hashes)
    assert codes[:4000].tolist() == list(range(4000)) and (codes[4000:] >= lm.OTHER).all()


def test_lm_rounds_take_all_rows(spark):
    vocabulary, _, _ = vocabulary_of(np.array([30, 20, 20]), np.zeros(0, int))
    encoded = spark.createDataFrame([(k, [0, 1, 2, 0, 1, 2, 0]) for k in range(10)], "doc_id long, codes array<int>").repartition(3)
    moved = [[np.abs(x).sum() for x in lm.train(encoded, vocabulary, rounds=k).lower] for k in (0, 1, 2)]
    assert moved[0][0] == 0 < moved[1][0] and 1.2 * moved[1][0] < moved[2][0]


def test_lm_long_texts_and_few_told_tokens(spark):
    """Texts of many steps; and with few told tokens, the rest find their counts by the join."""
    rnd = random.Random(2)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(rnd.choice((1, 30, 9000)))) for _ in range(40)]
    docs = spark.createDataFrame([(k, t, k % 5 == 0) for k, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    count = collections.Counter(w for k, t in enumerate(texts) if k % 5 for w in [*t.split(), None])
    n, v = sum(count.values()), len(count)
    for r in lm.score_documents(docs, told=16).collect():
        own = [*texts[r.doc_id].split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


# 9


def components(rows, n=4, percent=85):
    sets = {}
    for doc, text in rows:
        w = re.findall(WORD, lower(text or ""))
        sets.setdefault(doc, set()).update([frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()])
    sets = {d: next(iter(s)) for d, s in sets.items()}
    up = {d: d for d in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("short", [128, 4])
def test_jaccard_join_against_brute_force(spark, monkeypatch, short):
    """With lists of 4 as the most for pairs, and blocks of 8, families and their blocks do the work."""
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "BLOCK", 3072 if short == 128 else 8)
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randint(0, 3000)}"
    passage = [word() for _ in range(30)]
    originals = [[word() for _ in range(rnd.choice((60, 120, 200)))] for _ in range(6)]
    rows = []
    for k in range(160):
        t = list(originals[k % 6])
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 3, 6))):
            t[rnd.randrange(len(t))] = word()
        if k % 5 == 0:
            t = t + passage
        rows.append((k, " ".join(t)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "One  two"), (204, "a b c d"), (5, rows[5][1]), (205, " ".join(passage))]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))).collect()
    want = components(rows)
    assert len(got) == len(rows) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_jaccard_join_empty_and_null_ids(spark, odd, empty):
    assert ngram_join.jaccard_components(empty).count() == 0
    rows = ngram_join.jaccard_components(odd).collect()
    assert len(rows) == len(odd_rows()) and {r.component_id for r in rows if r.doc_id in (4, 5, 6, 11)} <= {4, 6}


@pytest.mark.parametrize("few", [1 << 19, 0])
def test_components_against_union_find(spark, few):
    rnd = random.Random(3)
    pairs = [(rnd.randint(-400, 400), rnd.randint(-400, 400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, 5000 + k) for k in range(300)] + [(7, 7)]
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(pairs, "u long, v long").repartition(3), few=few).collect()
    alone = {a for a, b in pairs if a == b} - {a for p in pairs if p[0] != p[1] for a in p}
    assert {tuple(r) for r in got} == {(a, root(a)) for a in up if a not in alone} and len(got) == len(up) - len(alone)
    assert connected_components(spark.createDataFrame([], "u long, v long"), few=few).count() == 0


def test_span_hashes_depend_on_bytes_only():
    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 1, 2, 7, 8, 9, 15, 16, 17, 40, 255, 256, 257, 3000) for _ in range(20)]
    words += [w + b"a" for w in words] + words

    def hashes(rows):
        ends = np.cumsum([len(w) for w in rows])
        return textops.span_hashes(np.frombuffer(b"".join(rows), np.uint8), ends - [len(w) for w in rows], ends)

    found = hashes(words)
    assert found.tolist() == [int(hashes([w])[0]) for w in words]
    assert len(set(found.tolist())) == len(set(words))


def test_divide_skip_forest_spans_all_links():
    rng = np.random.default_rng(8)
    for _ in range(30):
        base = np.arange(60)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0, 0.02, 0.05]), rng.integers(100, 400, 60), base + 1000 * (k % 3))) for k in range(40)]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        edges = ngram_join.divide_skip(np.concatenate(sets), bounds, 85, leaders=2)
        up = list(range(40))

        def root(a, up=up):
            while up[a] != a:
                a = up[a]
            return a

        for a, b in edges:
            up[root(a)] = root(b)
        for a in range(40):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    assert root(a) == root(b)


# 10


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "u\r\nv", ""), (0, "http://c", "<p>é</p>"), (0, "http://c", "<p>é</p>"), (5, "x", "\r\n\r\nWARC/1.1\r\n" * 3000), (None, "n", "<p>é</p>")]
    path, manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("bundle", F.lit(1)))
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path, manifest).collect())
    want = collections.Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        first = min(p for p, _, h in rows if p is not None and (h or "") == (html or ""))
        twin = page is not None and page > first
        want[page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if twin else "response", first if twin else None] += 1
    assert got == want
    for m in manifest.collect():
        content = spark.read.format("binaryFile").load(f"{path}/{m.bundle}.warc.zst").first().content
        headers, _ = warc.read_record(bytes(content), m.frame, m.offset)
        assert headers["WARC-Record-ID"] == f"<{warc.URN}{'null' if m.page_id is None else m.page_id}>"
    path, manifest = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(spark, path, manifest).count() == 0


def test_query_warc_against_brute_force(spark, data):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    first = {}
    for page in sorted(pages):
        first.setdefault(pages[page], page)
    want = set()
    for page, payload in pages.items():
        response = first[payload]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.add((page, len(payload), digest, "response" if page == response else "revisit", None if page == response else response))
    got = [tuple(r) for r in queries.op10_warc(spark, data).collect()]
    assert set(got) == want and len(got) == len(pages)
