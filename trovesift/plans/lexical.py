"""Full-text queries over the catalog's chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trovesift.catalog import query
from trovesift.functions import text
from trovesift.operators import fulltext
from trovesift.operators import rewrite
from trovesift.plans.relations import CONTENT, ITEMS, content, items, with_
from trovesift.sources.scratch import shared_folder

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_FIELDS = f"""fields AS (SELECT i.item_id, chunk_index, {_TOKENS.format('name')} AS n, {_TOKENS.format('path')} AS p, {_TOKENS.format('chunk_text')} AS c
  FROM content JOIN items i USING (item_id))"""


def _bm25(terms, every):
    rule = lambda t: f"starts_with(w, '{t[:-1]}')" if t.endswith("*") else f"w = '{t}'"
    tf = ", ".join(f"10.0 * len(list_filter(n, lambda w: {rule(t)})) + 5.0 * len(list_filter(p, lambda w: {rule(t)})) + 0.5 * len(list_filter(c, lambda w: {rule(t)})) AS tf{k}" for k, t in enumerate(terms))
    totals = ", ".join(f"count(*) FILTER (WHERE tf{k} > 0) AS n{k}" for k in range(len(terms)))
    score = " + ".join(f"greatest(ln((n_all - n{k} + 0.5) / (n{k} + 0.5)), 1e-6) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(terms)))
    rule = (" AND " if every else " OR ").join(f"tf{k} > 0" for k in range(len(terms)))
    return f"""{_FIELDS},
counted AS (SELECT item_id, chunk_index, len(n) + len(p) + len(c) AS dl, {tf} FROM fields),
totals AS (SELECT count(*) AS n_all, avg(dl) AS avgdl, {totals} FROM counted),
hits AS (SELECT item_id, chunk_index, -({score}) AS rank FROM counted, totals WHERE {rule})"""


def chunks(spark, sf_dir):
    return content(spark, sf_dir).join(items(spark, sf_dir).select("item_id", "name", "path"), "item_id")


_INDEXES: dict[tuple[str, str], fulltext.Index] = {}


def index(spark, sf_dir) -> fulltext.Index:
    """The index of the catalog's chunks, built once in a session for each data set, and read by all searches."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        _INDEXES[key] = fulltext.Index.build(chunks(spark, sf_dir), shared_folder(spark, "fulltext"))
    return _INDEXES[key]


@query(with_(ITEMS, CONTENT, _bm25(["with", "from", "are"], False)) + "SELECT item_id, chunk_index, round(rank, 6) AS rank FROM hits ORDER BY round(rank, 6), item_id LIMIT 50")
def bm25_relaxed(spark, sf_dir):
    hits = index(spark, sf_dir).bm25(["with", "from", "are"], every=False)
    return hits.withColumn("rank", F.round("rank", 6)).orderBy("rank", "item_id").limit(50)


@query(with_(ITEMS, CONTENT, _bm25(["the", "that", "pdf"], True)) + "SELECT item_id, chunk_index, round(rank, 6) AS rank FROM hits")
def bm25_strict(spark, sf_dir):
    terms = [w for phrase in fulltext.sanitize_strict("the that (pdf)") for w in phrase]
    return index(spark, sf_dir).bm25(terms, every=True).withColumn("rank", F.round("rank", 6))


@query(with_(ITEMS, CONTENT, _FIELDS) + "SELECT term, count(DISTINCT item_id) AS df FROM (SELECT item_id, unnest(list_concat(list_concat(n, p), c)) AS term FROM fields) GROUP BY term")
def doc_frequency(spark, sf_dir):
    return index(spark, sf_dir).frequencies


@query(with_(ITEMS, CONTENT, _bm25(["die", "der"], False)) + "SELECT item_id, arg_min(chunk_index, rank) AS chunk_index, round(min(rank), 6) AS rank FROM hits GROUP BY item_id")
def best_chunk_per_item(spark, sf_dir):
    return fulltext.best_chunks(index(spark, sf_dir).bm25(["die", "der"], every=False)).withColumn("rank", F.round("rank", 6))


@query(with_(CONTENT) + r"SELECT item_id FROM content WHERE contains(' ' || array_to_string(regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}]+'), ' ') || ' ', ' licensed under the ')")
def phrase_search(spark, sf_dir):
    phrase = fulltext.sanitize_strict('"licensed under the"')[0]
    return fulltext.with_phrase(content(spark, sf_dir), phrase).select("item_id")


@query()
def snippets(spark, sf_dir):
    """Snippets of the best 20 hits only: the UDF comes after the limit."""
    hits = fulltext.best_chunks(index(spark, sf_dir).bm25(["licensed", "license"], every=False)).orderBy("rank", "item_id").limit(20)
    return hits.join(content(spark, sf_dir), ["item_id", "chunk_index"]).select("item_id", text.snippets(["licensed", "license"])("chunk_text").alias("snippet"))


_TERMS = "terms AS (SELECT term, count(DISTINCT item_id) AS df FROM (SELECT item_id, unnest(list_concat(list_concat(n, p), c)) AS term FROM fields) GROUP BY term HAVING length(term) >= 2)"
_NEAR = rf"""tokens AS (SELECT unnest(['documnts', 'dwnloads', 'lisense', 'relesed', 'tht']) AS token),
adjacent(letter, near) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in fulltext.ADJACENT.items())}),
near AS (SELECT token, term, df, levenshtein(token, regexp_replace(term, '[^\x00-\x7F]', '?', 'g')) AS distance FROM tokens JOIN adjacent ON letter = substr(token, 1, 1) JOIN lexicon ON contains(near, first)
  WHERE abs(length(token) - length(term)) <= 2 AND token <> term)"""
_LEXICON = f"""{_TERMS},
lexicon AS (SELECT term, df, substr(term, 1, 1) AS first FROM (SELECT *, row_number() OVER (PARTITION BY substr(term, 1, 1) ORDER BY df DESC, term) AS r FROM terms) WHERE r <= 5000),
{_NEAR}"""
_ALL_TERMS = f"""{_TERMS},
lexicon AS (SELECT term, df, substr(term, 1, 1) AS first FROM terms),
{_NEAR}"""
_TYPOS = ["documnts", "dwnloads", "lisense", "relesed", "tht"]


def _typos(spark, sf_dir, plain=True, every=False):
    terms = fulltext.all_terms(index(spark, sf_dir).frequencies) if every else index(spark, sf_dir).lexicon()
    return fulltext.typo_candidates(spark.createDataFrame([(t,) for t in _TYPOS], "token string"), terms, plain=plain)


@query(with_(ITEMS, CONTENT, _FIELDS, _LEXICON) + "SELECT token, term, df, distance FROM near WHERE distance <= 2")
def typo_candidates(spark, sf_dir):
    return _typos(spark, sf_dir)


@query(with_(ITEMS, CONTENT, _FIELDS, _ALL_TERMS) + """SELECT token, term, round(least(1.0, greatest(0.0, 0.48 + CASE WHEN distance = 1 THEN 0.22 ELSE 0.10 END
  + CASE WHEN df >= 50 THEN 0.26 WHEN df >= 25 THEN 0.22 WHEN df >= 12 THEN 0.18 WHEN df >= 6 THEN 0.13 WHEN df >= 3 THEN 0.08 ELSE 0.0 END
  + CASE WHEN substr(token, 1, 1) = substr(term, 1, 1) THEN 0.06 ELSE -0.08 END + CASE WHEN length(token) = length(term) THEN 0.05 ELSE 0.0 END
  + CASE WHEN substr(token, 1, 2) = substr(term, 1, 2) THEN 0.04 ELSE 0.0 END
  + CASE WHEN length(token) = length(term) AND list_contains(list_transform(range(1, length(token)), lambda i: token[1:i - 1] || token[i + 1] || token[i] || token[i + 2:]), term) THEN 0.06 ELSE 0.0 END
  + CASE WHEN distance = 2 AND length(token) >= 8 THEN 0.05 ELSE 0.0 END)), 6) AS confidence FROM near WHERE distance <= 2""")
def typo_confidence(spark, sf_dir):
    """Among all terms of the index, not only the most frequent of each letter."""
    return _typos(spark, sf_dir, every=True).select("token", "term", F.round(fulltext.typo_confidence(), 6).alias("confidence"))


@query()
def typo_osa(spark, sf_dir):
    return _typos(spark, sf_dir, plain=False)


_TOP = "SELECT item_id, chunk_index, round(rank, 6) AS rank, '{}' AS origin FROM hits ORDER BY round(rank, 6), item_id LIMIT {}"


def _found(spark, sf_dir, raw, mode, typos=True):
    """All hits of a search, as in the SQL."""
    terms = index(spark, sf_dir).lexicon()
    hits, _ = rewrite.search(index(spark, sf_dir), chunks(spark, sf_dir), items(spark, sf_dir), terms, raw, mode, limit=None, typos=typos)
    return hits.withColumn("rank", F.round("rank", 6))


@query(with_(ITEMS, CONTENT, _bm25(["licensed", "under", "the"], True)) + r"""SELECT item_id, chunk_index, round(rank, 6) AS rank, 'strict' AS origin FROM hits JOIN content USING (item_id, chunk_index)
WHERE contains(' ' || array_to_string(regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}]+'), ' ') || ' ', ' licensed under ')""")
def search_strict(spark, sf_dir):
    """All terms, and the phrase."""
    return _found(spark, sf_dir, '"licensed under" the', "strict")


@query(with_(ITEMS, CONTENT, _bm25(["licen*", "gpl", "relea*"], False)) + "SELECT item_id, chunk_index, round(rank, 6) AS rank, 'relaxed' AS origin FROM hits")
def search_relaxed(spark, sf_dir):
    """Any term; those of four letters or more stand for all words that begin with them. The words are as meant: on large tables some word is near enough to pass for a correction."""
    return _found(spark, sf_dir, "Licen the GPL relea", "relaxed", typos=False)


@query(with_(ITEMS, CONTENT, _bm25(["documents*", "downloads*"], False)) + "SELECT item_id, chunk_index, round(rank, 6) AS rank, 'relaxed' AS origin FROM hits")
def search_auto(spark, sf_dir):
    """Nothing has these words, so the query is rewritten and relaxed."""
    return _found(spark, sf_dir, "documnets downlaods", "auto")


@query()
def typo_rewrite(spark, sf_dir):
    """Decisions for a batch of queries, a few rows each; unit tests hold the rules."""
    terms = index(spark, sf_dir).lexicon()
    found = [rewrite.decide(q, terms, 2) for q in ("documnets downlaods", "with the licence", "publc doman", "zzzzqqqq")]
    return spark.createDataFrame([(d.query, d.rewritten, round(d.confidence, 6), round(d.least, 6), d.considered, d.sure) for d in found], "query string, rewritten string, confidence double, least double, considered int, sure boolean")
