"""Full text: an inverted index as tables, BM25 ranking, name search and typo correction."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovesift.config import DEFAULTS, Settings
from trovesift.functions import text
from trovesift.sources.snapshots import Snapshots

#: A query's term, and whether it stands for all words that begin with it.
Term = tuple[str, bool]
POSTINGS = "term string, item_id long, chunk_index int, dl int, tf_name long, tf_path long, tf_content long"


def sanitize_strict(raw: str) -> list[list[str]]:
    """Terms and quoted phrases of a query, all of which must occur."""
    out = []
    quoted = raw.count('"') % 2 == 0
    for k, part in enumerate(raw.split('"') if quoted else [raw.replace('"', " ")]):
        part = re.sub(r"[*^:()]", " ", part).lower()
        words = re.findall(r"[^\W_]+", part)
        if k % 2 and quoted:
            out.extend([words] if words else [])
        else:
            out.extend([w] for w in words)
    return out


def sanitize_relaxed(raw: str) -> list[tuple[str, bool]]:
    """At most eight distinct terms, any of which may occur; (term, is a prefix)."""
    words = dict.fromkeys(w for w in re.findall(r"[a-z0-9_]+", raw.lower()) if len(w) >= 2 and w not in text.STOP_WORDS)
    return [(w, len(w) >= 4) for w in list(words)[:8]]


def fold(words: Column) -> Column:
    """Words without diacritics."""
    return F.transform(words, lambda w: F.regexp_replace(F.translate(w, *text.DIACRITICS), r"\p{M}+", ""))


FIELDS = ("name", "path", "chunk_text")


def _fields(chunks: DataFrame, stemming: bool, folding: bool) -> DataFrame:
    """(item_id, chunk_index, and the words of each field) of chunks (item_id, chunk_index, name, path, chunk_text)."""
    fields = chunks.select("item_id", F.col("chunk_index").cast("int").alias("chunk_index"), *(text.tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in FIELDS))
    if folding:
        fields = fields.select("item_id", "chunk_index", *(fold(F.col(c)).alias(c) for c in FIELDS))
    if stemming:
        fields = fields.select("item_id", "chunk_index", *(text.stems(c).alias(c) for c in FIELDS))
    return fields


FORWARD = "item_id long, chunk_index int, dl int, terms array<string>, tf_name array<int>, tf_path array<int>, tf_content array<int>"
#: Words that a worker counts at once (a chunk at least).
COUNTED_WORDS = 1 << 19


def _count(part: pa.RecordBatch) -> pa.RecordBatch:
    """The distinct words of each row, and how often each field has them."""
    lists = [part.column(k) for k in range(2, 5)]
    lengths = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists]
    words = pa.chunked_array([x.flatten().cast(pa.string()) for x in lists]).combine_chunks().dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    row = np.concatenate([np.repeat(np.arange(part.num_rows), n) for n in lengths])
    field = np.repeat(np.arange(3), [int(n.sum()) for n in lengths])
    size = max(1, len(words.dictionary))
    found, place = np.unique(row * size + words.indices.to_numpy().astype(np.int64), return_inverse=True)
    bounds = pa.array(np.searchsorted(found, np.arange(part.num_rows + 1) * size).astype(np.int32))
    counts = [np.bincount(place[field == k], minlength=len(found)).astype(np.int32) for k in range(3)]
    columns = [words.dictionary.take(pa.array(found % size)), *map(pa.array, counts)]
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sum(lengths).astype(np.int32)), *(pa.ListArray.from_arrays(bounds, c) for c in columns)], [x.split()[0] for x in FORWARD.split(", ")])


def _forward(fields: DataFrame) -> DataFrame:
    """FORWARD of `_fields`: a chunk's words are in its row, so they are counted there; no row for each word is made, hashed or shuffled."""

    def run(batches):
        for batch in batches:
            at = np.concatenate([[0], np.cumsum(sum(pc.fill_null(pc.list_value_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2, 5)))])
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(at, at[start] + COUNTED_WORDS, side="right")) - 1)
                yield _count(batch.slice(start, stop - start))
                start = stop

    return fields.select("item_id", "chunk_index", *FIELDS).mapInArrow(run, FORWARD)


def _postings(forward: DataFrame) -> DataFrame:
    entry = lambda term, *tf: F.struct(term.alias("term"), *(x.cast("long").alias(n) for x, n in zip(tf, ("tf_name", "tf_path", "tf_content"), strict=True)))
    words = F.transform(F.arrays_zip("terms", "tf_name", "tf_path", "tf_content"), lambda x: entry(x["terms"], x["tf_name"], x["tf_path"], x["tf_content"]))
    rows = forward.select("item_id", "chunk_index", "dl", F.inline(F.concat(F.array(entry(F.lit(""), *[F.lit(0)] * 3)), words)))
    return rows.select(*(x.split()[0] for x in POSTINGS.split(", ")))


def _once(rows: DataFrame) -> DataFrame:
    """Postings of chunks that come several times, added up."""
    return rows.groupBy("term", "item_id", "chunk_index", "dl").agg(*(F.sum(x).alias(x) for x in ("tf_name", "tf_path", "tf_content"))).select(*rows.columns)


def postings(chunks: DataFrame, stemming: bool = False, folding: bool = False) -> DataFrame:
    """POSTINGS of chunks (item_id, chunk_index, name, path, chunk_text). The empty term of each chunk holds its length.

    All words of a chunk are in one task, so they are counted before the shuffle.
    """
    return _once(_postings(_forward(_fields(chunks, stemming, folding))))


def document_frequency(index: DataFrame) -> DataFrame:
    """(term, df): chunks with each term."""
    return index.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))


def _terms(terms) -> list[Term]:
    return list(dict.fromkeys(t if isinstance(t, tuple) else (t, False) for t in terms))


def _is(word: Column, term: Term) -> Column:
    return word.startswith(term[0]) if term[1] else word == term[0]


def _scored(counted: DataFrame, totals, terms: list[Term], every: bool, s: Settings) -> DataFrame:
    """(item_id, chunk_index, rank) of rows (item_id, chunk_index, dl, tf0, tf1, ...) with the corpus's (n, avgdl, n0, n1, ...)."""
    average = totals["avgdl"] or 1.0
    score, has = F.lit(0.0), []
    for k in range(len(terms)):
        df = totals[f"n{k}"] or 0
        idf = max(math.log((totals["n"] - df + 0.5) / (df + 0.5)), 1e-6)
        w = F.col(f"tf{k}")
        score = score + F.lit(idf) * w * (s.bm25_k1 + 1) / (w + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * F.col("dl") / average))
        has.append(w > 0)
    rule = reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), has, F.lit(every and bool(has)))
    return counted.where(rule).select("item_id", "chunk_index", (-score).alias("rank"))


def bm25(chunks: DataFrame, terms: list, every: bool, settings: Settings = DEFAULTS) -> DataFrame:
    """(item_id, chunk_index, rank) of chunks with any (or every) term; rank is negative, lower is better.

    `terms` are words, or (word, whether it is a prefix). Without an index: two passes over
    the texts, with no shuffle but of sums. `Index.bm25` gives the same from postings.
    """
    terms = _terms(terms)
    weights = {"name": settings.name_weight, "path": settings.path_weight, "chunk_text": settings.content_weight}
    fields = chunks.select("item_id", "chunk_index", *(text.tokens(F.col(c)).alias(c) for c in weights))
    fields = fields.select("*", (F.size("name") + F.size("path") + F.size("chunk_text")).alias("dl"))
    count = lambda c, t: F.size(F.filter(F.col(c), lambda w: _is(w, t))) * F.lit(weights[c])
    tf = [sum((count(c, t) for c in weights), F.lit(0.0)).alias(f"tf{k}") for k, t in enumerate(terms)]
    counted = fields.select("item_id", "chunk_index", "dl", *tf)
    totals = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"n{k}") for k in range(len(terms)))).first()
    return _scored(counted, totals, terms, every, settings)


#: So many changed items are told to the scan of the forward table; more are joined with it.
TOLD_ITEMS = 10_000


class Index:
    """A persisted inverted index that grows: postings by term, terms by chunk, signed document frequencies and totals, all in one log of commits.

    A search reads the row groups of its terms only (the filter on the sorted column is
    pushed to the scan), so its cost goes with their postings, not with the corpus. A
    change writes the postings of the changed items, takes their old ones away by item,
    and adds what they change of the frequencies and totals, so scores are those of an
    index built anew. Postings are dealt by term and item: a term of every chunk is split.
    """

    TABLES = {"postings": POSTINGS, "forward": FORWARD, "frequencies": "term string, df long", "statistics": "n long, dl long", "lexicon": "term string, df long, first string"}

    def __init__(self, spark: SparkSession, path: str, version: int | None = None, stemming: bool = False, folding: bool = False) -> None:
        self.spark, self.path, self.stemming, self.folding = spark, path.rstrip("/"), stemming, folding
        self.log = Snapshots(spark, self.path, self.TABLES)
        self.state = self.log.state(version)
        read = lambda table: self.log.read(table, state=self.state)
        self.postings, self.forward = read("postings"), read("forward")
        self.frequencies = read("frequencies").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        totals = read("statistics").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).first()
        self.n = totals.n or 0
        self.average = totals.dl / totals.n if self.n else None

    @classmethod
    def build(cls, chunks: DataFrame, path: str, stemming: bool = False, folding: bool = False) -> Index:
        """A new index in place of what is at the path."""
        made = cls(chunks.sparkSession, path, stemming=stemming, folding=folding)
        made.log.commit(made._added(chunks, None), overwrite=tuple(cls.TABLES))
        return cls(made.spark, path, None, stemming, folding).learn_lexicon()

    def _opened(self) -> Index:
        return Index(self.spark, self.path, None, self.stemming, self.folding)

    @staticmethod
    def _laid(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange("term", "item_id").sortWithinPartitions("term", "item_id", "chunk_index")

    def _added(self, chunks: DataFrame | None, old: DataFrame | None) -> dict:
        """What a commit adds: postings and terms of `chunks`, and how they and the chunks that go (rows of `forward`) change the totals."""
        added = {}
        if chunks is not None:
            added["forward"] = _forward(_fields(chunks, self.stemming, self.folding)).sortWithinPartitions("item_id", "chunk_index")

            def laid(written):
                keys = written["forward"].groupBy("item_id", "chunk_index").agg(F.count("*").alias("n"))
                rows = _postings(written["forward"])
                return self._laid(rows if keys.where("n > 1").isEmpty() else _once(rows))

            added["postings"] = laid

        def frequencies(written):
            signed = []
            if chunks is not None:
                signed.append(document_frequency(written["postings"]))
            if old is not None:
                signed.append(old.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df")))
            return reduce(DataFrame.unionByName, signed).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").sortWithinPartitions("term")

        def statistics(written):
            parts = [written["forward"].select(F.lit(1).alias("sign"), "dl")] if chunks is not None else []
            parts += [old.select(F.lit(-1).alias("sign"), "dl")] if old is not None else []
            return reduce(DataFrame.unionByName, parts).agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("dl"))

        return added | {"frequencies": frequencies, "statistics": statistics}

    def _rows_of(self, gone: DataFrame) -> DataFrame:
        few = [r.item_id for r in gone.limit(TOLD_ITEMS + 1).collect()]
        if len(few) <= TOLD_ITEMS:
            return self.forward.where(F.col("item_id").isin(few))
        return self.forward.join(gone, "item_id", "left_semi")

    def replace(self, chunks: DataFrame, gone: DataFrame | None = None, once: tuple[str, int] | None = None) -> Index:
        """The index with the items of `chunks` in place of what it had of them, and without the items of `gone` (item_id), in one commit.

        What it writes goes with the change. Another writer's change of the same items in
        between makes it fail. Null ids are never replaced.
        """
        ids = chunks.select("item_id")
        ids = (ids if gone is None else ids.unionByName(gone.select("item_id"))).where("item_id is not null").distinct()
        taken = {table: ("item_id", ids) for table in ("postings", "forward")}
        self.log.commit(self._added(chunks, self._rows_of(ids)), taken, once=once, read=self.state.version)
        return self._opened()

    def delete(self, gone: DataFrame, once: tuple[str, int] | None = None) -> Index:
        """The index without the items of `gone` (item_id)."""
        ids = gone.select("item_id").where("item_id is not null").distinct()
        self.log.commit(self._added(None, self._rows_of(ids)), {table: ("item_id", ids) for table in ("postings", "forward")}, once=once, read=self.state.version)
        return self._opened()

    def merge(self, fanout: int = 8) -> Index:
        """The same index with segments of a size merged, so that a search opens few of them."""
        summed = {"frequencies": lambda df: df.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").sortWithinPartitions("term"), "statistics": lambda df: df.agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))}
        laid = {"postings": self._laid, "forward": lambda df: df.sortWithinPartitions("item_id", "chunk_index"), **summed}
        if sum(self.log.merge(table, fanout, arrange) for table, arrange in laid.items()):
            return self._opened().learn_lexicon()
        return self

    def learn_lexicon(self) -> Index:
        """Keep the terms that corrections choose among with the index; changes since are learned with the next merge."""
        self.log.commit({"lexicon": lexicon(self.frequencies)}, overwrite=("lexicon",))
        return self._opened()

    def lexicon(self) -> DataFrame:
        return self.log.read("lexicon", state=self.state)

    def compact(self, path: str) -> Index:
        """The same index at another path, in one segment a table; refuses one whose parts disagree."""
        if not self.whole():
            raise ValueError("the index is damaged")
        log = Snapshots(self.spark, path, self.TABLES)
        totals = self.spark.createDataFrame([(self.n, round((self.average or 0) * self.n))], self.TABLES["statistics"])
        log.commit({"postings": self._laid(self.postings), "forward": self.forward, "frequencies": self.frequencies, "statistics": totals, "lexicon": self.lexicon()}, overwrite=tuple(self.TABLES))
        return Index(self.spark, path, None, self.stemming, self.folding)

    def whole(self) -> bool:
        """Whether postings, frequencies and totals agree."""
        rows = self.postings.agg(F.count_if(F.col("term") != ""), F.count_if(F.col("term") == "")).first()
        return rows[0] == (self.frequencies.agg(F.sum("df")).first()[0] or 0) and rows[1] == self.n == self.forward.count()

    def bm25(self, terms: list, every: bool, settings: Settings = DEFAULTS) -> DataFrame:
        """As `bm25` of the chunks that the index was built from."""
        terms = _terms(terms)
        if not terms:
            return self.spark.createDataFrame([], "item_id long, chunk_index int, rank double")
        weight = F.col("tf_name") * settings.name_weight + F.col("tf_path") * settings.path_weight + F.col("tf_content") * settings.content_weight
        rows = self.postings.where(reduce(lambda a, b: a | b, (_is(F.col("term"), t) for t in terms)))
        tf = [F.sum(F.when(_is(F.col("term"), t), weight).otherwise(0.0)).alias(f"tf{k}") for k, t in enumerate(terms)]
        counted = rows.groupBy("item_id", "chunk_index", "dl").agg(*tf)
        found = counted.agg(*(F.count_if(F.col(f"tf{k}") > 0).alias(f"n{k}") for k in range(len(terms)))).first()
        return _scored(counted, {"n": self.n, "avgdl": self.average, **found.asDict()}, terms, every, settings)

    def strict(self, chunks: DataFrame, raw: str, settings: Settings = DEFAULTS) -> DataFrame:
        """Chunks (as `bm25`) with all terms and all phrases of a query; only hits of all words are looked at for phrases."""
        groups = sanitize_strict(raw)
        hits = self.bm25([w for g in groups for w in g], True, settings)
        for words in (g for g in groups if len(g) > 1):
            hits = hits.join(with_phrase(chunks, words).select("item_id", "chunk_index"), ["item_id", "chunk_index"], "left_semi")
        return hits

    def relaxed(self, raw: str, settings: Settings = DEFAULTS) -> DataFrame:
        return self.bm25(sanitize_relaxed(raw), False, settings)


def ranked(source: DataFrame | Index, terms: list, every: bool, settings: Settings = DEFAULTS) -> DataFrame:
    return source.bm25(terms, every, settings) if isinstance(source, Index) else bm25(source, terms, every, settings)


def best_chunks(hits: DataFrame) -> DataFrame:
    """The strongest chunk of each item: the lowest rank, the first chunk of equals."""
    best = hits.groupBy("item_id").agg(F.min(F.struct("rank", "chunk_index")).alias("b"))
    return best.select("item_id", "b.chunk_index", "b.rank")


def with_phrase(hits: DataFrame, words: list[str], column: str = "chunk_text") -> DataFrame:
    """Hits whose tokens have the phrase."""
    joined = F.concat(F.lit(" "), F.array_join(text.tokens(F.col(column)), " "), F.lit(" "))
    return hits.where(joined.contains(" " + " ".join(words) + " "))


def name_search(items: DataFrame, raw: str, most: int) -> DataFrame:
    """Items whose name has every token of more than one character; shortest names first."""
    rule = F.lit(True)
    for token in raw.lower().split():
        if len(token) > 1:
            rule = rule & F.lower("name").contains(token)
    return items.where(rule).orderBy(F.length("name"), "name", "item_id").limit(most)


# Neighbours of each letter on a QWERTY keyboard, itself included.
ADJACENT = {
    "q": "qwa", "w": "wqeas", "e": "ewrsd", "r": "retdf", "t": "tryfg", "y": "ytugh", "u": "uyihj", "i": "iuojk", "o": "oipkl", "p": "pol",
    "a": "aqwsz", "s": "sawedzx", "d": "dserfxc", "f": "fdrtgcv", "g": "gftyhvb", "h": "hgyujbn", "j": "jhuiknm", "k": "kjiolm", "l": "lkop",
    "z": "zasx", "x": "xzsdc", "c": "cxdfv", "v": "vcfgb", "b": "bvghn", "n": "nbhjm", "m": "mnjk",
}


def all_terms(frequencies: DataFrame) -> DataFrame:
    """(term, df, first) of all terms of `frequencies` (term, df) that corrections may choose among."""
    return frequencies.where(F.length("term") >= 2).withColumn("first", F.substring("term", 1, 1))


def lexicon(frequencies: DataFrame, names: DataFrame | None = None, per_letter: int = 5000, total: int = 100_000) -> DataFrame:
    """(term, df, first): of `frequencies` (term, df) the most frequent terms of each first letter, `total` at most; and words of `names` (name) that aren't among them."""
    terms = all_terms(frequencies)
    order = Window.partitionBy("first").orderBy(F.desc("df"), "term")
    top = terms.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_letter).drop("_r").orderBy(F.desc("df"), "term").limit(total)
    if names is None:
        return top
    words = names.select(F.explode(F.split(F.lower("name"), "[^a-z0-9]+")).alias("term")).where(F.length("term") >= 2).distinct()
    more = words.join(top.select("term"), "term", "left_anti").select("term", F.lit(1).cast("long").alias("df"), F.substring("term", 1, 1).alias("first"))
    return top.unionByName(more)


def typo_candidates(tokens: DataFrame, terms: DataFrame, most: int = 2, plain: bool = True, equal: bool = False, also: list[str] = ()) -> DataFrame:
    """(token, term, df, distance): lexicon terms near each token, joined by a neighbouring first letter and the length.

    The distance is Levenshtein's, or optimal string alignment with `plain=False`. Equal
    terms are no candidates but with `equal`; columns `also` of the terms stay.
    """
    near = F.create_map(*(F.lit(x) for k, v in ADJACENT.items() for x in (k, v)))[F.substring("token", 1, 1)]
    letters = F.explode(F.split(F.coalesce(near, F.substring("token", 1, 1)), "")).alias("first")
    keys = tokens.select("token", letters).where("first <> ''").distinct()
    close = F.abs(F.length("token") - F.length("term")) <= most
    pairs = keys.join(terms, "first").where(close & (F.lit(equal) | (F.col("token") != F.col("term"))))
    distance = F.levenshtein("token", "term") if plain else text.osa("token", "term")
    return pairs.withColumn("distance", distance).where(F.col("distance") <= most).select("token", "term", "df", "distance", *also)


#: Words of more letters are compared by first letter and length, as those that they drop are too many.
LONG_WORD = 24


def _dropped(word: Column, most: int) -> Column:
    """The word and what is left of it without up to `most` of its letters."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out = level = F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda w: F.length(w) > 0), without)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def many_typo_candidates(tokens: DataFrame, terms: DataFrame, most: int = 2, plain: bool = True, equal: bool = False, also: list[str] = ()) -> DataFrame:
    """As `typo_candidates`, for tables of tokens: words within `most` edits are equal once each has dropped up to `most` letters, so only such pairs are compared."""
    short = F.length("token") <= LONG_WORD
    far = typo_candidates(tokens.where(~short), terms.where(F.length("term") > LONG_WORD - most), most, plain, equal, also)
    near = tokens.where(short).distinct().select("token", F.explode(_dropped(F.col("token"), most)).alias("left"))
    left = terms.where(F.length("term") <= LONG_WORD + most).select("term", "df", "first", *also, F.explode(_dropped(F.col("term"), most)).alias("left"))
    letters = F.create_map(*(F.lit(x) for k, v in ADJACENT.items() for x in (k, v)))[F.substring("token", 1, 1)]
    begins = F.coalesce(letters, F.substring("token", 1, 1)).contains(F.col("first"))
    close = F.abs(F.length("token") - F.length("term")) <= most
    pairs = near.join(left, "left").where((F.col("first") != "") & begins & close & (F.lit(equal) | (F.col("token") != F.col("term")))).drop("left", "first").distinct()
    distance = F.levenshtein("token", "term") if plain else text.osa("token", "term")
    found = pairs.withColumn("distance", distance).where(F.col("distance") <= most).select("token", "term", "df", "distance", *also)
    return found.unionByName(far)


def corrections(tokens: DataFrame, terms: DataFrame, most: int = 2, candidates: Callable[..., DataFrame] = typo_candidates) -> DataFrame:
    """(token, term, df, distance): the nearest term of each token, the most frequent of equals; tokens without one are tried once more with runs of a letter as one."""

    def nearest(found: DataFrame) -> DataFrame:
        best = found.groupBy("token").agg(F.min(F.struct("distance", (-F.col("df")).alias("rare"), "term")).alias("b"))
        return best.select("token", "b.term", (-F.col("b.rare")).alias("df"), "b.distance")

    plain = nearest(candidates(tokens, terms, most))
    squeezed = lambda c: F.regexp_replace(c, r"(.)\1+", "$1")
    left = tokens.join(plain.select("token"), "token", "left_anti")
    runs = left.select(F.col("token").alias("whole"), squeezed("token").alias("token"))
    short = terms.select(F.col("term").alias("whole_term"), squeezed("term").alias("term"), "df", "first")
    again = candidates(runs.select("token").distinct(), short, most, equal=True, also=["whole_term"])
    again = again.join(runs, "token").select(F.col("whole").alias("token"), F.col("whole_term").alias("term"), "df", "distance").where("token <> term")
    return plain.unionByName(nearest(again))


def typo_confidence():
    """How sure a correction (token, term, df, distance) is: distance, frequency, and what the words share."""
    steps = F.when(F.col("df") >= 50, 0.26).when(F.col("df") >= 25, 0.22).when(F.col("df") >= 12, 0.18).when(F.col("df") >= 6, 0.13).when(F.col("df") >= 3, 0.08).otherwise(0.0)
    first = F.when(F.substring("token", 1, 1) == F.substring("term", 1, 1), 0.06).otherwise(-0.08)
    length = F.when(F.length("token") == F.length("term"), 0.05).otherwise(0.0)
    prefix = F.when(F.substring("token", 1, 2) == F.substring("term", 1, 2), 0.04).otherwise(0.0)
    token, size = F.col("token"), F.length("token")
    swap = lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.lit(1)), F.substring(token, i, F.lit(1)), F.substring(token, i + 2, size))
    swapped = (size == F.length("term")) & (size >= 2) & F.exists(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: swap(i) == F.col("term"))
    long = F.when((F.col("distance") == 2) & (F.length("token") >= 8), 0.05).otherwise(0.0)
    total = 0.48 + F.when(F.col("distance") == 1, 0.22).otherwise(0.10) + steps + first + length + prefix + F.when(swapped, 0.06).otherwise(0.0) + long
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
