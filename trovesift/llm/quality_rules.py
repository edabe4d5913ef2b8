"""Line-first quality rules, in SQL functions only.

Each line is judged by itself: navigation bars, symbol noise and shouting fail, and so do
short lines with a boilerplate notice or without an end mark. Failed lines are removed; a
document that loses more than `most_lost_percent` of its word characters is rejected,
and so is one that fails the base rules (too few words, too much repetition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the rules.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
BAR = r"(?<![^\x20\x09-\x0D])[|>](?![^\x20\x09-\x0D])"
SHOUT = r"!!(?![^\x20\x09-\x0D])"
END_MARK = r"[.!?…:;\x22”»)][\x27\x22)\]]*[\x20\x09-\x0D]*\z"
NOTICE = (
    r"(?:^|[^A-Za-z])(?i:all rights reserved|licensed under|released under|general public license|copyright|cookies?|privacy policy"
    r"|terms of (?:use|service)|subscribe|sign (?:in|up)|log ?in|click here|skip to content|javascript)(?:[^A-Za-z]|$)"
)
#: Lines of more words are prose: a missing end mark or a phrase of a notice doesn't fail them.
SHORT_LINE = 40


def line_fails(line: Column, symbols: Column, shouts: Column) -> Column:
    """True if a line with words fails a rule; a line without words never does.

    `symbols` and `shouts` tell whether the whole text has any, so that clean texts skip these rules.
    """
    words = F.regexp_count(line, F.lit(WORD))
    bars = F.regexp_count(line, F.lit(BAR))
    noise = F.regexp_count(line, F.lit(SYMBOL)) * 10 > F.length(F.regexp_replace(line, SPACE, ""))
    marked = symbols & ((noise & (words > 0)) | ((bars >= 2) & (bars * 5 >= words)))
    shouted = shouts & line.contains("!!") & (words >= 3) & (F.regexp_count(line, F.lit(SHOUT)) * 10 >= words * 3)
    return marked | shouted | (line.rlike(WORD) & (~line.rlike(END_MARK) | line.rlike(NOTICE)) & (words <= SHORT_LINE))


def word_metrics(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (words in windows found twice or more)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    last = F.col("n_words").cast("int") - window
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice("_hashes", i, F.lit(window)))))
    out = out.withColumn("_windows", windows)
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    indexed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("_sorted", F.when(repeated, F.sort_array(indexed)))
    twin = lambda k: F.get(F.col("_sorted"), k)["h"]
    found = F.filter("_sorted", lambda x, k: F.coalesce(x["h"] == twin(k - 1), F.lit(False)) | F.coalesce(x["h"] == twin(k + 1), F.lit(False)))
    out = out.withColumn("_at", F.sort_array(F.transform(found, lambda x: x["i"])))
    covered = F.transform("_at", lambda p, k: F.least(F.lit(window), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(window))))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    return (
        out.withColumn("word_chars", F.length(F.concat_ws("", "_words")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(whole, F.lit(SYMBOL)).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
        .drop("_words", "_hashes", "_windows", "_sorted", "_at", "_lines")
    )


def clean_documents(docs: DataFrame, min_words: int = 20, most_repeat_percent: int = 30, most_lost_percent: int = 50) -> DataFrame:
    """`docs` (doc_id, text, ...) with cleaned_text, the word metrics, base_failed and kept.

    Null and empty texts have no words, so they fail the base rules. Each row is judged
    alone: repeated rows, ties and extra columns make no difference, and an empty table
    gives an empty result. Columns that clash with those added are replaced.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    out = word_metrics(docs).withColumn("_lines", F.split(whole, "\n"))
    symbols, shouts = F.col("n_symbols") > 0, F.contains(whole, F.lit("!!"))
    out = out.withColumn("_good", F.filter("_lines", lambda x: ~line_fails(x, symbols, shouts)))
    same = F.size("_good") == F.size("_lines")
    out = out.withColumn("cleaned_text", F.when(same, whole).otherwise(F.array_join("_good", "\n")))
    left = F.when(same, F.col("word_chars")).otherwise(F.length(F.regexp_replace("cleaned_text", SPACE, "")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    kept = ~F.col("base_failed") & (100 * (F.col("word_chars") - left) <= most_lost_percent * F.col("word_chars"))
    return out.withColumn("base_failed", failed).withColumn("kept", kept).drop("_lines", "_good")


def keep_clean(docs: DataFrame, **rules) -> DataFrame:
    """The kept rows of `clean_documents`.

    The row number stands between the filter and what it needs: without it the optimizer
    would push the filter below the metrics and write them all out in its condition again.
    """
    judged = clean_documents(docs, **rules).withColumn("_at", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_at") >= 0)).drop("_at")


#: The same in DuckDB's SQL, whose patterns have no look-around: by word lists instead.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i,
    unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g
  FROM words WHERE len(w) >= 8),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM words),
parts AS (SELECT doc_id, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS w,
  length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM lines),
judged AS (
  SELECT doc_id, l, w, chars, len(w) > 0 AND (
    len(w) <= 40 AND NOT regexp_matches(l, '[.!?…:;\x22”»)][\x27\x22)\]]*[\x20\x09-\x0D]*\z')
    OR (len(list_filter(w, lambda x: x IN ('|', '>'))) >= 2 AND len(list_filter(w, lambda x: x IN ('|', '>'))) * 5 >= len(w))
    OR len(regexp_extract_all(l, '[#*$%&|<>]')) * 10 > chars
    OR (len(w) >= 3 AND len(list_filter(w, lambda x: suffix(x, '!!'))) * 10 >= len(w) * 3)
    OR len(w) <= 40 AND regexp_matches(l, '(?:^|[^A-Za-z])(?i:all rights reserved|licensed under|released under|general public license|copyright|cookies?|privacy policy|terms of (?:use|service)|subscribe|sign (?:in|up)|log ?in|click here|skip to content|javascript)(?:[^A-Za-z]|$)')
  ) AS fails FROM parts),
totals AS (
  SELECT doc_id, sum(chars) AS word_chars, sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost,
    count(*) FILTER (WHERE len(w) > 0) - count(DISTINCT l) FILTER (WHERE len(w) > 0) AS dup
  FROM judged GROUP BY doc_id),
based AS (
  SELECT a.doc_id, len(a.w) AS n_words, CAST(t.word_chars AS BIGINT) AS word_chars, len(regexp_extract_all(a.text, '[#*$%&|<>]')) AS n_symbols,
    t.dup AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, t.lost,
    len(a.w) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(a.w) AS base_failed
  FROM words a JOIN totals t ON t.doc_id = a.doc_id LEFT JOIN repeats r ON r.doc_id = a.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost <= 50 * word_chars AS kept FROM based
"""
