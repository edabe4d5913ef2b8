"""Text functions: cleaning, normalising, tokens as Columns; chunks, stems, snippets and OSA distance as Arrow UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Stop-words, and characters that normalising drops.
STOP_WORDS = "a an any and are at for from how in is it my of on or that there the to what when where which who why with".split()
NOISE = r"""[!?$@#%^&*(){}\[\]~`"']"""


# Latin letters with a mark, and their letters.
DIACRITICS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśşšţťūůűźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorsssttuuuzzz")


_CHUNK = StructType([StructField("chunk_index", IntegerType()), StructField("byte_offset", IntegerType()), StructField("chunk_text", StringType())])


def clean(text: Column) -> Column:
    """Unix line ends, no control characters, at most one blank line in a row, single spaces, trimmed."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.regexp_replace(out, r"\A\s+|\s+\z", "")


def normalize_query(text: Column) -> Column:
    """Quotes around and noise signs off, dashes alike, single spaces and dashes, lower case."""
    out = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    out = F.regexp_replace(out, r"""(?s)\A(["'])(.*)\1\z""", "$2")
    out = F.regexp_replace(out, NOISE, "")
    out = F.regexp_replace(out, "[–—]", "-")
    out = F.regexp_replace(out, r"\s*-[\s\-]*", "-")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.lower(F.regexp_replace(out, r"\A\s+|\s+\z", ""))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def chunk_id(path: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws("#", path, index.cast("string")), 256)


def split_point(text: str, start: int, stop: int, least: int) -> int:
    """Where to cut at `stop` or before: after a paragraph, after a sentence, after a space; never within `least` of the start."""
    low = start + least if start + least <= stop else start
    cut = text.rfind("\n\n", max(0, low - 1), stop) + 2
    if cut > 1 and cut > low:
        return cut
    cut = max(text.rfind(end, low, stop + 1) for end in (". ", "!\n", "?\n")) + 1
    if cut > low:
        return cut
    cut = text.rfind(" ", low, stop) + 1
    return cut if cut > low else stop


def chunk_offsets(text: str, target: int = 1000, least: int = 500, most: int = 2000) -> list[tuple[int, int]]:
    """[(start, end)] of chunks that make up the text, cut near the target; a short rest after a cut goes with its chunk."""
    out, start, size = [], 0, len(text)
    while start < size:
        rest = size - start
        stop = size if rest <= target else min(split_point(text, start, start + target, least), start + most)
        if size - stop < least and rest <= most:
            stop = size
        out.append((start, stop))
        start = stop
    return out


@F.pandas_udf(ArrayType(_CHUNK))
def chunks(texts: pd.Series) -> pd.Series:
    def one(text):
        out, offset = [], 0
        for k, (a, b) in enumerate(chunk_offsets(text or "")):
            part = text[a:b]
            out.append({"chunk_index": k, "byte_offset": offset, "chunk_text": part})
            offset += len(part.encode())
        return out

    return texts.map(one)


def osa_distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


@F.pandas_udf(IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa_distance(x or "", y or "", 2) for x, y in zip(a, b, strict=True)])


_VOWEL = "aeiou"


def _consonants(word: str) -> str:
    out = ""
    for k, c in enumerate(word):
        vowel = c in _VOWEL or (c == "y" and k > 0 and out[k - 1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _consonants(word)))


def porter_stem(word: str) -> str:
    """The stemmer of Porter (1980), with suffix tables in place of its rules' text."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    has_vowel = lambda w: "v" in _consonants(w)
    doubled = lambda w: len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1] == "c"
    short = lambda w: len(w) > 2 and _consonants(w)[-3:] == "cvc" and w[-1] not in "wxy"

    def table(w, rows, least):
        for end, new in rows:
            if w.endswith(end):
                stem = w[: len(w) - len(end)]
                return stem + new if _measure(stem) > least else w
        return w

    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and has_vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif doubled(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and short(word):
                    word += "e"
                break
    if word.endswith("y") and has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = table(word, _STEP2, 0)
    word = table(word, _STEP3, 0)
    for end in _STEP4:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not short(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


# Suffixes of the published algorithm's steps 2 to 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    from functools import lru_cache

    stem = lru_cache(100_000)(porter_stem)
    return words.map(lambda row: [stem(w) for w in row] if row is not None else None)


def snippet_of(text: str, terms: set[str], width: int = 32) -> str:
    """The `width` tokens with most hits, hits in <b></b>, dots where text is left out."""
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    hits = [text[a:b].lower() in terms for a, b in spans]
    if not spans:
        return text
    best = max(range(max(1, len(spans) - width + 1)), key=lambda k: (sum(hits[k : k + width]), -k))
    chosen = range(best, min(len(spans), best + width))
    out, at = [], spans[best][0]
    for k in chosen:
        a, b = spans[k]
        out.append(text[at:a] + (f"<b>{text[a:b]}</b>" if hits[k] else text[a:b]))
        at = b
    return ("..." if best else "") + "".join(out) + ("..." if chosen[-1] + 1 < len(spans) else "")


def highlights(snippet: str) -> list[tuple[int, int]]:
    """(offset, length) of each marked span in the text without marks."""
    out, plain = [], 0
    for part in re.split(r"(<b>.*?</b>)", snippet, flags=re.S):
        if part.startswith("<b>") and part.endswith("</b>"):
            out.append((plain, len(part) - 7))
            plain += len(part) - 7
        else:
            plain += len(part)
    return out


def snippets(terms: list[str]):
    wanted = {t.lower() for t in terms}

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet_of(t or "", wanted))

    return run
