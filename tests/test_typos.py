"""Typo candidates of tables of tokens."""

import random

from trovesift.operators import fulltext


def test_many_tokens_have_the_candidates_of_single_ones(spark):
    """Joined by what they drop, not by first letters: pairs that share nothing are never compared."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("aabcdeq") for _ in range(n))
    terms = sorted({word(rng.choice((1, 2, 3, 5, 8, 23, 24, 25, 26, 27))) for _ in range(300)} | {"été", "étés", "3a", "aab"})
    tokens = sorted({t[:k] + x + t[k + d :] for t in terms for k in (0, 1, len(t) - 1) for x, d in (("a", 0), ("", 1), ("q", 1), ("ba", 2), ("bb", 1))} | {"", "ét", *terms[:20]})
    lexicon = spark.createDataFrame([(t, k, t[0]) for k, t in enumerate(terms)], "term string, df long, first string")
    asked = spark.createDataFrame([(t,) for t in tokens], "token string")
    for most in (1, 2):
        for equal, plain in ((False, True), (True, True), (False, False)):
            want = sorted(map(tuple, fulltext.typo_candidates(asked, lexicon, most, plain, equal).collect()))
            assert sorted(map(tuple, fulltext.many_typo_candidates(asked, lexicon, most, plain, equal).collect())) == want and len(want) > 100
