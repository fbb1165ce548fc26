import random

import pytest

AWKWARD = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "it's we'll 'solo \n\n x's''s  ",
    "<|endoftext|> and <|startoftext|>x <|endoftext|>",
    "é中ñΣİ́ß ١٢٣    wide",
    "one two three four",
    "one two three four",
    "THE Quick brown fox, the quick brown fox; the quick brown fox.\nTHE Quick\nTHE Quick\n",
    "x" * 5000,
    "### $$$ " * 40,
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids and texts, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    rng = random.Random(3)
    vocabulary = ["the", "of", "Ration", "onwh", "ère", "uña", "it's", "42", "end.", "x,y"]
    rows = [(i, t, "en", "s0", 1) for i, t in enumerate(AWKWARD)]
    rows += [(None, "no id here", None, None, None), (3, "\n\n", "en", "s0", 1)]
    rows += [(100, " ".join(rng.choice(vocabulary) for _ in range(60_000)), "en", "s1", 1)]
    rows += [(200 + i, " ".join(rng.choice(vocabulary) + rng.choice(["", "a", "an", "th"]) for _ in range(rng.randint(5, 900))), "en", "s1", 1) for i in range(40)]
    extra = ", block string, slot int, word string, n_tokens string, score string, fingerprint int, kept int, quality int"
    return spark.createDataFrame([(*r, "b", 1, "w", "n", "s", 0, 0, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars int" + extra)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
