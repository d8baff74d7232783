import random

import pytest

LONG = 30_000


def prose(rng, words):
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words)) + "."


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that bend operators: null, empty, blank, controls, scripts, runs, specials."""
    rng = random.Random(5)
    fixed = [
        None, "", " ", "  ", " a", "a ", "a  b", "x\n\n y", "\t\r\n", "\x0b\x0c", "\x1c \x85", "a\x00b c", "<|endoftext|>", "foo <|endoftext|> bar<|endoftext|><|startoftext|>",
        "don't  we'll I'M 'S", "日本語 テスト 한국어", "ΑΣ ΣΑΣ.", "é ́ é", "İstanbul ǅ", "١٢٣ 12345", "🎉🎉 👨‍👩‍👧", "a b c", "aaaa" * 300, "!" * 1500, "ab" * 2000, "one", "one two", "One Two THREE",
    ]
    mixed = ["".join(rng.choice(" \n\tab'sé.1<|endoftext|>ΣA漢") for _ in range(60)) for _ in range(60)]
    return fixed + mixed + [prose(rng, 50) for _ in range(20)] + [prose(rng, LONG)]


@pytest.fixture()
def odd_docs(spark, odd_texts):
    """The odd texts with ids; one row twice, one without an id, extra columns with awkward names."""
    rows = [(i, t, "en", "s", 7, "x", b"y") for i, t in enumerate(odd_texts)]
    rows += [rows[20], (None, "no id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, _id int, `a.b` string, fp binary")


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
