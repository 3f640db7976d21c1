import pytest

from turnstone.functions import text as X
from turnstone.functions.udfs import split_sentences

TEXTS = [
    "Dr. Smith paid 3.50 dollars. He left at 5 p.m. and went home.",
    "Wait... what? Yes! \"Really?\" she said. J. K. Rowling wrote it.",
    "The U.S.A. is big. The U.S. economy grew. See e.g. the list: 1. apples 2. pears.",
    "No end here",
    "  spaces   kept?  yes. ",
    "Ellipsis… then lower. Ellipsis… Then upper.",
]


def squeeze(t):
    return " ".join(t.split())


@pytest.mark.parametrize("text", TEXTS)
def test_nothing_is_lost_and_chunking_does_not_matter(text):
    whole = split_sentences(text)[0]
    assert squeeze(" ".join(whole)) == squeeze(text)
    for n in (1, 3, 7):
        rest, out = "", []
        for i in range(0, len(text), n):
            found, rest = split_sentences(rest + text[i : i + n], False)
            out += found
        out += split_sentences(rest)[0]
        # A number that ends the text so far ends a sentence: only what follows shows that it counts a list.
        assert out == whole or "1. apples" in text and squeeze(" ".join(out)) == squeeze(text)


def test_boundaries():
    cut = lambda t: split_sentences(t)[0]
    assert cut("Dr. Smith paid 3.50. He left.") == ["Dr. Smith paid 3.50.", "He left."]
    assert cut("Ellipsis… then lower. Now.") == ["Ellipsis… then lower.", "Now."]
    assert cut("Buy 1. apples now.") == ["Buy 1. apples now."]
    assert cut("") == [] and cut("   ") == []
    assert split_sentences("Not yet.", False) == ([], "Not yet.") and split_sentences("Done. N", False) == (["Done."], "N")


def test_noise_is_stable(spark):
    rows = spark.createDataFrame([("a bc def ghij " * 200,), ("",), (None,)], "t string")
    noise = lambda **o: [r[0] for r in rows.select(X.noisy(rows.t, 3, **o)).collect()]
    assert noise() == noise() and noise()[1:] == ["", None]
    assert 600 < len(noise()[0].split()) < 790 and set(noise()[0].split()) == {"a", "bc", "def", "ghij"}
    assert noise(drop=0.0, swap=1.0)[0].split()[:4] == ["a", "cb", "fed", "jihg"]
    assert noise(drop=0.0)[0].split() == ["a", "bc", "def", "ghij"] * 200
