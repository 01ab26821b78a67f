import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or (id, text) pairs."""

    def build(texts, lang="en", source="s"):
        pairs = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in pairs], DOC)

    return build


@pytest.fixture(scope="session")
def corpus():
    """Texts of made-up words that don't resemble one another."""
    import random

    r = random.Random(5)
    words = ["".join(r.choice("ban ker tol mi su pa dre vo ni le".split()) for _ in range(r.randint(1, 4))) for _ in range(300)]
    return [" ".join(r.choice(words) for _ in range(r.randint(30, 120))) + "." for _ in range(60)]
