import random

import pytest


def _words(rng, n):
    return " ".join("".join(rng.choice(["ta", "ko", "mi", "ser", "lun", "pa"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Invented documents: plain ones, copies, near copies, a shared passage, odd bytes, empty and long ones, nulls."""
    rng = random.Random(5)
    passage = _words(rng, 60)
    out = [_words(rng, rng.randint(6, 250)) for _ in range(60)]
    out += [out[3]] * 25 + [out[4]] * 2 + [out[5].upper()]
    for i in range(30):  # near copies of one text, a few words changed each
        words = out[7].split() if len(out[7].split()) > 80 else (out[7] + " " + passage).split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = _words(rng, 1) + str(i)
        out.append(" ".join(words))
    out += [f"{_words(rng, 20)} {passage} {_words(rng, 30)}" for _ in range(12)]
    out += ["", None, " ", "\n\t ", "one", "one two three four", "One two three FOUR", "a  b\tc d", "héé ñandú 你好   emoji 😀", "x" * 5000, _words(rng, 30_000)]
    return out


@pytest.fixture
def docs(spark, texts):
    """The texts under ids in random order, with columns named like those that operators use inside."""
    ids = random.Random(9).sample(range(10_000), len(texts))
    rows = [(i, t, "en" if i % 2 else None, "src", i, None, i % 3) for i, t in zip(ids, texts, strict=True)]
    schema = "doc_id long, text string, lang string, `kept` string, id long, `k` string, `_c0` int"
    return spark.createDataFrame(rows, schema).repartition(3).persist()


@pytest.fixture
def empty(docs):
    return docs.where("1 = 0")
