import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Small invented documents with copies, near copies, shared lines, nulls and odd cases."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdéß") for _ in range(r.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    out = [prose(r.randint(1, 120)) for _ in range(60)]
    base = prose(100).split()
    for i in range(12):  # near copies of one text
        words = list(base)
        for _ in range(i % 4):
            words[r.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [out[0], out[0].upper(), out[1] + "\n" + out[1]]
    line = "This line stands in many of the documents"
    out += [f"{prose(5)}\n  {line.upper() if i % 2 else line}\t\n{prose(5)}\n{line}" for i in range(6)]
    out += [None, "", " ", "\n", "one", "one", "two words", "a b c", "A B C", "x " * 3000, "é" * 700, "<|endoftext|> and <|endoftext|>\n\n  x", "\n\n" + line, "ab" * 900]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names clash with internal ones."""
    rows = [(i, t, "src", "h", i % 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, doc string, h string, pos int").repartition(5, "doc_id")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
