import random

import pytest

WORDS = "the of and to in on harbor lights ferry timetable platform northbound señal größe été voilà signal vehicle route seven eleven ninety quartz".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n))


def corpus(seed: int = 5) -> list[tuple]:
    """(doc_id, text, lang): prose, copies, near copies, shared passages, nulls, blanks, one long text, a repeated row."""
    rng = random.Random(seed)
    passage, line = sentence(rng, 25), "Page 12 of 90 - all rights reserved"
    rows = []
    for i in range(60):
        text = "\n".join(sentence(rng, rng.randrange(1, 60)) for _ in range(rng.randrange(1, 4)))
        if i % 9 == 4:
            text = rows[i // 2][1] or ""
        if i % 11 == 5:
            words = (rows[i - 3][1] or "x").split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if i % 6 == 0:
            text += "\n" + passage
        if i % 4 == 1:
            text += "\n" + line.replace("12", str(i))
        rows.append((i * 3 + 7, text, "en"))
    rows[10] = (rows[10][0], None, "en")
    rows[11] = (rows[11][0], "", None)
    rows[12] = (rows[12][0], "  \n\t ", "en")
    rows[13] = (rows[13][0], "two words", "en")
    rows[14] = (rows[14][0], "Two WORDS", "en")
    rows[20] = (rows[20][0], " ".join(sentence(rng, 40) for _ in range(60)), "en")
    rows.append(rows[3])
    rows.append((None, rows[4][1], "en"))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """With extra columns whose names clash with those that operators make."""
    d = spark.createDataFrame([(*r, 1, "z") for r in corpus()], "doc_id long, text string, lang string, score int, bucket string")
    return d.repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
