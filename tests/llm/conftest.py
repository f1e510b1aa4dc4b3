"""Small documents with the cases that every operator must stand."""

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "block string, words string, kept string, line string, component string")


def words_of(text):
    return WORD.findall(text or "")


def lower(word):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), word)


def make(spark, texts, ids=None):
    """Documents with extra columns whose names operators use themselves."""
    rows = [(i, t, "en", f"host{(i or 0) % 3}" if i != 5 else None, len(t or ""), "x", "y", "z", "l", "c")
            for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


def texts():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ß", "中文", "Ünï"]
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    out = []
    for i in range(60):
        lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 25))) for _ in range(r.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(r.randint(0, len(lines)), "Shared Footer line 12 of the site here")
        if i % 7 == 0:
            lines.append(passage)
        out.append("\n".join(lines))
    out += [out[3], out[3], out[8]]  # exact copies
    near = out[10].split()
    for k in range(6):  # near copies
        copy = list(near)
        copy[k * 3 % len(copy)] = f"changed{k}"
        out.append(" ".join(copy))
    out += [None, "", "  \n\t ", "one", "two words", "a b c d", "same same same same same same same same same same same",
            "long " * 30000, "x" * 5000, "# ### $$ %% | < > &"]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return make(spark, texts()).persist()


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, a null id, and nulls in every column."""
    t = texts()
    rows = [t[0], t[0], t[7], None, "null id " * 80, t[14]]
    out = make(spark, rows, [1, 1, 2, 3, None, 5])
    return out.unionByName(spark.createDataFrame([(None,) * 10], SCHEMA))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
