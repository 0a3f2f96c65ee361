import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, data string, score double, tokens int"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = ["ba", "ce", "di", "fo", "gu", "ñe", "lé", "mi", "no"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + ("." if rng.random() < 0.1 else "") for _ in range(words))


@pytest.fixture(scope="session")
def awkward():
    """Texts by id: null, empty, blank, short, copies, near copies, periodic, a very long one, ties."""
    base, other = prose(1, 120), prose(2, 150)
    near = base.split(" ")
    near[60] = "changed"
    return {
        0: None, 1: "", 2: " \n\t ", 3: "one", 4: "ONE", 5: "one two three four", 6: base, 7: base, 8: " ".join(near), 9: other + "\n" + base, 10: "a b " * 200, 11: "x" * 500,
        12: "x" * 400 + "é" * 300, 13: prose(3, 6000), 14: prose(4, 40) + " " + base[100:400], 15: "é" * 180, 16: "\n".join([prose(5, 12)] * 20), 17: base.upper(), 18: "THE###  end%%% " * 30,
        19: "日本語 テスト　空白 " * 20, 20: other[::-1],
    }


@pytest.fixture(scope="session")
def documents(spark, awkward):
    """As a table with columns whose names the operators use themselves."""
    rows = [(i, t, None, "s", len(t or ""), "c", "d", 0.5, 3) for i, t in awkward.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
