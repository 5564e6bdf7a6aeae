import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rid long, size long, name string, key string, label string, node string, _k1 int, _k2 int, _node int, _i int, _n int, _dropped int, _text int, score int, lang_pred string, known boolean, row int, k1 int, k2 int, t int, n_lines int, `a.b` int, id int, doc int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.6) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, and extra columns with clashing names."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    far = [w if i % 4 else "other" for i, w in enumerate(base.split())]
    texts = [(1, base), (2, base.upper()), (3, " ".join(near)), (4, " ".join(far)), (5, None), (6, ""), (7, "   \t\n "), (8, prose(2, 5000)), (9, prose(3, 3)), (9, prose(3, 3)), (None, prose(4, 50)), (None, None), (11, "Été \U0001f600 " * 30), (12, prose(5, 80) + "\n" + "a line that recurs in several places 17"), (13, "a line that recurs in several places 99\n" + prose(6, 80)), (14, prose(7, 80) + "\na line that recurs in several places 3\n" + prose(8, 10))]
    rows = [(i, t, ("en", "fr", None)[k % 3], ("b", "a", None, "c")[k % 4], k, 7, 7, "x", "y", "z", "n", *range(8), "xx", False, *range(8)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
