import random

import pytest

VOCABULARY = [a + b for a in "ba de fi go hu ka le mi no pu ra se ti vo xu".split() for b in "l m n r s t".split()]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) rows, in the columns of the given table and two that clash with added ones."""
    def build(rows, clash=True):
        extra = ", n_words string, rows int" if clash else ""
        return spark.createDataFrame(
            [(i, t, None, "s", 0) + (("own", 7) if clash else ()) for i, t in rows],
            f"doc_id long, text string, lang string, source string, n_chars long{extra}")
    return build


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty, very long, repeated and near texts."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    rows = [(i, text(rng.randint(1, 90))) for i in range(10, 60)]
    passage = text(45)
    rows += [(60, text(30) + " " + passage + "\n" + text(8)), (61, passage), (62, passage + "  " + passage)]
    long = text(40000)
    rows += [(63, long), (64, long + " more"), (65, rows[0][1]), (66, rows[0][1] + " x"), (67, rows[0][1].upper())]
    rows += [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "Ünï çødé 日本  x\u0085y")]
    rows += [(70, rows[3][1]), (70, rows[3][1]), (71, text(50)), (None, text(60)), (None, None)]
    return rows
