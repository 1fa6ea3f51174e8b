import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n int, sig string, rank int, part string, copies string, length string, tie string, sequence_id string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from (doc_id, text[, source]); further columns bear names that operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", 1, "x", 1, "x", "x", "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[k * 7 % 20] + str(k % 997) for k in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(docs):
    """Nulls, empty, blank, short, long and repeated texts; null and repeated ids."""
    near = [f"w{k}" for k in range(80)]
    return docs([
        (5, "a b c d e f g"), (3, "A B c D e f G", "t"), (9, None), (1, ""), (2, " \n\t "), (7, "one two", None), (8, "one two", None), (4, LONG, "t"), (None, "null id text of some words"), (None, "null id text of some words"),
        (6, "dup row with words in it"), (6, "dup row with words in it"), (11, " ".join(near)), (12, " ".join([*near[:79], "zz"])), (13, "Ünïcode 世界 𝒳   text"), (14, "x" * 5000), (2**62, None, None),
    ])
