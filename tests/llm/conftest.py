from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"

#: Names that operators use for their own columns, and one that only the input has.
CLASHING = ["n_words", "kept", "score", "shard", "size", "seed", "node", "rows", "band", "uid", "dedup_spans",
            "mix_stream", "lid_lang", "bpe_ids", "tox_score", "component", "start", "row", "word", "key", "other_column"]


def _prose(seed: int, n: int) -> str:
    import random
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(["ta", "ri", "mo", "len", "sk"]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def prose():
    return _prose


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls in any column, empty, blank and very long texts, ties, repeated rows."""
    long = _prose(9, 30_000)
    near = _prose(3, 120)
    return [(1, _prose(1, 80), "en", "a"), (1, _prose(1, 80), "en", "a"), (2, _prose(1, 80), None, "b"),
            (3, None, "en", "a"), (4, "", "de", None), (5, " \n\t ", None, None), (None, _prose(2, 70), "de", "b"),
            (None, None, None, None), (6, near, "de", "a"), (7, near + " extra", "de", "a"), (8, long, "en", "a"),
            (9, "x", "en", "b"), (10, "12 34 -- ;;", "en", "b"), (11, "日本 😀 \u0000 é", "en", None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    rows = [(*r, len(r[1] or ""), *[f"c{k}" for k in range(len(CLASHING))]) for r in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
