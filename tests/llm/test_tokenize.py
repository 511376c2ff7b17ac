import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from docmill.llm import tokenize  # noqa: E402


@pytest.fixture(scope="module")
def truth():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def test_same_ids_as_public_library(truth):
    rng = random.Random(1)
    bits = ["a", "б", "  ", " ", "\n", "\xa0", "1", "é", "​", "<|endoftext|>", "th", "ing", "x" * 300, "'s", "ё", "\U0001f600", "\r\n", "\x1c", " \t", "　"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(600)] + ["x" * 6000 + "аб" * 2000, " ", "\n\n"]
    flat, offsets = tokenize.encoder(tokenize.DEFAULT_VOCABULARY).encode_batch(texts)
    assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == truth(texts)


def test_query_defines_empty_null_repeated_and_extra_columns(spark, truth):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Акт № 5 <|endoftext|>", "y"), (4, "Акт № 5 <|endoftext|>", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokenize.encode(df).collect()}
    want = truth(["Акт № 5 <|endoftext|>"])[0]
    assert got == {1: [], 2: [], 3: want, 4: want}
    assert tokenize.encode(df.limit(0)).count() == 0
    counts = {r.doc_id: r.n_tokens for r in tokenize.token_counts(df, ["doc_id"]).collect()}
    assert counts == {1: 0, 2: 0, 3: len(want), 4: len(want)}
