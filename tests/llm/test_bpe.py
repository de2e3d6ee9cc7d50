import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quirekit.llm import bpe

TEXTS = ["", "Hello world", "don't  stop\n\n now<|endoftext|>x <|endoftext|", "a" * 500, "thethethe" * 60, "ñandú 東京 123 456!!!  　 x", "\t\t \n x  ", "🙂🙂 é", "<|endoftext|>", " " * 300 + "a", "x" * 127 + " " + "y" * 129, "ab" * 3000]


@pytest.fixture(scope="module")
def tables():
    return bpe.Bpe(bpe.default_path())


def noise():
    rng = random.Random(3)
    letters = "abcdeéñß  \n.,'0123#東́🙂" + "theing" * 3
    return ["".join(rng.choices(letters, k=rng.randrange(400))) for _ in range(200)]


def test_ids_and_round_trip_equal_the_library(tables):
    library = Tokenizer.from_file(bpe.default_path())
    texts = TEXTS + noise()
    for text, ids in zip(texts, tables.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert tables.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_query_columns(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "x", "x"), (7, None, None), (7, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode(df, with_ids=True).collect()
    assert len(got) == len(rows)
    for (d, t, _), r in zip(rows, got):
        raw = np.array(r.ids, "<u4").tobytes()
        assert (r.doc_id, r.n_tokens, r.decoded) == (d, len(r.ids), t or "")
        assert r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(df.limit(0)).count() == 0
