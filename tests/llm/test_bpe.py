import hashlib
import random

import numpy as np
import pytest

from scriptoria.llm import bpe
from scriptoria.llm.op2_bpe import run, vocabulary_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def data():
    return open(vocabulary_path(), encoding="utf-8").read()


def ids(x):
    return np.frombuffer(x, "<u4").tolist()


def test_random_texts_as_the_library(library, data):
    rng = random.Random(4)
    pool = ["a", "aa", " ", "\n", "é", "日本", "<|endoftext|>", "<|endof", "'s", "'LL", "1", "  ", "x" * 17, "́", "🙂", "!!", "the", "\x1c", " ", " "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["", "a" * 50_000, " " * 3000, "ab" * 20_000]
    encoder, table = bpe.encoder(data), bpe.token_bytes(data)
    got = encoder.encode(texts)
    for t, g, w in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(g) == w.ids, t[:80]
        assert bpe.decode(g, table) == library.decode(w.ids, skip_special_tokens=False) == t
    assert encoder.encode([None]) == [b""]


def test_small_word_table_gives_the_same(library, data):
    encoder = bpe.Encoder(bpe.Vocabulary(data), room=50, batch_chars=200)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(30)) for _ in range(40)]
    assert [ids(x) for x in encoder.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bytes_that_are_no_text(data):
    table = bpe.token_bytes(data)
    k = table.index(b"\xff")
    assert bpe.decode(np.array([k], "<u4").tobytes(), table) == "�"


def test_query_and_edge_rows(spark, sf_dir, library):
    out = {r["doc_id"]: r for r in run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        w = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = out[d["doc_id"]]
        assert r["n_tokens"] == len(w) and r["ids_sha256"] == hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
    df = spark.createDataFrame([(None, None, 1), (1, "x y", 2), (1, "x y", 2)], "doc_id long, text string, ids int")
    assert sorted(r["n_tokens"] for r in bpe.bpe_encode(df, vocabulary_path()).collect()) == [0, 2, 2]


def test_unsupported_special_tokens_and_an_empty_table(spark, data):
    import json

    spec = json.loads(data)
    for flag in ("lstrip", "rstrip", "single_word", "normalized"):
        changed = json.loads(data)
        changed["added_tokens"][0][flag] = True
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(changed))
    assert spec["added_tokens"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_decode(bpe.bpe_encode(empty, vocabulary_path()), vocabulary_path()).count() == 0
