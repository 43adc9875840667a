import hashlib
import os
import subprocess
import sys

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline as P
from scriptoria.llm import jaccard, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = [(10**6 + k, x, None, "junk", len(x)) for k, x in enumerate(["абвгд ежзик лмноп рсту " * 9, "12345 67890 " * 20, "", "天地玄黃 宇宙洪荒 日月盈昃 " * 7] * 3)]
    docs.unionByName(spark.createDataFrame(junk, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, out[-1], sf_dir).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_stages_keep_the_columns_and_take_effect(steps):
    assert all(d.columns == COLUMNS for d in steps[:-1])
    rows = [{r["doc_id"]: r for r in d.collect()} for d in steps]
    junk = {i for i, r in rows[0].items() if i >= 10**6}
    assert len(junk) == 12 and not junk & set(rows[1])  # planted: no language of the table
    assert set(rows[1]) <= set(rows[0]) and len(rows[1]) >= 0.95 * (len(rows[0]) - len(junk))
    sets = {i: jaccard.shingle_set(r["text"], 5) for i, r in rows[1].items()}
    kept = sorted(rows[2])
    for a in kept:  # no two that stay are near copies
        for b in kept:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                assert 10 * both < 8 * (len(sets[a]) + len(sets[b]) - both)
    for i in set(rows[1]) - set(rows[2]):  # each that goes has a kept or removed near copy with a smaller id
        assert any(10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for j in sets if j != i)
    found = dict(zip(rows[2], pii.detector().find([r["text"] for r in rows[2].values()]), strict=True))
    for i, r in rows[3].items():
        assert r["text"] == pii.masked(rows[2][i]["text"], found[i][1]) and r["n_chars"] == len(r["text"])
    assert any(a for _, a in found.values())
    assert {i: tuple(r) for i, r in rows[4].items()} == {i: tuple(r) for i, r in rows[3].items()}
    from tokenizers import Tokenizer

    from scriptoria.llm.op2_bpe import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path())
    assert set(rows[5]) == set(rows[4])
    for i, r in rows[5].items():
        ids = library.encode(rows[4][i]["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_is_the_last_stage(spark, sf_dir, steps):
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(P.run(spark, os.path.dirname(steps[0].inputFiles()[0].removeprefix("file:").rpartition("/documents.parquet")[0] + "/x"))) == key(steps[-1])


def test_stages_on_odd_rows(spark, sf_dir):
    rows = [(1, "hello there my friend", "en", "a", 21), (2, None, None, None, None), (3, "", "fr", "", 0), (None, "bonjour le monde", "fr", "a", 16), (4, "hello there my friend", "en", "b", 21), (4, "hello there my friend", "en", "b", 21)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, slot int")
    for data in (docs, docs.where("false")):
        for _, f in P.STAGES[:-1]:
            out = f(spark, data, sf_dir)
            assert out.columns == data.columns and out.count() <= data.count()
        assert P.STAGES[-1][1](spark, data, sf_dir).count() == data.count()


def test_registry():
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_entry_imports_without_this_subpackage(tmp_path):
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(os.path.join(root, "scriptoria"), tmp_path / "scriptoria", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
