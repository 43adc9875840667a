import glob

import corpus_pipeline as P
from scriptoria.llm import pfair
from scriptoria.llm.common import Scratch, checkpoint_dir


def test_the_mix_reaches_the_result_over_several_files(spark, tmp_path, monkeypatch):
    rows = [(k, f"text {k} " * (1 + k * 7 % 40), "en", "abc"[0 if k % 10 < 6 else 1 if k % 10 < 9 else 2], 0) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(P, "STAGES", [s for s in P.STAGES if s[1] in (P.mix_sources, P.encode)])
    key, written = "spark.sql.adaptive.coalescePartitions.enabled", []
    keep = Scratch.keep

    def counted(self, df):
        out = keep(self, df)
        written.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        out = P.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    assert all(n > 1 for n in written) and len(written) == 2
    assert len(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/pipeline-*/*")) >= 1  # the last table stays for its reader
    wanted = [(r["slot"], r["doc_id"]) for r in pfair.mix(docs).orderBy("slot", "doc_id").collect()]
    assert [r["doc_id"] for r in out] == [i for _, i in wanted]
    assert [(r["slot"], r["doc_id"]) for r in out] == wanted
