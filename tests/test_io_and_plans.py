import io
import json
import tarfile

import numpy as np
from pyspark.sql import functions as F

from scriptoria.functions import kernels as K
from scriptoria.plans import pages
from scriptoria.sources import readers, writers
from scriptoria.streaming import live as stream


def test_readers(spark, tmp_path):
    (tmp_path / "dict.txt").write_text("а\nб\n \nв\n", encoding="utf-8")
    assert [(r[0], r[1]) for r in readers.dictionary(spark, str(tmp_path / "dict.txt"), "ж").orderBy("class_id").collect()] == [(1, "а"), (2, "б"), (3, " "), (4, "в"), (5, "ж")]
    (tmp_path / "freq.tsv").write_text("Lemma\tFreq(ipm)\nДом\t5.5\nдом\t7\n\t3\nкот\tx\n", encoding="utf-8")
    assert [tuple(r) for r in readers.lexicon(spark, str(tmp_path / "freq.tsv")).collect()] == [("дом", 7.0)]
    (tmp_path / "m.json").write_text(json.dumps([{"page": 2, "image": "a.png", "text": "т", "bubbles": [{"box": [1, 2, 3, 4], "text": "т"}]}, {"image": "b.png", "text": "у"}]), encoding="utf-8")
    rows = readers.manifest(spark, str(tmp_path / "m.json")).orderBy("ord").collect()
    assert rows[0]["bubbles"][0]["box"] == [1, 2, 3, 4] and rows[1]["page"] is None and rows[1]["ord"] == 2
    xml = "<corpus><sentence><source>Первое</source></sentence><sentence><source>Второе</source></sentence></corpus>"
    (tmp_path / "c.xml").write_text(xml, encoding="utf-8")
    assert sorted(r["text"] for r in readers.xml_sentences(spark, str(tmp_path / "c.xml")).collect()) == ["Второе", "Первое"]
    data = xml.encode()
    (tmp_path / "t").mkdir()
    with tarfile.open(tmp_path / "t" / "c.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("x/opencorpora_annot_2025.xml")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    assert [(r["seq"], r["text"]) for r in readers.tar_sentences(spark, str(tmp_path / "t" / "c.tar.gz")).orderBy("seq").collect()] == [(0, "Первое"), (1, "Второе")]
    (tmp_path / "img").mkdir()
    for name in ("p10.PNG", "p2.png", "p1.jpg", "note.txt"):
        (tmp_path / "img" / name).write_bytes(name.encode())
    found = readers.images(spark, str(tmp_path / "img")).orderBy("page").collect()
    assert [(r["page"], r["name"]) for r in found] == [(1, "p1.jpg"), (2, "p2.png"), (3, "p10.PNG")] and bytes(found[0]["content"]) == b"p1.jpg"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b.png", "два"), (1, "a.png", "раз")], "page int, name string, text string")
    writers.chapter(df, str(tmp_path / "chapter"))
    text = "".join(r["value"] + "\n" for r in spark.read.text(str(tmp_path / "chapter")).collect())
    assert "СТРАНИЦА 1: a.png" in text and "раз" in text
    writers.report(df.withColumn("cer", F.lit(None).cast("double")), str(tmp_path / "report"))
    assert "cer" in json.loads(spark.read.text(str(tmp_path / "report")).first()["value"])


def picture():
    image = np.full((60, 200, 3), 255, np.uint8)
    for x in (20, 29, 38, 110, 119, 128):  # two words of three strokes
        image[20:40, x : x + 6] = 0
    return image


def test_kernels():
    image = picture()
    assert K.trim(image).shape == (28, 122, 3)
    assert len(K.word_pieces(K.crop(image, 10, 10, 190, 50))) == 2
    assert K.preprocess(image).shape == (3, 48, 320)
    assert [v[0] for v in K.variants(image, True)] == ["raw", "gray", "otsu", "clahe", "otsu_inv", "adaptive"]
    assert len(K.variants(np.rot90(image), True)) == 8
    s = K.signature(image)
    assert s.shape == (32, 48) and abs(s.mean()) < 1e-9 and abs(np.abs(s).mean() - 1) < 1e-3
    assert abs(np.abs(K.device_signature(image)).mean() - 1) < 1e-9
    light = np.zeros((50, 50), np.uint8)
    light[5:20, 5:30] = 255
    light[30:40, 30:45] = 255
    assert sorted(K.regions(light)) == [(5, 5, 25, 15, 375), (30, 30, 15, 10, 150)]
    light[8:15, 10:25] = 0  # text in a bubble counts to it, and light within that text is no region of its own
    light[10:12, 12:14] = 255
    assert sorted(K.regions(light)) == [(5, 5, 25, 15, 375), (30, 30, 15, 10, 150)]
    light[18:31, 20:31] = 0
    light[19, 29] = light[20, 30] = 255
    assert len(K.regions(np.zeros((4, 4), np.uint8))) == 0 and len(K.regions(np.full((4, 4), 255, np.uint8))) == 1


def test_page_plan_with_a_made_up_recognizer(spark):
    def make_detector():  # local, so that workers get them by value
        return lambda image: [(10, 10, 190, 50)]

    def make_recognizer():
        return lambda crop: ("TeKcT" if crop.shape[1] < 60 else "мир", 0.97)

    image = picture()
    blank = np.full((20, 20, 3), 255, np.uint8)
    rows = [(1, bytearray(image.tobytes()), 60, 200, 3), (2, bytearray(blank.tobytes()), 20, 20, 3)]
    df = spark.createDataFrame(rows, "page long, data binary, height int, width int, channels int")
    out = {r["page"]: r for r in pages.recognize(df.where("page = 1"), make_detector, make_recognizer).collect()}
    assert out[1]["text"] == "Текст Текст"
    assert out[1]["certain"] and out[1]["confidence"] > 0.9 and out[1]["passes"] == 1
    none = pages.recognize(df, lambda: lambda image: [], make_recognizer).collect()
    assert all(r["text"] == "" and not r["certain"] for r in none) and len(none) == 2


def page_rows(spark, images):
    rows = [(k, bytearray(i.tobytes()), i.shape[0], i.shape[1], 3) for k, i in images.items()]
    return spark.createDataFrame(rows, "page long, data binary, height int, width int, channels int")


def test_extended_readings_and_the_second_engine_only_where_needed(spark, tmp_path):
    calls = str(tmp_path)

    def recognizer(name, sure):
        def make():
            def read(crop):
                import os
                import uuid

                open(os.path.join(calls, f"{name}-{uuid.uuid4().hex}"), "w").close()
                wide = crop.shape[1] >= 60
                return ("мир", 0.97) if sure or not wide else ("миг", 0.40)

            return read

        return make

    count = lambda name: sum(f.startswith(f"{name}-") for f in __import__("os").listdir(calls))
    df = page_rows(spark, {1: picture()})
    one = pages.recognize(df, lambda: lambda image: [(10, 10, 190, 50)], recognizer("sure", True)).collect()[0]
    pieces = len(one["text"].split())
    assert one["certain"] and count("sure") == 3 * pieces  # no extended reading
    out = pages.recognize(df, lambda: lambda image: [(10, 10, 190, 50)], recognizer("weak", False), make_second=recognizer("second", True)).collect()[0]
    assert count("weak") >= count("second") and count("second") % 6 == 0 and len(out["text"].split()) == pieces


def test_bubble_mode_needs_three_bubbles_and_takes_the_better(spark):
    def drawn(n):
        image = np.full((500, 400, 3), 120, np.uint8)
        for k in range(n):
            image[20 + 150 * k : 130 + 150 * k, 40:300] = 255
            image[60 + 150 * k : 80 + 150 * k, 80:120] = 0
        return image

    found = {r["page"]: [] for r in pages.bubbles(page_rows(spark, {1: drawn(3), 2: drawn(2)})).collect()}
    for r in pages.bubbles(page_rows(spark, {1: drawn(3), 2: drawn(2)})).collect():
        found[r["page"]].append((r["ord"], r["x"], r["y"], r["w"], r["h"]))
    assert sorted(found[1]) == [(k + 1, 40, 20 + 150 * k, 260, 110) for k in range(3)] and len(found[2]) == 2

    def make_recognizer():
        return lambda crop: ("мир", 0.97 if crop.shape[0] < 100 else 0.30)

    whole, part = (lambda: lambda image: [(0, 0, image.shape[1], image.shape[0])]), (lambda: lambda image: [(30, 30, 90, 70)])
    out = {r["page"]: r for r in pages.recognize(page_rows(spark, {1: drawn(3), 2: drawn(2)}), whole, make_recognizer, bubble_mode=True, make_bubble_detector=part).collect()}
    assert (out[1]["source"], out[1]["text"], out[1]["certain"]) == ("bubble", "мир\nмир\nмир", True)
    assert out[2]["source"] == "normal" and not out[2]["certain"]


def test_python_rounding_of_whole_batches(spark):
    from scriptoria.functions.geometry import python_round

    values = [0.12345, 0.12355, 2.5, 1.00005, 0.00015, -0.12345, 1e300, float("inf"), None, 0.99995, 123456.78905, 0.1 + 0.2] + [k / 20000 for k in range(400)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r["r"] for r in df.select("k", python_round(F.col("v"), 4).alias("r")).orderBy("k").collect()]
    assert got == [None if v is None else v if v == float("inf") else round(v, 4) for v in values]


def test_optional_files_may_be_missing(spark, tmp_path):
    nowhere = str(tmp_path / "nowhere.txt")
    assert readers.lexicon(spark, nowhere).count() == 0 and readers.manifest(spark, nowhere).count() == 0
    own = spark.createDataFrame([("a sentence of our own",)], "text string")
    assert readers.sentence_lines(spark, nowhere, fallback=own).count() == 1 and readers.sentence_lines(spark, nowhere).count() == 0
    (tmp_path / "short.txt").write_text("short\n", encoding="utf-8")
    assert readers.sentence_lines(spark, str(tmp_path / "short.txt"), fallback=own).count() == 1


def test_stream_keeps_state_over_batches(spark, tmp_path):
    schema = "session string, seq long, sig array<double>, text string, force boolean"
    frames = [("a", 1, [0.0], "x", False), ("a", 2, [0.001], "y", False), ("a", 3, [1.0], "z", False), ("a", 4, [1.0], "w", True), ("b", 1, [5.0], "q", False)]
    for k in range(0, len(frames), 2):  # one file, and so one batch, for two frames
        spark.createDataFrame(frames[k : k + 2], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = stream.run_to_memory(stream.suppress_repeats(source, "session", ["seq"], "sig", "text", force="force"), "frames_out").collect()
    got = {(r["session"], r["seq"]): (r["frame_id"], r["analyzed"], r["shown"]) for r in out}
    assert got == {("a", 1): (1, True, "x"), ("a", 2): (2, False, "x"), ("a", 3): (3, True, "z"), ("a", 4): (4, True, "w"), ("b", 1): (1, True, "q")}


def test_keep_latest(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "s string, seq int, v string").coalesce(1).write.json(str(tmp_path / "in"))
    seen = []
    q = stream.keep_latest(spark.readStream.schema("s string, seq int, v string").json(str(tmp_path / "in")), ["s"], ["seq"], lambda df, k: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(seen) == [("a", 2, "y"), ("b", 1, "z")]


def test_command_line(spark, tmp_path, capsys):
    from scriptoria.__main__ import main

    (tmp_path / "in.txt").write_text("TeKcTa , x\nроверка\n", encoding="utf-8")
    (tmp_path / "lex.tsv").write_text("Lemma\tFreq(ipm)\nпроверка\t900\n", encoding="utf-8")
    main(["normalize", str(tmp_path / "in.txt"), str(tmp_path / "a")], spark)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "a")).collect()) == ["Текста, х", "роверка"]
    main(["normalize", str(tmp_path / "in.txt"), str(tmp_path / "b"), "--lexicon", str(tmp_path / "lex.tsv")], spark)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "b")).collect()) == ["Текста, х", "проверка"]
    (tmp_path / "r.json").write_text('{"engine": "e", "page": 1, "text": "аб", "latency_sec": 0.5}\n', encoding="utf-8")
    (tmp_path / "m.json").write_text('[{"page": 1, "text": "ав"}]', encoding="utf-8")
    main(["score", str(tmp_path / "r.json"), str(tmp_path / "m.json"), str(tmp_path / "out")], spark)
    assert '"mean_cer":0.5' in capsys.readouterr().out


def test_image_source(spark, tmp_path):
    import struct
    import zlib

    def png(w, h, rgb):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        raw = (b"\0" + bytes(rgb) * w) * h
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    (tmp_path / "p10.png").write_bytes(png(3, 2, (10, 20, 30)))
    (tmp_path / "p2.png").write_bytes(b"broken")
    out = readers.pixels(spark, str(tmp_path)).orderBy("page").collect()
    assert [(r["page"], r["name"], r["data"] is None) for r in out] == [(1, "p2.png", True), (2, "p10.png", False)]
    assert (out[1]["height"], out[1]["width"], out[1]["channels"], bytes(out[1]["data"][:3])) == (2, 3, 3, bytes([30, 20, 10]))
    rows = spark.range(1).select(readers.cropped_rows(F.lit(10), 3, 0).alias("a"), readers.cropped_rows(F.lit(10), 30, 50).alias("b")).first()
    assert tuple(rows["a"]) == (3, 10) and tuple(rows["b"]) == (9, 10)
