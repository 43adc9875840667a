import json
import struct
import zlib

import numpy as np
import pytest

from scriptoria.__main__ import plug
from scriptoria.operators import ctc, detect
from scriptoria.plans import chapter, pages
from scriptoria.sources import readers, writers


def png(path, image):
    """An 8-bit RGB image from BGR pixels."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = image.shape[:2]
    raw = b"".join(b"\0" + image[y, :, ::-1].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def picture():
    image = np.full((80, 200, 3), 255, np.uint8)
    image[:20] = 7  # what a reader cuts away
    for x in (20, 29, 38):
        image[40:60, x : x + 6] = 0
    return image


#: Plug-ins named on the command line.
def make_detector():
    return lambda image: [(0, 0, image.shape[1], image.shape[0])]


def make_recognizer():
    return lambda crop: ("TeKcT", 0.97)


def make_engine():
    def read(image):
        if image.shape[0] < 10:
            raise ValueError("too small")
        return "текст"

    return read


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    png(path / "p10.png", picture())
    png(path / "p2.png", picture())
    (path / "p1.png").write_bytes(b"broken")
    (path / "manifest.json").write_text(json.dumps([{"page": 1, "image": "p10.png", "text": "Текст"}, {"page": 3, "image": "p2.png", "text": "текст"}]), encoding="utf-8")
    return path


def test_rows_of_pixels_are_cut(spark, folder):
    found = readers.pixels(spark, str(folder))
    assert [(r["page"], r["name"]) for r in found.orderBy("page").collect()] == [(1, "p1.png"), (2, "p2.png"), (3, "p10.png")]
    cut = {r["page"]: r for r in chapter.cut_rows(found, 20, 70).collect()}
    assert sorted(cut) == [2, 3] and cut[2]["height"] == 50
    assert (pages.to_image(cut[2]["data"], 50, 200, 3) == picture()[20:70]).all()
    assert chapter.cut_rows(found, 30, 20).count() == 0


def test_scan_keeps_numbers_and_writes_the_chapter(spark, folder, tmp_path):
    found = chapter.scan(readers.pixels(spark, str(folder)), plug("tests.test_jobs:make_detector"), plug("tests.test_jobs:make_recognizer"), top=20)
    chapter.write_chapter(found, str(tmp_path / "out"))
    report = {r["page"]: r for r in spark.read.json(str(tmp_path / "out" / "report")).collect()}
    assert sorted(report) == [2, 3] and report[3]["source"] == "p10.png" and report[3]["text"] == "Текст" and report[3]["certain"]
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out" / "chapter")).collect())
    assert "СТРАНИЦА 2: p2.png" in text and text.index("p2.png") < text.index("p10.png")


def test_engines_side_by_side(spark, folder):
    png(folder / "a.png", np.zeros((4, 4, 3), np.uint8))
    found = readers.pixels(spark, str(folder), natural=False, suffixes=(".png",))
    rows = chapter.engine_rows(found, {"one": plug("tests.test_jobs:make_engine"), "broken": lambda: 1 / 0})
    got = {(r["engine"], r["page"]): r for r in rows.collect()}
    assert len(got) == 8  # a.png, p1.png, p10.png, p2.png
    assert "too small" in got["one", 1]["error"] and "loaded" in got["one", 2]["error"] and got["one", 3]["error"] is None
    assert all("ZeroDivisionError" in got["broken", k]["error"] and got["broken", k]["text"] == "" for k in (1, 2, 3, 4))
    scored, report = chapter.compare(rows, readers.manifest(spark, str(folder / "manifest.json")))
    assert {r["page"]: r["cer"] for r in scored.where("engine = 'one'").collect()} == {1: 1.0, 2: None, 3: 0.0, 4: None}
    means = {r["engine"]: (r["pages"], r["mean_cer"]) for r in report.collect()}
    assert means == {"one": (4, 0.0), "broken": (4, None)}


def test_commands(spark, folder, tmp_path, capsys):
    from scriptoria.__main__ import main

    plugs = ["--detector", "tests.test_jobs:make_detector", "--recognizer", "tests.test_jobs:make_recognizer"]
    main(["image", str(folder / "p2.png"), *plugs, "--json"], spark)
    assert json.loads(capsys.readouterr().out)["certain"]
    with pytest.raises(SystemExit):
        main(["image", str(folder / "p1.png"), *plugs], spark)
    main(["scan", str(folder), "--output", str(tmp_path / "s"), "--top", "20", *plugs], spark)
    assert spark.read.json(str(tmp_path / "s" / "report")).count() == 2
    main(["compare", str(folder), "--output", str(tmp_path / "c"), "--engine", "one=tests.test_jobs:make_engine", *plugs], spark)
    assert {json.loads(line)["engine"] for line in capsys.readouterr().out.strip().splitlines()} == {"one", "ours"}
    main(["evaluate", str(folder), "--output", str(tmp_path / "e"), *plugs], spark)
    assert json.loads(capsys.readouterr().out)["pages"] == 2


def plain_detections(rows, w, h, size=640, least=0.25, most=0.45):
    """The same by a loop."""
    scale = min(size / w, size / h)
    dx, dy = (size - round(w * scale)) // 2, (size - round(h * scale)) // 2
    boxes = []
    for seq, v in enumerate(rows):
        if v is None or len(v) < 6:
            continue
        if len(rows) > 100:
            scores = v[4:]
            score, cls = max(scores), scores.index(max(scores))
            x0, y0, x1, y1 = v[0] - v[2] / 2, v[1] - v[3] / 2, v[0] + v[2] / 2, v[1] + v[3] / 2
        else:
            x0, y0, x1, y1, score, cls = v[:6]
        x0, x1 = (int(max(0.0, min(w - 1.0, (x - dx) / scale))) for x in (x0, x1))
        y0, y1 = (int(max(0.0, min(h - 1.0, (y - dy) / scale))) for y in (y0, y1))
        if score > least and x1 > x0 and y1 > y0:
            boxes.append((-score, seq, int(cls), x0, y0, x1, y1))
    kept = []
    for b in sorted(boxes):
        def share(a, b=b):
            both = max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
            return both / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - both)

        if all(share(a) <= most for a in kept):
            kept.append(b)
    return [(k + 1, b[2], -b[0], *b[3:]) for k, b in enumerate(kept)]


def test_detector_output_of_both_layouts(spark):
    rng = np.random.default_rng(5)
    raw = [[*map(float, rng.uniform(100, 300, 2)), *map(float, rng.uniform(20, 90, 2)), *map(float, rng.uniform(0, 1, 3))] for _ in range(150)]
    short = [[float(x), float(y), float(x + 60), float(y + 40), float(s), float(k % 2)] for k, (x, y, s) in enumerate(zip(rng.integers(0, 200, 90), rng.integers(150, 300, 90), rng.uniform(0, 1, 90)))]
    short += [None, [1.0, 2.0], [5.0, 5.0, 5.0, 9.0, 0.9, 0.0]]
    rows = spark.createDataFrame([(p, k, v) for p, part in ((1, raw), (2, short)) for k, v in enumerate(part)], "page long, seq long, v array<double>")
    sizes = spark.createDataFrame([(1, 900, 1300), (2, 500, 400), (3, 10, 10)], "page long, width int, height int")
    out = detect.detections(rows, sizes).orderBy("page", "ord").collect()
    for page, part, w, h in ((1, raw, 900, 1300), (2, short, 500, 400)):
        assert [tuple(r)[1:] for r in out if r["page"] == page] == plain_detections(part, w, h)
    text = detect.detections(rows, sizes, only=detect.TEXT)
    assert {r["cls"] for r in text.collect()} == {detect.TEXT}
    other = spark.createDataFrame([(2, 1, 0, 0.5, 1, 1, 2, 2), (3, 1, 0, 0.5, 1, 1, 2, 2)], "page long, ord int, cls int, score double, x0 int, y0 int, x1 int, y1 int")
    assert [r["page"] for r in detect.with_fallback(text, other).where("score = 0.5 and x1 = 2").collect()] == [3]
    assert detect.detections(rows.limit(0), sizes).count() == 0


def test_small_verdict_without_a_vote(spark):
    df = spark.createDataFrame([(1, [[0.0, 0.95, 0.0], [0.0, 0.0, 0.91]]), (2, [[0.0, 0.5, 0.0]]), (3, [])], "id int, p array<array<double>>")
    got = {r["id"]: (r["raw_text"], r["text"], r["certain"]) for r in ctc.verdict(df, "p", "Tо").collect()}
    assert got == {1: ("Tо", "То", True), 2: ("T", "Т", False), 3: ("", "", False)}


def test_dataset_settings(spark, tmp_path):
    df = spark.createDataFrame([("train", "a.jpg", ["0 1 1 1 1"], ["c\tт"])], "split string, image string, labels array<string>, recognition_rows array<string>")
    writers.dataset(df, str(tmp_path / "d"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "d" / "dataset.yaml")).collect()]
    assert lines[1:] == ["train: images/train", "val: images/val", "names:", "  0: text", "  1: bubble"]


def test_confidence_of_rows_of_text(spark):
    words = [(1, 0, 0, 0, 0, 20, 10, "a", 0.9, True, 1), (1, 1, 0, 30, 2, 50, 12, "b", 0.4, False, 4), (1, 2, 0, 0, 40, 20, 50, "c", 0.8, True, 2)]
    found = spark.createDataFrame(words, "page long, box long, piece long, x0 int, y0 int, x1 int, y1 int, text string, confidence double, certain boolean, passes int")
    assert [tuple(r) for r in pages.line_rows(found).orderBy("row").collect()] == [(1, 1, 0.4, False, 4), (1, 2, 0.8, True, 2)]
    assert [tuple(r) for r in pages.page_text(found.replace({"a": "б", "b": "в", "c": "г"}, subset=["text"])).collect()] == [(1, "б в\nг", 0.4, False, 4)]
