import hashlib
import random
import zlib

import numpy as np
import pytest

from scriptoria.llm import tiff
from scriptoria.llm.op1_tiff import run


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_round_trip(order, big, kind, predictor, tile):
    rng = np.random.default_rng(1)
    pages = []
    for w, h, spp, bits in ((37, 41, 1, 8), (16, 5, 3, 8), (33, 9, 1, 16), (1, 1, 1, 8)):
        pixels = (rng.integers(0, 3, w * h * spp * bits // 8) * 60).astype(np.uint8).tobytes()
        pages.append({"pixels": pixels, "width": w, "height": h, "samples": spp, "bits": bits, "compression": kind, "predictor": predictor, "tile": tile, "rows_per_strip": 4})
    found = list(tiff.read_pages(tiff.write_pages(pages, order, big)))
    assert [p.page for p in found] == [0, 1, 2, 3]
    for p, q in zip(pages, found, strict=True):
        assert q.error is None and q.pixels == p["pixels"] and (q.width, q.height, q.samples, q.bits) == (p["width"], p["height"], p["samples"], p["bits"])


def test_codecs_on_hard_data():
    rng = random.Random(2)
    for data in (b"", b"a", b"ab" * 5000, bytes(10_000), rng.randbytes(30_000), bytes(rng.choice(b"ab") for _ in range(40_000)), b"a" * 300 + b"b"):
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
        assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data


def test_one_bit_rows_and_floating_point_prediction():
    bits = tiff.write_pages([{"pixels": bytes([0b10110000, 0b1, 0b11110000, 0b0]), "width": 12, "height": 2, "bits": 1, "compression": tiff.PACKBITS}])
    assert next(tiff.read_pages(bits)).pixels == bytes([0b10110000, 0b1, 0b11110000, 0b0])
    values = np.array([[1.5, -2.25, 3e9, 0.0]], "<f4")
    planes = values.view(np.uint8).reshape(1, 4, 4)[:, :, ::-1].transpose(0, 2, 1).reshape(1, 16).copy()  # most significant bytes first
    planes[:, 1:] -= planes[:, :-1].copy()
    assert tiff._undo(planes.tobytes(), 3, 1, 4, 1, 32, "<") == values.tobytes()


def test_damage_is_an_error_row_and_loops_end():
    good = tiff.write_pages([{"pixels": bytes(64), "width": 8, "height": 8}])
    assert list(tiff.read_pages(None)) == [] and list(tiff.read_pages(b"")) == []
    assert next(tiff.read_pages(b"junk")).error
    for cut in range(8, len(good), 7):
        assert all(p.error or p.pixels is not None for p in tiff.read_pages(good[:cut]))
    loop = bytearray(good)
    loop[-4:] = loop[4:8]
    assert len(list(tiff.read_pages(bytes(loop)))) == 1
    assert next(tiff.read_pages(good, limit=10)).error


def test_fixed_streams():
    """Streams written out by hand from the format's rules, not by this module's encoders."""
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")  # the example of the published PackBits description
    assert tiff.packbits_decode(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    # LZW of 7 7 7 8 8 7 7 6 6: codes 256 7 258 8 8 258 6 6 257, nine bits each, most significant first
    codes = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    stream = int(codes.ljust(-(-len(codes) // 8) * 8, "0"), 2).to_bytes(-(-len(codes) // 8), "big")
    assert tiff.lzw_decode(stream, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == stream


def test_pages_have_no_limit_but_what_their_bytes_can_hold():
    big = bytes(1 << 22)
    data = tiff.write_pages([{"pixels": big, "width": 64, "height": len(big) // 64, "rows_per_strip": 1 << 12}])
    assert next(tiff.read_pages(data)).pixels == big
    lie = tiff.write_pages([{"pixels": bytes(64), "width": 64, "height": 1, "compression": tiff.NONE}])
    for tag in (b"\x01\x01\x04\x00", b"\x16\x01\x04\x00"):  # the entries of the height and of the rows in a strip
        at = lie.index(tag)
        lie = lie[: at + 8] + b"\xff\xff\xff\x0f" + lie[at + 12 :]
    assert "can hold" in next(tiff.read_pages(lie)).error


def test_query(spark, sf_dir):
    import io

    out = {r["doc_id"]: r for r in run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(out) == len(docs)
    forms = set()
    for d in docs:
        raw = (d["text"] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = out[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        a = np.frombuffer(payload, np.uint8)
        bins = [int(((a >= 16 * k) & (a < 16 * k + 16)).sum()) for k in range(16)]
        assert r["feature"] == f"64x{len(payload) // 64} mean={a.mean():.4f} std={a.std():.4f} hist=" + ",".join(map(str, bins))
        form = tiff.layout(raw)
        forms.add((form["compression"], "tile" in form))
        pages = [{"pixels": payload[k : k + 64 * tiff.PAGE_ROWS], "width": 64, "height": len(payload[k : k + 64 * tiff.PAGE_ROWS]) // 64, **form} for k in range(0, len(payload), 64 * tiff.PAGE_ROWS)]
        stored = io.BytesIO(tiff.write_pages(pages)).getvalue()
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert forms == {(tiff.DEFLATE, False), (tiff.DEFLATE, True), (tiff.LZW, False), (tiff.PACKBITS, False)}


def test_long_texts_take_several_pages(spark):
    text = "".join(chr(97 + k * k % 26) for k in range(700_000))
    df = spark.createDataFrame([(1, text), (2, "b"), (1, text)], "doc_id long, text string").coalesce(1)
    keys = [("doc_id", "long")]
    pages = tiff.tiff_pages(tiff.texts_to_tiff(df), "media", keys)
    assert pages.where("doc_id = 1").count() == 2 * -(-700_000 // (64 * tiff.PAGE_ROWS))
    got = sorted((r["doc_id"], r["payload_sha256"]) for r in tiff.page_features(pages, keys).collect())
    want = hashlib.sha256(text.encode().ljust(-(-700_000 // 64) * 64, b"\0")).hexdigest()
    assert got == [(1, want), (1, want), (2, hashlib.sha256(b"b".ljust(64, b"\0")).hexdigest())]


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a" * 100_000, None), (3, "a" * 100_000, None), (None, "é", "z")], "doc_id long, text string, page string")
    keys = [("doc_id", "long"), ("n_bytes", "long")]
    out = tiff.tiff_pages(tiff.texts_to_tiff(df), "media", keys).collect()
    assert sorted((r["n_bytes"], r["height"]) for r in out) == [(0, 1), (0, 1), (2, 1), (100_000, 1563), (100_000, 1563)]
    assert tiff.tiff_pages(tiff.texts_to_tiff(df.where("false")), "media", keys).count() == 0
