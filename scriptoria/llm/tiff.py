"""TIFF columns: one row per page, and a lossless writer.

`read_pages` walks the image directories of classic TIFF and BigTIFF in either byte order,
decodes raw, PackBits, LZW and deflate strips and tiles, and undoes horizontal differencing
and floating-point prediction. `tiff_pages` applies it to a column of a DataFrame.

Defined cases: null or empty media give no page rows; bytes that are no TIFF, and directories
that cannot be decoded or state a page larger than their stored bytes can hold, give one row with `error`
set and null pixels; directory chains with a loop end where they close; very long texts are whole, on as
many pages as they need; repeated input rows give repeated output rows; an empty table gives no rows. Columns of
the input other than the named keys are not carried, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptoria.llm.common import arrow_map, sha, slices, to_arrow

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
#: Other numbers under which deflate is stored.
DEFLATE_CODES = (8, 32946)
#: Tags of the TIFF 6.0 specification (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 317, 322, 323, 324, 325, 339
#: Field types: code -> (struct letter, bytes); fixed values of the specification.
FIELD = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}


#: Bytes that one stored byte can stand for at most, by the codecs' formats.
MOST = {NONE: 1, PACKBITS: 64, LZW: 2731, 8: 1032, 32946: 1032}


class TiffError(ValueError):
    pass


@dataclass
class Page:
    page: int
    width: int = 0
    height: int = 0
    samples: int = 0
    bits: int = 0
    compression: int = 0
    predictor: int = 1
    photometric: int = 0
    pixels: bytes | None = None
    error: str | None = None


# ---------------------------------------------------------------- codecs


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more become run packets, the rest literal packets."""
    if not data:
        return b""
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate(([0], edges))
    ends = np.concatenate((edges, [a.size]))
    long = np.flatnonzero(ends - starts >= 3)
    out, at = [], 0

    def literal(lo: int, hi: int) -> None:
        for k in range(lo, hi, 128):
            part = data[k : min(k + 128, hi)]
            out.append(bytes([len(part) - 1]) + part)

    for i in long:
        lo, hi = int(starts[i]), int(ends[i])
        literal(at, lo)
        for k in range(lo, hi, 128):
            n = min(128, hi - k)
            out.append(bytes([257 - n, data[lo]]) if n > 1 else bytes([0, data[lo]]))
        at = hi
    literal(at, a.size)
    return b"".join(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, have = [], 0, 0
    while at < len(data) and have < size:
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
            continue
        out.append(part)
        have += len(part)
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, with the early width change TIFF asks for."""
    acc = bits = 0
    out = bytearray()
    table = {bytes([i]): i for i in range(256)}
    width, following = 9, 258

    def put(code: int) -> None:
        nonlocal acc, bits
        acc = (acc << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    put(256)
    held = b""
    for value in data:
        longer = held + bytes([value])
        if longer in table:
            held = longer
            continue
        put(table[held])
        table[longer] = following
        following += 1
        if following == 4094:
            put(256)
            table = {bytes([i]): i for i in range(256)}
            width, following = 9, 258
        elif following >= 1 << width:  # the reader's table is one entry behind
            width += 1
        held = bytes([value])
    if held:
        put(table[held])
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    entries, width, out, have = list(single), 9, [], 0
    acc = bits = at = 0
    last = b""
    while have < size:
        while bits < width:
            if at >= len(data):
                return b"".join(out)[:size]
            acc = ((acc << 8) | data[at]) & 0xFFFFFFFF
            at += 1
            bits += 8
        bits -= width
        code = (acc >> bits) & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            entries, width, last = list(single), 9, b""
            continue
        if not last:
            if code > 255:
                raise TiffError("LZW code before any literal")
            word = entries[code]
        else:
            if code < len(entries):
                word = entries[code]
            elif code == len(entries):
                word = last + last[:1]
            else:
                raise TiffError("LZW code beyond the table")
            if len(entries) < 4096:
                entries.append(last + word[:1])
        out.append(word)
        have += len(word)
        last = word
        if len(entries) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)[:size]


def _inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size) if size else b""
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from None


def _decode(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        return data[:size]
    if kind in DEFLATE_CODES:
        return _inflate(data, size)
    if kind == PACKBITS:
        return packbits_decode(data, size)
    if kind == LZW:
        return lzw_decode(data, size)
    raise TiffError(f"compression {kind} is not supported")


def _encode(kind: int, data: bytes) -> bytes:
    if kind == NONE:
        return data
    if kind in DEFLATE_CODES:
        return zlib.compress(data, 1)
    if kind == PACKBITS:
        return packbits_encode(data)
    if kind == LZW:
        return lzw_encode(data)
    raise TiffError(f"compression {kind} is not supported")


def _undo(block: bytes, predictor: int, rows: int, width: int, spp: int, bits: int, order: str) -> bytes:
    """Samples of a block, in the file's byte order, with the prediction undone."""
    if predictor == 1:
        return block
    if predictor == 2 and bits in (8, 16, 32):
        kind = np.dtype(f"{order}u{bits // 8}")
        a = np.frombuffer(block, kind).reshape(rows, width, spp)
        return np.add.accumulate(a, axis=1, dtype=kind.newbyteorder("=")).astype(kind).tobytes()
    if predictor == 3 and bits in (16, 32, 64):
        n = bits // 8
        a = np.add.accumulate(np.frombuffer(block, np.uint8).reshape(rows, width * n, spp), axis=1, dtype=np.uint8)
        planes = a.reshape(rows, n, width * spp).transpose(0, 2, 1)  # most significant byte first
        return (planes if order == ">" else planes[:, :, ::-1]).tobytes()
    raise TiffError(f"predictor {predictor} with {bits} bits is not supported")


# ---------------------------------------------------------------- reading


def _directory(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    counter, entry, link = ("Q", 20, "Q") if big else ("H", 12, "I")
    head = struct.calcsize(order + counter)
    (n,) = struct.unpack_from(order + counter, data, at)
    if n * entry > len(data):
        raise TiffError("directory runs past the end")
    tags = {}
    for k in range(n):
        p = at + head + k * entry
        tag, kind = struct.unpack_from(order + "HH", data, p)
        (count,) = struct.unpack_from(order + link, data, p + 4)
        letter, width = FIELD.get(kind, ("", 0))
        if not letter:
            continue
        value_at = p + (12 if big else 8)
        if count * width > (8 if big else 4):
            (value_at,) = struct.unpack_from(order + link, data, value_at)
        if value_at + count * width > len(data):
            raise TiffError(f"tag {tag} points past the end")
        tags[tag] = (data[value_at : value_at + count],) if letter == "s" else struct.unpack_from(order + letter * count if len(letter) > 1 else f"{order}{count}{letter}", data, value_at)
    (following,) = struct.unpack_from(order + link, data, at + head + n * entry)
    return tags, following


def _fill(tags: dict[int, tuple], data: bytes, order: str, page: Page, limit: int | None) -> None:
    one = lambda tag, default: int(tags[tag][0]) if tags.get(tag) else default
    page.width, page.height = one(WIDTH, 0), one(HEIGHT, 0)
    page.samples, page.bits = one(SAMPLES, 1), one(BITS, 1)
    page.compression, page.predictor, page.photometric = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PHOTOMETRIC, 0)
    if not page.width or not page.height:
        raise TiffError("no size")
    if len(set(tags.get(BITS, (1,)))) > 1:
        raise TiffError("samples of unlike width are not supported")
    planes = page.samples if one(PLANAR, 1) == 2 else 1
    spp = page.samples // planes
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (page.width, min(one(ROWS_PER_STRIP, page.height), page.height))
    if not bw or not bh:
        raise TiffError("no block size")
    offsets, counts = (tags.get(TILE_OFFSETS, ()), tags.get(TILE_COUNTS, ())) if tiled else (tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ()))
    across, down = -(-page.width // bw), -(-page.height // bh)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise TiffError("blocks are missing")
    row_bytes = -(-bw * spp * page.bits // 8)
    line = -(-page.width * spp * page.bits // 8)
    if line * page.height * planes > (sum(counts) + 8) * MOST.get(page.compression, 1):
        raise TiffError("page is larger than its blocks can hold")
    if limit is not None and (line * page.height * planes > limit or row_bytes * bh > limit):
        raise TiffError("page is larger than the limit")
    if tiled and across > 1 and bw * spp * page.bits % 8:
        raise TiffError("tiles that end inside a byte are not supported")
    out = []
    for plane in range(planes):
        image = None if across == 1 and row_bytes == line else np.zeros((down * bh, across * row_bytes), np.uint8)
        for k in range(across * down):
            i = plane * across * down + k
            y, x = divmod(k, across)
            rows = bh if tiled else min(bh, page.height - y * bh)
            block = _decode(page.compression, data[offsets[i] : offsets[i] + counts[i]], rows * row_bytes)
            if len(block) < rows * row_bytes:
                raise TiffError("block is short")
            block = _undo(block, page.predictor, rows, bw, spp, page.bits, order)
            if image is None:
                out.append(block[: min(rows, page.height - y * bh) * line])
            else:
                image[y * bh : y * bh + rows, x * row_bytes : (x + 1) * row_bytes] = np.frombuffer(block, np.uint8).reshape(rows, row_bytes)
        if image is not None:
            out.append(np.ascontiguousarray(image[: page.height, :line]).tobytes())
    page.pixels = out[0] if len(out) == 1 else b"".join(out)


def read_pages(data: bytes | None, limit: int | None = None) -> Iterator[Page]:
    """Pages in directory order. A `limit`, if given, bounds the bytes of one decoded page; a larger one gives an error row."""
    if not data:
        return
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    try:
        if not order:
            raise TiffError("no TIFF header")
        (magic,) = struct.unpack_from(order + "H", data, 2)
        if magic not in (42, 43):
            raise TiffError(f"magic {magic}")
        (at,) = struct.unpack_from(order + ("Q" if magic == 43 else "I"), data, 8 if magic == 43 else 4)
    except (TiffError, struct.error) as e:
        yield Page(0, error=str(e))
        return
    seen, number = set(), 0
    while at and at not in seen:
        seen.add(at)
        page = Page(number)
        following = 0
        try:
            tags, following = _directory(data, at, order, magic == 43)
            _fill(tags, data, order, page, limit)
        except (TiffError, struct.error, ValueError, MemoryError) as e:
            page.error = f"{type(e).__name__}: {e}"
            page.pixels = None
        yield page
        at = following
        number += 1


# ---------------------------------------------------------------- writing


def write_pages(pages: list[dict], order: str = "<", big: bool = False) -> bytes:
    """A TIFF of the given pages.

    A page: pixels (bytes, rows top down), width, height; optional samples (1), bits (8), compression
    (deflate), predictor (1 or 2), rows_per_strip (all), tile ((w, h), multiples of 16), photometric (1).
    """
    link = "Q" if big else "I"
    size = struct.calcsize(order + link)
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    patch = 8 if big else 4
    for p in pages:
        w, h, spp, bits = p["width"], p["height"], p.get("samples", 1), p.get("bits", 8)
        kind, predictor, tile = p.get("compression", DEFLATE), p.get("predictor", 1), p.get("tile")
        line = -(-w * spp * bits // 8)
        blocks = []
        if tile:
            bw, bh = tile
            across, down, wide = -(-w // bw), -(-h // bh), bw * spp * bits // 8
            image = np.zeros((down * bh, across * wide), np.uint8)
            image[:h, :line] = np.frombuffer(p["pixels"], np.uint8).reshape(h, line)
            blocks = [(np.ascontiguousarray(image[y * bh : (y + 1) * bh, x * wide : (x + 1) * wide]).tobytes(), bh, bw) for y in range(down) for x in range(across)]
        else:
            rows = p.get("rows_per_strip") or h
            blocks = [(p["pixels"][y * line : min(h, y + rows) * line], min(rows, h - y), w) for y in range(0, h, rows)]
        offsets, counts = [], []
        for raw, n, bw in blocks:
            if predictor == 2:
                unit = np.dtype(f"{order}u{bits // 8}")
                a = np.frombuffer(raw, unit).reshape(n, bw, spp).astype(unit.newbyteorder("="))
                a[:, 1:] -= a[:, :-1].copy()
                raw = a.astype(unit).tobytes()
            stored = _encode(kind, raw)
            offsets.append(len(out))
            counts.append(len(stored))
            out += stored
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [bits] * spp), (COMPRESSION, 3, [kind]), (PHOTOMETRIC, 3, [p.get("photometric", 1)]), (SAMPLES, 3, [spp]), (PREDICTOR, 3, [predictor])]
        place = 16 if big else 4
        tags += [(TILE_WIDTH, 4, [tile[0]]), (TILE_HEIGHT, 4, [tile[1]]), (TILE_OFFSETS, place, offsets), (TILE_COUNTS, place, counts)] if tile else [(ROWS_PER_STRIP, 4, [p.get("rows_per_strip") or h]), (STRIP_OFFSETS, place, offsets), (STRIP_COUNTS, place, counts)]
        body = []
        for tag, field, values in sorted(tags):
            letter, _ = FIELD[field]
            packed = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(packed) > size:
                if len(out) % 2:
                    out += b"\0"
                at, packed_at = len(out), struct.pack(order + link, len(out))
                out += packed
                assert at == len(out) - len(packed)
                packed = packed_at
            body.append(struct.pack(order + "HH" + link, tag, field, len(values)) + packed.ljust(size, b"\0"))
        if len(out) % 2:
            out += b"\0"
        struct.pack_into(order + link, out, patch, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(body)) + b"".join(body)
        patch = len(out)
        out += struct.pack(order + link, 0)
    return bytes(out)


# ---------------------------------------------------------------- DataFrame operators

PAGE_SCHEMA = "page int,width int,height int,samples int,bits int,compression int,predictor int,photometric int,pixels binary,error string"


def tiff_pages(df: DataFrame, media: str = "media", keys: list[tuple[str, str]] = (), limit: int | None = None) -> DataFrame:
    """One row per page, those of a file one after another: the keys, given as (name, type), then PAGE_SCHEMA. Keys keep their values."""
    schema = ",".join([*(f"{n} {t}" for n, t in keys), PAGE_SCHEMA])
    target, names = to_arrow(schema), [n for n, _ in keys]

    def run(batches):
        for part in slices(batches, 64):
            columns = [part.column(n).to_pylist() for n in names]
            rows = []
            for i, data in enumerate(part.column(media).to_pylist()):
                key = [c[i] for c in columns]
                rows += [[*key, p.page, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.photometric, p.pixels, p.error] for p in read_pages(data, limit)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target)

    return df.select(*names, media).mapInArrow(run, schema)


#: Rows of a page and of a strip or tile of it; bytes up to which a text may be stored by LZW, which is slow to write.
PAGE_ROWS, BLOCK_ROWS, LZW_BYTES = 2048, 256, 4096


def layout(raw: bytes) -> dict:
    """How a text is stored, by its checksum: deflate or LZW strips with differencing, PackBits strips, or deflate tiles."""
    choice = zlib.crc32(raw) % 4
    if choice == 1:
        return {"compression": PACKBITS, "rows_per_strip": BLOCK_ROWS}
    if choice == 2:
        return {"compression": DEFLATE, "predictor": 2, "tile": (64, BLOCK_ROWS)}
    return {"compression": LZW if choice == 3 and len(raw) <= LZW_BYTES else DEFLATE, "predictor": 2, "rows_per_strip": BLOCK_ROWS}


def texts_to_tiff(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 64, page_rows: int = PAGE_ROWS) -> DataFrame:
    """key, n_bytes, media, media_sha256: each text's UTF-8 padded with zero bytes to a positive multiple
    of `width` and stored as 8-bit gray pages of up to `page_rows` rows, in the layout of its checksum.
    A null text is stored as the empty one."""

    def each(part):
        raw = [(t or "").encode() for t in part.column(text).to_pylist()]
        media = []
        for b in raw:
            height, form = max(1, -(-len(b) // width)), layout(b)
            b = b.ljust(width * height, b"\0")
            rows = [min(page_rows, height - y) for y in range(0, height, page_rows)]
            media.append(write_pages([{"pixels": b[k * page_rows * width : (k * page_rows + n) * width], "width": width, "height": n, **form} for k, n in enumerate(rows)]))
        return {key: part.column(key), "n_bytes": [len(b) for b in raw], "media": media, "media_bytes": [len(m) for m in media], "media_sha256": [sha(m) for m in media]}

    return arrow_map(df.select(key, text), each, f"{key} long,n_bytes long,media binary,media_bytes long,media_sha256 string")


class _Payload:
    """What is kept of a file's pages, one after another: checksums, a histogram, and the last bytes."""

    def __init__(self, key: list):
        self.key, self.sha, self.tail, self.counts = key, hashlib.sha256(), b"", np.zeros(256, np.int64)
        self.width, self.height, self.whole = 0, 0, True

    def add(self, data: bytes | None, width: int, height: int) -> None:
        if data is None:
            self.whole = False
            return
        self.sha.update(data)
        self.tail = (self.tail + data[-64:])[-64:]
        self.counts += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        self.width, self.height = max(self.width, width), self.height + height

    def row(self) -> list:
        if not self.whole:
            return [*self.key, None, None, None, None]
        c, values = self.counts, np.arange(256)
        n = int(c.sum())
        mean = int((c * values).sum()) / max(n, 1)
        spread = max(0.0, int((c * values**2).sum()) / max(n, 1) - mean**2) ** 0.5
        feature = f"{self.width}x{self.height} mean={mean:.4f} std={spread:.4f} hist=" + ",".join(map(str, c.reshape(16, 16).sum(axis=1)))
        return [*self.key, n, self.sha.hexdigest(), zlib.crc32(self.tail), feature]


def page_features(pages: DataFrame, keys: list[tuple[str, str]], pixels: str = "pixels") -> DataFrame:
    """keys, payload_bytes, payload_sha256, tail_crc32 (last 64 bytes), feature of the 8-bit samples of each file, read back.

    The pages of a file follow each other, as `tiff_pages` gives them. A file with a page in error has nulls.
    feature: WxH, the mean and standard deviation to 4 decimals, and a 16-bin histogram of the samples.
    """
    names = [n for n, _ in keys]
    schema = f"{','.join(f'{n} {t}' for n, t in keys)},payload_bytes long,payload_sha256 string,tail_crc32 long,feature string"
    target = to_arrow(schema)
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target)

    def run(batches):
        now: _Payload | None = None
        for part in slices(batches, 64):
            rows = []
            columns = [part.column(n).to_pylist() for n in (*names, "page", "width", "height")]
            data = part.column(pixels)
            for k, (*key, page, width, height) in enumerate(zip(*columns, strict=True)):
                if page == 0:
                    rows += [now.row()] if now else []
                    now = _Payload(key)
                now.add(data[k].as_py(), width, height)
            if rows:
                yield table(rows)
        if now:
            yield table([now.row()])

    return pages.select(*names, "page", "width", "height", pixels).mapInArrow(run, schema)
