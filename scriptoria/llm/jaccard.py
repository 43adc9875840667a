"""N-gram Jaccard join by partitioning the universe of shingles.

Shingles are hashed to 64 bits. For each band of set sizes the hash space is cut into equal segments;
a set falls apart into its parts in them. Two sets that link differ in at most H shingles, which the
pigeonhole principle turns into a match: of `exact` segments searched for equal parts and `near`
segments searched for parts that differ in at most one shingle (each part is indexed with its
one-deletion neighbourhood), some segment matches if exact + 2 * near > H. A set need not index all
its exact parts: if they are put in an order that depends on the part alone, its first
H + 1 - 2 * near parts are enough, because two sets that link share more equal parts than either
leaves out. Parts with more shingles, which collide least, come first. How many segments a band gets
and how many of them are `near` is chosen by cost from the number of sets in the band.

An empty part says nothing about two sets, so it comes last, and it is charged as a meeting with every set
of the band that has one there. Small sets in large bands, whose few parts would often be empty or very
common, get one-deletion segments: these are larger, so that they meet by chance far less often.

Equal sets are one set with one key (64 bits of a digest; a digest of 128 bits tells sets apart), so copies
cost one set. In the index, parts are packed by range of their hash. A part that many sets of one
batch share is spread: those sets go to slices of it, and one of them to its own range. In a range, sets
that share a part are candidates through a star around the smallest of them. Stars are verified on the
whole sets, one centre with all its partners at a time; components come from distributed star
contraction. Where the stars leave sets of one part in different components, the sets outside of the
part's largest component are compared with all others of a size that can link, exactly, in blocks of
bounded size, and only links that join components are kept; so no link between components is missed and
no pairs of a group are listed. Sets are compared as sorted 64-bit hashes of their shingles.

Defined cases: a null text, or one without words, has the empty set and links with nothing; with fewer
words than a shingle has, the whole sequence is the only shingle; repeated rows belong to the
component of their text; a null id does not name a component, and rows with a null id belong to the component
of their text if that has a row with an id; one id with several texts is in the component of each; very long
texts are whole; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import Scratch, arrow_map, fresh, row_digest, slices, small_batches, text_key, trim
from scriptoria.llm.components import components

#: Entries of the index that a bucket holds on average.
BUCKET_ENTRIES = 300_000
#: Hashed words a worker keeps.
ROOM = 100_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at space and U+0009 to U+000D: what bytes do by themselves."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(text: str | None, size: int) -> set[tuple]:
    """The exact set, for verification."""
    w = words(text)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(size)), strict=False))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the whole text."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    if len(_hashes) > ROOM:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    n = min(size, len(w))
    x = np.full(len(w) - n + 1, np.uint64(n))
    for k in range(n):
        x = mix(x * _M1 + h[k : len(h) - n + 1 + k])
    return np.unique(x)


def digests(s: np.ndarray) -> tuple[int, int]:
    """(key, check): 128 bits of a non-empty set as two signed integers."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


# ---------------------------------------------------------------- bands and their segments


@dataclass(frozen=True)
class Threshold:
    """Sets link when den * intersection >= num * union."""

    num: int
    den: int

    def differing(self, total: int) -> int:
        """Most shingles in which two linked sets of `total` shingles together can differ."""
        need = -(-self.num * total // (self.num + self.den))
        return total - 2 * need

    def largest(self, n: int) -> int:
        """The largest set that one of n shingles can link with."""
        return n * self.den // self.num


@dataclass(frozen=True)
class Band:
    lo: int
    hi: int
    exact: int
    near: int

    @property
    def segments(self) -> int:
        return self.exact + self.near


def most_differing(t: Threshold, n: int, other: int) -> int:
    """Most shingles in which a set of n differs from a linked one of at most `other`."""
    other = min(other, t.largest(n))
    return max(t.differing(n + other), t.differing(n + other - 1), 0)


def band_edges(t: Threshold, most: int) -> list[tuple[int, int]]:
    """Sizes from 1 on in bands such that linked sets are in one band or in two that adjoin."""
    out, lo = [], 1
    while lo <= most:
        hi = max(lo, t.largest(lo))
        out.append((lo, hi))
        lo = hi + 1
    return out


#: Sizes of the parts whose meetings are measured, one shingle in RATE of each set as their beginning.
LEVELS, RATE = (1, 2, 4, 8), 128
#: What a measurement of no parts is taken for, as so many measured ones: parts of c shingles agree for a set in 50 000 * 4**c.
PRIOR, PRIOR_WEIGHT = 1 / 50_000, 50


def occupied(n: int, bins: int, wanted: int) -> float:
    """Probability that n shingles, dealt to equal bins, leave fewer than `wanted` of them filled."""
    if bins > 16:  # empty bins are then near to a Poisson number
        mean = bins * math.exp(-n / bins)
        few = sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(bins - wanted + 1)) if mean else 1.0
        return max(0.0, 1.0 - few)
    filled, k = np.zeros(bins + 1), np.arange(bins + 1)
    filled[0] = 1.0
    for _ in range(min(n, 40 * bins)):
        more = filled * (bins - k) / bins
        filled = filled * k / bins
        filled[1:] += more[:-1]
    return float(filled[:wanted].sum())


def meeting(measured: dict[int, tuple[float, float]], sets: int):
    """Other sets, as a function of c, that share a given part of c shingles, from measured (parts, meetings) by part size."""
    known = []
    for c in LEVELS:
        parts, met = measured.get(c, (0.0, 0.0))
        known.append((met + PRIOR_WEIGHT * sets * PRIOR * 4.0**-c) / (parts + PRIOR_WEIGHT))
    return lambda c: np.exp(np.interp(c, LEVELS, np.log(np.maximum(known, 1e-30))))


def allocate(t: Threshold, sizes: dict[int, int], measured: dict[int, dict[int, tuple[float, float]]] | None = None, near: bool = True) -> list[Band]:
    """Segments of each band, from the number of sets of each size and, by band, the measured meetings of parts.

    The cost of a choice, in entries of the index: those of a set of the band, and for each set that it
    meets by chance the verification, which moves and compares a whole set. `near` false leaves one-deletion
    segments out.
    """
    edges = band_edges(t, max(sizes, default=0))
    counts = [sum(n for s, n in sizes.items() if lo <= s <= hi) for lo, hi in edges]
    out = []
    for at, ((lo, hi), n, below) in enumerate(zip(edges, counts, [0, *counts], strict=False)):
        need = max(t.differing(2 * hi), most_differing(t, hi, hi), 0) + 1
        mean, best = (lo + hi) / 2, None
        here = (measured or {}).get(at, {})
        meet, weight = meeting(here, n + below), 5 + 0.4 * mean
        parts, met = here.get(1, (0.0, 0.0))
        most = min(n + below, 4 * met / parts) if parts else n + below  # a set meets no others than those that share its shingles
        for ones in {0, need // 4, need // 2, -(-need // 2)} if near else {0}:
            for stretch in (1.0, 1.1, 1.2, 1.35, 1.5, 1.75, 2.0, 2.5):
                exact = max(0, round((need - 2 * ones) * stretch))
                if exact + ones < 1 or exact + 2 * ones < need:
                    continue
                per, kept = mean / (exact + ones), max(0, min(need - 2 * ones, exact))
                entries = kept + ones * (1 + per)
                met = kept * meet(per * (1 + 0.4 * (1 - kept / exact))) if kept else 0.0  # the larger parts are kept
                met = min(met + ones * ((1 + per) * meet(max(per - 1, 1.0))), most)
                empty = occupied(lo, exact + ones, kept + ones)
                cost = entries + weight * (met + (n + below) * empty * empty)
                if best is None or cost < best[0]:
                    best = (cost, exact, ones)
        out.append(Band(lo, hi, best[1], best[2]))
    return out


def band_of(bands: list[Band], n: int) -> int:
    lo, hi = 0, len(bands) - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if bands[mid].lo <= n else (lo, mid - 1)
    return lo


def signatures(s: np.ndarray, bands: list[Band], t: Threshold) -> np.ndarray:
    """Index keys of a set: under its own band, and under the next if it can link with a set of that."""
    n, own = len(s), band_of(bands, len(s))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s ^ _M1))))
    out = []
    for k in (own, own + 1):
        if k >= len(bands) or (k > own and t.largest(n) < bands[k].lo):
            continue
        band = bands[k]
        differ = most_differing(t, n, band.hi)
        if differ <= 0:
            continue  # only equal sets link
        edges = np.array([(j << 64) // band.segments for j in range(1, band.segments)], np.uint64)
        at = np.concatenate(([0], np.searchsorted(s, edges), [n]))
        part, count = sums[at[1:]] - sums[at[:-1]], np.diff(at)
        tag = mix(np.arange(band.segments, dtype=np.uint64) + np.uint64(k << 32) + np.uint64(1))
        if band.near:
            lo, hi = band.exact, band.segments
            which = np.repeat(np.arange(lo, hi), count[lo:hi])
            whole, less = part[lo:hi] * _M2 + tag[lo:hi], (part[which] - mix(s[at[lo] : at[hi]] ^ _M1)) * _M2 + tag[which]
            out += [mix(whole), mix(less)]
        wanted = min(differ + 1 - 2 * band.near, band.exact)
        if wanted > 0:
            key = mix(part[: band.exact] * _M2 + tag[: band.exact])
            if wanted < band.exact:
                key = key[np.lexsort((key, -count[: band.exact]))[:wanted]]
            out.append(key)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


# ---------------------------------------------------------------- the join


def probes(s: np.ndarray) -> bytes:
    """For one shingle in RATE, hashes of the runs of 1, 2, 4 and 8 shingles that begin with it: parts as a segment could cut them."""
    at = np.flatnonzero(s % np.uint64(RATE) == 0)
    out = []
    for c in LEVELS:
        runs = s[at[at + c <= len(s), None] + np.arange(c)]
        out.append(np.stack((np.full(len(runs), c, np.uint64), mix(mix(runs ^ _M1).sum(axis=1, dtype=np.uint64) * _M3 + np.uint64(c))), axis=1))
    return np.concatenate(out).astype("<u8").tobytes()


def sets_of(df: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """doc_id, t1, t2 (the text's key), n, sid, check, probes of every row; sid and check are null for empty sets."""

    def each(part):
        found = [shingles(t, size) for t in part.column("text").to_pylist()]
        keys = [digests(s) if len(s) else (None, None) for s in found]
        return {c: part.column(c) for c in ("doc_id", "t1", "t2")} | {"n": [len(s) for s in found], "sid": [k[0] for k in keys], "check": [k[1] for k in keys], "probes": [probes(s) for s in found]}

    t1, t2 = text_key(text)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.col(text).alias("text"))
    return arrow_map(rows, each, "doc_id long,t1 long,t2 long,n long,sid long,check long,probes binary")


def measured_meetings(sets: DataFrame, edges: list[tuple[int, int]]) -> dict[int, dict[int, tuple[float, float]]]:
    """By band and part size: the parts probed in all sets, and the pairs of them that agree. One row a band and size reaches the driver."""
    low = [lo for lo, _ in edges]
    numbers = _bytes_to_longs(sets)
    band = F.expr(f"size(filter(array({','.join(map(str, low))}), x -> x <= n)) - 1") if low else F.lit(0)
    counts = numbers.withColumn("band", band).groupBy("band", "c", "part").agg(F.count(F.lit(1)).cast("double").alias("k"))
    out: dict[int, dict[int, tuple[float, float]]] = {}
    for r in counts.groupBy("band", "c").agg(F.sum("k").alias("parts"), F.sum(F.expr("k * (k - 1)")).alias("met")).collect():
        out.setdefault(r["band"], {})[r["c"]] = (r["parts"], r["met"])
    return out


def _bytes_to_longs(sets: DataFrame) -> DataFrame:
    """(n, c, part) of every probe."""

    def run(batches):
        for batch in batches:
            raw = [np.frombuffer(b, "<u8").reshape(-1, 2) for b in batch.column(1).to_pylist()]
            if raw and sum(map(len, raw)):
                n = np.repeat(batch.column(0).to_numpy(), [len(r) for r in raw])
                both = np.concatenate(raw)
                yield pa.RecordBatch.from_pydict({"n": n, "c": both[:, 0].astype(np.int32), "part": both[:, 1].view(np.int64)})

    return sets.select("n", "probes").where("length(probes) > 0").mapInArrow(run, "n long,c int,part long")


#: Sets that share a part in one batch of the index and are spread over slices of it from this number on.
MANY = 64
#: In how many slices.
SLICES = 64
#: Marks, in the size of an index entry, the one of a spread part's sets that stands for the batch.
_STANDS_IN = np.uint32(1 << 31)
_ENTRIES = pa.schema([("bucket", pa.int32()), ("tag", pa.int64()), ("data", pa.binary())])
#: Entries that are sorted at once, on either side of the shuffle.
HELD_ENTRIES = 1_500_000


def _plane(x: np.ndarray) -> bytes:
    width = x.dtype.itemsize
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes()


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 20
    raw = np.frombuffer(data, np.uint8)
    take = lambda lo, width, kind: np.ascontiguousarray(raw[lo * n : (lo + width) * n].reshape(width, n).T).view(kind).ravel()
    return take(0, 8, np.uint64), take(8, 8, np.int64), take(16, 4, np.uint32)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal sorted keys begins, and its length."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


def index(df: DataFrame, size: int, bands: list[Band], t: Threshold, buckets: int, text: str) -> DataFrame:
    """(bucket, tag, data): keys, set ids and set sizes, packed; copies met in one batch are indexed once.

    Buckets from 0 are ranges of the hash space. Buckets from `buckets` on take the slices of parts that
    very many sets of one batch share; of these the smallest set goes to its range as well.
    """
    edges = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    most = 150_000  # entries of a batch

    def packed(keys, sids, sizes):
        key, sid, n = np.concatenate(keys), np.concatenate(sids), np.concatenate(sizes)
        order = np.lexsort((sid, n, key))
        key, sid, n = key[order], sid[order], n[order]
        starts, length = _runs(key)
        hot = np.repeat(length >= MANY, length)
        plain = ~hot
        first = np.zeros(len(key), bool)
        first[starts[length >= MANY]] = True
        n_plain = np.where(first, n | _STANDS_IN, n)
        plain |= first
        bucket = np.concatenate((
            np.searchsorted(edges, key[plain], side="right") - 1,
            buckets + ((mix(key[hot]) + mix(sid[hot].view(np.uint64)) % np.uint64(SLICES)) % np.uint64(buckets)).astype(np.int64),
        ))
        key, sid, n = np.concatenate((key[plain], key[hot])), np.concatenate((sid[plain], sid[hot])), np.concatenate((n_plain[plain], n[hot]))
        order = np.argsort(bucket, kind="stable")
        bucket, key, sid, n = bucket[order], key[order], sid[order], n[order]
        at, length = _runs(bucket)
        data = [_plane(key[lo : lo + k]) + _plane(sid[lo : lo + k]) + _plane(n[lo : lo + k]) for lo, k in zip(at.tolist(), length.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array(sid[at], pa.int64()), pa.array(data, pa.binary())], schema=_ENTRIES)

    def run(batches):
        seen: set[int] = set()
        _hashes.clear()
        keys, sids, sizes, held = [], [], [], 0
        for part in slices(batches, 1024):
            for text_ in part.column(0).to_pylist():
                s = shingles(text_, size)
                if not len(s):
                    continue
                sid = digests(s)[0]
                if sid in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(sid)
                k = signatures(s, bands, t)
                if len(k):
                    keys.append(k)
                    sids.append(np.full(len(k), sid, np.int64))
                    sizes.append(np.full(len(k), len(s), np.uint32))
                    held += len(k)
                if held >= most:
                    yield packed(keys, sids, sizes)
                    keys, sids, sizes, held = [], [], [], 0
        if keys:
            yield packed(keys, sids, sizes)

    small_batches(df.sparkSession)
    return df.select(text).mapInArrow(run, "bucket int,tag long,data binary")


_FOUND = pa.schema([("grp", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


class _Bucket:
    """The parts of one bucket, taken in pieces of bounded size; between pieces it keeps the smallest set of each part."""

    def __init__(self, number: int, buckets: int, t: Threshold):
        self.sliced, self.t, self.number = number >= buckets, t, number
        self.parts: list[tuple] = []
        self.held, self.kept, self.pieces = 0, None, 0

    def add(self, data: bytes):
        self.parts.append(_read(data))
        self.held += len(self.parts[-1][0])
        if self.held >= HELD_ENTRIES:
            yield from self.flush(last=False)

    def flush(self, last: bool):
        """Rows of _FOUND for what is held."""
        parts, whole = self.parts, last and self.pieces == 0
        if self.kept is not None:
            parts = [self.kept, *parts]
        key, sid, n = (np.concatenate([p[c] for p in parts]) for c in range(3))
        self.parts, self.held, self.pieces = [], 0, self.pieces + 1
        stands, n = (n & _STANDS_IN) != 0, n & ~_STANDS_IN
        order = np.lexsort((~stands, sid, n, key))
        key, sid, n, stands = key[order], sid[order], n[order], stands[order]
        same = np.concatenate(([True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])))
        key, sid, n, stands = key[same], sid[same], n[same].astype(np.int64), stands[same]
        starts, length = _runs(key)
        if not last:
            self.kept = key[starts], sid[starts], (n[starts].astype(np.uint32) | np.where(stands[starts], _STANDS_IN, np.uint32(0)))
        first = np.repeat(starts, length)
        member = np.arange(len(key))
        linkable = (member != first) & (n[first] * self.t.den >= n * self.t.num)
        pairs = np.unique(np.stack((np.minimum(sid[first], sid), np.maximum(sid[first], sid)), axis=1)[linkable], axis=0)
        # The lists of the parts' sets. Those of two sets are settled by their star, unless the part has more
        # elsewhere; complete lists with the same sets are given once.
        elsewhere = np.logical_or.reduceat(stands, starts) if len(starts) else np.zeros(0, bool)
        if not whole or self.sliced:
            elsewhere = (length > 1) if not self.sliced else np.ones(len(starts), bool)
        listed = np.flatnonzero((length > 2) & ~elsewhere)
        if len(listed):
            name = np.add.reduceat(mix(sid.view(np.uint64)), starts)
            listed = listed[np.unique(name[listed], return_index=True)[1]]
        open_ = np.zeros(len(starts), bool)
        open_[listed] = True
        open_ |= elsewhere
        rows = np.repeat(open_, length)
        trim()
        none, zero = np.zeros(len(pairs), np.int64), np.zeros(int(rows.sum()), np.int64)
        grp = np.concatenate((none, key[rows].view(np.int64)))
        yield pa.RecordBatch.from_arrays([
            pa.array(grp, mask=np.arange(len(grp)) < len(pairs)), pa.array(np.concatenate((pairs[:, 0], sid[rows]))),
            pa.array(np.concatenate((pairs[:, 1], zero))), pa.array(np.concatenate((none, n[rows]))),
        ], schema=_FOUND)


def candidates(entries: DataFrame, t: Threshold, buckets: int) -> DataFrame:
    """Rows of two kinds: grp null, a candidate pair (a, b); else set `a` of size n is one of the sets of part `grp`."""

    def run(batches):
        now: _Bucket | None = None
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now is None or now.number != number:
                    if now is not None:
                        yield from now.flush(last=True)
                    now = _Bucket(number, buckets, t)
                yield from now.add(data.as_py())
        if now is not None:
            yield from now.flush(last=True)

    dealt = entries.repartition("bucket").sortWithinPartitions("bucket", "tag").select("bucket", "data")
    return dealt.mapInArrow(run, "grp long,a long,b long,n long").distinct()


def vectors_of(df: DataFrame, wanted: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(sid, data) of the wanted sets (sid, doc_id, t1, t2): the sorted hashes of one text of each."""
    slot = F.pmod(F.col("t1"), F.lit(SLOTS))
    t1, t2 = text_key(text)
    id_, name = F.col(key).cast("long"), ["t1", "t2", "id", "no_id"]
    rows = df.select(t1.alias("t1"), t2.alias("t2"), F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().alias("no_id"), F.col(text).alias("text"))
    slots = wanted.select(slot.alias("slot")).distinct()  # SLOTS rows at most
    thinned = rows.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    w = wanted.select("sid", "t1", "t2", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"))
    met = thinned.dropDuplicates(name).join(w, name).select("sid", "text")  # one shuffle of texts serves both

    def each(part):
        return {"sid": part.column("sid"), "data": [shingles(x, size).tobytes() for x in part.column("text").to_pylist()]}

    return arrow_map(met, each, "sid long,data binary", 256)


def _links(x: np.ndarray, y: np.ndarray, t: Threshold) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if len(x) * t.den < len(y) * t.num:
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return both > 0 and t.den * both >= t.num * (len(x) + len(y) - both)


#: Partners of a set that are verified in one piece of work.
PARTNERS = 256


def verified(pairs: DataFrame, vectors: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) that link. The set of `a` is sent once for PARTNERS of its partners."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        at, centre = None, None
        for batch in batches:
            a, piece, b = (batch.column(c).to_pylist() for c in ("a", "piece", "b"))
            good: list[tuple[int, int]] = []
            for k, data in enumerate(batch.column("data")):
                s = np.frombuffer(data.as_py(), np.uint64)
                if b[k] is None:
                    at, centre = (a[k], piece[k]), s
                elif at == (a[k], piece[k]) and _links(centre, s, t):
                    good.append((a[k], b[k]))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], schema=out)

    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("pieces"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "pieces").cast("int").alias("piece"))
    partners = dealt.join(vectors.withColumnRenamed("sid", "b"), "b").select("a", "piece", "b", "data")
    centres = dealt.select("a", "piece").distinct().join(vectors.withColumnRenamed("sid", "a"), "a").select("a", "piece", F.lit(None).cast("long").alias("b"), "data")
    both = partners.unionByName(centres).repartition("a", "piece").sortWithinPartitions("a", "piece", F.col("b").asc_nulls_first())
    return both.mapInArrow(run, "a long,b long")


#: A block of the sets of one part: so many sets, or so many shingles if that is less.
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: Slots of the filter that thins out texts before they are shuffled; a table of at most so many longs.
SLOTS = 1 << 18
#: Slices over which the rows of one part are spread when they meet what is known of the part.
SPREAD = 8


def _blocks_compared(t: Threshold):
    """Links that join two components, for one pair of blocks after another."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: pa.Table) -> pa.RecordBatch | None:
        sid, root, kind, own = (rows.column(c).to_numpy() for c in ("sid", "root", "kind", "own"))
        sets = [np.frombuffer(b, np.uint64) for b in rows.column("data").to_pylist()]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        ca, cb, i, j = (rows.column(c)[0].as_py() for c in ("ca", "cb", "i", "j"))
        first, second = np.flatnonzero((kind == ca) & (own == i)), np.flatnonzero((kind == cb) & (own == j))
        if not len(first) or not len(second):
            return None
        order = np.argsort(np.concatenate([sets[k] for k in second]), kind="stable")
        shingle, holder = np.concatenate([sets[k] for k in second])[order], np.repeat(np.arange(len(second)), n[second])[order]
        up = {r: r for r in np.unique(root).tolist()}

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        good = []
        for k in first.tolist():
            s = sets[k]
            lo, hi = np.searchsorted(shingle, s), np.searchsorted(shingle, s, side="right")
            length = hi - lo
            met = np.repeat(lo, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            both = np.bincount(holder[met], minlength=len(second))
            for c in np.flatnonzero((both > 0) & (t.den * both >= t.num * (n[k] + n[second] - both)) & (root[second] != root[k])).tolist():
                x, y = find(int(root[k])), find(int(root[second[c]]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    good.append((int(sid[k]), int(sid[second[c]])))
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], schema=out) if good else None

    def run(batches):
        held: list[pa.Table] = []  # rows of the key that the last batch ended in
        last = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            keys = np.stack([rows.column(c).to_numpy() for c in ("family", "ca", "cb", "i", "j")], axis=1)
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                key = tuple(keys[lo].tolist())
                if key != last and held:
                    if (got := links(pa.concat_tables(held).combine_chunks())) is not None:
                        yield got
                    held = []
                held.append(rows.slice(lo, hi - lo))
                last = key
        if held and (got := links(pa.concat_tables(held).combine_chunks())) is not None:
            yield got

    return run


def unsettled(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(family, sid, n, root): the sets of parts (grp, sid, n) whose sets are in several components.

    Parts with the same least component are one family, as the parts of one group of near copies mostly
    are; so a pair that shares many parts is compared once.
    """
    members = groups.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    split = members.groupBy("grp").agg(F.min("root").alias("family"), F.max("root").alias("hi")).where("family <> hi").select("grp", "family")
    slices_ = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    spread = members.withColumn("slice", F.pmod(F.xxhash64("sid"), F.lit(SPREAD)).cast("int"))
    return spread.join(split.withColumn("slice", slices_), ["grp", "slice"]).select("family", "sid", "n", "root").distinct()


def across_components(families: DataFrame, vectors: DataFrame, t: Threshold) -> DataFrame:
    """Links (a, b) between components, of the families (family, sid, n, root).

    The sets of a family's largest component are compared with those of the others only, and blocks only
    where their sizes can link: sizes fall into bins such that linked sets are in one or in two that adjoin.
    """
    lone = families.groupBy("family", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("family").agg(F.max_by("root", F.struct("c", "root")).alias("largest"))
    size_bin = F.floor(F.log(F.col("n").cast("double")) / float(np.log(t.den / t.num * (1 + 1e-9)))).cast("int") if t.num < t.den else F.col("n").cast("int")
    spread = families.withColumn("slice", F.pmod(F.xxhash64("sid"), F.lit(SPREAD)).cast("int"))
    largest = lone.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = spread.join(largest, ["family", "slice"]).withColumn("kind", 2 * size_bin + (F.col("root") != F.col("largest")).cast("int")).select("family", "slice", "sid", "root", "kind", "n")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    counts = rows.groupBy("family", "kind").agg(blocks.alias("blocks")).groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("kind", "blocks"))).alias("blocks"))
    counts = counts.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = rows.join(counts, ["family", "slice"]).withColumn("own", F.pmod(F.xxhash64("sid"), F.element_at("blocks", F.col("kind"))).cast("int"))
    task = "struct({} as ca, {} as cb, {} as i, {} as j)"
    others = "coalesce(element_at(blocks, {k}), 0)"

    def against(k: str, ca: str, cb: str, i: str, j: str) -> str:
        """A task for each block o of kind k."""
        return f"transform(filter(sequence(0, greatest({others.format(k=k)}, 1) - 1), o -> o < {others.format(k=k)}), o -> {task.format(ca, cb, i, j)})"

    main = [against(f"kind + {2 * d + 1}", "kind", f"kind + {2 * d + 1}", "own", "o") for d in (-1, 0, 1)]
    rest = [against(f"kind + {2 * d - 1}", f"kind + {2 * d - 1}", "kind", "o", "own") for d in (-1, 0, 1)]
    rest += [against("kind", "kind", "kind", "least(own, o)", "greatest(own, o)"), against("kind + 2", "kind", "kind + 2", "own", "o"), against("kind - 2", "kind - 2", "kind", "o", "own")]
    tasks = F.expr(f"if(kind % 2 = 0, concat({', '.join(main)}), concat({', '.join(rest)}))")
    dealt = rows.withColumn("task", F.explode(tasks)).select("family", "task.*", "kind", "own", "sid", "root").join(vectors, "sid")
    order = ["family", "ca", "cb", "i", "j"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_blocks_compared(t), "a long,b long").distinct()


def _near_duplicates(df: DataFrame, size: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """doc_id, t1, t2, n and root of every row: the component's name among sets, null without words."""
    if not 0 < num <= den:
        raise ValueError("num / den is above 0 and at most 1")
    t, scratch = Threshold(num, den), Scratch(df.sparkSession, "jaccard")
    docs = scratch.keep(sets_of(df, size, key, text))
    least = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "t1", "t2")
    sets = scratch.keep(docs.where(F.col("sid").isNotNull()).groupBy("sid", "check").agg(F.min(least).alias("rep"), F.max("n").alias("n"), F.max("probes").alias("probes")))
    sizes = {r["n"]: r["c"] for r in sets.groupBy(F.expr("cast(floor(pow(1.02, ceil(ln(n) / ln(1.02)))) as long)").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    bands = allocate(t, sizes, measured_meetings(sets, band_edges(t, max(sizes, default=0))))
    buckets = int(max(1, -(-sum(c * _entries(bands, n, t) for n, c in sizes.items()) // BUCKET_ENTRIES)))
    found = scratch.keep(candidates(index(df, size, bands, t, buckets, text), t, buckets))
    pairs, groups = found.where("grp is null").select("a", "b"), found.where("grp is not null").select("grp", F.col("a").alias("sid"), "n")
    met = found.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    vectors = scratch.keep(vectors_of(df, sets.join(met, "sid", "left_semi").select("sid", "rep.doc_id", "rep.t1", "rep.t2"), size, key, text))
    roots = scratch.keep(components(verified(pairs, vectors, t)))
    more = components(across_components(unsettled(groups, roots), vectors, t).join(_roots(roots, "a"), "a", "left").join(_roots(roots, "b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    more = scratch.keep(more)
    both = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = more.join(roots, "node", "left_anti").select("node", "root")  # sets that only the second pass linked
    of_set = both.unionByName(alone)
    scratch.drop(found, vectors)
    return docs.join(of_set.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "t1", "t2", "n", "sid", "check", F.coalesce("root", "sid").alias("root"))


def _roots(roots: DataFrame, name: str) -> DataFrame:
    return roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))


def near_duplicates(df: DataFrame, size: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least id reachable by links of num/den or more."""
    rows = _near_duplicates(df, size, num, den, key, text)
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, size: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, of one document of each component: that of the least id.

    Rows without an id come after those with one, ordered by a digest of their text. Rows without words
    are a component of their own. Of rows equal in id and text one stays, the least by a digest of all its columns.
    """
    rows = _near_duplicates(df, size, num, den, key, text)
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "t1", "t2")
    kept = rows.where("root is not null").groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.t1", "k.t2")
    kept = kept.unionByName(rows.where("root is null").select("doc_id", "t1", "t2").distinct())
    copies = rows.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("copies"))
    d, k1, k2, a, b, many, place = fresh(df, "_id", "_k1", "_k2", "_t1", "_t2", "_copies", "_place")
    kept = kept.join(copies, kept["doc_id"].eqNullSafe(copies["doc_id"]) & (kept["t1"] == copies["t1"]) & (kept["t2"] == copies["t2"])).select(kept["doc_id"].alias(d), kept["t1"].alias(k1), kept["t2"].alias(k2), F.col("copies").alias(many))
    t1, t2 = text_key(text)
    whole = df.withColumns({a: t1, b: t2}).join(kept, F.col(key).cast("long").eqNullSafe(F.col(d)) & (F.col(a) == F.col(k1)) & (F.col(b) == F.col(k2)))
    once = whole.where(F.col(many) == 1).select(*df.columns)
    digest = row_digest(df)
    again = whole.where(F.col(many) > 1).groupBy(d, k1, k2).agg(F.min_by(F.struct(*df.columns), digest).alias(place))
    return once.unionByName(again.select(f"{place}.*"))


def _entries(bands: list[Band], n: int, t: Threshold) -> int:
    k = band_of(bands, n)
    return sum(min(max(0, most_differing(t, n, b.hi) + 1 - 2 * b.near), b.exact) + b.near + (n * b.near // b.segments) for b in bands[k : k + 2])
