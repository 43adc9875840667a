"""Language-model scoring by deleted interpolation of bigram, unigram and uniform estimates.

p(w|v) = l2(b) c(v,w)/c(v) + l1(b) c(w)/N + l0(b)/(V+1), where b is the bucket of the context's
frequency c(v). The mixture weights of each bucket are learned by expectation-maximisation on the
held-out fold of the training rows, against counts from which that fold is deleted; scoring then uses
the counts of all training rows.

Rows are dealt to chunks of about CHUNK_BYTES of text. A chunk counts its distinct grams and sends one
packed row (sorted 64-bit hashes, counts) to each bucket of the hash space; a bucket adds up the counts
of all chunks and sends each chunk the totals of just the grams it asked for, in its order. From DIRECT
chunks on, both ways go over a level in between: a group of about the root of their number of chunks adds
up its members' grams in as many ranges, each of which deals with its buckets; so the rows sent grow with the
power 3/2 of the number of chunks at most, not with its square. So every
count covers all rows, a frequent gram arrives once from each chunk, no vocabulary is broadcast and no
task holds more than a chunk or a bucket. Only the totals N and V, and a histogram of bounded size
for the weights (BUCKETS * GRID * GRID cells), reach the driver.

Defined cases: a null or empty text is its end token alone; a null id counts as the empty text for its
fold; without training rows all counts are 0 and the estimate is uniform; an empty table gives no rows; repeated
rows count and are scored as often as they occur; very long texts are whole; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import cut, release

CHUNK_BYTES = 6_000_000
#: Chunks up to which each of them writes to each bucket.
DIRECT = 2048
BUCKETS, GRID = 24, 64
END, BEGIN = b" ", b"\t"  # no word holds white space
_TINY = 1e-6


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at space and U+0009 to U+000D: what bytes do by themselves."""
    return (text or "").encode("utf-8", "replace").lower().split()


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a pair of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


class Grams:
    """Tokens of a chunk's texts and its distinct unigrams and bigrams, both in the order of their hashes."""

    def __init__(self, texts: list[str | None]):
        place = _Places({END: 0, BEGIN: 1})
        tokens, self.ends = [], np.zeros(len(texts), np.int64)
        total = 0
        for i, t in enumerate(texts):
            w = words(t)
            ids = np.fromiter(map(place.__getitem__, w), np.int64, len(w))
            total += len(w) + 1
            self.ends[i] = total
            tokens += [ids, np.zeros(1, np.int64)]
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        previous = np.empty_like(self.tokens)
        previous[1:] = self.tokens[:-1]
        starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        previous[starts] = 1
        n = len(place)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, place), np.uint64, n)
        order = np.argsort(hashes)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        self.tokens, self.previous, self.uni = back[self.tokens], back[previous], hashes[order]
        self.begin, self.n = int(back[1]), n
        codes, inverse = np.unique(self.previous * n + self.tokens, return_inverse=True)
        pairs = _pair(self.uni[codes // n], self.uni[codes % n])
        order = np.argsort(pairs)
        back = np.empty(len(codes), np.int64)
        back[order] = np.arange(len(codes))
        self.pairs_of, self.bi = back[inverse.ravel()], pairs[order]

    def counts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of unigrams (of BEGIN: rows) and bigrams in the rows of the mask."""
        lengths = np.diff(self.ends, prepend=0)
        mask = np.repeat(rows, lengths)
        uni = np.bincount(self.tokens[mask], minlength=self.n)
        uni[self.begin] = int(rows.sum())
        return uni, np.bincount(self.pairs_of[mask], minlength=len(self.bi))


def _pack(*columns: np.ndarray) -> bytes:
    """64-bit columns byte plane by byte plane: sorted hashes and small counts compress well that way."""
    return b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    n = len(data) // (8 * columns)
    raw = np.frombuffer(data, np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(raw[k].T).view("<u8").ravel() for k in range(columns)]


def _bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, an equal range of the hash space, begins in sorted hashes; and the end."""
    edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


_REQUEST = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("uni", pa.binary()), ("bi", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("uni", pa.binary()), ("bi", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64()), ("kept_types", pa.int64()), ("kept_tokens", pa.int64())])
_DDL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ",".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _requests(buckets: int):
    def each(t: pa.Table) -> pa.Table:
        g = Grams(t.column("text").to_pylist())
        uni, bi = g.counts(t.column("training").to_numpy(zero_copy_only=False).astype(bool))
        at, bt = _bounds(g.uni, buckets), _bounds(g.bi, buckets)
        chunk = t.column("chunk")[0].as_py()
        rows = [(k, chunk, _pack(g.uni[at[k] : at[k + 1]], uni[at[k] : at[k + 1]]), _pack(g.bi[bt[k] : bt[k + 1]], bi[bt[k] : bt[k + 1]])) for k in range(buckets) if at[k] < at[k + 1] or bt[k] < bt[k + 1]]
        return pa.table([pa.array([r[c] for r in rows], _REQUEST.field(c).type) for c in range(4)], schema=_REQUEST)

    return each


def _answers(first_held_out: int):
    begin = xxhash.xxh3_64_intdigest(BEGIN)

    def each(t: pa.Table) -> pa.Table:
        bucket, chunks = t.column("bucket")[0].as_py(), t.column("chunk").to_pylist()
        held = np.array([c >= first_held_out for c in chunks])
        out, stats = [], [0, 0, 0, 0]
        for name in ("uni", "bi"):
            parts = [_unpack(b, 2) for b in t.column(name).to_pylist()]
            sizes = [len(h) for h, _ in parts]
            hashes, counts = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
            distinct, inverse = np.unique(hashes, return_inverse=True)
            inverse = inverse.ravel()
            total = np.bincount(inverse, counts.astype(np.float64), len(distinct)).astype(np.int64)
            of_held = np.repeat(held, sizes)
            left = total - np.bincount(inverse[of_held], counts[of_held].astype(np.float64), len(distinct)).astype(np.int64)
            ends = np.cumsum([0, *sizes])
            out.append([_pack(total[inverse[lo:hi]], left[inverse[lo:hi]]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)])
            if name == "uni":
                real = distinct != np.uint64(begin)
                stats = [int((total[real] > 0).sum()), int(total[real].sum()), int((left[real] > 0).sum()), int(left[real].sum())]
        n = len(chunks)
        columns = [[*chunks, -1], [bucket] * (n + 1), [*out[0], None], [*out[1], None], *([*([0] * n), s] for s in stats)]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ANSWER, strict=True)], schema=_ANSWER)

    return each


_MERGED = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("sup", pa.int32()), ("uni", pa.binary()), ("bi", pa.binary())])
_RETURNED = pa.schema([("grp", pa.int32()), ("sup", pa.int32()), ("bucket", pa.int32()), *list(_ANSWER)[2:]])


def _added(t: pa.Table, name: str, first_held_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of the requests of a group and range, their counts, and those of the held-out chunks."""
    parts = [_unpack(b, 2) for b in t.column(name).to_pylist()]
    hashes, counts = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
    held = np.repeat(t.column("chunk").to_numpy() >= first_held_out, [len(h) for h, _ in parts])
    distinct, at = np.unique(hashes, return_inverse=True)
    at, weights = at.ravel(), counts.astype(np.float64)
    return distinct, np.bincount(at, weights, len(distinct)).astype(np.int64), np.bincount(at[held], weights[held], len(distinct)).astype(np.int64)


def _merge(ranges: int, first_held_out: int):
    """The requests of one group in one range, added up and dealt to the range's buckets."""

    def each(t: pa.Table) -> pa.Table:
        grp, sup = t.column("grp")[0].as_py(), t.column("sup")[0].as_py()
        sums = [_added(t, name, first_held_out) for name in ("uni", "bi")]
        cuts = [_bounds(x[0], ranges * ranges)[sup * ranges : (sup + 1) * ranges + 1] for x in sums]
        rows = []
        for k in range(ranges):
            blobs = [_pack(*(c[at[k] : at[k + 1]] for c in x)) for x, at in zip(sums, cuts, strict=True)]
            if any(blobs):
                rows.append((sup * ranges + k, grp, sup, *blobs))
        return pa.table([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(_MERGED)], schema=_MERGED)

    return each


def _total(t: pa.Table) -> pa.Table:
    """A bucket's totals for each group and range that asked, and a row of its statistics."""
    begin = xxhash.xxh3_64_intdigest(BEGIN)
    bucket, n = t.column("bucket")[0].as_py(), t.num_rows
    out, stats = [], [0, 0, 0, 0]
    for name in ("uni", "bi"):
        parts = [_unpack(b, 3) for b in t.column(name).to_pylist()]
        sizes = [len(p[0]) for p in parts]
        hashes, counts, held = (np.concatenate([p[c] for p in parts]) for c in range(3))
        distinct, at = np.unique(hashes, return_inverse=True)
        at = at.ravel()
        total = np.bincount(at, counts.astype(np.float64), len(distinct)).astype(np.int64)
        left = total - np.bincount(at, held.astype(np.float64), len(distinct)).astype(np.int64)
        ends = np.cumsum([0, *sizes])
        out.append([_pack(total[at[lo:hi]], left[at[lo:hi]]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)])
        if name == "uni":
            real = distinct != np.uint64(begin)
            stats = [int((total[real] > 0).sum()), int(total[real].sum()), int((left[real] > 0).sum()), int(left[real].sum())]
    columns = [[*t.column("grp").to_pylist(), -1], [*t.column("sup").to_pylist(), -1], [bucket] * (n + 1), [*out[0], None], [*out[1], None], *([*([0] * n), x] for x in stats)]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _RETURNED, strict=True)], schema=_RETURNED)


def _share_out(asked: pa.Table, returned: pa.Table) -> pa.Table:
    """The totals of a group's range, for each of its chunks in the chunk's order."""
    if not asked.num_rows or not returned.num_rows:
        return _ANSWER.empty_table()
    order = np.argsort(returned.column("bucket").to_numpy()).tolist()
    out = []
    for name in ("uni", "bi"):
        pieces = [_unpack(b, 2)[0] for b in asked.column(name).to_pylist()]
        distinct, blobs = np.unique(np.concatenate(pieces)), returned.column(name).to_pylist()
        totals = [np.concatenate(c) for c in zip(*(_unpack(blobs[k], 2) for k in order), strict=True)]
        out.append([_pack(*(x[np.searchsorted(distinct, p)] for x in totals)) for p in pieces])
    n, zeros = asked.num_rows, [0] * asked.num_rows
    columns = [asked.column("chunk").to_pylist(), asked.column("sup").to_pylist(), *out, zeros, zeros, zeros, zeros]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ANSWER, strict=True)], schema=_ANSWER) if n else _ANSWER.empty_table()


def _answered(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(answers to the chunks, a row of statistics for each bucket), of chunks from 0, those from `n` on held out."""
    request = lambda buckets: docs.select("chunk", "text", "training").groupBy("chunk").applyInArrow(_requests(buckets), _ddl(_REQUEST))
    if n <= DIRECT:
        answers = cut(request(n).groupBy("bucket").applyInArrow(_answers(n), _ddl(_ANSWER)))
        return answers.where("chunk >= 0"), answers.where("chunk = -1")
    ranges = int(np.ceil(np.sqrt(n)))
    asked = request(ranges).withColumnRenamed("bucket", "sup").withColumn("grp", F.floor(F.col("chunk") / ranges).cast("int"))
    merged = asked.groupBy("grp", "sup").applyInArrow(_merge(ranges, n), _ddl(_MERGED))
    returned = cut(merged.groupBy("bucket").applyInArrow(_total, _ddl(_RETURNED)))
    own = returned.where("grp >= 0").select("grp", "sup", "bucket", "uni", "bi").groupBy("grp", "sup")
    return cut(asked.groupBy("grp", "sup").cogroup(own).applyInArrow(_share_out, _ddl(_ANSWER))), returned.where("grp = -1")


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then one bucket for each doubling."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


def _estimates(g: Grams, uni: np.ndarray, bi: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: the bucket of its context, and the bigram and unigram estimates."""
    context = uni[g.previous]
    f2 = bi[g.pairs_of] / np.maximum(context, 1)
    return context_bucket(context), f2, uni[g.tokens] / max(total, 1)


def _totals(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(uni, uni without the held-out fold, bi, bi without it) in the chunk's own order."""
    order = np.argsort(answers.column("bucket").to_numpy())
    out = []
    for name in ("uni", "bi"):
        blobs = answers.column(name).to_pylist()
        parts = [_unpack(blobs[k], 2) for k in order.tolist()]
        out += [np.concatenate([p[c] for p in parts]).astype(np.int64) for c in (0, 1)]
    return out[0], out[1], out[2], out[3]


def _cell(x: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 to GRID-1 on a logarithmic scale from 1e-12 to 1."""
    return np.where(x > 0, 1 + np.clip(((np.log10(np.maximum(x, 1e-12)) + 12) / 12 * (GRID - 2)).astype(np.int64), 0, GRID - 2), 0)


_CELLS = pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("f2", pa.float64()), ("f1", pa.float64())])


def _histogram(total: int):
    def each(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _CELLS.empty_table()
        g = Grams(docs.column("text").to_pylist())
        _, uni, _, bi = _totals(answers)
        rows = np.repeat(docs.column("training").to_numpy(zero_copy_only=False).astype(bool), np.diff(g.ends, prepend=0))
        b, f2, f1 = (x[rows] for x in _estimates(g, uni, bi, total))
        cells, at = np.unique((b * GRID + _cell(f2)) * GRID + _cell(f1), return_inverse=True)
        at = at.ravel()
        return pa.table([pa.array(cells, pa.int64()), np.bincount(at, minlength=len(cells)).astype(np.int64), np.bincount(at, f2, len(cells)), np.bincount(at, f1, len(cells))], schema=_CELLS)

    return each


def maximise(cells: list[tuple[int, int, float, float]], types: int, rounds: int = 60) -> np.ndarray:
    """Weights (l2, l1, l0) of each bucket, which add up to one, from the histogram (cell, n, sum of f2, sum of f1)."""
    start = np.array([0.4, 0.5, 0.1])
    if not cells:
        out = np.tile([0.0, 0.0, 1.0] if types <= 0 else start, (BUCKETS, 1))
        out[0] = [0.0, *(out[0, 1:] / out[0, 1:].sum())]
        return out
    code, n, f2, f1 = (np.array(c) for c in zip(*sorted(cells), strict=True))
    f = np.stack([f2 / n, f1 / n, np.full(len(n), 1.0 / (types + 1))], axis=1)

    def run(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            part = f[rows] * w
            share = (part / np.maximum(part.sum(axis=1, keepdims=True), 1e-300) * n[rows, None]).sum(axis=0)
            w = share / share.sum()
        return (w + _TINY) / (w + _TINY).sum()

    pooled = run(np.arange(len(n)), start)
    out = np.stack([run(np.flatnonzero(code // GRID**2 == b), start) if (code // GRID**2 == b).any() else pooled for b in range(BUCKETS)])
    out[0, 0] = 0.0  # an unseen context has no bigrams, so its whole mass goes to the other estimates
    out[0] /= out[0].sum()
    return out


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scores(total: int, types: int, weights: np.ndarray):
    def each(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _SCORES.empty_table()
        g = Grams(docs.column("text").to_pylist())
        uni, _, bi, _ = _totals(answers)
        b, f2, f1 = _estimates(g, uni, bi, total)
        w = weights[b]
        p = np.log10(w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] / (types + 1))
        base = np.log10((uni[g.tokens] + 1) / (total + types + 1))
        known = (uni[g.tokens] > 0).astype(np.int64)
        starts = g.ends - np.diff(g.ends, prepend=0)
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has its end token, so no part is empty
        n = len(starts)
        return pa.table([docs.column("doc_id").combine_chunks().cast(pa.int64()), docs.column("held_out").combine_chunks(), np.diff(g.ends, prepend=0), add(known), np.full(n, total), add(base), add(p)], schema=_SCORES)

    return each


def score(df: DataFrame, held_out: Column, deleted: Column, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Counts come from the rows where `held_out` is false; of these, the rows where `deleted` is true fit
    the mixture weights against the counts of the others. base_score is the add-one unigram score.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"), (~held_out).alias("training"), (~held_out & deleted).alias("_deleted"))
    size = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n = max(1, -(-int((size[0] or 0) + 8 * size[1]) // chunk_bytes))
    h = F.xxhash64("doc_id", "text")
    docs = docs.withColumn("chunk", F.when(F.col("_deleted"), F.lit(n) + F.pmod(h, F.lit(-(-n // 6)))).otherwise(F.pmod(h, F.lit(n))).cast("int")).drop("_deleted")
    grouped = docs.groupBy("chunk")
    answers, counted = _answered(docs, n)
    stats = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "tokens", "kept_types", "kept_tokens"))).first()
    release(df.sparkSession)  # the shuffles behind the answers, now that the checkpoint's events are through
    mine = answers.select("chunk", "bucket", "uni", "bi")
    held = docs.where(F.col("chunk") >= n).select("chunk", "text", "training").groupBy("chunk").cogroup(mine.where(F.col("chunk") >= n).groupBy("chunk"))
    cells = held.applyInArrow(_histogram(int(stats[3])), _ddl(_CELLS)).groupBy("cell").agg(F.sum("n"), F.sum("f2"), F.sum("f1")).collect()
    release(df.sparkSession)
    weights = maximise([tuple(c) for c in cells], int(stats[2]))
    return grouped.cogroup(mine.groupBy("chunk")).applyInArrow(_scores(int(stats[1]), int(stats[0]), weights), _ddl(_SCORES))
