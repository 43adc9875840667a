"""Byte-level BPE with a pair occurrence index.

A worker gathers the distinct pre-tokens of a slice of its partition that it has not met yet (so the index spans
the new pre-tokens of a slice; those met before are looked up), lays their bytes out as one array of symbols and maps every adjacent pair that the vocabulary can merge
to all its positions. The ranks that are active are taken in ascending order; all positions of a
rank are merged at once (left to right, so overlapping pairs resolve as the sequential rule does),
the neighbours' pairs are looked up again, and their positions go to the lists of their own ranks.
A merge makes only pairs of higher rank, because a symbol's own merge comes before every merge that
uses it; `Vocabulary` verifies that when it loads. Encoded pre-tokens are kept in a table of bounded
size, so a repeated pre-token costs one lookup.

Defined cases: a null text is the empty one and has no ids; the file's special token is found in a
text as the tokenizers library finds it, and a file whose special tokens strip white space, match whole words only
or are normalized is refused; very long texts are whole; repeated rows give repeated rows; an empty table gives no
rows; other columns of the input are not read, except those in `keep`, which pass through.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame

from scriptoria.llm.common import arrow_map, sha

#: The split of byte-level BPE before merging (a fixed value of the vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte: itself where it prints, else the next free code point from 256."""
    plain = [b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + k): b for k, b in enumerate(rest)}


def token_bytes(data: str) -> list[bytes]:
    """Bytes of each id, special tokens as their UTF-8."""
    spec, alphabet = json.loads(data), byte_alphabet()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    out = [b""] * (max([*spec["model"]["vocab"].values(), *special.values()]) + 1)
    for token, k in spec["model"]["vocab"].items():
        out[k] = bytes(alphabet[c] for c in token)
    for token, k in special.items():
        out[k] = token.encode()
    return out


class Vocabulary:
    """Merges and tokens of a byte-level BPE file in the tokenizers library's JSON form."""

    def __init__(self, data: str):
        spec = json.loads(data)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are supported")
        if any(x.get(c) for x in spec["added_tokens"] for c in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("only special tokens that match as they stand are supported")
        alphabet = byte_alphabet()
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.byte_id = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.result = np.array([vocab["".join(m)] for m in merges], np.int64)
        born = np.full(size, -1, np.int64)
        born[self.result] = np.arange(len(merges))
        if len(set(self.result.tolist())) != len(merges) or (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a symbol that a later merge makes")
        self.size, self.left, self.right = size, left, right
        keys = left * size + right
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.split = regex.compile(SPLIT)
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs that do not merge."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank[at], -1)


def merge_words(words: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of each non-empty pre-token, by the pair occurrence index over all of them together."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = vocab.byte_id[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
    n = symbols.size
    ends = np.cumsum(lengths)
    follow = np.arange(1, n + 1)  # the next live position of the same word, n for none
    follow[ends - 1] = n
    before = np.arange(-1, n - 1)
    before[ends - lengths] = -1
    symbols = np.append(symbols, -1)
    live = np.ones(n + 1, bool)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Look up the pairs that start at these positions and append them to their ranks' lists."""
        at = at[follow[at] < n]
        if not at.size:
            return
        ranks = vocab.ranks(symbols[at], symbols[follow[at]])
        keep = ranks >= 0
        at, ranks = at[keep], ranks[keep]
        if not at.size:
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), at.size], strict=True):
            r = int(ranks[lo])
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(at[lo:hi])

    enter(np.flatnonzero(follow < n))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = at[(symbols[at] == vocab.left[r]) & (symbols[follow[at]] == vocab.right[r]) & live[at]]
        if not at.size:
            continue
        if at.size > 1:
            at = np.sort(at)
            chained = follow[at[:-1]] == at[1:]  # the pair begins inside the one before it: aaa
            if chained.any():
                take = np.ones(at.size, bool)
                for k in np.flatnonzero(chained).tolist():
                    take[k + 1] = not take[k]
                at = at[take]
        gone = follow[at]
        symbols[at] = vocab.result[r]
        live[gone] = False
        symbols[gone] = -1
        beyond = follow[gone]
        follow[at] = beyond
        before[beyond[beyond < n]] = at[beyond < n]
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        ahead = ahead[symbols[ahead] != vocab.result[r]]  # those are in `at`
        enter(np.concatenate((ahead, at)))
    kept = np.flatnonzero(live[:n])
    out = symbols[kept]
    cuts = np.searchsorted(kept, ends)
    return [out[lo:hi] for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]


class Encoder:
    """Encodes texts; `room` bounds the kept pre-tokens, beyond it the table starts anew."""

    def __init__(self, vocab: Vocabulary, room: int = 120_000, batch_chars: int = 2_000_000):
        self.vocab, self.room, self.batch_chars = vocab, room, batch_chars
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[list[str] | int]:
        """Pre-tokens of the stretches between special tokens, and the ids of those."""
        v = self.vocab
        if v.special_split is None or not any(s in text for s in v.special):
            return [v.split.findall(text)]
        return [v.special[x] if x in v.special else v.split.findall(x) for x in v.special_split.split(text) if x]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The table, with all these words in it."""
        missing = words - self.known.keys()
        if missing and len(self.known) + len(missing) > self.room:  # what this slice uses stays
            self.known = {w: self.known[w] for w in words & self.known.keys()}
        if missing:
            fresh = list(missing)
            self.known.update(zip(fresh, (ids.astype("<u4").tobytes() for ids in merge_words([w.encode() for w in fresh], self.vocab)), strict=True))
        return self.known

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(texts):
            chars, upto = 0, at
            while upto < len(texts) and (upto == at or chars + len(texts[upto] or "") <= self.batch_chars):
                chars += len(texts[upto] or "")
                upto += 1
            split = [self.pieces(t or "") for t in texts[at:upto]]
            get = self.learn(set().union(*(p for parts in split for p in parts if not isinstance(p, int)))).__getitem__
            for parts in split:
                out.append(b"".join([np.uint32(p).tobytes() if isinstance(p, int) else b"".join(map(get, p)) for p in parts]))
            at = upto
        return out


def decode(ids: bytes, bytes_of: list[bytes]) -> str:
    """Text of little-endian 32-bit ids; byte sequences that are no UTF-8 become U+FFFD."""
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_kept: dict[tuple, object] = {}


def _once(shared, make):
    """One encoder or decoding table per worker and vocabulary."""
    k = (make.__name__, shared.value[0])
    if k not in _kept:
        _kept[k] = make(shared.value[1])
    return _kept[k]


def encoder(data: str) -> Encoder:
    return Encoder(Vocabulary(data))


def _share(df: DataFrame, path: str):
    """The vocabulary file is read once on the driver; its size does not grow with the data."""
    with open(path, encoding="utf-8") as f:
        data = f.read()
    return df.sparkSession.sparkContext.broadcast((sha(data.encode()), data))


def _kept_types(keep: tuple[str, ...]) -> str:
    return "".join(f"{c} long," for c in keep)


def bpe_encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the long columns in `keep`, ids (binary, little-endian unsigned 32-bit), n_tokens for every row."""
    shared = _share(df, path)

    def each(part):
        ids = _once(shared, encoder).encode(part.column(text).to_pylist())
        return {key: part.column(key), **{c: part.column(c) for c in keep}, "ids": ids, "n_tokens": [len(x) // 4 for x in ids]}

    return arrow_map(df.select(key, *keep, text), each, f"{key} long,{_kept_types(keep)}ids binary,n_tokens long", 1024)


def bpe_decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the long columns in `keep`, n_tokens, ids_sha256, text for every row of encoded ids; null ids decode to the empty text."""
    shared = _share(df, path)

    def each(part):
        bytes_of, stored = _once(shared, token_bytes), [x or b"" for x in part.column(ids).to_pylist()]
        return {key: part.column(key), **{c: part.column(c) for c in keep}, "n_tokens": [len(x) // 4 for x in stored], "ids_sha256": [sha(x) for x in stored], "text": [decode(x, bytes_of) for x in stored]}

    return arrow_map(df.select(key, *keep, ids), each, f"{key} long,{_kept_types(keep)}n_tokens long,ids_sha256 string,text string", 1024)
