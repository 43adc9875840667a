"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select.

Four base patterns (email, ip, card, phone) always stay. Wider generators add candidates that may
overlap: spelled-out addresses, IPv6, digit groups with other separators, national phone numbers,
account numbers and social security numbers. Each candidate gets format and context features, a
gradient-boosted ensemble of small trees gives a score, a logistic map fitted on held-out rows turns
it into a probability, and a threshold for each kind, chosen on those rows, keeps the sure ones. Of
overlapping candidates the most probable stays; a candidate that touches a base span goes.

The ensemble is trained on SAMPLE_ROWS labelled spans from a seeded generator in this module, so it
does not depend on the corpus. No pattern rescans a run, and overlaps are found by bisection among
sorted spans, so the work is linear in the text but for the sorting of its spans.

Defined cases: a null text has no spans and stays null when redacted, and so has and stays an empty one;
very long texts are whole; positions are code points with exclusive ends; of overlapping candidates of equal
probability the first stays, then the shorter, then by kind; repeated rows give repeated results; an empty table
gives no rows; columns other than key and text are not read by `find`, and `redact` keeps all of them.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import arrow_map, sha, slices, small_batches

#: Base kinds in their listed order, then the kinds that only the method finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
SAMPLE_ROWS = 6000
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 - 9 * (d > 4) if k % 2 else d
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind that pass its test, by kind and start."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _ANY_DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        if len(parts) < 4:
            continue
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(map(_octet, parts[k : k + 4])):
                out.append(("ip", at, at + size))
            at += size + 1
    for m in _DIGITS.finditer(text):
        if 13 <= len(m[0]) <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---------------------------------------------------------------- generators of candidates

_GENERATORS = [
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9][\w.%+-]{0,63} ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}", re.I)),
    ("ip", re.compile(r"(?<![\w:])[0-9A-Fa-f]{0,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![\w:])")),
    ("card", re.compile(r"(?<![\w.-])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){3}(?![\w])")),
    ("card", re.compile(r"(?<![\w.-])3[0-9]{3}[ ./_-]{1,2}[0-9]{6}[ ./_-]{1,2}[0-9]{5}(?![\w])")),
    ("phone", re.compile(r"(?<![\w.+-])\(?[0-9]{3}\)?[ ./-]{1,2}[0-9]{3}[ ./-]{1,2}[0-9]{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])00[0-9]{1,3}(?:[ ./-]\(?[0-9]{2,4}\)?){2,5}(?![\w-])")),
    ("phone", re.compile(r"\+[0-9]{1,3}[ .-]\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])")),
    ("card", re.compile(r"(?<![\w.-])[0-9]{13,19}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])0[0-9](?:[ ./-][0-9]{2}){4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])0[0-9]{2,4}[ /-][0-9]{5,9}(?![\w-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![\w.-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])")),
]
_SPELLED = re.compile(r"[\[({ ]at[\])} ]", re.I)


def candidates(text: str) -> list[Span]:
    out = []
    digits = _ANY_DIGIT.search(text) is not None
    for kind, pattern in _GENERATORS:
        if kind == "email":
            if _SPELLED.search(text) is None:
                continue
        elif not digits:
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return list(dict.fromkeys(out))


# ---------------------------------------------------------------- features

#: Words near a span, in English, French, German and Spanish (fixed values).
_NEAR = {
    "email": ("mail", "e-mail", "email", "courriel", "correo", "kontakt", "contact", "write", "schreib"),
    "ip": ("ip", "host", "server", "address", "adresse", "client", "login"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta", "amex", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "appel", "anruf", "teléfono", "handy", "whatsapp"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "bic"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "other": ("version", "order", "isbn", "invoice", "serial", "total", "page", "ref", "id", "model", "part", "sku", "bestell", "article", "lot", "score", "hash", "commit", "time", "date"),
}
FEATURES = len(KINDS) + len(_NEAR) + 19


def _mod97(s: str) -> bool:
    s = s.replace(" ", "").upper()
    if not 15 <= len(s) <= 34 or not s.isalnum() or not s.isascii():
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    kind, lo, hi = span
    s, left, right = text[lo:hi], text[max(0, lo - 40) : lo].lower(), text[hi : hi + 20].lower()
    digits = "".join(c for c in s if "0" <= c <= "9")
    runs = re.findall("[0-9]+", s)
    words = set(re.findall(r"[\w-]+", left)) | set(re.findall(r"[\w-]+", right[:12]))
    near = [float(any(x.startswith(w) if len(w) > 3 else x == w for x in words for w in group)) for group in _NEAR.values()]
    out = [float(kind == k) for k in KINDS] + near
    area = digits[:3]
    out += [
        len(s), len(digits), sum(c.isalpha() for c in s), len(runs), max(map(len, runs), default=0), min(map(len, runs), default=0),
        float(len(digits) in range(13, 20) and luhn(digits)), float(kind == "iban" and _mod97(s)),
        float(s[:1] == "+" or s[:2] == "00"), float("(" in s), float("." in s), float("-" in s), float(" " in s), float("/" in s),
        float(len(set(digits)) <= 2), float(left[-1:].isalnum()), float(left.rstrip()[-1:] in ("#", "$", "€", "£", "=", "v")),
        float(kind == "ssn" and (area in ("000", "666") or area >= "900" or s[4:6] == "00" or s[-4:] == "0000")),
        float(kind == "email" and bool(re.search(r"(?:dot|\.)[\])} ]* ?(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|co)$", s.lower()))),
    ]
    return out


# ---------------------------------------------------------------- boosted trees


class Trees:
    """Gradient boosting for the logistic loss: complete trees of fixed depth over binned features."""

    def __init__(self, count: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, smooth: float = 1.0):
        self.count, self.depth, self.rate, self.bins, self.smooth = count, depth, rate, bins, smooth
        self.start, self.feature, self.cut, self.leaf = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.start)
        width = self.bins + 1
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                base = (1 << level) - 1
                for k in range(1 << level):
                    here = np.flatnonzero(node == base + k)
                    if here.size < 2:
                        continue
                    best = (1e-9, 0, np.inf)
                    total_g, total_h = g[here].sum(), h[here].sum()
                    for j, e in enumerate(edges):
                        if not e.size:
                            continue
                        sg = np.cumsum(np.bincount(binned[here, j], g[here], width))[: e.size]
                        sh = np.cumsum(np.bincount(binned[here, j], h[here], width))[: e.size]
                        gain = sg**2 / (sh + self.smooth) + (total_g - sg) ** 2 / (total_h - sh + self.smooth) - total_g**2 / (total_h + self.smooth)
                        at = int(np.argmax(gain))
                        if gain[at] > best[0]:
                            best = (gain[at], j, e[at])
                    feature[base + k], cut[base + k] = best[1], best[2]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - ((1 << self.depth) - 1)
            size = 1 << self.depth
            value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.smooth)
            f += value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(value)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            f += leaf[node - ((1 << self.depth) - 1)]
        return f


# ---------------------------------------------------------------- labelled spans


def _account(rng: random.Random) -> str:
    country, body = rng.choice(["DE", "FR", "ES", "GB"]), "".join(rng.choice("0123456789") for _ in range(18))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    s = f"{country}{check:02d}{body}"
    return " ".join(s[k : k + 4] for k in range(0, len(s), 4)) if rng.random() < 0.5 else s


def _card(rng: random.Random) -> str:
    body = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def _no_card(rng: random.Random) -> str:
    s = _card(rng)
    return s[:-1] + str((int(s[-1]) + rng.randrange(1, 10)) % 10)


def labelled(rows: int = SAMPLE_ROWS, seed: int = 11) -> list[tuple[str, Span, int]]:
    """Candidate spans of made-up sentences with their labels: 1 personal data, 0 a look-alike."""
    rng = random.Random(seed)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    sep = lambda: rng.choice([" ", ".", "/", "-"])
    tld = lambda: rng.choice(["com", "org", "net", "de", "fr", "es"])

    def group(s: str, by: str, k: int = 4) -> str:
        return by.join(s[i : i + k] for i in range(0, len(s), k))

    def positive() -> tuple[str, str]:
        d, e = sep(), sep()
        return rng.choice([
            lambda: ("email", f"{word()}.{n(2)} [at] {word()} [dot] {tld()}"), lambda: ("email", f"{word()}(at){word()}.{tld()}"), lambda: ("email", f"{word()} at {word()} dot {tld()}"),
            lambda: ("ip", ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8))), lambda: ("ip", f"2001:db8:{rng.randrange(65536):x}::{rng.randrange(1, 65536):x}"),
            lambda: ("card", group(_card(rng), rng.choice([".", "/", "_", "  "]))), lambda: ("phone", f"({rng.randrange(200, 990)}) {n(3)}-{n(4)}"), lambda: ("phone", f"{rng.randrange(200, 990)}{d}{n(3)}{d}{n(4)}"),
            lambda: ("phone", f"00{rng.choice(['1', '33', '44', '49', '34'])} {n(3)} {n(3)} {n(3)}"), lambda: ("phone", f"0{rng.randrange(1, 8)}{e}" + e.join(n(2) for _ in range(4))), lambda: ("phone", f"0{n(3)} {n(7)}"),
            lambda: ("phone", f"+{rng.choice(['1', '33', '49'])} ({n(3)}) {n(3)}-{n(4)}{rng.choice(['', ' ' + n(2), ' ' + n(3) + '.' + n(2)])}"), lambda: ("card", _card(rng) + rng.choice(["", " " + n(2), " " + n(4)])),
            lambda: ("iban", _account(rng)), lambda: ("ssn", f"{rng.randrange(1, 665):03d}-{rng.randrange(1, 99):02d}-{rng.randrange(1, 9999):04d}"),
        ])()

    def negative() -> tuple[str, str]:
        return rng.choice([
            lambda: ("email", f"{word()} at {word()}.{word()}"), lambda: ("email", f"{word()} at {word()}. {word().title()}"), lambda: ("email", f"{word()} at {word()} dot {word()}"),
            lambda: ("ip", f"{n(2)}:{n(2)}:{n(2)}"), lambda: ("ip", f"{n(1)}:{n(2)}:{n(2)}"), lambda: ("card", group(_no_card(rng), rng.choice([" ", "-", ".", "/"]))), lambda: ("card", _no_card(rng)),
            lambda: ("phone", f"{n(3)}.{n(3)}.{n(4)}"), lambda: ("phone", f"{n(3)} {n(3)} {n(4)}"), lambda: ("phone", f"0{n(1)}-{n(2)}-{n(2)}-{n(2)}-{n(2)}"), lambda: ("phone", f"00{n(8)}"),
            lambda: ("iban", f"{rng.choice(['AB', 'XK', 'SN', 'LT'])}{n(2)}{n(12)}"), lambda: ("iban", f"ID{n(2)} {n(4)} {n(4)}"), lambda: ("ssn", f"{n(3)} {n(2)} {n(4)}"), lambda: ("ssn", f"9{n(2)}-{n(2)}-{n(4)}"),
        ])()

    out: list[tuple[str, Span, int]] = []
    while len(out) < rows:
        good = rng.random() < 0.5
        kind, s = positive() if good else negative()
        cue = ""
        if good and s[0] != "+" and (kind == "phone" or rng.random() < 0.5):
            cue = rng.choice(_NEAR[kind]) + rng.choice([": ", " ", " is ", ". "]) if rng.random() < (0.75 if kind in ("phone", "ssn") else 0.4) else ""
            if kind == "phone" and not cue and not s.startswith(("(", "00", "+")):
                continue
        elif not good:
            cue = rng.choice(_NEAR["other"]) + rng.choice([" ", ": ", " #"]) if rng.random() < 0.6 else ""
        before = " ".join(word() for _ in range(rng.randint(0, 6)))
        text = f"{before} {cue}{s}{rng.choice(['', '.', ',', ' ' + word(), ' ' + word() + ' ' + word()])}"
        lo = len(before) + 1 + len(cue)
        hits = [c for c in candidates(text) if c[0] == kind and c[1] < lo + len(s) and c[2] > lo]
        out += [(text, c, int(good)) for c in hits]
    return out[:rows]


class Detector:
    def __init__(self, trees: Trees, slope: float, shift: float, thresholds: dict[str, float]):
        self.trees, self.slope, self.shift, self.thresholds = trees, slope, shift, thresholds

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.score(x) + self.shift)))

    def find(self, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """(base spans, all spans) of each text, by kind as listed, then start."""
        base = [base_spans(t) if t else [] for t in texts]
        wanted, rows = [], []
        for i, t in enumerate(texts):
            found = candidates(t) if t else []
            if not found:
                continue
            taken = sorted((lo, hi) for _, lo, hi in base[i])
            starts, reach = [lo for lo, _ in taken], list(accumulate((hi for _, hi in taken), max))
            for c in found:
                before = bisect_left(starts, c[2])  # base spans that begin before its end
                if not before or reach[before - 1] <= c[1]:
                    wanted.append((i, c))
                    rows.append(features(t, c))
        added: dict[int, list[Span]] = {}
        placed: dict[int, list[tuple[int, int]]] = {}
        if rows:
            sure = sorted(((-p, i, c) for p, (i, c) in zip(self.probabilities(np.array(rows)).tolist(), wanted, strict=True) if p >= self.thresholds[c[0]]), key=lambda r: (r[0], r[1], r[2][1], r[2][2], r[2][0]))
            for _, i, c in sure:
                here = placed.setdefault(i, [])  # disjoint, in order
                at = bisect_left(here, (c[1], c[1]))
                if (at == 0 or here[at - 1][1] <= c[1]) and (at == len(here) or here[at][0] >= c[2]):
                    here.insert(at, (c[1], c[2]))
                    added.setdefault(i, []).append(c)
        order = {k: n for n, k in enumerate(KINDS)}
        rank = lambda s: (order[s[0]], s[1], s[2])
        return [(sorted(b, key=rank), sorted(b + added.get(i, []), key=rank)) for i, b in enumerate(base)]


@lru_cache(maxsize=2)
def detector(rows: int = SAMPLE_ROWS, precision: float = 0.99) -> Detector:
    """Trained on four fifths of the labelled spans; calibration and thresholds from the last fifth."""
    data = labelled(rows)
    x, y = np.array([features(t, s) for t, s, _ in data]), np.array([label for _, _, label in data], float)
    out = np.arange(len(data)) % 5 == 4
    trees = Trees().fit(x[~out], y[~out])
    f, truth = trees.score(x[out]), y[out]
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic map
        p = 1 / (1 + np.exp(-(slope * f + shift)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - truth) * f).sum() + 0.1 * (slope - 1), (p - truth).sum() + 0.1 * shift])
        h = np.array([[(w * f * f).sum() + 0.1, (w * f).sum()], [(w * f).sum(), w.sum() + 0.1]])
        slope, shift = np.array([slope, shift]) - np.linalg.solve(h, g)
    p = 1 / (1 + np.exp(-(slope * f + shift)))
    kinds = np.array([s[0] for _, s, _ in data])[out]
    thresholds = {}
    for kind in KINDS:
        here = kinds == kind
        order = np.argsort(-p[here])
        right = np.cumsum(truth[here][order]) / np.arange(1, here.sum() + 1)
        good = np.flatnonzero(right >= precision)
        thresholds[kind] = max(0.6, float(p[here][order][good[-1]])) if good.size else 1.1
    return Detector(trees, float(slope), float(shift), thresholds)


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in spans)


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(detector())

    def each(part):
        found = shared.value.find(part.column(text).to_pylist())
        out = {key: part.column(key)} | {f"n_{k}": [sum(s[0] == k for s in b) for b, _ in found] for k in BASE}
        return out | {"base_sha256": [sha(digest(b).encode()) for b, _ in found], "spans": [digest(a) for _, a in found]}

    return arrow_map(df.select(key, text), each, f"{key} long,{','.join(f'n_{k} long' for k in BASE)},base_sha256 string,spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span as [KIND]; spans that overlap become one, named by its first."""
    out, at = [], 0
    for kind, lo, hi in sorted(spans, key=lambda s: (s[1], -s[2])):
        if lo >= at:
            out += [text[at:lo], f"[{kind.upper()}]"]
        at = max(at, hi)
    return "".join(out) + text[at:]


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with the spans of `text` masked; a null text stays null."""
    shared = df.sparkSession.sparkContext.broadcast(detector())
    place, schema = df.columns.index(text), df.schema
    small_batches(df.sparkSession)

    def run(batches):
        for part in slices(batches):
            texts = part.column(place).to_pylist()
            found = shared.value.find(texts)
            new = [t if t is None else masked(t, a) for t, (_, a) in zip(texts, found, strict=True)]
            arrays = [pa.array(new, part.schema.field(k).type) if k == place else part.column(k) for k in range(part.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return df.mapInArrow(run, schema)


def with_length(df: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """`length` brought up to date after a change of the text, where the frame has it."""
    return df.withColumn(length, F.coalesce(F.char_length(text).cast(df.schema[length].dataType), F.col(length))) if length in df.columns else df
