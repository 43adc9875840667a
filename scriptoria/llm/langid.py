"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, every run of non-letters becomes one space, and n-grams of 1 to 3 code points
are hashed to 2**BITS features. Document frequencies come from all training rows. The classifier is
fitted on a bounded sample of labelled training rows (about `per_label` of each language, chosen by a hash
of id, text and label, equal rows once) with the per-coordinate follow-the-regularised-leader update under an
elastic-net penalty, and a temperature is then fitted on the fifth of the sample kept out of it.

`accept` rejects texts that no learned language fits. A text's fit is the mean, over its n-grams as often as they
occur, of the log share of training rows that hold them: n-grams of no learned language are rare ones. The least
fit that passes is set on the kept-out fifth of the labelled sample, of which it loses LOST (a stated share).

Defined cases: a null text, and one without a letter, is `und` with score 0; with no labelled row, and so with
an empty table to learn from, every text is `und`; rows without an id are told apart by their text; rows with
equal ids and different texts both count; ties go to the first label in code-point order; repeated rows get equal
predictions; very long texts are whole; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import arrow_map, slices, small_batches

BITS = 15
SIZE = 1 << BITS
UNKNOWN = "und"
#: Share of labelled texts that the least fit may lose.
LOST = 0.004
#: Odd multipliers of the hash.
_A, _B, _C, _D = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263))
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(15)
    x *= _D
    x ^= x >> np.uint32(13)
    x *= _A
    return x >> np.uint32(32 - BITS)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Features and their counts in the whole text; None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = letter_table()[c]
    if not letter.any():
        return None
    c = np.concatenate(([32], np.where(letter, c, 32), [32])).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    one = c * _A + np.uint32(1)
    two = c[:-1] * _B + c[1:] * _C + np.uint32(2)
    three = c[:-2] * _C + c[1:-1] * _A + c[2:] * _B + np.uint32(3)
    found = np.bincount(_mix(np.concatenate((one, two, three))), minlength=SIZE)
    at = np.flatnonzero(found)
    return at, found[at]


def vector(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sublinear TF-IDF of unit length."""
    at, n = found
    x = (1.0 + np.log(n)) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


def document_frequencies(df: DataFrame, text: str = "text", ways: int = 16) -> tuple[np.ndarray, int]:
    """Rows holding each feature, and rows with a letter, over the whole frame; `ways` partial sums reach the driver."""
    schema = "n long,df binary"
    small_batches(df.sparkSession)

    def each(batches):
        total, n = np.zeros(SIZE, np.int64), 0
        for part in slices(batches):
            for t in part.column(0).to_pylist():
                if (found := counts(t)) is not None:
                    total[found[0]] += 1
                    n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "df": pa.array([total.tobytes()], pa.binary())})

    def add(batches):
        total, n = np.zeros(SIZE, np.int64), 0
        for part in slices(batches, 16):
            for k, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                total += np.frombuffer(b, np.int64)
                n += k
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "df": pa.array([total.tobytes()], pa.binary())})

    rows = df.select(text).mapInArrow(each, schema).repartition(ways).mapInArrow(add, schema).collect()
    return sum((np.frombuffer(r["df"], np.int64) for r in rows), np.zeros(SIZE, np.int64)), sum(r["n"] for r in rows)


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float = 1.0, least_fit: float = -np.inf):
        self.labels, self.weights, self.idf, self.temperature, self.least_fit = labels, weights, idf, temperature, least_fit

    def logits(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, x = vector(found, self.idf)
        return x @ self.weights[at] + self.weights[SIZE]

    def fit(self, found: tuple[np.ndarray, np.ndarray]) -> float:
        at, n = found
        return float(1.0 - (self.idf[at] * n).sum() / n.sum())

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(label, probability, fit)."""
        found = counts(text) if self.labels else None
        if found is None:
            return UNKNOWN, 0.0, -np.inf
        p = softmax(self.logits(found) / self.temperature)
        k = int(np.argmax(p))
        return self.labels[k], float(p[k]), self.fit(found)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, tuple[np.ndarray, np.ndarray]]], idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> Model:
    """FTRL-proximal over the rows (label, counts) in their order; every fifth row calibrates the temperature."""
    labels = sorted({lab for lab, _ in rows})
    place = {lab: k for k, lab in enumerate(labels)}
    width = len(labels)
    z, n = np.zeros((SIZE + 1, width)), np.zeros((SIZE + 1, width))
    data = [(place[lab], *vector(found, idf)) for lab, found in rows]
    data = [(y, np.append(at, SIZE), np.append(x, 1.0)) for y, at, x in data]
    train = [d for k, d in enumerate(data) if k % 5 != 4 or len(data) < 10]
    kept_out = [d for k, d in enumerate(data) if k % 5 == 4] or train

    def weights(at):
        za, na = z[at], n[at]
        w = -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2)
        return np.where(np.abs(za) <= l1, 0.0, w), na

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(train)):
            y, at, x = train[k]
            w, na = weights(at)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            more = na + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(na)) / alpha * w
            n[at] = more
    model = Model(labels, weights(np.arange(SIZE + 1))[0], idf)
    if kept_out:
        logits = np.array([x @ model.weights[at] for _, at, x in kept_out])
        truth = np.array([y for y, _, _ in kept_out])
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 10, 80), key=loss))
    if len(data) >= 10:
        fits = np.sort([model.fit(found) for k, (_, found) in enumerate(rows) if k % 5 == 4])
        model.least_fit = float(fits[int(LOST * len(fits))])
    return model


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = 900) -> Model:
    """A model of all rows given: frequencies of all of them, weights of at most about `per_label` rows a label."""
    rows = df.where(F.col(label).isNotNull()).select(key, text, label)
    have = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not have:
        return Model([], np.zeros((SIZE + 1, 0)), np.ones(SIZE))
    frequency, n = document_frequencies(rows, text)
    idf = np.log((1.0 + n) / (1.0 + frequency)) + 1.0
    share = F.create_map(*[F.lit(x) for lab, k in sorted(have.items()) for x in (lab, min(1.0, per_label / k))])
    name = F.xxhash64(F.col(key), F.col(text), F.col(label), F.lit("langid"))
    sample = rows.withColumn("_name", name).where(F.pmod("_name", F.lit(1 << 24)) / float(1 << 24) < F.element_at(share, F.col(label)))
    sample = sample.groupBy("_name").agg(F.min(F.struct(text, label)).alias("_row")).select(F.col("_name").alias("id"), F.col(f"_row.{text}").alias("text"), F.col(f"_row.{label}").alias("label"))

    def each(part):
        found = [counts(t) for t in part.column("text").to_pylist()]
        return {
            "id": part.column("id"), "label": part.column("label"),
            "at": [None if f is None else f[0].astype("<i4").tobytes() for f in found],
            "n": [None if f is None else f[1].astype("<i4").tobytes() for f in found],
        }

    got = arrow_map(sample, each, "id long,label string,at binary,n binary").where(F.col("at").isNotNull()).collect()
    got.sort(key=lambda r: r["id"])  # a hash, so the order is as good as random and the same in each run
    data = [(r["label"], (np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4").astype(np.int64))) for r in got]
    return fit(data, idf) if data else Model([], np.zeros((SIZE + 1, 0)), idf)


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score of every row. The model's size is fixed by BITS and the number of labels."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def each(part):
        got = [shared.value.predict(t) for t in part.column(text).to_pylist()]
        return {key: part.column(key), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return arrow_map(df.select(key, text), each, f"{key} long,lang_pred string,score double")


def accept(df: DataFrame, model: Model, margin: float = 1.2, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text fits a learned language.

    Three kinds go: texts without a letter; those that fit no language better than another, by a probability
    under `margin` times chance; and those whose n-grams are of no learned language, by the model's least fit.
    """
    small_batches(df.sparkSession)
    least = min(1.0, margin / max(1, len(model.labels)))
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)

    def run(batches):
        for part in slices(batches):
            got = [shared.value.judge(t) for t in part.column(place).to_pylist()]
            yield part.filter(pa.array([lang != UNKNOWN and p >= least and f >= shared.value.least_fit for lang, p, f in got], pa.bool_()))

    return df.mapInArrow(run, df.schema)
