import hashlib
import random
import re

import numpy as np
import pytest

from scriptoria.llm import pii
from scriptoria.llm.op8_pii import run


def brute(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(v) <= 255 for v in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(int(c) * 2, 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_against_the_patterns():
    rng = random.Random(4)
    for pool, n in (("a.@-+ 0123456789()x_\n.1@", 20_000), ("0123456789 -", 20_000), ("ab1.@", 10_000)):
        for _ in range(n):
            t = "".join(rng.choice(pool) for _ in range(rng.randrange(50)))
            assert pii.base_spans(t) == brute(t), t


def test_held_out_precision_and_recall():
    d = pii.detector()
    data = pii.labelled(3000, seed=99)
    p = d.probabilities(np.array([pii.features(t, s) for t, s, _ in data]))
    y, kinds = np.array([label for *_, label in data]), np.array([s[0] for _, s, _ in data])
    for kind in pii.KINDS:
        kept = (kinds == kind) & (p >= d.thresholds[kind])
        assert y[kept].mean() > 0.97 and kept.sum() > 0.9 * y[kinds == kind].sum()
    assert abs(p.mean() - y.mean()) < 0.05  # calibrated


@pytest.mark.parametrize("text,kind", [
    ("write to anna.k [at] example [dot] com now", "email"), ("host 2001:db8:85a3::8a2e:370:7334 is up", "ip"), ("call (415) 555-2671 today", "phone"), ("card 4111.1111.1111.1111 ok", "card"),
    ("IBAN DE89 3704 0044 0532 0130 00 please", "iban"), ("ssn 536-90-4399 filed", "ssn"), ("Des +1 (826) 555-4081 190.137.223.20", "phone"),
])
def test_method_adds_spans(text, kind):
    base, every = pii.detector().find([text])[0]
    assert kind in {s[0] for s in every} and set(base) <= set(every) and kind not in {s[0] for s in base if s[0] not in pii.BASE}


@pytest.mark.parametrize("text", ["", "plain words only", "version 1.2.3 of 12:30:45", "order 1234-5678-9012-3456", "isbn 978-3-16-148410-0", "in 1999, 25 000 people", "meet at noon dot", "0007687199101951 things"])
def test_clean_texts_stay(text):
    assert pii.detector().find([text])[0][1] == []


def test_hostile_texts_take_linear_time():
    long = ["a" * 300_000 + "@", "1" * 300_000, "1.1." * 100_000, "0-" * 100_000, "a at " * 60_000 + "dot", "12:" * 100_000, "+1(" * 100_000, "a@" * 100_000]
    assert len(pii.detector().find(long)) == len(long)


def test_query(spark, sf_dir):
    out = {r["doc_id"]: r for r in run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        b, r = brute(d["text"] or ""), out[d["doc_id"]]
        digest = ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in b)
        assert r["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in b) for k in pii.BASE]
        assert set(digest.split(",")) <= set(r["spans"].split(","))


def test_redaction_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "a", 3), (2, "é a@b.co x", "b", 10), (2, "é a@b.co x", "b", 10), (None, "", "c", 0)], "doc_id long, text string, spans string, n_chars long")
    out = pii.with_length(pii.redact(df))
    assert out.columns == df.columns
    assert sorted(("-" if r["text"] is None else r["text"], r["n_chars"]) for r in out.collect()) == [("", 0), ("-", 3), ("é [EMAIL] x", 11), ("é [EMAIL] x", 11)]
    assert pii.masked("abcdef", [("ip", 1, 4), ("card", 2, 5)]) == "a[IP]f"
    assert pii.redact(df.where("false")).count() == 0


def test_many_hits_in_one_text():
    import time

    one = "ann@b.co called (415) 555-2671, card 4111.1111.1111.1111; "
    took = []
    for n in (1000, 8000):
        t0 = time.perf_counter()
        (base, every), = pii.detector().find([one * n])
        took.append(time.perf_counter() - t0)
        assert len(base) == n and len(every) == 3 * n
    assert took[1] < 24 * took[0]
    spans = sorted((lo, hi) for _, lo, hi in every)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_find_on_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x@y.zz", "c"), (3, "x@y.zz", "c"), (None, "10.0.0.1", None), (4, "word " * 60_000 + "x@y.zz", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = sorted(((r["doc_id"] or -1, r["n_email"], r["n_ip"], r["spans"]) for r in pii.find(df).collect()), key=str)
    assert out == sorted([(-1, 0, 1, "ip:0:8"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "email:0:6"), (3, 1, 0, "email:0:6"), (4, 1, 0, "email:300000:300006")], key=str)
    assert pii.find(df.where("false")).count() == 0


def test_overlaps_as_by_plain_search():
    rng = random.Random(8)
    d = pii.detector()
    parts = ["ann@b.co", "(415) 555-2671", "4111 1111 1111 1111", "4111.1111.1111.1111", "10.0.0.1", "+1 415 555 2671", "536-90-4399", "call", "ssn", "card", ","]
    for _ in range(300):
        t = " ".join(rng.choice(parts) for _ in range(12))
        (base, every), = d.find([t])
        free = [c for c in pii.candidates(t) if not any(c[1] < hi and lo < c[2] for _, lo, hi in base)]
        p = d.probabilities(np.array([pii.features(t, c) for c in free])).tolist() if free else []
        kept = []
        for _, c in sorted(((-q, c) for q, c in zip(p, free) if q >= d.thresholds[c[0]]), key=lambda r: (r[0], r[1][1], r[1][2], r[1][0])):
            if not any(c[1] < hi and lo < c[2] for _, lo, hi in kept):
                kept.append(c)
        assert sorted(every) == sorted([*base, *kept])
