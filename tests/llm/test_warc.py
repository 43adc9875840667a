import gzip
import random
from collections import Counter

from sql import connect, same

from scriptoria.llm import op5_warc, warc


def test_query_equals_its_sql(spark, sf_dir):
    assert same(op5_warc.run(spark, sf_dir), connect(sf_dir), op5_warc.ORACLE_SQL) > 0
    bigger = sf_dir.replace("sf0.001", "sf0.01")
    assert same(op5_warc.run(spark, bigger), connect(bigger), op5_warc.ORACLE_SQL) > 0


def test_files_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nx", "<p>é\r\n\r\nWARC/1.1</p>"), (2, None, None), (3, "http://b", ""), (3, "http://b", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        warc.write_warc(df, path, "url", "page_id", "html", compression)
        out = warc.read_warc(spark, path).orderBy("seq").collect()
        assert [bytes(r["payload"]).decode() for r in out] == ["<p>é\r\n\r\nWARC/1.1</p>", "", "", ""]
        assert [r["uri"] for r in out] == ["http://a/  x", "", "http://b", "http://b"]
        assert all(a["offset"] + a["length"] == b["offset"] for a, b in zip(out, out[1:], strict=False))
        leaves = warc.replica(spark, path).orderBy("seq").collect()
        assert [(r["lo"], r["hi"], r["digest"]) for r in leaves] == [(r["offset"], r["offset"] + r["length"], r["digest"]) for r in out]
        assert len({r["nodes"][-1] for r in leaves}) == 1 and len({r["nodes"][0] for r in leaves}) == 4
    assert warc.replica(spark, path).select("file").distinct().collect()[0][0] == "part-00000-c000"


def test_broken_bytes():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [r["type"] for r in warc.parse(good + b"garbage")] == [None, "broken"]
    assert [(r["type"], r["length"]) for r in warc.parse(good + b"gar\r\n\r\nbage\r\n\r\n" + good)] == [(None, len(good)), ("broken", 15), (None, len(good))]
    assert [r["payload"] for r in warc.parse(b"\r\n\r\n" + good + b"\r\n\r\n" + good)] == [b"ab", b"ab"]
    assert [r["payload"] for r in warc.parse(gzip.compress(good))] == [b"ab"] and warc.parse(b"") == []
    assert warc.parse(good[:-6])[0]["payload"] == b""


def made(records):
    return [{"record_id": i, "length": len(t), "digest": warc.hashlib.sha256(t.encode()).hexdigest(), "offset": 0} for i, t in records]


def test_a_lost_record_changes_only_the_ranges_that_hold_it():
    records = [(f"r{k}", f"text {k}") for k in range(1000)]
    whole, less = warc.tree(made(records)), warc.tree(made([r for r in records if r[0] != "r400"]))
    for level in range(warc.LEVELS + 2):
        changed = set(whole[level]) ^ set(less[level])
        assert 1 <= len(changed) <= 3 and len(set(whole[level])) >= (1000, 40, 2, 1)[level]
    assert warc.tree([]) == [[]] * (warc.LEVELS + 2)


def stored(spark, path, files):
    """WARC files, written plainly, of lists of (record id, payload)."""
    path.mkdir()
    for k, rows in enumerate(files):
        data = b"".join(f"WARC/1.1\r\nWARC-Record-ID: {i}\r\nContent-Length: {len(t)}\r\n\r\n{t}\r\n\r\n".encode() for i, t in rows)
        (path / f"part-{k:05d}").write_bytes(data)
    return warc.replica(spark, str(path))


def test_audit_names_the_records(spark, tmp_path):
    rng = random.Random(3)
    a = [[(f"{f}-{k}", f"text {k} " * (k % 7)) for k in range(300)] for f in range(4)]
    b = [list(rows) for rows in a]
    del b[0][10]  # lost
    b[0][200] = (b[0][200][0], "other")  # altered
    b[1].insert(50, ("new", "x"))  # extra
    b[1][100], b[1][101] = b[1][101], b[1][100]  # moved within the file
    b[3].append(b[2].pop(7))  # moved to another file
    out = warc.audit(stored(spark, tmp_path / "a", a), stored(spark, tmp_path / "b", b)).collect()
    got = Counter((r["record_id"], r["status"]) for r in out)
    assert got == Counter([("0-10", "missing"), (a[0][201][0], "altered"), ("new", "extra"), ("1-99", "moved"), ("1-100", "moved"), ("2-7", "moved")])
    (crossed,) = [r for r in out if r["record_id"] == "2-7"]
    assert (crossed["file_a"], crossed["file_b"]) == ("part-00002", "part-00003")
    # any damage, against a comparison of the records without trees
    for turn in range(3):
        c = [[r for r in rows if rng.random() > 0.02] for rows in a]
        c = [[(i, t + "!") if rng.random() < 0.02 else (i, t) for i, t in rows] for rows in c]
        first, second = ({i: t for rows in x for i, t in rows} for x in (a, c))
        wanted = Counter([(i, "missing") for i in first.keys() - second.keys()] + [(i, "altered") for i in second if first[i] != second[i]])
        out = warc.audit(stored(spark, tmp_path / f"a{turn}", a), stored(spark, tmp_path / f"c{turn}", c)).collect()
        assert Counter((r["record_id"], r["status"]) for r in out) == wanted


def test_nulls_repeats_and_nothing(spark, tmp_path):
    rows = [(None, None, None), (1, "u", "x"), (1, "u", "x"), (1, "u", "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").coalesce(1)
    warc.write_warc(df, str(tmp_path / "a"), "url", "page_id", "html")
    warc.write_warc(df.limit(2), str(tmp_path / "b"), "url", "page_id", "html")
    a, b = (warc.replica(spark, str(tmp_path / x)) for x in "ab")
    assert a.count() == 4 and warc.audit(a, a).count() == 0
    assert [(r["record_id"], r["status"]) for r in warc.audit(a, b).collect()] == [("<urn:x-page:1>", "missing")] * 2
    warc.write_warc(df.where("false"), str(tmp_path / "c"), "url", "page_id", "html")
    assert warc.audit(*[warc.replica(spark, str(tmp_path / "c"))] * 2).count() == 0
