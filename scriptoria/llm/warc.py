"""WARC files and a Merkle fixity audit of stored replicas.

A record's leaf covers its identifier, length and digest. The leaves of a file, in the order of their
offsets, are cut into ranges where a digest says so (one leaf in FANOUT ends a range, one in FANOUT**2 a range
of the next level, and so on), and a range's hash covers its children in order; the last level is the
root of the file. As the cuts depend on the contents alone, a lost or inserted record changes the ranges
that hold it and no others, though all later offsets shift.

The audit reads the files of two replicas, compares roots, and goes down only in files and ranges whose
hash has no equal in the other replica or stands in another order. There records are paired: by identifier
and digest first, the others by identifier. All hashes of a record's ranges stand in its own slim row, so
trees are built once, in the pass that reads the bytes, and the whole descent is one shuffle by file, whose
records are bounded by the writer (FILE_RECORDS).

Defined cases: a null payload or address is the empty one, a null identifier an empty one; of equal records each
counts; a record of one replica only is `missing` or `extra`; one that is intact in another place, of its file
or of the replica, is `moved`; one whose bytes differ is `altered`; bytes that are no record are one record of
type `broken` up to the next that is; very long payloads are whole; empty tables and folders give no rows; columns
other than the named ones are not read.
"""

from __future__ import annotations

import gzip
import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.llm.common import small_batches

FANOUT = 16
LEVELS = 2
#: Records of a file that `write_warc` makes; bounds what a task holds.
FILE_RECORDS = 1024
END = "\r\n\r\n"


def record(uri: Column, record_id: Column, payload: Column, date: str = "2020-01-01T00:00:00Z", kind: str = "text/html") -> Column:
    """A resource record without its closing two line ends, as a string."""
    payload = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.translate(F.coalesce(uri, F.lit("")), "\r\n", "  "),
        F.lit(f"\r\nContent-Type: {kind}\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit(END),
        payload,
    )


def write_warc(df: DataFrame, path: str, uri: str, record_id: str, payload: str, compression: str = "none", file_records: int = FILE_RECORDS) -> None:
    """WARC files of up to `file_records` records, in the order of the rows of each partition."""
    write_records(df.select(record(F.col(uri), F.col(record_id), F.col(payload)).alias("value")), path, compression, file_records)


def write_records(records: DataFrame, path: str, compression: str = "none", file_records: int = FILE_RECORDS) -> None:
    """Records without their closing line ends, which are the sink's separator."""
    records.write.mode("overwrite").option("lineSep", END).option("zlib.compress.level", "BEST_SPEED").option("compression", compression).option("maxRecordsPerFile", file_records).text(path)


def parse(data: bytes) -> list[dict]:
    """Records of a file with their offsets; bytes up to the next record that has a header are one of type `broken`."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out, at, end_mark = [], 0, END.encode()
    while at < len(data):
        if data.startswith(end_mark, at):  # line ends without a record
            at += 4
            continue
        head_end = data.find(end_mark, at)
        lines = data[at : max(head_end, at)].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = fields.get("content-length", "")
        if head_end < 0 or not lines[0].startswith("WARC/") or not size.isdigit():
            stop = data.find(end_mark + b"WARC/", at + 1)
            stop = len(data) if stop < 0 else stop + 4
            out.append({"offset": at, "length": stop - at, "type": "broken", "uri": None, "record_id": None, "payload": None, "digest": hashlib.sha256(data[at:stop]).hexdigest()})
            at = stop
            continue
        end = head_end + 4 + int(size)
        stop = end + 4 if data[end : end + 4] == end_mark else min(end, len(data))
        out.append({
            "offset": at, "length": stop - at, "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "record_id": fields.get("warc-record-id"),
            "payload": data[head_end + 4 : end], "digest": hashlib.sha256(data[at:stop]).hexdigest(),
        })
        at = stop
    return out


def _files(spark: SparkSession, path: str, each, target: pa.Schema, schema: str) -> DataFrame:
    """Rows of each file under the path; a file's name is its partition and part, which replicas have in common."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column("path")[k].as_py().rpartition("/")[2].split(".")[0]
                pieces = name.split("-")
                rows = each("-".join((*pieces[:2], pieces[-1])) if len(pieces) > 3 else name, parse(batch.column("content")[k].as_py()))
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 256], schema=target)

    small_batches(spark, 16)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, offset, length, type, uri, record_id, payload, digest of every record under the path."""
    schema = "file string,seq long,offset long,length long,type string,uri string,record_id string,payload binary,digest string"
    target = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("record_id", pa.string()), ("payload", pa.binary()), ("digest", pa.string())])
    return _files(spark, path, lambda name, rows: [{"file": name, "seq": i} | r for i, r in enumerate(rows)], target, schema)


def tree(records: list[dict], levels: int = LEVELS, fanout: int = FANOUT) -> list[list[str]]:
    """For each level, from the leaves up to the root, the name of every record's node there.

    A name is the node's hash and how many equal nodes of its level stand before it.
    """
    short = lambda text: hashlib.blake2b(text.encode(), digest_size=16).hexdigest()
    leaf = [short(f"{r['record_id'] or ''}:{r['length']}:{r['digest']}") for r in records]
    out, spans, hashes = [], [(k, k + 1) for k in range(len(leaf))], leaf
    for level in range(levels + 2):
        if level:  # group the nodes below
            every = fanout**level
            groups, at = [], 0
            for k, (_, hi) in enumerate(spans):
                if k + 1 == len(spans) or (level <= levels and int(leaf[hi - 1][:12], 16) % every == 0):
                    groups.append((at, k + 1))
                    at = k + 1
            hashes = [short(",".join(hashes[lo:hi])) for lo, hi in groups]
            spans = [(spans[lo][0], spans[hi - 1][1]) for lo, hi in groups]
        seen: Counter[str] = Counter()
        names = []
        for (lo, hi), h in zip(spans, hashes, strict=True):
            names += [f"{h}:{seen[h]}"] * (hi - lo)
            seen[h] += 1
        out.append(names)
    return out


def replica(spark: SparkSession, path: str, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """Leaves of the stored files: file, seq, record_id, lo, hi, digest, and `nodes`, the names of a record's nodes from leaf to root."""

    def each(name: str, rows: list[dict]) -> list[dict]:
        names = tree(rows, levels, fanout)
        return [
            {"file": name, "seq": k, "record_id": r["record_id"], "lo": r["offset"], "hi": r["offset"] + r["length"], "digest": r["digest"], "nodes": [n[k] for n in names]}
            for k, r in enumerate(rows)
        ]

    schema = "file string,seq long,record_id string,lo long,hi long,digest string,nodes array<string>"
    target = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("record_id", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("digest", pa.string()), ("nodes", pa.list_(pa.string()))])
    return _files(spark, path, each, target, schema)


def audit(a: DataFrame, b: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Records in which replica `b` differs from `a`; both as `replica` gives them, with the same `levels`.

    record_id, status (altered, moved, missing, extra), and file, lo, hi and digest of either side.
    """
    slim = ("file", "seq", "record_id", "lo", "hi", "digest", "nodes")
    open_ = a.select(*slim, F.lit(0).alias("side")).unionByName(b.select(*slim, F.lit(1).alias("side"))).repartition("file")
    for level in range(levels + 1, -1, -1):  # from the root to the leaves: what has an equal in its place is closed
        node = F.element_at("nodes", level + 1)
        open_ = open_.withColumn("node", node)
        same = Window.partitionBy("file", "node")
        open_ = open_.withColumn("both", F.min("side").over(same) != F.max("side").over(same)).withColumn("start", F.min("seq").over(Window.partitionBy("file", "node", "side")))
        place = F.when(F.col("both"), F.dense_rank().over(Window.partitionBy("file", "side", "both").orderBy("start")))
        open_ = open_.withColumn("place", place)
        displaced = F.min("place").over(same) != F.max("place").over(same)
        open_ = open_.withColumn("displaced", F.col("both") & displaced).where(~F.col("both") | F.col("displaced"))
    # at the leaves: equal ones in another order are moved, the others are paired by identifier in their order
    name = F.when(F.col("displaced"), F.concat(F.lit("="), "node")).otherwise(F.concat(F.lit("#"), F.coalesce("record_id", F.lit(""))))
    nth = F.row_number().over(Window.partitionBy("file", "name", "side").orderBy("seq"))
    paired = open_.withColumn("name", name).withColumn("nth", nth)
    of = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    sides = [of(c, k).alias(f"{c}_{s}") for k, s in enumerate("ab") for c in ("file", "lo", "hi", "digest")]
    rows = paired.groupBy("file", "name", "nth").agg(F.max("record_id").alias("record_id"), *sides)
    whole = ["record_id", *(f"{c}_{s}" for s in "ab" for c in ("file", "lo", "hi", "digest"))]
    lone = F.col("file_a").isNull() | F.col("file_b").isNull()
    inside = rows.where(~lone).select(*whole, F.when(F.col("digest_a") == F.col("digest_b"), "moved").otherwise("altered").alias("status"))
    # records of one side only: one that is intact in another file is moved
    digest = F.coalesce("digest_a", "digest_b")
    strays = rows.where(lone).withColumn("digest", digest).withColumn("from", F.col("file_b").isNull())
    strays = strays.withColumn("nth", F.row_number().over(Window.partitionBy("record_id", "digest", "from").orderBy(F.coalesce("file_a", "file_b"), F.coalesce("lo_a", "lo_b"))))
    met = strays.groupBy("record_id", "digest", "nth").agg(*(F.max(c).alias(c) for c in whole[1:]))
    status = F.when(F.col("file_b").isNull(), "missing").when(F.col("file_a").isNull(), "extra").otherwise("moved")
    return inside.unionByName(met.select(*whole, status.alias("status")))
