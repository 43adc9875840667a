"""Images, dictionaries, lexicons, manifests and corpora as DataFrames."""

from __future__ import annotations

import io
import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.functions.text import natural_key, strip

MANIFEST = "page int, image string, text string, bubbles array<struct<box:array<int>,text:string,panel:int>>"
DATASET_MANIFEST = (
    "image string, split string, layout string, transcript string, "
    "lines array<struct<text:string,box:array<int>,direction:string,layout:string,font:string,angle:double>>, "
    "bubbles array<array<int>>, recognition_rows array<string>, source string"
)
SAMPLE = "id string, source_type string, script string, language string, resolution_dpi int, font_or_period string"
ENGINES = "id string, name string, kind string, language_codes array<string>, offline boolean, strengths array<string>, source string, language_models string, note string"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")


def images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, natural: bool = True) -> DataFrame:
    """page, name, path, content of the image files under a path, numbered from 1 in natural or plain name order.

    Numbers come from the listing (path and length only), before any content is read or found unreadable.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    listed = files.select("path", name.alias("name")).where(suffix.isin(*suffixes))
    order = [natural_key(F.col("name"))] if natural else []
    # one row a file: the listing of a chapter, not its contents
    pages = listed.withColumn("page", F.row_number().over(Window.orderBy(*order, "name", "path")))
    return pages.join(files.select("path", "content"), "path").select("page", "name", "path", "content")


def pixels(spark: SparkSession, path: str, natural: bool = True, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """page, name, data, height, width, channels (BGR bytes) by Spark's image source; unreadable files keep their number and have
    null data, files of other suffixes have no row."""
    name = F.element_at(F.split("origin", "/"), -1)
    found = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    found = found.where(F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*suffixes))
    listed = found.select("origin", name.alias("name"))
    order = [natural_key(F.col("name"))] if natural else []
    numbered = listed.withColumn("page", F.row_number().over(Window.orderBy(*order, "name", "origin")).cast("long"))
    bad = F.col("height") < 0
    out = found.select("origin", *(F.when(~bad, F.col(c)).alias(c) for c in ("data", "height", "width")), F.when(~bad, F.col("nChannels")).alias("channels"))
    return numbered.join(out, "origin").select("page", "name", "data", "height", "width", "channels")


def cropped_rows(height, top: int, bottom: int):
    """struct(top, bottom) of the rows kept: top within the page, bottom 0 for all."""
    first = F.greatest(F.lit(0), F.least(F.lit(top), height - 1))
    return F.struct(first.alias("top"), (height if bottom <= 0 else F.least(F.lit(bottom), height)).alias("bottom"))


def dictionary(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """class_id, ch: a character a line from class 1, class 0 being the blank; `extra` characters follow."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r?\n$", "").alias("value"))
    lines = F.concat(F.split("value", "\r?\n"), F.array(*[F.lit(c) for c in extra]).cast("array<string>"))
    return whole.select(F.posexplode(lines).alias("k", "ch")).select((F.col("k") + 1).alias("class_id"), "ch")


def _there(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(conf).globStatus(where)
    return found is not None and len(found) > 0


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, ipm of a tab-separated list with the columns Lemma and Freq(ipm): lower case, the most of repeated words, bad rows
    skipped; no file is an empty list."""
    if not _there(spark, path):
        return spark.createDataFrame([], "word string, ipm double")
    rows = spark.read.csv(path, sep="\t", header=True)
    names = {c.strip(): c for c in rows.columns}
    count = next((names[c] for c in ("Freq(ipm", "Freq(ipm)") if c in names), None)
    ipm = F.expr(f"try_cast(`{count}` as double)") if count else F.lit(0.0)
    word = F.lower(strip(F.col(f"`{names['Lemma']}`")))
    return rows.select(word.alias("word"), ipm.alias("ipm")).where("word <> '' and ipm is not null").groupBy("word").agg(F.max("ipm").alias("ipm"))


def manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """Rows of a JSON array with their place `ord` from 1; the array is one file by its format; no file is an empty array."""
    if not _there(spark, path):
        return spark.createDataFrame([], f"ord int, {schema}")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<struct<{_fields(schema)}>>")).alias("k", "m")).select((F.col("k") + 1).alias("ord"), "m.*")


def _fields(ddl: str) -> str:
    """A flat list `name type` with colons, as struct<> wants it."""
    out, depth, part = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += c
    return ",".join(out)


def recognition_rows(spark: SparkSession, path: str) -> DataFrame:
    """crop_path, text of a tab-separated file without header or quoting."""
    return spark.read.csv(path, sep="\t", schema="crop_path string, text string", quote="", escape="")


def xml_sentences(spark: SparkSession, path: str, tag: str = "sentence", child: str = "source") -> DataFrame:
    """text of each element of an XML corpus, by the native reader."""
    return spark.read.format("xml").option("rowTag", tag).schema(f"{child} string").load(path).select(F.col(child).alias("text"))


def tar_sentences(spark: SparkSession, path: str, member: str = "opencorpora_annot_2025.xml", tag: str = "sentence", child: str = "source") -> DataFrame:
    """archive, seq, text of each element of an XML member of .tar.gz archives, parsed as a stream in each archive's task."""
    schema = pa.schema([("archive", pa.string()), ("seq", pa.int64()), ("text", pa.string())])

    def parse(content: bytes) -> Iterator[str]:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz") as archive:
            for info in archive:
                if info.name.endswith(member):
                    for _, element in ET.iterparse(archive.extractfile(info), events=("end",)):
                        if element.tag.endswith(tag):
                            yield element.findtext(child, default="")
                            element.clear()
                    return
        raise FileNotFoundError(f"no member {member}")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows: list[tuple[int, str]] = []
                for seq, text in enumerate(parse(content)):
                    rows.append((seq, text))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, seq long, text string")


def sentence_lines(spark: SparkSession, path: str, least: int = 10, fallback: DataFrame | None = None) -> DataFrame:
    """text: trimmed lines of at least `least` characters; `fallback` (text) where there is no file or no such line."""
    if not _there(spark, path):
        return fallback if fallback is not None else spark.createDataFrame([], "text string")
    found = spark.read.text(path).select(strip(F.col("value")).alias("text")).where(F.char_length("text") >= least)
    return fallback if fallback is not None and found.isEmpty() else found
