"""The registered queries over the driver's tables, each with its SQL twin where SQL can express it.

Tables of the domain that the driver does not have are stood in for: boxes are derived from `part`,
readings are lines of orders, frames are events, class probabilities are embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import geometry as G
from scriptoria.functions import text as T
from scriptoria.functions import vectors as V
from scriptoria.functions.profile import CYRILLIC, LATIN
from scriptoria.operators import corpus, ctc, detect, evaluate, layout, live, spell, vote

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much work: dealt out to all cores where its files make fewer partitions than there are."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def micro(c: Column) -> Column:
    """Six decimals, so that sums in another order compare equal."""
    return F.round(c, 6)


# ---------------------------------------------------------------- text

P = CYRILLIC
_TOKEN = P.token_pattern
_L = P.letter_class
_PUNCT = "".join("\\" + c if c in "[]-^\\" else c for c in P.punctuation).replace("'", "''")
_MAPPED = f"translate(text, '{P.confusable_from}', '{P.confusable_to}')"
_Y = f"regexp_replace(translate(x, '{P.digit_from}', '{P.digit_to}'), '[^{_L}]', '', 'g')"
_CORRECTED = (
    f"CASE WHEN NOT regexp_matches(x, '[{_L}]') THEN regexp_replace(x, '[^0-9]', '', 'g') WHEN {_Y} = upper({_Y}) THEN {_Y} "
    f"WHEN substr({_Y}, 1, 1) = upper(substr({_Y}, 1, 1)) THEN substr({_Y}, 1, 1) || lower(substr({_Y}, 2)) ELSE lower({_Y}) END"
)


@query(f"SELECT doc_id, {_MAPPED} AS mapped FROM documents")
def map_confusables(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", T.map_confusables(F.col("text")).alias("mapped"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_TOKEN}')) AS INTEGER) AS n_tokens FROM documents")
def tokenize_count(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"))


_NORMALIZED = f"""
WITH m AS (SELECT doc_id, {_MAPPED} AS t FROM documents),
p AS (SELECT doc_id, string_split_regex(t, '{_TOKEN}') AS g, list_transform(regexp_extract_all(t, '{_TOKEN}'), lambda x: {_CORRECTED}) AS z FROM m),
j AS (SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(z[i], '')), '') AS t FROM p),
k AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[^{_L}0-9\\s{_PUNCT}]', '', 'g'), '[ \\t]+', ' ', 'g'), '\\s+([,.;:!?%])', '\\1', 'g') AS t FROM j)
SELECT doc_id, trim(t, E' \\t\\n\\r') AS normalized, CAST(len(regexp_extract_all(trim(t, E' \\t\\n\\r'), '{_TOKEN}')) AS INTEGER) AS n_tokens FROM k
"""


@query(_NORMALIZED)
def normalize_visual(spark, sf_dir):
    out = texts(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))
    return out.withColumn("n_tokens", F.size(T.tokens(F.col("normalized"))))


@query(
    f"SELECT doc_id, trim(regexp_replace(regexp_replace({_MAPPED}, '[^{_L}0-9\\s{_PUNCT}]', '', 'g'), '[ \\t]+', ' ', 'g'), E' \\t\\n\\r') AS normalized FROM documents"
)
def normalize_lite(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", T.normalize_lite(F.col("text")).alias("normalized"))


@query(f"""
WITH t AS (SELECT doc_id, {_MAPPED} AS t FROM documents), z AS (SELECT doc_id, regexp_extract_all(t, '{_TOKEN}') AS z FROM t),
e AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, z[i] AS x FROM (SELECT doc_id, z, unnest(range(1, len(z) + 1)) AS i FROM z))
SELECT doc_id, pos, x AS token, {_CORRECTED} AS corrected FROM e WHERE regexp_matches(x, '[{_L}]') AND regexp_matches(x, '[0-9]')
""")
def digit_lookalikes(spark, sf_dir):
    mapped = texts(spark, sf_dir, "documents").select("doc_id", T.tokens(T.map_confusables(F.col("text"))).alias("z"))
    each = mapped.select("doc_id", F.posexplode("z").alias("pos", "token")).where(F.col("token").rlike(f"[{_L}]") & F.col("token").rlike("[0-9]"))
    return each.withColumn("corrected", T.correct_token(F.col("token")))


@query(f"""
SELECT CASE WHEN x = lower(x) THEN 'lower' WHEN x = upper(x) THEN 'upper' WHEN substr(x, 1, 1) = upper(substr(x, 1, 1)) AND substr(x, 2) = lower(substr(x, 2)) THEN 'title' ELSE 'mixed' END AS case_class, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(text, '{_TOKEN}')) AS x FROM documents) GROUP BY 1
""")
def case_restore_histogram(spark, sf_dir):
    x = F.col("x")
    head, rest = F.substring(x, 1, 1), F.substring(x, 2, 1 << 30)
    kind = F.when(x == F.lower(x), "lower").when(x == F.upper(x), "upper").when((head == F.upper(head)) & (rest == F.lower(rest)), "title").otherwise("mixed")
    return texts(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("x")).groupBy(kind.alias("case_class")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT item_id, list_reduce(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''),
  lambda a, w: a || CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(w) > 30 THEN chr(10) ELSE ' ' END || w) AS wrapped FROM benchmark
""")
def wrap_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.wrap(F.col("text"), 30), "\n").alias("wrapped"))


# ---------------------------------------------------------------- evaluation

_COMPARABLE = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
#: SQL's edit distance counts bytes: the non-ASCII letters of the tables become single bytes first.
_BYTES = "translate({}, 'ßäçèéêíñóöüàâîôûëïùúáœ', chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8) || chr(14) || chr(15) || chr(16) || chr(17) || chr(18) || chr(19) || chr(20) || chr(21) || chr(22) || chr(23) || chr(24) || chr(25) || chr(26) || chr(27))"


def _expected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The benchmark as (place, item_id, expected), places from 0 in the order of item_id, and its number of items."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("expected"))
    return corpus.numbered(items, ["item_id"], "place"), max(1, items.count())


#: The benchmark's items with their places from 0 in the order of item_id.
_PLACES = "(SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS items FROM benchmark)"


@query(f"""
WITH p AS (SELECT d.doc_id, b.item_id, {_COMPARABLE.format('b.text')} AS e, {_COMPARABLE.format('d.text')} AS a FROM documents d JOIN {_PLACES} b ON d.doc_id % (SELECT greatest(1, count(*)) FROM benchmark) = b.place)
SELECT doc_id, item_id, CAST(levenshtein({_BYTES.format('e')}, {_BYTES.format('a')}) AS INTEGER) AS distance, round(levenshtein({_BYTES.format('e')}, {_BYTES.format('a')}) / greatest(1, length(e)), 6) AS cer FROM p
""")
def cer_pairs(spark, sf_dir):
    items, n = _expected(spark, sf_dir)
    docs = texts(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("actual"), (F.col("doc_id") % n).alias("place"))
    both = docs.join(items, "place")
    distance = F.levenshtein(T.comparable(F.col("expected")), T.comparable(F.col("actual")))
    return both.select("doc_id", "item_id", distance.alias("distance"), micro(T.cer(F.col("expected"), F.col("actual"))).alias("cer"))


@query(f"""
WITH p AS (SELECT {_COMPARABLE.format('b.text')} AS e, {_COMPARABLE.format('c.text')} AS a, length(c.text) > 50 AS certain FROM conversations c JOIN {_PLACES} b ON c.conv_id % (SELECT greatest(1, count(*)) FROM benchmark) = b.place)
SELECT count(*) AS pages, count(*) FILTER (WHERE e = a) AS exact_pages, round(sum(levenshtein({_BYTES.format('e')}, {_BYTES.format('a')}) / greatest(1, length(e))) / greatest(1, count(*)), 6) AS mean_cer, count(*) FILTER (WHERE certain) AS certain_pages FROM p
""")
def exact_match_rate(spark, sf_dir):
    items, n = _expected(spark, sf_dir)
    talks = table(spark, sf_dir, "conversations").select((F.col("conv_id") % n).alias("place"), "text", (F.char_length("text") > 50).alias("certain"))
    both = talks.join(items, "place")
    e = T.comparable(F.col("expected"))
    rows = both.withColumns({"cer": T.cer(F.col("expected"), F.col("text")), "exact": e == T.comparable(F.col("text"))})
    return evaluate.chapter_report(rows).withColumn("mean_cer", micro(F.col("mean_cer")))


@query("""
SELECT d.source AS engine, count(*) AS pages, round(avg(CASE WHEN coalesce(l.toxic, 0) = 0 THEN 1.0 - l.quality END), 6) AS mean_cer, round(sum(d.n_chars / 1000.0) / greatest(count(*), 1), 6) AS mean_latency_sec
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1
""")
def engine_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("engine"), (F.col("n_chars") / 1000.0).alias("latency_sec"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumns({"cer": 1.0 - F.col("quality"), "error": F.when(F.col("toxic") == 1, "toxic")})
    out = evaluate.engine_report(rows)
    return out.select("engine", "pages", micro(F.col("mean_cer")).alias("mean_cer"), micro(F.col("mean_latency_sec")).alias("mean_latency_sec"))


# ---------------------------------------------------------------- decoding and votes


def _steps(df: DataFrame) -> DataFrame:
    return df.withColumn("steps", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8)))


def _ctc_sql(mask: str) -> str:
    return f"""
WITH s AS (SELECT vec_id, t, list_transform(embedding[t * 8 + 1 : t * 8 + 8], lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings, range(8) r(t)),
m AS (SELECT vec_id, t, {mask} AS p FROM s), k AS (SELECT vec_id, t, list_max(p) AS top, list_position(p, list_max(p)) - 1 AS c FROM m),
l AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY t) AS pc FROM k)
SELECT vec_id, coalesce(string_agg(substr('abcdefg', CAST(c AS BIGINT), 1), '' ORDER BY t) FILTER (WHERE c <> 0 AND c IS DISTINCT FROM pc), '') AS raw_text,
  round(coalesce(avg(top) FILTER (WHERE c <> 0 AND c IS DISTINCT FROM pc), 0), 6) AS confidence FROM l GROUP BY vec_id
"""


@query(_ctc_sql("q"))
def ctc_decode(spark, sf_dir):
    out = ctc.decode(_steps(table(spark, sf_dir, "embeddings")), "steps", "abcdefg")
    return out.select("vec_id", "raw_text", micro(F.col("confidence")).alias("confidence"))


@query(_ctc_sql("list_transform(range(1, 9), lambda i: CASE WHEN i IN (3, 8) THEN 0.0 ELSE q[i] END)"))
def ctc_decode_masked(spark, sf_dir):
    out = ctc.decode(_steps(table(spark, sf_dir, "embeddings")), "steps", "abcdefg", set("acdef"))
    return out.select("vec_id", "raw_text", micro(F.col("confidence")).alias("confidence"))


@query("SELECT DISTINCT ch FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' AND ch NOT IN (SELECT unnest(string_split(text, '')) FROM benchmark)")
def dictionary_coverage(spark, sf_dir):
    chars = lambda n: table(spark, sf_dir, n).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return ctc.uncovered(chars("benchmark"), chars("documents"))


def _readings(df: DataFrame, *more: Column) -> DataFrame:
    return df.select("l_orderkey", F.col("l_returnflag").alias("key"), (F.col("l_quantity") / 50.0).alias("confidence"), F.col("l_linenumber").alias("seq"), (F.col("l_linenumber") > 3).alias("extended"), *more)


def _vote_sql(where: str = "true") -> str:
    return f"""
SELECT l_orderkey, k AS text, least(0.7 * m + 0.3 * n / total, 0.999) AS confidence, 0.7 * m + 0.3 * n / total >= 0.8999 AND n >= 2 AS certain, n, CAST(total AS BIGINT) AS total FROM (
  SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, x DESC, f, k) AS rn
  FROM (SELECT l_orderkey, l_returnflag AS k, count(*) AS n, avg(l_quantity / 50.0) AS m, max(l_quantity / 50.0) AS x, min(l_linenumber) AS f FROM lineitem WHERE {where} GROUP BY ALL)) WHERE rn = 1
"""


@query(f"SELECT l_orderkey, text, round(confidence, 6) AS confidence, certain, n, total FROM ({_vote_sql()})")
def vote_consensus(spark, sf_dir):
    out = vote.consensus(_readings(table(spark, sf_dir, "lineitem")), "l_orderkey", target=0.8999)
    return out.withColumn("confidence", micro(F.col("confidence")))


@query("""
WITH e AS (SELECT l_orderkey, l_returnflag AS k, l_quantity / 50.0 AS c, l_linenumber AS f, p, p + CASE WHEN l_linenumber > 3 THEN 0 ELSE 1 END AS w FROM lineitem, range(4) r(p)),
g AS (SELECT l_orderkey, p, k, sum(w) AS n, sum(w * c) / sum(w) AS m, max(c) AS x, min(f) AS f FROM e WHERE w > 0 GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey, p) AS total, row_number() OVER (PARTITION BY l_orderkey, p ORDER BY n DESC, x DESC, f, k) AS rn FROM g),
s AS (SELECT l_orderkey, p, k, 0.7 * m + 0.3 * n / total AS score, 0.7 * m + 0.3 * n / total >= 0.8999 AND n >= 2 AS certain FROM r WHERE rn = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN certain THEN p ELSE 8 - p END) AS place FROM s)
SELECT l_orderkey, k AS text, round(least(score, 0.999), 6) AS confidence, certain, CAST(CASE WHEN certain THEN p + 1 ELSE 4 END AS INTEGER) AS passes FROM o WHERE place = 1
""")
def vote_bounded_passes(spark, sf_dir):
    out = vote.bounded(_readings(table(spark, sf_dir, "lineitem")), "l_orderkey", target=0.8999)
    return out.withColumn("confidence", micro(F.col("confidence")))


@query(f"""
WITH p AS ({_vote_sql('l_linenumber % 2 = 1')}), s AS ({_vote_sql('l_linenumber % 2 = 0')})
SELECT l_orderkey, text, round(confidence, 6) AS confidence, certain, total AS passes, 'ppocrv3' AS engine, true AS engines_agree FROM p WHERE certain AND confidence >= 0.8999
UNION ALL
SELECT p.l_orderkey, CASE WHEN p.text = s.text OR p.confidence >= s.confidence THEN p.text ELSE s.text END,
  round(CASE WHEN p.text = s.text THEN least(0.999, 0.5 * (p.confidence + s.confidence) + 0.12) ELSE greatest(p.confidence, s.confidence) * 0.85 END, 6),
  p.text = s.text AND least(0.999, 0.5 * (p.confidence + s.confidence) + 0.12) >= 0.8999, greatest(p.total, s.total), 'ppocrv3+ppocrv5', p.text = s.text
FROM p JOIN s ON p.l_orderkey = s.l_orderkey WHERE NOT (p.certain AND p.confidence >= 0.8999)
""")
def ensemble_verdict(spark, sf_dir):
    # confidences are added up as their rows are stored: neither seq nor any other column tells all rows apart
    lines = _readings(table(spark, sf_dir, "lineitem"), F.struct("_metadata.file_name", "_metadata.row_index").alias("row"))
    engine = lambda odd: vote.consensus(lines.where(F.col("seq") % 2 == odd), "l_orderkey", target=0.8999, order="row").withColumn("passes", F.col("total"))
    out = vote.ensemble(engine(1), engine(0), "l_orderkey", target=0.8999)
    return out.withColumn("confidence", micro(F.col("confidence")))


_SIDE = "SELECT user_id, count(*) AS n, max(value) / 200.0 AS confidence, min(value) > 2 AS certain FROM events WHERE event_id % 2 = {} GROUP BY 1"


@query(f"""
SELECT n.user_id, CASE WHEN take THEN n.n ELSE b.n END AS n, round(CASE WHEN take THEN n.confidence ELSE b.confidence END, 6) AS confidence, CASE WHEN take THEN n.certain ELSE b.certain END AS certain, CASE WHEN take THEN 'normal' ELSE 'bubble' END AS source
FROM (SELECT n.user_id, coalesce(b.user_id IS NULL OR CASE WHEN n.certain <> b.certain THEN n.certain ELSE NOT (b.confidence > n.confidence) END, true) AS take FROM ({_SIDE.format(0)}) n LEFT JOIN ({_SIDE.format(1)}) b ON n.user_id = b.user_id) t
JOIN ({_SIDE.format(0)}) n ON n.user_id = t.user_id LEFT JOIN ({_SIDE.format(1)}) b ON b.user_id = t.user_id
""")
def choose_result(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    side = lambda k: events.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.max("value") / 200.0).alias("confidence"), (F.min("value") > 2).alias("certain"))
    return vote.choose(side(0), side(1), "user_id").withColumn("confidence", micro(F.col("confidence")))


# ---------------------------------------------------------------- pages as a whole


@query("""
SELECT conv_id, round(coalesce(min(1.0 / (turn + 1)), 0), 6) AS confidence, bool_and(length(text) > 20) AS certain, CAST(max(turn) AS BIGINT) AS passes, coalesce(string_agg(text, chr(10) ORDER BY turn, role, text) FILTER (WHERE text <> ''), '') AS text
FROM conversations GROUP BY conv_id
""")
def page_rollup(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    text = layout.joined_text(turns, ["conv_id"], ["turn", "role"], "text", "\n")
    summary = turns.groupBy("conv_id").agg(*layout.page_summary(1.0 / (F.col("turn") + 1), F.char_length("text") > 20, F.col("turn")))
    return summary.join(text, "conv_id").withColumn("confidence", micro(F.col("confidence")))


@query("""
SELECT conv_id, chr(10) || '===== СТРАНИЦА ' || CAST(conv_id AS VARCHAR) || ': conv_' || CAST(conv_id AS VARCHAR) || ' =====' || chr(10) || coalesce(string_agg(text, chr(10) ORDER BY turn, role, text) FILTER (WHERE text <> ''), '') || chr(10) AS chapter
FROM conversations GROUP BY conv_id
""")
def chapter_text(spark, sf_dir):
    pages = layout.joined_text(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role"], "text", "\n")
    return pages.select("conv_id", T.page_header(F.col("conv_id"), F.concat(F.lit("conv_"), F.col("conv_id").cast("string")), F.col("text")).alias("chapter"))


# ---------------------------------------------------------------- frames

_LIVE = """
WITH RECURSIVE o AS (SELECT event_id, user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_id, rn, value AS last, event_type AS shown, true AS analyzed FROM o WHERE rn = 1
  UNION ALL SELECT o.user_id, o.event_id, o.rn, CASE WHEN abs(o.value - f.last) <= 25 THEN f.last ELSE o.value END, CASE WHEN abs(o.value - f.last) <= 25 THEN f.shown ELSE o.event_type END, NOT abs(o.value - f.last) <= 25
  FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT event_id, user_id, CAST(rn AS BIGINT) AS frame_id, analyzed, NOT analyzed AS reused, shown FROM f
"""


@query(_LIVE)
def live_dedup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    out = live.suppress_repeats(events, "user_id", ["ts", "event_id"], "value", "event_type", delta=25.0)
    return out.select("event_id", "user_id", "frame_id", "analyzed", "reused", "shown")


@query(_LIVE)
def live_dedup_stream(spark, sf_dir):
    from scriptoria.streaming import live as stream

    path = f"{sf_dir}/events.parquet"
    # as a pattern: the streaming source takes a lone file only so
    frames = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]").select("event_id", "user_id", "ts", "value", "event_type")
    out = stream.suppress_repeats(frames, "user_id", ["ts", "event_id"], "value", "event_type", delta=25.0)
    return stream.run_to_files(out).select("event_id", "user_id", "frame_id", "analyzed", "reused", "shown")


@query("""
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) - list_avg(list_transform(embedding, lambda y: CAST(y AS DOUBLE)))) AS v FROM embeddings),
s AS (SELECT vec_id, v, list_avg(list_transform(v, lambda x: abs(x))) + 1e-6 AS scale FROM c)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS place, round(v[i] / scale, 6) AS value FROM (SELECT vec_id, v, scale, unnest(range(1, len(v) + 1)) AS i FROM s)
""")
def signature_norm(spark, sf_dir):
    signed = table(spark, sf_dir, "embeddings").select("vec_id", V.signature(F.col("embedding")).alias("s"))
    return signed.select("vec_id", F.posexplode("s").alias("place", "value")).withColumn("value", micro(F.col("value")))


@query("""
SELECT a.vec_id, round(list_avg(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))), 6) AS mad
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def signature_mad_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(following, "vec_id").select("vec_id", micro(V.mean_abs_difference(F.col("v"), F.col("w"))).alias("mad"))


def _hour(ts: str = "ts") -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 3600).cast("long")


_HOUR = "CAST(floor(epoch(ts) / 3600) AS BIGINT)"


@query(f"SELECT user_id, {_HOUR} AS hour, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def latest_only(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("hour", _hour())
    return live.latest(events.select("user_id", "hour", "ts", "event_id", "value"), ["user_id", "hour"], ["ts", "event_id"]).select("user_id", "hour", "event_id", "value")


_RUNS = f"""
d AS (SELECT DISTINCT user_id, {_HOUR} AS x FROM events), i AS (SELECT user_id, x, x - row_number() OVER (PARTITION BY user_id ORDER BY x) AS isl FROM d),
s AS (SELECT user_id, min(x) AS "left", max(x) AS "right" FROM i GROUP BY user_id, isl),
r AS (SELECT user_id, row_number() OVER w AS run, "left", "right", lead("left") OVER w - "right" - 1 AS gap FROM s WINDOW w AS (PARTITION BY user_id ORDER BY "left"))
"""


@query(f'WITH {_RUNS} SELECT user_id, CAST(run AS INTEGER) AS run, "left", "right", coalesce(gap, -1) AS gap FROM r')
def ink_runs(spark, sf_dir):
    found = layout.runs(table(spark, sf_dir, "events").withColumn("x", _hour()), "user_id", "x")
    return found.withColumn("gap", F.coalesce("gap", F.lit(-1)))


@query(f"""
WITH {_RUNS}, l AS (SELECT user_id, greatest(5.0, round_even(coalesce(median(gap) FILTER (WHERE gap > 0), 1.0) * 1.7, 0)) AS lim FROM r GROUP BY 1),
c AS (SELECT r.*, coalesce(CAST(lag(gap) OVER (PARTITION BY r.user_id ORDER BY run) >= lim AS INTEGER), 0) AS cut FROM r JOIN l ON r.user_id = l.user_id),
p AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY run ROWS UNBOUNDED PRECEDING) + 1 AS piece FROM c)
SELECT user_id, CAST(piece AS BIGINT) AS piece, min("left") AS "left", max("right") AS "right" FROM p GROUP BY 1, 2
""")
def word_split(spark, sf_dir):
    return layout.word_spans(table(spark, sf_dir, "events").withColumn("x", _hour()), "user_id", "x")


# ---------------------------------------------------------------- boxes

_BOXES = "SELECT p_partkey AS id, p_partkey // 20 AS page, (p_partkey * 37) % 900 AS x0, (p_partkey * 53) % 1200 AS y0, (p_partkey * 37) % 900 + 20 + p_size * 7 AS x1, (p_partkey * 53) % 1200 + 12 + (p_partkey % 5) * 40 AS y1, (p_partkey * 7919 % 1000) / 1000.0 AS score, p_size FROM part"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_partkey div 20 AS page", "(p_partkey * 37) % 900 AS x0", "(p_partkey * 53) % 1200 AS y0", "(p_partkey * 37) % 900 + 20 + p_size * 7 AS x1",
        "(p_partkey * 53) % 1200 + 12 + (p_partkey % 5) * 40 AS y1", "(p_partkey * 7919 % 1000) / 1000D AS score", "p_size",
    )


@query(f"SELECT page, id, CAST(row_number() OVER (PARTITION BY page ORDER BY y0, x0, id) AS INTEGER) AS ord FROM ({_BOXES})")
def reading_order(spark, sf_dir):
    return layout.reading_order(boxes(spark, sf_dir), "page", "y0", "x0", "id").select("page", "id", "ord")


@query(f"""
WITH RECURSIVE b AS (SELECT page, id, (y0 + y1) / 2.0 AS cy, CAST(y1 - y0 AS DOUBLE) AS h, CAST(x0 AS DOUBLE) AS x, row_number() OVER (PARTITION BY page ORDER BY id) AS n FROM ({_BOXES})),
f AS (SELECT page, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(cy DOUBLE, h DOUBLE, n BIGINT, top DOUBLE, m STRUCT(x DOUBLE, id BIGINT)[])[]) AS r FROM b GROUP BY page
  UNION ALL SELECT page, n, CASE WHEN hit IS NULL THEN list_append(r, {{'cy': cy, 'h': h, 'n': 1, 'top': cy, 'm': [{{'x': x, 'id': id}}]}}) ELSE list_transform(range(1, len(r) + 1), lambda i: CASE WHEN i = hit
    THEN {{'cy': r[i].cy + cy, 'h': r[i].h + h, 'n': r[i].n + 1, 'top': least(r[i].top, cy), 'm': list_append(r[i].m, {{'x': x, 'id': id}})}} ELSE r[i] END) END
  FROM (SELECT b.page, b.n, f.r, b.cy, b.h, b.x, b.id, list_min(list_filter(range(1, len(f.r) + 1), lambda i: abs(b.cy - f.r[i].cy / f.r[i].n) <= greatest(b.h, f.r[i].h / f.r[i].n) * 0.6)) AS hit FROM f JOIN b ON b.page = f.page AND b.n = f.n + 1)),
l AS (SELECT page, arg_max(r, n) AS r FROM f GROUP BY page),
e AS (SELECT page, i, r[i].top AS top, unnest(r[i].m) AS m FROM (SELECT page, r, unnest(range(1, len(r) + 1)) AS i FROM l)),
d AS (SELECT page, i, top, m.x AS x, m.id AS id FROM e)
SELECT page, CAST(dense_rank() OVER (PARTITION BY page ORDER BY top, i) AS INTEGER) AS row, CAST(row_number() OVER (PARTITION BY page, i ORDER BY x, id) AS INTEGER) AS ord, id AS seq FROM d
""")
def row_grouping(spark, sf_dir):
    b = boxes(spark, sf_dir).selectExpr("page", "id", "(y0 + y1) / 2D AS cy", "y1 - y0 AS h", "x0 AS x")
    return layout.rows_of(b, "page", "cy", "h", "x", "id")


@query(f"""
WITH RECURSIVE b AS (SELECT page, id, x0, y0, x1, y1, score, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS n FROM ({_BOXES}) WHERE score >= 0.25),
f AS (SELECT page, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT, score DOUBLE)[]) AS k FROM b GROUP BY page
  UNION ALL SELECT b.page, b.n, CASE WHEN len(list_filter(f.k, lambda q: greatest(0, least(q.x1, b.x1) - greatest(q.x0, b.x0)) * greatest(0, least(q.y1, b.y1) - greatest(q.y0, b.y0))
    / CAST((q.x1 - q.x0) * (q.y1 - q.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(q.x1, b.x1) - greatest(q.x0, b.x0)) * greatest(0, least(q.y1, b.y1) - greatest(q.y0, b.y0)) AS DOUBLE) > 0.1)) > 0 THEN f.k
    ELSE list_append(f.k, {{'id': b.id, 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1, 'score': b.score}}) END FROM f JOIN b ON b.page = f.page AND b.n = f.n + 1),
l AS (SELECT page, arg_max(k, n) AS k FROM f GROUP BY page)
SELECT page, CAST(i AS INTEGER) AS ord, k[i].id AS id, k[i].score AS score FROM (SELECT page, k, unnest(range(1, len(k) + 1)) AS i FROM l)
""")
def nms(spark, sf_dir):
    return layout.suppressed(boxes(spark, sf_dir), "page", "score", "id", threshold=0.1).select("page", "ord", "id", "score")


#: Detector output: pages of 200 rows of centres and class scores, and pages of 20 rows of corners, score and class.
_OUTPUT = """SELECT p_partkey // 200 AS page, p_partkey AS seq, true AS raw, (p_partkey * 37) % 240 + 100.0 AS a, (p_partkey * 53) % 180 + 200.0 AS b, 20.0 + p_size * 2 AS c, 15.0 + (p_partkey % 5) * 12 AS d, (p_partkey * 7919 % 1000) / 1000.0 AS s0, (p_partkey * 6151 % 1000) / 1000.0 AS s1 FROM part
UNION ALL SELECT 1000000000 + p_partkey // 20, p_partkey, false, (p_partkey * 37) % 300 + 60.0, (p_partkey * 53) % 250 + 90.0, (p_partkey * 37) % 300 + 130.0 + p_size, (p_partkey * 53) % 250 + 150.0, (p_partkey * 7919 % 1000) / 1000.0, p_partkey % 2 FROM part"""


@query(f"""
WITH RECURSIVE o AS ({_OUTPUT}), n AS (SELECT *, count(*) OVER (PARTITION BY page) > 100 AS many, 800 + page % 7 * 100 AS w, 1100 + page % 3 * 90 AS h FROM o),
z AS (SELECT *, least(640.0 / w, 640.0 / h) AS scale FROM n),
g AS (SELECT *, floor((640 - greatest(1, round_even(w * scale, 0))) / 2.0) AS dx, floor((640 - greatest(1, round_even(h * scale, 0))) / 2.0) AS dy,
  CASE WHEN many THEN a - c / 2 ELSE a END AS l, CASE WHEN many THEN b - d / 2 ELSE b END AS t, CASE WHEN many THEN a + c / 2 ELSE c END AS r, CASE WHEN many THEN b + d / 2 ELSE d END AS u,
  CASE WHEN many THEN greatest(s0, s1) ELSE s0 END AS score, CASE WHEN many THEN CASE WHEN s1 > s0 THEN 1 ELSE 0 END ELSE s1 END AS cls FROM z),
k AS (SELECT page, seq, CAST(cls AS INTEGER) AS cls, score, CAST(trunc(greatest(0.0, least(w - 1, (l - dx) / scale))) AS BIGINT) AS x0, CAST(trunc(greatest(0.0, least(h - 1, (t - dy) / scale))) AS BIGINT) AS y0,
  CAST(trunc(greatest(0.0, least(w - 1, (r - dx) / scale))) AS BIGINT) AS x1, CAST(trunc(greatest(0.0, least(h - 1, (u - dy) / scale))) AS BIGINT) AS y1 FROM g),
q AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, seq) AS n FROM k WHERE score > 0.25 AND x1 > x0 AND y1 > y0),
f AS (SELECT page, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(cls INTEGER, score DOUBLE, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT)[]) AS kept FROM q GROUP BY page
  UNION ALL SELECT q.page, q.n, CASE WHEN len(list_filter(f.kept, lambda e: greatest(0, least(e.x1, q.x1) - greatest(e.x0, q.x0)) * greatest(0, least(e.y1, q.y1) - greatest(e.y0, q.y0))
    / CAST((e.x1 - e.x0) * (e.y1 - e.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) - greatest(0, least(e.x1, q.x1) - greatest(e.x0, q.x0)) * greatest(0, least(e.y1, q.y1) - greatest(e.y0, q.y0)) AS DOUBLE) > 0.45)) > 0 THEN f.kept
    ELSE list_append(f.kept, {{'cls': q.cls, 'score': q.score, 'x0': q.x0, 'y0': q.y0, 'x1': q.x1, 'y1': q.y1}}) END FROM f JOIN q ON q.page = f.page AND q.n = f.n + 1),
v AS (SELECT page, arg_max(kept, n) AS kept FROM f GROUP BY page)
SELECT page, CAST(i AS INTEGER) AS ord, kept[i].score AS score, kept[i].x0 AS x0, kept[i].y0 AS y0, kept[i].x1 AS x1, kept[i].y1 AS y1 FROM (SELECT page, kept, unnest(range(1, len(kept) + 1)) AS i FROM v) WHERE kept[i].cls = 0
""")
def detector_text_boxes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    many = part.selectExpr("p_partkey div 200 AS page", "p_partkey AS seq", "array((p_partkey * 37) % 240 + 100D, (p_partkey * 53) % 180 + 200D, 20D + p_size * 2, 15D + (p_partkey % 5) * 12, (p_partkey * 7919 % 1000) / 1000D, (p_partkey * 6151 % 1000) / 1000D) AS v")
    few = part.selectExpr("1000000000 + p_partkey div 20 AS page", "p_partkey AS seq", "array((p_partkey * 37) % 300 + 60D, (p_partkey * 53) % 250 + 90D, (p_partkey * 37) % 300 + 130D + p_size, (p_partkey * 53) % 250 + 150D, (p_partkey * 7919 % 1000) / 1000D, p_partkey % 2 + 0D) AS v")
    rows = many.unionByName(few)
    sizes = rows.select("page").distinct().selectExpr("page", "cast(800 + page % 7 * 100 AS int) AS width", "cast(1100 + page % 3 * 90 AS int) AS height")
    return detect.detections(rows, sizes, only=detect.TEXT).selectExpr("page", "ord", "score", "cast(x0 AS long) AS x0", "cast(y0 AS long) AS y0", "cast(x1 AS long) AS x1", "cast(y1 AS long) AS y1")


_LETTERBOX = "SELECT *, least(736.0 / greatest(x1 - x0, 1), 736.0 / greatest(y1 - y0, 1)) AS scale, x1 - x0 AS w, y1 - y0 AS h FROM b"


@query(f"""
WITH b AS ({_BOXES}), s AS ({_LETTERBOX}), i AS (SELECT *, CAST(greatest(1, round_even(w * scale, 0)) AS INTEGER) AS iw, CAST(greatest(1, round_even(h * scale, 0)) AS INTEGER) AS ih FROM s),
o AS (SELECT *, CAST(floor((736 - iw) / 2.0) AS INTEGER) AS dx, CAST(floor((736 - ih) / 2.0) AS INTEGER) AS dy FROM i)
SELECT id, round(scale, 6) AS scale, iw, ih, dx, dy, round(greatest(0.0, least(w - 1, (368 - dx) / scale)), 6) AS mid_x FROM o
""")
def letterbox_map(spark, sf_dir):
    b = boxes(spark, sf_dir).selectExpr("id", "cast(x1 - x0 as int) AS w", "cast(y1 - y0 as int) AS h").withColumn("l", G.letterbox(F.col("w"), F.col("h"), 736))
    mid = G.unletterbox(F.lit(368.0), F.col("l.dx"), F.col("l.scale"), F.col("w"))
    return b.select("id", micro(F.col("l.scale")).alias("scale"), F.col("l.w").alias("iw"), F.col("l.h").alias("ih"), F.col("l.dx").alias("dx"), F.col("l.dy").alias("dy"), micro(mid).alias("mid_x"))


@query(f"""
WITH c AS (SELECT id, least(1024, x0) AS x0, least(1024, y0) AS y0, least(1024, x1) AS x1, least(1024, y1) AS y1 FROM ({_BOXES}))
SELECT id, CASE WHEN x1 <= x0 OR y1 <= y0 THEN '' ELSE printf('%d %.6f %.6f %.6f %.6f', 0, (x0 + x1) / 2.0 / 1024, (y0 + y1) / 2.0 / 1024, (x1 - x0) / 1024.0, (y1 - y0) / 1024.0) END AS label FROM c
""")
def yolo_labels(spark, sf_dir):
    c, page = F.col, F.lit(1024)
    return boxes(spark, sf_dir).select("id", G.label_line(F.lit(0), c("x0"), c("y0"), c("x1"), c("y1"), page, page).alias("label"))


@query(f"""
SELECT id FROM (SELECT id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0) * (y1 - y0) * (0.5 + p_size / 100.0) AS area FROM ({_BOXES}))
WHERE area >= 15000 AND w >= 100 AND h >= 60 AND x > 10 AND y > 10 AND x + w < 1190 AND y + h < 1390 AND w / CAST(greatest(h, 1) AS DOUBLE) BETWEEN 1.15 AND 5.5 AND area / greatest(1.0, w * h) >= 0.60
""")
def bubble_filter(spark, sf_dir):
    b = boxes(spark, sf_dir).selectExpr("id", "x0 AS x", "y0 AS y", "x1 - x0 AS w", "y1 - y0 AS h", "(x1 - x0) * (y1 - y0) * (0.5D + p_size / 100D) AS area")
    c = F.col
    return b.where(G.is_bubble(c("x"), c("y"), c("w"), c("h"), c("area"), F.lit(1200), F.lit(1400))).select("id")


@query(f"""
WITH t AS (SELECT id, page % 10 AS page, x0 AS x, y0 AS y FROM ({_BOXES})), b AS (SELECT s_suppkey AS bubble_id, s_suppkey % 10 AS page, (s_suppkey * 91) % 800 AS x0, (s_suppkey * 67) % 1000 AS y0, (s_suppkey * 91) % 800 + 150 AS x1, (s_suppkey * 67) % 1000 + 90 AS y1 FROM supplier)
SELECT t.id, b.bubble_id FROM t JOIN b ON t.page = b.page AND t.x >= b.x0 AND t.x < b.x1 AND t.y >= b.y0 AND t.y < b.y1
""")
def text_in_bubbles(spark, sf_dir):
    text = boxes(spark, sf_dir).selectExpr("id", "page % 10 AS page", "x0 AS x", "y0 AS y")
    bubbles = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS bubble_id", "s_suppkey % 10 AS page", "(s_suppkey * 91) % 800 AS x0", "(s_suppkey * 67) % 1000 AS y0", "(s_suppkey * 91) % 800 + 150 AS x1", "(s_suppkey * 67) % 1000 + 90 AS y1")
    return layout.inside(text, bubbles, "page").select("id", "bubble_id")


# ---------------------------------------------------------------- spelling

_A = LATIN.letters


@query(f"""
WITH w AS (SELECT DISTINCT x AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS x FROM benchmark)),
r AS (SELECT word, unnest(range(0, CAST(length(word) AS BIGINT) + 1)) AS i FROM w),
e AS (
  SELECT word, substr(word, 1, i - 1) || substr(word, i + 1) AS c FROM r WHERE i >= 1
  UNION SELECT word, substr(word, 1, i) || a || substr(word, i + 1) FROM r, (SELECT unnest(string_split('{_A}', '')) AS a)
  UNION SELECT word, substr(word, 1, i - 1) || a || substr(word, i + 1) FROM r, (SELECT unnest(string_split('{_A}', '')) AS a) WHERE i >= 1 AND a <> substr(word, i, 1)
  UNION SELECT word, substr(word, 1, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2) FROM r WHERE i >= 1 AND i < length(word) AND substr(word, i, 1) <> substr(word, i + 1, 1))
SELECT word, CAST(count(*) AS INTEGER) AS n, md5(string_agg(c, ',' ORDER BY c)) AS digest FROM e WHERE c <> '' GROUP BY word
""")
def edits_one(spark, sf_dir):
    tokens = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).distinct()
    made = tokens.withColumn("e", spell.edits(F.col("word"), LATIN))
    return made.select("word", F.size("e").alias("n"), F.md5(F.array_join(F.array_sort("e"), ",").cast("binary")).alias("digest"))


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark texts by their frequency."""
    tokens = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word"))
    n = F.count(F.lit(1))
    return tokens.groupBy("word").agg(F.least(F.lit(1.0), n / 8.0).alias("morph"), F.lit(0.0).alias("zipf"), (n * 50.0).alias("ipm"))


_LEX = "l AS (SELECT x AS word, least(1.0, count(*) / 8.0) AS morph, least(1.0, ln(1 + count(*) * 50.0) / 9.0) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS x FROM benchmark) GROUP BY 1)"


@query(f"""
WITH {_LEX}, w AS (SELECT DISTINCT substr(word, 2) AS word FROM l),
b AS (SELECT w.word, coalesce(l.morph, 0) AS base FROM w LEFT JOIN l ON w.word = l.word), s AS (SELECT * FROM b WHERE base < 0.2),
a AS (SELECT unnest(string_split('{_A}', '')) AS a, unnest(range(0, 26)) AS ai), r AS (SELECT word, base, unnest(range(0, CAST(length(word) AS BIGINT) + 1)) AS i FROM s),
e AS (
  SELECT word, base, 10000000 + i AS o, substr(word, 1, i - 1) || substr(word, i + 1) AS c FROM r WHERE i >= 1
  UNION ALL SELECT word, base, 20000000 + i * 26 + ai, substr(word, 1, i) || a || substr(word, i + 1) FROM r, a
  UNION ALL SELECT word, base, 40000000 + i * 26 + ai, substr(word, 1, i - 1) || a || substr(word, i + 1) FROM r, a WHERE i >= 1 AND a <> substr(word, i, 1)
  UNION ALL SELECT word, base, 60000000 + i, substr(word, 1, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2) FROM r WHERE i >= 1 AND i < length(word) AND substr(word, i, 1) <> substr(word, i + 1, 1)),
k AS (SELECT e.word, e.base, e.o, e.c, 0.62 * l.morph + 0.38 * l.freq - 0.015 * abs(length(e.c) - length(e.word)) AS rank FROM e JOIN l ON e.c = l.word WHERE l.morph > 0),
t AS (SELECT word, base, c, rank, row_number() OVER (PARTITION BY word ORDER BY rank DESC, o) AS rn FROM k)
SELECT b.word, coalesce(t.c, b.word) AS corrected FROM b LEFT JOIN t ON b.word = t.word AND t.rn = 1 AND t.rank >= greatest(0.35, t.base + 0.15)
""")
def spell_correct(spark, sf_dir):
    lexicon = _lexicon(spark, sf_dir)
    words = lexicon.select(F.substring("word", 2, 1 << 30).alias("word"))
    return spell.best_edits(words, lexicon, LATIN)


_ONE = ", ".join(f"'{c}'" for c in spell.ONE_LETTER)
_SHORT = ", ".join(f"'{c}'" for c in spell.SHORT_WORDS)


@query(f"""
WITH RECURSIVE {_LEX}, t AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS t FROM benchmark),
w AS (SELECT DISTINCT t[i] || t[i + 1] AS word FROM (SELECT t, unnest(range(1, len(t))) AS i FROM t)),
long AS (SELECT w.word FROM w LEFT JOIN l ON w.word = l.word WHERE length(w.word) >= 9 AND NOT coalesce(l.morph >= 0.2 AND l.freq >= 0.16, false)),
i AS (SELECT word, unnest(range(1, CAST(length(word) AS BIGINT) + 1)) AS i FROM long),
p AS (SELECT word, substr(word, i, k) AS piece FROM (SELECT word, i, unnest(range(1, least(20, CAST(length(word) AS BIGINT) - i + 1) + 1)) AS k FROM i) UNION SELECT word, word FROM long),
sc AS (SELECT p.word, map_from_entries(list((p.piece, 0.55 * least(1.0, l.morph / 0.5) + 0.45 * l.freq))) AS m FROM p JOIN l ON p.piece = l.word
  WHERE length(p.piece) > 1 AND (length(p.piece) >= 4 OR (p.piece IN ({_SHORT}) AND l.freq >= 0.5)) AND (l.morph > 0 OR l.freq >= 0.5) GROUP BY p.word),
paths AS (
  SELECT long.word, coalesce(sc.m, map([]::VARCHAR[], []::DOUBLE[])) AS m, CAST(0 AS BIGINT) AS k, [CAST(0 AS DOUBLE)] AS total, [''] AS pieces FROM long LEFT JOIN sc ON long.word = sc.word
  UNION ALL
  SELECT word, m, k + 1, list_append(total, best.t), list_append(pieces, best.p) FROM (
    SELECT word, m, k, total, pieces, list_sort(list_filter(list_transform(range(greatest(0, k - 19), k + 1), lambda s: {{
      't': total[s + 1] + coalesce(CASE WHEN s = k AND substr(word, s + 1, 1) IN ({_ONE}) THEN 0.10 END, m[substr(word, s + 1, k + 1 - s)]) - CASE WHEN s = 0 THEN 0.0 WHEN s = k THEN 1.35 ELSE 0.95 END,
      'b': -s, 'p': pieces[s + 1] || CASE WHEN s = 0 THEN '' ELSE ' ' END || substr(word, s + 1, k + 1 - s)}}), lambda x: x.t IS NOT NULL), 'DESC')[1] AS best
    FROM paths WHERE k < length(word)))
SELECT w.word, CASE WHEN q.total[-1] >= coalesce(q.m[w.word], -1) + 0.25 THEN q.pieces[-1] ELSE w.word END AS pieces FROM w LEFT JOIN (SELECT * FROM paths WHERE k = length(word)) q ON w.word = q.word
""")
def segment_fused(spark, sf_dir):
    lexicon = _lexicon(spark, sf_dir)
    words = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1).alias("t"))
    pairs = words.select(F.explode(F.zip_with("t", F.slice("t", 2, 1 << 20), lambda a, b: F.concat(a, b))).alias("word")).where("word is not null").distinct()
    return spell.segmented(pairs, lexicon)


@query()
def normalize_dictionary(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return spell.normalize_with(docs, "text", _lexicon(spark, sf_dir), profile=LATIN).select("conv_id", "turn", "role", "normalized")


# ---------------------------------------------------------------- corpora

_LINES = "SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, trim(regexp_replace(s[i], '\\s+', ' ', 'g')) AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
_SENTENCES = f"SELECT doc_id, line, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, line) AS rn FROM ({_LINES}) WHERE length(text) >= 12 AND regexp_matches(text, '[A-Za-z]')) WHERE rn = 1"


def _sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


@query(_SENTENCES)
def corpus_extract(spark, sf_dir):
    return corpus.sentences(_sentence_rows(spark, sf_dir), "text", ["doc_id", "line"], profile=LATIN)


@query(f"SELECT * FROM ({_SENTENCES}) ORDER BY doc_id, line LIMIT 1000")
def corpus_extract_first(spark, sf_dir):
    return corpus.sentences(_sentence_rows(spark, sf_dir), "text", ["doc_id", "line"], profile=LATIN, limit=1000)


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, printf('page_%06d', doc_id) AS name FROM documents")
def split_assign(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", G.split_of(F.col("doc_id")).alias("split"), F.format_string("page_%06d", F.col("doc_id")).alias("name"))


@query("""
WITH k AS (SELECT page_id, url, array_to_string(list_transform(regexp_extract_all(lower(url), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(ltrim(p, '0'), 20, '0') ELSE p END), '') AS k FROM pages)
SELECT page_id, url, row_number() OVER (ORDER BY k, page_id) - 1 AS place FROM k
""")
def natural_sort(spark, sf_dir):
    keyed = table(spark, sf_dir, "pages").select("page_id", "url", T.natural_key(F.col("url")).alias("k"))
    return corpus.numbered(keyed, ["k", "page_id"], "place").select("page_id", "url", "place")


@query(f"""
WITH b AS (SELECT page, id, least(1024, x0) AS x0, least(1024, y0) AS y0, least(1024, x1) AS x1, least(1024, y1) AS y1 FROM ({_BOXES}))
SELECT page AS index, printf('images/%s/page_%06d.jpg', CASE WHEN page % 5 = 0 THEN 'val' ELSE 'train' END, page) AS image, string_agg('part ' || CAST(id AS VARCHAR), chr(10) ORDER BY id) AS transcript,
  string_agg(printf('%d %.6f %.6f %.6f %.6f', 0, (x0 + x1) / 2.0 / 1024, (y0 + y1) / 2.0 / 1024, (x1 - x0) / 1024.0, (y1 - y0) / 1024.0), chr(10) ORDER BY id) AS labels
FROM b WHERE x1 > x0 AND y1 > y0 GROUP BY 1, 2
""")
def dataset_manifest(spark, sf_dir):
    line = F.struct("id", F.concat(F.lit("part "), F.col("id").cast("string")).alias("text"), "x0", "y0", "x1", "y1")
    samples = boxes(spark, sf_dir).groupBy(F.col("page").alias("index")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    none = F.filter("lines", lambda _: F.lit(False))
    out = corpus.dataset(samples.withColumns({"w": F.lit(1024), "h": F.lit(1024), "layout": F.lit("scene_text"), "bubbles": none}))
    return out.where(F.size("labels") > 0).select("index", "image", "transcript", F.array_join("labels", "\n").alias("labels"))


@query("""
SELECT p.page, CAST(i.i AS INTEGER) AS panel, n.n_name AS phrase FROM (SELECT DISTINCT CAST(p_partkey // 20 AS INTEGER) AS page FROM part) p, range(3) i(i) JOIN nation n ON n.n_nationkey = (p.page * 3 + i.i) % 25
""")
def phrase_pick(spark, sf_dir):
    pages = boxes(spark, sf_dir).select(F.col("page").cast("int").alias("page")).distinct().withColumn("panel", F.explode(F.sequence(F.lit(0), F.lit(2))))
    phrases = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("phrase"))
    return pages.join(phrases, corpus.phrase_index(F.col("page"), F.col("panel"), 25) == F.col("n_nationkey")).select("page", "panel", "phrase")


@query(f"""
WITH b AS (SELECT page, count(*) FILTER (WHERE least(1024, x1) > least(1024, x0) AND least(1024, y1) > least(1024, y0)) AS n FROM ({_BOXES}) GROUP BY page)
SELECT CASE WHEN page % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS pages, CAST(sum(n) AS BIGINT) AS line_crops FROM b GROUP BY 1
""")
def split_counts(spark, sf_dir):
    line = F.struct("id", F.col("id").cast("string").alias("text"), "x0", "y0", "x1", "y1")
    samples = boxes(spark, sf_dir).groupBy(F.col("page").alias("index")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    none = F.filter("lines", lambda _: F.lit(False))
    return corpus.split_counts(corpus.dataset(samples.withColumns({"w": F.lit(1024), "h": F.lit(1024), "layout": F.lit("scene_text"), "bubbles": none})))
