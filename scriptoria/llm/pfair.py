"""Mixing sources to target weights by Pfair scheduling.

Time runs in slots, one block of rows a slot. A source with `a` of `period` weight units owns block j
in the window from its release floor(j*period/a) to its deadline ceil((j+1)*period/a), end exclusive.
In every slot the released block with the earliest deadline runs, ties to the source first in order.
As the units add up to the period, every block runs inside its window, so at any time a source is less
than one block from its target share. The schedule repeats with the period and depends on the weights
alone: one period is computed by a fold over its slots, and a block's slot is read off by arithmetic.
When a source runs out, its later slots stay empty and the windows of the others hold as before.

Everything is DataFrame functions. Ranks within a source are two-level (source and a prefix of the
row's digest), so a source that holds a third of all rows spreads over all tasks.

Defined cases: null sources are a source of their own; a null id counts as the empty one; rows with equal
ids are ordered by a digest of all their columns, so only rows that are equal throughout may change places,
and rows without an id are spread by it as well; no row is dropped or repeated; a source always has at least one
weight unit; an empty table gives no rows; texts are not looked at beyond the digest of rows with equal ids.
Columns are kept, whatever their names; the new columns replace any of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptoria.llm.common import fresh, row_digest

#: Weight units to which target weights are resolved.
UNITS = 1000
BLOCK_ROWS = 8
#: Columns that `mix` adds.
ADDED = ("block", "slot", "release", "deadline")


def source_key(source: Column) -> Column:
    """A non-null key: null sources differ from empty ones."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def tempered_units(counts: DataFrame, power: float = 0.5, units: int = UNITS) -> DataFrame:
    """(key, units): weights in proportion to rows**power, in units; `counts` has (key, n)."""
    w = F.pow(F.col("n").cast("double"), F.lit(power))
    total = F.sum(w).over(Window.partitionBy())  # over one row a source
    return counts.select("key", F.greatest(F.lit(1), F.floor(F.lit(units) * w / total + 0.5)).cast("long").alias("units"))


def schedule(weights: DataFrame) -> DataFrame:
    """(key, units, period, slots) of each source: slots[k] is the slot of its k-th block in a period.

    `weights` has one row a source; the fold handles them as one array, whose size is the number of sources.
    """
    one = weights.agg(F.array_sort(F.collect_list(F.struct("key", "units"))).alias("s")).withColumn("period", F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + x["units"]))
    start = F.struct(
        F.transform("s", lambda x, i: F.struct(i.alias("i"), x["units"].alias("a"), F.lit(0).cast("long").alias("j"))).alias("state"),
        F.array().cast("array<struct<slot:bigint,i:int>>").alias("out"),
    )
    period = F.col("period")

    def step(acc, t):
        released = F.filter(acc["state"], lambda x: (x["j"] < x["a"]) & (F.floor(x["j"] * period / x["a"]) <= t))
        first = F.array_min(F.transform(released, lambda x: F.struct(F.ceil((x["j"] + 1) * period / x["a"]).alias("deadline"), x["i"].alias("i"))))
        state = F.transform(acc["state"], lambda x: F.struct(x["i"].alias("i"), x["a"].alias("a"), F.when(x["i"] == first["i"], x["j"] + 1).otherwise(x["j"]).alias("j")))
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(F.struct(t.alias("slot"), first["i"].alias("i")))).alias("out"))

    ran = one.where(F.size("s") > 0).withColumn("out", F.aggregate(F.sequence(F.lit(0).cast("long"), period - 1), start, step, lambda acc: acc["out"]))
    each = ran.select(F.posexplode("s").alias("i", "x"), "period", "out")
    slots = F.transform(F.filter("out", lambda o: o["i"] == F.col("i")), lambda o: o["slot"])
    return each.select(F.col("x.key").alias("key"), F.col("x.units").alias("units"), "period", slots.alias("slots"))


def prefix_digits(rows: int) -> int:
    """Hex digits of the digest that split a source: groups of some hundreds of rows at any size."""
    digits = 1
    while rows > 2000 * 16**digits and digits < 6:
        digits += 1
    return digits


def mix(df: DataFrame, source: str = "source", key: str = "doc_id", weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, power: float = 0.5, digits: int | None = None, prefix: str = "") -> DataFrame:
    """All rows and columns, with block, slot, release and deadline of each row, under names that begin with `prefix`.

    `weights` has (key, units), the key as `source_key` makes it; by default units follow rows**power.
    Rows of a source are taken in the order of their id's digest.
    """
    digits = digits or prefix_digits(df.count())
    base = df.drop(*(prefix + c for c in ADDED))
    k, digest, part, tie, n, upto, at, units, period, slots = fresh(base, "_key", "_digest", "_part", "_tie", "_n", "_before", "_at", "_a", "_p", "_slots")
    named = F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"), 256), 1, 16)
    rows = base.withColumn(k, source_key(F.col(source))).withColumn(digest, named)
    rows = rows.withColumn(tie, row_digest(base))
    # rows without an id, which share one digest, are spread by the leading bits of their ties, by which they are ordered
    none = F.substring(F.sha2(F.lit("").cast("binary"), 256), 1, 16)
    spread = F.concat(F.lit("1"), F.lpad(F.hex(F.shiftrightunsigned(tie, 52)), 3, "0"))
    rows = rows.withColumn(part, F.concat(F.substring(digest, 1, digits), F.when(F.col(key).isNull(), spread).when(F.col(digest) < none, "0").otherwise("2")))
    counts = rows.groupBy(k, part).agg(F.count(F.lit(1)).alias(n))
    before = F.sum(n).over(Window.partitionBy(k).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    if weights is None:
        weights = tempered_units(counts.groupBy(F.col(k).alias("key")).agg(F.sum(n).alias("n")), power)
    plan = schedule(weights).select(F.col("key").alias(k), F.col("units").alias(units), F.col("period").alias(period), F.col("slots").alias(slots))
    # the plan's size is the period, which the weights fix: at most UNITS and one more for each source
    offsets = counts.select(k, part, before.alias(upto)).join(F.broadcast(plan), k)
    order = Window.partitionBy(k, part).orderBy(digest, key, F.shiftrightunsigned(tie, 52), tie)
    placed = rows.join(offsets, [k, part]).withColumn(at, F.col(upto) + F.row_number().over(order) - 1)
    block, a, p = F.floor(F.col(at) / block_rows).cast("long"), F.col(units), F.col(period)
    b = F.col(prefix + "block")
    return (
        placed.withColumn(prefix + "block", block)
        .withColumn(prefix + "slot", F.floor(b / a) * p + F.get(F.col(slots), (b % a).cast("int")))
        .withColumn(prefix + "release", F.floor(b * p / a))
        .withColumn(prefix + "deadline", F.ceil((b + 1) * p / a))
        .select(*base.columns, *(prefix + c for c in ADDED))
    )


def in_order(df: DataFrame, key: str = "doc_id", prefix: str = "") -> DataFrame:
    """Rows sorted over all partitions by slot, then id; the schedule's columns go."""
    return df.orderBy(prefix + "slot", prefix + "block", key).drop(*(prefix + c for c in ADDED))
