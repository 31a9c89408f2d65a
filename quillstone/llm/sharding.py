"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. At each level a row's key draws an exponential variate for every child of the node
it has come to, from a hash of the key and the child's path, at the rate of the weight below that child; the row descends to
the child with the least draw, region first, then rack, then shard. So it falls to a shard with a chance in proportion to the
shard's weight, and draws eleven times or so, whatever the number of shards in other regions.

A change of a shard's weight alters the rates of its rack and its region alone: rows move into that region or out of it, and
inside it into the rack or out of it. Shards that come later are regions of their own: the draws of all older regions stay,
so that a new shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

SHARDS = 40
#: Shards in a rack and racks in a region.
RACK, REGION = 4, 3
ROWS_PER_BUCKET = 1_000_000
#: Equal rows that are made at once.
CHUNK = 10_000


def tree(weights: list[float], base: int, rack: int = RACK, region: int = REGION) -> dict[str, dict[str, dict[str, int]]]:
    """Shards by region, rack and shard path. The first ``base`` shards fill racks and regions; each later one is a region. Those without weight are left out."""
    out: dict[str, dict[str, dict[str, int]]] = {}
    for shard, weight in enumerate(weights):
        at = f"{shard // (rack * region)}" if shard < base else f"+{shard}"
        under = f"{at}/{shard // rack % region}" if shard < base else f"{at}/0"
        if weight > 0:
            out.setdefault(at, {}).setdefault(under, {})[f"{under}/{shard}"] = shard
    return out


def draw(key: Column, path: str, weight: float) -> Column:
    """An exponential variate of rate ``weight`` that the key and the path decide."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(path), key), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(uniform) / F.lit(float(weight))


def _least(key: Column, children: dict[str, float]) -> Column:
    """The path of the child with the least draw."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    return F.least(*(F.struct(draw(key, path, weight).alias("draw"), F.lit(path).alias("path")) for path, weight in children.items()))["path"]


def _by_node(at: Column, below: dict[str, Column]) -> Column:
    out = None
    for path, value in below.items():
        out = F.when(at == path, value) if out is None else out.when(at == path, value)
    return out


def descended(rows: DataFrame, name: str, weights: list[float], base: int, rack: int = RACK, region: int = REGION) -> DataFrame:
    """``rows`` (key) with a column ``name``: the shard to which the key descends."""
    regions = tree(weights, base, rack, region)
    racks = {p: shards for under in regions.values() for p, shards in under.items()}
    heavy = lambda shards: float(sum(weights[s] for s in shards.values()))
    key = F.col("key")
    rows = rows.withColumn("_region", _least(key, {r: sum(map(heavy, under.values())) for r, under in regions.items()}))
    rows = rows.withColumn("_rack", _by_node(F.col("_region"), {r: _least(key, {p: heavy(s) for p, s in under.items()}) for r, under in regions.items()}))
    leaf = _by_node(F.col("_rack"), {p: _least(key, {q: weights[s] for q, s in shards.items()}) for p, shards in racks.items()})
    return rows.withColumn(name, F.substring_index(leaf, "/", -1).cast("int")).drop("_region", "_rack")


def shard(docs: DataFrame, weights: list[float] | None = None, grown: float | None = 1.0, base: int | None = None, rack: int = RACK, region: int = REGION, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, a row for each row of ``docs`` (doc_id, text).

    weights: of the shards, all 1 unless given; base: how many of them the tree was laid out for, all unless given. grown:
    the weight of one more shard, for grown_shard. A null text has no bytes; rows with equal doc_id, null included, meet in
    one shard. Slots run from 0 without gaps in each shard and follow from the rows alone: equal rows are counted, the
    counts are summed in the order of a hash, bucket by bucket, and each row's places are made from its count, some at a
    time, so that rows that repeat very often are dealt over tasks too. Empty tables, empty texts and texts of any length
    are nothing special. Other columns of ``docs`` are neither read nor returned.
    """
    weights = weights or [1.0] * SHARDS
    base = base or len(weights)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("doc_id", key.alias("key"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    own = ["doc_id", "size", "text_crc32"]
    counted = rows.groupBy(*own, "key").agg(F.count("*").alias("n")).withColumn("spread", F.xxhash64(*own))
    placed = descended(counted, "shard", weights, base, rack, region)
    placed = descended(placed, "grown_shard", [*weights, grown], base, rack, region) if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    placed = written(placed.drop("key"), "placed")
    total = placed.agg(F.sum("n")).first()[0] or 0
    placed = placed.withColumn("bucket", F.pmod("spread", F.lit(8 * max(1, total // rows_per_bucket))).cast("int"))
    in_order = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    offsets = written(buckets.select("shard", "bucket", in_order(Window.partitionBy("shard").orderBy("bucket")).alias("before")), "offsets")
    slotted = placed.withColumn("within", in_order(Window.partitionBy("shard", "bucket").orderBy("spread", *own))).join(offsets, ["shard", "bucket"])
    chunks = slotted.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})"))).repartition("shard", "spread", "chunk")
    each = chunks.withColumn("i", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(n, (chunk + 1) * {CHUNK}) - 1)")))
    return each.select(*own, F.lit("key").alias("law"), "shard", (F.col("before") + F.col("within") + F.col("i")).cast("long").alias("slot"), "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
