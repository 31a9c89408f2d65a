"""Relations of packages: ids for what is taken over from other packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def migrated(own: DataFrame, taken: DataFrame) -> DataFrame:
    """package, source, rid and new_rid: the ids in ``package`` of the relations that it takes over.

    own: package, rid, kind and target of the relations that the package has; taken: package, source, nth (in order), rid,
    kind and target, a row for each use. Equal targets of one kind share an id: the package's own, if it has one, of several
    the least in text order; else a new one. New ids are rId with the least numbers that are free, in the order of first
    use (source, nth, rid). The k-th free number is k and as many used ones as lie below it, which a running count over both in
    one order tells.
    """
    key = ["package", "kind", "target"]
    held = own.groupBy(*key).agg(F.min("rid").alias("own_rid"))
    first = taken.groupBy(*key).agg(F.min(F.struct("source", "nth", "rid")).alias("first"))
    fresh = first.join(held, key, "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("package").orderBy("first", "kind", "target")))
    number = F.regexp_extract("rid", "^rId([1-9][0-9]{0,8})$", 1).try_cast("int")
    used = own.select("package", number.alias("number")).filter("number IS NOT NULL").distinct()
    # free numbers below each used one
    below = used.withColumn("at", F.col("number") - F.row_number().over(Window.partitionBy("package").orderBy("number")))
    none = lambda c: F.lit(None).cast("string").alias(c)
    events = below.select("package", "at", F.lit(1).alias("is_used"), F.lit(None).cast("int").alias("k"), none("kind"), none("target")).unionByName(fresh.select("package", (F.col("k") - 1).alias("at"), F.lit(0).alias("is_used"), "k", "kind", "target"))
    passed = F.sum("is_used").over(Window.partitionBy("package").orderBy("at", F.desc("is_used")).rowsBetween(Window.unboundedPreceding, 0))
    new = events.withColumn("passed", passed).filter("is_used = 0").select(*key, F.concat(F.lit("rId"), (F.col("k") + F.col("passed")).cast("string")).alias("fresh_rid"))
    uses = taken.select("source", "rid", *key).distinct()
    found = uses.join(held, key, "left").join(new, key, "left")
    return found.select("package", "source", "rid", F.coalesce("own_rid", "fresh_rid").alias("new_rid"))


def rewritten(xml: Column, ids: Column) -> Column:
    """XML with the ids of its embed, id and link references changed as the map ``ids`` has it; others stay. Each reference is changed once, so that ids may trade places."""
    parts = F.split(xml, r"(?<=r:(embed|id|link)=\")")
    old = lambda part: F.substring_index(part, '"', 1)
    changed = F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.coalesce(F.element_at(ids, old(part)), old(part)), F.substring(part, F.length(old(part)) + 1, F.length(part)))))
    return F.array_join(changed, "")
