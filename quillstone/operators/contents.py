"""Tables of contents: their entries, where their headings stand in the body, and the split that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars
from . import hybrid
from .segments import before, block, doc
from .rows import refined
from .tiers import auto_split, first_tier, protected, reading_events

#: Paragraphs in which a table of contents is looked for, and behind a place those in which a heading is.
SCANNED, REACH = 100, 300


def listed(paras: DataFrame) -> DataFrame:
    """doc_id, toc_end and an entry (para, role, name; null where a table has none), a row for each entry of a table of contents.

    A table begins at its title; it ends at an empty paragraph or, once it has an entry, at a short one that names no section.
    """
    t, name, role, kind = F.col("text"), F.col("name"), F.col("role"), F.col("kind")
    first = lambda when: F.min(F.when(when, F.col("para"))).over(doc())
    later = F.col("para") > F.col("title")
    # a title and the empty paragraph behind it bound what the patterns of names and roles are tried on
    head = paras.filter(F.col("para") <= SCANNED).select("doc_id", "para", "text").withColumn("title", first(t.isin(P.TOC_TITLES))).filter(F.col("para") >= F.col("title"))
    head = head.withColumn("blank", first((t == "") & later)).filter(F.col("blank").isNull() | (F.col("para") <= F.col("blank")))
    dotted = t.rlike(P.DOTTED)
    is_entry = role.isNotNull() & F.when(dotted, F.length(name) >= 2).otherwise(F.length(t) < 60)
    sort = F.when(t == "", "empty").when(t.isin(P.TOC_TITLES), "title").when(is_entry, "entry").when(~dotted & (F.length(t) < 60), "other")
    # no filter on these columns before the windows: below the columns it would bring all patterns with it once more
    rows = head.withColumn("name", scalars.clean_toc_name(t)).withColumn("role", scalars.toc_role(name)).withColumn("kind", sort)
    # a second title is a paragraph like any other; no title names a section
    other = kind.isin("other", "title") & later
    rows = rows.withColumn("since", first((kind == "entry") & later))
    rows = rows.withColumn("stop", F.least("blank", first(other & (F.col("para") > F.col("since")))))
    own = (kind == "entry") & (F.col("stop").isNull() | (F.col("para") < F.col("stop")))
    rows = rows.withColumn("end", F.coalesce("stop", F.coalesce(F.max(F.when(own, F.col("para"))).over(doc()), F.lit(SCANNED)) + 1).cast("int"))
    return rows.filter(own | (kind == "title") & (F.col("para") == F.col("title"))).select("doc_id", F.col("end").alias("toc_end"), F.when(own, F.struct("para", "role", "name")).alias("entry"))


def entries(paras: DataFrame) -> DataFrame:
    """doc_id, toc_end and entries (para, role, name) in their order, a row for each document with a table of contents."""
    return listed(paras).groupBy("doc_id").agg(F.first("toc_end").alias("toc_end"), F.array_sort(F.collect_list("entry")).alias("entries"))


def headings(paras: DataFrame) -> DataFrame:
    """doc_id and entries (para, role, name) from headings of the body, each name once."""
    t = F.col("text")
    strip = lambda c, *patterns: strip(F.regexp_replace(c, patterns[0], ""), *patterns[1:]) if patterns else c
    bare = F.col("bare")
    name = F.trim(F.regexp_replace(F.when(bare != "", bare).otherwise(t), P.PARENTHESES, ""))
    f = paras.repartition("doc_id").withColumn("bare", strip(t, P.NAV_DECOR, P.NAV_BRACKETS, P.NAV_ORDINAL)).filter(t.rlike(P.NAV_HEADER) | bare.rlike(P.NAV_HEADER)).select("doc_id", "para", name.alias("name"), F.coalesce(scalars.toc_role(t), scalars.toc_role(name)).alias("role"))
    once = f.filter(F.length("name") >= 3).groupBy("doc_id", "name").agg(F.min(F.struct("para", "role")).alias("x")).filter("x.role IS NOT NULL")
    return once.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("x.para", "x.role", "name"))).alias("entries"))


def practices(entries: Column) -> Column:
    return F.filter(entries, lambda e: e["role"] != "knowledge")


def letters(text: Column) -> Column:
    return F.regexp_replace(text, P.NO_WORD, "")


def surveyed(listed: DataFrame, paras: DataFrame) -> DataFrame:
    """doc_id, first, last, events (of reading) and places, a row for each document, from one pass over the paragraphs.

    places (para, role) are those in the body of the practice entries of ``listed`` (doc_id, toc_end, entries); empty for none.
    Entries are looked for in order, each behind the last one that was found: a paragraph that is its name, else one that
    begins with it, has it, or has it when only letters and digits count. A paragraph meets the names of its own document,
    which are SCANNED at most, as no table of contents goes on behind that.
    """
    each = F.filter(F.transform(practices(F.col("entries")), lambda e, i: F.struct(i.alias("nth"), e["role"].alias("role"), e["name"].alias("name"), letters(e["name"]).alias("plain"))), lambda e: F.length(e["name"]) >= 2)
    # few rows are hashed, so that the many texts needn't be sorted for the join
    names = listed.select("doc_id", "toc_end", each.alias("names")).filter("size(names) > 0").hint("shuffle_hash")
    t = F.col("text")

    def level(e: Column, own: Column) -> Column:
        name, plain = e["name"], e["plain"]
        return F.when(t == name, 1).when(t.startswith(name), 2).when(t.contains(name), 3).when((F.length(plain) >= 3) & own.contains(plain), 4)

    def met(own: Column) -> Column:
        of = F.transform("names", lambda e: F.struct(e["nth"].alias("nth"), e["role"].alias("role"), level(e, own).alias("level"), F.col("para").alias("para")))
        return F.filter(of, lambda x: x["level"].isNotNull())

    # in a lambda, so that a paragraph's letters are taken once and not for each name
    hits = F.when(F.col("para") >= F.col("toc_end"), F.flatten(F.transform(F.array(letters(t)), met)))
    body = paras.select("doc_id", "para", "text").join(names, "doc_id", "left").withColumn("hits", hits)
    d = body.groupBy("doc_id").agg(F.min("para").alias("first"), F.max("para").alias("last"), reading_events().alias("events"), F.first("toc_end", ignorenulls=True).alias("toc_end"), F.flatten(F.collect_list("hits")).alias("hits"))
    # hits are in the order of entries, then of levels, then of paragraphs: the first of an entry that is within reach is its place
    start = F.struct(F.col("toc_end").alias("since"), F.lit(-1).alias("done"), F.array().cast("array<struct<para:int,role:string>>").alias("out"))
    ordered = F.array_sort(F.transform("hits", lambda x: F.struct(x["nth"].alias("nth"), x["level"].alias("level"), x["para"].alias("para"), x["role"].alias("role"))))

    def step(acc, x):
        takes = (x["nth"] > acc["done"]) & x["para"].between(acc["since"], acc["since"] + REACH)
        out = F.array_append(acc["out"], F.struct(x["para"].alias("para"), x["role"].alias("role")))
        return F.when(takes, F.struct((x["para"] + 1).alias("since"), x["nth"].alias("done"), out.alias("out"))).otherwise(acc)

    return d.select("doc_id", "first", "last", "events", F.aggregate(ordered, start, step, lambda acc: acc["out"]).alias("places"))


def split(paras: DataFrame, consolidation: str = P.MARKER_CONSOLIDATION) -> DataFrame:
    """doc_id, ord, marker, start_para, end_para for documents whose contents, or else headings, name their practice.

    Where basic practice is named and advanced practice behind it, they are the second and third block; else all practice
    is one block, which nothing cuts.
    """
    listed = entries(paras).filter("size(entries) >= 2")
    # no heading is looked for in documents whose contents tell
    named = headings(paras.join(listed.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti"))
    direct = named.select("doc_id", F.transform(practices(F.col("entries")), lambda e: F.struct(e["para"].alias("para"), e["role"].alias("role"))).alias("direct"))
    d = surveyed(listed, paras).join(direct, "doc_id", "left").withColumn("places", F.coalesce("direct", "places")).filter("size(places) > 0")
    at = lambda role: F.array_min(F.transform(F.filter("places", lambda p: p["role"] == role), lambda p: p["para"]))
    d = d.withColumns({"lead": F.array_min("places"), "basic": at("basic_practice")})
    advanced = F.array_min(F.transform(F.filter("places", lambda p: (p["role"] == "advanced_practice") & (p["para"] > F.col("basic"))), lambda p: p["para"]))
    d = d.withColumn("advanced", advanced)
    lead, last = F.col("lead.para"), F.col("last")
    two = F.array(before(lead), block(2, P.MARKER_DRILL, F.col("basic"), F.col("advanced") - 1), block(3, consolidation, F.col("advanced"), last))
    late = F.col("lead.role") == "advanced_practice"
    one = F.array(before(lead), F.when(late, block(2, consolidation, lead, last)).otherwise(block(2, P.MARKER_DRILL, lead, last)))
    d = d.withColumn("made", F.when(F.col("advanced").isNotNull(), two).otherwise(one))
    return protected(d, F.col("first")).select("doc_id", F.explode_outer("made").alias("b")).select("doc_id", "b.*")


def smart_split(paras: DataFrame, hybrid_first: bool = False) -> DataFrame:
    """doc_id, tier, ord, marker, start_para, end_para of all tiers that need no remote model, in their order.

    hybrid, if it is asked for; toc; then those of ``tiers.auto_split``. As hybrid has blocks for every document that has
    paragraphs, no document is left to the others and they aren't worked out.
    """
    if hybrid_first:
        return hybrid.split(paras).select("doc_id", F.lit("hybrid").alias("tier"), "ord", "marker", "start_para", "end_para")
    return first_tier(split(paras).withColumn("tier", F.lit("toc")), auto_split(paras))


def smart_blocks(paras: DataFrame) -> DataFrame:
    """The blocks of smart mode without a key: of the first tier of all that says anything, with practice refined."""
    return refined(smart_split(paras), paras)
