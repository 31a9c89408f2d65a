"""The tiers that split a document, from the surest sign to none: type markers, separators, the scored boundary, proportions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars
from .segments import before, block, boundaries, cut_at, doc, ordered, share


def followed(paras: DataFrame) -> DataFrame:
    """``paras`` with the two paragraphs behind each (a struct of para and text)."""
    row = F.struct("para", "text")
    return paras.withColumns({"next1": F.lead(row, 1).over(ordered()), "next2": F.lead(row, 2).over(ordered())})


def separated() -> Column:
    """Behind a separator: at, where the part that it opens begins, and whether English prose runs across it."""
    t, n = F.col("text"), F.col("next1")
    opens = F.regexp_replace(t, "/+$", "").rlike(P.SEPARATOR) & (n["para"] == F.col("para") + 1) & (n["text"].rlike(P.SECTION_HEADER) | n["text"].rlike(P.PART_HEADER))
    prose = t.rlike(P.ENGLISH) & (F.col("next2.para") == F.col("para") + 2) & F.col("next2.text").rlike(P.ENGLISH)
    return F.when(opens, F.struct(n["para"].alias("at"), F.coalesce(prose, F.lit(False)).alias("prose")))


def reading_events(begins: Column | None = None, ends: Column | None = None) -> Column:
    """Paragraphs that begin a reading passage or end one, in order; where it is known which do, by those columns."""
    begins, ends = F.col("text").rlike(P.READING) if begins is None else begins, F.col("text").rlike(P.READING_ENDS) if ends is None else ends
    return F.array_sort(F.collect_list(F.when(begins | ends, F.struct("para", begins.alias("begins")))))


def spans(events: Column, since: Column, last: Column) -> Column:
    """Reading passages from ``since`` on: each to before the next event, the last one to the end."""
    e = F.filter(events, lambda x: x["para"] >= since)
    each = F.transform(e, lambda x, i: F.struct(x["para"].alias("start_para"), F.coalesce(F.get(e, i + 1)["para"] - 1, last).alias("end_para"), x["begins"].alias("begins")))
    return F.filter(each, lambda x: x["begins"])


def protected(d: DataFrame, since: Column) -> DataFrame:
    """``d`` with the blocks in ``made`` cut nowhere inside a reading passage: drill goes on to the passage's end."""
    cut = F.col("made")[1]["end_para"]
    end = F.filter(spans(F.col("events"), since, F.col("last")), lambda s: (s["start_para"] <= cut) & (cut < s["end_para"]))
    d = d.withColumn("to", F.when(F.size("made") > 2, F.get(end, F.lit(0))["end_para"].cast("int")))
    to = F.col("to")
    moved = F.transform("made", lambda b: F.when(b["ord"] == 2, b.withField("end_para", to)).when(b["ord"] == 3, b.withField("start_para", to + 1)).otherwise(b))
    return d.withColumn("made", F.when(to.isNotNull(), moved).otherwise(F.col("made")))


def type_blocks(points: Column) -> Column:
    """points: paragraphs of the type markers in the order of their numbers, in which places need not ascend."""
    last, at = F.col("last"), F.get(points, F.lit(0))
    by_point = F.when(share(points) < F.size(points), F.get(points, share(points)) - 1).otherwise(last)
    end = F.when(F.size(points) >= 2, by_point).otherwise(at + ((last - at) * F.lit(0.7)).cast("int"))
    return F.array(before(at), block(2, P.MARKER_DRILL, at, end), block(3, P.MARKER_CONSOLIDATION, end + 1, last))


def snapped(ratio: float) -> Column:
    """A cut at a share of the document, moved to the nearest empty paragraph or heading that is near enough."""
    first, last, n = F.col("first"), F.col("last"), F.col("n")
    target = first + ((last - first) * F.lit(ratio)).cast("int")
    near = lambda c, reach: F.array_min(F.filter(F.transform(c, lambda p: F.struct(F.abs(p - target).alias("far"), p.alias("para"))), lambda x: x["far"] <= reach))["para"]
    return F.greatest(first, F.least(F.coalesce(near("blanks", F.greatest(F.lit(3), F.floor(n / 20))), near("headers", F.greatest(F.lit(5), F.floor(n / 10))), target), last))


def proportional_blocks(p1: Column, p2: Column) -> Column:
    first, last = F.col("first"), F.col("last")
    return F.array(block(1, P.MARKER_KNOWLEDGE, first, F.greatest(first, p1 - 1)), block(2, P.MARKER_DRILL, p1, p2 - 1), block(3, P.MARKER_CONSOLIDATION, p2, last))


def surveyed(paras: DataFrame) -> DataFrame:
    """A row for each document with all that the tiers need, from one shuffle."""
    t = F.col("text")
    no = F.when(F.col("_type"), F.regexp_extract(t, P.TYPE_MARKER, 1))
    gathered = lambda condition: F.array_sort(F.collect_list(F.when(condition, F.col("para"))))
    return boundaries(
        followed(paras),
        {
            "separator": F.min(F.when(F.col("_decor"), separated())),
            "practice": F.min(F.when((F.col("section_type") == "practice") | F.col("is_boundary"), F.col("para"))),
            "types": F.array_sort(F.collect_list(F.when(no != "", F.struct(scalars.number(no).alias("no"), "para")))),
            "blanks": gathered(t == ""),
            "headers": gathered(F.col("_header")),
            "events": reading_events(F.col("_begins"), F.col("_ends")),
        },
        {"_type": P.TYPE_MARKER, "_decor": P.DECOR_BEGINS, "_header": P.SECTION_HEADER, "_begins": P.READING, "_ends": P.READING_ENDS},
        sections=True,
    )


def auto_split(paras: DataFrame, ratios: tuple[float, float] = (0.5, 0.85)) -> DataFrame:
    """doc_id, tier, ord, marker, start_para, end_para: the blocks of the first tier that says anything."""
    d = surveyed(paras)
    lone = F.filter("types", lambda x, i: ~F.get("types", i + 1)["no"].eqNullSafe(x["no"]))
    s = F.col("separator")
    opened = s.isNotNull() & ~F.coalesce(F.col("practice") < s["at"], F.lit(False)) & ~(s["prose"] & (s["at"] + 1 < F.col("last")))
    tier = F.when(F.size("types") > 0, "type").when(opened, "separator").when(F.col("boundary").isNotNull(), "score").otherwise("proportional")
    d = d.withColumns({"points_of_types": F.transform(lone, lambda x: x["para"]), "tier": tier, "p1": snapped(ratios[0]), "p2": snapped(ratios[1])})
    d = d.withColumns({"at": F.when(F.col("tier") == "separator", s["at"]).when(F.col("tier") == "score", F.col("boundary")), "p2": F.greatest(F.col("p1") + 1, "p2")})
    by_type, by_share = type_blocks(F.col("points_of_types")), proportional_blocks(F.col("p1"), F.col("p2"))
    d = d.withColumn("made", F.when(F.col("tier") == "type", by_type).when(F.col("at").isNotNull(), cut_at(F.col("at"))).otherwise(by_share))
    # outer, as no array is empty and the filter that explode brings would carry copies of all these expressions down the plan
    return protected(d, F.coalesce("at", "first")).select("doc_id", "tier", F.explode_outer("made").alias("b")).select("doc_id", "tier", "b.*")


def first_tier(*tiers: DataFrame) -> DataFrame:
    """doc_id, tier, ord, marker, start_para, end_para: for each document the rows of the first of ``tiers`` that has it.

    Tiers are told apart by their place, in one shuffle of their rows, instead of an anti-join of each with those before.
    """
    columns = ["doc_id", "tier", "ord", "marker", "start_para", "end_para"]
    every = reduce(DataFrame.unionByName, (t.select(*columns, F.lit(k).alias("_place")) for k, t in enumerate(tiers)))
    return every.withColumn("_first", F.min("_place").over(doc())).filter("_place = _first").select(*columns)


def reading_spans(paras: DataFrame) -> DataFrame:
    """Reading passages, which no cut may part."""
    d = paras.groupBy("doc_id").agg(F.min("para").alias("first"), F.max("para").alias("last"), reading_events().alias("events"))
    return d.select("doc_id", F.explode(spans(F.col("events"), F.col("first"), F.col("last"))).alias("s")).select("doc_id", "s.start_para", F.col("s.end_para").cast("int").alias("end_para"))


def images_moved(blocks: DataFrame, paras: DataFrame) -> DataFrame:
    """Blocks with the pictures that stand right before a block, in paragraphs without words, made part of it; three at most."""
    pictures = paras.groupBy("doc_id").agg(F.collect_list(F.when(F.col("has_img") & F.col("text").rlike(P.DECOR), F.col("para"))).alias("pictures"))
    each = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "marker", "start_para", "end_para"))).alias("made"))
    return pictured(each.join(pictures, "doc_id"))


def pictured(found: DataFrame) -> DataFrame:
    """What ``images_moved`` gives, for rows that have a document's blocks (made, in their order) and pictures already."""
    kind = "array<struct<ord:int,marker:string,start_para:int,end_para:int>>"

    def step(acc, b):
        prior, start = F.get(acc, F.size(acc) - 1), b["start_para"]
        at = lambda k: F.array_contains("pictures", start - k) & (start - k >= prior["start_para"])
        back = F.when(at(1) & at(2) & at(3), 3).when(at(1) & at(2), 2).when(at(1), 1).otherwise(0)
        moved = F.struct(b["ord"].alias("ord"), b["marker"].alias("marker"), (start - back).alias("start_para"), b["end_para"].alias("end_para"))
        shorter = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(prior.withField("end_para", F.when(back > 0, start - back - 1).otherwise(prior["end_para"]))))
        return F.when(F.size(acc) == 0, F.array(b)).otherwise(F.array_append(shorter, moved)).cast(kind)

    made = F.aggregate("made", F.array().cast(kind), step)
    return found.select("doc_id", F.explode_outer(made).alias("b")).select("doc_id", "b.*")


def example_groups(paras: DataFrame, most: float = 0.4) -> DataFrame:
    """The first exam question under each type heading, to before the second; the last heading's may run to the end.

    sound: whether a document's groups cover no more than ``most`` of its paragraphs, without which nothing is to be taken out.
    """
    t = F.col("text")
    is_type = t.rlike(P.TYPE_ROW)
    marked = paras.withColumns({"total": F.count("*").over(doc()), "last": F.max("para").over(doc()), "section": F.sum(is_type.cast("int")).over(ordered())})
    asked = F.array_sort(F.collect_list(F.when(t.rlike(P.EXAM_QUESTION) & ~is_type, F.col("para"))))
    g = marked.filter("section > 0").groupBy("doc_id", "section").agg(asked.alias("asked"), F.max("para").alias("section_end"), F.first("last").alias("last"), F.first("total").alias("total"))
    end = F.when(F.size("asked") > 1, F.get("asked", F.lit(1)) - 1).when(F.col("section_end") == F.col("last"), F.col("last"))
    g = g.select("doc_id", F.get("asked", F.lit(0)).alias("start_para"), end.cast("int").alias("end_para"), "total").filter("start_para IS NOT NULL AND end_para IS NOT NULL")
    return g.withColumn("sound", F.sum(F.expr("end_para - start_para + 1")).over(doc()) <= F.col("total") * F.lit(most)).drop("total")


def without_examples(paras: DataFrame, most: float = 0.4) -> DataFrame:
    """``paras`` (doc_id, para, text) without their example groups, counted anew; documents whose groups aren't sound stay whole."""
    groups = example_groups(paras, most).filter("sound").groupBy("doc_id").agg(F.collect_list(F.struct("start_para", "end_para")).alias("groups"))
    inside = F.exists(F.coalesce("groups", F.array().cast("array<struct<start_para:int,end_para:int>>")), lambda g: F.col("para").between(g["start_para"], g["end_para"]))
    kept = paras.join(groups, "doc_id", "left").filter(~inside)
    return kept.select("doc_id", F.row_number().over(ordered()).alias("para"), "text")


def ideal_split(paras: DataFrame, size: int = 10) -> DataFrame:
    """Blocks of documents with type headings and two exam questions or more: by their sectors, or else ``size`` questions to drill."""
    t = F.col("text")
    f = paras.withColumn("since", F.min(F.when(t.rlike(P.TYPE_ROW), F.col("para"))).over(doc()))
    d = f.groupBy("doc_id").agg(
        F.min("para").alias("first"), F.max("para").alias("last"), F.first("since").alias("since"),
        F.min(F.when(t.rlike(P.SECTOR) & (F.col("para") >= F.col("since")), F.col("para"))).alias("sector"), F.array_sort(F.collect_list(F.when(t.rlike(P.EXAM_QUESTION), F.col("para")))).alias("asked"),
    ).filter("since IS NOT NULL AND size(asked) >= 2")
    third = F.coalesce("sector", F.get("asked", F.lit(size)))
    made = F.array(
        block(1, P.MARKER_KNOWLEDGE, F.col("first"), F.col("since") - 1), block(2, P.MARKER_DRILL, F.col("since"), F.coalesce(third - 1, "last")), F.when(third.isNotNull(), block(3, P.MARKER_CONSOLIDATION, third, F.col("last")))
    )
    return d.select("doc_id", F.explode(F.array_compact(made)).alias("b")).select("doc_id", "b.*")
