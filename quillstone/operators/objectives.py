"""What a handout teaches: titles of its knowledge and of its question types, numbers of questions, and objectives in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars
from .candidates import first_word


def features(paras: DataFrame) -> DataFrame:
    """doc_id, knowledge and types (three titles each, in order), tags (two), questions and examples, a row for each document.

    A paragraph counts as the first of these that it is: a type, a heading of knowledge, an ordered heading, a question;
    all others may be examples and have tags. Questions count as long as their numbers go on from 1.
    """
    t = F.col("text")
    strip = lambda c, edge: F.trim(F.regexp_replace(c, f"^{edge}+|{edge}+$", ""))
    ordered = F.regexp_extract(t, P.OBJECTIVE_ORDERED, 1)
    kind = F.when(t == "", None).when(t.rlike(P.TYPE_MARKER), "type").when(t.rlike(P.OBJECTIVE_KNOWLEDGE), "knowledge").when(ordered != "", "ordered").when(t.rlike(P.NUMBER), "question").otherwise("other")
    excluded = first_word(ordered, P.OBJECTIVE_EXCLUDED).isNotNull()
    title = (
        F.when(F.col("kind") == "type", strip(F.regexp_replace(t, P.OBJECTIVE_TYPE, ""), "[【】]")).when(F.col("kind") == "knowledge", F.regexp_replace(F.trim(F.regexp_replace(t, P.OBJECTIVE_KNOWLEDGE, "")), "^[：:、 ]+", ""))
        .when((F.col("kind") == "ordered") & ~excluded, F.trim(ordered))
    )
    f = paras.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("title", title)
    fit = (F.length("title") > 0) & (F.length("title") < 30)
    gathered = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("para", value.alias("v"))))), lambda x: x["v"])
    other = F.col("kind") == "other"
    tag = first_word(t, P.OBJECTIVE_TAGS)
    d = paras.select("doc_id").distinct().join(
        f.groupBy("doc_id").agg(
            gathered((F.col("kind") != "type") & fit, F.col("title")).alias("knowledge"), gathered((F.col("kind") == "type") & fit, F.col("title")).alias("types"), gathered(other & tag.isNotNull(), tag).alias("tags"),
            gathered(F.col("kind") == "question", scalars.number(F.regexp_extract(t, P.NUMBER, 1))).alias("numbers"), F.count_if(other & t.rlike(P.OBJECTIVE_EXAMPLE)).cast("int").alias("examples"),
        ),
        "doc_id", "left",
    )
    top = lambda c, n: F.slice(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))), 1, n).alias(c)
    numbers = F.coalesce("numbers", F.array().cast("array<int>"))
    questions = F.aggregate(numbers, F.lit(0), lambda n, x: F.when(x == n + 1, x).otherwise(n))
    return d.select("doc_id", top("knowledge", 3), top("types", 3), top("tags", 2), questions.alias("questions"), F.coalesce("examples", F.lit(0)).alias("examples"))


def worded(pattern: str, **values: Column) -> Column:
    """A text with columns in its places."""
    out, left = [], pattern
    while "{" in left:
        before, _, rest = left.partition("{")
        name, _, left = rest.partition("}")
        out += [F.lit(before), values[name].cast("string")]
    return F.concat(*out, F.lit(left))


def objectives(found: DataFrame, topic: Column) -> DataFrame:
    """doc_id, objectives and difficulties in words from ``features`` and a topic."""
    text = P.OBJECTIVE_TEXTS
    names = F.when(F.size("types") > 0, F.col("types")).otherwise(F.col("tags"))
    listed = F.concat(F.array_join(names, "、"), F.lit("等"))
    part = F.when(F.size(names) > 0, listed).otherwise(text["any_part"])
    known, few = F.array_join("knowledge", "、"), F.array_join(F.slice("knowledge", 1, 2), "、")
    first = F.when(F.size("knowledge") > 0, worded(text["knowledge"], topic=topic, names=known)).otherwise(worded(text["no_knowledge"], topic=topic))
    second = F.when(F.col("questions") > 0, worded(text["counted"], part=part, count=F.col("questions"))).otherwise(worded(text["uncounted"], part=part))
    key = F.when(F.size("knowledge") > 0, worded(text["key"], topic=topic, names=few)).otherwise(worded(text["no_key"], topic=topic))
    hard = F.when(F.size(names) > 0, worded(text["hard"], part=listed)).otherwise(text["no_hard"])
    return found.select("doc_id", F.concat_ws("\n", first, second, F.lit(text["skills"])).alias("objectives"), F.concat_ws("\n", key, hard).alias("difficulties"))
