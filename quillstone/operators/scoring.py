"""Row-local scores and types of paragraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matching, scalars
from ..functions import patterns as P


def weight(text: Column, table: list[tuple[str, int]]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(text.rlike(p), w).otherwise(0) for p, w in table))


def knowing(text: Column) -> Column:
    """Whether a paragraph is more like knowledge than like a question, for which some pattern of knowledge has to match.

    The weights are inside a lambda, so that a filter's code stays small; only what one of two alternations finds gets there.
    """
    return any_of(text, [p for p, _ in P.KNOWLEDGE]) & F.exists(F.array(text), lambda t: weight(t, P.KNOWLEDGE) > weight(t, P.QUESTION))


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns matches: one alternation, and one for those without regard to case."""
    folded, plain = [p[4:] for p in patterns if p.startswith("(?i)")], [p for p in patterns if not p.startswith("(?i)")]
    found = [text.rlike(flag + "|".join(f"(?:{p})" for p in ps)) for flag, ps in (("", plain), ("(?i)", folded)) if ps]
    return reduce(lambda a, b: a | b, found)


def scored(paras: DataFrame, more: dict[str, str] | None = None, sections: bool = True) -> DataFrame:
    """``paras`` with q, k, is_boundary and, if ``sections`` are asked for, section_type, and a boolean for each of the patterns in ``more``."""
    found = {"is_boundary": matching.alternation(P.BOUNDARY)} | (more or {})
    return matching.with_tried(paras, found, {"q": P.QUESTION, "k": P.KNOWLEDGE}, {"section_type": P.SECTION} if sections else None)


def type_positions(paras: DataFrame) -> DataFrame:
    """The last paragraph of each numbered type marker."""
    n = F.regexp_extract("text", P.TYPE_MARKER, 1)
    return paras.withColumn("type_no", n).filter(n != "").groupBy("doc_id", scalars.number(F.col("type_no")).alias("type_no")).agg(F.max("para").alias("para"))
