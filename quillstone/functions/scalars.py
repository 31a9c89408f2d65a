"""Scalar functions of the handout workload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import matching
from . import patterns as P


def number(digits: Column) -> Column:
    """The number that full-width or plain digits spell; null for other scripts and for none."""
    return F.translate(digits, "０１２３４５６７８９", "0123456789").try_cast("int")


def cleaned(text: Column) -> Column:
    """Text as a scan has it: without encoded control characters (_x0007_), with a space for each real one, and none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "_x[0-9A-Fa-f]{4}_", ""), r"[\x00-\x1F]", " "))


def counter(log: Column, key: str) -> Column:
    """The number behind ``key=`` in a script's output; 0 if it has none."""
    return F.coalesce(F.regexp_extract(log, f"{key}=([0-9]+)", 1).try_cast("int"), F.lit(0))


def short(text: Column, limit: int) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def academic_year(day: Column) -> Column:
    y = F.year(day)
    first = F.when(F.month(day) >= 9, y).otherwise(y - 1)
    return F.concat(first.cast("string"), F.lit("-"), (first + 1).cast("string"), F.lit("学年"))


def file_base(*parts: Column) -> Column:
    """Parts joined by underscores, the null and empty ones left out."""
    return F.concat_ws("_", *(F.nullif(p, F.lit("")) for p in parts))


def is_red(colour: Column) -> Column:
    """RRGGBB that reads as red; anything else is not."""
    part = lambda k: F.conv(F.substring(colour, k, 2), 16, 10).cast("int")
    return F.coalesce(colour.rlike("^[0-9A-Fa-f]{6}$") & (part(1) >= 100) & (part(3) <= 70) & (part(5) <= 70), F.lit(False))


def clean_toc_name(line: Column) -> Column:
    """A line of a table of contents without its leader dots and page number."""
    t = F.trim(line)
    name = F.regexp_extract(t, r"^(.+?)\s*\.{5,}\s*\p{Nd}*\s*$", 1)
    return F.when(name != "", F.trim(name)).otherwise(F.trim(F.regexp_replace(t, r"\.{3,}\s*\p{Nd}*$", "")))


def toc_role(name: Column) -> Column:
    """advanced_practice, basic_practice, practice or knowledge, by words first and then by numbers; null for neither."""
    return matching.tried(name, {}, firsts={"role": P.TOC_ROLES})["role"]


def topic(name: Column, fallback: Column | None = None) -> Column:
    """What a file is about: its name without folders, extension, numbers, years and words of use; else the fallback, else its bare name."""
    bare = F.regexp_replace(F.substring_index(F.regexp_replace(name, r"\\", "/"), "/", -1), P.EXTENSION, "$1")
    parts = F.split(F.regexp_replace(bare, P.TOPIC_WHOLE, " "), P.TOPIC_SPLIT)
    noise = F.array(*(F.lit(w) for w in sorted(P.TOPIC_NOISE, key=len, reverse=True)))

    def cleaned(part: Column) -> Column:
        left = F.aggregate(noise, part, lambda acc, w: F.replace(acc, w, F.lit("")))
        return F.trim(F.regexp_replace(F.regexp_replace(left, P.TOPIC_PART, ""), P.TOPIC_EDGE_PART, ""))

    kept = F.filter(F.transform(F.filter(parts, lambda p: (p != "") & ~p.isin(P.TOPIC_NOISE)), cleaned), lambda p: (p != "") & ~p.isin(P.TOPIC_NOISE))
    left = F.array_join(kept, " ")
    for pattern in P.TOPIC_LEFT:
        left = F.regexp_replace(left, pattern, "")
    left = F.trim(F.regexp_replace(left, P.TOPIC_EDGE, ""))
    return F.coalesce(F.nullif(left, F.lit("")), F.nullif(fallback if fallback is not None else F.lit(None).cast("string"), F.lit("")), bare)
