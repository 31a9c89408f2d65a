"""Patterns tried on columns of texts inside tasks, by Arrow's kernels: one pass for a pattern, however many alternatives it has.

The patterns and the results are those of ``rlike``, for texts without vertical tabs and other line ends than \\n.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alternation(patterns: list[str]) -> str:
    """One pattern that matches where any of ``patterns`` does."""
    return "|".join(f"(?:{p})" for p in patterns)


def tried(text: Column, found: dict[str, str], sums: dict[str, list[tuple[str, int]]] | None = None, firsts: dict[str, list[tuple[str, str]]] | None = None) -> Column:
    """A struct of what patterns tell of a text, by name.

    found: whether a pattern matches, null for a null text. sums: the weights of all patterns that match. firsts: the value
    of the first pattern that matches; neighbours of one value are one alternation, as their order makes no difference.
    The function counts as nondeterministic so that no filter behind it makes Spark call it twice.
    """
    sums = sums or {}
    runs = {name: [(value, alternation([p for p, _ in run])) for value, run in groupby(table, key=lambda x: x[1])] for name, table in (firsts or {}).items()}
    parts = {name: ([x for x in table if x[0].startswith("^")], [x for x in table if not x[0].startswith("^")]) for name, table in sums.items()}
    opening = {name: alternation([p for p, _ in begins]) for name, (begins, _) in parts.items()}

    def sure(texts: pa.Array, p: str) -> np.ndarray:
        return pc.match_substring_regex(texts, p).fill_null(False).to_numpy(zero_copy_only=False)

    def summed(texts: pa.Array, table: list[tuple[str, int]]) -> np.ndarray:
        return sum((w * sure(texts, p) for p, w in table), np.zeros(len(texts), np.int32)).astype(np.int32)

    def run(texts: pa.Array) -> pa.Array:
        # a text that a batch has more than once is tried once
        coded = texts.dictionary_encode(null_encoding="encode")
        texts = coded.dictionary
        out = {name: pc.match_substring_regex(texts, p) for name, p in found.items()}
        for name, (begins, anywhere) in parts.items():
            total = summed(texts, anywhere)
            # few texts begin with anything of a table: one alternation tells which, and its patterns are tried on those alone
            at = np.flatnonzero(sure(texts, opening[name])) if begins else []
            if len(at):
                total[at] += summed(texts.take(pa.array(at)), begins)
            out[name] = pa.array(total)
        for name, each in runs.items():
            value = pa.nulls(len(texts), pa.string())
            for v, p in reversed(each):
                value = pc.if_else(pa.array(sure(texts, p)), v, value)
            out[name] = value
        return pa.StructArray.from_arrays(list(out.values()), names=list(out)).take(coded.indices)

    kinds = [*(f"{name} boolean" for name in found), *(f"{name} int" for name in sums), *(f"{name} string" for name in runs)]
    return F.arrow_udf(run, ", ".join(kinds)).asNondeterministic()(text)


def with_tried(paras: DataFrame, found: dict[str, str], sums: dict[str, list[tuple[str, int]]] | None = None, firsts: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """``paras`` with columns for what ``tried`` tells of their text."""
    made = [*(sums or {}), *found, *(firsts or {})]
    kept = [c for c in paras.columns if c not in made]
    return paras.select(*kept, tried(F.col("text"), found, sums, firsts).alias("_made")).select(*kept, *(F.col(f"_made.{c}").alias(c) for c in made))
