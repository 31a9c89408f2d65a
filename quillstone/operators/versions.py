"""Plans: documents fanned out by versions and modes of splitting, in one plan with a status for each version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import candidates, contents, rows, tiers
from .replies import reviewed_blocks

MODES = ("full", "ideal", "candidate", "smart")
OK, NO_SOURCE, NO_MODE = "ok", "no source", "no such mode"


def whole(paras: DataFrame) -> DataFrame:
    """All of a document as its knowledge."""
    return rows.extent(paras).select("doc_id", F.lit(1).alias("ord"), F.lit(P.MARKER_KNOWLEDGE).alias("marker"), "start_para", "end_para")


def candidate_mode(paras: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Blocks by candidates, reviewed where there are replies, that cut no reading passage."""
    found = candidates.collected(paras)
    blocks = candidates.candidate_blocks(found) if replies is None else reviewed_blocks(found, replies).drop("source")
    made = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "marker", "start_para", "end_para"))).alias("made"))
    extents = paras.groupBy("doc_id").agg(F.min("para").alias("first"), F.max("para").alias("last"), tiers.reading_events().alias("events"))
    kept = tiers.protected(made.join(extents, "doc_id"), F.col("first"))
    return kept.select("doc_id", F.explode_outer("made").alias("b")).select("doc_id", "b.*")


def version_blocks(versions: DataFrame, paras: DataFrame) -> DataFrame:
    """version_id, mode, status, ord, marker, start_para and end_para of versions (version_id, doc_id, mode) of documents.

    Each mode is worked out for the documents that some version wants in it, once, however many versions do. Documents
    that have no ideal blocks are split smartly. A version without a document, or in no known mode, has a status that says
    so and no blocks, and leaves the others alone.
    """
    known = paras.groupBy("doc_id").agg(F.count("*").alias("n_paras"))
    checked = versions.join(known, "doc_id", "left").withColumn("status", F.when(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)), NO_MODE).when(F.col("n_paras").isNull(), NO_SOURCE).otherwise(OK)).drop("n_paras")
    of = lambda *modes: paras.join(versions.filter(F.col("mode").isin(*modes)).select("doc_id").distinct(), "doc_id", "left_semi")
    ideal = tiers.ideal_split(of("ideal"))
    fit = ideal.select("doc_id", F.lit(True).alias("fit")).distinct()
    used = F.when((F.col("mode") == "ideal") & F.col("fit").isNull(), "smart").otherwise(F.col("mode"))
    checked = checked.join(fit, "doc_id", "left").withColumn("used", used)
    each = {"full": whole(of("full")), "ideal": ideal, "candidate": candidate_mode(of("candidate")), "smart": contents.smart_blocks(of("smart", "ideal")).drop("tier")}
    blocks = reduce(DataFrame.unionByName, (b.withColumn("used", F.lit(m)) for m, b in each.items()))
    return checked.join(blocks, ["doc_id", "used"], "left").select("version_id", "mode", "status", "ord", "marker", "start_para", "end_para")
