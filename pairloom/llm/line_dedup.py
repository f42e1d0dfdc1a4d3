"""Line dedup by overlapping windows of three lines, in DataFrame functions only.

Lines that hold a word are numbered within their text; every three consecutive ones make a window, keyed by 96 bits of
hash. A window's first occurrence in the table (smallest document id, then text hash, then line) stays; the lines of all
later occurrences are covered, overlapping covers merge, and covered lines go. Blank lines stay where they are.

The first occurrence is a minimum with map-side combine, and occurrences meet it in an equi-join whose small side has one
row per repeated window, so a passage that a third of all documents share neither gathers in one task nor makes pairs.

Defined results: null texts stay null and have no lines; texts of fewer than three such lines have no window and stay;
repeated windows inside one text count as later occurrences; rows that agree in id and text get the same result; rows that
share an id are told apart by their text; null ids sort first; an empty table gives an empty table; columns of the
input are kept, and replaced where they are called n_lines or n_removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HAS_WORD = r"[^\x20\x09-\x0D]"


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text's repeated windows removed, n_lines (lines with a word) and n_removed (of those)."""
    ident = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("t"))
    lines = F.split("t", "\n", -1)
    numbered = F.filter(F.transform(lines, lambda v, k: F.struct(k.alias("k"), v.alias("v"))), lambda s: s["v"].rlike(HAS_WORD))
    kept = ident.where("t is not null").select("d", "x", numbered.alias("a"))

    def window(k):
        a, b, c = (F.get("a", k + j)["v"] for j in range(3))
        return F.struct(
            F.xxhash64(a, b, c).alias("h"), F.hash(c, b, a).alias("g"), F.get("a", k)["k"].alias("i"),
            F.get("a", k + 1)["k"].alias("j"), F.get("a", k + 2)["k"].alias("l"),
        )

    # an outer generator: for others Catalyst infers a filter that would split the text again for every window
    each = F.when(F.size("a") >= 3, F.transform(F.sequence(F.lit(0), F.size("a") - 3), window))
    windows = kept.select("d", "x", F.inline_outer(each)).where("h is not null")
    first = windows.groupBy("h", "g").agg(F.min(F.struct("d", "x", "i")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["h", "g"]).where(~F.struct("d", "x", "i").eqNullSafe(F.col("first")))
    covered = later.groupBy("d", "x").agg(F.array_distinct(F.flatten(F.collect_list(F.array("i", "j", "l")))).alias("gone"))

    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    whole = docs.select(F.struct(*rest).alias("r"), F.col(id_col).alias("d0"), F.xxhash64(text_col).alias("x0"), F.col(text_col).alias("t0"))
    out = whole.join(covered, F.col("d0").eqNullSafe(F.col("d")) & (F.col("x0") == F.col("x")), "left")
    lines = F.split("t0", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    out = out.withColumns({"stay": stay, "l0": lines})
    count = F.size(F.filter("l0", lambda v: v.rlike(HAS_WORD)))
    out = out.select(
        "r", F.when(F.col("gone").isNull(), F.col("t0")).otherwise(F.array_join(F.transform("stay", lambda k: F.get("l0", k)), "\n")).alias("t1"),
        F.when(F.col("t0").isNull(), F.lit(0)).otherwise(count).cast("long").alias("n1"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n2"),
    )
    out = out.select(*[F.col("r")[c].alias(c) for c in rest], F.col("t1").alias(text_col), F.col("n1").alias("n_lines"), F.col("n2").alias("n_removed"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*names, "n_lines", "n_removed")
