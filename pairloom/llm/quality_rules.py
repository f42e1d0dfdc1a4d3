"""Quality rules as a ledger: measure once, evaluate every rule once into a bit mask, decide by versioned policies.

The ledger holds, per document, the measurements and ``failed``: bit k is set if rule k fails. A policy is a named mask;
applying one, or finding what each rule alone removes, is bitwise arithmetic over the ledger and never reads texts again.

Measuring runs in Python on Arrow batches (bytes.split and sets of word triples; Spark's array functions would build the
same sets per window at several times the cost); no shuffle, one row in and one row out. Policies and ablations are
DataFrame expressions.

Defined results: null and empty texts have no words (they fail ``short``); repeated rows and equal ids give a row each;
an empty table gives an empty ledger, and ablations of zeros; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import SPACE
from pairloom.plans.runtime import ship

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")

#: (name, failure) in order of bits; failures are SQL over the measurements. Append only: bits keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("short", "n_words < 50"),
    ("repeats", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("shouting", "100 * n_upper > 40 * word_chars"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    ("same_lines", "n_lines >= 4 and 100 * n_dup_lines > 60 * n_lines"),
)


@dataclass(frozen=True)
class Policy:
    """A version of what counts: the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {name: 1 << k for k, (name, _) in enumerate(RULES)}
        return sum(bits[r] for r in self.rules)


BASE = Policy("base", ("short", "repeats"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", ("short", "repeats", "symbols", "shouting", "word_length", "same_lines")))}


def measure(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines of one text."""
    words = text.split()
    inside = text.translate(None, SPACE)
    lines = [line for line in text.split(b"\n") if line.strip()]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(triples)) < len(triples):
        seen, twice = set(), set()
        for t in triples:
            (twice if t in seen else seen).add(t)
        covered_to = 0
        for k, t in enumerate(triples):
            if t in twice:
                repeated += k + 3 - max(k, covered_to)
                covered_to = k + 3
    return (
        len(words), len(inside.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated, len(text) - len(text.translate(None, UPPER)), len(lines),
    )


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the measurements (long) and ``failed`` (long, one bit per rule of RULES)."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(v.as_py() or b"") for v in batch.column(1)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    measured = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    )
    bits = [F.when(F.expr(failure), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, failure) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed).withColumnRenamed("id", id_col)


def passes(policy: Policy) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail only it, and that the policy without it keeps.

    One pass: the ledger is first summed per distinct mask (at most 2 to the number of rules rows), so the rest is tiny.
    """
    masks = rows.groupBy("failed").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (n, _) in enumerate(RULES) if n in policy.rules])
    of = F.lit(policy.mask).cast("long")
    seen = F.col("failed").bitwiseAND(of)
    long = masks.withColumn("r", F.explode(rules)).select("n", seen.alias("seen"), "r.rule", "r.bit")
    return long.groupBy("rule").agg(
        F.sum(F.when(F.col("seen").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("seen") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("seen").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
