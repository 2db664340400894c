"""What datasets and runs are of: digests of rows, and unions of runs that are of the same."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the hash that the levels of a tree group by, the leaves' first.
LEVELS = (6, 3)


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row: of each column ``n`` for null, else ``s``, its text's bytes and the text, so that no two rows run together.
    For columns whose text is the same everywhere: strings, whole numbers, booleans, dates."""
    text = lambda c: F.col(c).cast("string")
    return F.sha2(F.concat(*[F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("s"), F.octet_length(text(c)).cast("string"), F.lit(":"), text(c))) for c in columns]), 256)


def digests(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """``by, rows, digest`` of each group (one row if there are none): the root of a tree of hashes, whatever the order of the rows.

    Equal rows are one with their number; the others meet by the first digits of their hash, and nodes by fewer, so that no
    task has more than a leaf's or a node's children. Without rows the digest is that of nothing."""
    by = by or []
    each = rows.select(*by, row_hash(columns).alias("h")).groupBy(*by, "h").agg(F.count("*").alias("n"))
    level = each.select(*by, F.col("h").alias("p"), F.concat("h", F.lit(":"), F.col("n").cast("string")).alias("h"), "n")
    for width in (*LEVELS, 0):
        inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "")
        level = level.groupBy(*by, F.left("p", F.lit(width)).alias("q")).agg(F.sha2(inner, 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("q", "p")
    found = level.select(*by, F.col("n").alias("rows"), F.col("h").alias("digest"))
    if by:
        return found
    none = hashlib.sha256(b"").hexdigest()
    return found.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("digest"), F.lit(none)).alias("digest"))


def digest(rows: DataFrame, columns: list[str]) -> str:
    return digests(rows, columns).first()["digest"]


def joined(parts: list[tuple[str, str]]) -> tuple[str, str]:
    """The label and digest of several datasets (label, digest) in their order; those of a single one are its own."""
    if len(parts) == 1:
        return parts[0]
    return "+".join(label for label, _ in parts), hashlib.sha256("\n".join(d for _, d in parts).encode()).hexdigest()


@dataclass
class Run:
    """Rows (``variant, case_id, ...``) of a run, the digest of its cases, its graders by name and version, and when it began."""

    rows: DataFrame
    cases: str
    graders: dict[str, str]
    began: str = ""


def united(runs: list[Run]) -> DataFrame:
    """The rows of all runs. Refused if their cases or graders differ, or a variant is in two of them: their rates could not be
    compared."""
    first = runs[0]
    out = first.rows
    for run in runs[1:]:
        if run.cases != first.cases:
            raise ValueError(f"the runs are of different cases: {first.cases[:12]} and {run.cases[:12]}")
        if run.graders != first.graders:
            odd = sorted(n for n in first.graders.keys() | run.graders.keys() if first.graders.get(n) != run.graders.get(n))
            raise ValueError(f"the runs have different graders: {', '.join(odd)}")
        both = out.select("variant").distinct().join(run.rows.select("variant").distinct(), "variant", "left_semi")
        if names := sorted(r.variant for r in both.collect()):  # variants are few
            raise ValueError(f"in several runs: {', '.join(names)}")
        out = out.unionByName(run.rows, allowMissingColumns=True)
    return out


def newest(runs: list[Run]) -> Run:
    """The run that began last; of equal ones the last given."""
    return max(enumerate(runs), key=lambda x: (x[1].began, x[0]))[1]


def newest_rows(rows: DataFrame, run: str, began: str, by: list[str] | None = None) -> DataFrame:
    """The rows of the run that began last (ties: the greatest name), in each group of ``by`` if given."""
    by = by or []
    last = rows.groupBy(*by).agg(F.max(F.struct(began, run)).alias("last")) if by else rows.agg(F.max(F.struct(began, run)).alias("last"))
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col(f"a.{run}").eqNullSafe(F.col(f"b.last.{run}")), F.col(f"a.{began}").eqNullSafe(F.col(f"b.last.{began}"))]
    return rows.alias("a").join(last.alias("b"), keys, "left_semi")
