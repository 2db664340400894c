"""Captured filing lists of an exchange (JSON) to rows, the latest revision of each, and what of it is to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.periods import fiscal_year

#: Field names and date formats of the old and the new list.
OLD = {"end": "toDate", "sent": "broadCastDate", "day": "dd-MMM-yyyy", "stamp": "dd-MMM-yyyy HH:mm:ss"}
NEW = {"end": "qe_Date", "sent": "broadcast_Date", "day": "dd-MMM-yyyy", "stamp": "dd-MMM-yyyy HH:mm:ss"}


def basis(text: Column) -> Column:
    return F.when(F.lower(text) == "consolidated", "consolidated").when(F.lower(text).isin("non-consolidated", "standalone"), "standalone")


def rows_of(listing: DataFrame, kind: dict[str, str], order: int) -> DataFrame:
    """``ticker, period_end, basis, url, broadcast, listed``: filings with an XML document and a basis, dates in any case."""
    date = F.to_date(F.expr(f"try_to_timestamp(initcap({kind['end']}), '{kind['day']}')"))
    sent = F.expr(f"try_to_timestamp(initcap({kind['sent']}), '{kind['stamp']}')")
    return listing.select("ticker", date.alias("period_end"), basis(F.col("consolidated")).alias("basis"), F.col("xbrl").alias("url"), sent.alias("broadcast"), F.lit(order).alias("listed")).filter("lower(url) LIKE '%.xml' AND basis IS NOT NULL AND period_end IS NOT NULL")


def nested(pages: DataFrame) -> DataFrame:
    """Rows of pages of the new list (``ticker, body``; body: JSON with the field ``data``) with the fields that ``rows_of`` reads."""
    kind = "array<struct<consolidated:string,xbrl:string,qe_Date:string,broadcast_Date:string>>"
    return pages.select("ticker", F.explode(F.from_json(F.get_json_object("body", "$.data"), kind)).alias("r")).select("ticker", "r.*")


def pages_needed(total: int, size: int) -> list[int]:
    """Numbers of the pages that a list of so many rows has, from 1; an empty one has a page."""
    if size < 1:
        raise ValueError(f"a page of {size} rows")
    return list(range(1, max(1, -(-total // size)) + 1))


def latest(listings: DataFrame, years: list[int]) -> DataFrame:
    """The last broadcast of each company, day and basis; of equal ones the first listed."""
    w = Window.partitionBy("ticker", "period_end", "basis").orderBy(F.col("broadcast").desc_nulls_last(), "listed", "url")
    kept = listings.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return kept.withColumn("fy", fiscal_year(F.col("period_end"))).filter(F.col("fy").isin(years))


def to_fetch(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """What the manifest (``name, url``) doesn't have under this name with this URL: new filings and revisions."""
    named = listing.withColumn("name", F.concat_ws("-", "ticker", F.date_format("period_end", "yyyy-MM-dd"), F.upper(F.substring("basis", 1, 1))))
    return named.join(manifest.select("name", "url"), ["name", "url"], "left_anti")


def verified(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (``name, content``) whose SHA-256 the manifest (``name, sha256``) has, and the failures with a reason."""
    both = manifest.join(files.select("name", "content"), "name", "left").withColumn("why", F.when(F.col("content").isNull(), "absent").when(F.sha2("content", 256) != F.col("sha256"), "its digest differs"))
    return both.filter("why IS NULL").drop("why"), both.filter("why IS NOT NULL").select("name", "why")


def first_claims(entries: DataFrame) -> DataFrame:
    """``spelling, ticker``: names and aliases (``ticker, names array, ord``), folded; the first entry keeps a spelling."""
    fold = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col("name")), r"[^a-z0-9 ]", " "), r"\s+(ltd|limited|inc|plc)?\s*$|\s+", " "))
    return entries.select("ticker", "ord", F.explode("names").alias("name")).select(fold.alias("spelling"), "ticker", "ord").groupBy("spelling").agg(F.min_by("ticker", F.struct("ord", "ticker")).alias("ticker"))
