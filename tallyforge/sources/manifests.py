"""Manifests of fetched files and of the documents that facts are checked against, and hand-written seeds, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.binding import required
from tallyforge.functions.labels import document_stem, ticker_of
from tallyforge.sizes import sized

#: The mark and engine of a second reading, shares and letters that make a page or a document a scan, verdicts.
MARK, ENGINE = "#rapidocr", "rapidocr"
MOST_SCANNED, LEAST_LETTERS = 0.10, 200
VERDICTS = ("right", "wrong", "elsewhere")
FORMATS = {"pdf": "pdf", "htm": "html", "html": "html"}
ENTRY = "struct<url:string,sha256:string,fetched:string,source:string,format:string,pages:int,text_less_pages:array<int>,ocr_pages:array<int>,ticker:string,company:string,title:string>"


def read(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """``name`` and the entry's fields of a JSON object of entries by name, or of that of a field of it."""
    text = spark.read.text(path, wholetext=True).select(F.get_json_object("value", f"$.{field}").alias("value") if field else "value")
    rows = text.select(F.explode(F.from_json("value", f"map<string,{ENTRY}>")).alias("name", "e"))
    return rows.select("name", "e.*")


def as_json(manifest: DataFrame) -> DataFrame:
    """One row, ``value``: entries by name, names and fields in order; null fields are left out."""
    fields = sorted(c for c in manifest.columns if c != "name")
    rows = manifest.select("name", F.concat(F.lit('"'), "name", F.lit('": '), F.to_json(F.struct(*fields))).alias("line"))
    return rows.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "line"))), lambda x: x["line"]), ",\n"), F.lit("}\n")).alias("value"))


def is_scan(pages: Column, text_less: Column, ocr: Column, most: float = MOST_SCANNED) -> Column:
    """More than a share of the pages have no text, or text that was read from a picture."""
    return F.coalesce((pages > 0) & (F.size(F.array_union(text_less, ocr)) > most * pages), F.lit(False))


def is_ocr_scan(pages: Column, text_less: Column, ocr: Column, most: float = MOST_SCANNED) -> Column:
    """A scan only because of pages whose text was read from pictures."""
    return is_scan(pages, text_less, ocr, most) & (F.size(text_less) <= most * pages)


def _scans() -> tuple[Column, Column]:
    args = (F.col("pages"), F.col("text_less_pages"), F.col("ocr_pages"))
    return is_scan(*args), is_ocr_scan(*args)


def origin(name: Column, version: str = "3") -> Column:
    """Source and format of a copy, ``-ocr`` if it is read through its own OCR text; for a second reading engine and version."""
    form = F.concat_ws("-", "source", "format")
    return F.when(name.endswith(MARK), F.concat_ws("-", form, F.lit(ENGINE), F.lit(version))).when(_scans()[1], F.concat(form, F.lit("-ocr"))).otherwise(form)


def _usable(ocr: list[str] | Column) -> Column:
    """Whether an entry's company is one whose OCR text may be used: of a list, or by a condition."""
    return F.coalesce(ocr if isinstance(ocr, Column) else ticker_of(F.col("name")).isin(ocr), F.lit(False))


def with_ocr_companies(manifest: DataFrame, companies: DataFrame) -> DataFrame:
    """Entries with ``ocr_usable``: whether their company is one of a table of any length (``ticker``)."""
    listed = companies.select(F.col("ticker").alias("_ticker"), F.lit(True).alias("_listed")).distinct()
    rows = manifest.withColumn("_ticker", ticker_of(F.col("name"))).join(sized(listed), "_ticker", "left")
    return rows.withColumn("ocr_usable", F.coalesce("_listed", F.lit(False))).drop("_ticker", "_listed")


def refusal(ocr: list[str] | Column) -> Column:
    """Why an entry can't be read; null if it can: it isn't flagged, or a scan, unless it has OCR text and a company whose text
    may be used (a list of companies, or a condition)."""
    flagged = F.col("format").isNotNull() & F.col("pages").isNotNull() & F.col("text_less_pages").isNotNull() & F.col("ocr_pages").isNotNull()
    scan, own = _scans()
    allowed = own & _usable(ocr)
    return F.when(~flagged, "not flagged yet").when((F.col("format") != "html") & scan & ~allowed, F.concat(F.lit("a scan: no text on pages "), F.array_join(F.col("text_less_pages").cast("array<string>"), ", "), F.when(F.size("ocr_pages") > 0, F.concat(F.lit("; OCR text on pages "), F.array_join(F.col("ocr_pages").cast("array<string>"), ", "))).otherwise("")))


def readings(manifest: DataFrame, ocr: list[str] | Column) -> DataFrame:
    """Entries with each ``reading`` of theirs: the document itself, and a second one of a company's scan."""
    second = (F.col("format") == "pdf") & _scans()[0] & _usable(ocr)
    return manifest.select("*", F.explode(F.when(F.coalesce(second, F.lit(False)), F.array("name", F.concat("name", F.lit(MARK)))).otherwise(F.array("name"))).alias("reading"))


def flagged(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries with format, page count and lists of pages without text and with OCR text, of ``pages(name, page, letters,
    invisible)``; HTML has none. A name with another suffix is an error."""
    kind = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("page"))))
    g = pages.groupBy("name").agg(F.count("*").cast("int").alias("n"), listed(F.col("letters") < LEAST_LETTERS).alias("t"), listed(F.col("invisible")).alias("o"))
    none = F.array().cast("array<int>")
    rows = manifest.drop("format", "pages", "text_less_pages", "ocr_pages").join(g, "name", "left").withColumn("format", F.try_element_at(kind, suffix))
    fmt = F.when(F.col("format").isNull(), F.raise_error(F.concat(F.lit("neither PDF nor HTML: "), "name"))).otherwise(F.col("format"))
    pdf = F.col("format") == "pdf"
    return rows.select(*[c for c in rows.columns if c not in ("format", "n", "t", "o")], fmt.alias("format"), F.when(pdf, F.coalesce("n", F.lit(0))).otherwise(0).alias("pages"), F.when(pdf, F.coalesce("t", none)).otherwise(none).alias("text_less_pages"), F.when(pdf, F.coalesce("o", none)).otherwise(none).alias("ocr_pages"))


def stems(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("stem", document_stem(F.col("name")))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, value`` of a JSON Lines file, blank lines and ``//`` comments left out."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "value"))
    return text.select((F.col("i") + 1).alias("line"), F.trim("value").alias("value")).filter((F.col("value") != "") & ~F.col("value").startswith("//"))


def strict(rows: DataFrame, schema: str, allowed: list[str]) -> DataFrame:
    """Lines parsed by a schema; a line that is no object, has other fields or doesn't fit is an error that names it."""
    keys = F.json_object_keys("value")
    extra = F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0
    parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    where = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "))
    why = F.when(keys.isNull(), "no JSON object").when(extra, "unknown fields").when(F.col("r._broken").isNotNull(), "it doesn't fit")
    checked = rows.withColumn("r", parsed).withColumn("why", why)
    return checked.filter(required(F.concat(where, "why"))).select("line", "r.*").drop("_broken")


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts of persons on groups; an unknown verdict is an error. A check's facts are pairs of id and value."""
    rows = strict(lines(spark, path), "id string, verdict string, note string, decided_by string, checks array<struct<group:string,facts:array<array<double>>,spot_checked:array<bigint>>>", ["id", "verdict", "note", "decided_by", "checks"])
    rows = rows.filter(required(F.when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": verdict "), F.coalesce("verdict", F.lit("none"))))))
    checks = F.transform("checks", lambda c: F.struct(c["group"].alias("group"), F.transform(c["facts"], lambda f: F.struct(f[0].cast("bigint").alias("id"), f[1].alias("value"))).alias("facts"), c["spot_checked"].alias("ticked")))
    return rows.select(F.col("id").alias("group_id"), "verdict", F.coalesce("note", F.lit("")).alias("note"), "decided_by", checks.alias("checks"))


def share_events(spark: SparkSession, path: str, held: DataFrame) -> DataFrame:
    """Seeded events of companies that aren't held yet for their company and day (``held(ticker, effective)``)."""
    rows = strict(lines(spark, path), "ticker string, kind string, effective date, shares_after int, shares_before int, note string", ["ticker", "kind", "effective", "shares_after", "shares_before", "note"])
    return rows.join(held.select("ticker", "effective").distinct(), ["ticker", "effective"], "left_anti").withColumn("tier", F.lit("share-event-ai")).drop("line")


def fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """``ticker, year, metric, value, unit, printed, doc_id, page, note`` of a JSON object nested by company, year and metric."""
    kind = "map<string,map<string,map<string,struct<value:double,unit:string,printed:string,doc_id:string,page:int,note:string>>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.fundamentals"), kind).alias("m"))
    years = text.select(F.explode("m").alias("ticker", "years")).select("ticker", F.explode("years").alias("year", "metrics"))
    return years.select("ticker", F.col("year").cast("int").alias("year"), F.explode("metrics").alias("metric", "e")).select("ticker", "year", "metric", "e.*")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """``ticker, name, aliases, ord`` of a JSON object of companies by ticker, in the order of the tickers."""
    text = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.companies"), "map<string,struct<name:string,aliases:array<string>>>").alias("m"))
    entries = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].alias("ticker"), e["value"].alias("v"))))
    return text.select(F.posexplode(entries).alias("ord", "e")).select("e.ticker", "e.v.name", "e.v.aliases", "ord")


def outside(ticker: Column, year: Column, tickers: list[str], years: list[int]) -> Column:
    """Why a figure is beyond what is held; null if it isn't."""
    return F.when(~ticker.isin(tickers), "not a company that is held").when(~year.isin(years), "not a year that is held")


def labelled_figures(rows: DataFrame, tickers: list[str], years: list[int], results: list[str]) -> DataFrame:
    """Figures that a teacher labelled, with ``source`` and ``left_out``, the first reason in order why one doesn't count.

    ``rows(chunk_id, question, i, metric, value, unit, year, description, tolerance)``; a figure that repeats another with the same
    question counts once, the first by chunk and place."""
    from pyspark.sql import Window

    ticker = F.regexp_extract(F.substring_index("chunk_id", "#", 1), r"^(.*)-[^-]*$", 1)
    metric = F.coalesce("metric", F.lit("other"))
    source = F.when(metric == "other", "teacher").when(metric.isin(results), "teacher-results").otherwise("teacher-other")
    why = (
        F.when(metric == "other", "no named metric")
        .when(F.col("year").isNull() | F.col("value").isNull(), "no year or no value")
        .when(outside(ticker, F.col("year"), tickers, years).isNotNull(), outside(ticker, F.col("year"), tickers, years))
        .when(~F.col("unit").eqNullSafe(F.lit("INR")) | F.col("description").eqNullSafe(F.lit("change")), "not an amount in rupees")
        .when(F.col("value") == 0, "zero, which any nil fact would match")
        .when(F.col("tolerance").isNull(), "its precision can't be read from its call")
    )
    out = rows.withColumns({"ticker": ticker, "source": source, "why": why})
    again = F.row_number().over(Window.partitionBy("ticker", "year", "metric", "value", "question", F.col("why").isNull()).orderBy("chunk_id", "i")) > 1
    return out.withColumn("left_out", F.coalesce("why", F.when(again, "repeats a figure already counted"))).drop("why")
