"""Results tables read for matching: which period, scale, basis and row label each printed number has.

``tables``: document, sheet (place in the document), begin, end (offsets in the text), page, rows (array of arrays of
cells). Everything that a table takes over from the one before it is a window over its document's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import printed as N
from tallyforge.sinks.snapshots import written

#: A line that opens a block by its number, a year alone, and how far back a scale is looked for.
MAIN_LINE = r"^\s*(?:[IVX]{1,5}|[A-H])[.)]?\s"
LONE_YEAR = r"^(20\d{2})$"
SCALE_REACH = 300

TABLE = ("document", "sheet")


def _in_order(value: Column, *place: str) -> Column:
    """Values of a group, joined by spaces in the order of ``place``; nulls are left out."""
    kept = F.collect_list(F.when(value.isNotNull(), F.struct(*place, value.alias("v"))))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: x["v"]), " ")


def exploded(tables: DataFrame) -> DataFrame:
    """``document, sheet, r, c, text, number`` of every cell."""
    rows = tables.select(*TABLE, F.posexplode("rows").alias("r", "cells"))
    cells = rows.select(*TABLE, "r", F.posexplode("cells").alias("c", "text"))
    return cells.withColumn("number", N.number(F.col("text")))


def column_periods(header: DataFrame) -> DataFrame:
    """``document, sheet, c, period_end, months`` of the dated columns of header cells (``document, sheet, r, c, text``).

    A cell also covers the empty cells to its right, down to the last row that has a date. A column's own cells come before
    those that cover it. A fiscal year is twelve months if nothing else is said. A lone year among other headers counts
    if all dated columns end on one day of the year."""
    t = F.trim("text")
    dated = N.date_in(t).isNotNull() | N.fiscal_end_in(t).isNotNull() | t.rlike(LONE_YEAR)
    sheet, row = Window.partitionBy(*TABLE), Window.partitionBy(*TABLE, "r")
    cells = header.withColumn("cell", F.nullif(t, F.lit(""))).withColumn("last", F.coalesce(F.max(F.when(dated, F.col("r"))).over(sheet), F.max("r").over(sheet)))
    cells = cells.withColumn("cover", F.when(F.col("cell").isNull() & (F.col("r") <= F.col("last")), F.last("cell", ignorenulls=True).over(row.orderBy("c").rowsBetween(Window.unboundedPreceding, 0))))
    cells = cells.withColumn("year", F.when(F.count("cell").over(row) >= 2, F.nullif(F.regexp_extract("cell", LONE_YEAR, 1), F.lit("")).cast("int")))
    last_year = F.max(F.when(F.col("year").isNotNull(), F.struct("r", "year")))["year"]
    columns = cells.groupBy(*TABLE, "c").agg(_in_order(F.col("cell"), "r").alias("mine"), _in_order(F.col("cover"), "r").alias("theirs"), last_year.alias("year"))
    both = lambda f: F.coalesce(f(F.col("mine")), f(F.col("theirs")))
    columns = columns.withColumns({"day": both(N.date_in), "fiscal": both(N.fiscal_end_in), "months": both(N.months_in)})
    columns = columns.withColumn("own", F.coalesce("day", "fiscal")).withColumn("months", F.when(F.col("day").isNull() & F.col("fiscal").isNotNull(), F.coalesce("months", F.lit(12))).otherwise(F.col("months")))
    days = F.collect_set(F.date_format("own", "MM-dd")).over(sheet)
    by_year = F.when(F.size(days) == 1, F.try_to_date(F.concat_ws("-", F.col("year").cast("string"), F.get(days, F.lit(0))), "yyyy-MM-dd"))
    # without a year, concat_ws leaves a bare day, which is no date
    end = F.coalesce("own", F.when(F.col("year").isNotNull(), by_year))
    return columns.withColumn("period_end", end).filter("period_end IS NOT NULL").select(*TABLE, "c", "period_end", "months")


def sheets(tables: DataFrame, texts: DataFrame) -> DataFrame:
    """``document, sheet, basis, scale, page, row, column, label, heading, printed, value, places, percent, period_end,
    months, alone``: every figure of every table with numbers; ``texts(document, text)``.

    A table's body begins at its first row with two numbers. Basis and scale are the last that the text since the table
    before (for the scale its last ``SCALE_REACH`` letters) or the header states, else the table before's, else, for the
    scale, the one that the document states most often. An undated table as wide as the one before it, on the same or the
    next page, goes on under that one's columns and heading. Rows without figures and numbered main lines open blocks; a
    block's first figure row without a label takes its heading. Figures stand under the dated columns in order if there
    is one for each, else under their own column. ``alone``: no other column of the table ends that day."""
    cells = written(exploded(tables), "cells")  # numbers are read once
    counted = cells.groupBy(*TABLE, "r").agg(F.count("number").alias("n"), F.max("c").alias("widest"))
    shape = counted.groupBy(*TABLE).agg(F.min(F.when(F.col("n") >= 2, F.col("r"))).alias("first"), (F.max("widest") + 1).alias("width"))
    order = Window.partitionBy("document").orderBy("sheet")
    placed = tables.select(*TABLE, "begin", "end", "page").withColumn("since", F.coalesce(F.lag("end").over(order), F.lit(0))).join(shape.filter("first IS NOT NULL"), list(TABLE))

    head = cells.join(placed.select(*TABLE, "first"), list(TABLE))
    header, rest = head.filter("r < first"), head.filter("r >= first")
    own = header.groupBy(*TABLE).agg(_in_order(F.col("text"), "r", "c").alias("own"), F.max("r").alias("r"))
    line = header.groupBy(*TABLE, "r").agg(_in_order(F.nullif(F.col("text"), F.lit("")), "c").alias("line"))
    own = own.join(line, [*TABLE, "r"]).drop("r")
    dated = column_periods(header)
    periods = dated.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("c", "period_end", "months"))).alias("columns"))

    t = placed.join(texts.select("document", "text"), "document").join(own, list(TABLE), "left").join(periods, list(TABLE), "left")
    before = F.lower(F.substring(F.col("text"), F.col("since") + 1, F.greatest(F.col("begin") - F.col("since"), F.lit(0))))
    said = F.concat(F.lit(" "), F.lower(F.coalesce("own", F.lit(""))))
    t = t.withColumns({"basis": N.basis_in(F.concat(before, said)), "scale": N.scale_in(F.concat(F.substring(before, -SCALE_REACH, SCALE_REACH), said)), "usual": N.most_stated_scale(F.col("text"))})
    t = t.select(*TABLE, "page", "first", "width", "columns", "basis", "scale", "usual", F.coalesce("line", F.lit("")).alias("line"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    goes_on = F.col("columns").isNull() & (F.col("width") == F.lag("width").over(order)) & (F.col("page") - F.lag("page").over(order)).between(0, 1)
    t = t.withColumns({"basis": F.last("basis", ignorenulls=True).over(so_far), "scale": F.coalesce(F.last("scale", ignorenulls=True).over(so_far), "usual"), "opens": F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)})
    t = t.withColumn("run", F.sum("opens").over(so_far))
    start = Window.partitionBy("document", "run").orderBy("sheet")
    # a run whose first table has no dates has nothing to hand on: each of its tables is a run of its own
    t = t.withColumn("columns", F.first("columns").over(start)).withColumn("run", F.when(F.col("columns").isNull(), -1 - F.col("sheet")).otherwise(F.col("run")))
    t = written(t.withColumn("line", F.first("line").over(start)).drop("opens", "usual", "width"), "tables")

    figure = F.col("number").isNotNull() & (F.trim("text") != "") & ~N.is_serial(F.col("c"), F.col("text"))
    words = F.when(~figure & ~N.is_serial(F.col("c"), F.col("text")), F.nullif(F.col("text"), F.lit("")))
    body = rest.groupBy(*TABLE, "r").agg(
        _in_order(words, "c").alias("label"),
        _in_order(F.nullif(F.col("text"), F.lit("")), "c").alias("whole"),
        F.array_sort(F.collect_list(F.when(figure, F.struct("c", F.trim("text").alias("printed"), "number")))).alias("figures"),
    )
    body = body.join(t, list(TABLE))
    bare, main = F.size("figures") == 0, F.col("whole").rlike(MAIN_LINE)
    down = Window.partitionBy(*TABLE).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("document", "run").orderBy("sheet", "r").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(bare, F.nullif(F.col("label"), F.lit(""))).when(main, F.col("label"))
    body = body.withColumns({"heading": F.coalesce(F.last(opened, ignorenulls=True).over(along), "line"), "block": F.sum(F.when(bare | main, 1).otherwise(0)).over(down)})
    unnamed = Window.partitionBy(*TABLE, "block")
    closes = F.min(F.when((F.col("label") == "") & ~bare, F.col("r"))).over(unnamed)
    body = body.withColumn("closes", closes).filter(~bare)
    body = body.withColumn("label", F.when(F.col("label") != "", F.col("label")).when(F.col("r") == F.col("closes"), F.col("heading")).otherwise(""))

    by_order = F.size("columns") == F.size("figures")
    out = body.select(*TABLE, "basis", "scale", "page", "r", "label", "heading", "columns", by_order.alias("by_order"), F.posexplode("figures").alias("i", "f"))
    own_column = F.try_element_at(F.filter("columns", lambda x: x["c"] == F.col("f.c")), F.lit(1))
    period = F.when(F.coalesce("by_order", F.lit(False)), F.get("columns", F.col("i"))).otherwise(own_column)
    out = out.withColumn("p", period)
    alone = F.size(F.filter("columns", lambda x: x["period_end"] == F.col("p.period_end"))) == 1
    return out.select(*TABLE, "basis", "scale", "page", F.col("r").alias("row"), F.col("f.c").alias("column"), "label", "heading", "f.printed", "f.number.value", "f.number.places", "f.number.percent", "p.period_end", "p.months", F.coalesce(alone, F.lit(False)).alias("alone"))
