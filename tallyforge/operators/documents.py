"""Documents: fixed chunks, furniture, sentence packing, HTML elements, equal texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import is_heading, skeleton
from tallyforge.sizes import joined_by_size

#: Abbreviations after which no sentence ends, and what ends one.
ABBREVIATIONS = frozenset(("approx", "co", "cr", "dr", "e.g", "etc", "fig", "i.e", "inc", "jr", "ltd", "mr", "mrs", "ms", "no", "pvt", "rs", "sr", "vs", "viz"))
SENTENCE_END = re.compile(r"(?<=[.!?])[\"'’”)\]]*\s+")
#: Letters before an end in which its last word is looked for.
LOOK_BACK = 64


def fixed_chunks(docs: DataFrame, *, size: int = 1200, overlap: int = 200, least: int = 80) -> DataFrame:
    """``doc_id, ordinal, start, text``: windows of ``size`` every ``size - overlap``; a tail under ``least`` is no chunk."""
    step = size - overlap
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))
    cut = docs.select("doc_id", "text", F.posexplode(starts).alias("i", "start")).select("doc_id", "i", "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("text"))
    # only a document's last windows can be too short, so places before them have no gaps
    return cut.filter(F.length("text") >= least).select("doc_id", F.col("i").alias("ordinal"), "start", "text")


def furniture(lines: DataFrame, *, by: str = "doc_id", page: str = "page", least_pages: int = 4, edge: int = 2, share: float = 0.2) -> DataFrame:
    """``by, skeleton, pages, of`` of digit-masked lines that stand among the first or last ``edge`` lines (not blank) of at
    least ``share`` of the pages, in groups of ``least_pages`` or more. ``lines(by, page, pos, line)``."""
    full = lines.filter(F.trim("line") != "")
    w = Window.partitionBy(by, page)
    edges = full.withColumn("up", F.row_number().over(w.orderBy("pos"))).withColumn("down", F.row_number().over(w.orderBy(F.desc("pos")))).filter((F.col("up") <= edge) | (F.col("down") <= edge))
    pages = lines.groupBy(by).agg(F.count_distinct(page).alias("of")).filter(F.col("of") >= least_pages)
    seen = edges.groupBy(by, skeleton(F.col("line")).alias("skeleton")).agg(F.count_distinct(page).alias("pages"))
    return seen.join(pages, by).filter(F.col("pages") >= share * F.col("of"))


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences, which tile the text: one ends after a full stop, a question or an exclamation mark, closing marks
    and white space, unless an abbreviation or a single letter stands before."""
    spans, start = [], 0
    for m in SENTENCE_END.finditer(text):
        before = text[max(0, m.start() - LOOK_BACK) : m.start()].rstrip(".!?").split()
        word = before[-1].rstrip(".").casefold() if before else ""
        if len(word) != 1 and word not in ABBREVIATIONS:
            spans.append((start, m.end()))
            start = m.end()
    return [*spans, (start, len(text))] if start < len(text) else spans


def cut_lines(text: str, start: int, end: int, size: int) -> list[tuple[int, int]]:
    """A span in pieces of whole lines up to ``size``; a longer line is a piece of its own."""
    out, at, held = [], start, start
    for m in re.finditer("\n|$", text[start:end]):
        stop = start + m.end()
        if stop - at > size and held > at:
            out.append((at, held))
            at = held
        held = stop
    return [*out, (at, end)] if at < end else out


def packed(text: str, size: int = 1200, overlap: int = 1, lines: bool = False) -> list[tuple[int, str]]:
    """(start, piece): sentences packed up to ``size``; the next piece begins ``overlap`` sentences back. A sentence over
    the size is cut every ``size`` letters or, with ``lines``, at its line breaks."""
    spans, out, i = sentences(text), [], 0
    cut = (lambda a, b: cut_lines(text, a, b, size)) if lines else (lambda a, b: [(x, min(x + size, b)) for x in range(a, b, size)])
    while i < len(spans):
        start, j = spans[i][0], i
        while j < len(spans) and spans[j][1] - start <= size:
            j += 1
        if j == i:
            out += cut(start, spans[i][1])
            i += 1
            continue
        out.append((start, spans[j - 1][1]))
        i = j if j >= len(spans) else max(i + 1, j - overlap)
    pieces = [(a, text[a:b]) for a, b in out]
    return [(a + len(p) - len(p.lstrip()), p.strip()) for a, p in pieces if p.strip()]


def sentence_chunks(docs: DataFrame, *, size: int = 1200, overlap: int = 1) -> DataFrame:
    """``doc_id, ordinal, start, text`` by whole sentences. Packing carries state, so each document is one Python call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, i, a, p) for d, t in zip(f["doc_id"], f["text"], strict=True) if t for i, (a, p) in enumerate(packed(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "start", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ordinal int, start int, text string")


def heading_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, begin, heading`` of every line that reads like a heading; ``begin``: its offset in the text."""
    lines = docs.filter(F.col("text").isNotNull()).select("doc_id", F.split("text", "\n").alias("lines"))
    # offsets are sums of lengths within the row, so that no shuffle is needed
    starts = F.aggregate("lines", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x) + 1)))
    rows = lines.select("doc_id", F.posexplode(F.arrays_zip("lines", F.slice(starts, 1, F.size("lines")).alias("at"))).alias("i", "x")).select("doc_id", F.col("x.lines").alias("line"), F.col("x.at").alias("at"))
    return rows.filter(is_heading(F.col("line"))).select("doc_id", (F.col("at") + F.length("line") - F.length(F.ltrim("line"))).alias("begin"), F.trim("line").alias("heading"))


def without_furniture(text: Column, found: Column) -> Column:
    """A page without the lines whose skeleton is furniture; blank lines stay, ends are trimmed."""
    keep = lambda x: (F.trim(x) == "") | ~F.array_contains(found, skeleton(x))
    return F.regexp_replace(F.regexp_replace(F.array_join(F.filter(F.split(text, "\n"), keep), "\n"), r"^\s+", ""), r"\s+$", "")


def stripped_pages(pages: DataFrame, *, by: str = "doc_id", page: str = "page", **how) -> DataFrame:
    """Pages (``by, page, text``) without their document's furniture; a page of nothing else stays, empty."""
    lines = pages.select(by, page, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = furniture(lines, by=by, page=page, **how).groupBy(by).agg(F.collect_set("skeleton").alias("found"))
    whole = pages.join(found, by, "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    return whole.withColumn("text", without_furniture(F.col("text"), F.col("found"))).drop("found")


def joined_pages(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """``doc_id, text, page_starts`` of ``pages(doc_id, page, text)``: pages in order, and where each begins; an empty page
    takes its place."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    starts = F.aggregate("t", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x) + len(separator))))
    docs = pages.groupBy("doc_id").agg(listed.alias("t"))
    return docs.select("doc_id", F.array_join("t", separator).alias("text"), F.slice(starts, 1, F.size("t")).alias("page_starts"))


class Elements(HTMLParser):
    """Headings, texts and table rows of a page in reading order. No text is lost: what stands in no known block is a text
    of its own, and blocks and cells that are never closed end where the next begins."""

    BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form header hr html li main nav ol p pre section summary table tbody tfoot thead title tr ul br".split()) | {f"h{i}" for i in range(1, 7)}

    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.kind = "text"
        self.row: list[str] | None = None
        self.skip = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if self.kind == "cell" and self.row is not None:
            if text == "%" and self.row:  # a lone percent sign belongs to the figure before it
                self.row[-1] += "%"
            else:
                self.row.append(text)
        elif text:
            self.found.append((self.kind, text))
        self.kind = "text"

    def end_row(self) -> None:
        self.flush()
        if self.row and any(self.row):
            self.found.append(("row", " | ".join(self.row)))
        self.row = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style")
        if tag in ("td", "th"):
            self.flush()
            self.row = [] if self.row is None else self.row
            self.kind = "cell"
        elif tag in ("tr", "table"):
            self.end_row()
            self.row = [] if tag == "tr" else None
        elif tag in self.BLOCKS and self.kind != "cell":
            self.flush()
            self.kind = "heading" if tag[0] == "h" and tag[1:].isdigit() else "title" if tag == "title" else "text"
        elif tag in self.BLOCKS:
            self.parts.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in ("td", "th"):
            self.flush()
        elif tag in ("tr", "table"):
            self.end_row()
        elif tag in self.BLOCKS:
            self.parts.append(" ") if self.kind == "cell" else self.flush()

    def close(self) -> None:
        super().close()
        self.end_row()


def html_elements(pages: DataFrame) -> DataFrame:
    """``page_id, pos, kind, text`` of every page's elements."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for page, html in zip(f["page_id"], f["html"], strict=True):
                parser = Elements()
                parser.feed(html or "")
                parser.close()
                rows += [(page, i, k, t) for i, (k, t) in enumerate(parser.found)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "kind", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos int, kind string, text string")


def equal_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, first_id`` of documents whose text an earlier one has, by SHA-256."""
    hashed = docs.filter(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return joined_by_size(hashed, first.persist(), ["h"], "n").filter("doc_id <> first_id").select("doc_id", "first_id")
