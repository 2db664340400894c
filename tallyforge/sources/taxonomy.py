"""Labels of taxonomy packages: zipped linkbases whose locators, arcs and labels are joined to concept, role and label."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.lookup import labels_merged

LINK = "{http://www.w3.org/1999/xlink}"
SCHEMA = "package string, member string, kind string, a string, b string, role string, text string"


def linkbase(data: bytes) -> Iterator[tuple[str, str, str, str | None, str | None]]:
    """(kind, a, b, role, text): ``loc`` of a label to its concept, ``arc`` from a locator to a resource, ``label`` of one."""
    for x in ET.fromstring(data).iter():
        tag = x.tag.rsplit("}", 1)[-1]
        at = lambda name, x=x: x.get(f"{LINK}{name}", "")
        if tag == "loc":  # a fragment is prefix_Element, and no prefix has an underscore
            yield "loc", at("label"), at("href").split("#", 1)[-1].split("_", 1)[-1], None, None
        elif tag == "labelArc":
            yield "arc", at("from"), at("to"), None, None
        elif tag == "label" and (text := " ".join((x.text or "").split())):
            yield "label", at("label"), "", at("role").rsplit("/", 1)[-1], text


def parts(packages: DataFrame) -> DataFrame:
    """Locators, arcs and labels of all label files in ``packages(package, content)``, whose names hold ``lab``."""
    kinds = pa.schema([(c.split()[0], pa.string()) for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with zipfile.ZipFile(io.BytesIO(row["content"])) as archive:
                    for member in sorted(archive.namelist()):
                        name = member.rsplit("/", 1)[-1]
                        if name.endswith(".xml") and "lab" in name:
                            found = [(row["package"], member, *x) for x in linkbase(archive.read(member))]
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)] or [pa.array([], pa.string())] * 7, schema=kinds)

    return packages.select("package", "content").mapInArrow(run, SCHEMA)


def labels(packages: DataFrame) -> DataFrame:
    """``package, concept, role, label``: arcs joined with their locators and labels, file by file."""
    p = parts(packages)
    one = lambda kind, *names: p.filter(F.col("kind") == kind).select("package", "member", *names)
    locs = one("loc", F.col("a").alias("from"), F.col("b").alias("concept"))
    arcs = one("arc", F.col("a").alias("from"), F.col("b").alias("to"))
    texts = one("label", F.col("a").alias("to"), "role", F.col("text").alias("label"))
    keys = ["package", "member"]
    return arcs.join(locs, [*keys, "from"]).join(texts, [*keys, "to"]).select("package", "concept", "role", "label").distinct()


def merged(packages: DataFrame, order: list[str]) -> DataFrame:
    """``concept, label, aliases`` over packages in order of priority; concepts without a standard label have none."""
    places = F.create_map(*[F.lit(x) for i, name in enumerate(order) for x in (name, i)])
    rows = labels(packages).select(F.try_element_at(places, F.col("package")).alias("ord"), "concept", F.when(F.col("role") == "label", "standard").otherwise(F.col("role")).alias("role"), "label").filter("ord IS NOT NULL")
    return labels_merged(rows).filter("label IS NOT NULL")


def checked(files: DataFrame, manifest: DataFrame, names: list[str]) -> DataFrame:
    """Cached packages (``package, content``) of the names; one that isn't there, or whose SHA-256 isn't the manifest's, is an
    error."""
    wanted = files.sparkSession.createDataFrame([(n,) for n in names], "package string")
    rows = wanted.join(files, "package", "left").join(manifest.select(F.col("name").alias("package"), "sha256"), "package", "left")
    why = F.when(F.col("content").isNull() | F.col("sha256").isNull(), F.concat(F.lit("not cached: "), "package")).when(F.sha2("content", 256) != F.col("sha256"), F.concat(F.lit("its SHA-256 is not the manifest's: "), "package"))
    bad = rows.select(why.alias("why")).filter("why IS NOT NULL").orderBy("why").first()  # few packages
    if bad:
        raise ValueError(bad.why)
    return rows.select("package", "content")
