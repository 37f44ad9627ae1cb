"""Spreadsheets, images and their sinks, by built-in readers and the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice, product
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.contents import normal_cells

CELLS = "content_id string, row_no int, col_no int, cell_value string"
#: Cells of a grid that are made at once.
GRID_ROWS = 50_000
_REF = re.compile(r"([A-Z]+)([0-9]+)")


def sheet_cells(data: bytes) -> list[tuple[int, int, str]]:
    """(row, column, text) of the first sheet of an xlsx file; empty cells are left out. Not a workbook: no cells."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        names = book.namelist()
        name = next(n for n in sorted(names) if n.startswith("xl/worksheets/sheet"))
    except (zipfile.BadZipFile, StopIteration):
        return []
    shared = []
    if "xl/sharedStrings.xml" in names:
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind("{*}si"):
            shared.append("".join(t.text or "" for t in item.iter() if t.tag.endswith("}t")))
    out = []
    for c in ElementTree.fromstring(book.read(name)).iter():
        if not c.tag.endswith("}c"):
            continue
        m, v = _REF.match(c.get("r", "")), c.find("{*}v")
        if c.get("t") == "inlineStr":
            text = "".join(t.text or "" for t in c.iter() if t.tag.endswith("}t"))
        elif v is None or v.text is None:
            continue
        else:
            text = shared[int(v.text)] if c.get("t") == "s" else v.text
        if m:
            col = 0
            for letter in m[1]:
                col = col * 26 + ord(letter) - 64
            out.append((int(m[2]) - 1, col - 1, text))
    return out


def read_xlsx(spark: SparkSession, path: str, whole_path: bool = False) -> DataFrame:
    """Cells of all xlsx files of a folder in long form, without a header; content_id is the file's name without its end,
    or its whole path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf.path, pdf.content):
                name = p if whole_path else p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                # Gaps within the table's extent are null, as merged cells leave them; they are made a piece at a time.
                by = {(r, c): v for r, c, v in sheet_cells(bytes(data))}
                grid = product(range(max((r for r, _ in by), default=-1) + 1), range(max((c for _, c in by), default=-1) + 1))
                while piece := [(name, *at, by.get(at)) for at in islice(grid, GRID_ROWS)]:
                    yield pd.DataFrame(piece, columns=["content_id", "row_no", "col_no", "cell_value"])

    return files.select("path", "content").mapInPandas(run, CELLS)


def of_contents(files: DataFrame, contents: DataFrame, bundles: DataFrame, path: str = "path") -> DataFrame:
    """files (path, ...) with the content_id of the content that each file is, instead of its path.

    The path of a content is relative to the folder of its bundle's file (bundles: bundle_id, filename).
    """
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*", "/")
    folder = bundles.select(F.col("bundle_id").alias("doc_id"), F.regexp_replace("filename", "[^/]*$", "").alias("folder"))
    place = contents.select("doc_id", "content_id", F.col("path").alias("file")).join(folder, "doc_id")
    place = place.select("content_id", plain(F.concat("folder", "file")).alias("_file")).dropDuplicates()
    return files.withColumn("_file", F.regexp_replace(path, "^[a-z]+:/*", "/")).drop(path).join(place, "_file").drop("_file")


def tables_as_tsv(cells: DataFrame) -> DataFrame:
    """(content_id, value): normalised tables as tab-separated text without header."""
    rows = normal_cells(cells).groupBy("content_id", "row_no").agg(F.sort_array(F.collect_list(F.struct("col_no", F.coalesce("value", F.lit("")).alias("v")))).alias("x"))
    rows = rows.select("content_id", "row_no", F.concat_ws("\t", "x.v").alias("line"))
    return rows.groupBy("content_id").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("row_no", "line"))), lambda r: r["line"])).alias("value"))


def write_tsv(cells: DataFrame, path: str) -> None:
    """One folder per table under path, each with its text."""
    tables_as_tsv(cells).write.partitionBy("content_id").mode("overwrite").text(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, n_bands, one_colour): one_colour if the variance of any of the first three bands is below 1."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(np.float64)
                flat = any(int(a[:, :, k].var()) == 0 for k in range(min(3, r.nChannels)))
                rows.append((r.origin, r.width, r.height, r.nChannels, flat))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "n_bands", "one_colour"])

    return images.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").mapInPandas(
        run, "path string, width int, height int, n_bands int, one_colour boolean"
    )
