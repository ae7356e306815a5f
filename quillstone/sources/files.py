"""Directories of PDF, HWP and HWPX files as DataFrames: a row per page or file, and an error instead of an exception.

Files are read by Spark (binaryFile), so any file system that it knows will do, and parsed where they are read. Parsers are
looked up by extension; those that need a library that isn't installed make error rows. A parser gives a list of pages, each a
text or a text and its tables. It runs in a child of the task, so that a file that takes too long or ends its process costs a row.
"""

from __future__ import annotations

import hashlib
import multiprocessing
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import closing
from io import BytesIO
from itertools import batched
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, strip_control, table_markdown, url_basename
from ..functions.udfs import normal_form
from . import containers
from .grids import Cell, Grid, grid

# Types of records in HWP's body, and the text that stands before the tables of a page.
TEXT_TAG, LIST_TAG, TABLE_TAG = 67, 72, 77
TABLES_BELOW = "\n\n[Table]\n"

#: A page with fewer characters than this is one for OCR.
OCR_BELOW = 50
#: Seconds that a file may take.
LIMIT = 120.0
#: Files that are parsed and entered in the ledger together.
SLICE = 10_000

Page = str | tuple[str, list[Grid]]
Parser = Callable[[bytes], list[Page]]


def records(data: bytes, compressed: bool) -> Iterator[tuple[int, int, bytes, bool]]:
    """Type, level, body and whether the body is whole of a section's records: a 4-byte head has the type in its low 10 bits, the
    level in 10 and the length in the high 12; a length of all ones stands in the 4 bytes after the head."""
    if compressed:
        data = zlib.decompress(data, -15)
    at = 0
    while at + 4 <= len(data):
        (head,) = struct.unpack_from("<I", data, at)
        at += 4
        size = head >> 20
        if size == 0xFFF and at + 4 <= len(data):
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        body = data[at : at + size]
        yield head & 0x3FF, head >> 10 & 0x3FF, body, len(body) == size
        at += size


def record_texts(data: bytes, compressed: bool) -> Iterator[str]:
    """Texts of a body section."""
    for tag, _, body, whole in records(data, compressed):
        if tag == TEXT_TAG:
            if not whole:
                return
            try:
                yield body.decode("utf-16")
            except UnicodeDecodeError:
                pass  # one record's loss


def _plain(body: bytes) -> str:
    """A paragraph without its controls, which take one unit or eight."""
    units = struct.unpack(f"<{len(body) // 2}H", body[: len(body) // 2 * 2])
    kept, at = [], 0
    while at < len(units):
        u = units[at]
        wide = 0 < u < 24 and u not in (10, 13)
        if u >= 32 or u in (9, 10):
            kept.append(u)
        at += 8 if wide else 1
    return struct.pack(f"<{len(kept)}H", *kept).decode("utf-16-le", "replace")


def record_tables(data: bytes, compressed: bool) -> list[list[Cell]]:
    """Cells of a section's tables. A table's record and the lists of its cells have one level; a lower one ends the table. The text of
    a table inside a cell is the outer cell's too."""
    tables: list[list[tuple[int, int, int, int, list[str]]]] = []
    around: list[tuple[int, list]] = []
    for tag, level, body, _ in records(data, compressed):
        while around and level < around[-1][0]:
            around.pop()
        if tag == TABLE_TAG:
            tables.append([])
            around.append((level, tables[-1]))
        elif tag == LIST_TAG and around and level == around[-1][0] and len(body) >= 16:
            column, row, columns, rows = struct.unpack_from("<4H", body, 8)
            around[-1][1].append((row, column, rows, columns, []))
        elif tag == TEXT_TAG:
            for _, cells in around:
                if cells:
                    cells[-1][4].append(_plain(body).strip())
    return [[(*c[:4], "\n".join(x for x in c[4] if x)) for c in cells] for cells in tables]


def read_hwp(data: bytes) -> list[tuple[str, list[Grid]]]:
    """One text and its tables per file."""
    found = containers.streams(data)
    if "FileHeader" not in found or "\x05HwpSummaryInformation" not in found:
        raise ValueError("not a HWP file")
    compressed = bool(found["FileHeader"]()[36] & 1)
    sections = sorted((n for n in found if re.fullmatch(r"BodyText/Section\d+", n)), key=lambda n: int(n[16:]))
    texts, tables = [], []
    for n in sections:
        body = found[n]()
        try:
            texts.append("\n".join(record_texts(body, compressed)))
            tables += [grid(cells) for cells in record_tables(body, compressed)]
        except zlib.error:
            continue  # one section's loss
    return [("\n".join(texts), tables)]


def parse_hwp(data: bytes) -> list[str]:
    """One text per file."""
    return [text for text, _ in read_hwp(data)]


def _kind(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _lines(part: ElementTree.Element) -> list[str]:
    lines: list[str] = []
    for e in part.iter():
        if _kind(e) == "p":
            lines.append("")
        elif _kind(e) == "t" and lines:
            lines[-1] += "".join(e.itertext())
    return [x for x in lines if x]


def _cells(table: ElementTree.Element) -> list[Cell]:
    """Cells by their addresses; those without one by the order of rows and of cells in a row."""
    out: list[Cell] = []
    for r, line in enumerate(e for e in table if _kind(e) == "tr"):
        for c, cell in enumerate(e for e in line if _kind(e) == "tc"):
            own = {_kind(e): e.attrib for e in cell}
            number = lambda part, key, other: int(own.get(part, {}).get(key, other))  # noqa: B023, E731
            out.append((number("cellAddr", "rowAddr", r), number("cellAddr", "colAddr", c), number("cellSpan", "rowSpan", 1), number("cellSpan", "colSpan", 1), "\n".join(_lines(cell))))
    return out


def read_hwpx(data: bytes) -> list[tuple[str, list[Grid]]]:
    """One text per file, a line for each paragraph, and its tables: the sections of a ZIP of XML, in the order of their numbers. A table
    inside a cell comes after the outer one."""
    with zipfile.ZipFile(BytesIO(data)) as archive:
        numbers = {n: int(m[1]) for n in archive.namelist() if (m := re.fullmatch(r"Contents/section(\d+)\.xml", n))}
        if not numbers:
            raise ValueError("not a HWPX file")
        lines: list[str] = []
        tables: list[Grid] = []
        for name in sorted(numbers, key=numbers.__getitem__):
            try:
                root = ElementTree.fromstring(archive.read(name))
            except ElementTree.ParseError:
                continue  # one section's loss
            lines += _lines(root)
            tables += [grid(_cells(e)) for e in root.iter() if _kind(e) == "tbl"]
    return [("\n".join(lines), tables)]


def parse_hwpx(data: bytes) -> list[str]:
    """One text per file."""
    return [text for text, _ in read_hwpx(data)]


def parse_pdf(data: bytes) -> list[str]:
    """One text per page. Needs pypdf."""
    import pypdf

    return [p.extract_text() or "" for p in pypdf.PdfReader(BytesIO(data)).pages]


PARSERS: dict[str, Parser] = {".pdf": parse_pdf, ".hwp": read_hwp, ".hwpx": read_hwpx}


def _serve(pipe, other, known: dict[str, Parser]) -> None:
    other.close()
    while True:
        try:
            ext, data = pipe.recv()
        except EOFError:
            return
        try:
            pages = [p if isinstance(p, tuple) else (p, []) for p in known[ext](data)]
            reply = (pages, None)
        except Exception as e:  # noqa: BLE001  a file's failure is a row
            reply = ([(None, None)], f"{type(e).__name__}: {e}")
        pipe.send(reply)


class Child:
    """A process that parses file after file. It is ended when a file takes more than its seconds, and begun anew for the next."""

    def __init__(self, known: dict[str, Parser], seconds: float) -> None:
        self.known, self.seconds, self.process, self.pipe = known, seconds, None, None

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None

    def parse(self, ext: str, data: bytes) -> tuple[list, str | None]:
        if self.process is None:
            fork = multiprocessing.get_context("fork")
            self.pipe, theirs = fork.Pipe()
            self.process = fork.Process(target=_serve, args=(theirs, self.pipe, self.known), daemon=True)
            self.process.start()
            theirs.close()
        try:
            self.pipe.send((ext, data))
            if self.pipe.poll(self.seconds):
                return self.pipe.recv()
            error = f"TimeoutError: more than {self.seconds:g} s"
        except (EOFError, OSError):
            error = "ChildProcessError: the parser's process ended"
        self.close()
        return [(None, None)], error


def _files(spark: SparkSession, folder: str, known: dict[str, Parser]) -> DataFrame:
    """Files of known extensions; Spark reads the content of no others, and only where content is selected."""
    either = lambda ext: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("pathGlobFilter", f"*{{{','.join(map(either, known))}}}").load(folder)
    return files.withColumn("ext", extension(F.col("path"))).filter(F.col("ext").isin(list(known)))


def _parsed(files: DataFrame, known: dict[str, Parser], seconds: float) -> DataFrame:
    """files: path, ext, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with closing(Child(known, seconds)) as child:
            for b in batches:
                for path, ext, content in zip(b["path"], b["ext"], b["content"], strict=True):
                    pages, error = child.parse(ext, bytes(content))
                    yield pd.DataFrame({"path": path, "page": range(len(pages)), "text": [t for t, _ in pages], "tables": [g for _, g in pages], "error": error})

    rows = files.mapInPandas(run, "path string, page int, text string, tables array<array<array<string>>>, error string")
    name = normal_form(url_basename(F.col("path")))
    text = F.when(extension(F.col("path")).isin(".hwp", ".hwpx"), strip_control(F.col("text"))).otherwise(F.col("text"))
    return rows.select(F.col("path").alias("source"), name.alias("file_name"), F.ltrim(extension(F.col("path")), F.lit(".")).alias("file_type"), "page", text.alias("text"), (F.length("text") < OCR_BELOW).alias("needs_ocr"), "tables", "error")


def load(spark: SparkSession, folder: str, parsers: dict[str, Parser] | None = None, seconds: float = LIMIT) -> DataFrame:
    """source, file_name, file_type, page (from 0), text, needs_ocr, tables, error of every file that a parser is known for."""
    known = PARSERS if parsers is None else parsers
    return _parsed(_files(spark, folder, known).select("path", "ext", "content"), known, seconds)


def with_tables(text: Column, tables: Column) -> Column:
    """A page's text and, if it has tables, these below as Markdown."""
    below = F.array_join(F.transform(tables, table_markdown), "\n\n")
    return F.when(F.size(tables) > 0, F.concat(F.coalesce(text, F.lit("")), F.lit(TABLES_BELOW), below)).otherwise(text)


LEDGER = "source string, length bigint, modified timestamp, pages bigint, characters bigint, error string, finished timestamp, slice string"
PAGES = "source string, file_name string, file_type string, page int, text string, needs_ocr boolean, tables array<array<array<string>>>, error string, slice string"


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """A row for each file and each of its states that sync has parsed."""
    return spark.read.schema(LEDGER).parquet(f"{out}/ledger")


def sync(spark: SparkSession, folder: str, out: str, parsers: dict[str, Parser] | None = None, seconds: float = LIMIT, slice_files: int = SLICE, retry: bool = False) -> DataFrame:
    """Parses the files of folder whose path, length and time out's ledger doesn't have, and returns their rows of the ledger.

    Files go in slices; the pages of one are written to a folder named by its files, then the slice is entered in the ledger. A run that
    is cut off goes on behind the last slice that it entered: current() reads no pages but those of the ledger. The driver holds the
    names of one slice. retry: whether files with an error are parsed again. Files that are gone stay in the ledger.
    """
    known = PARSERS if parsers is None else parsers
    files = _files(spark, folder, known)
    spark.createDataFrame([], LEDGER).write.mode("ignore").partitionBy("slice").parquet(f"{out}/ledger")
    done = ledger(spark, out)
    state = ["source", "length", "modified"]
    there = files.select(F.col("path").alias("source"), "length", F.col("modificationTime").alias("modified"), F.col("_metadata.file_path").alias("uri"))
    left = there.join(done.filter("error IS NULL" if retry else "true").select(state), state, "left_anti").orderBy("source")
    entered: list[str] = []
    for rows in batched(left.toLocalIterator(), slice_files):
        name = hashlib.sha256("\n".join(str([r[c] for c in state]) for r in rows).encode()).hexdigest()[:32]
        own = files.filter(F.col("_metadata.file_path").isin([r["uri"] for r in rows])).select("path", "ext", "content")
        target = f"{out}/pages/slice={name}"
        _parsed(own, known, seconds).write.mode("overwrite").parquet(target)
        counted = spark.read.schema(PAGES.rpartition(",")[0]).parquet(target).groupBy("source").agg(
            F.count("text").alias("pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.min("error").alias("error"))
        listed = spark.createDataFrame([tuple(r[c] for c in state) for r in rows], "source string, length bigint, modified timestamp")
        listed.join(counted, "source").withColumn("finished", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/ledger/slice={name}")
        entered.append(name)
    return ledger(spark, out).filter(F.col("slice").isin(entered))


def current(spark: SparkSession, out: str) -> DataFrame:
    """Pages of the last state of each file, as load gives them."""
    last = ledger(spark, out).groupBy("source").agg(F.max_by("slice", F.struct("modified", "finished")).alias("slice"))
    return spark.read.schema(PAGES).parquet(f"{out}/pages").join(last, ["source", "slice"]).drop("slice")
