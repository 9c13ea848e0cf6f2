"""Exports inside documents: XML, HTML tables, Word, Excel and archives of all kinds.

Formats that Spark doesn't read are parsed with the standard library, a file in a task."""

from __future__ import annotations

import atexit
import io
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..operators.cycles import merge_or_stack
from ..operators.sinks import save
from . import text as S
from .text import SourceError

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_ERRORS = {"#REF!", "#N/A", "#VALUE!", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!"}


class _Tables(HTMLParser):
    """Cells of all tables of a page; a table inside a cell is a table of its own."""

    def __init__(self):
        super().__init__()
        self.tables, self.open, self.cell = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append(self.tables[-1])
            self.cell.append(None)
        elif self.open and tag == "tr":
            self._end()
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            self._end()
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell[-1] = []
        elif tag == "br" and self.cell and self.cell[-1] is not None:
            self.cell[-1].append("\n")

    def _end(self):
        if self.cell and self.cell[-1] is not None:
            self.open[-1][-1].append(" ".join("".join(self.cell[-1]).split()))
            self.cell[-1] = None

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag in ("td", "th", "tr"):
            self._end()
        elif tag == "table":
            self._end()
            self.open.pop(), self.cell.pop()

    def handle_data(self, data):
        if self.cell and self.cell[-1] is not None:
            self.cell[-1].append(data)


def html_tables(content: str) -> list[list[list[str]]]:
    p = _Tables()
    p.feed(content)
    p.close()
    return [t for t in ([r for r in t if r] for t in p.tables) if t]


def word_tables(content: bytes) -> tuple[list[list[list[str]]], list[str]]:
    """Tables and paragraphs of a Word file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    say = lambda e: "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in e.iter(f"{_W}p")).strip()
    tables = [[[say(c) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")] for t in body.findall(f"{_W}tbl")]
    return [t for t in tables if t], ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.findall(f"{_W}p")]


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def excel_sheets(content: bytes) -> list[tuple[str, list[list[str | None]]]]:
    """Sheets of a workbook as rows of text; merged cells hold their first cell's value, errors of formulas none."""
    return list(each_sheet(content))


def each_sheet(content: bytes) -> Iterator[tuple[str, list[list[str | None]]]]:
    """``excel_sheets``, one after the other; of a sheet's elements no more than a row's are held."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_X}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_X}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet"):
            target = links[sheet.get(f"{_R}id")].lstrip("/")
            cells: dict[int, dict[int, str]] = {}
            merged, i, rows = [], 0, None
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                for event, e in ElementTree.iterparse(f, ("start", "end")):
                    if event == "start":
                        rows = e if e.tag == f"{_X}sheetData" else rows
                    elif e.tag == f"{_X}mergeCell":
                        merged.append(e.get("ref"))
                    elif e.tag == f"{_X}row":
                        found = {}
                        for j, c in enumerate(e.findall(f"{_X}c")):
                            v = c.find(f"{_X}v")
                            text = "".join(t.text or "" for t in c.iter(f"{_X}t")) if c.get("t") == "inlineStr" else shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else None
                            if c.get("t") == "b" and text is not None:
                                text = "True" if text == "1" else "False"
                            if text not in (None, "") and text not in _ERRORS:
                                found[_column(c.get("r")) if c.get("r") else j] = text
                        if found:
                            cells.setdefault(int(e.get("r", i + 1)) - 1, {}).update(found)
                        i += 1
                        (e if rows is None else rows).clear()
            for ref in merged:
                a, _, b = ref.partition(":")
                (r1, c1), (r2, c2) = ((int(re.search(r"\d+", x)[0]) - 1, _column(x)) for x in (a, b or a))
                if c1 in cells.get(r1, {}):
                    for r in range(r1, r2 + 1):
                        for c in range(c1, c2 + 1):
                            cells.setdefault(r, {}).setdefault(c, cells[r1][c1])
            if cells:
                height, width = max(cells) + 1, max(map(max, cells.values())) + 1
                none: dict[int, str] = {}
                yield sheet.get("name"), [[cells.get(r, none).get(c) for c in range(width)] for r in range(height)]


#: Rows of a parsed table that are handed on at once.
ROWS = 20_000


def _parsed(spark: SparkSession, path: str, parse) -> DataFrame:
    """at (the table's number), name, line_no, cells of what ``parse`` (content -> [(name, rows)]) finds in a file."""

    def rows(frames):
        for f in frames:
            for content in f["content"]:
                for k, (name, table) in enumerate(parse(bytes(content))):
                    for first in range(0, len(table), ROWS):
                        some = table[first : first + ROWS]
                        yield pd.DataFrame({"at": k, "name": name, "line_no": range(first, first + len(some)), "cells": some})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "at int, name string, line_no long, cells array<string>")


def _by_name(raw: DataFrame, headers, by: str = "name") -> dict[str, DataFrame]:
    """The tables of a parsed file, by name: names are metadata and come to the driver.

    A file is parsed once: what was found is kept in the shared folder."""
    path = f"{shared_folder(raw.sparkSession)}/tables"
    raw.write.parquet(path)
    raw, out = raw.sparkSession.read.schema(raw.schema).parquet(path), {}
    for r in raw.groupBy("name").agg(F.min("at").alias("at")).orderBy(by).collect():
        out[r.name] = S.grid(raw.where(F.col("name") == r.name).select("line_no", "cells"), headers)
    return out


def html(spark: SparkSession, path: str, headers: dict[str, list[str]] | None = None) -> DataFrame:
    """Of a page's tables the one whose first rows look most like headers."""
    head = S.sniff_encoding(S.first_bytes(spark, path))
    raw = _parsed(spark, path, lambda c: [(f"{k:06}", t) for k, t in enumerate(html_tables(c.decode(head, errors="replace")))])
    known = sorted(H.known_names(headers))
    names = F.size(F.filter("cells", lambda c: H.squeezed_column(c).isin(known)))
    best = raw.where("line_no < 3").groupBy("name").agg(F.max(names).alias("n")).orderBy(F.desc("n"), "name").first()
    if best is None:
        raise SourceError(f"no table in {path}")
    name = best.name
    return S.grid(raw.where(F.col("name") == name).select("line_no", "cells"), headers)


def docx(spark: SparkSession, path: str, headers: dict[str, list[str]] | None = None) -> DataFrame:
    """A Word file's tables, merged where they share logins and stacked where not; else its text."""
    from ..operators.standard import standardise

    raw = _parsed(spark, path, lambda c: [(f"table {k + 1}", t) for k, t in enumerate(word_tables(c)[0])])
    tables = {n: standardise(t, headers).df for n, t in _by_name(raw, headers).items()}
    if tables:
        return next(iter(tables.values())) if len(tables) == 1 else merge_or_stack(tables, names_are_systems=False)
    body = _parsed(spark, path, lambda c: [("text", [[p] for p in word_tables(c)[1]])])
    rows = body.select("line_no", F.get("cells", F.lit(0)).alias("line"))
    top = [r.line for r in rows.orderBy("line_no").limit(50).collect()]
    d = S.sniff_delimiter("\n".join(x or "" for x in top))
    return S.delimited(rows, d, headers) if d else S.fixed_width(rows, headers)


def xlsx(spark: SparkSession, path: str, headers: dict[str, list[str]] | None = None, default_system: str | None = None) -> DataFrame:
    """All sheets of a workbook, stacked; the system is the row's, else the sheet's name where there are several."""
    from ..operators.standard import standardise, with_system

    sheets = _by_name(_parsed(spark, path, each_sheet), headers)
    if not sheets:
        raise SourceError(f"no rows in {path}")
    out = None
    for name, t in sheets.items():
        t = with_system(standardise(t, headers).df, name if len(sheets) > 1 else default_system or name)
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def sheets(spark: SparkSession, path: str, headers: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The sheets of a workbook by name, in its order, with their own columns."""
    return _by_name(_parsed(spark, path, each_sheet), headers, "at")


def xml(spark: SparkSession, path: str) -> DataFrame:
    """Repeated elements: the tag that repeats right below the root; attributes and children as text columns."""
    content = S.decoded(S.first_bytes(spark, path, 1 << 16))
    tags = re.findall(r"<([A-Za-z_][\w.-]*)[\s/>]", re.sub(r"<[?!][^>]*>", "", content))
    if len(tags) < 2:
        raise SourceError(f"no repeated elements in {path}")
    df = spark.read.format("xml").options(rowTag=tags[1], attributePrefix="", inferSchema="false").load(path)
    return S.flatten(df).withColumn("line_no", F.monotonically_increasing_id())


READERS = {".csv": S.csv, ".txt": S.text, ".tsv": S.csv, ".html": html, ".htm": html, ".docx": docx, ".xlsx": xlsx, ".xlsm": xlsx}
PLAIN = {".json": S.json, ".xml": xml, ".ldif": S.ldif, ".ldf": S.ldif}
#: Formats that need a library which isn't part of this package: suffix, what to install a reader for.
EXTRA = {".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image", ".tif": "image", ".tiff": "image"}
PLUGINS: dict = {}


def load(spark: SparkSession, path: str, headers: dict[str, list[str]] | None = None, default_system: str | None = None, learned: dict[str, str] | None = None, strict: bool = True, fill_system: bool = True) -> DataFrame:
    """A file of any known format in the canonical schema.

    Read by suffix, headers found and matched, dates detected, names and logins made up
    where the file has parts of them, logins that name no one replaced by an identity, the
    system filled (the file's name by default), rows of one permission or role each
    collapsed, blank rows dropped; required fields are checked if ``strict``."""
    from ..operators import standard as N
    from ..operators.cycles import collapse_permissions

    name = PurePosixPath(path.replace("\\", "/"))
    suffix = name.suffix.lower()
    system = default_system or name.stem
    if suffix == ".zip":
        return archive(spark, path, headers, system, learned)
    if suffix in READERS:
        raw = READERS[suffix](spark, path, headers)
    elif suffix in PLAIN:
        raw = PLAIN[suffix](spark, path)
    elif suffix in EXTRA:
        if EXTRA[suffix] not in PLUGINS:
            raise SourceError(f"no reader for {suffix}: put a function (spark, path) -> DataFrame into PLUGINS[{EXTRA[suffix]!r}]")
        raw = PLUGINS[EXTRA[suffix]](spark, path).withColumn("_ocr_source", F.lit(EXTRA[suffix] == "image"))
    else:
        raise SourceError(f"unknown format {suffix!r}")
    order = raw.select("line_no") if "line_no" in raw.columns else None
    done = N.standardise(raw, headers, learned).df
    done = N.detect_dates(done)
    done = N.specific_login(N.full_name(N.login_from_home(done)))
    done = N.without_blank_rows(done, leaving=("line_no", "_ocr_source"))
    done = N.with_system(done, system) if fill_system else done
    many = next((c for c in ("user_rights", "role") if c in done.columns), None)
    if suffix not in (".xlsx", ".xlsm") and many and "username" in done.columns and order is not None and "line_no" in done.columns:
        done = collapse_permissions(done, many)
    N.validate(done, strict=strict)
    return done


def shared_folder(spark: SparkSession) -> str:
    """A new folder where every executor finds files: in ``spark.checkpoint.dir``; a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise SourceError("set spark.checkpoint.dir to a folder that all executors share")
        if not hasattr(spark, "_tallyward_unpacked"):
            folder = tempfile.mkdtemp(prefix="tallyward-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            spark._tallyward_unpacked = "file://" + folder
        base = spark._tallyward_unpacked
    return f"{base.rstrip('/')}/unpacked-{uuid.uuid4().hex}"


def archive(spark: SparkSession, path: str, headers=None, default_system: str = "archive", learned=None) -> DataFrame:
    """All readable members of the ZIPs that ``path`` matches, each loaded by its format, merged or stacked; bad members are left out.

    Members go by their full names, and by their archive's where there are several; as
    systems, by as much of them as tells them apart. They are unpacked through Spark's own
    file system to a shared folder, which is deleted where no member can be read and else
    stays as long as the table is read (``remove_unpacked``)."""
    base = shared_folder(spark)
    found = spark.read.format("binaryFile").load(path).select("path", "content").orderBy("path")
    tables: dict[str, DataFrame] = {}
    at = 0
    members = []
    for row in found.toLocalIterator():  # one archive at a time
        with zipfile.ZipFile(io.BytesIO(bytes(row.content))) as z:
            for member in z.namelist():
                suffix = PurePosixPath(member).suffix.lower()
                if member.endswith("/") or suffix not in READERS and suffix not in PLAIN:
                    continue
                target = f"{base}/{at}/{PurePosixPath(member).name}"
                at += 1
                save(spark, target, z.read(member))
                members.append((PurePosixPath(row.path).stem, PurePosixPath(member), target))
    names = system_names([(PurePosixPath(a) / m.with_suffix("")).parts for a, m, _ in members])
    for name, (_, _, target) in zip(names, members):
        try:
            tables[name] = load(spark, target, headers, name, learned, strict=False, fill_system=False)
        except (SourceError, PySparkException, ValueError):
            continue
    if not tables:
        remove_unpacked(spark, base)
        raise SourceError(f"no readable member in {path}")
    out = merge_or_stack(tables, default_system=default_system)
    out._tallyward_unpacked = base
    return out


def put_archive(spark: SparkSession, path: str, members: dict[str, str]) -> None:
    """A ZIP of texts, through Spark's own file system."""
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)
    save(spark, path, f.getvalue())


def remove_unpacked(spark: SparkSession, folder: str) -> None:
    """Delete the folder (``_tallyward_unpacked`` of an archive's table) once the table isn't read any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def system_names(paths: list[tuple[str, ...]]) -> list[str]:
    """A name for each path: its last part, with as many parts before it as tell it from the others; equal paths are numbered."""
    out = []
    for p in paths:
        k = 1
        while k < len(p) and sum(q[-k:] == p[-k:] for q in paths) > 1:
            k += 1
        out.append("/".join(p[-k:]))
    seen: dict[str, int] = {}
    for i, name in enumerate(out):
        seen[name] = seen.get(name, 0) + 1
        if seen[name] > 1:
            out[i] = f"{name} ({seen[name]})"
    return out
