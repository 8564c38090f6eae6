"""Delimited files, workbooks and archives as raw rows, decoded inside Spark tasks.

Each function takes rows that carry a file's bytes, as ``binaryFile`` gives them; one file is
decoded by one task and its rows leave in batches bounded by rows and by bytes.

``decode_files`` and the archive functions give a typed stream: beside its rows every file leaves
exactly one record of its own that says whether it was read, so that no file is lost on the way.
"""

import csv
import hashlib
import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom import fixed

CELL = "struct<s:string,t:string>"
BATCH = 5000
BATCH_BYTES = 1 << 24


def oversized_files(spark: SparkSession, path: str, limit: int = fixed.MAX_SOURCE_BYTES
                    ) -> DataFrame:
    """(path, length) of source files above the size limit; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1))
    return files.where((F.col("length") > limit)
                       & suffix.isin([*fixed.SOURCE_SUFFIXES, ".zip"])).select("path", "length")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of source files up to the size limit; ``oversized_files`` names
    the others."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1))
    return files.where((F.col("length") <= fixed.MAX_SOURCE_BYTES)
                       & suffix.isin([*fixed.SOURCE_SUFFIXES, ".zip"])) \
        .select("path", "length", "content")


def _schema(files: DataFrame, carried: list[str], added: str) -> str:
    kept = ",".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in carried)
    return f"{kept},{added}"


def _weight(value) -> int:
    """Bytes that a value holds, about."""
    if isinstance(value, (str, bytes)):
        return len(value)
    if isinstance(value, list):
        return sum(32 + len(c["s"] or "") for c in value)
    return 8


def decode_rows(files, carried, decode, added, columns, given=()):
    """Run ``decode(content, *given)`` per file, yielding tuples, and send them on in batches."""
    names, picked = [*carried, *columns], [*dict.fromkeys([*carried, *given])]

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for record in batch.to_dict("records"):
                keys = [record[c] for c in carried]
                for row in decode(record["content"], *[record[c] for c in given]):
                    rows.append((*keys, *row))
                    held += sum(map(_weight, row))
                    if len(rows) >= BATCH or held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return files.select(*picked, "content").mapInPandas(run, _schema(files, carried, added))


ROW_SCHEMA = f"sheet string,row_no bigint,cells array<{CELL}>,error string"
ROW_COLUMNS = ["sheet", "row_no", "cells", "error"]


def _text(payload: bytes) -> str:
    if payload[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return payload.decode("utf-16")
    return payload.decode("utf-8-sig")


def _delimited(payload: bytes):
    try:
        text = _text(payload)
    except UnicodeDecodeError:
        yield ("CSV", None, None, "encoding must be UTF-8 or UTF-16 with a byte order mark")
        return
    mark = "\t" if "\t" in text[:fixed.DIALECT_PROBE_CHARS] else ","
    try:
        for number, record in enumerate(csv.reader(io.StringIO(text), delimiter=mark), start=1):
            yield ("CSV", number, [{"s": v, "t": "s"} for v in record], None)
    except csv.Error as error:
        yield ("CSV", None, None, str(error))


def read_delimited(files: DataFrame, carried: list[str]) -> DataFrame:
    """One row per CSV record; ``row_no`` counts records, not lines."""
    return decode_rows(files, carried, _delimited, ROW_SCHEMA, ROW_COLUMNS)


# --- workbooks --------------------------------------------------------------------------

DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attribute(element, name):
    for key, value in element.attrib.items():
        if _local(key) == name:
            return value
    return None


def _xml(archive, name):
    return ET.fromstring(archive.read(name)) if name in archive.namelist() else None


def _strings(archive):
    root = _xml(archive, "xl/sharedStrings.xml")
    if root is None:
        return []
    return [_plain(item) for item in root if _local(item.tag) == "si"]


def _plain(item):
    """Text of a string item without its phonetic runs."""
    parts = []
    for child in item:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(parts)


def _date_styles(archive):
    root = _xml(archive, "xl/styles.xml")
    if root is None:
        return set()
    dated = set(DATE_FORMATS)
    for fmt in root.iter():
        if _local(fmt.tag) == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
            if re.search("[dmyhs]", code, re.IGNORECASE):
                dated.add(int(fmt.get("numFmtId")))
    for group in root:
        if _local(group.tag) == "cellXfs":
            return {i for i, xf in enumerate(group) if int(xf.get("numFmtId", 0)) in dated}
    return set()


def _column(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number


def _cell(cell, strings, dated, epoch):
    kind, value, inline = cell.get("t", "n"), None, None
    for child in cell:
        if _local(child.tag) == "v":
            value = child.text
        elif _local(child.tag) == "is":
            inline = _plain(child)
    if kind == "inlineStr":
        return {"s": inline, "t": "s"}
    if value is None:
        return {"s": None, "t": "null"}
    if kind == "s":
        return {"s": strings[int(value)], "t": "s"}
    if kind == "b":
        return {"s": "True" if value == "1" else "False", "t": "b"}
    if kind == "n" and int(cell.get("s", 0)) in dated:
        moment = epoch + timedelta(days=float(value))
        return {"s": moment.replace(microsecond=0).isoformat(), "t": "d"}
    return {"s": value, "t": "n" if kind == "n" else "s"}


def _workbook(payload: bytes):
    try:
        with zipfile.ZipFile(io.BytesIO(payload)) as archive:
            book = _xml(archive, "xl/workbook.xml")
            links = {r.get("Id"): r.get("Target")
                     for r in _xml(archive, "xl/_rels/workbook.xml.rels")}
            strings, dated = _strings(archive), _date_styles(archive)
            old = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true")
                      for e in book)
            epoch = datetime(1904, 1, 1) if old else datetime(1899, 12, 30)
            sheets = [e for e in book.iter() if _local(e.tag) == "sheet"]
            for sheet in sheets:
                target = links[_attribute(sheet, "id")]
                name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                with archive.open(name) as stream:
                    yield from _sheet_rows(stream, sheet.get("name"), strings, dated, epoch)
    except (zipfile.BadZipFile, ET.ParseError, KeyError, TypeError, ValueError) as error:
        yield (None, None, None, f"unreadable workbook: {type(error).__name__}")


def _sheet_rows(stream, sheet, strings, dated, epoch):
    number, filled = 0, 0
    for _, element in ET.iterparse(stream):
        if _local(element.tag) != "row":
            continue
        number = int(element.get("r", number + 1))
        cells = []
        for cell in element:
            at = _column(cell.get("r")) if cell.get("r") else len(cells) + 1
            cells += [{"s": None, "t": "null"}] * (at - 1 - len(cells))
            cells.append(_cell(cell, strings, dated, epoch))
        element.clear()
        if number - filled > fixed.BLANK_TAIL_ROWS:
            return
        if any(c["s"] is not None and c["s"].strip() for c in cells):
            filled = number
        yield (sheet, number, cells, None)


def read_workbooks(files: DataFrame, carried: list[str]) -> DataFrame:
    """One row per filled row of every sheet: cached values, dates as ISO text.

    Reading of a sheet ends after a hundred blank rows in a row.
    """
    return decode_rows(files, carried, _workbook, ROW_SCHEMA, ROW_COLUMNS)


# --- files of any kind, as a stream of rows and file records ------------------------------

STREAM_SCHEMA = f"record string,sheet string,row_no bigint,cells array<{CELL}>,error string," \
                "n_rows bigint"
STREAM_COLUMNS = ["record", "sheet", "row_no", "cells", "error", "n_rows"]


def _filled(cells) -> bool:
    return any(c["s"] is not None and c["s"].strip() for c in cells)


def _stream(payload: bytes, name: str, probe: bool = False):
    """The rows of one file and then its own record. A probe ends each sheet at the first filled
    row below those that can hold a header, which is enough to classify it."""
    decode = _workbook if _suffix(name) == ".xlsx" else _delimited
    error, n, done = None, 0, set()
    try:
        for sheet, number, cells, problem in decode(payload):
            if problem is not None:
                error = problem
                continue
            if sheet in done:
                continue
            below = number > fixed.HEADER_SCAN_ROWS
            if probe and below and not _filled(cells):
                continue
            n += 1
            yield ("row", sheet, number, cells, None, None)
            if probe and below:
                if decode is _delimited:
                    break
                done.add(sheet)
    except Exception as problem:  # whatever a file does, it is listed and stops nothing
        error = f"{type(problem).__name__}: {problem}"[:1000]
    yield ("file", None, None, None, error, n)


def decode_files(files: DataFrame, carried: list[str], name: str = "file") -> DataFrame:
    """The stream of every file; the column ``name`` tells its format by its suffix."""
    return decode_rows(files, carried, _stream, STREAM_SCHEMA, STREAM_COLUMNS, [name])


# --- archives ---------------------------------------------------------------------------

MEMBER_SCHEMA = "nested string,member string,content binary,error string"
MEMBER_COLUMNS = ["nested", "member", "content", "error"]


def _wanted(info):
    base = info.filename.rsplit("/", 1)[-1]
    return not (info.is_dir() or info.filename.startswith("__MACOSX/") or base.startswith("._"))


def _suffix(name):
    base = name.rsplit("/", 1)[-1]
    return base[base.rfind("."):].lower() if "." in base[1:] else ""


def _members(payload: bytes, nested=None):
    try:
        archive = zipfile.ZipFile(io.BytesIO(payload))
    except zipfile.BadZipFile:
        yield (nested, None, None, "not a readable archive")
        return
    with archive:
        for info in archive.infolist():
            if not _wanted(info):
                continue
            suffix = _suffix(info.filename)
            inner = suffix == ".zip" and nested is None
            if not inner and suffix not in fixed.SOURCE_SUFFIXES:
                continue
            if info.flag_bits & 1 or info.file_size > fixed.MAX_SOURCE_BYTES:
                yield (info.filename if inner else nested, None, None, "encrypted or too large")
            elif inner:
                yield from _members(archive.read(info), info.filename)
            else:
                yield (nested, info.filename, archive.read(info), None)


def expand_archives(files: DataFrame, carried: list[str]) -> DataFrame:
    """Source files inside each archive and inside the archives it holds, one level deep."""
    return decode_rows(files, carried, _members, MEMBER_SCHEMA, MEMBER_COLUMNS)


LEVEL_SCHEMA = f"nested string,member string,{STREAM_SCHEMA}"
LEVEL_COLUMNS = ["nested", "member", *STREAM_COLUMNS]


def _level(archive, nested, probe):
    """The streams of the source files of one archive level."""
    for info in archive.infolist():
        if not _wanted(info) or _suffix(info.filename) not in fixed.SOURCE_SUFFIXES:
            continue
        if info.flag_bits & 1:
            problem = "encrypted"
        elif info.file_size > fixed.MAX_SOURCE_BYTES:
            problem = "larger than the size limit"
        else:
            try:
                payload, problem = archive.read(info), None
            except Exception as error:
                problem = f"{type(error).__name__}: {error}"[:1000]
        if problem is not None:
            yield (nested, info.filename, "file", None, None, None, problem, 0)
            continue
        for item in _stream(payload, info.filename, probe):
            yield (nested, info.filename, *item)


def _nested(archive):
    """(name, payload or None, problem) of the archives inside an archive, one at a time."""
    for info in archive.infolist():
        if not _wanted(info) or _suffix(info.filename) != ".zip":
            continue
        if info.flag_bits & 1 or info.file_size > fixed.MAX_SOURCE_BYTES:
            yield info.filename, None, "encrypted or larger than the size limit"
            continue
        try:
            yield info.filename, archive.read(info), None
        except Exception as error:
            yield info.filename, None, f"{type(error).__name__}: {error}"[:1000]


def _probe(payload: bytes):
    """Header probes of all levels. A level that cannot be opened leaves a file record without
    a member."""
    try:
        outer = zipfile.ZipFile(io.BytesIO(payload))
    except Exception as error:
        yield (None, None, "file", None, None, None, f"{type(error).__name__}: {error}"[:1000], 0)
        return
    with outer:
        yield from _level(outer, None, True)
        for name, inner, problem in _nested(outer):
            try:
                if problem is None:
                    with zipfile.ZipFile(io.BytesIO(inner)) as archive:
                        yield from _level(archive, name, True)
            except zipfile.BadZipFile as error:
                problem = str(error)
            if problem is not None:
                yield (name, None, "file", None, None, None, problem, 0)


def probe_archives(files: DataFrame, carried: list[str]) -> DataFrame:
    """The streams of all members of all levels, each cut off where it can be classified."""
    return decode_rows(files, carried, _probe, LEVEL_SCHEMA, LEVEL_COLUMNS)


def _chosen(payload: bytes, nested):
    nested = nested if isinstance(nested, str) else None
    with zipfile.ZipFile(io.BytesIO(payload)) as archive:
        if nested is not None:
            payload = archive.read(nested)
    with zipfile.ZipFile(io.BytesIO(payload)) as archive:
        yield (nested, None, "archive", hashlib.sha256(payload).hexdigest(), None, None, None, 0)
        yield from _level(archive, nested, False)


def decode_archives(files: DataFrame, carried: list[str]) -> DataFrame:
    """The streams of the members of one level, named by ``nested`` (null: the archive itself);
    a record ``archive`` carries the digest of that level's bytes in place of a sheet."""
    return decode_rows(files, carried, _chosen, LEVEL_SCHEMA, LEVEL_COLUMNS, ["nested"])


def choose_bundle(status: DataFrame, by: list[str]) -> DataFrame:
    """The archive level to use: the outer one if complete, else the only complete inner one.

    ``status(by, nested, complete)`` has one row per level, ``nested`` null for the outer.
    """
    inner = F.col("complete") & F.col("nested").isNotNull()
    found = status.groupBy(*by).agg(
        F.max(F.col("complete") & F.col("nested").isNull()).alias("direct"),
        F.count_if(inner).alias("inner"), F.min(F.when(inner, F.col("nested"))).alias("only"))
    return found.select(
        *by, (F.col("direct") | (F.col("inner") == 1)).alias("resolved"),
        F.when(~F.col("direct") & (F.col("inner") == 1), F.col("only")).alias("nested"),
        F.when(F.col("direct") | (F.col("inner") == 1), F.lit(None).cast("string"))
        .when(F.col("inner") == 0, "no_bundle").otherwise("several_bundles").alias("problem"))
