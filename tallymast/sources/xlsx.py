"""Spreadsheet ingestion: one workbook per record of a ``binaryFile`` scan.

A workbook is a zip of XML and cannot be split, so it is the unit of work; many workbooks
spread over the cluster.  CSV and Parquet are the main path for large data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _date_styles(book, ns: str) -> dict[int, str]:
    """What the cell styles with a date or time format show: ``d``, ``t`` or ``dt``."""
    import re
    from xml.etree import ElementTree as ET

    if "xl/styles.xml" not in book.namelist():
        return {}
    styles = ET.fromstring(book.read("xl/styles.xml"))
    # numbers that the format fixes: dates, times, and both
    kinds = {14: "d", 15: "d", 16: "d", 17: "d", 18: "t", 19: "t", 20: "t", 21: "t", 22: "dt", 45: "t", 46: "t", 47: "t"}
    for f in styles.iter(ns + "numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "", (f.get("formatCode") or "").lower())
        day, hour = bool(re.search("[yd]", code)), bool(re.search("[hs]", code))
        if day or hour:
            kinds[int(f.get("numFmtId"))] = "d" * day + "t" * hour
    used = styles.find(ns + "cellXfs")
    found = {i: kinds.get(int(x.get("numFmtId") or 0)) for i, x in enumerate(used if used is not None else ())}
    return {i: k for i, k in found.items() if k}


def _moment(serial: str, shows: str, since_1904: bool) -> str:
    """Text of a date cell: the day number counts from 1899-12-30, or from 1904-01-01."""
    from datetime import datetime, timedelta

    at = (datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)) + timedelta(seconds=round(float(serial) * 86_400))
    return at.strftime({"d": "%Y-%m-%d", "t": "%H:%M:%S", "dt": "%Y-%m-%d %H:%M:%S"}[shows if float(serial) >= 1 or shows == "t" else "dt"])


def _cells(blob: bytes):
    """Rows of the first sheet as lists of text, one at a time; dates and times as ISO text."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree as ET

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(blob)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as f:
                for _, node in ET.iterparse(f):
                    if node.tag == ns + "si":
                        shared.append("".join(t.text or "" for t in node.iter(ns + "t")))
                        node.clear()
        dates = _date_styles(book, ns)
        since_1904 = "xl/workbook.xml" in names and re.search(rb'date1904="(1|true)"', book.read("xl/workbook.xml")) is not None
        sheet = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        with book.open(sheet) as f:
            for _, row in ET.iterparse(f):
                if row.tag != ns + "row":
                    continue
                out: dict[int, str | None] = {}
                for i, cell in enumerate(row.iter(ns + "c")):
                    letters = re.match(r"[A-Z]+", cell.get("r") or "")
                    at = i
                    if letters:
                        at = 0
                        for ch in letters.group():
                            at = at * 26 + ord(ch) - 64
                        at -= 1
                    value = cell.find(ns + "v")
                    if cell.get("t") == "s" and value is not None:
                        out[at] = shared[int(value.text)]
                    elif cell.get("t") == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(ns + "t"))
                    elif value is not None and cell.get("t") in (None, "n") and int(cell.get("s") or 0) in dates:
                        out[at] = _moment(value.text, dates[int(cell.get("s"))], since_1904)
                    else:
                        out[at] = value.text if value is not None else None
                row.clear()
                yield [out.get(j) for j in range(max(out) + 1)] if out else []


def read_xlsx(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], required: Sequence[Sequence[str]] = (), names: str = "*") -> DataFrame:
    """Text columns ``columns`` by header name (case and underscores aside), plus ``source_file``.  Workbooks
    that are unreadable anywhere, or lack all names of one of the ``required`` groups, give no rows: a
    workbook holds a million rows at most and is parsed whole before any of it is passed on."""
    flat = lambda name: (name or "").strip().lower().replace("_", " ")
    groups = [[flat(n) for n in g] for g in required]
    wanted = [flat(c) for c in columns]
    layout = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("source_file", T.StringType())])

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for path, blob in zip(pdf["path"], pdf["content"]):
                try:
                    rows = _cells(blob)
                    header = [flat(h) for h in next(rows)]
                    if any(not set(g) & set(header) for g in groups):
                        continue
                    where = [header.index(w) if w in header else None for w in wanted]
                    chunk = [[r[i] if i is not None and i < len(r) else None for i in where] + [path] for r in rows]
                except Exception:  # not a workbook, or damaged: skipped as a whole, like any unreadable file
                    continue
                for at in range(0, len(chunk), 10_000):
                    yield pd.DataFrame(chunk[at : at + 10_000], columns=layout.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(paths if isinstance(paths, str) else list(paths)).select("path", "content")
    parsed = files.mapInPandas(parse, layout)
    return parsed.withMetadata("source_file", {"_workbook": True})
