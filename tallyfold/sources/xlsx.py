"""The first sheet of a spreadsheet as lexical cell texts: no formulas, styles or date conversion."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from tallyfold.errors import XlsxReadError

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_index(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_NS}t"))


def read_first_sheet(name: str, content: bytes) -> list[list[str]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")] if "xl/sharedStrings.xml" in z.namelist() else []
            sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise XlsxReadError(f"{name}: not a readable spreadsheet ({e})") from e
    rows: list[list[str]] = []
    for row in sheet.iter(f"{_NS}row"):
        number = int(row.get("r") or len(rows) + 1)
        rows += [[] for _ in range(number - 1 - len(rows))]  # gaps are blank rows
        cells: list[str] = []
        for c in row.iter(f"{_NS}c"):
            m = re.match(r"[A-Z]+", c.get("r") or "")
            at = column_index(m.group()) if m else len(cells)
            cells += [""] * (at - len(cells))
            v = c.find(f"{_NS}v")
            if c.get("t") == "inlineStr":
                value = _text(c)
            elif c.get("t") == "s" and v is not None:
                try:
                    value = shared[int(v.text or "")]
                except (ValueError, IndexError) as e:
                    raise XlsxReadError(f"{name}: a cell names no shared string") from e
            else:
                value = (v.text or "") if v is not None else ""
            cells.append(value.strip())
        rows.append(cells)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]
