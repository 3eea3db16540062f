"""Parse specs: how a kind of file is read when it doesn't explain itself."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from tallyfold.errors import ParseSpecError
from tallyfold.sources import delimited

TYPES, FORMATS = ("text", "integer", "decimal", "date"), ("standard", "greek")


@dataclass
class Spec:
    kind: str
    columns: list[dict] = field(default_factory=list)
    skip_lines: int = 0
    min_length: int = 1
    skip_patterns: list[str] = field(default_factory=list)
    delimiter: str | None = None
    has_header: bool = True

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ParseSpecError(what)


# Fixed names: fields of specs as other tools of this kind write them, and ours.
FIELDS = {"type": "kind", "skipLineRegexes": "skip_patterns", "skipLeadingLines": "skip_lines", "skipLeadingRows": "skip_lines", "minLineLength": "min_length", "hasHeader": "has_header"}


def _own(raw: dict) -> dict:
    """The same spec by our names; columns may be names alone."""
    out = {FIELDS.get(k, k): v for k, v in raw.items() if v is not None}
    _need(len(out) == sum(v is not None for v in raw.values()), "a field is given twice")
    columns = out.get("columns", [])
    _need(isinstance(columns, list) and all(isinstance(c, (str, dict)) for c in columns), "columns is a list of names or definitions")
    out["columns"] = [{"name": c} if isinstance(c, str) else {"format" if k == "numberFormat" else k: v for k, v in c.items()} for c in columns]
    return out


def validate(raw: dict | str | Spec) -> Spec:
    if isinstance(raw, Spec):
        return raw
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise ParseSpecError(f"a parse spec is JSON: {e}") from e
    _need(isinstance(raw, dict), "a parse spec is an object")
    raw = _own(raw)
    _need(raw.get("kind") in ("fixed", "delimited", "xlsx"), "kind is fixed, delimited or xlsx")
    unknown = set(raw) - set(Spec.__dataclass_fields__)
    _need(not unknown, f"unknown fields {sorted(unknown)}")
    s = Spec(**raw)
    _need(isinstance(s.skip_lines, int) and s.skip_lines >= 0, "skip_lines counts lines")
    _need(isinstance(s.min_length, int) and isinstance(s.skip_patterns, list), "min_length is a number and skip_patterns a list")
    for p in s.skip_patterns:
        _need(isinstance(p, str), "a skip pattern is a text")
        try:
            re.compile(p)
        except re.error as e:
            raise ParseSpecError(f"skip pattern {p!r}: {e}") from e
    for c in s.columns:
        _need(isinstance(c.get("name"), str) and bool(c["name"].strip()), "a column has a name")
        _need(c.get("type") in (None, *TYPES) and c.get("format") in (None, *FORMATS), f"{c['name']}: type or format is unknown")
    if s.kind == "fixed":
        _need(len(s.columns) >= 2, "a fixed spec has two columns at least")
        for c in s.columns:
            _need(isinstance(c.get("start"), int) and isinstance(c.get("end"), int) and 0 <= c["start"] < c["end"], f"{c['name']}: start lies before end")
    if s.kind == "delimited":
        _need(s.delimiter is None or len(s.delimiter) == 1, "a delimiter is one character")
    if s.kind != "fixed":
        _need(isinstance(s.has_header, bool), "has_header is true or false")
        _need(s.has_header or len(s.columns) >= 2, "without a header, columns are named")
    return s


def forced(s: Spec) -> dict[str, tuple[str, str | None]]:
    """Types and formats that a fixed spec sets, by column name."""
    return {c["name"]: (c["type"], c.get("format")) for c in s.columns if c.get("type")} if s.kind == "fixed" else {}


def parse_fixed(text: str, s: Spec) -> tuple[list[str], list[list[str]]]:
    skip = [re.compile(p) for p in s.skip_patterns]
    lines = re.split(r"\r\n|\r|\n", text)[s.skip_lines :]
    rows = [[x[c["start"] : c["end"]].strip() for c in s.columns] for x in lines if len(x.strip()) >= s.min_length and not any(p.search(x) for p in skip)]
    return [c["name"] for c in s.columns], rows


def parse_delimited(name: str, text: str, s: Spec) -> tuple[list[str], list[list[str]]]:
    text = "\n".join(re.split(r"\r\n|\r|\n", text)[s.skip_lines :]) if s.skip_lines else text
    rows = delimited.parse(name, text, s.delimiter or delimited.sniff(name, text))
    names = [c["name"] for c in s.columns]
    if s.has_header:
        header, rows = (rows[0], rows[1:]) if rows else ([], [])
        names = names or header
    if rows and len(names) != len(rows[0]):
        raise ParseSpecError(f"{name}: {len(names)} names for {len(rows[0])} columns")
    return names, rows


def apply_xlsx(name: str, matrix: list[list[str]], s: Spec) -> tuple[list[str], list[list[str]]]:
    rows = matrix[s.skip_lines :]
    header = delimited.dedupe_headers(rows.pop(0)) if s.has_header and rows else []
    names = [c["name"] for c in s.columns] or header
    if rows and len(names) != len(rows[0]):
        raise ParseSpecError(f"{name}: {len(names)} names for {len(rows[0])} columns")
    return names, rows
