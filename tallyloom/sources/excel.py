"""Cells of .xlsx workbooks as the text that a reader sees."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from io import BytesIO
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: Number formats that files name by id only.
FORMATS = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0", 38: "#,##0", 39: "#,##0.00", 40: "#,##0.00", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "0.0E+0", 49: "@",
}


def _bare(code: str) -> str:
    """The format of positive numbers without quoted text, colours and padding."""
    return re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|[_*].', "", code.split(";")[0])


def _date(value: float, code: str, since: datetime) -> str:
    at = since + timedelta(days=int(value), milliseconds=round(value % 1 * 86_400_000))
    half = re.search(r"AM/PM|A/P", code, re.IGNORECASE)
    out, clock = [], False
    parts = re.findall(r"AM/PM|A/P|\[h+\]|y+|m+|d+|h+|s+|\.0+|.", code, re.IGNORECASE)
    for i, p in enumerate(parts):
        k = p[0].lower()
        if p.startswith("["):
            out.append(str(int(value * 24)))
            clock = True
        elif k == "y":
            out.append(f"{at:%Y}" if len(p) > 2 else f"{at:%y}")
        elif k == "m" and (clock or any(x[0].lower() == "s" for x in parts[i + 1 : i + 3])):
            out.append(f"{at.minute:0{min(len(p), 2)}d}")
            clock = False
        elif k == "m":
            out.append({1: str(at.month), 2: f"{at:%m}", 3: f"{at:%b}"}.get(len(p), f"{at:%B}"))
        elif k == "d":
            out.append({1: str(at.day), 2: f"{at:%d}", 3: f"{at:%a}"}.get(len(p), f"{at:%A}"))
        elif k == "h":
            hour = (at.hour % 12 or 12) if half else at.hour
            out.append(f"{hour:0{min(len(p), 2)}d}")
            clock = True
        elif k == "s":
            out.append(f"{at.second:0{min(len(p), 2)}d}")
        elif p in ("AM/PM", "A/P", "am/pm", "a/p"):
            out.append(("AM" if at.hour < 12 else "PM")[: 2 if len(p) > 3 else 1])
        elif p[0] == "." and len(p) > 1:
            out.append(f".{at.microsecond:06d}"[: len(p)])
        else:
            out.append(p)
    return "".join(out)


def shown(value: str, code: str, since: datetime = datetime(1899, 12, 30)) -> str:
    """A stored number as its format shows it: dates and times by their parts; decimals, thousands, percent and exponents; text
    around them is kept if quoted. Other formats show the number in general form."""
    bare, number = _bare(code), float(value)
    if re.search(r"[ymdhs]", bare, re.IGNORECASE) and not re.search(r"[0#?]", bare.replace(".0", "")) and code.lower() != "general":
        return _date(number, bare, since)
    if m := re.search(r"([#0?,]*)(?:\.([0#?]+))?(E[+-]0+)?(%?)", bare) if re.search(r"[0#?]", bare) else None:
        places = m[2] or ""
        exact = Decimal(value) * (100 if "%" in bare else 1)
        if m[3]:
            head, power = f"{exact:.{len(places)}E}".split("E")
            return f"{head}E{power[0]}{power[1:].zfill(len(m[3]) - 2)}"
        rounded = exact.quantize(Decimal(1).scaleb(-len(places)), ROUND_HALF_UP)
        text = f"{rounded:,f}" if "," in m[1] else f"{rounded:f}"
        optional = len(places) - len(places.rstrip("#?"))
        if optional and "." in text:
            cut = len(text) - optional
            text = text[:cut] + text[cut:].rstrip("0")
            text = text.removesuffix(".")
        before, after = (re.sub(r'\\(.)|"([^"]*)"|\[[^\]]*\]|[_*].', lambda q: (q[1] or "") + (q[2] or ""), x) for x in re.split(r"[#0?][#0?,.]*", code.split(";")[0], maxsplit=1))
        sign = "-" if text.startswith("-") else ""
        return f"{sign}{before}{text.removeprefix('-')}{after}"
    if number.is_integer() and abs(number) < 1e11:
        return str(int(number))
    return f"{number:.10g}".replace("e+", "E+").replace("e-", "E-")


def _column(reference: str, nth: int) -> int:
    at = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1 if at else nth


def _first_sheet(z: zipfile.ZipFile) -> tuple[str, bool]:
    """Path of the sheet that the workbook names first, and whether its days count from 1904."""
    names = z.namelist()
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        of = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        first, told = book.find(f"{_MAIN}sheets/{_MAIN}sheet"), book.find(f"{_MAIN}workbookPr")
        if first is not None and (target := of.get(first.get(f"{_REL}id"))):
            return (target[1:] if target.startswith("/") else f"xl/{target}"), told is not None and told.get("date1904") in ("1", "true")
    numbered = {int(m[1]): n for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n))}
    return numbered[min(numbered)], False


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """Rows of a workbook's first sheet, one after another: strings as they are, numbers as shown, booleans as true and false, formulas by the
    value that the file holds; errors and blanks are null. Rows and cells that the file leaves out are blank. The sheet is parsed as it is
    unpacked, and what was given is let go, so of a long sheet one row is in memory, with the workbook's table of strings."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        names = z.namelist()
        path, late = _first_sheet(z)
        shared, codes = [], []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in _each(z, "xl/sharedStrings.xml", "si")]
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = FORMATS | {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{_MAIN}numFmt")}
            codes = [own.get(int(x.get("numFmtId", 0)), "General") for x in styles.iterfind(f"{_MAIN}cellXfs/{_MAIN}xf")]
        since = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        given = 0
        for row in _each(z, path, "row"):
            cells: dict[int, str | None] = {}
            for nth, c in enumerate(row.iter(f"{_MAIN}c")):
                kind, v, style = c.get("t", "n"), c.findtext(f"{_MAIN}v"), int(c.get("s", 0))
                if kind == "inlineStr":
                    v = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is None or kind == "e":
                    v = None
                elif kind == "s":
                    v = shared[int(v)]
                elif kind == "b":
                    v = "true" if v == "1" else "false"
                elif kind == "n":
                    v = shown(v, codes[style] if style < len(codes) else "General", since)
                cells[_column(c.get("r", ""), nth)] = v
            while given < int(row.get("r", given + 1)) - 1:
                given += 1
                yield []
            given += 1
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def _each(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag as they are unpacked; each is emptied when the next is asked for."""
    with z.open(name) as f:
        parents: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if element.tag == f"{_MAIN}{tag}":
                yield element
                if parents:
                    parents[-1].clear()
