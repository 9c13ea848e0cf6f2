"""Files for offices, written with the standard library: a workbook, a Word document, a PDF.

A document is a list of blocks: ("heading", level, text), ("paragraph", text) and
("table", rows), the first row of a table its headings."""

from __future__ import annotations

import io
import re
import textwrap
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

#: Rows of a sheet, at most.
SHEET_ROWS = 1_048_576
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_OPEN = "application/vnd.openxmlformats-officedocument."
_RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _text(value) -> str:
    return escape(_CONTROLS.sub("", "" if value is None else str(value)))


def workbook(sheets: Iterable[tuple[str, list[str], Iterable]]) -> bytes:
    """Sheets (name, headings, rows) of text, row by row; one with more rows than a sheet holds goes on in further sheets."""
    f = io.BytesIO()
    row = lambda cells: "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{_text(c)}</t></is></c>' for c in cells) + "</row>"
    names: list[str] = []
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for name, headings, rows in sheets:
            rows, part = iter(rows), 0
            left = next(rows, None)
            while left is not None or not part:
                part += 1
                names.append(re.sub(r"[\[\]:*?/\\]", " ", name if part == 1 else f"{name} {part}")[:31])
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as out:
                    out.write(f'{_HEAD}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{row(headings)}'.encode())
                    for _ in range(SHEET_ROWS - 1):
                        if left is None:
                            break
                        out.write(row(left).encode())
                        left = next(rows, None)
                    out.write(b"</sheetData></worksheet>")
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_RELATION}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Type="{_RELATION}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        kinds = {"xl/workbook.xml": f"{_OPEN}spreadsheetml.sheet.main+xml"} | {f"xl/worksheets/sheet{k}.xml": f"{_OPEN}spreadsheetml.worksheet+xml" for k in range(1, len(names) + 1)}
        _contents(z, kinds, "xl/workbook.xml")
    return f.getvalue()


def _contents(z: zipfile.ZipFile, kinds: dict[str, str], main: str) -> None:
    """The lists by which a package's parts are found; ``kinds``: the content type of each."""
    listed = "".join(f'<Override PartName="/{n}" ContentType="{k}"/>' for n, k in kinds.items())
    z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{listed}</Types>')
    z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_RELATION}/officeDocument" Target="{main}"/></Relationships>')


def word(blocks: list[tuple]) -> bytes:
    """A Word document; headings are bold and larger, tables have borders."""
    def run(text, bold=False, size=22):
        style = f'<w:rPr>{"<w:b/>" if bold else ""}<w:sz w:val="{size}"/></w:rPr>'
        return f'<w:r>{style}<w:t xml:space="preserve">{_text(text)}</w:t></w:r>'

    def cell(text, bold):
        return f"<w:tc><w:p>{run(text, bold, 18)}</w:p></w:tc>"

    edges = "".join(f'<w:{side} w:val="single" w:sz="4"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))
    body = []
    for kind, *rest in blocks:
        if kind == "table":
            rows = "".join("<w:tr>" + "".join(cell(c, k == 0) for c in r) + "</w:tr>" for k, r in enumerate(rest[0]))
            body.append(f"<w:tbl><w:tblPr><w:tblBorders>{edges}</w:tblBorders></w:tblPr>{rows}</w:tbl><w:p/>")
        else:
            body.append(f"<w:p>{run(rest[-1], kind == 'heading', 22 if kind == 'paragraph' else 36 - 4 * rest[0])}</w:p>")
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'{_HEAD}<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(body)}</w:body></w:document>')
        _contents(z, {"word/document.xml": f"{_OPEN}wordprocessingml.document.main+xml"}, "word/document.xml")
    return f.getvalue()


#: Characters of a line and lines of a page of a PDF.
LINE, PAGE = 100, 60


def lines_of(blocks: list[tuple], width: int = LINE) -> list[tuple[bool, str]]:
    """Blocks as lines (bold, text); columns of a table are as wide as their cells, or cut evenly where they don't fit."""
    out: list[tuple[bool, str]] = []
    for kind, *rest in blocks:
        if kind != "table":
            out += [(kind == "heading", x) for x in textwrap.wrap(str(rest[-1]), width) or [""]] + [(False, "")]
            continue
        rows = [["" if c is None else " ".join(str(c).split()) for c in r] for r in rest[0]]
        wide = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(max(map(len, rows), default=0))]
        room = width - 2 * (len(wide) - 1)
        if sum(wide) > room:
            wide = [min(w, max(4, room // len(wide))) for w in wide]
        for n, r in enumerate(rows):
            parts = [textwrap.wrap(c, w) or [""] for c, w in zip(r, wide)]
            for k in range(max(map(len, parts), default=0)):
                out.append((n == 0, "  ".join((p[k] if k < len(p) else "").ljust(w) for p, w in zip(parts, wide)).rstrip()))
        out.append((False, ""))
    return out


def pdf(blocks: list[tuple]) -> bytes:
    """A PDF of A4 pages in a fixed-width type; characters outside of Windows' Western set become question marks."""
    lines = lines_of(blocks)
    pages = [lines[k : k + PAGE] for k in range(0, len(lines), PAGE)] or [[]]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(pages))) + b"] /Count %d >>" % len(pages)]
    objects += [b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier%s /Encoding /WinAnsiEncoding >>" % bold for bold in (b"", b"-Bold")]
    for k, page in enumerate(pages):
        said = [b"BT 13 TL 40 800 Td"]
        for bold, text in page:
            raw = text.encode("cp1252", errors="replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            said.append(b"/F%d 8.5 Tf (%s) Tj T*" % (bold + 1, raw))
        stream = b"\n".join([*said, b"ET"])
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents %d 0 R >>" % (6 + 2 * k))
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
    out, starts = bytearray(b"%PDF-1.4\n"), []
    for k, o in enumerate(objects, 1):
        starts.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, o)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % s for s in starts)
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at)
    return bytes(out)
