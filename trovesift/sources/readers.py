"""Text of document formats in plain Python: zipped XML (docx, odt, pptx, xlsx), RTF, and PDF without encryption.

Each reader takes a file's bytes and gives (status, text, error), as the extractors of
trovesift.sources.files do. PDF text comes from the strings of its content streams, with
pages set apart; fonts with an encoding of their own are read as Latin-1.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

Result = tuple[str, str | None, str | None]
#: Limits of PDF, and bytes that an archive may unfold to.
MOST_PAGES, MOST_PDF_TEXT, MOST_UNFOLDED = 1000, 10 << 20, 200 << 20


def _parts(data: bytes, pattern: str) -> list[tuple[str, ElementTree.Element]]:
    """XML parts of a zipped document whose names match, by number and name."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        found = [x for x in archive.infolist() if re.fullmatch(pattern, x.filename)]
        if sum(x.file_size for x in found) > MOST_UNFOLDED:
            raise ValueError("document unfolds to too much")
        found.sort(key=lambda x: ([int(n) for n in re.findall(r"\d+", x.filename)], x.filename))
        return [(x.filename, ElementTree.fromstring(archive.read(x))) for x in found]


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _paragraphs(root: ElementTree.Element, paragraph: tuple[str, ...], breaks: dict[str, str]) -> list[str]:
    """Texts of the paragraphs, each with its own runs; elements in `breaks` stand for signs."""
    out = []

    def walk(element, parts):
        name = _local(element)
        own = [] if name in paragraph else parts
        own.append(breaks.get(name, ""))
        own.append(element.text or "")
        for child in element:
            walk(child, own)
            own.append(child.tail or "")
        if own is not parts:
            out.append("".join(own).strip())

    walk(root, [])
    return [x for x in out if x]


def docx(data: bytes) -> Result:
    parts = _parts(data, r"word/(?:document|footnotes|endnotes)\.xml")
    return "ok", "\n".join(x for _, root in parts for x in _paragraphs(root, ("p",), {"tab": "\t", "br": "\n"})), None


def odt(data: bytes) -> Result:
    return "ok", "\n".join(x for _, root in _parts(data, r"content\.xml") for x in _paragraphs(root, ("p", "h"), {"tab": "\t", "line-break": "\n", "s": " "})), None


def pptx(data: bytes) -> Result:
    slides = _parts(data, r"ppt/slides/slide\d+\.xml")
    return "ok", "\n\n".join("\n".join(_paragraphs(root, ("p",), {"br": "\n"})) for _, root in slides), None


def xlsx(data: bytes) -> Result:
    """Cells as they are stored, tabs between them, a line for each row."""
    shared = [" ".join("".join(t.text or "" for t in s.iter() if _local(t) == "t").split()) for _, root in _parts(data, r"xl/sharedStrings\.xml") for s in root]
    out = []
    for _, root in _parts(data, r"xl/worksheets/sheet\d+\.xml"):
        for row in (x for x in root.iter() if _local(x) == "row"):
            cells = []
            for cell in row:
                value = next((v.text or "" for v in cell.iter() if _local(v) in ("v", "t")), "")
                cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
            if any(cells):
                out.append("\t".join(cells))
    return "ok", "\n".join(out), None


_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)|[\r\n]+", re.I)
_RTF_SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "generator", "listtable", "themedata"}
_RTF_SIGNS = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}


def rtf(data: bytes) -> Result:
    out, stack, silent, skip = [], [], False, 0
    if not data.lstrip().startswith(b"{\\rtf"):
        return "failed", None, "not an RTF document"
    for word, number, code, sign, brace, plain in _RTF.findall(data.decode("latin-1")):
        if brace == "{":
            stack.append(silent)
        elif brace:
            silent = stack.pop() if stack else False
        elif sign == "*" or word in _RTF_SKIPPED:
            silent = True
        elif not silent and word == "u" and number:
            out.append(chr(int(number) % 65536))
            skip = 1
        elif not silent:
            piece = _RTF_SIGNS.get(word, "") if word else bytes.fromhex(code).decode("cp1252", "replace") if code else " " if sign == "~" else sign if sign and sign in "\\{}" else plain
            out.append(piece[skip:] if skip and (code or plain) else piece)
            skip = 0 if code or plain else skip
    return "ok", "".join(out), None


_PDF_STRING = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>", re.S)
_PDF_SHOW = re.compile(rb"(\[(?:\\.|[^\]\\])*\]\s*TJ)|((?:\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\"))|(T\*|Td|TD|Tm|ET)\b", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        plain = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        number = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _PDF_ESCAPES.get(m[1], b"" if m[1] == b"\n" else m[1])
        plain = re.sub(rb"\\([0-7]{1,3}|.)", number, raw[1:-1], flags=re.S)
    return plain[2:].decode("utf-16-be", "replace") if plain[:2] == b"\xfe\xff" else plain.decode("latin-1")


def _pdf_text(content: bytes) -> str:
    out = []
    for many, one, move in _PDF_SHOW.findall(content):
        if move:
            out.append("\n")
        else:
            out.extend(_pdf_string(x) for x in _PDF_STRING.findall(many or one))
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()


def pdf(data: bytes) -> Result:
    if not data.lstrip()[:5] == b"%PDF-":
        return "failed", None, "Failed to load PDF document"
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        return "failed", None, "PDF is encrypted or password-protected"
    objects = {int(n): body for n, body in re.findall(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)endobj", data, re.S)}

    def stream(body: bytes) -> bytes:
        found = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not found:
            return b""
        return zlib.decompressobj().decompress(found[1], MOST_UNFOLDED) if b"FlateDecode" in body[: found.start()] else found[1]

    for body in [x for x in objects.values() if re.search(rb"/Type\s*/ObjStm", x)]:  # objects packed in streams
        inner, first = stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
        places = [int(x) for x in inner[:first].split()]
        starts = places[1::2] + [len(inner) - first]
        for k, number in enumerate(places[::2]):
            objects.setdefault(number, inner[first + starts[k] : first + starts[k + 1]])
    pages = [(n, body) for n, body in objects.items() if re.search(rb"/Type\s*/Page(?![a-zA-Z])", body)]
    if len(pages) > MOST_PAGES:
        return "failed", None, f"PDF has more than {MOST_PAGES} pages"
    out, size = [], 0
    for number, (_, body) in enumerate(pages, 1):
        named = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        parts = [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", named[1])] if named else []
        text = _pdf_text(b"\n".join(stream(objects[x]) for x in parts if x in objects))
        out.append(f"--- Page {number} ---\n{text}")
        size += len(text)
        if size > MOST_PDF_TEXT:
            break
    return "ok", "\n\n".join(out)[:MOST_PDF_TEXT], None


READERS = {"docx": docx, "odt": odt, "pptx": pptx, "xlsx": xlsx, "rtf": rtf, "pdf": pdf}
