"""Texts of files, as functions of bytes: plain text, mail, Office documents, PDF, and pictures where an OCR back end is given."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

from . import images
from .pdf import pdf, pdf_metadata

TEXT = ("txt", "csv", "json", "py", "md", "log")
PICTURES = ("png", "jpg", "jpeg", "tiff", "tif", "bmp", "gif", "webp")
SUPPORTED = (*TEXT, "docx", "xlsx", "pptx", "eml", "pdf", *PICTURES)


class ExtractionError(Exception):
    pass


def looks_binary(head: bytes) -> bool:
    """A NUL in the first 8192 bytes, or over three in ten of them that texts don't have."""
    head = head[:8192]
    odd = sum(1 for b in head if b < 32 and b not in b"\t\n\r\f\b\x1b" or b == 127)
    return b"\0" in head or (len(head) > 0 and odd / len(head) > 0.30)


class _Strip(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in ("br", "p", "div", "tr", "li", "h1", "h2", "h3"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str) -> str:
    p = _Strip()
    p.feed(html)
    p.close()
    return re.sub(r"[ \t]*\n\s*", "\n", "".join(p.parts)).strip()


def _xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name))


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def _paragraphs(root) -> list[str]:
    return ["".join(t.text or "" if _local(t) == "t" else "\t" if _local(t) == "tab" else "" for t in p.iter()) for p in root.iter() if _local(p) == "p"]


def docx(data: bytes) -> str:
    """Paragraphs and cells of the body, then each section's header and footer, in the order of the sections."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _xml(z, "word/document.xml")
        rels = "word/_rels/document.xml.rels"
        targets = {r.get("Id"): r.get("Target") for r in _xml(z, rels)} if rels in z.namelist() else {}
        used = [next((v for k, v in e.attrib.items() if k.endswith("}id")), None) for e in body.iter() if _local(e) in ("headerReference", "footerReference")]
        parts = [f"word/{targets[i]}" for i in dict.fromkeys(used) if i in targets]
        others = sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", n) and n not in parts) if not used else []
        roots = [body, *(_xml(z, n) for n in (*parts, *others) if n in z.namelist())]
        return "\n".join(x for root in roots for x in _paragraphs(root) if x)


def docx_metadata(data: bytes) -> dict[str, str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "docProps/core.xml" not in z.namelist():
            return {}
        names = {"creator": "author", "description": "comments", "lastModifiedBy": "last_modified_by"}
        return {names.get(_local(e), _local(e)): e.text for e in _xml(z, "docProps/core.xml") if e.text}


def xlsx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in _xml(z, "xl/sharedStrings.xml") if _local(si) == "si"] if "xl/sharedStrings.xml" in names else []
        out = []
        for sheet in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for row in (r for r in _xml(z, sheet).iter() if _local(r) == "row"):
                cells = []
                for c in row:
                    v = next((x.text for x in c.iter() if _local(x) in ("v", "t") and x.text), None)
                    if v is not None:
                        cells.append(shared[int(v)] if c.get("t") == "s" else v)
                out.append(" ".join(cells))
        for n in sorted(n for n in names if re.fullmatch(r"xl/comments\d*\.xml", n)):
            out += ["".join(t.text or "" for t in c.iter() if _local(t) == "t") for c in _xml(z, n).iter() if _local(c) == "comment"]
        return "\n".join(x for x in out if x)


def pptx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out, names = [], z.namelist()
        slides = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for k, n in slides:
            root = _xml(z, n)
            rows = [r for r in root.iter() if _local(r) == "tr"]
            in_rows = {p for r in rows for p in r.iter()}
            out += [f"Slide {k}", *("".join(t.text or "" for t in p.iter() if _local(t) == "t") for p in root.iter() if _local(p) == "p" and p not in in_rows)]
            out += [" | ".join("".join(t.text or "" for t in c.iter() if _local(t) == "t") for c in r if _local(c) == "tc") for r in rows]
            notes = f"ppt/notesSlides/notesSlide{k}.xml"
            if notes in names and (text := " ".join(x for x in _paragraphs(_xml(z, notes)) if x)):
                out.append(f"Notes: {text}")
        return "\n".join(x for x in out if x)


def eml(data: bytes) -> str:
    m = email.message_from_bytes(data, policy=email.policy.default)
    out = [f"{h}: {m[h]}" for h in ("From", "To", "Cc", "Subject", "Date") if m[h]]
    for part in m.walk():
        if part.is_multipart():
            continue
        try:
            if part.get_filename():
                out.append(f"Attachment: {part.get_filename()}")
            elif part.get_content_type() == "text/plain":
                out.append(part.get_content())
            elif part.get_content_type() == "text/html":
                out.append(html_text(part.get_content()))
        except (LookupError, ValueError, KeyError):
            out.append("[a part that can't be read]")
    return unescape("\n".join(out))


READERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "eml": eml}
METADATA = {"docx": docx_metadata, "pdf": pdf_metadata}


def extract_all(ext: str, data: bytes, backends: dict | None = None) -> tuple[str | None, str, str | None, dict[str, str]]:
    """(text, scan_status, failure_reason, metadata). backends may have a reader for any extension, and `ocr` (file, page or frame -> lines
    with scores) and `faces` (file -> number). A picture needs `ocr`; a PDF asks it for pages with little text."""
    backends, known = backends or {}, {}
    try:
        if ext in backends:
            return backends[ext](data), "scanned", None, known
        if ext in TEXT:
            return data.decode("utf-8", "ignore"), "scanned", None, known
        if ext in METADATA:
            try:
                known = {k: v for k, v in METADATA[ext](data).items() if v}
            except Exception:  # noqa: BLE001
                known = {}  # metadata is beside the point
        if ext == "pdf":
            ocr = backends.get("ocr")
            return pdf(data, (lambda d, k: images.of_lines(ocr(d, k))[0]) if ocr else None), "scanned", None, known
        if ext in PICTURES:
            if "ocr" not in backends:
                raise ExtractionError("no back end for pictures")
            text, known = images.image(data, backends["ocr"], backends.get("faces"))
            return text, "scanned", None, known
        if ext not in READERS:
            raise ExtractionError(f"no back end for {ext}")
        return READERS[ext](data), "scanned", None, known
    except Exception as e:  # noqa: BLE001
        return None, "extraction_failed", f"{type(e).__name__}: {e}", known


def extract(ext: str, data: bytes, backends: dict | None = None) -> tuple[str | None, str, str | None]:
    """(text, scan_status, failure_reason)."""
    return extract_all(ext, data, backends)[:3]
