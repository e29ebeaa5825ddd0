"""Text of office files and PDF with the standard library; other programs are used where they are installed."""

from __future__ import annotations

import io
import os
import re
import shutil
import subprocess
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

#: Characters of XML that a member of an archive may have.
MOST_XML = 1 << 28
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def _member(content: bytes, name: str) -> ElementTree.Element:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if z.getinfo(name).file_size > MOST_XML:
            raise ValueError(f"{name} is too large")
        data = z.read(name)
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data[:4096]:
        raise ValueError(f"{name} has a document type")
    return ElementTree.fromstring(data)


def docx_text(content: bytes) -> str:
    """One line for each paragraph, those of tables included; tabs and line breaks as they are."""
    lines = []
    for p in _member(content, "word/document.xml").iter(f"{_W}p"):
        parts = []
        for e in p.iter():
            if e.tag == f"{_W}t":
                parts.append(e.text or "")
            elif e.tag == f"{_W}tab":
                parts.append("\t")
            elif e.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        lines.append("".join(parts))
    return "\n".join(lines)


def odt_text(content: bytes) -> str:
    def inside(e: ElementTree.Element) -> Iterator[str]:
        yield e.text or ""
        for c in e:
            if c.tag == f"{_T}s":
                yield " " * int(c.get(f"{_T}c", "1"))
            elif c.tag == f"{_T}tab":
                yield "\t"
            elif c.tag == f"{_T}line-break":
                yield "\n"
            else:
                yield from inside(c)
            yield c.tail or ""

    return "\n".join("".join(inside(p)) for p in _member(content, "content.xml").iter() if p.tag in (f"{_T}p", f"{_T}h"))


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
#: Groups of RTF that aren't text, and words of it that are characters.
_RTF_SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "object", "themedata", "datastore", "listtable", "listoverridetable", "generator", "xmlnstbl"}
_RTF_CHARS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def rtf_text(content: bytes) -> str:
    t = content.decode("latin-1")
    if not t.lstrip().startswith("{\\rtf"):
        raise ValueError("not RTF")
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    skip, after, pending, first = False, 1, 0, False
    for m in _RTF.finditer(t):
        word, number, octet, symbol, brace, text = m.groups()
        if brace == "{":
            stack.append((skip, after))
            first = True
            continue
        if brace == "}":
            skip, after = stack.pop() if stack else (False, 1)
            first = False
            continue
        if word:
            if first and word in _RTF_SKIPPED:
                skip = True
            elif word == "uc":
                after = int(number or 1)
            elif word == "u" and not skip:
                n = int(number or 0)
                out.append(chr(n + 0x10000 if n < 0 else n))
                pending = after
            elif word in _RTF_CHARS and not skip:
                out.append(_RTF_CHARS[word])
        elif symbol == "*":
            skip = True
        elif octet or symbol or text:
            s = bytes([int(octet, 16)]).decode("cp1252", "replace") if octet else {"~": "\xa0", "_": "-"}.get(symbol, symbol) if symbol else text
            if pending and symbol is None:
                pending, s = max(0, pending - len(s)), s[pending:]
            if not skip:
                out.append(s)
        first = False
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


_STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOW = re.compile(rb"\[((?:\\.|\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(\((?:\\.|[^\\()])*\))\s*(Tj|'|\")|\b(T\*|Td|TD|ET)(?![\w*])", re.S)
_LITERAL = re.compile(rb"\(((?:\\.|[^\\()])*)\)|(-?\d+(?:\.\d+)?)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)


def _literal(b: bytes) -> str:
    def one(m: re.Match) -> bytes:
        e = m.group(1)
        if e[:1].isdigit():
            return bytes([int(e, 8) & 255])
        return {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(e, b"" if e in (b"\n", b"\r\n") else e)

    return _ESCAPE.sub(one, b).decode("cp1252", "replace")


def pdf_text(content: bytes) -> str:
    """By an installed reader, or else the literal strings that pages show (fonts with codes of their own need a reader)."""
    if not content.lstrip().startswith(b"%PDF"):
        raise ValueError("not PDF")
    for reader in (_by_fitz, _by_pypdf):
        try:
            return reader(content)
        except Exception:  # not installed, or not able to
            continue
    pages = []
    for m in _STREAM.finditer(content):
        data = m.group(2)
        if b"FlateDecode" in m.group(1):
            try:
                data = zlib.decompressobj().decompress(data, MOST_XML)
            except zlib.error:
                continue
        if b"BT" not in data:
            continue
        out: list[str] = []
        for x in _SHOW.finditer(data):
            if x.group(4):
                out.append("\n")
            elif x.group(2):
                out.append(("\n" if x.group(3) != b"Tj" else "") + _literal(x.group(2)[1:-1]))
            else:
                out += [_literal(y.group(1)) if y.group(1) is not None else " " if float(y.group(2)) < -200 else "" for y in _LITERAL.finditer(x.group(1))]
        pages.append(re.sub(r"\n+", "\n", "".join(out)).strip("\n"))
    if not any(p.strip() for p in pages):
        raise ValueError("no text that can be read without a PDF reader")
    return "\n".join(pages)


def _by_fitz(content: bytes) -> str:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as d:
        return "\n".join(p.get_text("text") or "" for p in d)


def _by_pypdf(content: bytes) -> str:
    from pypdf import PdfReader

    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)


def converted_text(kind: str, content: bytes, program: str = "soffice") -> str:
    """By an office program, if there is one."""
    at = shutil.which(program)
    if at is None:
        raise ValueError(f"{kind} needs {program}, which isn't installed")
    with tempfile.TemporaryDirectory() as d:
        with open(os.path.join(d, f"in.{kind}"), "wb") as f:
            f.write(content)
        subprocess.run([at, "--headless", "--convert-to", "txt:Text", "--outdir", d, os.path.join(d, f"in.{kind}")], check=True, capture_output=True, timeout=300)
        with open(os.path.join(d, "in.txt"), encoding="utf-8", errors="replace") as f:
            return f.read()


READERS = {"docx": docx_text, "odt": odt_text, "rtf": rtf_text, "pdf": pdf_text}


def office_text(kind: str, content: bytes) -> str:
    if kind in READERS:
        return READERS[kind](content)
    if kind == "doc":
        return converted_text(kind, content)
    raise ValueError(f"no extractor for {kind!r}")
