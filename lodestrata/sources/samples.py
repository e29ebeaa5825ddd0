"""Small valid files of each office kind, for queries and tests that need some."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape


def _zip(name: str, xml: str) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, xml)
    return b.getvalue()


def docx(*lines: str) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x[:4])}</w:t></w:r><w:r><w:t xml:space="preserve">{escape(x[4:])}</w:t></w:r></w:p>' for x in lines)
    return _zip("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')


def odt(*lines: str) -> bytes:
    o, t = (f"urn:oasis:names:tc:opendocument:xmlns:{n}:1.0" for n in ("office", "text"))
    body = "".join(f"<text:p>{escape(x)}</text:p>" for x in lines)
    return _zip("content.xml", f'<office:document-content xmlns:office="{o}" xmlns:text="{t}"><office:body><office:text>{body}</office:text></office:body></office:document-content>')


def rtf(*lines: str) -> bytes:
    def coded(x: str) -> str:
        units = x.encode("utf-16-le")
        codes = [int.from_bytes(units[i : i + 2], "little") for i in range(0, len(units), 2)]
        return "".join(f"\\{chr(c)}" if chr(c) in "\\{}" else chr(c) if c < 128 else f"\\u{c if c < 0x8000 else c - 0x10000}?" for c in codes)

    return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Serif;}}{\\*\\generator made;}\\uc1 " + "\\par\r\n".join(map(coded, lines)) + "}").encode("ascii")


def pdf(*lines: str) -> bytes:
    shown = b"".join(b"(" + x.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj 0 -14 Td\n" for x in lines)
    data = zlib.compress(b"BT /F1 12 Tf 72 720 Td\n" + shown + b"ET")
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n%b\nendstream" % (len(data), data),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
    ]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%b\nendobj\n" % (i, o)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))


def doc(*lines: str) -> bytes:
    """The head of an old binary file, which only an office program can read."""
    return b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + "\n".join(lines).encode("utf-16-le")


MAKERS = {"docx": docx, "odt": odt, "rtf": rtf, "pdf": pdf, "doc": doc}
