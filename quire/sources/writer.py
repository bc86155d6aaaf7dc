"""Small synthetic PDFs for tests and queries. Shares no code with the kernel."""

from __future__ import annotations

import zlib


def stream(data: bytes, extra: bytes = b"") -> bytes:
    return b"<</Length %d %s>>\nstream\n%s\nendstream" % (len(data), extra, data)


def flate(data: bytes, extra: bytes = b"") -> bytes:
    return stream(zlib.compress(data), b"/Filter/FlateDecode" + extra)


def build(objects: list[bytes], trailer: bytes = b"", leading: bytes = b"", version: bytes = b"1.7") -> bytes:
    """A file with one cross-reference table; objects are numbered from 1, the first is the catalog."""
    out = bytearray(leading + b"%PDF-" + version + b"\n")
    at = []
    for n, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1)
    out += b"".join(b"%010d 00000 n \n" % x for x in at)
    out += b"trailer\n<</Size %d/Root 1 0 R%s>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, trailer, start)
    return bytes(out)


def update(pdf: bytes, changed: dict[int, bytes], freed: tuple[int, ...] = (), trailer: bytes = b"") -> bytes:
    """An incremental revision: new bodies for some objects, others freed."""
    prior = int(pdf[pdf.rindex(b"startxref") + 9 :].split()[0])
    out = bytearray(pdf)
    at = {}
    for n, body in sorted(changed.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n"
    for n in sorted([*changed, *freed]):
        out += b"%d 1\n" % n + (b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 00001 f \n")
    size = max([1, *changed, *freed]) + 1
    out += b"trailer\n<</Size %d/Root 1 0 R/Prev %d%s>>\nstartxref\n%d\n%%%%EOF\n" % (size, prior, trailer, start)
    return bytes(out)


def build_stream(objects: list[bytes], packed: dict[int, bytes]) -> bytes:
    """A file with a cross-reference stream; `packed` objects (number -> body) lie in one object stream."""
    out = bytearray(b"%PDF-1.7\n")
    holder, table = len(objects) + len(packed) + 1, len(objects) + len(packed) + 2
    numbers = [n for n in range(1, holder) if n not in packed]
    rows = {0: (0, 0, 65535)}
    for n, body in zip(numbers, objects):
        rows[n] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    index, body = b"", b""
    for i, (n, x) in enumerate(packed.items()):
        index += b"%d %d " % (n, len(body))
        body += x + b" "
        rows[n] = (2, holder, i)
    rows[holder] = (1, len(out), 0)
    out += b"%d 0 obj\n%s\nendobj\n" % (holder, flate(index + body, b"/Type/ObjStm/N %d/First %d" % (len(packed), len(index))))
    rows[table] = (1, len(out), 0)
    data = b"".join(a.to_bytes(1, "big") + b.to_bytes(4, "big") + c.to_bytes(2, "big") for _, (a, b, c) in sorted(rows.items()))
    start = len(out)
    out += b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF\n" % (table, flate(data, b"/Type/XRef/W[1 4 2]/Size %d/Root 1 0 R" % (table + 1)), start)
    return bytes(out)


FONT = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/FirstChar 32/Widths[" + b"500 " * 95 + b"]>>"


def pages(contents: list[bytes], resources: bytes = b"/Font<</F 4 0 R>>", extra: list[bytes] = (), page: bytes = b"", font: bytes = FONT, trailer: bytes = b"", pack=stream, page_of=None) -> bytes:
    """One page per content stream: 1 catalog, 2 page tree, 3 unused null, 4 font, then `extra` from 5, then pages and contents."""
    first = 5 + len(extra)
    kids = b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(contents)))
    tail = []
    for i, c in enumerate(contents):
        own = page_of(i) if page_of else page
        tail += [b"<</Type/Page/Parent 2 0 R/Contents %d 0 R%s>>" % (first + 2 * i + 1, own), pack(c)]
    return build([b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/MediaBox[0 0 612 792]/Resources<<%s>>/Kids[%s]/Count %d>>" % (resources, kids, len(contents)), b"null", font, *extra, *tail], trailer)


def literal(data: bytes) -> bytes:
    """Bytes as a literal string."""
    return b"(" + data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def unicode_font(chars: list[str]) -> tuple[bytes, bytes, dict[str, int]]:
    """(font body that uses object 5 as ToUnicode, that object, character -> two-byte code)."""
    codes = {c: i + 1 for i, c in enumerate(chars)}
    lines = [b"<%04X> <%s>" % (i, c.encode("utf-16-be").hex().upper().encode()) for c, i in codes.items()]
    blocks = b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(lines[k : k + 100]), b"\n".join(lines[k : k + 100])) for k in range(0, len(lines), 100))
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + blocks
    return b"<</Type/Font/Subtype/Type0/BaseFont/U/Encoding/Identity-H/ToUnicode 5 0 R/DescendantFonts[<</Type/Font/Subtype/CIDFontType2/BaseFont/U/DW 500>>]>>", stream(cmap), codes
