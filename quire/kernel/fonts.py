"""Fonts: encodings, ToUnicode maps, widths."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .errors import LimitError, PdfError
from .glyphs import glyph_text
from .syntax import Dictionary, Obj, decode_hex, integer, lex, number

#: The upper part of WinAnsiEncoding that differs from Latin-1.
WIN_ANSI = {128: "€", 130: "‚", 131: "ƒ", 132: "„", 133: "…", 134: "†", 135: "‡", 136: "ˆ", 137: "‰", 138: "Š", 139: "‹", 140: "Œ", 142: "Ž", 145: "‘", 146: "’", 147: "“", 148: "”", 149: "•", 150: "–", 151: "—", 152: "˜", 153: "™", 154: "š", 155: "›", 156: "œ", 158: "ž", 159: "Ÿ", 160: " ", 173: "-"}
#: Fonts that may leave their encoding out.
STANDARD_FONTS = {b"Helvetica", b"Helvetica-Bold", b"Helvetica-Oblique", b"Helvetica-BoldOblique", b"Times-Roman", b"Times-Bold", b"Times-Italic", b"Times-BoldItalic", b"Courier", b"Courier-Bold", b"Courier-Oblique", b"Courier-BoldOblique"}
REPLACEMENT = "�"
ENTRIES, SPACES = 65_536, 256
_W, _UNIT = rb"[\t\n\f\r ]++", rb"[0-9A-Fa-f]{4}"
#: Blocks of two-byte codes and the one character of each.
_PLAIN = re.compile(rb"(?:[\t\n\f\r ]*+(?:1%b(?:begincodespacerange%b<0000>%b<FFFF>%bendcodespacerange)|[0-9]{1,9}+%bbeginbfchar(?:%b<%b>%b<(?:%b|[Dd][89ABab][0-9A-Fa-f]{2}[Dd][C-Fc-f][0-9A-Fa-f]{2})>)*+%bendbfchar)(?=[\t\n\f\r ]|\Z))*+[\t\n\f\r ]*+" % (_W, _W, _W, _W, _W, _W, _UNIT, _W, _UNIT, _W))


def simple_encoding(base: bytes | None, subtype: bytes, base_font: bytes, has_encoding: bool) -> dict[int, str] | None:
    """Code -> text of a simple font before its differences."""
    table = None
    implied = base is None and not has_encoding and subtype == b"Type1" and base_font in STANDARD_FONTS
    if base in (b"WinAnsiEncoding", b"StandardEncoding") or implied:
        table = {c: chr(c) for c in range(32, 127)}
    if base == b"WinAnsiEncoding":
        table |= {c: chr(c) for c in range(161, 256)} | WIN_ANSI | {c: "•" for c in (127, 129, 141, 143, 144, 157)}
    elif table:
        table |= {39: "’", 96: "‘"}
    return table


@dataclass(slots=True)
class CMap:
    spaces: list[tuple[bytes, bytes]] = field(default_factory=list)
    mapping: dict[bytes, str] = field(default_factory=dict)

    def split(self, raw: bytes) -> list[tuple[bytes, str, bool]]:
        """(code, text, known) of each code: the first code space that holds it decides its length."""
        spaces = self.spaces or [(b"\0" * n, b"\xff" * n) for n in sorted({len(k) for k in self.mapping})]
        if len(spaces) == 1 and not len(raw) % len(spaces[0][0]) and not any(spaces[0][0]) and set(spaces[0][1]) == {255}:
            # one code space with every code of its length
            n, get = len(spaces[0][0]), self.mapping.get
            codes = [raw[i : i + n] for i in range(0, len(raw), n)]
            return [(c, REPLACEMENT, False) if (u := get(c)) is None else (c, u, True) for c in codes]
        out, at = [], 0
        while at < len(raw):
            n = next((len(lo) for lo, hi in spaces if at + len(lo) <= len(raw) and all(a <= c <= b for a, c, b in zip(lo, raw[at : at + len(lo)], hi))), 1)
            code = raw[at : at + n]
            u = self.mapping.get(code)
            out.append((code, REPLACEMENT if u is None else u, u is not None))
            at += n
        return out


def _target(raw: bytes) -> str:
    if not raw or len(raw) % 2:
        raise PdfError("invalid ToUnicode target")
    try:
        return raw.decode("utf-16-be")
    except UnicodeDecodeError:
        raise PdfError("invalid ToUnicode target") from None


def _plain_cmap(data: bytes, entries: int, size: int) -> CMap | None:
    """What parse_cmap() makes of a map of two-byte codes to a character each; None where it has to look closer."""
    if len(data) > 1 << 19 or _PLAIN.fullmatch(data) is None:
        return None
    words, out, i, n = data.split(), CMap(), 0, 0
    while i < len(words):
        stop = words.index(b"end" + words[i + 1][5:], i)
        keys, values = (bytes.fromhex(b"".join(words[k:stop:2]).translate(None, b"<>").decode()) for k in (i + 2, i + 3))
        if words[i + 1] == b"begincodespacerange":
            out.spaces.append((keys, values))
        else:
            try:
                text = values.decode("utf-16-be")
            except UnicodeDecodeError:
                return None
            if not len(keys) == 2 * int(words[i]) == 2 * len(text):
                return None
            out.mapping.update(zip((keys[k : k + 2] for k in range(0, len(keys), 2)), text))
            n, size = n + len(text), size - len(keys) - len(text.encode())
        i = stop + 1
    return out if len(out.mapping) == n <= entries and size >= 0 and len(out.spaces) <= SPACES else None


def parse_cmap(data: bytes, entries: int = ENTRIES, size: int = 256 << 20) -> CMap:
    """A ToUnicode map; anything outside the supported form is an error. ENTRIES bound one map, `entries` what is left for all."""
    entries = min(entries, ENTRIES)
    if (plain := _plain_cmap(data, entries, size)) is not None:
        return plain
    toks, error = lex(data)
    if error:
        raise error
    words = [(k, data[s:e]) for k, s, e in toks if k not in ("whitespace", "comment", "eof")]
    out, left = CMap(), size

    def code(i: int) -> bytes:
        if i >= len(words) or words[i][0] != "hex_string":
            raise PdfError("ToUnicode operand is not a hexadecimal string")
        return decode_hex(words[i][1][1:-1])

    def put(key: bytes, text: str) -> None:
        nonlocal left
        left -= len(key) + len(text.encode())
        if len(out.mapping) >= entries or left < 0:
            raise LimitError("ToUnicode map limit exceeded")
        if key in out.mapping:
            raise PdfError("duplicate ToUnicode mapping")
        out.mapping[key] = text

    i = 0
    while i < len(words):
        kind, word = words[i]
        i += 1
        if kind != "keyword":
            continue
        if word == b"usecmap":
            raise PdfError("ToUnicode usecmap is not supported")
        if word not in (b"begincodespacerange", b"beginbfchar", b"beginbfrange"):
            continue
        declared = int(words[i - 2][1]) if i >= 2 and words[i - 2][0] == "integer" else -1
        stop, done = b"end" + word[5:], 0
        while True:
            if i >= len(words):
                raise PdfError("unterminated ToUnicode block")
            if words[i] == ("keyword", stop):
                i += 1
                break
            low = code(i)
            if not 1 <= len(low) <= 4:
                raise PdfError("invalid ToUnicode code length")
            done += 1
            if word == b"beginbfchar":
                put(low, _target(code(i + 1)))
                i += 2
                continue
            high = code(i + 1)
            if len(high) != len(low):
                raise PdfError("ToUnicode range with mixed code lengths")
            if word == b"begincodespacerange":
                if any(a > b for a, b in zip(low, high)):
                    raise PdfError("inverted code space range")
                if len(out.spaces) >= SPACES:
                    raise PdfError("too many code space ranges")
                out.spaces.append((low, high))
                i += 2
                continue
            a, b = int.from_bytes(low, "big"), int.from_bytes(high, "big")
            if b < a or low[:-1] != high[:-1] and len(low) > 1 and a >> 8 != b >> 8:
                raise PdfError("invalid ToUnicode range")
            if b - a + 1 > entries - len(out.mapping):
                raise LimitError("ToUnicode map limit exceeded")
            if i + 2 < len(words) and words[i + 2][0] == "array_open":
                i += 3
                for n in range(a, b + 1):
                    put(n.to_bytes(len(low), "big"), _target(code(i)))
                    i += 1
                if i >= len(words) or words[i][0] != "array_close":
                    raise PdfError("ToUnicode range array has the wrong length")
                i += 1
            else:
                base = code(i + 2)
                _target(base)
                if int.from_bytes(base[-2:], "big") + b - a > 0xFFFF:
                    raise PdfError("ToUnicode target overflow")
                for n in range(a, b + 1):
                    put(n.to_bytes(len(low), "big"), _target(base[:-2] + (int.from_bytes(base[-2:], "big") + n - a).to_bytes(2, "big")))
                i += 3
        if declared >= 0 and declared != done:
            raise PdfError("ToUnicode block has the wrong number of entries")
    if out.spaces:
        for key in out.mapping:
            if not any(len(lo) == len(key) and all(a <= c <= b for a, c, b in zip(lo, key, hi)) for lo, hi in out.spaces):
                raise PdfError("ToUnicode code outside its code spaces")
    return out


@dataclass(slots=True)
class Font:
    index: int
    span: tuple[int, int, int]
    num: int | None = None
    gen: int | None = None
    subtype: bytes = b""
    base_font: bytes = b""
    cmap: CMap | None = None
    table: dict[int, str] | None = None
    composite: bool = False
    widths: dict[int, float] = field(default_factory=dict)
    default: float = 0.0
    default_known: bool = False
    scale: float = 0.001
    positioned: bool = False
    embedded: tuple[int, int, int] | None = None
    diagnostics: list[tuple[str, str]] = field(default_factory=list)

    def split(self, raw: bytes) -> list[tuple[bytes, str, bool]]:
        if self.cmap is not None:
            return self.cmap.split(raw)
        if self.composite:
            return [(raw[i : i + 2], REPLACEMENT, False) for i in range(0, len(raw), 2)]
        t = self.table or {}
        return [(raw[i : i + 1], t.get(raw[i], REPLACEMENT), raw[i] in t) for i in range(len(raw))]


@dataclass(slots=True)
class UnicodeMaps:
    """ToUnicode maps of a document by the span of their streams, each charged once: entries of all, and their bytes through `spend`."""

    entries: int
    spend: Callable[[int], None]
    left: Callable[[], int]
    known: dict[tuple[int, int, int], CMap] = field(default_factory=dict)

    def read(self, doc, stream: Obj, diagnostics: list) -> CMap | None:
        if stream.kind != "stream":
            raise PdfError("ToUnicode is not a stream", stream.start)
        if stream.span not in self.known:
            try:
                found = parse_cmap(doc.sources[doc.decode(stream.value)].data, self.entries, self.left())
            except LimitError:
                raise
            except PdfError as e:
                diagnostics.append(("unsupported-tounicode", str(e)))
                return None
            self.entries -= len(found.mapping)
            self.spend(sum(len(k) + len(v.encode()) for k, v in found.mapping.items()))
            self.known[stream.span] = found
        return self.known[stream.span]


def load_font(doc, o: Obj, index: int, layout: bool, full: bool, maps: UnicodeMaps, glyphs: dict[str, str] | None = None) -> Font:
    """Read a font dictionary. layout asks for widths, full for its embedded program."""
    get, d = doc.direct, doc.mapping(o, "font")
    f = Font(index, o.span)
    f.subtype, f.base_font = doc.name(d, b"Subtype"), doc.name(d, b"BaseFont")
    f.composite = f.subtype == b"Type0"
    encoding = get(d.get(b"Encoding"))
    if layout:
        _metrics(doc, d, encoding, f, full)
    unicode = get(d.get(b"ToUnicode"))
    if unicode is not None:
        f.cmap = maps.read(doc, unicode, f.diagnostics)
    if not f.composite:
        base, diffs = encoding.value if encoding is not None and encoding.kind == "name" else None, None
        if encoding is not None and encoding.kind == "dictionary":
            base, diffs = doc.name(encoding.value, b"BaseEncoding") or None, get(encoding.value.get(b"Differences"))
        f.table = simple_encoding(base, f.subtype, f.base_font, base is not None)
        if diffs is not None:
            _differences(doc, diffs, f, glyphs)
    return f


def _metrics(doc, d: Dictionary, encoding: Obj | None, f: Font, full: bool) -> None:
    """Widths, and what of the positions they give is not supported."""
    f.positioned = f.subtype in (b"Type1", b"MMType1", b"TrueType")
    metric = d
    if f.subtype == b"Type3":
        f.diagnostics.append(("unsupported-type3-font", "glyph procedures are kept unread; positions come from the font's widths"))
        _type3_scale(doc, d, f)
    if f.composite:
        below = doc.direct(d.get(b"DescendantFonts"))
        if below is None or below.kind != "array" or len(below.value) != 1:
            raise PdfError("Type0 font needs one descendant", f.span[1])
        metric = doc.mapping(below.value[0], "descendant font")
        kind = encoding.value if encoding is not None and encoding.kind == "name" else None
        f.positioned = f.default_known = kind == b"Identity-H"
        if kind not in (b"Identity-H", b"Identity-V"):
            f.diagnostics.append(("unsupported-font-encoding", "codes are not CIDs, so widths and positions may be incomplete"))
        _cid_widths(doc, metric, f)
    else:
        _simple_widths(doc, d, f)
    if f.subtype == b"Type3":
        _type3_widths(doc, d, encoding, f)
        f.positioned = bool(f.widths)
    descriptor = doc.direct(metric.get(b"FontDescriptor"))
    if descriptor is not None:
        about = doc.mapping(descriptor, "font descriptor")
        if full:
            programs = (doc.direct(about.get(key)) for key in (b"FontFile", b"FontFile2", b"FontFile3"))
            program = next((x for x in programs if x is not None), None)
            f.embedded = program.value.span if program is not None and program.kind == "stream" else None
        if (missing := doc.direct(about.get(b"MissingWidth"))) is not None and not f.composite:
            f.default, f.default_known = number(missing), True


def _differences(doc, diffs: Obj, f: Font, glyphs: dict[str, str] | None) -> None:
    if diffs.kind != "array":
        raise PdfError("Differences is not an array", diffs.start)
    code = -1
    for x in map(doc.resolve, diffs.value):
        if x.kind == "integer":
            code = integer(x)
            if not 0 <= code <= 255:
                raise PdfError("Differences code out of range", x.start)
            continue
        if x.kind != "name" or not 0 <= code <= 255:
            raise PdfError("malformed Differences", x.start)
        text = glyph_text(x.value.decode("latin-1"), glyphs)
        f.table = f.table if f.table is not None else {}
        if text is None:
            f.table.pop(code, None)
        else:
            f.table[code] = text
        code += 1


def _simple_widths(doc, d: Dictionary, f: Font) -> None:
    first = doc.direct(d.get(b"FirstChar"))
    if first is None:
        return
    start, widths = integer(first), doc.direct(d.get(b"Widths"))
    if not 0 <= start <= 255:
        raise PdfError("FirstChar outside 0 to 255", first.start)
    if widths is None:
        return
    if widths.kind != "array" or start + len(widths.value) > 256:
        raise PdfError("Widths do not fit the codes of a simple font", widths.start)
    f.widths |= {start + i: number(doc.resolve(x)) for i, x in enumerate(widths.value)}


def _cid_widths(doc, d: Dictionary, f: Font) -> None:
    default = doc.direct(d.get(b"DW"))
    f.default = number(default) if default is not None else 1000.0
    w = doc.direct(d.get(b"W"))
    if w is None:
        return
    if w.kind != "array":
        raise PdfError("CID widths are not an array", w.start)
    items, i = [doc.resolve(x) for x in w.value], 0
    while i < len(items):
        first = integer(items[i])
        if i + 1 >= len(items) or not 0 <= first <= 65_535:
            raise PdfError("malformed CID widths", w.start)
        if items[i + 1].kind == "array":
            if first + len(items[i + 1].value) > 65_536:
                raise PdfError("CID widths beyond 65535", w.start)
            for k, x in enumerate(items[i + 1].value):
                f.widths[first + k] = number(doc.resolve(x))
            i += 2
        else:
            if i + 2 >= len(items):
                raise PdfError("malformed CID widths", w.start)
            last = integer(items[i + 1])
            if not first <= last <= 65_535:
                raise PdfError("malformed CID width range", w.start)
            each = number(items[i + 2])
            f.widths.update(dict.fromkeys(range(first, last + 1), each))
            i += 3


def _type3_scale(doc, d: Dictionary, f: Font) -> None:
    m = doc.direct(d.get(b"FontMatrix"))
    if m is not None:
        if m.kind != "array" or len(m.value) != 6:
            raise PdfError("FontMatrix is not six numbers", m.start)
        f.scale = number(doc.resolve(m.value[0]))


def _type3_widths(doc, d: Dictionary, encoding: Obj | None, f: Font) -> None:
    """Widths that glyph procedures set, which count more than the font's own."""
    names = encoding.value if encoding is not None and encoding.kind == "dictionary" else Dictionary()
    diffs, procs = doc.direct(names.get(b"Differences")), doc.direct(d.get(b"CharProcs"))
    if diffs is None or procs is None:
        return
    if diffs.kind != "array":
        raise PdfError("Differences is not an array", diffs.start)
    of, code = doc.mapping(procs, "CharProcs"), -1
    for x in map(doc.resolve, diffs.value):
        if x.kind == "integer":
            code = integer(x)
            continue
        if x.kind != "name" or not 0 <= code <= 255:
            raise PdfError("malformed Differences", x.start)
        glyph = doc.direct(of.get(x.value))
        if glyph is not None:
            if glyph.kind != "stream":
                raise PdfError("glyph procedure is not a stream", glyph.start)
            width = _glyph_width(doc, glyph)
            if width is not None:
                f.widths[code] = width
        code += 1


def _glyph_width(doc, glyph: Obj) -> float | None:
    """The first operand of a glyph procedure's first d0 or d1; None where there is none or its data cannot be decoded."""
    from .syntax import Content

    try:
        source = doc.decode(glyph.value)
    except LimitError:
        raise
    except PdfError:
        return None
    content = Content(doc.sources[source].data, source, doc.limits.max_depth, doc.limits.max_token_bytes, doc.limits.max_values)
    while (step := content.next(256)) is not None and step[0]:
        if step[0] in (b"d0", b"d1"):
            if not step[1]:
                raise PdfError("glyph procedure sets no width", glyph.start)
            return number(step[1][0])
    return None
