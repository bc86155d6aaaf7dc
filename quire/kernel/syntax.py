"""Tokens, direct objects, content operators and inline images."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .errors import LimitError, PdfError

SPACE = b"\x00\t\n\f\r "
_TOKEN = re.compile(
    rb"""(?P<whitespace>[\x00\t\n\f\r ]+)|(?P<comment>%[^\r\n]*)|(?P<dict_open><<)|(?P<dict_close>>>)
    |(?P<hex_string><[^>]*>)|(?P<literal_string>\()|(?P<name>/[^\x00\t\n\f\r ()<>\[\]{}/%]*)
    |(?P<array_open>\[)|(?P<array_close>\])|(?P<keyword>[^\x00\t\n\f\r ()<>\[\]{}/%]+|[{}])""",
    re.VERBOSE,
)
#: One token after any white space and comments, its kind being the number of its group.
_NEXT = re.compile(
    rb"""(?:[\x00\t\n\f\r ]++|%[^\r\n]*+)*+(?:(/[^\x00\t\n\f\r ()<>\[\]{}/%]*+)|([+-]?[0-9]++)(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z)
    |([+-]?(?:[0-9]++\.[0-9]*+|\.[0-9]++))(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z)|([^\x00\t\n\f\r ()<>\[\]{}/%]++|[{}])|(<<)|(>>)|(\[)|(\])|(<[^>]*+>)|(\())""",
    re.VERBOSE,
)
_KINDS = ("", "name", "integer", "real", "keyword", "dict_open", "dict_close", "array_open", "array_close", "hex_string", "literal_string")
_REFERENCE = re.compile(rb"(?:[\x00\t\n\f\r ]++|%[^\r\n]*+)*+([+-]?[0-9]++)(?=[\x00\t\n\f\r %])(?:[\x00\t\n\f\r ]++|%[^\r\n]*+)*+R(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z)")
_INTEGER, _REAL = re.compile(rb"[+-]?[0-9]+\Z"), re.compile(rb"[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)\Z")
_BAD_HEX = re.compile(rb"[^0-9A-Fa-f\x00\t\n\f\r ]")
_PAREN = re.compile(rb"[()\\]")
_ESCAPE = re.compile(rb"\\(\r\n|[0-7]{1,3}|[\s\S])|\r\n?|\n")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\r\n": b"", b"\r": b"", b"\n": b""}


@dataclass(slots=True)
class Obj:
    """A value and where it was written. kind: null boolean integer real name string array dictionary reference stream."""

    kind: str
    value: object
    start: int = 0
    end: int = 0
    source: int = 1

    @property
    def span(self) -> tuple[int, int, int]:
        return self.source, self.start, self.end


NULL = Obj("null", None)


@dataclass(slots=True)
class Dictionary:
    """Entries in file order, duplicates kept."""

    entries: list[tuple[bytes, Obj]] = field(default_factory=list)

    def get(self, key: bytes) -> Obj | None:
        """The only value under a key; more than one is an error."""
        found = None
        for k, v in self.entries:
            if k == key:
                if found is not None:
                    raise PdfError(f"duplicate dictionary key /{key.decode('latin-1')}")
                found = v
        return found

    def all(self, key: bytes) -> list[Obj]:
        return [v for k, v in self.entries if k == key]


@dataclass(slots=True)
class Stream:
    dictionary: Dictionary
    dict_span: tuple[int, int, int]
    start: int
    end: int
    source: int = 1
    boundary: str = "length"

    @property
    def span(self) -> tuple[int, int, int]:
        return self.source, self.start, self.end


def tokens(data: bytes, at: int = 0, end: int | None = None, max_token: int = 16 << 20):
    """(kind, start, end) of every token; raises at the first malformed byte."""
    end = len(data) if end is None else end
    match = _TOKEN.match
    while at < end:
        m = match(data, at, end)
        if m is None:
            raise PdfError(f"unexpected byte {data[at]:#04x}", at)
        kind, stop = m.lastgroup, m.end()
        if kind == "literal_string":
            stop = _literal_end(data, at, end)
        elif kind == "hex_string":
            if bad := _BAD_HEX.search(data, at + 1, stop - 1):
                raise PdfError("invalid hexadecimal digit", bad.start())
        elif kind == "keyword":
            word = data[at:stop]
            if _INTEGER.match(word):
                kind = "integer"
            elif _REAL.match(word):
                kind = "real"
        elif kind == "name":
            decode_name(data[at + 1 : stop], at)
        if stop - at > max_token:
            raise LimitError("token byte limit exceeded", at)
        yield kind, at, stop
        at = stop


def _literal_end(data: bytes, at: int, end: int) -> int:
    depth, i = 0, at
    while m := _PAREN.search(data, i, end):
        c, i = m.group(), m.end()
        if c == b"(":
            depth += 1
        elif c == b")":
            depth -= 1
            if not depth:
                return i
        else:
            i += 1
    raise PdfError("unterminated string", at)


def lex(data: bytes, offset: int = 0, max_tokens: int = 1 << 20) -> tuple[list[tuple[str, int, int]], PdfError | None]:
    """All tokens with white space, comments and a closing eof; on an error those before it, and the error."""
    out, error = [], None
    try:
        for t in tokens(data, offset):
            if len(out) >= max_tokens:
                raise LimitError("token count limit exceeded", t[1])
            out.append(t)
        out.append(("eof", len(data), len(data)))
    except PdfError as e:
        error = e
    return out, error


def decode_name(raw: bytes, at: int = 0) -> bytes:
    if b"#" not in raw:
        return raw
    parts = raw.split(b"#")
    out = [parts[0]]
    for p in parts[1:]:
        if not re.match(rb"[0-9A-Fa-f]{2}", p) or p[:2] == b"00":
            raise PdfError("invalid escape in name", at)
        out.append(bytes([int(p[:2], 16)]) + p[2:])
    return b"".join(out)


def decode_literal(raw: bytes) -> bytes:
    """Bytes of a literal string's inside."""

    def one(m: re.Match) -> bytes:
        e = m.group(1)
        if e is None:
            return b"\n"
        if e[0] in b"01234567":
            return bytes([int(e, 8) & 255])
        return _ESCAPED.get(e, e)

    return _ESCAPE.sub(one, raw) if b"\\" in raw or b"\r" in raw else raw


def decode_hex(raw: bytes) -> bytes:
    digits = raw.translate(None, SPACE)
    return bytes.fromhex((digits + b"0" * (len(digits) & 1)).decode())


class Parser:
    """Direct objects from a byte range, one after another. Nesting lives on an explicit stack."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None, source: int = 1, max_depth: int = 256, max_token: int = 16 << 20, max_values: int = 1 << 20, references: bool = True):
        self.data, self.at, self.end, self.source = data, at, len(data) if end is None else end, source
        self.max_depth, self.max_token, self.values, self.references = max_depth, max_token, max_values, references

    def token(self) -> tuple[str, int, int]:
        """The next token that is not white space or a comment."""
        m = _NEXT.match(self.data, self.at, self.end)
        if m is not None and m.end() - self.at <= self.max_token:
            i = m.lastindex
            start, stop = m.span(i)
            if i == 1:
                if b"#" in (raw := self.data[start:stop]):
                    decode_name(raw[1:], start)
            elif i == 10:
                stop = _literal_end(self.data, start, self.end)
                if stop - start > self.max_token:
                    raise LimitError("token byte limit exceeded", start)
            elif i == 9 and (bad := _BAD_HEX.search(self.data, start + 1, stop - 1)):
                raise PdfError("invalid hexadecimal digit", bad.start())
            self.at = stop
            return _KINDS[i], start, stop
        # what is as long as a token may be, the end, and what is no token
        for t in tokens(self.data, self.at, self.end, self.max_token):
            self.at = t[2]
            if t[0] not in ("whitespace", "comment"):
                return t
        self.at = self.end
        return "eof", self.end, self.end

    def keyword(self) -> bytes:
        k, s, e = self.token()
        return self.data[s:e] if k == "keyword" else b""

    def _reference(self, lexeme: bytes, start: int, at: int) -> tuple[Obj | None, int]:
        """A reference if `generation R` follows this integer, which ends at `at`; and where what was read ends."""
        m = _REFERENCE.match(self.data, at, self.end)
        if m is not None and m.end() - at <= self.max_token:
            num, gen, end = int(lexeme), int(m.group(1)), m.end()
        elif self.end - at <= self.max_token:
            return None, at
        else:
            self.at = at
            try:
                k1, s1, e1 = self.token()
                k2, s2, end = self.token() if k1 == "integer" else ("", 0, 0)
            except LimitError:
                raise
            except PdfError:
                return None, at
            if k2 != "keyword" or self.data[s2:end] != b"R":
                return None, at
            num, gen = int(lexeme), int(self.data[s1:e1])
        if not 1 <= num <= 0xFFFFFFFF or not 0 <= gen <= 0xFFFF:
            raise PdfError("reference out of range", start)
        return Obj("reference", (num, gen), start, end, self.source), end

    def value(self, allow_keyword: bool = False) -> Obj | None:
        """The next value; None at the end of the range. With allow_keyword, a bare keyword is returned as kind 'operator'."""
        data, end, most, source, references = self.data, self.end, self.max_token, self.source, self.references
        at, left, match = self.at, self.values, _NEXT.match
        stack: list[tuple[int, int, list]] = []
        inside: list[Obj] = []
        try:
            while True:
                m = match(data, at, end)
                if m is not None and (e := m.end()) - at <= most and (i := m.lastindex) < 9:
                    # all but strings, without further calls
                    raw = m[i]
                    s, at = e - len(raw), e
                else:
                    self.at = at
                    kind, s, e = self.token()
                    raw, at = data[s:e], self.at
                    if kind == "eof":
                        if stack:
                            raise PdfError("unterminated " + ("array", "dictionary")[stack[-1][0] == 6], s)
                        return None
                    i = _KINDS.index(kind)
                if i == 1:
                    done = Obj("name", decode_name(raw[1:], s) if b"#" in raw else raw[1:], s, e, source)
                elif i == 2:
                    done = None
                    if references and left and raw[0] != 45 and (_REFERENCE.match(data, e, end) or end - e > most):
                        done, at = self._reference(raw, s, e)
                    if done is None:
                        done = Obj("integer", raw.decode(), s, e, source)
                elif i == 8 or i == 6:
                    if not stack or stack[-1][0] != i:
                        raise PdfError("unexpected " + raw.decode(), s)
                    _, start, items = stack.pop()
                    if i == 8:
                        done = Obj("array", items, start, e, source)
                    else:
                        if len(items) % 2:
                            raise PdfError("dictionary key without value", s)
                        keys = items[::2]
                        for k in keys:
                            if k.kind != "name":
                                raise PdfError("dictionary key is not a name", k.start)
                        done = Obj("dictionary", Dictionary([(k.value, v) for k, v in zip(keys, items[1::2])]), start, e, source)
                    if not stack:
                        return done
                    inside = stack[-1][2]
                    inside.append(done)
                    continue
                elif i == 7 or i == 5:
                    if len(stack) >= self.max_depth:
                        raise LimitError("nesting depth limit exceeded", s)
                    left -= 1
                    if left < 0:
                        raise LimitError("value count limit exceeded", s)
                    inside = []
                    stack.append((i + 1, s, inside))
                    continue
                elif i == 3:
                    done = Obj("real", raw.decode(), s, e, source)
                elif i == 4 and raw not in (b"true", b"false", b"null"):
                    if allow_keyword and not stack:
                        return Obj("operator", raw, s, e, source)
                    raise PdfError(f"unexpected keyword {raw[:32].decode('latin-1')!r}", s)
                else:
                    done = self._scalar(_KINDS[i], raw, s, e)
                left -= 1
                if left < 0:
                    raise LimitError("value count limit exceeded", s)
                if not stack:
                    return done
                inside.append(done)
        finally:
            self.at, self.values = at, left

    def _scalar(self, kind: str, raw: bytes, s: int, e: int) -> Obj:
        if kind == "literal_string":
            return Obj("string", (1, decode_literal(raw[1:-1])), s, e, self.source)
        if kind == "hex_string":
            return Obj("string", (2, decode_hex(raw[1:-1])), s, e, self.source)
        return Obj("null", None, s, e, self.source) if raw == b"null" else Obj("boolean", raw == b"true", s, e, self.source)


def parse_object(data: bytes, offset: int = 0, source: int = 1, max_depth: int = 256) -> tuple[Obj, int]:
    """The direct object at `offset` and where it ends."""
    if not 0 < max_depth <= 4096:
        raise PdfError("depth limit must be between 1 and 4096")
    p = Parser(data, offset, source=source, max_depth=max_depth)
    found = p.value()
    if found is None:
        raise PdfError("missing object", offset)
    return found, found.end


def integer(o: Obj | None) -> int:
    if o is None or o.kind != "integer" or not -(1 << 63) <= int(o.value) < 1 << 63:
        raise PdfError("not an integer", o.start if o else -1)
    return int(o.value)


def number(o: Obj | None) -> float:
    if o is None or o.kind not in ("integer", "real"):
        raise PdfError("not a number", o.start if o else -1)
    f = float(o.value)
    if f - f != 0:
        raise PdfError("number out of range", o.start)
    return f


#: Inline image keys and their full names; filter and colour space abbreviations (fixed by the format).
INLINE_KEYS = {b"BPC": b"BitsPerComponent", b"CS": b"ColorSpace", b"D": b"Decode", b"DP": b"DecodeParms", b"F": b"Filter", b"H": b"Height", b"IM": b"ImageMask", b"I": b"Interpolate", b"L": b"Length", b"W": b"Width"}
INLINE_SPACES = {b"DeviceGray": 1, b"G": 1, b"DeviceRGB": 3, b"RGB": 3, b"DeviceCMYK": 4, b"CMYK": 4, b"Indexed": 1, b"I": 1}
_CANDIDATES, _LOOK_AHEAD, _LOOK_TOKENS, _ENTRIES = 64, 512, 8, 64


def inline_size(width: int, height: int, components: int, bits: int = 8, mask: bool = False) -> int:
    """Bytes of an unfiltered inline image: whole bytes per row."""
    return -(-width * (1 if mask else components * bits) // 8) * height


@dataclass(slots=True)
class Inline:
    dictionary: Dictionary
    start: int
    end: int
    boundary: str
    dict_start: int = 0
    dict_end: int = 0


class Content:
    """Operators of a content stream, one at a time."""

    def __init__(self, data: bytes, source: int = 1, max_depth: int = 256, max_token: int = 16 << 20, max_values: int = 1 << 20):
        self.data, self.parser = data, Parser(data, source=source, max_depth=max_depth, max_token=max_token, max_values=max_values, references=False)

    def next(self, max_operands: int = 65_536):
        """(operator, operands, start, end) or None at the end; leftover operands then stand alone with operator b''."""
        operands: list[Obj] = []
        while True:
            o = self.parser.value(allow_keyword=True)
            if o is None:
                return (b"", operands, len(self.data), len(self.data)) if operands else None
            if o.kind == "operator":
                return o.value, operands, o.start, o.end
            if len(operands) >= max_operands:
                raise LimitError("operand count limit exceeded", o.start)
            operands.append(o)

    def inline_image(self) -> Inline:
        """What follows BI, up to and with EI."""
        p, pairs = self.parser, []
        dict_start = p.at
        while True:
            o = p.value(allow_keyword=True)
            if o is None:
                raise PdfError("unterminated inline image", p.at)
            if o.kind == "operator":
                if o.value != b"ID":
                    raise PdfError("unexpected operator in inline image", o.start)
                break
            if o.kind != "name" or len(pairs) >= _ENTRIES:
                raise PdfError("invalid inline image dictionary", o.start)
            v = p.value(allow_keyword=True)
            if v is None or v.kind == "operator":
                raise PdfError("inline image key without value", o.start)
            pairs.append((o.value, v))
        full = [INLINE_KEYS.get(k, k) for k, _ in pairs]
        if len(set(full)) != len(full):
            raise PdfError("duplicate inline image key", p.at)
        d = Dictionary(pairs)
        start = o.end
        if start >= len(self.data) or self.data[start] not in SPACE:
            raise PdfError("missing white space after ID", start)
        start += 2 if self.data[start : start + 2] == b"\r\n" else 1
        size, boundary = self._size(d)
        if size is not None:
            end = start + size
            m = re.compile(rb"[\x00\t\n\f\r ]*EI(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z)").match(self.data, end)
            if end > len(self.data) or not m:
                raise PdfError("inline image data is not followed by EI", end)
            p.at = m.end()
            return Inline(d, start, end, boundary, dict_start, o.start)
        at = start
        for _ in range(_CANDIDATES):
            m = re.compile(rb"[\x00\t\n\f\r ]EI(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z)").search(self.data, at)
            if not m:
                break
            if self._plausible(m.end()):
                p.at = m.end()
                return Inline(d, start, m.start(), "recovered", dict_start, o.start)
            at = m.start() + 1
        raise PdfError("inline image end not found", start)

    def _plausible(self, at: int) -> bool:
        """Whether a few tokens after a possible EI look like content."""
        stop = min(len(self.data), at + _LOOK_AHEAD)
        seen = 0
        try:
            for kind, s, e in tokens(self.data, at, stop):
                if kind in ("whitespace", "comment"):
                    continue
                if kind == "keyword" and (e < stop or stop == len(self.data)) and not re.fullmatch(rb"[A-Za-z'\"*0-9]{1,5}", self.data[s:e]):
                    return False
                seen += 1
                if seen >= _LOOK_TOKENS:
                    break
        except PdfError:
            return stop < len(self.data) and seen > 0
        return True

    def _size(self, d: Dictionary) -> tuple[int | None, str]:
        def one(short: bytes, full: bytes) -> Obj | None:
            return d.get(short) or d.get(full)

        if (length := one(b"L", b"Length")) is not None:
            n = integer(length)
            if n < 0:
                raise PdfError("negative inline image length", length.start)
            return n, "length"
        if (f := one(b"F", b"Filter")) is not None and f.kind != "null" and f.value != []:
            return None, "recovered"
        w, h = integer(one(b"W", b"Width")), integer(one(b"H", b"Height"))
        if w < 0 or h < 0:
            raise PdfError("negative inline image dimension")
        mask = one(b"IM", b"ImageMask")
        is_mask = mask is not None and mask.kind == "boolean" and bool(mask.value)
        bits = one(b"BPC", b"BitsPerComponent")
        n_bits = integer(bits) if bits is not None else 8
        space = one(b"CS", b"ColorSpace")
        if is_mask:
            return inline_size(w, h, 1, 1, True), "recovered"
        name = space.value[0].value if space is not None and space.kind == "array" and space.value and space.value[0].kind == "name" else space.value if space is not None and space.kind == "name" else None
        if name not in INLINE_SPACES:
            return None, "recovered"
        if n_bits not in (1, 2, 4, 8, 16):
            raise PdfError("invalid inline image bit depth")
        return inline_size(w, h, INLINE_SPACES[name], n_bits), "recovered"
