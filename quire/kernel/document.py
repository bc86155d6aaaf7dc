"""File structure: header, cross-reference sections, indirect objects, decoded sources, byte regions."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

from ..options import Limits
from . import filters
from .errors import LimitError, MissingKey, PdfError, UnsupportedError
from .syntax import SPACE, Dictionary, Obj, Parser, Stream, integer

_SPACES = re.compile(rb"[\x00\t\n\f\r ]*")
_STARTXREF = re.compile(rb"startxref(?=[\x00\t\n\f\r ])")
_HEADER = re.compile(rb"%PDF-")
_ENTRY = re.compile(rb"[\x00\t\n\f\r ]*([0-9]{1,10})[\x00\t\n\f\r ]+([0-9]{1,5})[\x00\t\n\f\r ]+([nf])(?=[\x00\t\n\f\r ]|\Z)")
_RANGE = re.compile(rb"(?:[\x00\t\n\f\r ]|%[^\r\n]*[\r\n])*([0-9]+)[\x00\t\n\f\r ]+([0-9]+)(?=[\x00\t\n\f\r ])")
_TRAILER = re.compile(rb"(?:[\x00\t\n\f\r ]|%[^\r\n]*[\r\n])*trailer(?=[\x00\t\n\f\r <])")
#: Entries one after another, and how many are read at once.
_ENTRIES = re.compile(rb"[\x00\t\n\f\r ]*+(?:[0-9]{1,10}[\x00\t\n\f\r ]++[0-9]{1,5}[\x00\t\n\f\r ]++[nf][\x00\t\n\f\r ]++)*+")
_TOGETHER = 4096
_OBJECT = re.compile(rb"[\x00\t\n\f\r ]*+([+-]?[0-9]++)[\x00\t\n\f\r ]++([+-]?[0-9]++)[\x00\t\n\f\r ]++obj(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z)")
_ENDOBJ = re.compile(rb"[\x00\t\n\f\r ]*+endobj(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z)")
_VERSION = re.compile(rb"[12]\.[0-9]")
_UINT = re.compile(rb"[\x00\t\n\f\r ]+([0-9]+)")


@dataclass(slots=True)
class Entry:
    """One cross-reference record. kind: free, in_use, compressed, unknown."""

    num: int
    kind: str
    a: int  # next free number, byte offset, container number, or first field
    b: int  # generation, generation, index in container, or second field
    type: int = 1


@dataclass(slots=True)
class Section:
    order: int
    kind: str  # table or stream
    start: int
    end: int
    entries: list[Entry]
    trailer: Dictionary
    hybrid: bool = False


@dataclass(slots=True)
class Indirect:
    num: int
    gen: int
    body: Obj
    origin: str  # file or object_stream
    start: int = 0
    end: int = 0
    container: int | None = None
    index: int | None = None


@dataclass(slots=True)
class Source:
    """Bytes addressed by spans: 1 is the file, others are decoded or joined."""

    data: bytes
    inputs: list[tuple[int, int, int]] = field(default_factory=list)
    steps: list[tuple[str, bytes]] = field(default_factory=list)
    origin: str = "file"


class Document:
    """Structure of one file. Objects are parsed when asked for. After a failed open(), what was found stays readable."""

    def __init__(self, data: bytes, limits: Limits):
        self.limits = limits.checked()
        self.sources: dict[int, Source] = {1: Source(data)}
        self.data = data
        self.version: tuple[int, int] | None = None
        self.header_at = -1
        self.sections: list[Section] = []
        self.entries: dict[int, Entry] = {}
        self.trailer = Dictionary()
        self.encrypted = False
        self.diagnostics: list[tuple[str, str, tuple[int, int, int]]] = []
        self.regions: list[tuple[int, int, str]] = []
        self.tail: tuple[int, int, int] | None = None
        self.objects: dict[int, Indirect] = {}
        self._busy: set[int] = set()
        self._decoded: dict[tuple[int, int, int], int] = {}
        self._containers: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        self._spent = 0

    # --- opening

    def open(self) -> "Document":
        data = self.data
        if len(data) > self.limits.max_file_bytes:
            raise LimitError("file byte limit exceeded")
        m = _HEADER.search(data, 0, 1024)
        if not m or m.end() + 3 > len(data):
            raise PdfError("missing PDF header")
        v = data[m.end() : m.end() + 3]
        if not _VERSION.fullmatch(v):
            raise PdfError(f"invalid PDF header version {v.decode('latin-1')!r}")
        self.header_at, self.version = m.start(), (v[0] - 48, v[2] - 48)
        self._claim(m.start(), m.start() + 8, "header")
        if m.start():
            self.diagnostics.append(("leading-data", "bytes precede PDF header", (1, 0, m.start())))
        at = data.rfind(b"startxref")
        while at >= 0 and not _STARTXREF.match(data, at):
            at = data.rfind(b"startxref", 0, at)
        if at < 0:
            raise PdfError("missing startxref")
        n = _UINT.match(data, at + 9)
        if not n:
            raise PdfError("missing startxref offset", at)
        mark = _SPACES.match(data, n.end()).end()
        if data[mark : mark + 5] != b"%%EOF":
            raise PdfError("missing EOF marker after startxref", at)
        self.tail = (at, int(n.group(1)), mark + 5)
        self._claim(at, mark + 5, "file_tail")
        self._chain(int(n.group(1)))
        crypt = self.trailer.get(b"Encrypt")
        self.encrypted = crypt is not None and crypt.kind != "null"
        return self

    def _chain(self, offset: int) -> None:
        seen: set[int] = set()
        at: int | None = offset
        while at is not None:
            section = self._section(at, seen)
            self._merge(section)
            hidden = self._link(section.trailer, b"XRefStm")
            if hidden is not None:
                extra = self._section(hidden, seen)
                if extra.kind != "stream":
                    raise PdfError("XRefStm does not point at a cross-reference stream", hidden)
                extra.hybrid = True
                # a hybrid file's stream stands between its own table and older sections, but its
                # entries hide the table's: undo the table's and merge in that order
                self.sections.insert(len(self.sections) - 1, self.sections.pop())
                self._remerge()
            at = self._link(section.trailer, b"Prev")
        self.trailer = next((s.trailer for s in self.sections if not s.hybrid), Dictionary())

    def _link(self, trailer: Dictionary, key: bytes) -> int | None:
        o = trailer.get(key)
        if o is None or o.kind == "null":
            return None
        if o.kind != "integer" or not 0 <= int(o.value) < len(self.data):
            raise PdfError(f"invalid /{key.decode()}", o.start)
        return int(o.value)

    def _merge(self, section: Section) -> None:
        own = set()
        for e in section.entries:
            if e.num in own:
                raise PdfError(f"duplicate cross-reference entry {e.num}", section.start)
            own.add(e.num)
            self.entries.setdefault(e.num, e)
            if len(self.entries) > self.limits.max_objects:
                raise LimitError("object count limit exceeded")

    def _remerge(self) -> None:
        self.entries = {}
        for i, s in enumerate(self.sections):
            s.order = i
            self._merge(s)

    def _section(self, at: int, seen: set[int]) -> Section:
        if at in seen:
            raise PdfError("cross-reference cycle", at)
        if len(seen) >= self.limits.max_xref_sections:
            raise LimitError("cross-reference section limit exceeded", at)
        if not 0 <= at < len(self.data):
            raise PdfError("cross-reference offset outside the file", at)
        seen.add(at)
        start = _SPACES.match(self.data, at).end()
        found = self._table(start) if self.data[start : start + 4] == b"xref" else self._xref_stream(start)
        found.order = len(self.sections)
        self.sections.append(found)
        return found

    def _table(self, start: int) -> Section:
        at, entries = start + 4, []
        while not (t := _TRAILER.match(self.data, at)):
            m = _RANGE.match(self.data, at)
            if not m:
                raise PdfError("malformed cross-reference subsection", at)
            first, n = int(m.group(1)), int(m.group(2))
            at = m.end()
            if n > self.limits.max_objects or len(entries) + n > self.limits.max_objects:
                raise LimitError("object count limit exceeded", at)
            if n <= _TOGETHER:
                rows = self.data[at : _ENTRIES.match(self.data, at).end()].replace(b"\0", b" ")
                words = rows.split()
                if len(words) == 3 * n:
                    entries += [Entry(num, "in_use" if k == b"n" else "free", int(a), int(b), 1 if k == b"n" else 0) for num, a, b, k in zip(range(first, first + n), words[::3], words[1::3], words[2::3])]
                    at += len(rows.rstrip())
                    continue
            for num in range(first, first + n):
                e = _ENTRY.match(self.data, at)
                if not e:
                    raise PdfError("malformed cross-reference entry", at)
                entries.append(Entry(num, "in_use" if e.group(3) == b"n" else "free", int(e.group(1)), int(e.group(2)), 1 if e.group(3) == b"n" else 0))
                at = e.end()
        p = self._parser(t.end())
        body = p.value()
        if body is None or body.kind != "dictionary":
            raise PdfError("trailer is not a dictionary", t.end())
        self._claim(start, t.end() - 7, "xref")
        self._claim(t.end() - 7, body.end, "trailer")
        return Section(0, "table", start, body.end, entries, body.value)

    def _xref_stream(self, start: int) -> Section:
        found = self._indirect_at(start, None, direct_length=True)
        s = found.body.value
        if found.body.kind != "stream" or (t := s.dictionary.get(b"Type")) is None or t.value != b"XRef":
            raise PdfError("expected a cross-reference section", start)
        d = s.dictionary
        widths = [integer(x) for x in self._array(d.get(b"W"))]
        if len(widths) != 3 or any(not 0 <= w <= 8 for w in widths) or not sum(widths):
            raise PdfError("invalid cross-reference stream widths", start)
        size = integer(d.get(b"Size"))
        index = [integer(x) for x in self._array(d.get(b"Index"))] if d.get(b"Index") else [0, size]
        if len(index) % 2 or any(x < 0 for x in index):
            raise PdfError("invalid cross-reference stream index", start)
        raw = self.sources[self.decode(s, resolve=False)].data
        each, at, entries = sum(widths), 0, []
        for first, n in zip(index[::2], index[1::2]):
            if len(entries) + n > self.limits.max_objects:
                raise LimitError("object count limit exceeded", start)
            for num in range(first, first + n):
                row = raw[at : at + each]
                if len(row) < each:
                    raise PdfError("truncated cross-reference stream", start)
                at += each
                f = [int.from_bytes(row[sum(widths[:i]) : sum(widths[: i + 1])], "big") for i in range(3)]
                kind = f[0] if widths[0] else 1
                if kind > 2:
                    self.diagnostics.append(("unknown-xref-entry", f"unknown cross-reference entry type {kind}", (1, start, found.end)))
                entries.append(Entry(num, ("free", "in_use", "compressed")[kind] if kind <= 2 else "unknown", f[1], f[2], kind))
        self._claim(start, found.end, "xref")
        return Section(0, "stream", start, found.end, entries, d)

    def _array(self, o: Obj | None) -> list[Obj]:
        if o is None or o.kind != "array":
            raise PdfError("expected an array")
        return o.value

    # --- objects

    def _parser(self, at: int, source: int = 1, end: int | None = None) -> Parser:
        lim = self.limits
        return Parser(self.sources[source].data, at, end, source, lim.max_depth, lim.max_token_bytes, lim.max_values)

    def _at(self, pattern: re.Pattern, at: int) -> re.Match | None:
        """What stands at a place, unless the limit of a token could matter: the parser then looks at it."""
        m = pattern.match(self.data, at)
        return m if m is not None and m.end() - at <= self.limits.max_token_bytes else None

    def _indirect_at(self, at: int, want: tuple[int, int] | None, direct_length: bool = False) -> Indirect:
        p = self._parser(at)
        if m := self._at(_OBJECT, at):
            num, gen, p.at = int(m.group(1)), int(m.group(2)), m.end()
        else:
            p.references = False
            n, g = p.token(), p.token()
            if n[0] != "integer" or g[0] != "integer" or p.keyword() != b"obj":
                raise PdfError("expected an indirect object", at)
            num, gen = int(self.data[n[1] : n[2]]), int(self.data[g[1] : g[2]])
        if want is not None and (num, gen) != want:
            raise PdfError(f"object {num} {gen} found where {want[0]} {want[1]} was expected", at)
        p.references = True
        body = p.value()
        if body is None:
            raise PdfError("missing object body", at)
        word_at = p.at
        if m := self._at(_ENDOBJ, word_at):
            p.at, word = m.end(), b"endobj"
        else:
            word = p.keyword()
        if word == b"stream":
            if body.kind != "dictionary":
                raise PdfError("stream without a dictionary", body.start)
            start = p.at
            if self.data[start : start + 2] == b"\r\n":
                start += 2
            elif self.data[start : start + 1] == b"\n":
                start += 1
            else:
                raise PdfError("stream keyword is not followed by a line break", start)
            length = body.value.get(b"Length")
            if length is not None and length.kind == "reference":
                if direct_length:
                    raise PdfError("cross-reference stream with indirect /Length", at)
                length = self.resolve(length)
            size = integer(length)
            if size < 0 or start + size > len(self.data):
                raise PdfError("stream /Length outside the file", start)
            stop = re.compile(rb"(?:\r\n|\r|\n)?endstream(?=[\x00\t\n\f\r ]|\Z)").match(self.data, start + size)
            if not stop:
                raise PdfError("stream data is not followed by endstream", start + size)
            p.at = stop.end()
            body = Obj("stream", Stream(body.value, body.span, start, start + size), body.start, stop.end())
            word_at, word = p.at, p.keyword()
        if word != b"endobj":
            raise PdfError("missing endobj", word_at)
        self._claim(at, p.at, "indirect_object")
        return Indirect(num, gen, body, "file", _SPACES.match(self.data, at).end(), p.at)

    def load(self, num: int, gen: int = 0) -> Indirect:
        """The object with this id; absent, free and mismatched ids are errors."""
        if (known := self.objects.get(num)) is not None and known.gen == gen:
            return known
        e = self.entries.get(num)
        if e is None:
            raise MissingKey(f"object {num} is not in the cross-reference table")
        if e.kind == "free":
            raise PdfError(f"object {num} is free")
        if num in self._busy:
            raise PdfError(f"cycle while loading object {num}")
        self._busy.add(num)
        try:
            if e.kind == "in_use":
                if e.b != gen:
                    raise PdfError(f"object {num} has generation {e.b}, not {gen}")
                found = self._indirect_at(e.a, (num, gen))
            elif e.kind == "compressed":
                if gen:
                    raise PdfError(f"compressed object {num} must have generation 0")
                found = self._member(num, e.a, e.b)
            else:
                raise PdfError(f"object {num} has an unknown cross-reference type")
        finally:
            self._busy.discard(num)
        self.objects[num] = found
        return found

    def object_stream(self, container: int) -> tuple[int, list[tuple[int, int]]]:
        """Source and (object number, offset) pairs of an object stream."""
        if container in self._containers:
            return self._containers[container]
        e = self.entries.get(container)
        if e is None or e.kind != "in_use":
            raise PdfError(f"object stream {container} is not an ordinary object")
        s = self.load(container, e.b).body
        if s.kind != "stream" or (t := s.value.dictionary.get(b"Type")) is None or t.value != b"ObjStm":
            raise PdfError(f"object {container} is not an object stream")
        d = s.value.dictionary
        n, first = (integer(self.direct(d.get(k))) for k in (b"N", b"First"))
        source = self.decode(s.value)
        data = self.sources[source].data
        if n < 0 or n > self.limits.max_objects or not 0 <= first <= len(data):
            raise PdfError("invalid object stream header")
        words = data[:first].split()
        if len(words) != 2 * n or not all(w.isdigit() for w in words):
            raise PdfError("malformed object stream index")
        pairs = [(int(a), int(b) + first) for a, b in zip(words[::2], words[1::2])]
        if len({a for a, _ in pairs}) != n or any(b <= a for (_, a), (_, b) in zip(pairs, pairs[1:])) or any(b > len(data) for _, b in pairs):
            raise PdfError("object stream index out of order")
        self._containers[container] = source, pairs
        return source, pairs

    def _member(self, num: int, container: int, index: int) -> Indirect:
        source, pairs = self.object_stream(container)
        if index >= len(pairs) or pairs[index][0] != num:
            raise PdfError(f"object {num} is not member {index} of object stream {container}")
        start = pairs[index][1]
        end = pairs[index + 1][1] if index + 1 < len(pairs) else len(self.sources[source].data)
        p = self._parser(start, source, end)
        body = p.value()
        if body is None or p.token()[0] != "eof":
            raise PdfError(f"object {num} in object stream {container} is malformed")
        return Indirect(num, 0, body, "object_stream", body.start, body.end, container, index)

    def resolve(self, o: Obj | None) -> Obj | None:
        """Follow references; undefined ones are null. A chain may take max_depth hops."""
        seen: set[tuple[int, int]] = set()
        while o is not None and o.kind == "reference":
            if o.value in seen:
                raise PdfError("reference cycle", o.start)
            if len(seen) >= self.limits.max_depth:
                raise LimitError("reference depth limit exceeded", o.start)
            seen.add(o.value)
            num, gen = o.value
            e = self.entries.get(num)
            if e is None or e.kind in ("free", "unknown") or (e.kind == "in_use" and e.b != gen) or (e.kind == "compressed" and gen):
                return Obj("null", None, o.start, o.end, o.source)
            o = self.load(num, gen).body
        return o

    def direct(self, o: Obj | None) -> Obj | None:
        """Resolved value, or None where it is absent or null."""
        o = self.resolve(o)
        return None if o is None or o.kind == "null" else o

    def mapping(self, o: Obj | None, what: str) -> Dictionary:
        """The dictionary an object is, or has as a stream; no key may stand in it twice."""
        o = self.resolve(o)
        if o is None or o.kind not in ("dictionary", "stream"):
            raise PdfError(f"{what} is not a dictionary", o.start if o else -1)
        d = o.value if o.kind == "dictionary" else o.value.dictionary
        seen: set[bytes] = set()
        for key, _ in d.entries:
            if key in seen:
                raise PdfError(f"duplicate key /{key.decode('latin-1')} in {what}", o.start)
            seen.add(key)
        return d

    def name(self, d: Dictionary, key: bytes) -> bytes:
        """The name under a key; empty where there is none, an error where it is something else."""
        o = self.direct(d.get(key))
        if o is None:
            return b""
        if o.kind != "name":
            raise PdfError(f"/{key.decode('latin-1')} is not a name", o.start)
        return o.value

    def catalog(self) -> Dictionary:
        root = self.trailer.get(b"Root")
        if root is None or root.kind != "reference":
            raise PdfError("trailer /Root is not a reference")
        return self.mapping(root, "catalog")

    # --- streams and sources

    def bytes(self, span: tuple[int, int, int]) -> bytes:
        source, start, end = span
        if source not in self.sources or not 0 <= start <= end <= len(self.sources[source].data):
            raise PdfError("span outside its source")
        return self.sources[source].data[start:end]

    def filters_of(self, d: Dictionary, resolve: bool = True) -> list[tuple[bytes, Dictionary | None]]:
        get = self.direct if resolve else lambda o: None if o is None or o.kind == "null" else o
        if get(d.get(b"F")) is not None:
            raise UnsupportedError("external stream data")
        f, parms = get(d.get(b"Filter")), get(d.get(b"DecodeParms"))
        if f is None:
            if parms is not None and not (parms.kind == "array" and not parms.value):
                raise PdfError("DecodeParms without Filter")
            return []
        names = [get(x) for x in f.value] if f.kind == "array" else [f]
        if any(x is None or x.kind != "name" for x in names):
            raise PdfError("invalid stream filter")
        if parms is None:
            each = [None] * len(names)
        elif parms.kind == "array":
            each = [get(x) for x in parms.value]
        elif parms.kind == "dictionary":
            each = [parms]
        else:
            raise PdfError("DecodeParms is no dictionary or array")
        # only Flate has parameters that matter here; what stands beside other filters is not looked at
        flate = [filters.SHORT.get(n.value, n.value) == b"FlateDecode" for n in names]
        if len(each) != len(names) or any(own and x is not None and x.kind != "dictionary" for own, x in zip(flate, each)):
            raise PdfError("DecodeParms do not match filters")
        return [(n.value, x.value if own and x else None) for own, n, x in zip(flate, names, each)]

    def decode(self, s: Stream, resolve: bool = True) -> int:
        """Source number of a stream's decoded bytes."""
        if self.encrypted:
            raise UnsupportedError("encrypted stream")
        if s.span in self._decoded:
            return self._decoded[s.span]
        data, steps = self.bytes(s.span), []
        for name, parms in self.filters_of(s.dictionary, resolve):
            data = filters.decode(name, data, self.limits.max_decoded_bytes - self._spent)
            if parms is not None:
                get = self.direct if resolve else lambda o: o
                one = lambda k, default: integer(v) if (v := get(parms.get(k))) is not None else default  # noqa: E731,B023
                data = filters.unpredict(data, one(b"Predictor", 1), one(b"Colors", 1), one(b"BitsPerComponent", 8), one(b"Columns", 1))
            steps.append(("filter", name))
        if not steps:
            data = self.bytes(s.span)
        self._spent += len(data)
        if self._spent > self.limits.max_decoded_bytes:
            raise LimitError("decoded byte limit exceeded")
        self._decoded[s.span] = self._add(Source(data, [s.span], steps, "decoded"))
        return self._decoded[s.span]

    def _add(self, source: Source) -> int:
        n = len(self.sources) + 1
        self.sources[n] = source
        return n

    def join(self, parts: list[int]) -> int:
        """One source out of several, nothing between them; a single one stays itself."""
        if len(parts) == 1:
            return parts[0]
        return self._add(Source(b"".join(self.sources[p].data for p in parts), [(p, 0, len(self.sources[p].data)) for p in parts], [], "joined"))

    # --- regions

    def _claim(self, start: int, end: int, kind: str) -> None:
        self.regions.append((start, end, kind))
        if len(self.regions) > self.limits.max_region_work:
            raise LimitError("region work limit exceeded")

    def region_map(self) -> list[tuple[int, int, str]]:
        """Claimed intervals, later claims first, and the unknown gaps: a partition of the file."""
        cover: list[tuple[int, int, str]] = []
        for start, end, kind in dict.fromkeys(reversed(self.regions)):
            i = bisect_left(cover, (start, start, ""))
            if i and cover[i - 1][1] > start:
                start = cover[i - 1][1]
            while start < end:
                stop = min(end, cover[i][0]) if i < len(cover) else end
                if stop > start:
                    cover.insert(i, (start, stop, kind))
                    i += 1
                if i >= len(cover):
                    break
                start = max(stop, cover[i][1])
                i += 1
        out, at = [], 0
        for start, end, kind in cover:
            if start > at:
                out.append((at, start, "unknown"))
            out.append((start, end, kind))
            at = end
        if at < len(self.data):
            out.append((at, len(self.data), "unknown"))
        return out
