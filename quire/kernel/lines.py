"""Visual lines of pages, straight from their content: texts are checked and counted as at the full level, but no rows are made of them."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice, repeat
from operator import add

from ..options import FULL, TEXT, ParseOptions
from .document import Document
from .errors import PdfError
from .interp import IDENTITY, Fold, Interpretation
from .syntax import Content

_W, _N = rb"[\t\n\f\r ]++", rb"[+-]?+[0-9]{1,9}+(?:\.[0-9]{0,9}+)?+"
#: Strings each put at an upright place, `1 0 0 1 x y Tm <codes> Tj`, so many at once.
_WORDS = re.compile(rb"(?:[\t\n\f\r ]*+" + _W.join((rb"1", rb"0", rb"0", rb"1", _N, _N, rb"Tm", rb"<[0-9A-Fa-f]*+>", rb"Tj")) + rb"(?=[\t\n\f\r ]|\Z)){1,4096}+")
#: What is a multiple of 1 / _FINE and below _FAR is added without rounding.
_FINE, _FAR = 1024.0, 2.0**40
_BLANK = frozenset(" \t\n\x0b\f\r")
_MOST = (1 << 63) - 1


class _Codes(dict):
    def __missing__(self, code):
        raise ValueError(code)


def rounded(y: float) -> int:
    """Half away from zero, within 64 bits."""
    n = math.floor(abs(y))
    n += abs(y) - n >= 0.5
    return max(-n, -_MOST - 1) if y < 0 else min(n, _MOST)


class LineFold(Fold):
    """Keeps pieces of lines in page.texts: (y, x of the first glyph, operation, number of that glyph in it, end of the last, font size, text, step; None for a glyph)."""

    def together(self, content: Content) -> bool:
        """Read the upright strings that come next at once, if each of their steps is sure to be right and within the limits; else they go one by one."""
        run, g, parser = self.run, self.g, content.parser
        m = _WORDS.match(parser.data, parser.at, parser.end)
        if m is None or m.end() - m.start() > parser.max_token:
            return False
        table = run.table(g.font)
        if table is None or g.ctm != IDENTITY or g.rise or g.char_space or g.h_scale != 1 or not 0 <= g.size * run.gap:
            return False
        step = g.font.default * g.font.scale * g.size
        words = m.group().split()
        across, up, strings = words[4::9], words[5::9], words[7::9]
        n, sizes = len(strings), list(map(len, strings))
        glyphs = {s: s - 2 >> 2 for s in set(sizes)}
        whole = b"." not in m.group()
        xs = list(map(int if whole else float, across))
        if not 0 <= step < _FAR or not (step * _FINE).is_integer() or any(s - 2 & 3 for s in glyphs) or not (whole or all((x * _FINE).is_integer() for x in xs)):
            return False
        try:
            text = bytes.fromhex(b"".join(strings)[1:-1].replace(b"><", b"0000").decode()).decode("utf-16-be", "surrogatepass").translate(table)
        except ValueError:
            return False
        texts, total = text.split("\n"), sum(map(glyphs.__getitem__, sizes))
        wide = {s: step * k for s, k in glyphs.items()}
        ends = list(map(add, xs, map(wide.__getitem__, sizes)))
        spent = {"semantic": 2 * n, "values": 7 * n, "codes": 2 * total, "unicode": len(text.encode()) - n + 1, "style": n * self.style_size()}
        if len(texts) != n or len(text) != total + n - 1 or max(ends) >= _FAR or any(run.left[k] < v for k, v in spent.items()):
            return False
        for k, v in spent.items():
            run.left[k] -= v
        parser.values -= spent["values"]
        parser.at = m.end()
        first, height = self.page.n_operations + 1, {w: rounded(float(w)) for w in set(up)}
        self.page.n_operations += 2 * n
        pieces = zip(map(height.__getitem__, up), xs, range(first, first + 2 * n, 2), repeat(0), ends, repeat(g.size), texts, repeat(step))
        self.page.texts += [p for p in pieces if p[6]] if 2 in glyphs else pieces
        y = float(up[-1])
        self.tm, self.tlm, self.placed = (1.0, 0.0, 0.0, 1.0, ends[-1], y), (1.0, 0.0, 0.0, 1.0, float(xs[-1]), y), True
        return True

    def operation(self, name, operands):
        pass

    def provenance(self, spans=None, operations=None):
        return None

    def style_size(self) -> int:
        return len(self.g.dash) + len(self.g.stroke.components) + len(self.g.fill.components)

    def style(self):
        self.run.spend("style", self.style_size())

    def state(self):
        return None

    def emit(self, kind, row):
        if kind == 1:
            for k, v in enumerate(row["glyphs"]):
                x = v["origin"]["x"]
                self.page.texts.append((rounded(v["origin"]["y"]), x, self.index, k, x + v["advance"]["x"], row["font_size"], v["unicode"], None))


class Lines(Interpretation):
    """A run over texts at the full level that keeps pieces of lines."""

    folding = LineFold

    def __init__(self, doc: Document, options: ParseOptions, gap: float):
        super().__init__(doc, options)
        self.gap = gap
        self.tables: dict[int, _Codes | None] = {}

    def table(self, font) -> _Codes | None:
        """Texts of a font's two-byte codes, a character each, if all have the same known width; 0, which is none of them, is a line's end."""
        if font is None:
            return None
        if font.index not in self.tables:
            plain = font.cmap is not None and font.cmap.spaces == [(b"\0\0", b"\xff\xff")] and font.positioned and font.default_known and not font.widths
            plain = plain and b"\0\0" not in font.cmap.mapping and all(len(u) == 1 and u != "\n" for u in font.cmap.mapping.values())
            self.tables[font.index] = _Codes({0: "\n"} | {int.from_bytes(c, "big"): u for c, u in font.cmap.mapping.items()}) if plain else None
        return self.tables[font.index]


def _glyphs(pieces: list[tuple]) -> Iterator[tuple]:
    """Pieces of one glyph each."""
    for y, x, op, k, end, size, text, step in pieces:
        if step:
            yield from ((y, at := x + step * i, op, k + i, at + step, size, c, None) for i, c in enumerate(text))
        else:
            yield y, x, op, k, end, size, text, step


def _parts(line: list[tuple], gap: float) -> list[str] | None:
    """Texts of sorted pieces with the spaces between them; None if one begins before the last glyph of what it follows."""
    _, _, at, _, end, _, text, step = line[0]
    parts = [text]
    for _, x, op, _, to, size, word, wide in islice(line, 1, None):
        if x < end and step and (x, op) < (end - step, at):
            return None
        parts.append(" " + word if x - end > size * gap and not (text[-1] in _BLANK if step is not None else _BLANK.issuperset(text)) else word)
        at, end, text, step = op, to, word, wide
    return parts


def joined(pieces: list[tuple], gap: float) -> list[tuple[int, str]]:
    """(y, line) of a page's pieces, left to right; a gap above `gap` of the font size is a space."""
    lines = defaultdict(list)
    for p in pieces:
        lines[p[0]].append(p)
    out = []
    for y, line in lines.items():
        line.sort()
        parts = _parts(line, gap) or _parts(sorted(_glyphs(line)), gap)
        out.append((y, "".join(parts).rstrip(" ")))
    return out
