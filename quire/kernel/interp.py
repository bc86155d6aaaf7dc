"""Pages and their content: a fold over operators that emits text, graphics, images, annotations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from ..options import ANNOTATIONS, FULL, GRAPHICS, IMAGES, LAYOUT, TEXT, ParseOptions
from .document import Document
from .errors import LimitError, PdfError, UnsupportedError
from .fonts import REPLACEMENT, Font, UnicodeMaps, load_font
from .syntax import Content, Dictionary, Inline, Obj, Stream, integer, number

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
FORM_DEPTH, PAGE_DEPTH, STACK_DEPTH = 64, 128, 256


def mul(m, n):
    """The matrix that applies n first, then m."""
    a, b, c, d, e, f = m
    return (n[0] * a + n[1] * c, n[0] * b + n[1] * d, n[2] * a + n[3] * c, n[2] * b + n[3] * d, n[4] * a + n[5] * c + e, n[4] * b + n[5] * d + f)


def apply(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def finite(values) -> bool:
    return all(map(math.isfinite, values))


@dataclass(frozen=True, slots=True)
class Color:
    space: str = "DeviceGray"
    components: tuple[float, ...] = (0.0,)
    pattern: str | None = None


class Graphics(NamedTuple):
    """Graphics state; a value, so that q keeps it by keeping a reference."""

    ctm: tuple = IDENTITY
    stroke: Color = Color()
    fill: Color = Color()
    line_width: float = 1.0
    line_cap: int = 0
    line_join: int = 0
    miter_limit: float = 10.0
    dash: tuple[float, ...] = ()
    dash_phase: float = 0.0
    intent: str | None = None
    stroke_alpha: float = 1.0
    fill_alpha: float = 1.0
    blend_mode: str = "Normal"
    clip: tuple = ()
    complete: bool = True
    font: Font | None = None
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    h_scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    render: int = 0


@dataclass
class Page:
    index: int
    span: tuple[int, int, int]
    num: int | None = None
    gen: int | None = None
    media_box: tuple | None = None
    crop_box: tuple | None = None
    rotate: int = 0
    user_unit: float = 1.0
    complete: bool = True
    n_operations: int = 0
    texts: list[dict] = field(default_factory=list)
    graphics: list[dict] = field(default_factory=list)
    images: list[dict] = field(default_factory=list)
    annotations: list[dict] = field(default_factory=list)
    operations: list[dict] = field(default_factory=list)
    items: list[tuple[int, int]] = field(default_factory=list)


class Interpretation:
    """All pages of a document under one choice of content and detail; keeps what it has when an error ends it."""

    #: The kind of Fold that reads contents, if another.
    folding: type | None = None

    def __init__(self, doc: Document, options: ParseOptions):
        self.doc, self.options = doc, options
        self.content, self.detail = options.content, options.detail
        drawn = bool(self.content & (TEXT | GRAPHICS | IMAGES))
        self.styles = drawn and self.detail >= LAYOUT
        self.positions = bool(self.content & TEXT) and self.detail >= LAYOUT
        self.transforms = bool(self.content & GRAPHICS) or self.detail >= LAYOUT and bool(self.content & (TEXT | IMAGES))
        self.full = self.detail == FULL
        self.pages: list[Page] = []
        self.fonts: dict[tuple, Font] = {}
        self.image_resources: dict[tuple, dict] = {}
        self.diagnostics: list[tuple[int, str, str, tuple]] = []
        self.active_forms: set[tuple] = set()
        lim = doc.limits
        self.depth = min(PAGE_DEPTH, lim.max_depth)
        self.left = {"semantic": lim.max_semantic_objects, "content": lim.max_content_bytes, "values": lim.max_values, "codes": lim.max_objects, "unicode": lim.max_decoded_bytes, "clips": lim.max_objects, "style": lim.max_values}
        self.maps = UnicodeMaps(lim.max_objects, lambda n: self.spend("unicode", n), lambda: self.left["unicode"])

    def spend(self, what: str, n: int = 1) -> None:
        self.left[what] -= n
        if self.left[what] < 0:
            raise LimitError(f"{what} limit exceeded")

    def diagnose(self, page: Page, code: str, message: str, span: tuple) -> None:
        self.spend("semantic")
        self.spend("unicode", len(code) + len(message))
        page.complete = False
        self.diagnostics.append((page.index, code, message, span))

    # --- pages

    def run(self) -> "Interpretation":
        if self.doc.encrypted:
            raise UnsupportedError("encrypted documents are not supported")
        pages = self.doc.catalog().get(b"Pages")
        if pages is None:
            raise PdfError("catalog has no /Pages")
        self._walk(pages)
        return self

    def _dict(self, o: Obj | None, what: str) -> Dictionary:
        """A dictionary of resources, whose entries count as semantic objects each time it is looked into."""
        d = self.doc.mapping(o, what)
        self.spend("semantic", len(d.entries))
        return d

    def _walk(self, root: Obj) -> None:
        # entries: (reference, inherited attributes, spans on the path); a stack keeps Kids order
        todo = [(root, {}, ())]
        while todo:
            ref, above, path = todo.pop()
            if len(path) >= self.depth:
                raise LimitError("page tree depth limit exceeded")
            o = self.doc.resolve(ref)
            if o.span in path:
                raise PdfError("page tree leads back to itself", o.start)
            d = self.doc.mapping(o, "page tree node")
            self.spend("semantic")
            get = lambda k, d=d: self.doc.direct(d.get(k))
            kind = self.doc.name(d, b"Type")
            only_notes = not self.content & (TEXT | GRAPHICS | IMAGES)
            keys = (b"MediaBox", b"CropBox", b"Rotate") if only_notes else (b"MediaBox", b"CropBox", b"Rotate", b"Resources")
            own = dict(above)
            for k in keys:
                if (v := get(k)) is not None:
                    own[k] = v
            if kind == b"Pages":
                kids = get(b"Kids")
                if kids is None or kids.kind != "array":
                    raise PdfError("page tree node without Kids", o.start)
                todo += [(k, own, (*path, o.span)) for k in reversed(kids.value)]
            elif kind == b"Page":
                self._page(ref, o, d, own)
            else:
                raise PdfError("page tree node has an unknown type", o.start)

    def rect(self, o: Obj) -> tuple:
        x0, y0, x1, y1 = self.numbers(o, 4)
        return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)

    def numbers(self, o: Obj, n: int | None = None) -> list[float]:
        o = self.doc.resolve(o)
        if o is None or o.kind != "array" or n is not None and len(o.value) != n:
            raise PdfError("expected an array of numbers", o.start if o else -1)
        return [number(self.doc.resolve(x)) for x in o.value]

    def _page(self, ref: Obj, o: Obj, d: Dictionary, own: dict) -> None:
        get = lambda k: self.doc.direct(d.get(k))
        page = Page(len(self.pages), o.span, *(ref.value if ref.kind == "reference" else (None, None)))
        if b"MediaBox" not in own:
            raise PdfError("page without MediaBox", o.start)
        page.media_box = self.rect(own[b"MediaBox"])
        page.crop_box = self.rect(own[b"CropBox"]) if b"CropBox" in own else page.media_box
        if b"Rotate" in own:
            turn = integer(own[b"Rotate"])
            if turn % 90:
                raise PdfError("page rotation is not a multiple of 90", o.start)
            page.rotate = int(math.fmod(turn, 360))
        if (unit := get(b"UserUnit")) is not None:
            page.user_unit = number(unit)
            if page.user_unit <= 0:
                raise PdfError("UserUnit is not positive", unit.start)
        drawn = bool(self.content & (TEXT | GRAPHICS | IMAGES))
        resources, contents = Dictionary(), get(b"Contents") if drawn else None
        if drawn and b"Resources" in own:
            resources = self._dict(own[b"Resources"], "Resources")
        if contents is not None and contents.kind not in ("stream", "array"):
            raise PdfError("page Contents are neither a stream nor an array", contents.start)
        self.pages.append(page)
        try:
            if contents is not None:
                self._contents(page, contents, resources)
            if self.content & ANNOTATIONS:
                self._annotations(page, d)
        except PdfError:
            page.complete = False
            raise

    def _contents(self, page: Page, contents: Obj, resources: Dictionary) -> None:
        sources = []
        for x in [contents] if contents.kind == "stream" else map(self.doc.resolve, contents.value):
            if x.kind != "stream":
                raise PdfError("a member of the page Contents is not a stream", x.start)
            sources.append(self.decoded(x.value))
        if not sources:
            return
        source = self.doc.join(sources)
        fold = (self.folding or Fold)(self, page, resources)
        fold.read(source)
        if fold.in_text or fold.stack:
            self.diagnose(page, "unbalanced-content-state", "text or graphics state left open at the end of the page", page.span)

    def decoded(self, s: Stream) -> int:
        self.spend("semantic")
        source = self.doc.decode(s)
        self.spend("content", len(self.doc.sources[source].data))
        return source

    def _annotations(self, page: Page, d: Dictionary) -> None:
        notes = self.doc.direct(d.get(b"Annots"))
        if notes is None:
            return
        if notes.kind != "array":
            raise PdfError("Annots is not an array", notes.start)
        for x in notes.value:
            self.spend("semantic")
            note = self.doc.resolve(x)
            about = self.doc.mapping(note, "annotation")
            kind, box = self.doc.name(about, b"Subtype"), self.doc.direct(about.get(b"Rect"))
            row = {"subtype": kind.decode("latin-1"), "rect": self.rect(box) if box is not None else (0.0,) * 4}
            if self.full:
                row["source"] = {"spans": [note.span], "operations": [], "form_path": []}
            page.annotations.append(row)

    # --- resources

    def font(self, o: Obj, page: Page) -> Font:
        target = self.doc.resolve(o)
        if target.span not in self.fonts:
            f = load_font(self.doc, target, len(self.fonts), self.positions, self.full, self.maps, self.options.glyphs)
            if o.kind == "reference":
                f.num, f.gen = o.value
            self.fonts[target.span] = f
            for code, message in f.diagnostics:
                self.diagnose(page, code, message, target.span)
        return self.fonts[target.span]

    def image(self, o: Obj | None, target: Obj, d: Dictionary, inline: bool = False) -> int:
        """Index of an image resource, by where it is written."""
        if target.span not in self.image_resources:
            if inline:
                self.spend("semantic")
            get = lambda short, full: self.doc.direct(d.get(full)) or (self.doc.direct(d.get(short)) if inline else None)
            sizes = [integer(get(*k)) for k in ((b"W", b"Width"), (b"H", b"Height"))]
            if any(not 0 <= x <= 1 << 30 for x in sizes):
                raise PdfError("invalid image size", target.start)
            bits, mask = get(b"BPC", b"BitsPerComponent"), get(b"IM", b"ImageMask")
            if mask is not None and mask.kind != "boolean":
                raise PdfError("ImageMask is not a boolean", mask.start)
            space = get(b"CS", b"ColorSpace")
            self.image_resources[target.span] = {
                "index": len(self.image_resources), "id_num": o.value[0] if o is not None and o.kind == "reference" else 0, "id_gen": o.value[1] if o is not None and o.kind == "reference" else 0,
                "width": sizes[0], "height": sizes[1], "bits_per_component": integer(bits) if bits is not None else None, "image_mask": bool(mask.value) if mask is not None else False,
                "color_space": self.doc.bytes(space.span).decode("latin-1") if space is not None else None, "object": target.span if self.full else None,
            }
        return self.image_resources[target.span]["index"]


def numbers_of(operands: list[Obj], n: int) -> list[float]:
    if len(operands) != n:
        raise PdfError(f"operator needs {n} numbers")
    return [number(o) for o in operands]


def none_of(operands: list[Obj]) -> None:
    if operands:
        raise PdfError("operator takes no operands", operands[0].start)


def name_of(operands: list[Obj]) -> bytes:
    if len(operands) != 1 or operands[0].kind != "name":
        raise PdfError("operator needs one name")
    return operands[0].value


class Fold:
    """The state of one content stream (a page's, or a form's inside it) and what each operator does to it."""

    #: Reads several operators at once inside a text object, and tells whether it did.
    together: Callable[[Content], bool] | None = None

    def __init__(self, run: Interpretation, page: Page, resources: Dictionary, parent: "Fold | None" = None):
        self.run, self.page, self.resources, self.parent = run, page, resources, parent
        self.g = parent.g if parent else Graphics()
        self.tm = parent.tm if parent else IDENTITY
        self.tlm = parent.tlm if parent else IDENTITY
        self.placed = parent.placed if parent else True
        self.depth = parent.depth + 1 if parent else 0
        self.form_path: list[dict] = list(parent.form_path) if parent else []
        self.stack: list[Graphics] = []
        self.in_text = False
        self.path: list[tuple[str, list]] = []
        self.path_ops: list[int] = []
        self.path_spans: list[tuple] = []
        self.current = self.start = (0.0, 0.0)
        self.pending: str | None = None
        self.started = False
        self.spans: list[tuple] = []

    def read(self, source: int) -> None:
        lim = self.run.doc.limits
        content = Content(self.run.doc.sources[source].data, source, lim.max_depth, lim.max_token_bytes, self.run.left["values"])
        before, together = content.parser.values, self.together
        while True:
            if together and self.in_text:
                while together(content):
                    before = content.parser.values
            if (step := content.next()) is None:
                break
            op, operands, start, end = step
            self.run.left["values"] -= before - content.parser.values
            before = content.parser.values
            if not op:
                raise PdfError("operands without an operator at the end of the content", operands[0].start)
            self.run.spend("semantic")
            self.span, self.index = (source, start, end), self.page.n_operations
            self.page.n_operations += 1
            name = op.decode("latin-1")
            self.spans = [*(o.span for o in operands), self.span] if self.run.full else []
            if op == b"BI":
                none_of(operands)
                found = content.inline_image()
                pairs = (source, found.dict_start, found.dict_end)
                self.spans = [pairs, self.span] if self.run.full else []
                self.operation(name, [pairs])
                self.inline(found, pairs)
                continue
            if self.run.full:
                self.operation(name, [o.span for o in operands])
            self.execute(name, operands)

    def operation(self, name: str, operands: list[tuple]) -> None:
        """Keep an operator and its operands as written (an inline image: its dictionary) at the full level."""
        if self.run.full:
            written = [self.run.doc.bytes(span).decode("latin-1") for span in operands]
            self.page.operations.append({"operator": name, "operands": written, "span": self.span, "form_path": list(self.form_path)})

    def execute(self, op: str, operands: list[Obj]) -> None:
        if op in _STYLE_ONLY and not self.run.styles:
            return
        handler = _HANDLERS.get(op)
        if handler is None:
            self.unsupported(f"operator {op[:32]} is kept without its effect")
        else:
            handler(self, op, operands)

    def unsupported(self, message: str) -> None:
        self.g = self.g._replace(complete=False)
        self.run.diagnose(self.page, "unsupported-content-effect", message, self.span)

    def set(self, **changes) -> None:
        self.g = self.g._replace(**changes)

    def resource(self, category: bytes, name: bytes) -> Obj:
        self.run.spend("semantic", len(self.resources.entries))
        group = self.run.doc.direct(self.resources.get(category))
        if group is None:
            raise PdfError(f"no /{category.decode()} resources")
        found = self.run._dict(group, f"/{category.decode()} resources").get(name)
        if found is None:
            raise PdfError(f"missing /{category.decode()} resource {name.decode('latin-1')!r}")
        return found

    # --- rows

    def provenance(self, spans=None, operations=None) -> dict | None:
        if not self.run.full:
            return None
        return {"spans": spans or list(self.spans), "operations": operations or [self.index], "form_path": list(self.form_path)}

    def style(self) -> dict | None:
        if not self.run.styles:
            return None
        g = self.g
        self.run.spend("style", len(g.dash) + len(g.stroke.components) + len(g.fill.components))
        color = lambda c: {"space": c.space, "components": list(c.components), "pattern": c.pattern}
        return {"stroke": color(g.stroke), "fill": color(g.fill), "line_width": g.line_width, "line_cap": g.line_cap, "line_join": g.line_join, "miter_limit": g.miter_limit, "dash": list(g.dash), "dash_phase": g.dash_phase, "stroke_alpha": g.stroke_alpha, "fill_alpha": g.fill_alpha, "blend_mode": g.blend_mode, "clipped": bool(g.clip), "complete": g.complete}

    def state(self) -> dict | None:
        """What only the full level keeps of the graphics state."""
        if not self.run.full:
            return None
        return {"ctm": list(self.g.ctm), "rendering_intent": self.g.intent, "clip": [{"even_odd": e, "segments": [{"op": o, "points": p} for o, p in s]} for s, e in self.g.clip]}

    def emit(self, kind: int, row: dict) -> None:
        rows = {1: self.page.texts, 2: self.page.graphics, 3: self.page.images}[kind]
        self.page.items.append((kind, len(rows)))
        rows.append(row)

    # --- general state

    def save(self, op, operands):
        none_of(operands)
        if len(self.stack) >= min(STACK_DEPTH, self.run.depth):
            raise LimitError("graphics state stack limit exceeded")
        self.stack.append(self.g)

    def restore(self, op, operands):
        none_of(operands)
        if not self.stack:
            raise PdfError("Q without q")
        self.g = self.stack.pop()

    def concat(self, op, operands):
        if not self.run.transforms:
            return
        m = mul(self.g.ctm, numbers_of(operands, 6))
        if not finite(m):
            raise PdfError("transformation overflow")
        self.set(ctm=m)

    def line(self, op, operands):
        (v,) = numbers_of(operands, 1)
        self.line_value(op, v)

    def line_value(self, op: str, v: float) -> None:
        if op == "w":
            if v < 0:
                raise PdfError("negative line width")
            self.set(line_width=v)
        elif op == "M":
            if v < 1:
                raise PdfError("miter limit below 1")
            self.set(miter_limit=v)
        else:
            if v not in (0, 1, 2):
                raise PdfError("line cap or join outside 0 to 2")
            self.set(**{"line_cap" if op == "J" else "line_join": int(v)})

    def dash(self, op, operands):
        if len(operands) != 2 or operands[0].kind != "array":
            raise PdfError("d needs an array and a phase")
        self.dash_value([number(x) for x in operands[0].value], number(operands[1]))

    def dash_value(self, values: list[float], phase: float) -> None:
        if any(v < 0 for v in values) or values and not any(values):
            raise PdfError("invalid dash pattern")
        self.set(dash=tuple(values), dash_phase=phase)

    def intent(self, op, operands):
        self.set(intent=name_of(operands).decode("latin-1"))

    def paint_color(self, op: str, color: Color) -> None:
        self.set(**{"stroke" if op[0].isupper() else "fill": color})

    def device(self, op, operands):
        space, n = {"g": ("DeviceGray", 1), "r": ("DeviceRGB", 3), "k": ("DeviceCMYK", 4)}[op[0].lower()]
        self.paint_color(op, Color(space, tuple(numbers_of(operands, n))))

    def space(self, op, operands):
        name = name_of(operands).decode("latin-1")
        first = {"DeviceGray": (0.0,), "DeviceRGB": (0.0,) * 3, "DeviceCMYK": (0.0, 0.0, 0.0, 1.0)}.get(name)
        if first is None:
            self.unsupported("colour spaces other than device ones are kept without conversion")
        self.paint_color(op, Color(name, first or ()))

    def color(self, op, operands):
        old = self.g.stroke if op[0] == "S" else self.g.fill
        pattern, values = old.pattern, operands
        if values and values[-1].kind == "name":
            pattern, values = values[-1].value.decode("latin-1"), values[:-1]
            self.unsupported("pattern colours are kept without their pattern")
        self.paint_color(op, Color(old.space, tuple(number(o) for o in values), pattern))

    def ext_state(self, op, operands):
        name = name_of(operands)
        run = self.run
        if not (run.content & TEXT or run.styles):
            return
        d = run._dict(self.resource(b"ExtGState", name), "ExtGState")
        for key, raw in d.entries:
            if not (run.content & TEXT if key == b"Font" else run.styles):
                continue
            v = run.doc.direct(raw)
            if v is None or key == b"Type":
                continue
            if key in (b"LW", b"LC", b"LJ", b"ML"):
                self.line_value({b"LW": "w", b"LC": "J", b"LJ": "j", b"ML": "M"}[key], number(v))
            elif key in (b"CA", b"ca"):
                alpha = number(v)
                if not 0 <= alpha <= 1:
                    raise PdfError("alpha outside 0 to 1", v.start)
                self.set(**{"stroke_alpha" if key == b"CA" else "fill_alpha": alpha})
            elif key == b"BM" and v.kind == "name":
                self.set(blend_mode=v.value.decode("latin-1"))
            elif key in (b"D", b"Font"):
                if v.kind != "array" or len(v.value) != 2:
                    raise PdfError(f"invalid ExtGState {key.decode()}", v.start)
                second = number(run.doc.resolve(v.value[1]))
                if key == b"D":
                    self.dash_value(run.numbers(v.value[0]), second)
                else:
                    self.set(font=run.font(v.value[0], self.page), size=second)
            elif key == b"RI":
                if v.kind != "name":
                    raise PdfError("rendering intent is not a name", v.start)
                self.set(intent=v.value.decode("latin-1"))
            elif not (key == b"SMask" and v.kind == "name" and v.value == b"None"):
                self.unsupported(f"ExtGState {key.decode('latin-1')} is kept without its effect")

    # --- paths

    def build(self, op, operands):
        v = numbers_of(operands, {"m": 2, "l": 2, "c": 6, "v": 4, "y": 4, "h": 0, "re": 4}[op])
        m = self.g.ctm
        if op not in ("m", "re") and not self.started:
            raise PdfError(f"{op} before any m or re")
        self.started = True
        if not (self.run.content & GRAPHICS or self.run.styles):
            return
        if op == "re":
            x, y, w, h = v
            points = [apply(m, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
            self.start = self.current = points[0]
        elif op == "h":
            points = [self.start]
            self.current = self.start
        else:
            points = [apply(m, *p) for p in zip(v[::2], v[1::2])]
            if op == "v":
                points = [self.current, *points]
            elif op == "y":
                points = [*points, points[-1]]
            self.current = points[-1]
            if op == "m":
                self.start = self.current
        if not all(map(finite, points)):
            raise PdfError("a point of the path is not finite")
        self.path.append((op, points))
        self.path_ops.append(self.index)
        self.path_spans.append(self.span)

    def clip(self, op, operands):
        none_of(operands)
        if self.run.styles:
            self.pending = op
            self.path_ops.append(self.index)

    def paint(self, op, operands):
        none_of(operands)
        if op in ("s", "b", "b*") and self.path:
            self.path.append(("h", [self.start]))
            self.path_spans.append(self.span)
        if self.run.content & GRAPHICS and op != "n" and self.path:
            self.emit(2, {"segments": [{"op": o, "points": p} for o, p in self.path], "paint": op, "stroke": op[0] in "SsBb", "fill": op not in ("S", "s"), "even_odd": op.endswith("*"), "style": self.style(), "state": self.state(), "source": self.provenance([*self.spans, *self.path_spans], [*self.path_ops, self.index])})
        if self.pending:
            self.add_clip(self.path, self.pending == "W*")
        self.path, self.path_ops, self.path_spans, self.pending, self.started = [], [], [], None, False

    def add_clip(self, path: list, even_odd: bool) -> None:
        self.run.spend("clips", len(self.g.clip) + 1)
        self.set(clip=(*self.g.clip, (tuple(path), even_odd)))

    def shade(self, op, operands):
        if self.run.content & GRAPHICS:
            self.unsupported("shading is kept without its effect")

    # --- text

    def begin(self, op, operands):
        none_of(operands)
        if self.in_text:
            raise PdfError("nested BT")
        self.in_text, self.tm, self.tlm, self.placed = True, IDENTITY, IDENTITY, True

    def finish(self, op, operands):
        none_of(operands)
        if not self.in_text:
            raise PdfError("ET without BT")
        self.in_text = False

    def select(self, op, operands):
        if len(operands) != 2 or operands[0].kind != "name":
            raise PdfError("Tf needs a font name and a size")
        size = number(operands[1])
        if self.run.content & TEXT:
            self.set(font=self.run.font(self.resource(b"Font", operands[0].value), self.page), size=size)

    def spacing(self, op, operands):
        (v,) = numbers_of(operands, 1)
        if op == "Tr":
            if v not in range(8):
                raise PdfError("text rendering mode outside 0 to 7")
            self.set(render=int(v))
            if v >= 4 and self.run.styles:
                self.unsupported("text clipping needs glyph outlines and is not applied")
        else:
            self.set(**{"Tc": {"char_space": v}, "Tw": {"word_space": v}, "Tz": {"h_scale": v / 100}, "TL": {"leading": v}, "Ts": {"rise": v}}[op])

    def matrix(self, op, operands):
        self.need_text(op)
        if self.run.positions:
            self.tm = self.tlm = tuple(numbers_of(operands, 6))
            self.placed = True

    def need_text(self, op: str) -> None:
        if not self.in_text:
            raise PdfError(f"operator {op} outside a text object")

    def move(self, op, operands):
        self.need_text(op)
        x, y = numbers_of(operands, 2)
        if op == "TD":
            self.set(leading=-y)
        self.move_by(x, y)

    def next_line(self, op, operands):
        none_of(operands)
        self.need_text(op)
        self.move_by(0.0, -self.g.leading)

    def move_by(self, x: float, y: float) -> None:
        if self.run.positions:
            self.tm = self.tlm = mul(self.tlm, (1, 0, 0, 1, x, y))
            self.placed = True

    def show(self, op, operands):
        self.need_text(op)
        run = self.run
        if not run.content & TEXT:
            return
        if len(operands) != (3 if op == '"' else 1):
            raise PdfError(f"wrong number of operands for {op}")
        if op == '"':
            self.set(word_space=number(operands[0]), char_space=number(operands[1]))
        if op in "'\"":
            self.move_by(0.0, -self.g.leading)
        parts = operands[-1:]
        if op == "TJ":
            if parts[0].kind != "array":
                raise PdfError("TJ needs an array")
            parts = parts[0].value
        g = self.g
        at = mul(g.ctm, self.tm)
        if not finite(at):
            raise PdfError("the text matrix is not finite")
        text, glyphs, raw_codes, decoded, placed = [], [], [], True, self.placed
        for part in parts:
            if part.kind != "string":
                if op != "TJ":
                    raise PdfError("text to show is not a string")
                shift = number(part)
                if run.positions:
                    self.tm = mul(self.tm, (1, 0, 0, 1, -shift / 1000 * g.size * g.h_scale, 0))
                    if not finite(self.tm):
                        raise PdfError("a shift in TJ leaves the finite range")
                continue
            raw = part.value[1]
            run.spend("codes", len(raw))
            raw_codes.append(raw)
            codes = g.font.split(raw) if g.font else [(raw[i : i + 1], REPLACEMENT, False) for i in range(len(raw))]
            text += [u for _, u, _ in codes]
            decoded = decoded and all([known for _, _, known in codes])
            if run.positions:
                ok = self.advance(codes, glyphs)
                placed, self.placed = placed and ok, self.placed and ok
        joined = "".join(text)
        run.spend("unicode", len(joined.encode("utf-8", "surrogatepass")))
        if not decoded:
            run.diagnose(self.page, "incomplete-text-decoding", "no Unicode text is known for some codes", self.span)
        if run.positions and not placed:
            run.diagnose(self.page, "incomplete-text-positioning", "widths or the writing direction of some glyphs are not known", self.span)
        row = {"unicode": joined, "font": {"base_font": g.font.base_font.decode("latin-1"), "subtype": g.font.subtype.decode("latin-1")} if g.font else None, "decode_complete": decoded, "style": self.style()}
        if run.positions:
            row |= {"font_size": g.size, "matrix": list(at), "rendering_mode": g.render, "position_complete": placed}
        if run.full:
            row |= {"glyphs": glyphs, "raw_codes": b"".join(raw_codes), "font_index": g.font.index if g.font else None, "state": self.state(), "source": self.provenance()}
        self.emit(1, row)

    def advance(self, codes: list, glyphs: list) -> bool:
        """Place codes one after the other and move on; whether all their widths are known. At the full level, the glyphs."""
        g, full, every = self.g, self.run.full, True
        widths, default, scale = ({}, (0.0, False), 0.0) if g.font is None else (g.font.widths, (g.font.default * g.font.scale, g.font.default_known), g.font.scale)
        positioned = g.font is not None and g.font.positioned
        a, b, c, d, e, f = self.tm
        ca, cb, cc, cd, ce, cf = g.ctm
        # the linear part of ctm x tm stays; only the translation moves along the line
        ma, mb, mc, md = a * ca + b * cc, a * cb + b * cd, c * ca + d * cc, c * cb + d * cd
        rise, size, extra, stretch, gap = g.rise, g.size, g.char_space, g.h_scale, g.word_space * g.h_scale
        for code, u, known in codes:
            w = widths.get(int.from_bytes(code, "big"))
            width, sure = default if w is None else (w * scale, True)
            sure = sure and positioned
            step = (width * size + extra) * stretch
            if code == b" ":
                step += gap
            me, mf = e * ca + f * cc + ce, e * cb + f * cd + cf
            x, y = mc * rise + me, md * rise + mf
            x2, y2 = ma * step + mc * rise + me, mb * step + md * rise + mf
            e, f = step * a + e, step * b + f
            total = x + y + x2 + y2 + e + f
            if total - total != 0 and not finite((x, y, x2, y2, e, f)):
                raise PdfError("a glyph's place is not finite")
            every = every and sure
            if full:
                glyphs.append({"code": code, "unicode": u, "origin": {"x": x, "y": y}, "advance": {"x": x2 - x, "y": y2 - y}, "decode_complete": known, "width_known": sure})
        self.tm = (a, b, c, d, e, f)
        return every

    # --- objects

    def place(self, index: int) -> None:
        row = {"resource": index, "style": self.style(), "state": self.state(), "source": self.provenance()}
        if self.run.detail >= LAYOUT:
            row["matrix"] = list(self.g.ctm)
        self.emit(3, row)

    def inline(self, found: Inline, pairs: tuple) -> None:
        if self.run.content & IMAGES:
            target = Obj("stream", Stream(found.dictionary, pairs, found.start, found.end, self.span[0], found.boundary), self.span[1], found.end, self.span[0])
            self.place(self.run.image(None, target, found.dictionary, inline=True))

    def stray(self, op, operands):
        raise PdfError(f"{op} outside an inline image")

    def invoke(self, op, operands):
        run, name = self.run, name_of(operands)
        ref = self.resource(b"XObject", name)
        target = run.doc.resolve(ref)
        if target.kind != "stream":
            raise PdfError("XObject is not a stream", target.start)
        s: Stream = target.value
        run.spend("semantic", len(s.dictionary.entries))
        get = lambda k: run.doc.direct(s.dictionary.get(k))
        kind = get(b"Subtype")
        kind = kind.value if kind is not None and kind.kind == "name" else b""
        if kind == b"Image" and not run.content & IMAGES:
            return
        optional = get(b"OC") is not None
        if optional:
            run.diagnose(self.page, "unsupported-content-effect", "optional content is kept without its visibility", self.span)
        if kind == b"Image":
            keep = self.g
            if optional:
                self.set(complete=False)
            self.place(run.image(ref, target, s.dictionary))
            self.g = keep
        elif kind == b"Form":
            self.form(ref, target, get, optional)
        else:
            self.unsupported(f"XObject subtype {kind.decode('latin-1')!r} is not supported")

    def form(self, ref: Obj, target: Obj, get, optional: bool) -> None:
        run = self.run
        if self.depth >= min(FORM_DEPTH, run.depth):
            raise LimitError("form depth limit exceeded")
        if target.span in run.active_forms:
            raise PdfError("form cycle", target.start)
        child = type(self)(run, self.page, self.resources, self)
        child.span, child.spans, child.index = self.span, self.spans, self.index
        if optional:
            child.set(complete=False)
        if run.full:
            num, gen = ref.value if ref.kind == "reference" else (0, 0)
            child.form_path.append({"num": num, "gen": gen, "span": target.span, "call": self.span})
        if run.transforms and (m := get(b"Matrix")) is not None:
            ctm = mul(self.g.ctm, run.numbers(m, 6))
            if not finite(ctm):
                raise PdfError("the form matrix is not finite")
            child.set(ctm=ctm)
        if run.styles:
            box = get(b"BBox")
            if box is None:
                raise PdfError("form without BBox", target.start)
            x0, y0, x1, y1 = run.rect(box)
            corners = [apply(child.g.ctm, *p) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
            if not all(map(finite, corners)):
                raise PdfError("a corner of the form box is not finite")
            child.add_clip([("re", corners)], False)
        if (own := get(b"Resources")) is not None:
            child.resources = run._dict(own, "Resources")
        if run.styles and get(b"Group") is not None:
            child.unsupported("form transparency groups are kept without compositing")
        run.active_forms.add(target.span)
        try:
            child.read(run.decoded(target.value))
        finally:
            run.active_forms.discard(target.span)
        if child.in_text or child.stack:
            run.diagnose(self.page, "unbalanced-content-state", "text or graphics state left open at the end of a form", target.span)

    def marked(self, op, operands):
        self.unsupported(f"marked content operator {op} is kept without its meaning")

    def compatibility(self, op, operands):
        none_of(operands)


_GROUPS = {
    Fold.save: "q", Fold.restore: "Q", Fold.concat: "cm", Fold.line: "w J j M", Fold.dash: "d", Fold.intent: "ri", Fold.device: "G g RG rg K k", Fold.space: "CS cs", Fold.color: "SC SCN sc scn", Fold.ext_state: "gs",
    Fold.build: "m l c v y h re", Fold.clip: "W W*", Fold.paint: "S s f F f* B B* b b* n", Fold.shade: "sh",
    Fold.begin: "BT", Fold.finish: "ET", Fold.select: "Tf", Fold.spacing: "Tc Tw Tz TL Ts Tr", Fold.matrix: "Tm", Fold.move: "Td TD", Fold.next_line: "T*", Fold.show: "Tj ' \" TJ",
    Fold.invoke: "Do", Fold.stray: "ID EI", Fold.marked: "BMC BDC EMC MP DP", Fold.compatibility: "BX EX",
}
_HANDLERS = {op: f for f, ops in _GROUPS.items() for op in ops.split()}
#: Without styles these are not even checked.
_STYLE_ONLY = set("w J j M d ri G g RG rg K k CS cs SC SCN sc scn".split())
