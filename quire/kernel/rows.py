"""One document's bytes -> plain rows for the tables."""

from __future__ import annotations

from ..options import ParseOptions
from .document import Document
from .errors import PdfError
from .interp import Interpretation
from .lines import Lines, joined
from .syntax import Dictionary, Obj
from .tree import of_file


def span(s: tuple | None) -> dict | None:
    return None if s is None else {"source": s[0], "start": s[1], "end": s[2]}


def _xy(p) -> dict:
    return {"x": float(p[0]), "y": float(p[1])}


def _box(b) -> dict | None:
    return None if b is None else dict(zip(("x0", "y0", "x1", "y1"), map(float, b)))


def _source(s: dict | None) -> dict | None:
    return None if s is None else {"spans": [span(x) for x in s["spans"]], "operations": s["operations"], "form_path": [_call(c) for c in s["form_path"]]}


def _call(c: dict) -> dict:
    return {"num": c["num"], "gen": c["gen"], "span": span(c["span"]), "call": span(c["call"])}


def _segments(s: list[dict]) -> list[dict]:
    return [{"op": x["op"], "points": [_xy(p) for p in x["points"]]} for x in s]


def _state(s: dict | None) -> dict | None:
    return None if s is None else s | {"clip": [{"even_odd": c["even_odd"], "segments": _segments(c["segments"])} for c in s["clip"]]}


def interpret(data: bytes, options: ParseOptions) -> dict:
    """files, pages, fonts, image resources, diagnostics and the error of one document."""
    doc, error, run, loaded = Document(data, options.limits), None, None, False
    try:
        doc.open()
        loaded = True
        run = Interpretation(doc, options)
        run.run()
    except PdfError as e:
        error = {"class": e.kind, "message": str(e), "page": len(run.pages) - 1 if run is not None and run.pages and not run.pages[-1].complete else -1}
    except RecursionError:
        error = {"class": "limit", "message": "nesting is too deep", "page": -1}
    if run is not None:
        run.maps = None  # it refers back to run: without it the document goes as soon as its rows are made
    pages = []
    for p in run.pages if run else []:
        pages.append(
            {
                "page": p.index, "num": p.num, "gen": p.gen, "media_box": _box(p.media_box), "crop_box": _box(p.crop_box), "rotate": p.rotate, "user_unit": p.user_unit, "complete": p.complete, "n_operations": p.n_operations,
                "texts": [t | {"source": _source(t.get("source")), "state": _state(t.get("state"))} for t in p.texts],
                "graphics": [g | {"segments": _segments(g["segments"]), "source": _source(g["source"]), "state": _state(g["state"])} for g in p.graphics],
                "images": [i | {"source": _source(i["source"]), "state": _state(i["state"])} for i in p.images],
                "annotations": [{"subtype": a["subtype"], "rect": _box(a["rect"]), "source": _source(a.get("source"))} for a in p.annotations],
                "operations": [o | {"span": span(o["span"]), "form_path": [_call(c) for c in o["form_path"]]} for o in p.operations],
                "items": [{"kind": k, "index": i} for k, i in p.items],
            }
        )
    found = [{"severity": 2, "code": c, "message": m, "page": p, "span": span(s)} for p, c, m, s in (run.diagnostics if run else [])]
    found += [{"severity": 2, "code": c, "message": m, "page": -1, "span": span(s)} for c, m, s in doc.diagnostics]
    fonts = [{"index": f.index, "num": f.num, "gen": f.gen, "subtype": f.subtype.decode("latin-1"), "base_font": f.base_font.decode("latin-1"), "decode_supported": f.cmap is not None or bool(f.table), "widths_known": bool(f.widths) or f.default_known, "positioning_supported": f.positioned, "embedded": span(f.embedded)} for f in (run.fonts.values() if run else [])]
    images = [r | {"object": span(r["object"])} for r in (run.image_resources.values() if run else [])]
    return {"loaded": loaded, "length": len(data), "version_major": doc.version[0] if doc.version else None, "version_minor": doc.version[1] if doc.version else None, "header_start": doc.header_at if doc.version else None, "encrypted": doc.encrypted, "content": options.content, "detail": options.detail, "n_pages": len(pages), "pages": pages, "fonts": fonts, "image_resources": images, "diagnostics": found, "error": error}


def lines(data: bytes, options: ParseOptions, gap: float) -> list[dict]:
    """Visual lines of one document's pages; those before an error stay."""
    doc, run = Document(data, options.limits), None
    try:
        doc.open()
        run = Lines(doc, options, gap)
        run.run()
    except (PdfError, RecursionError):
        pass
    if run is None:
        return []
    run.maps = None
    return [{"page": p.index, "y": y, "line": line} for p in run.pages for y, line in joined(p.texts, gap)]


def flatten(o: Obj) -> list[dict]:
    """A value as node rows: parent, order among siblings, dictionary key, kind, scalar parts, span."""
    out: list[dict] = []
    todo = [(o, None, 0, None, 0)]
    while todo:
        x, parent, ord_, key, depth = todo.pop()
        me = len(out)
        kind, value = x.kind, x.value
        row = {"node_id": me, "parent_id": parent, "ord": ord_, "dict_key": key, "kind": kind, "lexeme": None, "bytes": None, "ref_num": None, "ref_gen": None, "span_source": x.source, "span_start": x.start, "span_end": x.end, "depth": depth}
        if kind in ("integer", "real"):
            row["lexeme"] = value
        elif kind == "boolean":
            row["lexeme"] = "true" if value else "false"
        elif kind == "name":
            row["bytes"] = value
        elif kind == "string":
            row["lexeme"], row["bytes"] = ("literal", "hex")[value[0] - 1], value[1]
        elif kind == "reference":
            row["ref_num"], row["ref_gen"] = value
        out.append(row)
        if kind == "stream":
            kind, value = "dictionary", value.dictionary
        if kind == "array":
            todo += [(c, me, i, None, depth + 1) for i, c in reversed(list(enumerate(value)))]
        elif kind == "dictionary":
            todo += [(c, me, i, k.decode("latin-1"), depth + 1) for i, (k, c) in reversed(list(enumerate(value.entries)))]
    return out


def sources(data: bytes, options: ParseOptions | None) -> dict[int, bytes]:
    """Bytes of every source that reading a document gives rise to: its structure, or (with options) its pages."""
    doc = Document(data, (options or ParseOptions()).checked().limits)
    try:
        doc.open()
        if options is not None:
            Interpretation(doc, options.checked()).run()
        else:
            _objects(doc)
    except (PdfError, RecursionError):
        pass
    return {i: s.data for i, s in doc.sources.items()}


def stream_bytes(data: bytes | None, ids: list[tuple[int, int]], limits) -> list[tuple[bytes | None, str | None]]:
    """(decoded bytes, error) of each stream object."""
    if data is None:
        return [(None, "no content")] * len(ids)
    doc, out = Document(data, limits), []
    try:
        doc.open()
    except PdfError as e:
        return [(None, str(e))] * len(ids)
    for num, gen in ids:
        try:
            body = doc.load(num, gen).body
            if body.kind != "stream":
                raise PdfError(f"object {num} is not a stream")
            out.append((doc.sources[doc.decode(body.value)].data, None))
        except PdfError as e:
            out.append((None, str(e)))
    return out


def structure(data: bytes, options: ParseOptions, keep_data: bool = False) -> dict:
    """Cross-reference records, all indirect objects as node rows, regions and sources of one document; keep_data: also what streams decode to."""
    doc, error = Document(data, options.limits), None
    objects, nodes = [], []
    try:
        doc.open()
        objects, nodes = _objects(doc)
    except PdfError as e:
        error = {"class": e.kind, "message": str(e), "page": -1}
    records = [{"section": s.order, "section_kind": s.kind, "hybrid": s.hybrid, "num": e.num, "entry_type": e.kind, "field_a": e.a, "field_b": e.b} for s in doc.sections for e in s.entries]
    trailer = flatten(Obj("dictionary", doc.trailer)) if doc.sections else []
    return {
        "length": len(data), "encrypted": doc.encrypted, "error": error, "records": records, "objects": objects, "nodes": nodes, "trailer": trailer,
        "regions": [{"kind": k, "start": s, "end": e} for s, e, k in doc.region_map()],
        "sources": [{"source": i, "size": len(s.data), "origin": s.origin, "inputs": [span(x) for x in s.inputs], "steps": [{"kind": k, "name": n.decode("latin-1")} for k, n in s.steps], "data": s.data if i > 1 and keep_data else None} for i, s in doc.sources.items()],
    }


def page_tree(data: bytes, options: ParseOptions, depth: int) -> list[dict]:
    """Pages of one document's tree; a file that cannot be opened has none."""
    doc = Document(data, options.limits)
    try:
        doc.open()
    except PdfError:
        doc.trailer = Dictionary()
    return list(of_file(doc).pages(depth))


def _objects(doc: Document) -> tuple[list[dict], list[dict]]:
    """Object rows and node rows of every object in force; each stream is decoded on the way."""
    objects, nodes = [], []
    ids = sorted({(e.num, e.b if e.kind == "in_use" else 0) for e in doc.entries.values() if e.kind in ("in_use", "compressed")})
    for num, gen in ids:
        me = {"num": num, "gen": gen}
        try:
            o = doc.load(num, gen)
        except PdfError as e:
            nothing = dict.fromkeys(("container", "index", "start", "end", "payload"))
            objects.append(me | nothing | {"origin": "error", "message": str(e)})
            continue
        payload = None
        if o.body.kind == "stream":
            payload = span(o.body.value.span)
            if not doc.encrypted:
                try:
                    doc.decode(o.body.value)
                except PdfError:
                    pass
        objects.append(me | {"origin": o.origin, "container": o.container, "index": o.index, "start": o.start, "end": o.end, "payload": payload, "message": None})
        nodes += [me | n for n in flatten(o.body)]
    return objects, nodes
