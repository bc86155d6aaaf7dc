"""The page tree of one document, whether its objects lie in the file or in node rows."""

from __future__ import annotations

import math

from .document import Document
from .errors import PdfError
from .syntax import Dictionary, Obj, Stream


class Tree:
    """Pages below `top` (a trailer's Root); load(num, gen) gives an object's value, None where there is none."""

    INHERITED = (b"MediaBox", b"CropBox", b"Rotate", b"Resources")

    def __init__(self, load, top: Obj | None):
        self.load, self.top = load, top

    def value(self, o: Obj | None, num: int | None = None, hops: int = 256) -> tuple[Obj | None, int | None]:
        """What a reference leads to, None where it is undefined or null, and the number of the object it stands in."""
        while o is not None and o.kind == "reference":
            if not hops:
                raise ValueError("reference depth limit exceeded")
            num, hops = o.value[0], hops - 1
            o = self.load(*o.value)
        return None if o is None or o.kind == "null" else o, num

    @staticmethod
    def entries(o: Obj) -> dict[bytes, Obj]:
        pairs = o.value.entries if o.kind == "dictionary" else o.value.dictionary.entries
        found = dict(pairs)
        if len(found) < len(pairs):
            seen: set[bytes] = set()
            twice = next(k for k, _ in pairs if k in seen or seen.add(k))
            raise ValueError(f"duplicate key /{twice.decode('latin-1')}")
        return found

    @staticmethod
    def items(o: Obj | None) -> list[Obj]:
        if o is None or o.kind != "array":
            raise ValueError("expected an array")
        return o.value

    @staticmethod
    def lexeme(o: Obj) -> str:
        if o.kind not in ("integer", "real"):
            raise ValueError("expected a number")
        return o.value

    def numbers(self, o: Obj) -> list[float]:
        found = [self.value(x)[0] if x.kind == "reference" else x for x in self.items(o)]
        if any(x is None or x.kind not in ("integer", "real") for x in found):
            raise ValueError("expected numbers")
        return [float(x.value) for x in found]

    def pages(self, depth: int):
        """Rows of the pages in order, and a last one with an error if the walk could not end."""
        count = 0
        try:
            root, num = self.value(self.top)
            first = self.entries(root).get(b"Pages") if root is not None and root.kind in ("dictionary", "stream") else None
            todo = [(first, num, {}, ())]
            while todo:
                ref, num, above, path = todo.pop()
                node, num = self.value(ref, num)
                if node is None or node.kind not in ("dictionary", "stream"):
                    raise ValueError("page tree node is not a dictionary")
                if len(path) >= depth:
                    raise ValueError("page tree depth limit exceeded")
                if any(x is node for x in path):
                    raise ValueError("page tree leads back to itself")
                own = self.entries(node)
                known = above | {k: v for k in self.INHERITED if k in own and (v := self.value(own[k], num))[0] is not None}
                kind, _ = self.value(own.get(b"Type"))
                kind = kind.value if kind is not None and kind.kind == "name" else None
                if kind == b"Pages":
                    kids, at = self.value(own.get(b"Kids"), num)
                    todo += [(k, at, known, (*path, node)) for k in reversed(self.items(kids))]
                    continue
                if kind != b"Page" or b"MediaBox" not in known:
                    raise ValueError("page without MediaBox" if kind == b"Page" else "page tree node has an unknown type")
                yield {"page": count} | self.page(ref, own, known)
                count += 1
        except (ValueError, OverflowError) as e:
            yield {"page": count, "error": str(e)}

    def page(self, ref: Obj, own: dict[bytes, Obj], known: dict[bytes, tuple]) -> dict:
        box = {k: self.numbers(known[k][0]) for k in (b"MediaBox", b"CropBox") if k in known}
        turn = int(self.lexeme(known[b"Rotate"][0])) if b"Rotate" in known else 0
        unit, _ = self.value(own.get(b"UserUnit"))
        num, gen = ref.value if ref.kind == "reference" else (None, None)
        return {
            "num": num, "gen": gen, "rotate": int(math.fmod(turn, 360)), "media_box": box[b"MediaBox"], "crop_box": box.get(b"CropBox", box[b"MediaBox"]),
            "user_unit": float(self.lexeme(unit)) if unit is not None else 1.0, "resources": known[b"Resources"][1] if b"Resources" in known else None, "error": None,
        }


def of_file(doc: Document) -> Tree:
    """The tree of an opened document; only the objects that the walk comes to are read."""

    def load(num: int, gen: int) -> Obj | None:
        try:
            return doc.load(num, gen).body
        except PdfError:
            return None

    return Tree(load, next((o for k, o in doc.trailer.entries if k == b"Root"), None))


def of_rows(nodes: list[dict], trailer: list[dict]) -> Tree:
    """The tree of a document's node rows (rows.flatten)."""
    below: dict[tuple, list[dict]] = {}
    for n in nodes:
        if n["parent_id"] is not None:
            below.setdefault((n["num"], n["parent_id"]), []).append(n)
    made: dict[tuple, Obj] = {}
    # what stands inside a value is numbered after it
    for n in sorted(nodes, key=lambda n: n["node_id"], reverse=True):
        kind, key = n["kind"], (n["num"], n["node_id"])
        inside = sorted(below.get(key, ()), key=lambda c: c["ord"])
        if kind in ("dictionary", "stream"):
            value = Dictionary([(c["dict_key"].encode("latin-1"), made[c["num"], c["node_id"]]) for c in inside])
            value = Stream(value, (1, 0, 0), 0, 0) if kind == "stream" else value
        elif kind == "array":
            value = [made[c["num"], c["node_id"]] for c in inside]
        else:
            value = _scalar(n)
        made[key] = Obj(kind, value)
    roots = {(n["num"], n["gen"]): made[n["num"], n["node_id"]] for n in nodes if n["parent_id"] is None}
    top = next((n for n in trailer if n["depth"] == 1 and n["dict_key"] == "Root"), None)
    return Tree(lambda num, gen: roots.get((num, gen)), None if top is None else Obj(top["kind"], _scalar(top)))


def _scalar(n: dict) -> object:
    if n["kind"] == "reference":
        return n["ref_num"], n["ref_gen"]
    return bytes(n["bytes"]) if n["kind"] == "name" else n["lexeme"]
