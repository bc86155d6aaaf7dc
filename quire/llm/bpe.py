"""op2: exact byte-level BPE by dynamic programming over prefixes, and its inverse.

For each prefix of a piece there is exactly one token that can end a correct encoding of that
prefix. It is found among the vocabulary tokens that are suffixes of the prefix (an Aho-Corasick
suffix automaton lists them) as the one whose neighbour, the last token of the prefix before it,
may stand beside it: merging never crosses their border. Back-pointers then give the ids.
Whether two tokens may be neighbours is decided by undoing merges on both sides of the border.

Texts are cut at the vocabulary's special strings, then by its pre-tokenizer; pieces seen before
are answered from a bounded cache. Cutting before a lone space that precedes a word never changes
the pieces, so most texts are cut by bytes.split and looked up word by word.

Defined cases: null and empty texts have no ids and decode to the empty text; special strings in a
text become their ids, as the library does by default; rows are independent, so repeated rows and
null ids pass through; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, rows, text_bytes

#: Words, and pieces, that a worker remembers in the newer half of each cache; a full half replaces the older one.
CACHE = 100_000
#: Bytes of text encoded and decoded at once.
SLICE_BYTES = 4 << 20
#: Pre-tokenizer of byte-level BPE files whose ByteLevel step uses its regular expression (fixed by that format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Finds a space beside other white space, in a text whose words at single spaces are all non-empty.
BESIDE_SPACE = re.compile(r"[^\S ](?: |\Z)| [^\S ]|\A[^\S ]").search


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in such a file -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """Encoder and decoder for one byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], byte_symbols()
        steps = spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or steps["type"] != "ByteLevel" or steps["add_prefix_space"] or not steps.get("use_regex", True):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        raw = {t: bytes(symbols[c] for c in t) for t in model["vocab"] if all(c in symbols for c in t)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ids = {raw[t]: i for t, i in model["vocab"].items() if t in raw and t not in self.special}
        self.bytes = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.join, self.halves, self.rank = {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (ids[raw[x]] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = ids[self.bytes[a] + self.bytes[b]]
            self.join[a, b] = rank
            if whole not in self.halves:
                self.halves[whole], self.rank[whole] = (a, b), rank
        self.automaton = ahocorasick.Automaton()
        for b, i in ids.items():
            if len(b) == 1 or i in self.halves:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.single = {b: i for b, i in ids.items()}
        self.pieces = regex.compile(PIECES).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.beside: dict[tuple[int, int], bool] = {}
        self.known_piece: dict[str, bytes] = {}
        self.known_word: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        top = max(self.bytes) + 1
        self.width, self.code = ("<u2", "H") if top <= 1 << 16 else ("<u4", "I")
        self.table = [self.bytes.get(i, b"") for i in range(top)]

    def may_stand_beside(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between these two tokens unmerged when it builds both."""
        key = left, right
        if (found := self.beside.get(key)) is None:
            if len(self.beside) > 4 * CACHE:
                self.beside.clear()
            found = self.beside[key] = self._border_holds(left, right)
        return found

    def _border_holds(self, a: int, b: int) -> bool:
        # Walk back in time: at each moment a and b touch the border. A merge across it would win if it
        # comes before the merge that ends this moment: earlier rank, or the same rank and further left.
        first, ends_right = None, False
        while True:
            across = self.join.get((a, b))
            if across is not None and (first is None or across < first or across == first and ends_right):
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # of two merges with one rank the left one is made first, so the right one is undone first
            if ra > rb:
                first, ends_right, a = ra, False, self.halves[a][1]
            else:
                first, ends_right, b = rb, True, self.halves[b][0]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-tokenized piece."""
        if (one := self.single.get(data)) is not None and (len(data) == 1 or one in self.halves and self._whole(one)):
            return [one]
        last = [-1] * (len(data) + 1)
        size = [0] * (len(data) + 1)
        known, beside = self.beside.get, self.may_stand_beside
        for end, (n, token) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0:
                if before := end - n:
                    left = last[before]
                    if left >= 0 and ((yes := known((left, token))) or yes is None and beside(left, token)):
                        last[end], size[end] = token, n
                elif self._whole(token):
                    last[end], size[end] = token, n
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _whole(self, token: int) -> bool:
        """Whether BPE turns the token's own bytes into it (not every merge is reachable)."""
        key = token, -1
        if (found := self.beside.get(key)) is None:
            halves = self.halves.get(token)
            found = self.beside[key] = halves is None or self._whole(halves[0]) and self._whole(halves[1]) and self._made(*halves)
        return found

    def _made(self, a: int, b: int) -> bool:
        """Whether the border of a and b stays open until they themselves merge."""
        rank = self.join[a, b]
        kept = self.join.pop((a, b))
        try:
            holds = self._border_holds(a, b)
        finally:
            self.join[a, b] = kept
        return holds and max(self.rank.get(a, -1), self.rank.get(b, -1)) < rank

    def _pieces(self, text: str) -> bytes:
        out = []
        for p in self.pieces(text):
            if (ids := self.known_piece.get(p)) is None:
                if len(self.known_piece) >= CACHE:
                    self.known_piece, self.older_pieces = {}, self.known_piece
                if (ids := self.older_pieces.get(p)) is None:
                    ids = self.pack(self.piece(p.encode()))
                if len(p) <= 64:
                    self.known_piece[p] = ids
            out.append(ids)
        return b"".join(out)

    def _miss(self, word: str) -> bytes:
        """Ids of a space and the word after it (neither begins nor ends beside another white space)."""
        if len(self.known_word) >= CACHE:
            self.known_word, self.older_words = {}, self.known_word
        if (ids := self.older_words.get(word)) is not None:
            self.known_word[word] = ids
            return ids
        head, line, tail = word.partition("\n")
        if line and head and tail and not head[-1].isspace() and not tail[0].isspace() and "\n" not in tail:
            ids = self._pieces(" " + head) + self._pieces("\n") + self._pieces(tail)
        else:
            ids = self._pieces(" " + word)
        if len(word) <= 64:
            self.known_word[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian integers of self.width."""
        if self.cut and any(s in text for s in self.special):
            return b"".join(self.pack([self.special[x]]) if x in self.special else self.encode(x) for x in self.cut(text) if x)
        if not text:
            return b""
        words = text.split(" ")
        # next to other white space a space belongs to a longer run: such texts are cut by the whole pattern
        if not all(words) or BESIDE_SPACE(text):
            return self._pieces(text)
        out = [self._pieces(words[0])]
        for at in range(1, len(words), CACHE):  # the newer half may be replaced meanwhile
            get, miss = self.known_word.get, self._miss
            out += [get(w) or miss(w) for w in words[at : at + CACHE]]
        return b"".join(out)

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.width)

    def decode(self, ids) -> str:
        """The text of ids, special ones included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.table.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")


_loaded: dict[str, PrefixBpe] = {}


def load(path: str) -> PrefixBpe:
    """One codec a worker process."""
    if path not in _loaded:
        _loaded[path] = PrefixBpe(path)
    return _loaded[path]


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Encode and decode every whole text; digests of both. With keep, also the ids (array) and the decoded text."""
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))

    sha = lambda b: hashlib.sha256(b).hexdigest()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])]

    def run(batches):
        codec = load(path)
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                encoded = [codec.ids(t.decode()) for t in rows(part, "text")]
                decoded = [codec.decode(i) for i in encoded]
                digests = [pa.array([sha(i.astype("<u4").tobytes()) for i in encoded], pa.string()), pa.array([sha(d.encode()) for d in decoded], pa.string())]
                cols = [part.column(part.schema.get_field_index("doc_id")), pa.array([len(i) for i in encoded], pa.int64()), *digests]
                if keep:
                    cols += [pa.array([i.astype(np.int32) for i in encoded], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return given.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep)
