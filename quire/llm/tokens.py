"""op4 (token counts) and op7 (token-id files): whole texts through the public tokenizer libraries.

op4 gives the library whole texts, in batches balanced by bytes (CALL_BYTES); only texts above LONG_BYTES are
cut, at single spaces between ASCII letters or digits, where no token of the vocabularies crosses: the space
goes with what follows it, or away where the library puts one before every text (SentencePiece). A long text without
such a space goes whole. Only lengths come back. Where a vocabulary's normaliser only composes, joins white space
that its pre-tokenizer then drops, and lower-cases, texts of Latin letters up to U+024F, which are composed
already, are lower-cased here and go to the same library without that normaliser, which costs it a third of its time.

op7 hands the library every distinct word of a slice once and remembers its answer in a bounded cache. That
equals encoding whole texts because they are only split where byte-level BPE always splits: before lone
spaces and line breaks, and between a letter or digit and the punctuation that ends a word. Splitting, finding
the distinct words and putting ids in order is Arrow and numpy code. A text where white space stands beside white space
or that holds white space beyond ASCII is cut by the vocabulary's own pattern, and one that holds a special string goes whole.

Defined cases: null texts are empty: no tokens (counting), the end id alone (files). Null doc_ids
come first in a file's order; rows with one doc_id follow each other by a hash of their ids, then by their ids. Repeated
rows are kept each. An empty table gives no rows and a store without blocks. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import accumulate, chain, compress, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PIECES
from .common import by_bytes, drop_stored, rows, stored, text_bytes

#: Words remembered in the newer half of a cache; a full half replaces the older one.
CACHE = 400_000
#: Bytes of text handled at once, bytes given to the library at once, and the length above which op4 cuts a text.
SLICE_BYTES, CALL_BYTES, LONG_BYTES = 8 << 20, 1 << 20, 1 << 18


class Remembered:
    """word -> the library's answer, asked in bulk. A newer and an older half, each of CACHE words at most."""

    def __init__(self, ask):
        self.ask, self.new, self.old = ask, {}, {}

    def __call__(self, words) -> dict:
        """A mapping that holds at least these distinct words."""
        new = self.new
        missing = [w for w in words if w not in new]
        if len(new) + len(missing) > CACHE:
            new, self.old = {}, new
            self.new, missing = new, words
        if missing:
            again = [w for w in missing if w in self.old]
            new.update((w, self.old[w]) for w in again)
            fresh = [w for w in missing if w not in self.old] if again else missing
            for part in balanced(fresh):
                new.update(zip(part, self.ask(part)))
        return new


def balanced(words: list):
    """Runs of words of about CALL_BYTES each."""
    if not words:
        return
    before = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 16)
    start = 0
    while start < len(words):
        spent = before[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(before, spent + CALL_BYTES, "right")))
        yield words[start:stop]
        start = stop


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Words put into one text for the library: longer texts take it longer a word.
TOGETHER = 100
_GAP = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def cut_long(text: bytes, drop_space: bool, limit: int = LONG_BYTES) -> list[bytes]:
    """A text in parts of about `limit` bytes, cut at single spaces between ASCII letters or digits."""
    parts, start = [], 0
    while len(text) - start > limit:
        gap = _GAP.search(text, start + limit)
        if not gap:
            break
        parts.append(text[start : gap.start()])
        start = gap.end() if drop_space else gap.start()
    return [*parts, text[start:]]


#: Texts that are in normal form C and that lower() treats letter by letter, as the library does (not the dotted capital I).
_LATIN = re.compile("[\x00-\u012f\u0131-\u024f]*\\Z").match


def _without_normaliser(path: str):
    """The library without the file's normaliser, if that only composes, joins white space and lower-cases, and white space is then dropped; else None."""
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = (spec["normalizer"] or {}).get("normalizers") or []
    first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    joins = [n.get("pattern", {}).get("Regex") == r"\s+" and n.get("content") == " " for n in normal if n["type"] == "Replace"]
    drops = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex", "").endswith(r"|[^\s\p{L}\p{N}]+")
    if [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"] or joins != [True] or not drops:
        return None
    t = Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))
    t.no_truncation()
    t.no_padding()
    return t


_counters: dict[str, tuple] = {}


def _counter(path: str):
    """(list of texts -> numbers of tokens, whether a cut drops its space, whether texts may be cut); one a worker process."""
    if path not in _counters:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _counters[path] = (lambda texts: map(len, sp.encode(texts, num_threads=1)), True, True)
        else:
            t = _library(path)
            lowered = _without_normaliser(path)
            special = [x.lower() for x in _special(t)]

            def lengths(texts: list[str]) -> list[int]:
                low = [x.lower() if lowered and _LATIN(x) else None for x in texts]
                low = [None if x is None or any(w in x for w in special) else x for x in low]
                out = [0] * len(texts)
                for library, at in ((t, [i for i, x in enumerate(low) if x is None]), (lowered, [i for i, x in enumerate(low) if x is not None])):
                    if at:
                        given = [texts[i] if library is t else low[i] for i in at]
                        for i, e in zip(at, library.encode_batch_fast(given, add_special_tokens=False)):
                            out[i] = len(e)
                return out

            _counters[path] = (lengths, False, not any(" " in x for x in special))
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, lengths only; over_limit where there are more than `limit`."""
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))

    def run(batches):
        lengths, drop_space, cuts = _counter(path)
        for batch in batches:
            for part in by_bytes(batch, "text", CALL_BYTES):
                texts = rows(part, "text")
                pieces = [cut_long(t, drop_space) if cuts and len(t) > LONG_BYTES else [t] for t in texts]
                counts = chain.from_iterable(lengths([x.decode() for x in some]) for some in balanced([x for p in pieces for x in p]))
                n = [sum(islice(counts, len(p))) for p in pieces]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return given.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


# --- op7: files of frequency-ranked ids

#: Ids in a block of a file (a longer document makes a longer block).
BLOCK_IDS = 1 << 20
MAGIC = b"QTK1"
#: Lengths of the four values that a control byte describes, two bits each, lowest first.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(values: np.ndarray) -> bytes:
    """Control bytes, then data: each value takes 1 to 4 little-endian bytes."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)
    control = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    control[: len(v)] = size - 1
    control = (control.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    return control.tobytes() + v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def unpack(data: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """The n values packed at byte `at`, and where they end."""
    groups = -(-n // 4)
    size = LENGTHS[np.frombuffer(data, np.uint8, groups, at)].ravel()[:n]
    total = int(size.sum())
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8, total, at + groups)
    return out.view("<u4").ravel(), at + groups + total


def write_block(doc_ids: list, lens: list[int], ranks: np.ndarray) -> bytes:
    """magic, documents (u32), then packed: flags (1: the id is null), lengths, ids as low and high halves, ranks."""
    ids = np.array([i or 0 for i in doc_ids], np.int64).view(np.uint64)
    parts = (np.array([i is None for i in doc_ids]), np.array(lens), ids & 0xFFFFFFFF, ids >> np.uint64(32), ranks)
    return MAGIC + np.uint32(len(doc_ids)).tobytes() + b"".join(map(pack, parts))


def read_block(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ranks) of a block."""
    if data[:4] != MAGIC:
        raise ValueError("not a token block")
    n, at = int(np.frombuffer(data, "<u4", 1, 4)[0]), 8
    null, at = unpack(data, n, at)
    lens, at = unpack(data, n, at)
    low, at = unpack(data, n, at)
    high, at = unpack(data, n, at)
    ids = (low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)).view(np.int64).tolist()
    ranks, _ = unpack(data, int(lens.sum()), at)
    return [None if x else i for x, i in zip(null, ids)], lens.astype(np.int64), ranks


_encoders: dict[str, tuple] = {}


def _cut(raw: bytes, at: list[int]):
    """The parts of raw between these places."""
    return map(raw.__getitem__, map(slice, at, at[1:]))


def _special(t) -> list[str]:
    return [x.content for x in t.get_added_tokens_decoder().values()]


def _encoder(path: str):
    """(id type, Remembered ids, special strings, pre-tokenizer) of a byte-level BPE file; one a worker process."""
    import regex

    if path not in _encoders:
        t = _library(path)
        wide = "<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"
        special = _special(t)
        spaced = np.zeros(t.get_vocab_size(), bool)
        spaced[[i for token, i in t.get_vocab().items() if token.startswith("\u0120")]] = True  # how byte-level files write a space

        size = np.dtype(wide).itemsize

        def is_plain(k: bytes) -> bool:
            if k.isalnum():
                return True
            w = k.decode()
            return w.isalnum() or w != "" and not _SPACE(w) and not any(x in w for x in special)

        def ask(keys: list[bytes]) -> list[bytes]:
            """Ids of each key. Plain words go in texts that hold many each: a word's first id begins with its space, no other does."""
            kept = list(map(is_plain, keys))
            plain, odd = list(compress(keys, kept)), [_spelt(k) for k, x in zip(keys, kept) if not x]
            groups = [(b" " + b" ".join(plain[k : k + TOGETHER])).decode() for k in range(0, len(plain), TOGETHER)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in t.encode_batch_fast(groups, add_special_tokens=False)), wide)
            starts = np.flatnonzero(spaced[ids])
            if len(starts) != len(plain):
                raise ValueError("a word without a token of its own")
            each = [e.ids for e in t.encode_batch_fast(odd, add_special_tokens=False)]
            alone = np.fromiter(chain.from_iterable(each), wide).tobytes()
            found = _cut(alone, [0, *accumulate(len(x) * size for x in each)]), _cut(ids.tobytes(), (np.append(starts, len(ids)) * size).tolist())
            return [next(found[x]) for x in kept]

        _encoders[path] = (wide, Remembered(ask), special, regex.compile(PIECES).findall)
    return _encoders[path]


_SPACE = re.compile(r"\s").search
#: What keeps a text from being split at its spaces: white space beside white space, or beyond ASCII.
_CROWDED = r"[ \t\n\v\f\r]{2}|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: A letter or digit (those beyond ASCII are letters in every version of Unicode), punctuation to the word's end, and what follows it.
_ENDS = r"([A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/:-@\[-`{-~]+)([ \n]|\z)"


def _spelt(key: bytes) -> str:
    """A plain key stands for a space and the word; one that begins with a line break, for itself; with a carriage return, for what follows that.

    The latter two cannot be plain, since no white space stands beside another.
    """
    return key[1:].decode() if key[:1] == b"\r" else key.decode() if key[:1] == b"\n" else " " + key.decode()


def _words(texts: pa.Array, special: list[str], pieces) -> pa.ListArray:
    """Keys of the parts of each text, at least one, whose encodings follow each other in the text's own."""
    whole = pc.match_substring_regex(texts, "|".join(map(re.escape, special))) if special else pa.repeat(False, len(texts))
    crowded = pc.and_not(pc.match_substring_regex(texts, _CROWDED), whole)
    odd = pc.or_(whole, crowded)
    # what ends a word after a letter or digit is a piece of its own: "word.", "word!!" need not be known beside "word"
    plain = pc.replace_substring_regex(texts.filter(pc.invert(odd)), _ENDS, "\\1 \r\\2\\3")
    plain = pc.split_pattern(pc.binary_join_element_wise("\r", pc.replace_substring(plain, "\n", " \n"), ""), " ")
    if not pc.any(odd).as_py():
        return plain
    cut = [["\r" + t] if w else ["\r" + p for p in pieces(t)] or ["\r"] for t, w in zip(texts.filter(odd).to_pylist(), whole.filter(odd).to_pylist())]
    place = np.argsort(np.concatenate([np.flatnonzero(~np.asarray(odd)), np.flatnonzero(np.asarray(odd))]))
    return pa.concat_arrays([plain, pa.array(cut, plain.type)]).take(pa.array(place))


def _bytes_of(words: pa.StringArray) -> list[bytes]:
    """The words as bytes, cut out of their buffer: to_pylist() takes several times as long."""
    if not len(words):
        return []
    _, at, data = words.buffers()
    at = np.frombuffer(at, np.int32, len(words) + 1, 4 * words.offset)
    raw = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if data else b""
    return list(_cut(raw, (at - at[0]).tolist()))


def _encoded(texts: pa.Array, encoder: tuple, end_id: int) -> pa.Array:
    """Little-endian ids of each text, then end_id."""
    wide, remembered, special, pieces = encoder
    texts = texts.take(pa.array(np.arange(len(texts))))  # some Arrow string functions misread slices
    listed = _words(texts, special, pieces)
    coded = listed.flatten().dictionary_encode()
    keys = _bytes_of(coded.dictionary)
    known = remembered(keys)
    found = [known[k] for k in keys]
    size = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(wide).itemsize
    first = np.cumsum(size) - size
    code = coded.indices.to_numpy()
    n = size[code]
    ends = np.cumsum(n)
    kind = np.int32 if n.sum() < 1 << 31 else np.int64
    ids = np.frombuffer(b"".join(found), wide)[np.arange(n.sum(), dtype=kind) + np.repeat((first[code] - ends + n).astype(kind), n)]
    words = np.diff(listed.offsets.to_numpy())
    per_text = np.append(0, ends)[np.cumsum(words)]
    out = np.insert(ids, per_text, end_id)
    offsets = np.append(0, per_text + np.arange(1, len(texts) + 1)) * np.dtype(wide).itemsize
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out.astype(wide).tobytes())])


def encode_documents(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): little-endian ids of every whole text, then end_id; 2 bytes each if the vocabulary allows."""
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("text"))

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                texts = part.column(part.schema.get_field_index("text")).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), _encoded(texts, encoder, end_id)], ["doc_id", "ids"])

    return given.mapInArrow(run, "doc_id bigint, ids binary")


class TokenStore:
    """Token files in the shared folder: `blocks` (part, block, n_ids, data) in doc_id order and the rank -> id `codebook`."""

    def __init__(self, blocks: DataFrame, codebook: DataFrame):
        self.blocks, self.codebook = blocks, codebook

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens and ids of each document, from the files."""
        return self._read("doc_id bigint, start bigint, n_tokens bigint, ids array<bigint>", lambda ids, lens: pa.array([x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])], pa.list_(pa.int64())), "ids")

    def digests(self) -> DataFrame:
        """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""

        def crc(ids, lens):
            raw, to = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lens) * 4
            return pa.array([zlib.crc32(raw[b - n * 4 : b]) for b, n in zip(to.tolist(), lens.tolist())], pa.int64())

        return self._read("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", crc, "ids_crc32")

    def _read(self, schema: str, last, name: str) -> DataFrame:
        to_id = np.array([r.id for r in self.codebook.orderBy("rank").collect()] or [0], np.int64)
        parts = self.blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
        earlier = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
        at = self.blocks.select("part", "block", earlier.alias("earlier")).join(parts, "part").select("part", "block", (F.col("before") + F.col("earlier")).alias("start"))

        def run(batches):
            for batch in batches:
                for first, data in zip(rows(batch, "start"), rows(batch, "data")):
                    doc_ids, lens, ranks = read_block(data)
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(first + np.cumsum(lens) - lens), pa.array(lens), last(to_id[ranks], lens)], ["doc_id", "start", "n_tokens", name])

        return self.blocks.join(at, ["part", "block"]).select("start", "data").mapInArrow(run, schema)


def write_tokens(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
    """Encode documents and write them in ascending doc_id order as blocks of frequency-ranked ids.

    Blocks lie in Spark's own committed files, so a lost executor's half-written output never counts.
    The codebook holds one row per vocabulary id in use, which bounds what is collected and broadcast.
    """
    ids = stored(encode_documents(docs, path, end_id, id_col, text_col), "ids", compression="zstd")

    def tally(batches):
        total = np.zeros(0, np.int64)
        wide = _encoder(path)[0]
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(rows(batch, "ids")), wide), minlength=len(total))
            n[: len(total)] += total
            total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = ids.mapInArrow(tally, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = [r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))]
    codebook = stored(docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(order)], "rank bigint, id bigint").coalesce(1), "codebook")
    to_rank = np.zeros(max(order, default=0) + 1, np.uint32)
    to_rank[order] = np.arange(len(order))

    def write(batches):
        wide, part, seq = _encoder(path)[0], TaskContext.get().partitionId(), count()
        held, lens, raw, n = [], [], [], 0

        def block():
            ranks = to_rank[np.frombuffer(b"".join(raw), wide)]
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([next(seq)]), pa.array([n]), pa.array([write_block(held, lens, ranks)], pa.binary())], ["part", "block", "n_ids", "data"])

        size = np.dtype(wide).itemsize
        for batch in batches:
            for i, x in zip(rows(batch, "doc_id"), rows(batch, "ids")):
                held.append(i)
                lens.append(len(x) // size)
                raw.append(x)
                n += lens[-1]
                if n >= BLOCK_IDS:
                    yield block()
                    held, lens, raw, n = [], [], [], 0
        if held:
            yield block()

    # rows of one id, or of none, spread by their ids' hash, and rows equal in both by their place in the stored table
    dealt = ids.withColumn("_h", F.xxhash64("ids")).repartitionByRange("doc_id", "_h", F.monotonically_increasing_id())
    blocks = stored(dealt.sortWithinPartitions("doc_id", "_h", "ids").select("doc_id", "ids").mapInArrow(write, "part bigint, block bigint, n_ids bigint, data binary"), "tokens", compression="none")
    drop_stored(ids)
    return TokenStore(blocks, codebook)
