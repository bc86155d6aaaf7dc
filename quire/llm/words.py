"""op1: Brown class-based n-gram scoring.

Exchange clustering assigns every training word to a class. The probability of a word after its
predecessor h is P(class | class of h) * P(word | class); what is held back for unknown words
follows the share of words seen once (Good-Turing), by predecessor class, so the probabilities of
all known words and of the one unknown symbol sum to 1.

How it is laid out:

1. One pass turns documents into blocks (about BLOCK_BYTES of text each): the block's own word list
   with training counts, and its documents as positions in that list. No text is shuffled.
2. Words are dealt into parts by hash; a part numbers its words and sums their counts. The blocks
   keep numbers instead of words from then on, in buckets by block, so that what comes back to a block
   is joined without moving the block.
3. The HEAD most frequent words (so the driver's matrix is HEAD x HEAD at most) get their first
   classes by exchange moves on their bigram counts, one word at a time.
4. Then every word of the vocabulary, the head included, is moved in SWEEPS sweeps: a block sends
   each movable word's contexts (classes before and after it) to the word's part, the part moves the
   word to the class under which all its contexts are likeliest, and the block gets its words' classes
   back, a byte each. All words without a class move in the first sweep, half of the words in each later one
   (neighbours that move at once can chase each other), so each word has 1 + (SWEEPS - 1) / 2 moves.
   Nothing that grows with the vocabulary is broadcast or collected: the driver sees the table of
   class pairs and a sample-free sum of moved words.
5. Class transitions are counted over the whole corpus; blocks are scored with numpy.

SWEEPS ends the exchange after a fixed number of passes; the README says what later passes would gain.

Defined cases: null and empty texts hold the end token alone. A null doc_id counts as the id text ''.
Repeated rows are scored each. An empty table gives no rows. If no training token exists, both
scores are 0. A word none of whose neighbours has a class waits for a later sweep, and joins a class of
its own kind if it never gets one. Other columns are ignored.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bucketed, drop_stored, id_mod, stored, text_bytes

BLOCK_BYTES = 4 << 20
HEAD, CLASSES, HEAD_ROUNDS, SWEEPS = 1024, 48, 8, 7
#: Words of all blocks, each counted in every block that holds it, in one part.
PART_WORDS = 1 << 17
#: No word holds a space, so this stands for the end token, which is also what precedes a text.
END = b" "
#: Pseudo-count of the class prior in each transition row.
PRIOR = 5.0
#: Class of words without one: so far, or for good since no training row holds them.
NONE = 255


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = HEAD_ROUNDS) -> np.ndarray:
    """Class of each word, by exchange moves that raise the class bigram likelihood.

    bigrams[v, w] counts v followed by w; words come by descending frequency. Ends when a round
    moves nothing.
    """
    n = len(bigrams)
    of = np.arange(n) % classes
    b = bigrams.astype(np.float64)
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    table = member.T @ b @ member
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            twin = b[w, w]
            right, left = b[w] @ member, b[:, w] @ member
            right[of[w]] -= twin
            left[of[w]] -= twin
            old = of[w]
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= twin
            base = _xlogx(table)
            grown = (_xlogx(table + right) - base).sum(1) + (_xlogx(table + left[:, None]) - base).sum(0)
            d = table.diagonal()
            grown += _xlogx(d + right + left + twin) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            rows_, cols = table.sum(1), table.sum(0)
            grown -= _xlogx(rows_ + right.sum() + twin) - _xlogx(rows_)
            grown -= _xlogx(cols + left.sum() + twin) - _xlogx(cols)
            new = int(grown.argmax())
            if grown[new] <= grown[old] + 1e-9:
                new = old
            table[new] += right
            table[:, new] += left
            table[new, new] += twin
            if new != old:
                member[w, old], member[w, new], of[w] = 0, 1, new
                moved += 1
        if not moved:
            break
    return of


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    """One row of binary values: each array's length in bytes and its bytes compressed, since blocks lie on disk and cross the network more than once."""
    return [pa.array([np.int64(x.nbytes).tobytes() + pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary()) for x in arrays]


def _numbers(batch: pa.RecordBatch, name: str, i: int, kind=np.int32) -> np.ndarray:
    """The array of a binary value made by _binary()."""
    raw = batch.column(batch.schema.get_field_index(name))[i].as_buffer()
    return np.frombuffer(pa.decompress(raw.slice(8), int(np.frombuffer(raw, np.int64, 1)[0]), "zstd"), kind)


def _value(batch: pa.RecordBatch, name: str, i: int):
    return batch.column(batch.schema.get_field_index(name))[i]


BLOCK = "block string, ids array<bigint>, held binary, lens binary, tokens binary, words array<binary>, counts binary, hashes binary"
_NAMES_OF_BLOCK = ["block", "ids", "held", "lens", "tokens", "words", "counts", "hashes"]


_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _hashes(words: pa.Array) -> np.ndarray:
    """A 32-bit hash of each word, by which words are dealt into parts."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    start = offsets[:-1] - offsets[0]
    place = np.arange(len(data), dtype=np.int32) - np.repeat(start, np.diff(offsets))
    h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _FACTORS[place & 63], start)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def _block(name: str, ids: pa.Array, held: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """Texts as positions in the block's own word list, whose first entry is the end token."""
    listed = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    flat = listed.flatten()
    real = np.asarray(pc.binary_length(flat)) > 0
    before = np.append(0, np.cumsum(real))
    n_words = np.diff(before[listed.offsets.to_numpy()])
    coded = flat.filter(pa.array(real)).dictionary_encode()
    lens = (n_words + 1).astype(np.int32)
    tokens = np.zeros(int(lens.sum()), np.int32)
    spoken = np.ones(len(tokens), bool)
    spoken[np.cumsum(lens) - 1] = False
    tokens[spoken] = coded.indices.to_numpy() + 1
    words = pa.concat_arrays([pa.array([END], pa.binary()), coded.dictionary.cast(pa.large_binary()).cast(pa.binary())])
    counts = np.bincount(tokens[np.repeat(~held, lens)], minlength=len(words))
    hashes = _hashes(words)
    listed_words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    listed_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    columns = [pa.array([name]), listed_ids, *_binary(held, lens, tokens), listed_words, *_binary(counts.astype(np.int64), hashes)]
    return pa.RecordBatch.from_arrays(columns, _NAMES_OF_BLOCK)


def _blocks(batches):
    part, seq = TaskContext.get().partitionId(), count()
    waiting, size = [], 0

    def block():
        table = pa.Table.from_batches(waiting)
        # taken, since Arrow's ascii_lower misreads a slice that was cast to large strings
        ids, held, texts = (table.column(c).combine_chunks().take(pa.array(np.arange(table.num_rows))) for c in ("id", "held", "text"))
        return _block(f"{part}-{next(seq)}", ids, np.asarray(held).astype(bool), texts.cast(pa.string()))

    for batch in batches:
        lens = np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index("text")))).astype(np.int64) + 1
        start = 0
        while start < batch.num_rows:
            fits = int(np.searchsorted(np.cumsum(lens[start:]), BLOCK_BYTES - size)) + 1
            waiting.append(batch.slice(start, fits))
            size += int(lens[start : start + fits].sum())
            start += fits
            if size >= BLOCK_BYTES:
                yield block()
                waiting, size = [], 0
    if size:
        yield block()


def _shares(hashes: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, positions) of a block's words, dealt by hash."""
    part = hashes % parts
    order = np.argsort(part, kind="stable")
    return [(int(part[x[0]]), x) for x in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(x)]


def _listed(parts: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, words = _value(batch, "block", i).as_py(), _value(batch, "words", i).values
                counts = _numbers(batch, "counts", i, np.int64)
                shares = _shares(_numbers(batch, "hashes", i, np.uint32), parts)
                taken = words.take(pa.array(np.concatenate([x for _, x in shares])))
                ends = np.cumsum([0, *(len(x) for _, x in shares)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _ in shares], pa.int32()),
                        pa.array([name] * len(shares)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken),
                        pa.array([counts[x].tobytes() for _, x in shares], pa.binary()),
                    ],
                    ["part", "block", "words", "counts"],
                )

    return run


NAMES = "part int, block string, at binary, n binary, top array<struct<word:binary,n:bigint,at:int>>, total bigint, known bigint"


def _names(head: int):
    """Numbers a part's words: for each block its words' numbers and counts over all blocks, and for the part (block null) its most frequent words."""
    item = pa.struct([("word", pa.binary()), ("n", pa.int64()), ("at", pa.int32())])
    schema = pa.schema([("part", pa.int32()), ("block", pa.string()), ("at", pa.binary()), ("n", pa.binary()), ("top", pa.list_(item)), ("total", pa.int64()), ("known", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        listed = table.column("words").combine_chunks()
        coded = listed.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary
        n = np.zeros(len(words), np.int64)
        np.add.at(n, code, np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64))
        few = np.flatnonzero(n >= max(1, np.sort(n)[-head:][0]))
        top = sorted(({"word": words[int(j)].as_py(), "n": int(n[j]), "at": int(j)} for j in few), key=lambda r: (-r["n"], r["word"]))[:head]
        part, ends = table.column("part")[0].as_py(), listed.offsets.to_numpy() - listed.offsets[0].as_py()
        out = [{"part": part, "block": b, "at": code[x:y].tobytes(), "n": n[code[x:y]].tobytes()} for b, x, y in zip(table.column("block").to_pylist(), ends, ends[1:])]
        return pa.Table.from_pylist([*out, {"part": part, "top": top, "total": int(n.sum()), "known": int((n > 0).sum())}], schema)

    return run


#: A block's words by position: number (part in the upper half), count over all blocks.
STATE = "block string, ids array<bigint>, held binary, lens binary, tokens binary, number binary, n binary"


def _numbered(parts: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = _numbers(batch, "hashes", i, np.uint32)
                number, n = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
                for (p, at), r in zip(_shares(hashes, parts), _value(batch, "x", i).as_py()):
                    number[at] = (p << 32) + np.frombuffer(r["at"], np.int32).astype(np.int64)
                    n[at] = np.frombuffer(r["n"], np.int64)
                kept = [batch.column(batch.schema.get_field_index(c)).slice(i, 1) for c in ("block", "ids", "held", "lens", "tokens")]
                yield pa.RecordBatch.from_arrays([*kept, *_binary(number, n)], ["block", "ids", "held", "lens", "tokens", "number", "n"])

    return run


def _learnt(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's training tokens and their predecessors."""
    tokens, lens = _numbers(batch, "tokens", i), _numbers(batch, "lens", i)
    cur = tokens[np.repeat(~_numbers(batch, "held", i, bool), lens)]
    return cur, np.concatenate([[0], cur[:-1]]).astype(np.int32)[: len(cur)]


def _classes(number: np.ndarray, answers: list) -> np.ndarray:
    """Classes by position in the block, from the parts' answers in order."""
    cls = np.full(len(number), NONE, np.uint8)
    cls[np.argsort(number >> 32, kind="stable")] = np.frombuffer(b"".join(answers), np.uint8)
    return cls


def _head_of(number: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Place among the head's words (-1: none)."""
    order = np.argsort(head)
    at = order[np.searchsorted(head, number, sorter=order).clip(0, len(head) - 1)]
    return np.where(head[at] == number, at, -1)


def _head_bigrams(head: np.ndarray):
    """(v * HEAD + w, count) for words v, w of the head that follow each other in training rows."""
    h = len(head)

    def run(batches):
        total = np.zeros(h * h, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                cur, prev = _learnt(batch, i)
                own = _head_of(_numbers(batch, "number", i, np.int64), head)
                v, w = own[prev], own[cur]
                both = (v >= 0) & (w >= 0)
                total += np.bincount(v[both] * h + w[both], minlength=h * h)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    return run


#: A context and how often it was seen; more than 255 times take several entries.
SEEN = np.dtype([("ctx", "u1"), ("n", "u1")])
ASKED = "part int, block string, cls binary, turn binary, at binary, entries binary, seen binary"


def _turn(number: np.ndarray, sweep: int) -> np.ndarray:
    """Whether a word may move in this sweep: of two neighbours that would both follow the other, one often stays; every word may in one of two sweeps that follow each other."""
    mixed = (number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((sweep // 2 + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)) & np.uint64(1) == sweep % 2


def _asked(head: np.ndarray, of: np.ndarray, classes: int, sweep: int):
    """To each part, from each block: its words' classes, which of them may move, and their contexts: class before (ctx) and after (classes + ctx), where it has one."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                number, n = _numbers(batch, "number", i, np.int64), _numbers(batch, "n", i, np.int64)
                cur, prev = _learnt(batch, i)
                if sweep:
                    cls = _classes(number, _value(batch, "cls", i).as_py())
                    turn = (n > 0) & _turn(number, sweep)
                else:
                    own = _head_of(number, head)
                    cls = np.where(own >= 0, of[own], NONE).astype(np.uint8)
                    turn = n > 0
                order = np.argsort(number >> 32, kind="stable")
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order))
                after, before = turn[cur] & (cls[prev] < NONE), turn[prev] & (cls[cur] < NONE)
                width = 2 * classes
                code = np.concatenate([place[cur[after]] * width + cls[prev[after]], place[prev[before]] * width + classes + cls[cur[before]]])
                code, seen = np.unique(code, return_counts=True)
                times = (seen - 1) // 255 + 1
                last = np.cumsum(times) - 1
                rest = seen - 255 * (times - 1)
                code, seen = np.repeat(code, times), np.full(int(times.sum()), 255)
                seen[last] = rest
                entries = np.bincount(code // width, minlength=len(order)).astype(np.int32)
                blob = np.empty(len(code), SEEN)
                blob["ctx"], blob["n"] = code % width, seen
                ends = np.append(0, np.cumsum(entries))
                part = (number >> 32)[order]
                cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(order)]
                name, out = _value(batch, "block", i).as_py(), []
                for a, b in zip(cut, cut[1:]):
                    x = order[a:b]
                    t = turn[x]
                    at = (number[x[t]] & 0xFFFFFFFF).astype(np.int32)
                    out.append((cls[x].tobytes(), np.packbits(t).tobytes(), at.tobytes(), entries[a:b][t].tobytes(), blob[ends[a] : ends[b]].tobytes()))
                columns = [pa.array([int(part[a]) for a in cut[:-1]], pa.int32()), pa.array([name] * len(out)), *(pa.array(c, pa.binary()) for c in zip(*out))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "cls", "turn", "at", "entries", "seen"])

    return run


ANSWERS = "block string, part int, cls binary, moves array<struct<code:int,n:bigint>>"


def _placed(affinity: np.ndarray, mass: np.ndarray):
    """One exchange move of each word of a part that may move: the class under which all its neighbours are likeliest.

    A word none of whose neighbours has a class waits. The last row (block null) counts class pairs (class of the
    word as it moved, class after it) over the words that could move.
    """
    classes = len(mass)
    moves_type = pa.list_(pa.struct([("code", pa.int32()), ("n", pa.int64())]))

    def run(table: pa.Table) -> pa.Table:
        cls = [np.frombuffer(x, np.uint8).copy() for x in table.column("cls").to_pylist()]
        turn = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)).astype(bool) for x, c in zip(table.column("turn").to_pylist(), cls)]
        at = [np.frombuffer(x, np.int32) for x in table.column("at").to_pylist()]
        entries = np.frombuffer(b"".join(table.column("entries").to_pylist()), np.int32)
        seen = np.frombuffer(b"".join(table.column("seen").to_pylist()), SEEN)
        words, place = np.unique(np.concatenate(at), return_inverse=True)
        total = np.zeros((classes, classes))
        if len(words):
            old = np.full(len(words), NONE, np.uint8)
            old[place] = np.concatenate([c[t] for c, t in zip(cls, turn)])
            new = old.copy()
            # sparse sums of contexts, some words at a time
            word = np.repeat(place, entries)
            order = np.argsort(word, kind="stable")
            word, ctx, n = word[order], seen["ctx"][order], seen["n"][order]
            step = 1 << 15
            for a in range(0, len(words), step):
                lo, hi = np.searchsorted(word, [a, a + step])
                here = np.arange(min(step, len(words) - a))
                near = np.bincount((word[lo:hi] - a) * 2 * classes + ctx[lo:hi], n[lo:hi].astype(float), len(here) * 2 * classes).reshape(len(here), -1)
                fit = near @ affinity - near[:, :classes].sum(1, keepdims=True) * np.log(mass)
                best, was = fit.argmax(1), old[a : a + step]
                stays = (was < NONE) & (fit[here, best] <= fit[here, np.minimum(was, classes - 1)] + 1e-6)
                chosen = np.where(stays | ~near.any(1), was, best).astype(np.uint8)
                new[a : a + step] = chosen
                ok = chosen < NONE
                np.add.at(total, chosen[ok], near[ok, classes:])
            ends = np.cumsum([0, *map(len, at)])
            for c, t, a, b in zip(cls, turn, ends, ends[1:]):
                c[t] = new[place[a:b]]
        code = np.flatnonzero(total)
        moves = [{"code": int(k), "n": int(total.flat[k])} for k in code]
        part = table.column("part")[0].as_py()
        return pa.table(
            {
                "block": pa.array([*table.column("block").to_pylist(), None], pa.string()),
                "part": pa.array([part] * (table.num_rows + 1), pa.int32()),
                "cls": pa.array([*(c.tobytes() for c in cls), None], pa.binary()),
                "moves": pa.array([*[None] * table.num_rows, moves], moves_type),
            }
        )

    return run


READY = "block string, ids array<bigint>, held binary, lens binary, tokens binary, n binary, cls binary"


def _ready(classes: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cls = _classes(_numbers(batch, "number", i, np.int64), _value(batch, "cls", i).as_py())
                kept = [batch.column(batch.schema.get_field_index(c)).slice(i, 1) for c in ("block", "ids", "held", "lens", "tokens", "n")]
                yield pa.RecordBatch.from_arrays([*kept, *_binary(np.where(cls == NONE, classes, cls).astype(np.uint8))], ["block", "ids", "held", "lens", "tokens", "n", "cls"])

    return run


def _transitions(classes: int):
    """Counts (c, d): class c then class d over training tokens, where every word has one. Column `classes`: then a word seen once. Row `classes`: after a word seen once."""
    size = classes + 1

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                cur, prev = _learnt(batch, i)
                n, cls = _numbers(batch, "n", i, np.int64), _numbers(batch, "cls", i, np.uint8).astype(np.int32)
                total += np.bincount(cls[prev] * size + cls[cur], minlength=size * size)
                once = n[cur] == 1
                total += np.bincount(cls[prev[once]] * size + classes, minlength=size * size)
                once = n[prev] == 1
                total += np.bincount(classes * size + cls[cur[once]], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    return run


class ClassModel:
    """Probabilities of the class bigram model, as log10.

    `step` (contexts x classes): class after a context, where the last context stands for words not known.
    `unknown`: an unknown word after a context. `mass`: training tokens of each class.
    """

    def __init__(self, counts: np.ndarray, total: int):
        every = counts.shape[0] - 1
        moves, once = counts[:, :every], counts[:every, every]
        self.mass = moves[:every].sum(0)
        prior = (self.mass + 1e-3) / (self.mass + 1e-3).sum()
        step = (moves + PRIOR * prior) / (moves.sum(1, keepdims=True) + PRIOR)
        rare = min(0.5, max(1e-6, once.sum() / max(1, total)))
        unknown = np.append((once + PRIOR * rare) / (self.mass + PRIOR), rare).clip(1e-9, 0.9)
        self.step, self.unknown, self.total = np.log10(step * (1 - unknown)[:, None]), np.log10(unknown), total

    def score(self, tokens: np.ndarray, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 probability of each token; tokens are positions in a word list with counts n and classes cls, the first being the end."""
        if not self.total:
            return np.zeros(len(tokens))
        every = len(self.mass)
        known = n > 0
        ctx = np.where(known, cls, every)
        ctx[0] = cls[0]
        prev = ctx[np.append(0, tokens[:-1])]
        cls = np.minimum(cls, every - 1)
        emit = np.log10(np.maximum(n, 1)) - np.where(known, np.log10(np.maximum(self.mass, 1))[cls], 0)
        return np.where(known[tokens], self.step[prev, cls[tokens]] + emit[tokens], self.unknown[prev])


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, known_score double"


def _scored(model: ClassModel, distinct: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, lens = _numbers(batch, "tokens", i), _numbers(batch, "lens", i).astype(np.int64)
                n, cls = _numbers(batch, "n", i, np.int64), _numbers(batch, "cls", i, np.uint8).astype(np.int64)
                start = np.cumsum(lens) - lens
                base = np.log10((n + 0.5) / (model.total + 0.5 * (distinct + 1)))[tokens]
                known, score = (n > 0)[tokens], model.score(tokens, n, cls)
                add = lambda x: pa.array(np.add.reduceat(x, start))
                ids, held = _value(batch, "ids", i).values, pa.array(_numbers(batch, "held", i, bool))
                total = pa.array(np.full(len(lens), model.total, np.int64))
                columns = [ids, held, pa.array(lens), add(known.astype(np.int64)), total, add(base), add(score), add(np.where(known, score, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORES.split(", ")])

    return run


def _clustered(state: DataFrame, number: np.ndarray, classes: int, sweeps: int) -> DataFrame:
    """(block, cls): each block's classes by part, after the first sweep and `sweeps` - 1 later ones."""
    learnt, h = state.drop("ids"), len(number)
    b = np.zeros((h, h))
    pairs = stored(learnt.mapInArrow(_head_bigrams(number), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")), "lm-head")
    for r in pairs.collect():
        b.flat[r.code] = r.n
    drop_stored(pairs)
    of = exchange(b, classes)
    member = np.eye(classes)[of]
    halves = [member.T @ b @ member]
    cls = None
    for sweep in range(sweeps):
        smooth = sum(halves[-2:]) + 0.1
        follows = smooth / smooth.sum(1, keepdims=True)
        given = learnt if cls is None else learnt.join(cls.hint("shuffle_hash"), "block")
        asked = given.mapInArrow(_asked(number, of, classes, sweep), ASKED).groupBy("part")
        answers = stored(asked.applyInArrow(_placed(np.log(np.vstack([follows, follows.T])), smooth.sum(0)), ANSWERS), "lm-answers")
        table = np.zeros((classes, classes))
        moves = answers.filter("block IS NULL").select(F.explode("moves").alias("m")).groupBy("m.code").agg(F.sum("m.n").alias("n"))
        for r in moves.collect():
            table.flat[r.code] = r.n
        halves = [table] if sweep == 0 else [*halves, table]
        if sweep == 1:
            halves = [halves[0] / 2, table]
        by_block = answers.filter("block IS NOT NULL").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "cls"))).alias("x"))
        old, cls = cls, stored(by_block.select("block", F.col("x.cls").alias("cls")), "lm-classes")
        drop_stored(answers, *([old] if old is not None else []))
    return cls


def class_ngram_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """Log10 probability of every text under a Brown class bigram model learnt from the rows that are not held out; see the module's text."""
    given = docs.select(F.col(id_col).cast("bigint").alias("id"), (id_mod(id_col, 5) == 1).alias("held"), text_bytes(text_col).alias("text"))
    blocks = stored(given.mapInArrow(_blocks, BLOCK), "lm-blocks", compression="zstd")
    spark = docs.sparkSession
    parts = max(1, -(-(blocks.agg(F.sum(F.size("words"))).first()[0] or 0) // PART_WORDS))
    listed = blocks.mapInArrow(_listed(parts), "part int, block string, words array<binary>, counts binary")
    names = stored(listed.groupBy("part").applyInArrow(_names(head), NAMES), "lm-names", compression="zstd")
    per_part = names.filter("block IS NULL")
    total, distinct = per_part.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    top = per_part.select("part", F.explode("top").alias("w")).orderBy(F.desc("w.n"), "w.word").limit(head).collect()
    number = np.array([(r.part << 32) + r.w.at for r in top], np.int64)
    back = names.filter("block IS NOT NULL").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "at", "n"))).alias("x"))
    joined = blocks.select("block", "ids", "held", "lens", "tokens", "hashes").join(back, "block")
    # the join has dealt blocks by name already, so the buckets need no shuffle of their own
    state = Bucketed(joined.mapInArrow(_numbered(parts), STATE), "block", "lm_state", int(spark.conf.get("spark.sql.shuffle.partitions")))
    drop_stored(blocks, names)
    if not top:
        number, classes = np.array([-1], np.int64), 1
    classes = min(classes, len(number))
    cls = _clustered(state.df, number, classes, sweeps)
    ready = stored(state.df.join(cls.hint("shuffle_hash"), "block").mapInArrow(_ready(classes), READY), "lm-ready")
    drop_stored(cls)
    state.drop()
    every = classes + 1
    counts = np.zeros((every + 1, every + 1))
    for r in ready.mapInArrow(_transitions(every), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts.flat[r.code] = r.n
    return ready.mapInArrow(_scored(ClassModel(counts, int(total)), int(distinct)), SCORES)
