"""op5: SimHash fingerprints and exact linking by tiled comparison.

Distinct fingerprints are tiled by the set bits of their two 32-bit halves. Two fingerprints within
the radius have halves whose bit counts differ by at most the radius in sum, so only such tile pairs
are compared, each with numpy exclusive-or and bit counts, after the same test on 16-bit quarters.
Tiles above BLOCK fingerprints are cut into blocks by hash, all pairs of which are compared: no
fingerprint and no link is left out. A tile pair returns a spanning forest of its links (at most one
edge per fingerprint), never the links themselves; components follow from rounds of minimum-label
stars on those edges, whose state lies in the shared folder. Rows learn their component by their
fingerprint: those that very many rows share (HOT_LEAST at least, HOT_MOST of them at most) by broadcast, the
others by a shuffled join.

Defined cases: null and empty texts, and texts without a word, have fingerprint zero and link like
any other. Fewer words than a shingle: the whole word sequence is the only shingle. Rows with one
doc_id each get their own fingerprint; a null doc_id is never a component's name, so a component of
null ids alone has a null name. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, drop_stored, rows, stored, text_bytes

#: Fingerprints of a tile compared as one block.
BLOCK = 1 << 16
#: Bytes of text turned into fingerprints at once.
SLICE_BYTES = 4 << 20
#: Comparisons held in memory at once.
AT_ONCE = 1 << 20
#: A fingerprint is hot if more than HOT_LEAST rows, and more than one in HOT_MOST, have it; so there are at most HOT_MOST.
HOT_LEAST, HOT_MOST = 4096, 100_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the bigint columns `keys`."""
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *keys, text_bytes(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                fp = np.array([fingerprint(t, width) for t in rows(part, "text")], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp.view(np.int64))], ["doc_id", *keys, "fp"])

    return given.mapInArrow(run, ", ".join(["doc_id bigint", *(f"{k} bigint" for k in keys), "fp bigint"]))


class _Forest:
    """Union-find over positions, in bulk; the root is the smallest position."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            live = a != b
            if not live.any():
                return
            i, j, a, b = i[live], j[live], a[live], b[live]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int64)


def _groups(fp: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bit counts of the quarters, positions) of fingerprints that share them."""
    q = _quarters(fp[at])
    key = q @ np.array([1, 17, 289, 4913])
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    return [(q[p[0]], at[p]) for p in np.split(order, cut)] if len(at) else []


def forest(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Roots after linking every position in `left` with every one in `right` that lies within the radius."""
    tree = _Forest(len(fp))

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, AT_ONCE // len(b))
        x = fp[b]
        for k in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(fp[a[k : k + step], None] ^ x) <= radius)
            tree.link(a[k + i], b[j])

    if not len(left) or not len(right):
        return tree.root
    if len(left) * len(right) <= 1 << 16:
        compare(left, right)
        return tree.root
    mine, other = _groups(fp, left), _groups(fp, right)
    table = np.array([q for q, _ in other])
    for q, a in mine:
        near = np.flatnonzero(np.abs(table - q).sum(1) <= radius)
        if len(near):
            compare(a, np.concatenate([other[k][1] for k in near]))
    return tree.root


def links(distinct: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): spanning forests of the links among distinct fingerprints (column fp)."""
    ones = lambda c: F.bit_count(c).cast("int")
    placed = distinct.select("fp", ones(F.shiftrightunsigned("fp", 32)).alias("p"), ones(F.col("fp").bitwiseAND(0xFFFFFFFF)).alias("q"))
    tiles = placed.groupBy("p", "q").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    tiles = stored(tiles.select("p", "q", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")), "simhash-tiles")
    steps = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if abs(a) + abs(b) <= radius]
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps)))
    pairs = tiles.select("p", "q", "k", near.alias("d")).select("p", "q", "k", (F.col("p") + F.col("d.a")).alias("p2"), (F.col("q") + F.col("d.b")).alias("q2"))
    other = tiles.select(F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("k").alias("k2"))
    pairs = pairs.join(other, ["p2", "q2"]).filter("p < p2 OR p = p2 AND (q < q2 OR q = q2 AND k <= k2)")
    name = F.struct("p", "q", "k", "p2", "q2", "k2")
    pairs = stored(pairs.select(name.alias("pair"), F.explode(F.expr("array(struct(p, q, k, 0 AS side), struct(p2 AS p, q2 AS q, k2 AS k, 1 AS side))")).alias("t")).select("pair", "t.*"), "simhash-pairs")
    blocked = placed.join(tiles.select("p", "q", "blocks").distinct(), ["p", "q"]).select("fp", "p", "q", F.pmod(F.hash("fp"), F.col("blocks")).alias("k"))
    sent = blocked.join(pairs, ["p", "q", "k"]).filter("side = 0 OR pair.p != pair.p2 OR pair.q != pair.q2 OR pair.k != pair.k2").select("pair", "fp", "side")

    def run(table: pa.Table) -> pa.Table:
        fp = np.array(table.column("fp").to_numpy(), np.int64).view(np.uint64)
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        pair = table.column("pair")[0].as_py()
        if (pair["p"], pair["q"], pair["k"]) == (pair["p2"], pair["q2"], pair["k2"]):
            right = left
        root = forest(fp, left, right, radius)
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": fp[at].view(np.int64), "b": fp[root[at]].view(np.int64)})

    found = stored(sent.groupBy("pair").applyInArrow(run, "a bigint, b bigint"), "simhash-links")
    drop_stored(tiles, pairs)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node with an edge.

    Rounds of large-star and small-star (Kiveris et al., 2014) until the edges are stars; each round
    is a few joins and minimum aggregates, its state is written to the shared folder.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    current = stored(edges.filter("a != b").select(hi.alias("a"), lo.alias("b")).distinct(), "stars")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was = mark(current)
    while was[0]:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        before, current = current, stored(small, "stars")
        drop_stored(before)
        now = mark(current)
        if now == was:
            break
        was = now
    both = current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    found = stored(both, "stars-roots")
    drop_stored(current)
    return found


def _rooted(distinct: DataFrame, radius: int, block: int) -> DataFrame:
    """The rows of `distinct` (fp and others, one row a fingerprint) with the root of their component: its smallest fingerprint, signed."""
    edges = links(distinct.select("fp"), radius, block)
    roots = components(edges)
    drop_stored(edges)
    found = stored(distinct.join(roots, distinct.fp == roots.node, "left").drop("node").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")
    drop_stored(roots)
    return found


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable by links) of every row."""
    marked = stored(fingerprints(docs, width, id_col, text_col), "simhash")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("m")), "simhash-distinct")
    rooted = _rooted(distinct, radius, block)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(least, "root").select("fp", "component_id", "m"), "simhash-named")
    many = max(HOT_LEAST, marked.count() // HOT_MOST)
    drop_stored(distinct, rooted)
    hot = F.broadcast(named.filter(F.col("m") > many).drop("m"))  # HOT_MOST rows at most
    rest = marked.join(hot.select("fp"), "fp", "left_anti").join(named.filter(F.col("m") <= many).drop("m"), "fp")
    found = marked.join(hot, "fp").select("doc_id", "fp", "component_id").union(rest.select("doc_id", "fp", "component_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _whole_row(docs: DataFrame, seed: int):
    """A 64-bit hash of all of a row's columns, nulls told from values."""
    flat = [F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in docs.dtypes]
    return F.xxhash64(F.lit(seed), *flat, *[F.isnull(c) for c in docs.columns])


def one_of_each(docs: DataFrame, width: int = 3, radius: int = 3, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, columns as they are.

    The row with the smallest doc_id stays (null ids last), then the one with the smallest fingerprint, then the
    smallest hash of all columns; of rows equal in every column one. So no component is lost, however ids
    repeat, and reruns agree. Which row that is needs only ids, fingerprints and hashes; the texts are shuffled once, by hash.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    own = own.withColumn("h1", _whole_row(own, 1)).withColumn("h2", _whole_row(own, 2))
    marked = stored(fingerprints(own, width, names[docs.columns.index(id_col)], names[docs.columns.index(text_col)], ("h1", "h2")), "simhash")
    order = F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "fp", "h1", "h2")
    distinct = stored(marked.groupBy("fp").agg(F.min(order).alias("best")), "simhash-distinct")
    rooted = _rooted(distinct, radius, block)
    kept = stored(rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.h1", "best.h2"), "simhash-kept")
    drop_stored(marked, distinct, rooted)
    out = own.join(kept, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
