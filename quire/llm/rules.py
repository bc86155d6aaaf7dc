"""op10: quality rules, gradient-boosted trees over document statistics.

Exact statistics of every whole text feed depth-limited trees that are fitted on the driver by
histogram boosting and flattened into node arrays, which score all rows of a batch in as many numpy
steps as a tree has levels. Features in FALLING may only lower the verdict as they rise: a split that
would break this is not taken, and child values are kept within bounds that hold for their subtrees.

Training uses a bounded sample of labelled rows: at most SAMPLE ids, chosen by hash, statistics only.

Defined cases: null and empty texts have no words and fail the base rule. Without labels of both kinds
every text that passes the base rule is kept. Rows labelled twice count by their smallest label.
Repeated rows and null ids are judged like others. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, rows, text_bytes

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 3, 32, 0.2, 20, 1.0
#: Verdict: kept where the probability of a good text is at least this.
KEEP = 0.3
SLICE_BYTES = 4 << 20
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "capitals", "marks", "digits", "lone_marks", "distinct", "mean_line", "exclaims", "foreign")
FALLING = ("symbols", "dup_lines", "repeats", "capitals", "exclaims", "lone_marks")
_CAPITAL, _DIGIT, _MARK = bytes(range(65, 91)), b"0123456789", b"!\"'(),-./:;?[]_`{}~@\\^+="
_LONE = re.compile(rb"(?:(?<=[ \t-\r])|\A)[!-/:-@\[-`{-~]+(?=[ \t-\r]|\Z)").findall


def statistics(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The COUNTS and FEATURES of one text (UTF-8)."""
    words = text.split()
    n = len(words)
    without = lambda chars: len(text) - len(text.translate(None, chars))
    chars = len(text.decode("utf-8", "replace")) - without(SPACE)
    symbols = without(SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats, distinct = 0, len(set(words))
    if n > 3:
        number = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
        _, of, times = np.unique(pairs[:-1] * np.int64(distinct) + ids[2:], return_inverse=True, return_counts=True)
        twice = times[of] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= twice
        repeats = int(hit.sum())
    c, w = max(1, chars), max(1, n)
    features = (np.log1p(n), chars / w, symbols / c, dup / max(1, len(lines)), repeats / w, without(_CAPITAL) / c, without(_MARK) / c, without(_DIGIT) / c, len(_LONE(text)) / w, distinct / w, n / max(1, len(lines)), text.count(b"!") / c, (len(text) - without(bytes(range(128)))) / max(1, len(text)))
    return (n, chars, symbols, dup, repeats), features


class Trees:
    """Boosted trees as flat arrays: per node a feature, a threshold, the left child (the right one follows it) and a value."""

    def __init__(self, base: float = 0.0):
        self.base, self.roots = base, np.zeros(0, np.int64)
        self.feature = self.threshold = self.child = self.value = np.zeros(0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(self.roots):
            at = np.repeat(self.roots[None], len(x), 0)
            each = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                f = self.feature[at]
                # a leaf points at itself: feature -1
                at = np.where(f < 0, at, self.child[at] + (x[each, np.maximum(f, 0)] > self.threshold[at]))
            out += self.value[at].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))

    def fit(self, x: np.ndarray, y: np.ndarray, falling: list[int], trees: int = TREES) -> "Trees":
        if len(set(y.tolist())) < 2:
            self.base = 10.0 if not len(y) or y.mean() == 1 else -10.0
            return self
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        nodes: list[list[float]] = []
        score, roots = np.zeros(len(y)), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            roots.append(len(nodes))
            nodes.append([])
            self._grow(nodes, roots[-1], binned, cuts, (y - p) * weight, p * (1 - p) * weight, np.arange(len(y)), 0, -np.inf, np.inf, set(falling), score)
        table = np.array(nodes, float)
        self.roots, self.feature, self.threshold = np.array(roots), table[:, 0].astype(np.int64), table[:, 1]
        self.child, self.value = table[:, 2].astype(np.int64), table[:, 3]
        return self

    def _grow(self, nodes, me, binned, cuts, g, h, at, depth, low, high, falling, score):
        worth = lambda a, b: np.clip(a / (b + RIDGE), low, high)
        gain_of = lambda a, b, v: a * v - 0.5 * (b + RIDGE) * v * v
        value = float(worth(g[at].sum(), h[at].sum()))
        best = (1e-6, None)
        if depth < DEPTH and len(at) >= 2 * LEAST:
            whole = gain_of(g[at].sum(), h[at].sum(), value)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[at, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[at], h[at], np.ones(len(at))))
                gr, hr = g[at].sum() - gl, h[at].sum() - hl
                vl, vr = worth(gl, hl), worth(gr, hr)
                gain = gain_of(gl, hl, vl) + gain_of(gr, hr, vr) - whole
                gain[(nl < LEAST) | (len(at) - nl < LEAST)] = -np.inf
                if j in falling:
                    gain[vl < vr] = -np.inf
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, (vl[k] + vr[k]) / 2))
        if best[1] is None:
            nodes[me] = [-1, 0.0, me, RATE * value]
            score[at] += RATE * value
            return
        j, k, mid = best[1]
        left = len(nodes)
        nodes += [[], []]
        nodes[me] = [j, cuts[j][k], left, 0.0]
        goes = binned[at, j] > k
        bounds = ((mid, high), (low, mid)) if j in falling else ((low, high), (low, high))
        self._grow(nodes, left, binned, cuts, g, h, at[~goes], depth + 1, *bounds[0], falling, score)
        self._grow(nodes, left + 1, binned, cuts, g, h, at[goes], depth + 1, *bounds[1], falling, score)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    marks = marks.withColumn("_h", F.xxhash64("_id", F.lit(10))).orderBy("_h", "_id").limit(sample)
    given = docs.select(F.col(id_col).cast("bigint").alias("_id"), text_bytes(text_col).alias("_text")).join(F.broadcast(marks), "_id")

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "_text", SLICE_BYTES):
                x = pa.array([list(map(float, statistics(t)[1])) for t in rows(part, "_text")], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in ("_h", "_label")), x], ["h", "label", "x"])

    got = given.mapInArrow(run, "h bigint, label int, x array<double>").distinct().orderBy("h", "x").limit(sample).collect()
    x, y = np.array([r.x for r in got], float).reshape(-1, len(FEATURES)), np.array([r.label for r in got], float)
    return Trees().fit(x, y, [FEATURES.index(f) for f in FALLING])


def _judged(docs: DataFrame, model: Trees, keep: list, names: list[str], text_col: str) -> DataFrame:
    """mapInArrow over the columns `keep` and the text: adds the counts, base_failed and kept."""
    schema = docs.select(*keep).schema
    given = docs.select(*keep, text_bytes(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "_text", SLICE_BYTES):
                both = [statistics(t) for t in rows(part, "_text")]
                counts = np.array([c for c, _ in both], np.int64).reshape(-1, len(COUNTS))
                failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
                good = model.probability(np.array([f for _, f in both], float).reshape(-1, len(FEATURES)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, counts.T), pa.array(failed), pa.array(~failed & (good >= KEEP)), pa.array(good)], [*names, *COUNTS, "base_failed", "kept", "probability"])

    out = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema)] + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("probability", T.DoubleType())])
    return given.mapInArrow(run, out)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, the counts, base_failed, kept and the trees' probability of every row."""
    model = fit(docs, labels, id_col, text_col, label_col)
    return _judged(docs, model, [F.col(id_col).cast("bigint").alias("doc_id")], ["doc_id"], text_col)


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs that are kept; columns as they are."""
    model = fit(docs, labels, id_col, text_col, label_col)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    found = _judged(docs.toDF(*names), model, names, names, names[docs.columns.index(text_col)]).filter("kept")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
