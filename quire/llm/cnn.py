"""op9: quality classifier, a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of CHUNK, each read with the WIDTH bytes that follow, so that
neighbouring chunks overlap and the whole text is covered. Learned filters over learned byte
embeddings run at every STRIDE-th byte; each filter is max-pooled in its chunk; the mean and the
maximum of the pooled values over all chunks are combined into one logistic probability. Texts longer
than PART_CHUNKS chunks are read in parts of that length, whose sums and maxima are combined.

Training uses a bounded sample of labelled rows of all lengths: PER_CLASS of each label, chosen by a hash of
doc_id; of a text longer than TRAIN_BYTES, as many whole chunks as make up that length, evenly spread over it. Scoring
covers every row and every byte. Filters run at every STRIDE-th byte, in training and scoring alike.

Defined cases: null and empty texts are scored as one blank chunk. Without labels of both kinds the
score is the share of label 1 (0.5 without any). Rows labelled twice count by their smallest label.
Repeated rows and null ids are scored like others. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, id_mod, rows, text_bytes

CHUNK, WIDTH, STRIDE = 256, 8, 2
EMBED, FILTERS = 8, 24
#: Bounds of the training sample: rows of each label, and bytes of each text.
PER_CLASS, TRAIN_BYTES = 1200, 24 * CHUNK
#: Chunks of one text read at once.
PART_CHUNKS = 1 << 14
EPOCHS, BATCH, RATE = 8, 32, 4e-3
GOOD = 0.7
SLICE_BYTES = 4 << 20
#: Chunks whose filters are computed at once.
AT_ONCE = 512


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks (rows of CHUNK + WIDTH bytes, zero-filled) of all texts, and each text's number of chunks."""
    count = np.array([max(1, -(-len(t) // CHUNK)) for t in texts], np.int64)
    start = np.cumsum(count) - count
    flat = np.zeros(int(count.sum()) * CHUNK, np.uint8)
    for t, s in zip(texts, start.tolist()):
        flat[s * CHUNK : s * CHUNK + len(t)] = np.frombuffer(t, np.uint8)
    out = np.zeros((int(count.sum()), CHUNK + WIDTH), np.uint8)
    out[:, :CHUNK] = flat.reshape(-1, CHUNK)
    follows = np.ones(len(out), bool)
    follows[start + count - 1] = False
    at = np.flatnonzero(follows)
    out[at, CHUNK:] = out[at + 1, :WIDTH]
    return out, count


class ByteNet:
    def __init__(self, seed: int = 9):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.w = r.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(2 * FILTERS, np.float32)
        self.bias = np.zeros(1, np.float32)
        self.constant: float | None = None

    def windows(self, c: np.ndarray) -> np.ndarray:
        """(chunk, position, WIDTH * EMBED) embedded windows."""
        e = self.embed[c].reshape(len(c), -1)
        n = CHUNK // STRIDE
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(c), n, WIDTH * EMBED), (s[0], s[1] * STRIDE * EMBED, s[1]))

    def pooled(self, c: np.ndarray) -> np.ndarray:
        """(chunk, filter) max-pooled activations."""
        out = np.empty((len(c), FILTERS), np.float32)
        for k in range(0, len(c), AT_ONCE):
            part = self.windows(c[k : k + AT_ONCE])
            z = np.ascontiguousarray(part).reshape(-1, WIDTH * EMBED) @ self.w
            out[k : k + AT_ONCE] = z.reshape(len(part), -1, FILTERS).max(1)
        return np.maximum(out + self.b, 0)

    def features(self, texts: list[bytes]) -> np.ndarray:
        if any(len(t) > PART_CHUNKS * CHUNK for t in texts):
            return np.concatenate([self._long(t) if len(t) > PART_CHUNKS * CHUNK else self.features([t]) for t in texts])
        c, n = chunks(texts)
        h, start = self.pooled(c), np.cumsum(n) - n
        return np.concatenate([np.add.reduceat(h, start) / n[:, None], np.maximum.reduceat(h, start)], 1)

    def _long(self, text: bytes) -> np.ndarray:
        total, most, count = np.zeros(FILTERS), np.full(FILTERS, -np.inf), -(-len(text) // CHUNK)
        for k in range(0, count, PART_CHUNKS):
            # with the chunk after a part, whose first bytes its last chunk reads too
            h = self.pooled(chunks([text[k * CHUNK : (k + PART_CHUNKS + 1) * CHUNK]])[0][:PART_CHUNKS])
            total, most = total + h.sum(0), np.maximum(most, h.max(0))
        return np.concatenate([total / count, most])[None].astype(np.float32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.features(texts) @ self.out + self.bias).astype(np.float64)))

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 9) -> "ByteNet":
        """Adam on the log loss; label 1 weighs GOOD of the whole, whatever the sample's shares."""
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        share = labels.mean()
        weight = np.where(labels == 1, GOOD / share, (1 - GOOD) / (1 - share))
        r = np.random.default_rng(seed)
        params = [self.embed, self.w, self.b, self.out, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step, steps = 0, epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                at = order[k : k + BATCH]
                grads = self._gradients([texts[i] for i in at], labels[at], weight[at])
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for p, g, (m, v) in zip(params, grads, moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, texts, labels, weight):
        c, n = chunks(texts)
        start, doc = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        x = np.ascontiguousarray(self.windows(c))
        z = (x.reshape(-1, WIDTH * EMBED) @ self.w).reshape(len(c), -1, FILTERS)
        top = z.argmax(1)
        h = np.maximum(np.take_along_axis(z, top[:, None], 1)[:, 0] + self.b, 0)
        mean, most = np.add.reduceat(h, start) / n[:, None], np.maximum.reduceat(h, start)
        f = np.concatenate([mean, most], 1)
        p = 1 / (1 + np.exp(-(f @ self.out + self.bias)))
        d = ((p - labels) * weight / len(labels)).astype(np.float32)
        dh = (d[:, None] * self.out[:FILTERS] / n[:, None])[doc]
        dmost = d[:, None] * self.out[FILTERS:]
        is_most = h == most[doc]
        dh += np.where(is_most, dmost[doc], 0) / np.add.reduceat(is_most.astype(np.float32), start).clip(1)[doc]
        dh = np.where(h > 0, dh, 0).astype(np.float32)
        own = np.take_along_axis(x, top[:, :, None], 1)  # chunk, filter, window
        dw = np.einsum("cfk,cf->kf", own, dh)
        dx = dh[:, :, None] * self.w.T
        byte = top[:, :, None] * STRIDE + np.arange(WIDTH)
        byte = np.take_along_axis(c[:, None, :].repeat(FILTERS, 1), byte, 2).ravel()
        dx = dx.reshape(-1, EMBED)
        de = np.stack([np.bincount(byte, dx[:, i], 256) for i in range(EMBED)], 1).astype(np.float32)
        de[0] = 0
        return de, dw.astype(np.float32), dh.sum(0), (f.T @ d + 1e-4 * self.out).astype(np.float32), d.sum(keepdims=True)


def spread(text: bytes, longest: int = TRAIN_BYTES) -> bytes:
    """A text, or of a longer one the chunks that make up `longest` bytes, evenly spread over it, the first and the last included."""
    if len(text) <= longest:
        return text
    count, want = -(-len(text) // CHUNK), longest // CHUNK
    return b"".join(text[k * CHUNK : (k + 1) * CHUNK] for k in np.linspace(0, count - 1, want).astype(int).tolist())


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, longest: int, learn=None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[bytes, int]]:
    """At most per_class rows of each label, by hash of the id: (spread text, label), in a fixed order."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    joined = docs.select(F.col(id_col).cast("bigint").alias("_id"), text_bytes(text_col).alias("_text")).filter(F.col("_id").isNotNull())
    if learn is not None:
        joined = joined.filter(learn("_id"))
    shares = marks.groupBy("_label").count().collect()
    bound = {r["_label"]: min(1.0, 3 * per_class / r["count"]) for r in shares}
    mixed = F.pmod(F.xxhash64("_id", F.lit(9)), F.lit(1 << 30))
    marks = marks.withColumn("_h", mixed).filter(F.col("_h") < F.when(F.col("_label") == 1, int(bound.get(1, 1) * (1 << 30))).otherwise(int(bound.get(0, 1) * (1 << 30))))

    def cut(batches):
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            for part in by_bytes(batch, "_text", SLICE_BYTES):
                yield part.set_column(at, "_text", pa.array([spread(t, longest) for t in rows(part, "_text")], pa.binary()))

    found = joined.join(F.broadcast(marks), "_id")  # about 6 * per_class ids at most
    picked = found.mapInArrow(cut, found.schema).dropDuplicates(["_id", "_text"])
    out = []
    for label in (0, 1):
        out += [(bytes(r["_text"]), label) for r in picked.filter(F.col("_label") == label).orderBy("_h", "_id", "_text").limit(per_class).collect()]
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fold: int = 4, out: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows whose id falls in fold `out` are not learnt from."""
    sample = labelled_sample(docs, labels, label_col, PER_CLASS, TRAIN_BYTES, lambda c: id_mod(c, fold) != out, id_col, text_col)
    net = ByteNet().train([t for t, _ in sample], np.array([x for _, x in sample], float))
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (id_mod(id_col, fold) == out).alias("held_out"), text_bytes(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                score = net.score(rows(part, "text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return given.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
