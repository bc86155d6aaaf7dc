"""op6: language identification by nearest centroid.

A text is a vector of byte 2- and 3-gram counts of its lower-cased letters, hashed into DIMS places,
weighed by log(1 + count) times inverse document frequency, and normalised. Each language has CENTROIDS
centroids from spherical k-means; a text gets the language of the centroid with the largest cosine,
which is the score. A language rejects texts farther from its centroids than REJECT times the cosine
that all but REJECT_TAIL of its own sample reach.

Fitting uses a bounded sample: about SAMPLE rows in all, shared equally by the languages (EACH at least), chosen
by a hash of id and text, whole texts; no language has more than twice its share. The sample lies in the shared folder
as sparse counts, each language's centroids are found where its rows are, and only centroids and document
frequencies reach the driver: DIMS numbers a centroid. Everything else covers all rows.

Defined cases: a text that is null, empty or without a letter is `und` with score 0 and rejected. No
training rows at all: every text is `und`. Ties go to the first language in code point order. Repeated
rows and null ids are scored like others (a null id counts as ''). An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, drop_stored, id_mod, rows, stored, text_bytes

DIMS, CENTROIDS, ROUNDS = 4096, 4, 8
#: Bound of the training sample over all languages, least share of one, and the most languages there can be.
SAMPLE, EACH, LANGUAGES = 4000, 50, 1000
REJECT, REJECT_TAIL = 0.4, 0.01
SLICE_BYTES = 4 << 20
#: Bytes as they count: ASCII letters in lower case, other ASCII as one space, the rest as it is.
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def gram_counts(text: bytes) -> np.ndarray:
    """Hashed 2- and 3-gram counts of a text's bytes."""
    b = _PLAIN[np.frombuffer(b" " + text.decode("utf-8", "replace").lower().encode() + b"  ", np.uint8)].astype(np.uint32)
    two = b[:-2] << 8 | b[1:-1]
    three = two << 8 | b[2:]
    live = b[1:-1] != 32
    mix = lambda x: x * np.uint32(2654435761) >> np.uint32(20)
    return np.bincount(np.concatenate([mix(two[live] + np.uint32(1 << 24)), mix(three[live])]).astype(np.int64), minlength=DIMS).astype(np.float32)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def centroids(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from far-apart first centres; rows of x are normalised."""
    chosen = [int((x @ _normal(x.mean(0, keepdims=True)).T).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        c = _normal(np.stack([x[of == i].sum(0) if (of == i).any() else c[i] for i in range(len(c))]))
    return c


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray, centres: np.ndarray, of: np.ndarray, least: np.ndarray):
        self.languages, self.idf, self.centres, self.of, self.least = languages, idf, centres, of, least

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _normal(np.log1p(counts) * self.idf)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text."""
        import regex

        letter = regex.compile(r"\p{L}").search
        n = len(texts)
        known = np.array([bool(letter(t.decode("utf-8", "replace"))) for t in texts], bool) if self.languages else np.zeros(n, bool)
        score, lang = np.zeros(n), np.zeros(n, int)
        at = np.flatnonzero(known)
        for k in range(0, len(at), 256):
            part = at[k : k + 256]
            cos = self.vectors(np.stack([gram_counts(texts[i]) for i in part])) @ self.centres.T
            best = cos.argmax(1)
            score[part], lang[part] = cos[np.arange(len(part)), best], self.of[best]
        rejected = ~known | (score < self.least[lang]) if self.languages else ~known
        return [self.languages[j] if k else "und" for k, j in zip(known, lang)], score.clip(0, 1), rejected


def _sparse(counts: np.ndarray) -> bytes:
    """Places (u2) and then counts (u4) of a vector that are not zero."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<u4").tobytes()


def _dense(sparse: list[bytes]) -> np.ndarray:
    x = np.zeros((len(sparse), DIMS), np.float32)
    for row, s in zip(x, sparse):
        n = len(s) // 6
        row[np.frombuffer(s, "<u2", n)] = np.frombuffer(s, "<u4", n, 2 * n)
    return x


def _frequencies(batches):
    """How many of a part's sample vectors hold each place, and how many there are."""
    n, seen = 0, np.zeros(DIMS, np.int64)
    for batch in batches:
        for s in rows(batch, "x"):
            n += 1
            seen[np.frombuffer(s, "<u2", len(s) // 6)] += 1
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([seen.tobytes()], pa.binary())], ["n", "seen"])


def _fitted(idf: np.ndarray):
    """Of one language's sample: its centroids and the cosine below which a text is rejected."""

    def run(table: pa.Table) -> pa.Table:
        own = LanguageModel([], idf, np.zeros((0, DIMS)), np.zeros(0), np.zeros(0)).vectors(_dense(sorted(table.column("x").to_pylist())))
        c = centroids(own)
        least = REJECT * np.quantile((own @ c.T).max(1), REJECT_TAIL)
        return pa.table({"lang": table.column("lang")[:1], "centres": pa.array([c.astype("<f4").tobytes()], pa.binary()), "least": pa.array([float(least)])})

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn=None) -> LanguageModel:
    """Learn from the rows with a language, a letter-bearing text and (where given) the condition `learn`."""
    given = docs.filter(F.col(lang_col).isNotNull() & (F.length(F.coalesce(F.col(text_col), F.lit(""))) > 0))
    if learn is not None:
        given = given.filter(learn)
    given = given.select(F.col(lang_col).cast("string").alias("lang"), text_bytes(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(6)), F.lit(1 << 30)).alias("h"))
    counts = given.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    each = max(EACH, sample // max(1, len(counts)))
    bounds = docs.sparkSession.createDataFrame([(r.lang, int(min(1, each / r.n) * (1 << 30))) for r in counts], "lang string, bound bigint")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    picked = given.join(F.broadcast(bounds), "lang").filter("h < bound").withColumn("place", place).filter(F.col("place") <= 2 * each)  # broadcast: LANGUAGES rows at most

    def run(batches):
        for batch in batches:
            x = [_sparse(gram_counts(t)) for t in rows(batch, "text")]
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("lang")), pa.array(x, pa.binary())], ["lang", "x"])
            yield out.filter(pa.array([len(v) > 0 for v in x], pa.bool_()))

    found = stored(picked.select("lang", "text").mapInArrow(run, "lang string, x binary"), "lang-sample")
    parts = found.mapInArrow(_frequencies, "n bigint, seen binary").collect()
    seen = sum((np.frombuffer(r.seen, np.int64) for r in parts), np.zeros(DIMS, np.int64))
    idf = (np.log((1 + sum(r.n for r in parts)) / (1 + seen)) + 0.1).astype(np.float32)
    fitted = sorted(found.groupBy("lang").applyInArrow(_fitted(idf), "lang string, centres binary, least double").collect(), key=lambda r: r.lang)
    drop_stored(found)
    centres = [np.frombuffer(r.centres, "<f4").reshape(-1, DIMS) for r in fitted]
    of = np.repeat(np.arange(len(fitted)), [len(c) for c in centres])
    return LanguageModel([r.lang for r in fitted], idf, np.concatenate([*centres, np.zeros((0, DIMS), np.float32)]), of, np.array([r.least for r in fitted]))


def _predicted(docs: DataFrame, model: LanguageModel, keep: list, names: list[str], text_col: str) -> DataFrame:
    """mapInArrow over the columns `keep` and the text: adds lang_pred, score, rejected."""
    schema = docs.select(*keep).schema
    given = docs.select(*keep, text_bytes(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "_text", SLICE_BYTES):
                lang, score, rejected = model.predict(rows(part, "_text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    out = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema)] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return given.mapInArrow(run, out)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row; rows whose id falls in fold 0 are not learnt from."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, learn=id_mod(id_col, fold) != 0)
    keep = [F.col(id_col).cast("bigint").alias("doc_id"), (id_mod(id_col, fold) == 0).alias("held_out")]
    return _predicted(docs, model, keep, ["doc_id", "held_out"], text_col)


def accepted(docs: DataFrame, text_col: str = "text", **columns) -> DataFrame:
    """The rows of docs whose language is recognised; columns as they are."""
    model = fit(docs, text_col=text_col, **columns)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    given = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    found = _predicted(given, model, names, names, text).filter(~F.col("rejected"))
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
