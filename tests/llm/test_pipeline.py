import random

import pytest

import corpus_pipeline
from quire.llm.bpe import load
from quire.llm.registry import vocabulary

from .conftest import prose


@pytest.fixture
def folder(spark, docs, tmp_path):
    rows = [(i, prose(random.Random(i), 80), "en", "ab"[i % 2]) for i in range(80)]
    rows += [(200 + i, rows[i][1], "en", "a") for i in range(10)] + [(300, None, None, None), (301, "1 2 3", "en", "a"), (302, " ".join(w.upper() + "!!" for w in rows[5][1].split()), "en", "b")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), {i: t for i, t, _, _ in rows}


def test_stages(spark, folder):
    d, texts = folder
    df = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = df.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, d)
        if name != "encoding":
            assert df.columns == columns
            seen[name] = sorted(r.doc_id for r in df.select("doc_id").collect())
    assert set(range(80)) <= set(seen["language"]) and not {300, 301} & set(seen["language"])
    assert set(range(80)) <= set(seen["quality"])
    assert set(seen["near_dedup"]) & set(range(80)) == set(range(80)) and not {200 + i for i in range(10)} & set(seen["near_dedup"])
    assert set(seen["mixing"]) <= set(seen["near_dedup"]) and max(map(seen["mixing"].count, seen["mixing"])) <= 3


def test_run_encodes_exactly(spark, folder):
    d, texts = folder
    codec = load(vocabulary("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, d).collect()
    assert got and all(r.n_tokens == len(codec.ids(texts[r.doc_id])) for r in got)


def test_encoding_hands_on_ids_and_text(spark, docs):
    codec = load(vocabulary("byte_bpe_50k.json"))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "a  b\n\nc é😀 <|endoftext|>", "en", "a"), (4, prose(random.Random(1), 80), "en", "b")]
    got = {r.doc_id: (r.ids, r.decoded) for r in corpus_pipeline.encoding(spark, docs(rows), "").collect()}
    assert got == {i: (codec.ids(t or "").tolist(), t or "") for i, t, _, _ in rows}


def test_stages_on_empty_odd_and_clashing_tables(spark, docs, tmp_path):
    odd = [(1, None, None, None), (None, "", None, None), (None, "word", "en", "a"), (3, "x" * 80_000, "en", "a"), (3, "the cat " * 20_000, "en", "a"), (3, "the cat " * 20_000, "en", "a")]
    spark.createDataFrame([(None, None, None), (3, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], odd):
        df = docs(rows).withColumnsRenamed({"size": "fp", "id": "h1", "n_chars": "_c0"})
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(tmp_path))
            n = out.count()
            assert name == "encoding" or out.columns == df.columns
            assert rows or n == 0
            if rows:
                assert n == {"language": n, "quality": n, "near_dedup": len({None, "word", "x", "the"}), "mixing": n, "encoding": len(rows)}[name]
