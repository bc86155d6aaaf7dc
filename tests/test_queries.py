"""Every query with SQL against that SQL, and what has none against literal rows."""

import io
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quire import cli
from quire.functions import geometry as geo
from quire.operators.elements import Parsed, layout_text
from quire.operators.structure import Structure
from quire.options import ALL, FULL, TEXT
from quire.plans.queries import oracle_sql, queries
from quire.sources import writer as w
from quire.sources.reader import parse, parse_files, parse_structure

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert cells([tuple(r) for r in df.collect()], df.columns) == cells(want.fetchall(), want.columns)
    spark.catalog.clearCache()


def test_entry_lists_every_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pdf")
    (d / "a.pdf").write_bytes(w.pages([b"BT /F 10 Tf 10 20 Td (Hi) Tj 40 0 Td (you) Tj 0 30 Td (top) Tj ET", b"0 0 1 1 re f"]))
    (d / "b.pdf").write_bytes(b"not a pdf")
    return str(d)


def test_files_and_reports(spark, folder):
    p = Parsed(parse_files(spark, folder, ALL, FULL)).persist()
    by = {r.doc_id.rsplit("/", 1)[1]: r for r in p.summary().collect()}
    assert (by["a.pdf"].pages, by["a.pdf"].texts, by["a.pdf"].graphics, by["b.pdf"].pages) == (2, 3, 1, 0)
    assert [r["class"] for r in p.errors().collect()] == ["malformed"]
    assert layout_text(p.layout()).first().text == "top\nHi you"
    assert p.plain_text().first().text == "Hi\nyou\ntop\n\f\n"
    assert '"texts":3' in p.summary_json().filter("doc_id LIKE '%a.pdf'").first().json
    assert '"annotations"' not in p.result_json().first().json
    p.close()
    p.close()


def test_written_tables_and_named_files(spark, folder, tmp_path):
    p = Parsed(parse_files(spark, folder, ALL, FULL)).write(f"{tmp_path}/parsed")
    assert p.texts().count() == 3 and p.summary().count() == 2 and p.glyphs().count() == 8
    odd = tmp_path / "REPORT.PDF"
    odd.write_bytes(w.pages([b"0 0 1 1 re f"]))
    (tmp_path / "no_suffix").write_bytes(w.pages([b"0 0 1 1 re f", b""]))
    count = lambda path: Parsed(parse_files(spark, str(path), ALL)).pages().count()
    assert (count(odd), count(tmp_path / "no_suffix")) == (1, 2)
    assert Parsed(parse_files(spark, f"{tmp_path}/REPORT*", ALL)).graphics().count() == 1
    out = io.StringIO()
    assert cli.main([str(odd)], out) == 0 and "Images: 0 (0 shared resources)" in out.getvalue() and "interpretation_complete=true" in out.getvalue()
    assert cli.main([f"{tmp_path}/missing.pdf"], io.StringIO(), io.StringIO()) == 1


def test_page_tree_limits_and_source_bytes(spark):
    from quire.operators.structure import source_bytes, stream_data

    deep = w.build([b"<</Type/Catalog/Pages 2 0 R>>", *(b"<</Type/Pages/Kids[%d 0 R]>>" % (i + 3) for i in range(5)), b"<</Type/Page/MediaBox[0 0 1 1]>>"])
    wrong = w.build([b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R 4 0 R]/MediaBox[0 0 1 1]>>", b"<</Type/Page>>", b"<</Type/Other>>"])
    df = spark.createDataFrame([(1, bytearray(deep)), (2, bytearray(wrong)), (3, None)], "doc_id bigint, content binary")
    tree = Structure(parse_structure(df))
    got = sorted((r.doc_id, r.page, r.error) for r in tree.page_tree().collect() if r.doc_id < 3)
    assert got == [(1, 0, None), (2, 0, None), (2, 1, "page tree node has an unknown type")] or got[2][2].startswith("page tree node")
    assert {r.error for r in tree.page_tree(depth=3).filter("doc_id = 1").collect()} == {"page tree depth limit exceeded"}
    asked = spark.createDataFrame([(1, 9, 0, 5), (1, 1, 0, 5), (3, 1, 0, 1)], "doc_id bigint, source int, start bigint, end bigint")
    assert sorted((r.doc_id, r.source, None if r.bytes is None else bytes(r.bytes)) for r in source_bytes(asked, df).collect()) == [(1, 1, b"%PDF-"), (1, 9, None), (3, 1, None)]
    streams = spark.createDataFrame([(1, 2, 0), (3, 1, 0)], "doc_id bigint, num bigint, gen int")
    assert all(r.bytes is None and r.error for r in stream_data(streams, df).collect())


def test_stream_equals_batch(spark, folder):
    from quire.streaming.ingest import parse_stream

    q = parse_stream(spark, folder, TEXT).writeStream.format("memory").queryName("pdf_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = Parsed(spark.table("pdf_stream")).texts().select("unicode").collect()
    assert sorted(r.unicode for r in got) == ["Hi", "top", "you"]


def test_data_source(spark, folder):
    from quire.sources.datasource import register

    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("quire_pdf").option("path", f"{folder}/a.pdf").load()
    rows = df.filter(F.col("path") == f"{folder}/a.pdf").orderBy("ord").collect()
    assert [r.value for r in rows] == ["Hi", "you", "top"] and '"unicode": "Hi"' in rows[0].row
    broken = spark.read.format("quire_pdf").option("path", folder).load().filter("kind = 'error'").collect()
    assert len(broken) == 1 and broken[0].path.endswith("b.pdf")


def test_cli(spark, folder):
    out = io.StringIO()
    assert cli.main(["--layout", f"{folder}/a.pdf"], out) == 0 and out.getvalue() == "top\nHi you\n"
    assert cli.main(["--json", "--text", f"{folder}/a.pdf"], io.StringIO(), io.StringIO()) == 2
    assert cli.main([f"{folder}/b.pdf"], io.StringIO(), io.StringIO()) == 1


def test_null_content_and_ids(spark):
    df = spark.createDataFrame([(None, None), (1, None), (2, bytearray(w.pages([b"0 0 1 1 re f"])))], "doc_id bigint, content binary")
    p = Parsed(parse(df, ALL))
    assert sorted(r["class"] for r in p.errors().collect()) == ["limit", "limit"]
    assert p.graphics().count() == 1
    assert parse(df.limit(0)).count() == 0


def test_structure_audits(spark):
    pdf = w.build([b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[]/K 1/K 2>>", b"1"])
    s = Structure(parse_structure(spark.createDataFrame([(1, bytearray(pdf))], "doc_id bigint, content binary")))
    assert [r.dict_key for r in s.duplicate_keys().collect()] == ["K"]
    assert [r.num for r in s.orphans().collect()] == [3]


def test_geometry(spark):
    m = F.array(*map(F.lit, (2.0, 0.0, 0.0, 3.0, 10.0, 20.0)))
    row = spark.range(1).select(geo.product(F.array(m, geo.translate(20.0, 30.0))).alias("m"), geo.pdf_number(F.lit("1e3")).alias("a"), geo.pdf_number(F.lit("-.5")).alias("b"), geo.pdf_hex(F.lit("61 6")).alias("h")).first()
    assert row.m == [2, 0, 0, 3, 50, 110] and row.a is None and row.b == -0.5 and bytes(row.h) == b"a`"
