"""One query per capability: PDFs are built from driver tables inside the query, parsed, and returned as flat rows.

ORACLES state the same rows in SQL straight from the tables, with no PDF involved.
"""

from __future__ import annotations

import base64
import random
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.tables import decode_filters, register
from ..operators.elements import Parsed
from ..operators.structure import Structure, bytes_of
from ..options import ALL, ANNOTATIONS, BASIC, FULL, GRAPHICS, IMAGES, LAYOUT, TEXT, Limits
from ..sources import writer as w
from ..sources.reader import parse, parse_lines, parse_structure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pdfs(df: DataFrame, make, key: str) -> DataFrame:
    """doc_id, content: make(row) of each row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for k in range(0, len(rows), 256):
                part = rows[k : k + 256]
                yield pa.RecordBatch.from_arrays([pa.array([r[key] for r in part], batch.schema.field(key).type), pa.array([make(r) for r in part], pa.binary())], ["doc_id", "content"])

    # building and parsing are CPU work on few bytes: deal rows to all cores, whatever the input's file sizes
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores, key).mapInArrow(run, f"doc_id {kind}, content binary")


def grouped(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """key, rows: the other columns as an array in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))


def references(*wanted: tuple[int, int]) -> Column:
    """The same references (number, generation) for every document."""
    return F.array(*(F.struct(F.lit(n).cast("bigint").alias("ref_num"), F.lit(g).alias("ref_gen")) for n, g in wanted))


def show(text: str, x: float = 10, y: float = 20) -> bytes:
    return b"BT /F 10 Tf 1 0 0 1 %g %g Tm %s Tj ET" % (x, y, w.literal(text.encode("latin-1")))


def hex_of(text: str, codes: dict[str, int]) -> bytes:
    return b"<" + b"".join(b"%04X" % codes[c] for c in text) + b">"


def unicode_pages(contents: list[list[bytes]] | list[bytes], chars, **more) -> bytes:
    font, cmap, _ = w.unicode_font(chars)
    return w.pages(contents, extra=[cmap], font=font, **more)


# --- text


def _nations(spark, sf_dir):
    return grouped(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name")


@query("SELECT n_regionkey AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS page, 0 AS ord, n_name AS unicode FROM nation")
def text_basic(spark, sf_dir):
    docs = pdfs(_nations(spark, sf_dir), lambda r: w.pages([show(x["n_name"]) for x in r["rows"]]), "n_regionkey")
    return Parsed(parse(docs)).texts().select("doc_id", "page", "ord", "unicode")


def _lines_pdf(r) -> bytes:
    text = r["text"] or ""
    _, _, codes = w.unicode_font(chars := sorted(set(text) - {"\n"}))
    return unicode_pages([b"BT /F 10 Tf " + b"\n".join(hex_of(x, codes) + b" Tj" for x in text.split("\n")) + b" ET"], chars, pack=w.flate)


def _document_lines(spark, sf_dir):
    return Parsed(parse(pdfs(table(spark, sf_dir, "documents").select("doc_id", "text"), _lines_pdf, "doc_id"))).texts()


@query("SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS ord, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def text_lines_unicode(spark, sf_dir):
    return _document_lines(spark, sf_dir).select("doc_id", "ord", F.col("unicode").alias("line"))


@query("SELECT doc_id, md5(text) AS digest, CAST(length(text) AS BIGINT) AS n FROM documents")
def tounicode_roundtrip(spark, sf_dir):
    lines = _document_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "unicode"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["unicode"]), "\n")
    return lines.select("doc_id", F.md5(text).alias("digest"), F.length(text).cast("bigint").alias("n"))


@query("SELECT doc_id, md5(regexp_replace(text, '[^ -~¡-¬®-ÿ]', '', 'g')) AS digest FROM documents")
def winansi_roundtrip(spark, sf_dir):
    clean = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^ -~¡-¬®-ÿ]", "").alias("text"))
    font = w.FONT[:-2] + b"/Encoding/WinAnsiEncoding>>"
    docs = pdfs(clean, lambda r: w.pages([b"BT /F 10 Tf " + w.literal((r["text"] or "").encode("cp1252")) + b" Tj ET"], font=font), "doc_id")
    return Parsed(parse(docs)).texts().select("doc_id", F.md5("unicode").alias("digest"))


@query("SELECT CAST(n_nationkey AS INT) AS doc_id, n_name AS unicode, true AS decode_complete FROM nation")
def differences(spark, sf_dir):
    def make(r):
        chars = sorted(set(r["n_name"]))
        names = b" ".join(b"/uni%04X" % ord(c) for c in chars)
        font = b"<</Type/Font/Subtype/TrueType/BaseFont/X/Encoding<</Differences[1 %s]>>>>" % names
        return w.pages([b"BT /F 1 Tf <" + b"".join(b"%02X" % (chars.index(c) + 1) for c in r["n_name"]) + b"> Tj ET"], font=font)

    return Parsed(parse(pdfs(table(spark, sf_dir, "nation"), make, "n_nationkey"))).texts().select("doc_id", "unicode", "decode_complete")


@query("SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS INT) AS page, coalesce(text, '') AS text FROM conversations")
def text_by_page(spark, sf_dir):
    turns = grouped(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")

    def make(r):
        texts = [x["text"] or "" for x in r["rows"]]
        chars = sorted(set("".join(texts)))
        codes = {c: i + 1 for i, c in enumerate(chars)}
        return unicode_pages([b"BT /F 9 Tf " + hex_of(t, codes) + b" Tj ET" for t in texts], chars)

    pages = Parsed(parse(pdfs(turns, make, "conv_id"), TEXT | GRAPHICS)).by_page()
    return pages.select("doc_id", "page", F.array_join(F.transform("texts", lambda t: t["unicode"]), "").alias("text"))


# --- layout


def _shuffled_pdf(r) -> bytes:
    """Each line's words at their places, drawn in random order; 50 lines a page."""
    lines = (r["text"] or "").split("\n")
    chars = sorted(set(r["text"] or "") - {"\n", " "})
    codes = {ord(c): i + 1 for i, c in enumerate(chars)}
    pages, rnd = [], random.Random(r["doc_id"])
    for k in range(0, len(lines), 50):
        rows = [[word for word in line.split(" ") if word] for line in lines[k : k + 50]]
        hexed = "".join(map("".join, rows)).translate(codes).encode("utf-16-be", "surrogatepass").hex().upper()
        words, at = [], 0
        for i, row in enumerate(rows):
            x, y = 0, f"{780 - 15 * i} Tm <"
            for word in row:
                n = len(word)
                words.append(f"1 0 0 1 {x} {y}{hexed[at : (at := at + 4 * n)]}> Tj")
                x += 5 * n + 10
        rnd.shuffle(words)
        pages.append(f"BT /F 10 Tf {"\n".join(words)} ET".encode())
    return unicode_pages(pages, chars, pack=w.flate)


@query("""SELECT doc_id, CAST(i AS BIGINT) AS line_no, array_to_string(list_filter(string_split(l, ' '), lambda x: x <> ''), ' ') AS line
FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
WHERE len(replace(l, ' ', '')) > 0""")
def layout_lines(spark, sf_dir):
    docs = pdfs(table(spark, sf_dir, "documents").select("doc_id", "text"), _shuffled_pdf, "doc_id")
    lines = parse_lines(docs)
    return lines.select("doc_id", (F.col("page") * 50 + F.expr("(780 - y) div 15")).cast("bigint").alias("line_no"), "line")


# --- positions and widths


@query("SELECT p_partkey AS doc_id, CAST(i AS INT) AS glyph_ord, substr(p_name, CAST(i + 1 AS INT), 1) AS unicode, CAST(10 + 5 * i AS DOUBLE) AS x, CAST(20 AS DOUBLE) AS y, CAST(5 AS DOUBLE) AS advance FROM (SELECT p_partkey, p_name, unnest(range(length(p_name))) AS i FROM part)")
def glyph_positions(spark, sf_dir):
    docs = pdfs(table(spark, sf_dir, "part"), lambda r: w.pages([show(r["p_name"])]), "p_partkey")
    return Parsed(parse(docs, TEXT, FULL)).glyphs().select("doc_id", "glyph_ord", "unicode", F.round("origin.x", 6).alias("x"), F.round("origin.y", 6).alias("y"), F.round("advance.x", 6).alias("advance"))


@query("SELECT CAST(n_nationkey AS INT) AS doc_id, CAST(i AS INT) AS glyph_ord, CAST(CASE WHEN i < 3 THEN 100 * (i + 1) WHEN i < 6 THEN 700 ELSE 1000 END AS DOUBLE) / 100 AS advance FROM nation, range(8) t(i)")
def cid_widths(spark, sf_dir):
    font = b"<</Type/Font/Subtype/Type0/BaseFont/C/Encoding/Identity-H/DescendantFonts[<</Type/Font/Subtype/CIDFontType2/W[1[100 200 300]4 6 700]>>]>>"
    content = b"BT /F 10 Tf <" + b"".join(b"%04X" % i for i in range(1, 9)) + b"> Tj ET"
    docs = pdfs(table(spark, sf_dir, "nation"), lambda r: w.pages([content], font=font), "n_nationkey")
    return Parsed(parse(docs, TEXT, FULL)).glyphs().select("doc_id", "glyph_ord", F.round("advance.x", 6).alias("advance"))


@query("SELECT CAST(r_regionkey AS INT) AS doc_id, CAST(100 * (r_regionkey + 1) AS DOUBLE) * 0.002 * 10 AS advance FROM region")
def type3_widths(spark, sf_dir):
    def make(r):
        font = b"<</Type/Font/Subtype/Type3/FontBBox[0 0 1 1]/FontMatrix[.002 0 0 .002 0 0]/FirstChar 65/LastChar 65/Widths[%d]/Encoding<</Differences[65/A]>>/CharProcs<</A 5 0 R>>>>" % (100 * (r["r_regionkey"] + 1))
        return w.pages([b"BT /F 10 Tf (A) Tj ET"], font=font, extra=[w.stream(b"%d 0 d0" % (100 * (r["r_regionkey"] + 1)))])

    return Parsed(parse(pdfs(table(spark, sf_dir, "region"), make, "r_regionkey"), TEXT, FULL)).glyphs().select("doc_id", F.round("advance.x", 6).alias("advance"))


@query("SELECT CAST(n_nationkey AS INT) AS doc_id, CAST(15 - n_nationkey * 0.1 AS DOUBLE) AS x FROM nation")
def tj_kerning(spark, sf_dir):
    docs = pdfs(table(spark, sf_dir, "nation"), lambda r: w.pages([b"BT /F 10 Tf 10 20 Td [(A) %d (A)] TJ ET" % (r["n_nationkey"] * 10)]), "n_nationkey")
    return Parsed(parse(docs, TEXT, FULL)).glyphs().filter("glyph_ord = 1").select("doc_id", F.round("origin.x", 6).alias("x"))


# --- graphics


def _line_docs(spark, sf_dir, draw) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_discount"))
    return pdfs(grouped(items, "l_orderkey", "l_linenumber", "q", "l_discount"), lambda r: w.pages([b"\n".join(draw(x) for x in r["rows"])]), "l_orderkey")


_NTH = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INT), l_discount) - 1 AS INT)"


@query(f"SELECT l_orderkey AS doc_id, {_NTH} AS ord, CAST(l_quantity AS INT) + CAST(l_linenumber AS DOUBLE) AS x, CAST(2 * CAST(l_quantity AS INT) AS DOUBLE) AS y FROM lineitem")
def ctm_product(spark, sf_dir):
    docs = _line_docs(spark, sf_dir, lambda x: b"q %d 0 0 %d %d 0 cm 1 0 0 1 1 2 cm 0 0 m 1 1 l S Q" % (x["q"], x["q"], x["l_linenumber"]))
    first = F.col("segments")[0]["points"][0]
    return Parsed(parse(docs, GRAPHICS, BASIC)).graphics().select("doc_id", "ord", first["x"].alias("x"), first["y"].alias("y"))


@query(f"SELECT l_orderkey AS doc_id, {_NTH} AS ord, CAST(l_linenumber % 3 AS INT) AS line_cap, CAST(l_quantity AS INT) / 10.0 :: DOUBLE AS line_width, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 'DeviceRGB' ELSE 'DeviceGray' END AS VARCHAR) AS space, l_linenumber % 2 = 1 AS clipped FROM lineitem")
def line_style(spark, sf_dir):
    def draw(x):
        extra = b"1 0 0 RG" if x["l_linenumber"] % 2 == 0 else b"0 0 9 9 re W n"
        return b"q %d J %.1f w %s 0 0 m 5 5 l S Q" % (x["l_linenumber"] % 3, x["q"] / 10, extra)

    return Parsed(parse(_line_docs(spark, sf_dir, draw), GRAPHICS, LAYOUT)).graphics().select("doc_id", "ord", "style.line_cap", "style.line_width", "style.stroke.space", "style.clipped")


_PAINTS = ["S", "f*", "B", "b*", "s"]


@query("""SELECT o_orderkey AS doc_id, p AS paint, p NOT IN ('f*') AS stroke, p NOT IN ('S', 's') AS fill, ends_with(p, '*') AS even_odd, CAST(CASE WHEN p IN ('s', 'b*') THEN 3 ELSE 2 END AS INT) AS n_segments
FROM (SELECT o_orderkey, ['S', 'f*', 'B', 'b*', 's'][CAST(o_orderkey % 5 AS INT) + 1] AS p FROM orders)""")
def paint_flags(spark, sf_dir):
    docs = pdfs(table(spark, sf_dir, "orders").select("o_orderkey"), lambda r: w.pages([b"0 0 m 10 10 l " + _PAINTS[r["o_orderkey"] % 5].encode()]), "o_orderkey")
    return Parsed(parse(docs, GRAPHICS)).graphics().select("doc_id", "paint", "stroke", "fill", "even_odd", F.size("segments").alias("n_segments"))


@query("SELECT p_partkey AS doc_id, CAST(p_size AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, CAST(2 * p_size AS DOUBLE) AS x1, CAST(p_size AS DOUBLE) AS y1, CAST(4 AS INT) AS n_points FROM part")
def paths(spark, sf_dir):
    docs = pdfs(table(spark, sf_dir, "part").select("p_partkey", "p_size"), lambda r: w.pages([b"%d 0 %d %d re f" % ((r["p_size"],) * 3)]), "p_partkey")
    points = Parsed(parse(docs, GRAPHICS)).graphics().select("doc_id", F.col("segments")[0]["points"].alias("p"))
    return points.select("doc_id", F.col("p")[0]["x"].alias("x0"), F.col("p")[0]["y"].alias("y0"), F.col("p")[2]["x"].alias("x1"), F.col("p")[2]["y"].alias("y1"), F.size("p").alias("n_points"))


@query("SELECT CAST(n_nationkey AS INT) AS doc_id, CAST(n_nationkey AS DOUBLE) / 100 AS fill_alpha, CAST(1 AS DOUBLE) AS stroke_alpha, 'Multiply' AS blend_mode, CAST(3 AS DOUBLE) AS line_width FROM nation")
def extgstate(spark, sf_dir):
    docs = pdfs(table(spark, sf_dir, "nation"), lambda r: w.pages([b"/G gs 0 0 5 5 re f"], resources=b"/ExtGState<</G<</ca %.2f/BM/Multiply/LW 3/LC null>>>>" % (r["n_nationkey"] / 100)), "n_nationkey")
    return Parsed(parse(docs, GRAPHICS, LAYOUT)).graphics().select("doc_id", "style.fill_alpha", "style.stroke_alpha", "style.blend_mode", "style.line_width")


@query("SELECT CAST(n_nationkey AS INT) AS doc_id, CAST(i AS INT) AS ord, n_name AS unicode, CAST(7 + 10 * i AS DOUBLE) AS x FROM nation, range(6) t(i) WHERE i <= n_regionkey")
def form_reuse(spark, sf_dir):
    def make(r):
        form = w.stream(b"BT /F 1 Tf 7 8 Td " + w.literal(r["n_name"].encode()) + b" Tj ET", b"/Type/XObject/Subtype/Form/BBox[0 0 9 9]")
        return w.pages([b"\n".join(b"q 1 0 0 1 %d 0 cm /X Do Q" % (10 * i) for i in range(r["n_regionkey"] + 1))], resources=b"/Font<</F 4 0 R>>/XObject<</X 5 0 R>>", extra=[form])

    return Parsed(parse(pdfs(table(spark, sf_dir, "nation"), make, "n_nationkey"), TEXT, LAYOUT)).texts().select("doc_id", "ord", "unicode", F.col("matrix")[4].alias("x"))


# --- images and annotations


@query("SELECT p_partkey AS doc_id, CAST(i AS INT) AS ord, CAST(0 AS INT) AS resource, p_size AS width, CAST(2 AS INT) AS height, CAST(10 * (i + 1) AS DOUBLE) AS x1, CAST(p_size AS DOUBLE) AS y1 FROM part, range(2) t(i)")
def image_placements(spark, sf_dir):
    def make(r):
        image = w.stream(b"\0" * (2 * r["p_size"]), b"/Type/XObject/Subtype/Image/Width %d/Height 2/BitsPerComponent 8/ColorSpace/DeviceGray" % r["p_size"])
        return w.pages([b"\n".join(b"q 10 0 0 %d %d 0 cm /I Do Q" % (r["p_size"], 10 * i) for i in range(2))], resources=b"/XObject<</I 5 0 R>>", extra=[image])

    p = Parsed(parse(pdfs(table(spark, sf_dir, "part").select("p_partkey", "p_size"), make, "p_partkey"), IMAGES, LAYOUT))
    placed = p.images().withColumn("b", geo.placement_box(F.col("matrix")))
    known = p.image_resources().select("doc_id", F.col("index").alias("resource"), "width", "height")
    return placed.join(known, ["doc_id", "resource"]).select("doc_id", "ord", "resource", "width", "height", F.col("b.x1").alias("x1"), F.col("b.y1").alias("y1"))


@query("SELECT p_partkey AS doc_id, p_size AS width, CAST(2 AS INT) AS height, CAST(ceil(p_size / 8.0) * 2 AS BIGINT) AS n_bytes, true AS text_follows FROM part")
def inline_images(spark, sf_dir):
    def make(r):
        n = -(-r["p_size"] // 8) * 2
        return w.pages([b"BI /W %d /H 2 /BPC 1 /CS /G ID " % r["p_size"] + (b" EI " * n)[:n] + b"\nEI\n" + show("after")])

    p = Parsed(parse(pdfs(table(spark, sf_dir, "part").select("p_partkey", "p_size"), make, "p_partkey"), IMAGES | TEXT))
    n_bytes = geo.inline_size(F.col("width"), F.col("height"), F.lit(1), F.lit(1))
    after = p.texts().filter("unicode = 'after'").select("doc_id", F.lit(True).alias("text_follows"))
    return p.image_resources().join(after, "doc_id", "left").select("doc_id", "width", "height", n_bytes.alias("n_bytes"), F.coalesce("text_follows", F.lit(False)).alias("text_follows"))


@query("SELECT s_nationkey AS doc_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS ord, CASE WHEN s_suppkey % 2 = 0 THEN 'Link' ELSE 'Text' END AS subtype, CAST(0 AS DOUBLE) AS x0, CAST(s_suppkey AS DOUBLE) AS x1 FROM supplier")
def annotations(spark, sf_dir):
    def make(r):
        notes = [b"<</Type/Annot/Subtype/%s/Rect[%d 9 0 5]>>" % (b"Link" if x["s_suppkey"] % 2 == 0 else b"Text", x["s_suppkey"]) for x in r["rows"]]
        return w.pages([b""], page=b"/Annots[" + b" ".join(b"%d 0 R" % (5 + i) for i in range(len(notes))) + b"]", extra=notes)

    docs = pdfs(grouped(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey"), make, "s_nationkey")
    return Parsed(parse(docs, ANNOTATIONS)).annotations().select("doc_id", "ord", "subtype", "rect.x0", "rect.x1")


# --- filters


def _filtered(spark, sf_dir, encode, names: bytes) -> DataFrame:
    docs = pdfs(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda r: w.pages([b""], extra=[w.stream(encode((r["text"] or "").encode()), b"/Filter" + names)]), "doc_id")
    objects = parse_structure(docs, keep_data=True).select("doc_id", F.explode("sources").alias("s"), "objects")
    payload = F.get(F.filter("objects", lambda o: o["num"] == 5), F.lit(0))["payload"]
    own = objects.filter((F.get("s.inputs", F.lit(0))["start"] == payload["start"]) & (F.col("s.origin") == "decoded"))
    return own.select("doc_id", F.md5("s.data").alias("digest"), F.col("s.size").alias("n_bytes"))


def _runs(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100)) + b"\x80"


_DIGEST = "SELECT doc_id, md5(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents"
for _name, _encode, _filter in (
    ("filter_flate", zlib.compress, b"/FlateDecode"),
    ("filter_ahx", lambda b: b.hex().encode() + b">", b"/AHx"),
    ("filter_a85", lambda b: base64.a85encode(b) + b"~>", b"/ASCII85Decode"),
    ("filter_rl", _runs, b"/RunLengthDecode"),
    ("filter_chain", lambda b: zlib.compress(b).hex().encode() + b">", b"[/ASCIIHexDecode/FlateDecode]"),
):
    QUERIES[_name] = lambda spark, sf_dir, e=_encode, n=_filter: _filtered(spark, sf_dir, e, n)
    ORACLES[_name] = _DIGEST


def _predicted(spark, sf_dir, encode, chain: Column) -> DataFrame:
    items = grouped(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q")), "l_orderkey", "l_linenumber", "q")
    docs = pdfs(items, lambda r: zlib.compress(encode(bytes(x["q"] for x in r["rows"]))), "l_orderkey").join(items.select(F.col("l_orderkey").alias("doc_id"), F.size("rows").alias("n")), "doc_id")
    data = docs.select("doc_id", "n", F.pandas_udf(decode_filters, "binary")("content", F.array(chain)).alias("d"))
    values = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.conv(F.hex(F.substring("d", i, F.lit(1))), 16, 10).cast("bigint"))
    return data.select("doc_id", F.octet_length("d").alias("n"), F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a * 3 + x).alias("mix"))


_MIX = "SELECT l_orderkey AS doc_id, CAST(count(*) AS INT) AS n, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(CAST(l_quantity AS INT) AS BIGINT) ORDER BY l_linenumber, CAST(l_quantity AS INT))), lambda a, x: a * 3 + x) AS BIGINT) AS mix FROM lineitem GROUP BY l_orderkey"


def _sub(data: bytes, step: int = 1) -> bytes:
    return bytes((b - (data[i - step] if i >= step else 0)) & 255 for i, b in enumerate(data))


@query(_MIX)
def predictor_png(spark, sf_dir):
    return _predicted(spark, sf_dir, lambda d: b"".join(b"\x02" + bytes([(b - (d[i - 1] if i else 0)) & 255]) for i, b in enumerate(d)), F.lit("FlateDecode:15,1,8,1"))


@query(_MIX)
def predictor_tiff(spark, sf_dir):
    return _predicted(spark, sf_dir, _sub, F.concat(F.lit("FlateDecode:2,1,8,"), F.col("n").cast("string")))


# --- file structure


@query("SELECT user_id AS doc_id, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS event_id, count(*) AS n_revisions FROM events GROUP BY user_id")
def xref_latest(spark, sf_dir):
    def make(r):
        out = w.pages([b""], extra=[b"0"])
        for x in r["rows"]:
            out = w.update(out, {5: b"%d" % x["event_id"]})
        return out

    docs = pdfs(grouped(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id"), make, "user_id")
    s = Structure(parse_structure(docs, Limits(max_xref_sections=1_000_000)))
    newest = s.nodes().filter("num = 5 AND parent_id IS NULL").select("doc_id", F.col("lexeme").cast("bigint").alias("event_id"))
    revisions = s.records().filter("num = 5").groupBy("doc_id").agg((F.count("*") - 1).alias("n_revisions"))
    return newest.join(revisions, "doc_id")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(round(o_totalprice) AS BIGINT) END AS price, CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE 'integer' END AS kind FROM orders")
def xref_free_null(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice").cast("bigint").alias("price"))

    def make(r):
        out = w.build([b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[]/Count 0>>", b"%d" % r["price"]])
        return w.update(out, {}, (3,)) if r["o_orderstatus"] == "F" else out

    docs = pdfs(orders, make, "o_orderkey")
    return Structure(parse_structure(docs)).resolve(references((3, 0))).select("doc_id", F.col("lexeme").cast("bigint").alias("price"), "kind")


@query("SELECT p_brand AS doc_id, p_partkey, p_name, 'object_stream' AS origin FROM part")
def xref_stream_objstm(spark, sf_dir):
    def make(r):
        packed = {3 + i: b"<</K %d/N%s>>" % (x["p_partkey"], w.literal(x["p_name"].encode())) for i, x in enumerate(r["rows"])}
        return w.build_stream([b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[]/Count 0>>"], packed)

    s = Structure(parse_structure(pdfs(grouped(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_name"), make, "p_brand")))
    pair = s.nodes().filter("depth = 1 AND dict_key IN ('K', 'N')").groupBy("doc_id", "num").agg(F.max(F.when(F.col("dict_key") == "K", F.col("lexeme"))).cast("bigint").alias("p_partkey"), F.max(F.when((F.col("dict_key") == "N") & (F.col("kind") == "string"), F.decode("bytes", "ISO-8859-1"))).alias("p_name"))
    return pair.join(s.objects().filter("origin = 'object_stream'").select("doc_id", "num", "origin"), ["doc_id", "num"]).select("doc_id", "p_partkey", "p_name", "origin")


@query("SELECT o_orderkey AS doc_id, CAST(least(n, 4) AS INT) AS hops, CASE WHEN n <= 3 THEN '42' END AS lexeme, CASE WHEN n > 3 THEN 'limit' END AS error FROM (SELECT o_orderkey, o_orderkey % 5 + 1 AS n FROM orders)")
def ref_chain(spark, sf_dir):
    def make(r):
        n = r["o_orderkey"] % 5 + 1
        return w.build([b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[]/Count 0>>", *(b"%d 0 R" % (4 + i) for i in range(n - 1)), b"42"])

    docs = pdfs(table(spark, sf_dir, "orders").select("o_orderkey"), make, "o_orderkey")
    return Structure(parse_structure(docs)).chains(references((3, 0)), depth=3).select("doc_id", "hops", "lexeme", "error")


def _tree_docs(spark, sf_dir):
    pairs = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    nested = grouped(grouped(pairs, "n_nationkey", "s_suppkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey"), "n_regionkey", "n_nationkey", "rows")

    def make(r):
        objects, kids = [b"<</Type/Catalog/Pages 2 0 R>>", b""], []
        for n in r["rows"]:
            me = len(objects) + 1
            own = b"/Rotate %d" % (90 * (n["n_nationkey"] % 4)) if n["n_nationkey"] % 2 else b"/Rotate null"
            pages = [me + 1 + i for i in range(len(n["rows"]))]
            objects.append(b"<</Type/Pages%s/Kids[%s]>>" % (own, b" ".join(b"%d 0 R" % p for p in pages)))
            objects += [b"<</Type/Page/MediaBox[%d 5 0 0]>>" % x["s_suppkey"] if x["s_suppkey"] % 2 else b"<</Type/Page>>" for x in n["rows"]]
            kids.append(b"%d 0 R" % me)
        objects[1] = b"<</Type/Pages/Rotate -450/MediaBox[0 0 7 9]/Kids[%s]>>" % b" ".join(kids)
        return w.build(objects)

    return pdfs(nested, make, "n_regionkey")


_TREE = "FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_PAGE = "CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, s_suppkey) - 1 AS INT)"


@query(f"SELECT n_regionkey AS doc_id, {_PAGE} AS page, CAST(CASE WHEN n_nationkey % 2 = 1 THEN 90 * (n_nationkey % 4) ELSE -90 END AS INT) AS rotate, CAST(CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey ELSE 7 END AS DOUBLE) AS x1 {_TREE}")
def page_inherit(spark, sf_dir):
    return Parsed(parse(_tree_docs(spark, sf_dir))).pages().select("doc_id", "page", "rotate", "media_box.x1")


@query(f"SELECT n_regionkey AS doc_id, {_PAGE} AS page, CAST(CASE WHEN n_nationkey % 2 = 1 THEN 90 * (n_nationkey % 4) ELSE -90 END AS INT) AS rotate, CAST(CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey ELSE 7 END AS DOUBLE) AS x1 {_TREE}")
def page_tree_sql(spark, sf_dir):
    tree = Structure(parse_structure(_tree_docs(spark, sf_dir))).page_tree()
    return tree.filter("error IS NULL").select("doc_id", "page", "rotate", F.greatest(F.col("media_box")[0], F.col("media_box")[2]).alias("x1"))


@query("SELECT CAST(r_regionkey AS INT) AS doc_id, true AS covered, true AS disjoint FROM region")
def regions_cover(spark, sf_dir):
    docs = pdfs(table(spark, sf_dir, "region"), lambda r: w.pages([show(r["r_name"])]), "r_regionkey")
    s = parse_structure(docs)
    regions = Structure(s).regions()
    total = regions.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.max("end").alias("last"), F.count_distinct("start").alias("starts"), F.count("*").alias("rows"))
    return total.join(s.select("doc_id", "length"), "doc_id").select("doc_id", ((F.col("n") == F.col("length")) & (F.col("last") == F.col("length"))).alias("covered"), (F.col("starts") == F.col("rows")).alias("disjoint"))


@query("SELECT CAST(r_regionkey AS INT) AS doc_id, CAST(n AS BIGINT) AS num, true AS same FROM region, unnest([1, 2, 3, 4, 5, 6]) t(n)")
def provenance_bytes(spark, sf_dir):
    docs = pdfs(table(spark, sf_dir, "region"), lambda r: w.pages([show(r["r_name"])]), "r_regionkey")
    spans = bytes_of(Structure(parse_structure(docs)).objects().select("doc_id", "num", "start", "end"), docs)
    text = F.decode("bytes", "ISO-8859-1")
    return spans.select("doc_id", "num", (text.startswith(F.concat(F.col("num").cast("string"), F.lit(" 0 obj"))) & text.endswith("endobj")).alias("same"))


@query("SELECT CAST(r_regionkey AS INT) AS doc_id, true AS encrypted, CAST(0 AS BIGINT) AS pages, 'unsupported' AS class FROM region")
def encrypted(spark, sf_dir):
    docs = pdfs(table(spark, sf_dir, "region"), lambda r: w.pages([show(r["r_name"])], trailer=b"/Encrypt<</Filter/Standard>>"), "r_regionkey")
    p = Parsed(parse(docs))
    return p.files().select("doc_id", "encrypted").join(p.summary().select("doc_id", "pages"), "doc_id").join(p.errors().select("doc_id", "class"), "doc_id")


# --- diagnostics, errors, selection, reports


@query("SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS graphics, o_orderstatus = 'O' AS complete, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS diagnostics, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'malformed' END AS class FROM orders")
def errors_partial(spark, sf_dir):
    bad = {"O": b"", "F": b" 1 i"}
    docs = pdfs(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lambda r: w.pages([b"0 0 5 5 re f" + bad.get(r["o_orderstatus"], b" (unterminated")]), "o_orderkey")
    return Parsed(parse(docs, GRAPHICS)).page_outcomes().select("doc_id", "graphics", "complete", "diagnostics", "class")


@query("SELECT CAST(m AS INT) AS mask, CAST(d AS INT) AS detail, CAST(25 * (m & 1) AS BIGINT) AS texts, CAST(25 * ((m >> 1) & 1) AS BIGINT) AS graphics, CAST(25 * ((m >> 2) & 1) AS BIGINT) AS images, CAST(25 * ((m >> 3) & 1) AS BIGINT) AS annotations FROM range(1, 16) t(m), range(3) u(d)")
def content_selection(spark, sf_dir):
    extra = [w.stream(b"\0", b"/Type/XObject/Subtype/Image/Width 1/Height 1/BitsPerComponent 8/ColorSpace/DeviceGray"), b"<</Type/Annot/Subtype/Text>>"]
    docs = pdfs(table(spark, sf_dir, "nation").coalesce(1), lambda r: w.pages([show(r["n_name"]) + b" 0 0 5 5 re f /I Do"], resources=b"/Font<</F 4 0 R>>/XObject<</I 5 0 R>>", page=b"/Annots[6 0 R]", extra=extra), "n_nationkey")
    out = None
    for mask in range(1, ALL + 1):
        for detail in (BASIC, LAYOUT, FULL):
            n = Parsed(parse(docs, mask, detail)).page_counts().agg(*(F.sum(c).alias(c) for c in ("texts", "graphics", "images", "annotations")))
            n = n.select(F.lit(mask).alias("mask"), F.lit(detail).alias("detail"), "*")
            out = n if out is None else out.union(n)
    return out


def _report_docs(spark, sf_dir):
    return pdfs(_nations(spark, sf_dir), lambda r: w.pages([show(x["n_name"]) + b" 0 0 5 5 re f" * (x["n_nationkey"] % 3) for x in r["rows"]]), "n_regionkey")


@query("SELECT n_regionkey AS doc_id, count(*) AS pages, count(*) AS texts, CAST(sum(n_nationkey % 3) AS BIGINT) AS graphics, CAST(1 AS BIGINT) AS fonts, CAST(0 AS BIGINT) AS diagnostics FROM nation GROUP BY n_regionkey")
def doc_summary(spark, sf_dir):
    return Parsed(parse(_report_docs(spark, sf_dir), TEXT | GRAPHICS)).summary().select("doc_id", "pages", "texts", "graphics", "fonts", "diagnostics")


@query("SELECT n_regionkey AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS page, true AS complete, CAST(1 AS BIGINT) AS texts, CAST(n_nationkey % 3 AS BIGINT) AS graphics FROM nation")
def page_summary(spark, sf_dir):
    return Parsed(parse(_report_docs(spark, sf_dir), TEXT | GRAPHICS)).page_counts().select("doc_id", "page", "complete", "texts", "graphics")


@query("SELECT n_regionkey AS doc_id, string_agg(n_name || chr(10), chr(12) || chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def plain_text(spark, sf_dir):
    return Parsed(parse(_report_docs(spark, sf_dir))).plain_text()


@query("SELECT l_orderkey AS doc_id, CAST(0 AS BIGINT) AS nesting, CAST(3 * count(*) AS BIGINT) AS n_ops FROM lineitem GROUP BY l_orderkey")
def operation_depth(spark, sf_dir):
    from ..operators.elements import running_depth

    ops = running_depth(Parsed(parse(_line_docs(spark, sf_dir, lambda x: b"q q n Q Q"), GRAPHICS, FULL)).operations())
    return ops.groupBy("doc_id").agg(F.max_by("nesting", "ord").cast("bigint").alias("nesting"), F.sum(F.when(F.col("operator").isin("q", "n"), 1)).cast("bigint").alias("n_ops"))


# --- table functions


@query("SELECT p_partkey, CAST(3 AS BIGINT) AS n_tokens, p_name AS inside FROM part")
def lex_tokens(spark, sf_dir):
    register(spark)
    table(spark, sf_dir, "part").select("p_partkey", F.encode(F.concat(F.lit("/N ("), F.col("p_name"), F.lit(")")), "ISO-8859-1").alias("b")).createOrReplaceTempView("_quire_literals")
    return spark.sql("""SELECT p_partkey, count(CASE WHEN kind <> 'eof' THEN 1 END) AS n_tokens,
        max(CASE WHEN kind = 'literal_string' THEN substring(decode(bytes, 'ISO-8859-1'), 2, length(bytes) - 2) END) AS inside
        FROM _quire_literals, LATERAL pdf_lex(b, 0) GROUP BY p_partkey""")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS size, p_name AS name, CAST(4 AS BIGINT) AS n_nodes FROM part")
def parse_object(spark, sf_dir):
    register(spark)
    table(spark, sf_dir, "part").select("p_partkey", F.encode(F.concat(F.lit("<</S["), F.col("p_size").cast("string"), F.lit("]/N("), F.col("p_name"), F.lit(")>>")), "ISO-8859-1").alias("b")).createOrReplaceTempView("_quire_values")
    return spark.sql("""SELECT p_partkey, max(CASE WHEN kind = 'integer' THEN CAST(lexeme AS BIGINT) END) AS size,
        max(CASE WHEN kind = 'string' THEN decode(bytes, 'ISO-8859-1') END) AS name, count(*) AS n_nodes
        FROM _quire_values, LATERAL pdf_parse_object(b, 0) GROUP BY p_partkey""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import edge_queries  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import edge_queries  # noqa: F401

    return dict(ORACLES)


__all__ = ["queries", "oracle_sql", "layout_lines"]
