"""What lets the queries of findings run on large tables: plans without joins that broadcast, one pass of the kernel, few calls a document."""

import sys

import pytest

from quire.operators.structure import Structure
from quire.options import FULL, GRAPHICS, LAYOUT, TEXT, ParseOptions
from quire.plans.queries import queries, references
from quire.sources import writer as w
from quire.sources.reader import parse_structure

SF = "/root/testdata/sf0.001"
CATALOG = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[]/Count 0>>"]


@pytest.mark.parametrize("name, steps", [("resolve_strict", 3), ("xref_free_null", 3), ("ref_chain", 3), ("header_and_regions", 4), ("errors_partial", 2), ("limits_kept", 2), ("detail_checks", 4), ("selection_checks", 6)])
def test_one_pass_and_no_broadcast(spark, name, steps):
    """Python steps of the plan: building, reading and following, once each for every reading that the query asks for."""
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert plan.count("MapInArrow") == steps


def test_references_of_a_table_equal_those_of_a_column(spark):
    pdf = w.update(w.build([*CATALOG, b"7", b"4 0 R"]), {}, (3,))
    s = Structure(parse_structure(spark.createDataFrame([(1, pdf), (2, w.build(CATALOG)), (3, b"junk")], "doc_id long, content binary")))
    asked = spark.createDataFrame([(d, n, g) for d in (1, 2, 3) for n, g in ((2, 0), (3, 0), (4, 0), (4, 2), (9, 0))], "doc_id long, ref_num long, ref_gen int")
    column = references((2, 0), (3, 0), (4, 0), (4, 2), (9, 0))
    for strict in (False, True):
        found = [sorted(map(str, s.resolve(x, strict).collect())) for x in (asked, column)]
        assert found[0] == found[1] and len(found[0]) == 15
    assert sorted(map(str, s.chains(asked).collect())) == sorted(map(str, s.chains(column).collect()))
    assert "Broadcast" not in s.resolve(asked)._jdf.queryExecution().executedPlan().toString()


def _calls(f) -> int:
    """Function calls that f makes: the kernel's work, however fast the machine is."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    f()
    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def test_calls_a_document():
    from quire.kernel.rows import interpret, structure

    drawn = w.pages([b"\n".join([b"q 1 J 0.9 w 1 0 0 RG 0 0 m 5 5 l S Q"] * 4)])
    assert _calls(lambda: interpret(drawn, ParseOptions(GRAPHICS, LAYOUT).checked())) < 2300
    tree = w.build([CATALOG[0], b"<</Type/Pages/MediaBox[0 0 9 9]/Resources<<>>/CropBox 5 0 R/Kids 4 0 R>>", b"<</Type/Page/UserUnit 6 0 R>>", b"[3 0 R]", b"[0 0 2 1]", b"2.5"])
    assert _calls(lambda: structure(tree, ParseOptions().checked())) < 1150


def test_lines_inside_pages_equal_those_of_a_glyph_table(spark):
    """Shuffled, overlapping, turned and spaced texts, at both ends of a page; no shuffle of glyphs."""
    from quire.operators.elements import Parsed, layout
    from quire.options import FULL, TEXT
    from quire.sources.reader import parse

    turned = b"BT /F 10 Tf (late) Tj 0 1 -1 0 50 50 Tm (up) Tj 1 0 0 1 0 20 Tm ( a  b ) Tj 1 0 0 1 0 20 Tm (over) Tj 1 0 0 1 90 20.4 Tm (far) Tj 1 0 0 1 -30 20 Tm () Tj (x) Tj ET"
    docs = spark.createDataFrame([(1, w.pages([turned, b"", b"BT /F 1 Tf ( ) Tj 9 0 Td (y) Tj ET"])), (2, w.pages([b"0 0 1 1 re f"])), (3, b"junk")], "doc_id long, content binary")
    p = Parsed(parse(docs, TEXT, FULL))
    lines = p.layout()
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, layout(p.glyphs()).select("doc_id", "page", "y", "line").collect()))
    assert lines.columns == ["doc_id", "page", "y", "line"] and lines.count() > 4
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert Parsed(parse(docs, TEXT)).layout().count() == 0


def test_documents_go_without_the_collector():
    import gc
    import weakref

    from quire.kernel import rows
    from quire.kernel.document import Document

    seen = []

    class Watched(Document):
        def __init__(self, *a):
            super().__init__(*a)
            seen.append(weakref.ref(self))

    gc.disable()
    keep, rows.Document = rows.Document, Watched
    try:
        for pdf in (w.pages([b"BT /F 9 Tf (a) Tj ET"]), w.pages([b"q Q Q"]), b"junk"):
            rows.interpret(pdf, ParseOptions(15, 2).checked())
            rows.structure(pdf, ParseOptions().checked())
    finally:
        rows.Document = keep
        gc.enable()
    assert len(seen) == 6 and not any(x() for x in seen)


def test_page_tree_of_files_equals_that_of_rows(spark):
    """One step, nothing but pages' rows sent back, and only the objects on the way read; odd attributes are error rows in both."""
    from quire.kernel import document
    from quire.kernel.rows import page_tree
    from quire.sources.reader import parse_page_tree

    top = b"<</Type/Pages/MediaBox[0 0 9 9]/CropBox 5 0 R/Resources<<>>%s>>"
    page = b"<</Type/Page/UserUnit 6 0 R%s>>"
    rest = [b"[3 0 R]", b"[0 0 2 1]", b"2.5", b"(never asked for)"]
    files = [w.build([CATALOG[0], top % kids, page % own, *rest]) for kids, own in (
        (b"/Kids 4 0 R", b""), (b"/Kids[2 0 R]", b""), (b"/Kids[]/Kids[]", b""), (b"/Kids[3 0 R 9 0 R]", b""), (b"/Kids[<</Type/Page>> 3 0 R]", b"/Resources 3 0 R"),
        (b"/Kids 4 0 R", b"/Rotate -450"), (b"/Kids 4 0 R", b"/Rotate/X"), (b"/Kids 4 0 R", b"/CropBox[0 0 8 0 R 1]"), (b"/Kids 4 0 R", b"/Type/Page"), (b"/Kids[3 0 R 3 0 R]", b""))]
    files += [w.build_stream([CATALOG[0], b"(x)"], {3: b"<</Type/Page/MediaBox[0 0 1 1]>>", 2: b"<</Type/Pages/Kids[3 0 R]>>"}), w.build([b"[1 2]"]), b"junk", files[0][:-30], files[0] + b" ", None]
    docs = spark.createDataFrame(list(enumerate(files)), "doc_id long, content binary")
    found = parse_page_tree(docs)
    rows = Structure(parse_structure(docs)).page_tree()
    assert found.schema == rows.schema
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.collect()))
    assert {(r.page, r.error) for r in found.filter("doc_id = 6").collect()} == {(0, "expected a number")}
    assert [(r.crop_box[2], r.user_unit, r.resources) for r in found.filter("doc_id = 0").collect()] == [(2.0, 2.5, 2)]
    plan = queries()["page_tree_indirect"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Broadcast" not in plan

    asked = []
    keep, document.Document.load = document.Document.load, lambda self, num, gen=0: asked.append(num) or keep(self, num, gen)
    try:
        options = ParseOptions().checked()
        assert len(page_tree(files[0], options, 128)) == 1 and set(asked) == {1, 2, 3, 4, 5, 6}
    finally:
        document.Document.load = keep
    assert _calls(lambda: page_tree(files[0], options, 128)) < 650


def _words_pdf(content: bytes, chars: str = "abc dé\U0001f600\xa0", font=None, **more) -> bytes:
    own, cmap, _ = w.unicode_font(list(chars))
    return w.pages([content], extra=[cmap], font=font or own, **more)


def _lines_files() -> list[bytes | None]:
    """Upright words as layout_lines draws them, and what looks much like them."""
    word = b"1 0 0 1 %b %b Tm <%b> Tj\n"
    some = b"".join(word % x for x in ((b"0", b"700", b"00010002"), (b"20", b"700", b"0003"), (b"20", b"685", b"0005000600070001"), (b"60", b"685.5", b"0001"), (b"-30", b"684.5", b"0002"), (b"15", b"700", b"0002")))
    odd = [
        b"", word % (b"5", b"700", b"000200020002"), word % (b"5", b"700", b"0002") * 2, word % (b"0", b"700", b""), word % (b"25", b"700", b"00040004") + word % (b"90", b"700", b"0001"), word % (b"40", b"700", b"0008") + word % (b"90", b"700", b"0001"),
        word % (b".3", b"700", b"0001") + word % (b"9", b"-0.5", b"0001"), word % (b"3.", b"700.5", b"00010002"), word % (b"0.125", b"1234567890123", b"0001"), word % (b"0.3", b"20", b"00010003") + word % (b"8", b"20.2", b"0002"), word % (b"0", b"20", b"00090001"), word % (b"0", b"20", b"000") + word % (b"30", b"20", b"0aB"),
        b"-3 Tc " + some, b"50 Tz " + some, b"3 Ts " + some, b"9 Tw " + some, b"/F -10 Tf " + some, b"/F 0 Tf " + some, b"/F 3.3 Tf " + some, b"/X 9 Tf " + some, b"0 0 m ET q 2 0 0 2 5 5 cm BT " + some + b"ET Q BT ",
        b"2 0 0 1 0 9 Tm <00010002> Tj ", b"<0003> Tj 5 0 Td <0002> Tj T* <0001> Tj (\0\1) ' [<0001> -900 <0002>] TJ ", b"%x\n", b"1 0 0 1 9 700 Tm<0001>Tj 1 0 0 1 9 9 Tm <0001> Tjx ", b"1 0 0 1 9 Tm <0001> Tj ", b"Q ", b"ET " + some, b"1 0 0 1 9 9 Tm <00g1> Tj ", b"1 0 0 1 9 9 Tm",
    ]
    files = [_words_pdf(b"BT /F 10 Tf " + some + x + some + b" ET") for x in odd]
    files += [_words_pdf(some), _words_pdf(b"BT " + some + b"ET"), _words_pdf(b"BT /F 10 Tf " + some), w.pages([b"BT /F 10 Tf " + some + b"ET"]), b"junk", None, files[0][:-40]]
    for more in (b"/W[1[300 400]]", b"/DW 510.1", b"/DW 0", b"/DW -500"):
        own = w.unicode_font(["a"])[0].replace(b"/DW 500", more)
        files.append(_words_pdf(b"BT /F 10 Tf " + some + b" ET", font=own))
    files.append(_words_pdf(b"BT /F 10 Tf " + some + b" ET", font=w.unicode_font(["a"])[0].replace(b"Identity-H", b"Identity-V")))
    form = w.stream(b"BT /F 10 Tf " + some + b"ET", b"/Type/XObject/Subtype/Form/BBox[0 0 9 9]/Matrix[1 0 0 1 0 2]")
    files.append(_words_pdf(b"BT /F 10 Tf " + some + b"ET /Y Do /Y Do").replace(b"endobj", b"endobj", 1))
    own, cmap, _ = w.unicode_font(list("abc"))
    files.append(w.pages([b"BT /F 10 Tf " + some + b" /Y Do ET /Y Do", b"BT /F 9 Tf " + some + b"ET"], resources=b"/Font<</F 4 0 R>>/XObject<</Y 6 0 R>>", extra=[cmap, form], font=own))
    return files


def test_lines_of_files_equal_those_of_rows(spark):
    """One step that sends back lines only; the same lines within every limit, and those before an error stay."""
    from pyspark.sql import functions as F

    from quire.operators.elements import Parsed
    from quire.options import FULL, TEXT, Limits
    from quire.sources.reader import parse, parse_lines

    files = _lines_files()
    docs = spark.createDataFrame(list(enumerate(files)), "doc_id long, content binary").repartition(4).persist()
    limits = [None, *(Limits(**{k: n}) for k, ns in (("max_values", (30, 90)), ("max_objects", (9, 40)), ("max_semantic_objects", (26, 40)), ("max_token_bytes", (40,)), ("max_decoded_bytes", (300,))) for n in ns)]
    for limit in limits:
        found, rows = parse_lines(docs, limit), Parsed(parse(docs, TEXT, FULL, limit)).layout()
        assert found.columns == rows.columns and found.dtypes == rows.dtypes
        a, b = sorted(map(tuple, found.collect())), sorted(map(tuple, rows.collect()))
        assert a == b, limit
        assert limit or len(a) > 100
    for gap in (0.0, -1.0, 2.0):
        assert sorted(map(tuple, parse_lines(docs, gap=gap).collect())) == sorted(map(tuple, Parsed(parse(docs, TEXT, FULL)).layout(gap).collect()))
    docs.unpersist()
    plan = queries()["layout_lines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "glyphs" not in plan and "Broadcast" not in plan


def test_calls_a_word():
    """Words at upright places, and the characters of a font, are read many at once."""
    from quire.kernel.fonts import _plain_cmap, parse_cmap
    from quire.kernel.rows import lines
    from quire.plans.queries import _shuffled_pdf

    drawn = _shuffled_pdf({"doc_id": 1, "text": "\n".join(["a few words go on a line"] * 40)})
    assert _calls(lambda: lines(drawn, ParseOptions(TEXT, FULL).checked(), 0.5)) < 5000  # 280 words, 760 glyphs
    assert [d["line"] for d in lines(drawn, ParseOptions(TEXT, FULL).checked(), 0.5)] == ["a few words go on a line"] * 40
    data = w.unicode_font([chr(c) for c in range(33, 400)])[1].split(b"stream\n")[1].split(b"\nendstream")[0]
    assert _calls(lambda: parse_cmap(data)) < 1500
    plain = parse_cmap(data)
    assert plain == parse_cmap(data + b" % looked at closely") and len(plain.mapping) == 367
    for bad in (data + b" 1 beginbfchar <0001> <0041> endbfchar", data.replace(b"100 begin", b"99 begin", 1), data.replace(b"<0021>", b"<D83D>", 1), data.replace(b"<0021>", b"<00210041>", 1), data.replace(b"<0001>", b"<01>", 1)):
        assert _plain_cmap(bad, 65_536, 1 << 20) is None
    assert _plain_cmap(data, 366, 1 << 20) is None and _plain_cmap(data, 367, 900) is None
