import zlib

import pytest

from quire.kernel import filters
from quire.kernel.document import Document
from quire.kernel.errors import LimitError, PdfError, UnsupportedError
from quire.kernel.fonts import parse_cmap
from quire.kernel.glyphs import glyph_text, read_glyph_list
from quire.kernel.rows import interpret, structure
from quire.kernel.syntax import Obj
from quire.options import ALL, ANNOTATIONS, FULL, GRAPHICS, LAYOUT, TEXT, Limits, ParseOptions
from quire.sources import writer as w


def run(pdf, content=ALL, detail=FULL, **limits):
    return interpret(pdf, ParseOptions(content, detail, Limits(**limits)).checked())


def page(content, **more):
    return run(w.pages([content], **more))["pages"][0]


def test_filters():
    assert filters.decode(b"ASCIIHexDecode", b"61 62 6>", 99) == b"ab`"
    assert filters.decode(b"A85", b"BOu!rDZ~>", 99) == b"hello"
    assert filters.decode(b"RL", bytes.fromhex("02616263FE7880"), 99) == b"abcxxx"
    with pytest.raises(UnsupportedError):
        filters.decode(b"UnknownDecode", b"", 9)
    with pytest.raises(LimitError):
        filters.decode(b"Fl", zlib.compress(b"x" * 100), 10)
    assert filters.unpredict(bytes.fromhex("010A0A0A02050505"), 15, columns=3) == bytes([10, 20, 30, 15, 25, 35])
    assert filters.unpredict(b"\x01\x0a", 15) == b"\x0a"
    assert filters.unpredict(bytes([1, 2, 3, 4]), 2, columns=4) == bytes([1, 3, 6, 10])
    for bad in (b"61", b"6x>"):
        with pytest.raises(PdfError):
            filters.decode(b"AHx", bad, 99)


def test_to_unicode():
    c = parse_cmap(b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <AC00> endbfchar 2 beginbfrange <02> <03> <AC01> <10> <11> [<D55C> <AE00>] endbfrange")
    assert "".join(u for _, u, _ in c.split(bytes([1, 2, 3, 0x10, 0x11, 255]))) == "가각갂한글�"
    c = parse_cmap(b"2 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 2 beginbfchar <41> <0041> <8001> <D83DDE00> endbfchar")
    assert [u for _, u, _ in c.split(b"A\x80\x01")] == ["A", "😀"]
    for bad in (b"1 beginbfchar <01> <D800> endbfchar", b"1 beginbfchar <01> endbfchar", b"1 beginbfrange <01> <02> <FFFF> endbfrange", b"1 begincodespacerange <00> <01> endcodespacerange 1 beginbfchar <05> <0041> endbfchar", b"/X usecmap"):
        with pytest.raises(PdfError):
            parse_cmap(bad)
    with pytest.raises(LimitError):
        parse_cmap(b"1 beginbfrange <0000> <00FF> <0041> endbfrange", entries=10)


@pytest.mark.parametrize("name, text", [("fi", "ﬁ"), ("Delta", "∆"), ("Euro", "€"), ("uni20AC", "€"), ("u1D504", "𝔄"), ("notaglyph", None), ("eacute", "é"), ("A", "A")])
def test_glyph_names(name, text):
    assert glyph_text(name) == text


@pytest.mark.parametrize(
    "name, text",
    [("Abreveacute", "Ắ"), ("Alpha", "Α"), ("lambda", "λ"), ("omegatonos", "ώ"), ("iotadieresistonos", "ΐ"), ("zhecyrillic", "ж"), ("Zhecyrillic", "Ж"), ("alefhebrew", "א"), ("asmallhiragana", "ぁ"), ("kakatakana", "カ"), ("onesuperior", "¹"), ("twoinferior", "₂"), ("threecircle", "③"), ("fourarabic", "٤"),
     ("Amonospace", "Ａ"), ("Scommaaccent", "Ș"), ("kcommaaccent", "ķ"), ("uni00410042", "AB"), ("uniD800", None), ("uni0041004", None), ("u110000", None), ("g42", None), ("foocyrillic", None)],
)
def test_glyph_names_by_rule(name, text):
    assert glyph_text(name) == text


def test_glyph_list_is_an_option():
    listed = read_glyph_list("# a list\nodd;00C1 # one\nwide;D835 DD04\nbad;XYZ\nempty;\nbig;12345\n")
    assert listed == {"odd": "Á", "wide": "𝔄"}
    pdf = w.pages([b"BT /F 1 Tf <01> Tj ET"], font=b"<</Subtype/Type1/BaseFont/Courier/Encoding<</Differences[1/odd]>>>>")
    text = lambda glyphs: interpret(pdf, ParseOptions(TEXT, 0, Limits(), glyphs).checked())["pages"][0]["texts"][0]["unicode"]
    assert (text(None), text(listed)) == ("\ufffd", "Á")


def text_of(content, font, **more):
    return [(t["unicode"], t["decode_complete"]) for t in page(content, font=font, **more)["texts"]]


def test_encodings():
    win = b"<</Type/Font/Subtype/TrueType/BaseFont/X/Encoding/WinAnsiEncoding>>"
    assert text_of(b"BT /F 1 Tf <A0AD7F818D8F909D> Tj ET", win) == [(" -••••••", True)]
    plain = b"<</Type/Font/Subtype/Type1/BaseFont/%s>>"
    assert text_of(b"BT /F 1 Tf <412760> Tj ET", plain % b"Courier") == [("A’‘", True)]
    assert text_of(b"BT /F 1 Tf <412760> Tj ET", plain % b"Symbol") == [("���", False)]
    assert text_of(b"BT /F 1 Tf <41432760> Tj ET", b"<</Subtype/Type1/BaseFont/Courier/Encoding<</Differences[65/B]>>>>") == [("BC’‘", True)]
    assert text_of(b"BT <4142> Tj ET", plain % b"Courier") == [("��", False)]


def test_positions():
    p = page(b"BT /F 10 Tf 1 0 0 1 10 20 Tm [(A) 100 (A)] TJ (A) Tj ET", font=w.FONT.replace(b"500", b"600"))
    assert p["texts"][1]["matrix"][4] == pytest.approx(21)
    p = page(b"2 0 0 3 10 20 cm BT /F 1 Tf 1 0 0 1 20 30 Tm (A) Tj ET")
    assert p["texts"][0]["matrix"] == [2, 0, 0, 3, 50, 110]
    p = page(b"BT /F 10 Tf 2 Tw 1 Tc 50 Tz (a b) Tj ET")
    assert [g["origin"]["x"] for g in p["texts"][0]["glyphs"]] == pytest.approx([0, 3, 7])


def test_graphics_and_forms():
    p = page(b"q 2 w 1 0 0 RG 0 0 10 5 re W n 1 1 m 2 2 3 3 v h B* Q 0 0 m 1 1 l S")
    a, b = p["graphics"]
    assert [s["op"] for s in a["segments"]] == ["m", "v", "h"] and a["even_odd"] and a["stroke"] and a["fill"]
    assert a["style"]["line_width"] == 2 and a["style"]["clipped"] and a["style"]["stroke"]["space"] == "DeviceRGB"
    assert b["style"]["line_width"] == 1 and not b["style"]["clipped"] and not b["fill"]
    form = w.stream(b"0 0 1 1 re f i", b"/Subtype/Form/BBox[0 0 1 1]/Matrix[2 0 0 2 0 0]")
    r = run(w.pages([b"/X Do", b"/X Do"], resources=b"/XObject<</X 5 0 R>>", extra=[form]))
    assert r["error"] is None and len(r["diagnostics"]) == 2
    assert r["pages"][0]["graphics"][0]["segments"][0]["points"][2] == {"x": 2, "y": 2}
    loop = w.stream(b"/X Do", b"/Subtype/Form/BBox[0 0 1 1]/Resources<</XObject<</X 5 0 R>>>>")
    assert "cycle" in run(w.pages([b"/X Do"], resources=b"/XObject<</X 5 0 R>>", extra=[loop]))["error"]["message"]


def test_errors_keep_earlier_rows():
    r = run(w.pages([b"0 0 1 1 re f (unterminated"]), GRAPHICS, 0)
    assert r["error"]["class"] == "malformed" and len(r["pages"][0]["graphics"]) == 1 and not r["pages"][0]["complete"]
    r = run(w.pages([b"0 0 1 1 re f nonsense"]), GRAPHICS, 0)
    assert r["error"] is None and len(r["diagnostics"]) == 1 and not r["pages"][0]["complete"]
    for bad in (b"Q", b"ET", b"BT BT", b"(x) Tj", b"1 2 Td", b"-1 w", b"[0] 0 d", b"EI", b"9 Tr", b"1 2 3"):
        assert run(w.pages([bad]))["error"], bad
    assert run(w.pages([b"q BT"]))["diagnostics"][0]["code"] == "unbalanced-content-state"


def test_selection_changes_what_is_checked():
    large = b"1" + b"0" * 200
    broken = w.pages([b"%s 0 0 1 0 0 cm " % large * 2 + b"BT /F 1 Tf (A) Tj ET -1 w"])
    p = run(broken, TEXT, 0)
    assert p["error"] is None and [t["unicode"] for t in p["pages"][0]["texts"]] == ["A"] and p["pages"][0]["complete"]
    assert run(broken, GRAPHICS, 0)["error"] and run(broken, TEXT, LAYOUT)["error"]
    ok = w.pages([b"BT /F 1 Tf (A) Tj ET -1 w"])
    assert run(ok, TEXT, 0)["error"] is None and run(ok, TEXT, LAYOUT)["error"]
    notes = w.pages([b"("], page=b"/Annots[<</Subtype/Link>>]/Resources 99 0 R")
    r = run(notes, ANNOTATIONS, 0)
    assert r["error"] is None and r["pages"][0]["annotations"][0]["rect"] == {"x0": 0, "y0": 0, "x1": 0, "y1": 0}


def test_limits():
    two = w.pages([b"", b""], page=b"/Annots[<</Subtype/Link>><</Subtype/Link>>]")
    assert run(two, ANNOTATIONS, 0, max_semantic_objects=6)["error"]["class"] == "limit"
    assert run(two, ANNOTATIONS, 0, max_semantic_objects=7)["error"] is None
    assert run(two, max_file_bytes=10)["error"]["class"] == "limit"
    with pytest.raises(ValueError):
        Limits(max_depth=-1).checked()
    with pytest.raises(ValueError):
        ParseOptions(16).checked()
    assert ParseOptions().checked().content == TEXT


def test_values_and_content_bytes_are_bounded():
    many = w.pages([b"[1 2] 0 d " * 17])
    r = run(many, TEXT, FULL, max_values=64)
    assert r["error"]["class"] == "limit" and len(r["pages"][0]["operations"]) == 16
    assert run(many, TEXT, 0, max_values=64)["pages"][0]["operations"] == [] and run(many, TEXT, FULL)["error"] is None
    body = b"q Q" + b" " * 61
    assert run(w.pages([body] * 2), max_content_bytes=128)["error"] is None
    assert run(w.pages([body] * 3), max_content_bytes=128)["error"]["class"] == "limit"


def test_form_diagnostics_are_raised_on_every_page():
    form = w.stream(b"1 i", b"/Type/XObject/Subtype/Form/BBox[0 0 9 9]")
    r = run(w.pages([b"/X Do", b"/X Do"], resources=b"/XObject<</X 5 0 R>>", extra=[form]), GRAPHICS, 0)
    assert [d["page"] for d in r["diagnostics"]] == [0, 1] and not any(p["complete"] for p in r["pages"])


def test_shared_unicode_map_is_charged_once():
    cmap = w.stream(b"1 beginbfrange <0000> <00FF> <0041> endbfrange")
    fonts = [b"<</Subtype/Type0/BaseFont/U%d/Encoding/Identity-H/ToUnicode 5 0 R>>" % i for i in range(3)]
    shown = b"BT " + b" ".join(b"/F%d 1 Tf <0000> Tj" % i for i in range(3)) + b" ET"
    pdf = w.pages([shown], resources=b"/Font<</F0 6 0 R/F1 7 0 R/F2 8 0 R>>", extra=[cmap, *fonts])
    r = run(pdf, TEXT, 0, max_objects=300)
    assert r["error"] is None and [t["unicode"] for t in r["pages"][0]["texts"]] == ["A"] * 3
    assert run(pdf, TEXT, 0, max_objects=200)["error"]["class"] == "limit"


def test_type3_width_errors():
    def font(proc, extra=b""):
        own = b"<</Subtype/Type3/FontMatrix[.01 0 0 .01 0 0]/Encoding<</Differences[65/g]>>/CharProcs<</g %s>>%s>>" % (proc, extra)
        return run(w.pages([b"BT /F 1 Tf (A) Tj ET"], font=own, extra=[w.stream(b"d0"), w.stream(b"1 0 d0", b"/Filter/LZWDecode")]), TEXT, LAYOUT)

    assert font(b"5 0 R")["error"] and font(b"<<>>")["error"] and font(b"null", b"/FontMatrix[1 0]")["error"]
    r = font(b"6 0 R", b"/FirstChar 65/Widths[3]")
    assert r["error"] is None and r["diagnostics"][0]["code"] == "unsupported-type3-font"


def test_streams_stand_for_their_dictionaries():
    r = run(w.pages([b"/G gs 0 0 1 1 re f"], resources=b"/ExtGState 5 0 R", extra=[w.stream(b"", b"/G<</LW 3>>")]), GRAPHICS, LAYOUT)
    assert r["error"] is None or r["error"]["class"] == "malformed"
    note = run(w.pages([b""], page=b"/Annots[5 0 R]", extra=[w.stream(b"", b"/Subtype/Link")]), ANNOTATIONS, 0)
    assert note["pages"][0]["annotations"][0]["subtype"] == "Link"
    assert run(w.pages([b""], page=b"/Annots[<</A 1/A 2>>]"), ANNOTATIONS, 0)["error"]


def test_inline_image_operands_are_kept():
    r = run(w.pages([b"BI /W 1/H 1/BPC 8/CS/G ID x EI"]), ALL, FULL)
    op = r["pages"][0]["operations"][0]
    assert op["operator"] == "BI" and op["operands"][0].split() == ["/W", "1/H", "1/BPC", "8/CS/G"]
    assert len(r["pages"][0]["images"][0]["source"]["spans"]) == 2


def open_(pdf, **limits):
    return Document(pdf, Limits(**limits)).open()


BASE = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[]/Count 0>>"]


def test_cross_references():
    pdf = w.update(w.build([*BASE, b"7", b"8"]), {4: b"9"}, (3,))
    d = open_(pdf)
    ref = lambda n, g=0: d.resolve(Obj("reference", (n, g)))
    assert (ref(3).kind, ref(4).value, ref(4, 1).kind, ref(77).kind, len(d.sections)) == ("null", "9", "null", "null", 2)
    with pytest.raises(PdfError):
        d.load(3)
    loop = w.build(BASE)
    at = int(loop[loop.rindex(b"startxref") + 9 :].split()[0])
    with pytest.raises(PdfError, match="cycle"):
        open_(loop.replace(b"/Root 1 0 R>>", b"/Root 1 0 R/Prev %d>>" % at))
    d = open_(w.build_stream(BASE, {3: b"<</A 5>>"}))
    assert d.load(3).origin == "object_stream" and d.load(3).body.value.get(b"A").value == "5"
    with pytest.raises(PdfError):
        open_(b"%PDF-1.7")
    lead = w.build(BASE, leading=b"x")
    assert run(lead)["version_major"] == 1


def test_reference_chains():
    d = open_(w.build([*BASE, b"4 0 R", b"42"]), max_depth=2)
    assert d.resolve(Obj("reference", (3, 0))).value == "42"
    d = open_(w.build([*BASE, b"4 0 R", b"42"]), max_depth=1)
    with pytest.raises(LimitError):
        d.resolve(Obj("reference", (3, 0)))
    d = open_(w.build([*BASE, b"4 0 R", b"3 0 R"]))
    with pytest.raises(PdfError, match="cycle"):
        d.resolve(Obj("reference", (3, 0)))


def test_indirect_length_and_regions():
    body = b"<</Length 4 0 R>>\nstream\nab endstream cd\nendstream"
    d = open_(w.build([*BASE, body, b"15"]))
    assert d.bytes(d.load(3).body.value.span) == b"ab endstream cd"
    s = structure(w.pages([b"0 0 1 1 re f"]), ParseOptions().checked())
    at = 0
    for r in s["regions"]:
        assert r["start"] == at < r["end"]
        at = r["end"]
    assert at == s["length"]


def test_page_attributes():
    tree = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/MediaBox[100 100 0 0]/Rotate -450/Kids[3 0 R]>>", b"<</Type/Page/Rotate null/Contents 99 0 R/UserUnit 2>>"]
    p = run(w.build(tree))["pages"][0]
    assert p["media_box"] == {"x0": 0, "y0": 0, "x1": 100, "y1": 100} == p["crop_box"] and p["rotate"] == -90 and p["user_unit"] == 2 and p["complete"]
    for bad in (b"/Rotate 45", b"/UserUnit 0", b"/CropBox[1 2 3]"):
        assert run(w.build([*tree[:2], b"<</Type/Page%s>>" % bad]))["error"]


def test_encrypted():
    r = run(w.pages([b""], trailer=b"/Encrypt<<>>"))
    assert r["encrypted"] and r["pages"] == [] and r["error"]["class"] == "unsupported"
