import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.kernel.errors import LimitError, PdfError
from quire.kernel.syntax import Content, decode_hex, inline_size, lex, parse_object


@pytest.mark.parametrize("raw, kind, value", [
    (b"+00012", "integer", "+00012"), (b"-0", "integer", "-0"), (b".50", "real", ".50"), (b"+1.", "real", "+1."), (b"-.0020", "real", "-.0020"),
    (b"/A#20B#ff", "name", b"A B\xff"), (b"/", "name", b""), (b"(a(b)c)", "string", (1, b"a(b)c")),
    (b"(a\\101\\12\\1\\777\\(\\)\\\\\\n\\r\\t\\b\\f\\z)", "string", (1, bytes.fromhex("61410A01FF28295C0A0D09080C7A"))),
    (b"(a\rb\r\nc\nd)", "string", (1, b"a\nb\nc\nd")), (b"(a\\\r\nb\\\rc\\\nd)", "string", (1, b"abcd")), (b"<A b C\x00>", "string", (2, b"\xab\xc0")),
    (b"12 0 R", "reference", (12, 0)), (b"4294967295 65535 R", "reference", (4294967295, 65535)), (b"12 % ref\r\n 34 R", "reference", (12, 34)),
    (b"null", "null", None), (b"true", "boolean", True),
])
def test_direct_objects(raw, kind, value):
    o, end = parse_object(raw)
    assert (o.kind, o.value) == (kind, value)
    assert end == len(raw.rstrip(b" "))


@pytest.mark.parametrize("raw", [b"", b"(a", b"<1", b"<1g>", b"[1", b"<</A>>", b"<<1 2>>", b">>", b"]", b")", b"1e3", b"+", b".", b"--1", b"1.2.3", b"/A#0", b"/A#00", b"0 0 R", b"1 65536 R", b"4294967296 0 R", b"foo", b"[1 >>"])
def test_malformed(raw):
    with pytest.raises(PdfError):
        parse_object(raw)


def test_depth_is_bounded_without_recursion():
    parse_object(b"[" * 4000 + b"]" * 4000, max_depth=4096)
    with pytest.raises(LimitError):
        parse_object(b"[" * 300 + b"]" * 300)


def test_lex_keeps_trivia_and_prefix():
    toks, error = lex(b" 1%c\n/A")
    assert [k for k, _, _ in toks] == ["whitespace", "integer", "comment", "whitespace", "name", "eof"] and error is None
    toks, error = lex(b"1 (")
    assert [k for k, _, _ in toks] == ["integer", "whitespace"] and error


@given(st.binary(max_size=200))
@settings(max_examples=300, deadline=None)
def test_lex_covers_what_it_accepts(data):
    toks, error = lex(data)
    at = 0
    for _, s, e in toks:
        assert s == at
        at = e
    assert error or at == len(data)


def test_inline_images():
    def one(raw):
        c = Content(raw)
        assert c.next()[0] == b"BI"
        return c, c.inline_image()

    c, i = one(b"BI /W 2 /H 2 /BPC 8 /CS /RGB ID ab EI cdefgh\nEI Q")
    assert (i.end - i.start, i.boundary) == (12, "recovered") and c.next()[0] == b"Q"
    _, i = one(b"BI /W 8 /H 1 /IM true ID x EI")
    assert i.end - i.start == 1
    _, i = one(b"BI /L 6 /W 1 /H 1 ID abEIcd EI")
    assert (i.end - i.start, i.boundary) == (6, "length")
    assert inline_size(3, 3, 1, 1) == 3 and inline_size(8, 1, 1, 8, True) == 1
    for bad in (b"BI /W 1 /W 1 /H 1 ID x EI", b"BI /W 1 ID", b"BI 1 2 ID x EI", b"BI /W 9 /H 9 /CS /G ID x EI"):
        with pytest.raises((PdfError, AttributeError)):
            one(bad)


def test_hex_pads_at_the_end():
    assert decode_hex(b"61 6") == b"a`"
