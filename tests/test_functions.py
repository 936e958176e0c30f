"""Fixed values of scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliolake.functions import dates as D, geometry as G, text as T


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize("n,want", [(4, "IV"), (9, "IX"), (40, "XL"), (90, "XC"), (400, "CD"), (900, "CM"), (1999, "MCMXCIX"), (0, "I"), (4000, "MMMCMXCIX")])
def test_roman(spark, n, want):
    assert one(spark, T.roman(F.lit(n)))[0] == want


@pytest.mark.parametrize("n,want", [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (703, "AAA")])
def test_alpha(spark, n, want):
    assert one(spark, T.alpha(F.lit(n)))[0] == want


def test_labels(spark):
    got = one(spark, *[T.page_label(F.lit(s), F.lit(p), F.lit(n)) for s, p, n in (("r", None, 2), ("D", "A-", 3), (None, "cover", 1), ("a", "", 27))])
    assert tuple(got) == ("ii", "A-3", "cover", "aa")


def test_strings(spark):
    got = one(
        spark,
        T.xml_escape(F.lit("<a & 'b'>")), T.html_escape(F.lit("'")), T.name_escape(F.lit("A B#")), T.name_unescape(F.lit("A#20B#23#zz")), T.strip_subset(F.lit("ABCDEF+Arial")),
        T.bullets(F.lit("?  item\n  x")), T.newlines(F.lit("a\r\nb\rc")), T.has_rtl(F.lit("abc שלום")), T.has_rtl(F.lit("abc")), T.css_family(F.lit("Courier-Bold")), T.names_to_flags(F.lit("print, hidden")), T.names_to_flags(F.lit("36")),
    )
    assert tuple(got) == ("&lt;a &amp; &apos;b&apos;&gt;", "&#39;", "A#20B#23", "A B##zz", "Arial", ".  item\n  x", "a\nb\nc", True, False, "'Courier New', monospace", 6, 36)


def test_python_text():
    assert T.collapse_spacing("T H I S is") == "THIS is"
    assert T.collapse_spacing("T H") == "T H"
    assert T.collapse_doubles("HHeelllloo 1122 aaaa book") == "Hello 1122 aaaa book"
    assert T.reverse_rtl("a אבג b") == "a גבא b"
    assert T.wrap("aa bb cc", 30.1) == ["aa bb", "cc"]
    assert T.saslprep("I­X") == "IX"
    with pytest.raises(ValueError):
        T.saslprep("\u0007")


def test_dates(spark):
    got = one(spark, *[D.parse(F.lit(x)) for x in ("D:2024", "D:20240229", "D:20241301", "junk", "D:20240102030405+05'30'")], D.offset_minutes(F.lit("D:20240102030405-05'30'")), D.offset_minutes(F.lit("D:2024Z")), D.to_xmp(F.lit("D:20240102030405-05'30'")))
    assert got[0] == dt.datetime(2024, 1, 1) and got[1] == dt.datetime(2024, 2, 29) and got[2] is None and got[3] is None and got[4] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert tuple(got)[5:] == (-330, 0, "2024-01-02T03:04:05-05:30")


def test_geometry(spark):
    m = G.rotation(F.lit(1.5707963267948966))
    p = one(spark, G.transform(m, F.lit(1.0), F.lit(0.0)), G.inverse(G.matrix(1, 2, 2, 4, 0, 0)), G.transform_rect(G.matrix(-1, 0, 0, 1, 0, 0), G.rect(0, 0, 2, 1)), G.intersects(G.rect(0, 0, 1, 1), G.rect(1, 0, 2, 1)), G.quantized(F.lit(-91.0)))
    assert abs(p[0].x) < 1e-9 and abs(p[0].y - 1) < 1e-9 and p[1] is None and (p[2].llx, p[2].urx) == (-2, 0) and p[3] is False and p[4] == 270


def test_colours(spark):
    p = one(spark, G.cmyk(F.lit(0.0), F.lit(0.0), F.lit(0.0)), G.css_colour(F.lit("#abc")), G.css_colour(F.lit("Navy")), G.css_colour(F.lit("nonsense")), G.html_colour(F.lit("#80FF0000")), G.html_colour(F.lit("red")), G.css_length(F.lit("1in"), 12.0), G.css_length(F.lit("oops"), 12.0), G.is_bold(F.lit("bolder")), G.is_bold(F.lit("400")))
    assert (p[0].c, p[0].k) == (0.0, 1.0) and p[1] == "aabbcc" and p[2] == "000080" and p[3] is None and (p[4].a, p[4].r) == (128, 255) and p[5] is None and tuple(p)[6:] == (72.0, 12.0, True, False)


@pytest.mark.parametrize("program,inputs,want", [("{ add 2 mul }", [1, 2], [6]), ("{ dup 0.5 gt { 1 exch sub } { 2 mul } ifelse }", [0.25], [0.5]), ("{ 3 1 roll }", [1, 2, 3], [3, 1, 2]), ("{ 1 index exch pop }", [5, 6], [5, 5]), ("{ 7 2 idiv exch pop 3 bitshift }", [0], [24])])
def test_calculator(program, inputs, want):
    assert G.calculator(program, inputs) == want
