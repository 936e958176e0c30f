"""Codecs, parser, recovery, writer and text of PDF files."""

import os
import zlib

import pytest

from foliolake.operators import layout as L, pages as P, validate as V
from foliolake.sources import codecs, fixtures, pdf_core as C, pdf_text as X, pdf_writer as W, relations as R


@pytest.mark.parametrize("name", ["FlateDecode", "LZWDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode"])
@pytest.mark.parametrize("data", [b"", b"hello", bytes(range(256)), os.urandom(4000), b"ab" * 9000])
def test_codecs(name, data):
    assert codecs.decode_chain(codecs.encode_chain(data, [name]), [name]) == data


def test_damaged_and_large_streams():
    packed = zlib.compress(b"abc" * 1000 + os.urandom(300))
    assert codecs.flate(packed[:-50]).startswith(b"abcabc")
    assert codecs.flate(zlib.compress(b"raw")[2:-4]) == b"raw"
    with pytest.raises(codecs.TooLarge):
        codecs.flate(zlib.compress(bytes(3 << 20)), cap=1 << 20)
    with pytest.raises(ValueError):
        codecs.ascii_hex(b"4G>")
    assert codecs.ascii_hex(b"4 1 5>") == b"AP"


def test_predictors():
    rows = bytes([2, 1, 2, 3, 2, 1, 1, 1])
    assert codecs.unpredict(rows, 12, 1, 8, 3) == bytes([1, 2, 3, 2, 3, 4])
    assert codecs.unpredict(bytes([1, 1, 1]), 2, 1, 8, 3) == bytes([1, 2, 3])


def test_lexer():
    lex = C.Lexer(rb"/A#20B (a\(b\)\101\n) <48 65 6> [1 -2.5 true null 3 0 R] % note" + b"\n<< /K /V >>")
    assert [lex.value() for _ in range(5)] == ["A B", b"a(b)A\n", b"He`", [1, -2.5, True, None, C.Ref(3, 0)], {"K": "V"}]


def page(ops: bytes, **more):
    objects, root, _ = W.document([ops], **more)
    f = C.File(W.full(objects, root))
    fold = X.Fold(f)
    p = f.pages()[0]
    fold.run(f.content(p), f.get(p["Resources"]))
    return fold


@pytest.mark.parametrize("ops,want", [(b"(Hello World) Tj", ["Hello World"]), (b"(Hello) Tj ( World) Tj", ["Hello", " World"]), (b"[(H) 20 (ello)] TJ", ["Hello"]), (b"[(A) -400 (B)] TJ", ["A B"]), (b"[(A) -600 (B)] TJ", ["A", "B"]), (b"(Line 1) Tj 0 -14 Td (Line 2) Tj", ["Line 1", "Line 2"])])
def test_shows(ops, want):
    assert [f[0] for f in page(b"BT /F1 12 Tf 100 700 Td " + ops + b" ET").fragments] == want


def test_position_and_state():
    text, x, y, width, size, turn, *_ = page(b"Q q 2 0 0 2 10 20 cm BT /F1 12 Tf 100 200 Td (Hello) Tj ET Q").fragments[0]
    assert (text, x, y, size, turn) == ("Hello", 210, 420, 24, 0) and width > 0
    assert page(b"BT /F1 12 Tf 0 1 -1 0 50 60 Tm (up) Tj ET").fragments[0][5] == 90
    assert page(b"").fragments == []


def test_inline_image_and_junk():
    ops = list(C.instructions(b"q ) ]] 1 0 0 rg BI /W 2 /H 2 ID \x00EI\x01 EI Q"))
    assert [o for o, _ in ops] == ["q", "rg", "BI", "Q"] and ops[1][1] == [1, 0, 0]


@pytest.mark.parametrize("doc_id", [0, 1, 2])
def test_recovery(doc_id):
    text = "first\nsecond"
    assert [r[2] for r in R.rows_of(fixtures.damaged(doc_id, text), "fragments")] == ["first", "second"]


def test_unreadable():
    assert R.rows_of(b"", "errors") and R.rows_of(b"no file", "pages") == [] and R.rows_of(b"%PDF-1.4 truncated", "objects") == []


def test_compressed_and_appended():
    objects, root, _ = W.document(W.text_pages("a\nb"))
    small = W.compressed(objects, root)
    assert [r[2] for r in R.rows_of(small, "fragments")] == ["a", "b"]
    assert {r[2] for r in R.rows_of(small, "xref")} == {"compressed", "in use", "free"}
    whole = W.full(objects, root)
    again = W.appended(whole, {3: {"Type": C.Name("Font"), "BaseFont": C.Name("Courier")}}, root, 6, int(whole.rsplit(b"startxref\n", 1)[1].split()[0]))
    assert R.rows_of(again, "fonts")[0][1] == "Courier"
    rows = whole[whole.rfind(b"xref\n0") :].split(b"trailer")[0].split(b"\n", 2)[2]
    assert len(rows) % 20 == 0


def test_circular_references():
    objects, root, _ = W.document([b"BT ET"])
    objects[2]["Kids"].append(C.Ref(2, 0))
    objects[9] = C.Ref(9, 0)
    f = C.File(W.full(objects, root))
    assert len(f.pages()) == 1 and f.get(C.Ref(9, 0)) is None and f.get(C.Ref(77, 0)) is None


def test_cmap():
    assert X.cmap(b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <0061> endbfrange 1 beginbfrange <05> <06> [<0078> <0079>] endbfrange") == {1: "A", 2: "a", 3: "b", 4: "c", 5: "x", 6: "y"}


def test_signature_digest(spark):
    f = b"0123456789"
    data = W.full({1: {"Type": C.Name("Catalog"), "AcroForm": {"Fields": [{"T": "s", "FT": C.Name("Sig"), "V": {"ByteRange": [0, 4, 6, 2], "Contents": b"xx", "Reason": "why"}}]}, "Pages": C.Ref(2, 0)}, 2: {"Type": C.Name("Pages"), "Kids": [], "Count": 0}}, 1)
    row = R.rows_of(data, "signatures")[0]
    import hashlib

    assert row[0] == "s" and row[2] == "why" and row[5] == [0, 4, 6, 2] and row[7] == hashlib.sha256(data[0:4] + data[6:8]).hexdigest() and f


def test_read_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(fixtures.plain(1, "one\ntwo"))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    files = R.read_pdfs(spark, str(tmp_path))
    assert sorted(r.text for r in R.scan(files, "fragments").collect()) == ["one", "two"]
    assert R.scan(files, "errors").count() == 1


def test_rows_by_anchor(spark):
    f = spark.createDataFrame([(1, i + 1, "x", 0.0, -y) for i, y in enumerate([0.0, 2.0, 4.0])], "doc_id long, frag_idx long, text string, x double, y double")
    assert [r.row_no for r in L.anchored_rows(f, ["doc_id"]).orderBy("frag_idx").collect()] == [1, 1, 2]


def test_visible_outlines(spark):
    rows = [(1, 1, 1, False), (1, 2, 2, True), (1, 3, 3, True), (1, 4, 1, True), (1, 5, 2, True)]
    items = spark.createDataFrame(rows, "doc_id long, ord long, level long, open boolean")
    assert P.visible_outlines(items, ["doc_id"]).first().visible == 3


def _parses(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_a_file_is_parsed_once_for_all_rules(spark):
    """With a caller's rule, whose columns may be bound to its relation, there is one parse more."""
    files = spark.createDataFrame([(i, fixtures.rich(i, "a\nb")) for i in range(12)] + [(12, b"broken"), (13, None)], "doc_id long, content binary")

    def links(r, f):
        x = r("annotations")
        return [V._found(x, x["subtype"] == "Link", "own", "a link")]

    for target in ("PDF/A-1b", "PDF/A-2u", "PDF/A-3a"):
        assert _parses(V.validate(files, target)) == 1
    more = V.validate(files, "PDF/A-1b", [links])
    assert _parses(more) == 2
    assert [r.doc_id for r in more.where("rule_id = 'own'").orderBy("doc_id").collect()] == [i for i in range(12) if i % 4 >= 2]
    assert V.compliant(files, more).where("not compliant").count() == 13


def test_device_colours_by_output_intent(spark):
    """The rule takes the catalog's output intents from the resource's row."""

    def content(i: int, intents: list | None) -> bytes:
        image = C.Stream({"Type": C.Name("XObject"), "Subtype": C.Name("Image"), "ColorSpace": C.Name("DeviceGray")}, b"")
        objects, root, trailer = W.document([b"BT ET"], more={20: image}, catalog={} if intents is None else {"OutputIntents": [{"S": C.Name(x)} for x in intents]})
        objects[2]["Resources"]["XObject"] = {"Im1": C.Ref(20, 0)}
        return W.full(objects, root, trailer)

    files = spark.createDataFrame([(i, content(i, x)) for i, x in enumerate([None, [], ["GTS_PDFX"], ["GTS_PDFX", "GTS_PDFA1"]])], "doc_id long, content binary")
    assert sorted(r.doc_id for r in V.validate(files).where("rule_id = '6.2.2'").collect()) == [0, 1, 2]


@pytest.mark.parametrize("name,most", [("compliance", 2), ("validate_pdf_a", 2)])
def test_queries_write_and_parse_files_once(spark, small, name, most):
    from foliolake.queries import QUERIES

    assert _parses(QUERIES[name](spark, small)) == most


def test_all_relations_of_one_parse(spark):
    """The same rows as from a parse for each relation, with null ids and texts, damaged files and none."""
    made = [(i, m(i, "a\n" * (40 * i))) for i, m in enumerate([fixtures.rich, fixtures.plain, fixtures.damaged, fixtures.rich, fixtures.rich, fixtures.rich])] + [(7, b""), (None, None)]
    files = spark.createDataFrame(made, "doc_id long, content binary")
    names = [n for n in R.SCHEMAS if n != "errors"]
    together = R.scan_all(files, names).cache()
    for n in names:
        assert sorted(map(str, together.where(f"__relation = '{n}'").select("doc_id", f"__{n}.*").collect())) == sorted(map(str, R.scan(files, n).collect())), n
    together.unpersist()


def test_tokens_of_unusual_forms():
    got = C.Lexer(b"<</A#20B 1 0 R/C(x\\)(y))/D[1 -2.5 +.5 4. null true>>/E<4142>%c\n 7 0 Robj]/F<</G/H]>>/I 1 2/J>>").value()
    assert got == {"A B": C.Ref(1, 0), "C": b"x)(y)", "D": [1, -2.5, 0.5, 4.0, None, True, "E", b"AB", 7, 0], "F": {"G": "H"}, "I": 1} and type(got["D"][6]) is C.Name


@pytest.mark.parametrize("row", [b"%010d 00000 n \n", b"%010d 00000 n\r\n", b"%d 0 n\n", b"%010d 00000 n\n"])
def test_rows_of_cross_references(row):
    head = b"%PDF-1.7\n"
    body = b"1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n"
    rows = b"".join([b"0000000000 65535 f \n", row % len(head), row % (len(head) + len(body))])
    more = b"2 0 obj\n<</Type/Pages/Kids[]/Count 0>>\nendobj\n"
    f = C.File(head + body + more + b"xref\n0 3\n" + rows + b"trailer\n<</Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(head) + len(body) + len(more)))
    assert not f.rebuilt and f.places == {C.Ref(0, -1): (), C.Ref(1, 0): (len(head),), C.Ref(2, 0): (len(head) + len(body),)}
