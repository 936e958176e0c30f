"""PDF files made from text rows: a text sink, and test files whose contents follow from the row."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import pdf_writer as W
from .pdf_core import Name, Ref, Stream

COLOURS = [b"", b"0.8 0.1 0.2 rg", b"0.5 g", b"0 g 1 g", b"0 0 0 1 k"]
SUBTYPES = ["Text", "Link", "Highlight", "Sound"]


def plain(doc_id: int, text: str) -> bytes:
    objects, root, trailer = W.document(W.text_pages(text))
    return W.full(objects, root, trailer)


def rich(doc_id: int, text: str) -> bytes:
    """Pages of 50 lines with annotations, fields, outlines, labels, destinations, attachments, XMP and faults, all by doc_id."""
    pages = W.text_pages(text)
    n = len(pages)
    extra = COLOURS[doc_id % 5] + b"\nq 1 0 0 1 10 20 cm 0 0 5 5 re f Q\n"
    if doc_id % 3 == 0:
        extra += b"q 100 0 0 50 72 600 cm /Im1 Do Q\n"
    pages[0] = extra + pages[0]
    more: dict[int, object] = {}
    at = 4 + 2 * n

    def add(x) -> Ref:
        nonlocal at
        more[at] = x
        at += 1
        return Ref(at - 1, 0)

    page = lambda i: Ref(4 + 2 * i, 0)
    notes = []
    for k in range(doc_id % 4):
        note = {"Type": Name("Annot"), "Subtype": Name(SUBTYPES[k % 4]), "Rect": [10 * k, 10.0, 10 * k + 20, 40], "Contents": f"note {k} of {doc_id}", "NM": f"n{k}", "T": "a" if k % 2 else "b", "F": 4 if k % 2 == 0 else 2}
        if k == 1:
            note["A"] = {"S": Name("URI"), "URI": b"http://example.org/%d" % doc_id} if doc_id % 8 < 4 else {"S": Name("JavaScript")}
        notes.append(add(note))
    image = add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 2, "Height": 2, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray"), "Interpolate": doc_id % 2 == 0}, bytes(4)))
    spare = add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 1, 1]}, b"n"))
    state = add({"Type": Name("ExtGState"), "CA": 0.5 if doc_id % 4 == 1 else 1})
    first, items = at, n + 1
    refs = [Ref(first + i, 0) for i in range(items + 1)]
    root = refs[items]
    for i in range(n):
        item = {"Title": f"Page {i + 1}", "Parent": root, "Dest": [page(i), Name("Fit")]}
        if i:
            item["Prev"] = refs[i - 1]
        if i + 1 < n:
            item["Next"] = refs[i + 1]
        if i == 0:
            item |= {"First": refs[n], "Last": refs[n], "Count": 1}
        add(item)
    add({"Title": "Start", "Parent": refs[0], "Dest": [page(0), Name("Fit")]})
    add({"Type": Name("Outlines"), "First": refs[0], "Last": refs[n - 1], "Count": n})
    catalog: dict = {"Outlines": root, "PageLabels": {"Nums": [0, {"S": Name("r")}, 4, {"S": Name("D"), "P": "A-"}]}}
    catalog["Names"] = {"Dests": {"Kids": [add({"Names": [b"alpha", [page(0), Name("Fit")], b"last", [page(n - 1), Name("XYZ")]], "Limits": [b"alpha", b"last"]})]}}
    catalog["Dests"] = {"legacy": [page(0), Name("Fit")], "alpha": [page(n - 1), Name("Fit")]}
    if doc_id % 5 == 0:
        data = add(Stream({"Type": Name("EmbeddedFile"), "Subtype": Name("text/plain")}, text.encode()))
        catalog["Names"]["EmbeddedFiles"] = {"Names": [b"notes.txt", {"Type": Name("Filespec"), "F": b"notes.txt", "EF": {"F": data}, "Desc": b"all text"}]}
    fields = [add({"T": f"f{k}", "FT": Name("Tx") if k == 0 else Name("Btn"), "V": f"value {doc_id}" if k == 0 else Name("Off")}) for k in range(doc_id % 3)]
    if fields:
        catalog["AcroForm"] = {"Fields": [add({"T": "form", "Kids": fields})], "NeedAppearances": doc_id % 2 == 0}
    if doc_id % 7 == 0:
        catalog["AA"] = {"WC": {"S": Name("JavaScript")}}
    if doc_id % 6 == 0:
        catalog["OCProperties"] = {}
    if doc_id % 2 == 0:
        part = b'<x:xmpmeta><rdf:RDF><rdf:Description rdf:about="" xmlns:pdfaid="http://www.aiim.org/pdfa/ns/id/" pdfaid:part="1" pdfaid:conformance="B"><dc:title><rdf:Alt><rdf:li xml:lang="x-default">Document %d</rdf:li></rdf:Alt></dc:title></rdf:Description></rdf:RDF></x:xmpmeta>' % doc_id
        catalog["Metadata"] = add(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, part))
    kids = [add({"S": Name("P"), "P": Ref(0, 0), "K": [i, {"MCID": i + 100}]}) for i in range(2)]
    catalog["StructTreeRoot"] = add({"Type": Name("StructTreeRoot"), "K": add({"S": Name("Document"), "K": kids})})
    info = {"Title": f"Document {doc_id}", "CreationDate": b"D:2024%02d%02d030405+02'00'" % (doc_id % 12 + 1, doc_id % 28 + 1), "Pages": n}
    objects, top, trailer = W.document(pages, info, more=more, catalog=catalog)
    objects[4]["Annots"] = notes
    objects[4]["Rotate"] = 90 * (doc_id % 4)
    objects[2]["Resources"] |= {"XObject": {"Im1": image, "Fm1": spare}, "ExtGState": {"G1": state}}
    if doc_id % 2:
        trailer["ID"] = [b"0" * 16, b"1" * 16]
    return (W.compressed if doc_id % 10 == 9 and "ID" not in trailer else W.full)(objects, top, trailer) if doc_id % 2 == 0 else W.full(objects, top, trailer)


def damaged(doc_id: int, text: str) -> bytes:
    """A plain file without a usable cross-reference table, or with wrong stream lengths, or a wrong root."""
    data = plain(doc_id, text)
    if doc_id % 3 == 0:
        return data[: data.rfind(b"xref\n0")]
    if doc_id % 3 == 1:
        return data.replace(b"/Length ", b"/Length 9")
    return data.replace(b"/Root 1 0 R", b"/Root 99 0 R")


MAKERS = {"plain": plain, "rich": rich, "damaged": damaged}


def to_pdf(docs: DataFrame, kind: str = "plain", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and content: one file a row; a null text is an empty page. No shuffle."""
    make = MAKERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(i, t or "") for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, content binary")


__all__ = ["MAKERS", "damaged", "plain", "rich", "to_pdf", "zlib"]
