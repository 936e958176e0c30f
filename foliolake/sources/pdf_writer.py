"""A writer of plain PDF files: classic or compressed cross references, and appended revisions."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from .pdf_core import Name, Ref, Stream


@lru_cache(4096)
def _name(x: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c < 127 and chr(c) not in "#()<>[]{}/%" else b"#%02X" % c for c in x.encode("latin-1", "replace"))


def serial(x) -> bytes:
    kind = type(x)
    if kind is Name:
        return _name(x)
    if kind is dict:
        return b"<<" + b" ".join([_name(k) + b" " + serial(v) for k, v in x.items()]) + b">>"
    if kind is int:
        return b"%d" % x
    if kind is list:
        return b"[" + b" ".join([serial(v) for v in x]) + b"]"
    if isinstance(x, Ref):
        return b"%d %d R" % x
    if x is None:
        return b"null"
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, int):
        return str(x).encode()
    if isinstance(x, float):
        return f"{x:.6f}".rstrip("0").rstrip(".").encode() or b"0"
    if isinstance(x, Name):
        return _name(str(x))
    if isinstance(x, str):
        try:
            x = x.encode("ascii")
        except UnicodeEncodeError:
            x = b"\xfe\xff" + x.encode("utf-16-be")
    if isinstance(x, (bytes, bytearray)):
        return b"(" + bytes(x).replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"
    if isinstance(x, (list, tuple)):
        return b"[" + b" ".join(map(serial, x)) + b"]"
    if isinstance(x, dict):
        return b"<<" + b" ".join([_name(str(k)) + b" " + serial(v) for k, v in x.items()]) + b">>"
    if isinstance(x, Stream):
        return serial(x.attrs | {"Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream"
    raise TypeError(type(x))


def _objects(objects: dict[int, object], base: int) -> tuple[bytes, dict[int, int]]:
    out, places = bytearray(), {}
    for num in sorted(objects):
        places[num] = base + len(out)
        out += b"%d 0 obj\n" % num + serial(objects[num]) + b"\nendobj\n"
    return bytes(out), places


def full(objects: dict[int, object], root: int, trailer: dict | None = None) -> bytes:
    """Header, objects by number, rows of 20 bytes, trailer."""
    head = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"
    body, places = _objects(objects, len(head))
    n = max(objects, default=0) + 1
    rows = b"".join(b"%010d 00000 n \n" % places[i] if i in places else b"0000000000 65535 f \n" for i in range(n))
    tail = {"Size": n, "Root": Ref(root, 0)} | (trailer or {})
    return head + body + b"xref\n0 %d\n" % n + rows + b"trailer\n" + serial(tail) + b"\nstartxref\n%d\n%%%%EOF\n" % (len(head) + len(body))


def compressed(objects: dict[int, object], root: int, per_stream: int = 100) -> bytes:
    """Objects other than streams in object streams, and a cross-reference stream."""
    head = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"
    plain = [i for i in sorted(objects) if not isinstance(objects[i], Stream)]
    loose, packed, n = {i: objects[i] for i in objects if isinstance(objects[i], Stream)}, {}, max(objects, default=0) + 1
    for at in range(0, len(plain), per_stream):
        own = plain[at : at + per_stream]
        parts = [serial(objects[i]) for i in own]
        offsets, where = [], 0
        for p in parts:
            offsets.append(where)
            where += len(p) + 1
        index = b" ".join(b"%d %d" % (i, o) for i, o in zip(own, offsets)) + b" "
        loose[n] = Stream({"Type": Name("ObjStm"), "N": len(own), "First": len(index), "Filter": Name("FlateDecode")}, zlib.compress(index + b" ".join(parts)))
        packed |= {num: (n, k) for k, num in enumerate(own)}
        n += 1
    body, places = _objects(loose, len(head))
    start, rows = len(head) + len(body), bytearray()
    places[n] = start
    for i in range(n + 1):
        kind, a, b = (2, *packed[i]) if i in packed else (1, places[i], 0) if i in places else (0, 0, 255)
        rows += bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big")
    table = Stream({"Type": Name("XRef"), "Size": n + 1, "W": [1, 4, 2], "Root": Ref(root, 0), "Filter": Name("FlateDecode")}, zlib.compress(bytes(rows)))
    return head + body + b"%d 0 obj\n" % n + serial(table) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % start


def appended(data: bytes, changed: dict[int, object], root: int, size: int, previous: int) -> bytes:
    """A revision: changed objects, their rows and a trailer that points to the one before."""
    data = data if data.endswith(b"\n") else data + b"\n"
    body, places = _objects(changed, len(data))
    rows = b"".join(b"%d 1\n%010d 00000 n \n" % (i, places[i]) for i in sorted(places))
    tail = {"Size": max(size, max(changed, default=0) + 1), "Root": Ref(root, 0), "Prev": previous}
    return data + body + b"xref\n" + rows + b"trailer\n" + serial(tail) + b"\nstartxref\n%d\n%%%%EOF\n" % (len(data) + len(body))


_C1 = re.compile("[\x80-\x9f]")


def show(text: str) -> bytes:
    """Text as an operand, in WinAnsi; other characters become ?."""
    raw = text.encode("cp1252", "replace") if not _C1.search(text) else text.encode("latin-1", "replace")
    return serial(raw)


def text_pages(text: str, per_page: int = 50, size: float = 12, pitch: float = 14, left: float = 72, top: float = 792) -> list[bytes]:
    """Instructions of pages of per_page lines: one Tj a line, at y = top - pitch * line."""
    lines = text.split("\n")
    out = []
    for at in range(0, len(lines), per_page):
        ops = [b"BT /F1 %g Tf" % size]
        ops += [b"1 0 0 1 %g %g Tm " % (left, top - pitch * i) + show(line) + b" Tj" for i, line in enumerate(lines[at : at + per_page])]
        out.append(b"\n".join([*ops, b"ET"]))
    return out


def document(pages: list[bytes], info: dict | None = None, flate: bool = True, box: tuple = (0, 0, 612, 806), more: dict[int, object] | None = None, catalog: dict | None = None) -> tuple[dict[int, object], int, dict]:
    """(objects, number of the root, trailer) of a document with one font. Numbers: 1 catalog, 2 pages, 3 font, then a page and its content each."""
    objects: dict[int, object] = {3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}}
    kids = []
    for i, ops in enumerate(pages):
        num = 4 + 2 * i
        objects[num] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(num + 1, 0)}
        objects[num + 1] = Stream({"Filter": Name("FlateDecode")}, zlib.compress(ops)) if flate else Stream({}, ops)
        kids.append(Ref(num, 0))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": list(box), "Resources": {"Font": {"F1": Ref(3, 0)}}}
    objects[1] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)} | (catalog or {})
    objects |= more or {}
    trailer = {}
    if info:
        num = max(objects) + 1
        objects[num] = info
        trailer["Info"] = Ref(num, 0)
    return objects, 1, trailer
