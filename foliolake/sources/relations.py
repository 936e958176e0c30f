"""Relations of PDF files: one pass over each file's bytes, many schemas.

A scan takes a DataFrame with an id and a BINARY column and returns one
relation. A file that cannot be read gives no rows there and one row in the
relation `errors`; it never fails the task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .pdf_core import File, Lexer, Name, Ref, Stream, instructions
from .pdf_text import IDENTITY, Fold, point, text_string

RECT = "llx double, lly double, urx double, ury double"
SCHEMAS: dict[str, str] = {
    "files": "version string, n_objects long, n_pages long, rebuilt boolean, encrypted boolean, linearized boolean, n_startxref long, length long",
    "errors": "error string",
    "trailers": "keys array<string>, has_id boolean, encrypted boolean",
    "xref": "obj_num long, gen long, kind string, place long, idx long",
    "objects": "obj_num long, gen long, cos_type string, type string, subtype string, n_keys long, keys array<string>, is_stream boolean, stream_length long, value string",
    "refs": "obj_num long, path string, target long",
    "pages": f"page_no long, obj_num long, rotate long, {RECT}, crop_llx double, crop_lly double, crop_urx double, crop_ury double, keys array<string>",
    "operators": "page_no long, op_idx long, op string, n_operands long, operands array<string>, numbers array<double>",
    "fragments": "page_no long, frag_idx long, text string, x double, y double, width double, size double, rotation long, font string, font_name string, op_idx long",
    "images": "page_no long, name string, a double, b double, c double, d double, e double, f double, op_idx long",
    "resources": "page_no long, category string, name string, obj_num long, subtype string, keys array<string>, attrs map<string,string>, output_intents array<string>",
    "fonts": "obj_num long, base_font string, subtype string, encoding string, has_descriptor boolean, embedded boolean, keys array<string>, descriptor_keys array<string>",
    "annotations": f"page_no long, annot_idx long, subtype string, contents string, name string, title string, flags long, {RECT}, action string, uri string, dest_page long, keys array<string>",
    "fields": "ord long, name string, kind string, value string, flags long, n_kids long, keys array<string>",
    "outlines": "ord long, level long, title string, page_no long, open boolean, n_children long, parent long",
    "destinations": "ord long, name string, page_no long, fit string, source string",
    "labels": "start long, style string, prefix string, first long",
    "info": "key string, value string",
    "xmp": "key string, value string",
    "attachments": "name string, description string, mime string, size long, data binary",
    "signatures": "name string, filter string, reason string, location string, date string, byte_range array<long>, contents_length long, digest string",
    "struct_elements": "ord long, level long, kind string, n_kids long, mcids array<long>",
    "actions": "place string, page_no long, kind string",
    "catalogs": "keys array<string>, marked string, lang string, need_appearances string, has_xfa boolean, needs_rendering string, output_intents array<string>, metadata string, metadata_filter boolean, embedded_files boolean",
}
PAGE_GROUPS = ("Font", "XObject", "ExtGState", "ColorSpace", "Pattern", "Shading", "Properties")


def _num(x) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def _int(x) -> int | None:
    return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def _said(f: File, x) -> str | None:
    """A value as text: strings decoded, containers as JSON."""
    x = f.get(x)
    if x is None or isinstance(x, (str, bytes)):
        return text_string(x)
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return f"{x:g}"
    return _json(x)


def _plain(x):
    if isinstance(x, Ref):
        return f"{x.num} {x.gen} R"
    if isinstance(x, Stream):
        return {"stream": len(x.raw), **_plain(x.attrs)}
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return text_string(x) if isinstance(x, bytes) else x


_encoded, _quoted = json.JSONEncoder(ensure_ascii=False).encode, json.encoder.encode_basestring


def _json(x) -> str:
    """_plain(x) as JSON, at once."""
    kind = type(x)
    if kind is Ref:
        return f'"{x.num} {x.gen} R"'
    if kind is Name or kind is str:
        return _quoted(x)
    if kind is int:
        return str(x)
    if kind is dict:
        return "{" + ", ".join([f"{_quoted(k)}: {_json(v)}" for k, v in x.items()]) + "}"
    if kind is list:
        return "[" + ", ".join([_json(v) for v in x]) + "]"
    if kind is bytes:
        return _quoted(text_string(x))
    if kind is Stream and "stream" not in x.attrs:
        return "{" + ", ".join([f'"stream": {len(x.raw)}', *[f"{_quoted(k)}: {_json(v)}" for k, v in x.attrs.items()]]) + "}"
    return _encoded(_plain(x))


def _dict(f: File, x) -> dict:
    x = f.get(x)
    return x.attrs if isinstance(x, Stream) else x if isinstance(x, dict) else {}


def _list(f: File, x) -> list:
    x = f.get(x)
    return x if isinstance(x, list) else []


def _rect(f: File, x) -> list:
    got = [_num(f.get(v)) for v in _list(f, x)]
    if len(got) != 4 or None in got:
        return [None] * 4
    return [min(got[0], got[2]), min(got[1], got[3]), max(got[0], got[2]), max(got[1], got[3])]


_KINDS = {bool: "boolean", int: "integer", float: "real", Name: "name", bytes: "string", Ref: "reference", list: "array", dict: "dictionary", Stream: "stream"}


def _kind(x) -> str:
    return _KINDS.get(type(x), "null")


def _catalog(f: File) -> dict:
    return _dict(f, f.trailer.get("Root"))


def _output_intents(f: File) -> list | None:
    c = _catalog(f)
    return [_said(f, _dict(f, x).get("S")) for x in _list(f, c["OutputIntents"])] if "OutputIntents" in c else None


def _page_of(f: File, pages: list[dict], dest) -> int | None:
    dest = f.get(dest)
    if isinstance(dest, dict):
        dest = f.get(dest.get("D"))
    if isinstance(dest, (bytes, Name)):
        want = text_string(dest)
        return next((p for n, p, _, _ in _named(f, pages) if n == want), None)
    if isinstance(dest, list) and dest:
        if isinstance(dest[0], Ref):
            return next((i for i, p in enumerate(pages, 1) if p["__ref"] == dest[0]), None)
        n = _int(dest[0])
        return n + 1 if n is not None else None
    return None


def tree(f: File, root, leaf: str) -> Iterator[tuple]:
    """Pairs of a name tree (leaf Names) or number tree (leaf Nums), in order."""
    todo, seen = [root], 0
    while todo and seen < 100_000:
        seen += 1
        node = _dict(f, todo.pop())
        flat = _list(f, node.get(leaf))
        yield from ((f.get(k), v) for k, v in zip(flat[::2], flat[1::2]))
        todo += list(reversed(_list(f, node.get("Kids"))))


def _named(f: File, pages: list[dict]) -> Iterator[tuple]:
    catalog, seen = _catalog(f), set()
    both = [("tree", text_string(k), v) for k, v in tree(f, _dict(f, catalog.get("Names")).get("Dests"), "Names")]
    both += [("legacy", k, v) for k, v in _dict(f, catalog.get("Dests")).items()]
    for source, name, v in both:
        if name not in seen:
            seen.add(name)
            d = f.get(v)
            d = f.get(d.get("D")) if isinstance(d, dict) else d
            fit = str(d[1]) if isinstance(d, list) and len(d) > 1 else None
            yield name, _page_of(f, pages, d) if isinstance(d, list) else None, fit, source


def _files(f: File):
    head = f.data[:2048]
    yield [f.version, len(f.refs()), len(f.pages()), f.rebuilt, "Encrypt" in f.trailer, b"/Linearized" in head, f.data.count(b"startxref"), len(f.data)]


def _trailers(f: File):
    yield [sorted(f.trailer), isinstance(f.get(f.trailer.get("ID")), list), "Encrypt" in f.trailer]


def _xref(f: File):
    for r, place in sorted(f.places.items()):
        yield [r.num, max(r.gen, 0), *("free", None, None)] if not place else [r.num, r.gen, "in use" if len(place) == 1 else "compressed", place[0], place[1] if len(place) > 1 else None]


def _objects(f: File):
    for r in f.refs():
        x = f.get(r)
        d = x.attrs if isinstance(x, Stream) else x if isinstance(x, dict) else {}
        said = [text_string(d.get(k)) if isinstance(d.get(k), Name) else None for k in ("Type", "Subtype")]
        yield [r.num, r.gen, _kind(x), *said, len(d), list(d), isinstance(x, Stream), len(x.raw) if isinstance(x, Stream) else None, _json(x)]


def _refs(f: File):
    def walk(x, path: str):
        if isinstance(x, Ref):
            yield path, x.num
        elif isinstance(x, Stream):
            yield from walk(x.attrs, path)
        elif isinstance(x, dict):
            for k, v in x.items():
                yield from walk(v, f"{path}/{k}")
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from walk(v, f"{path}[{i}]")

    for k, v in f.trailer.items():
        yield from ([0, p, t] for p, t in walk(v, f"/{k}"))
    for r in f.refs():
        yield from ([r.num, p, t] for p, t in walk(f.get(r), ""))


def _pages(f: File):
    for i, p in enumerate(f.pages(), 1):
        media = _rect(f, p.get("MediaBox"))
        crop = _rect(f, p.get("CropBox")) if "CropBox" in p else media
        turn = _int(f.get(p.get("Rotate"))) or 0
        yield [i, p["__ref"].num if p["__ref"] else None, turn % 360, *media, *crop, sorted(k for k in p if k != "__ref")]


def _operators(f: File):
    for i, p in enumerate(f.pages(), 1):
        for k, (op, args) in enumerate(instructions(f.content(p)), 1):
            yield [i, k, op, len(args), [text_string(a) if isinstance(a, (bytes, str)) else json.dumps(_plain(a)) for a in args], [float(a) for a in args if _num(a) is not None]]


def _fragments(f: File):
    for i, p in enumerate(f.pages(), 1):
        fold = Fold(f)
        fold.run(f.content(p), f.get(p.get("Resources")))
        for k, (text, x, y, width, size, turn, font, name, at) in enumerate(fold.fragments, 1):
            yield [i, k, text, x, y, width, size, turn, font, name, at + 1]


def _images(f: File):
    for i, p in enumerate(f.pages(), 1):
        fold = Fold(f)
        fold.run(f.content(p), f.get(p.get("Resources")))
        for name, m, at in fold.images:
            yield [i, name, *m, at + 1]


def _resources(f: File):
    intents = _output_intents(f)
    for i, p in enumerate(f.pages(), 1):
        own = _dict(f, p.get("Resources"))
        for group in PAGE_GROUPS:
            for name, v in _dict(f, own.get(group)).items():
                d = _dict(f, v)
                yield [i, group, name, v.num if isinstance(v, Ref) else None, _said(f, d.get("Subtype")), sorted(d), {k: _said(f, x) for k, x in d.items() if k not in ("Parent",)}, intents]


def _fonts(f: File):
    for r in f.refs():
        x = f.get(r)
        if isinstance(x, dict) and x.get("Type") == "Font":
            d = _dict(f, x.get("FontDescriptor"))
            yield [r.num, _said(f, x.get("BaseFont")), _said(f, x.get("Subtype")), _said(f, x.get("Encoding")), bool(d), any(k in d for k in ("FontFile", "FontFile2", "FontFile3")), sorted(x), sorted(d)]


def _annotations(f: File):
    pages = f.pages()
    for i, p in enumerate(pages, 1):
        for k, a in enumerate(_list(f, p.get("Annots")), 1):
            d = _dict(f, a)
            act = _dict(f, d.get("A"))
            page = _page_of(f, pages, d["Dest"]) if "Dest" in d else _page_of(f, pages, act["D"]) if "D" in act else None
            yield [i, k, _said(f, d.get("Subtype")), _said(f, d.get("Contents")), _said(f, d.get("NM")), _said(f, d.get("T")), _int(f.get(d.get("F"))) or 0, *_rect(f, d.get("Rect")), _said(f, act.get("S")), _said(f, act.get("URI")), page, sorted(d)]


def _fields(f: File):
    out = []

    def walk(x, above: str, held: dict, depth: int) -> None:
        d = _dict(f, x)
        name = _said(f, d.get("T"))
        full = ".".join(n for n in (above, name) if n)
        held = held | {k: d[k] for k in ("FT", "V", "Ff") if k in d}
        kids = [k for k in _list(f, d.get("Kids")) if "T" in _dict(f, k)]
        if kids and depth < 64:
            for k in kids:
                walk(k, full, held, depth + 1)
        elif full:
            flags = _int(f.get(held.get("Ff"))) or 0
            form = _said(f, held.get("FT"))
            kind = {"Tx": "text", "Sig": "signature", "Ch": "combo" if flags >> 17 & 1 else "list", "Btn": "push" if flags >> 16 & 1 else "radio" if flags >> 15 & 1 else "check"}.get(form or "", "unknown")
            out.append([len(out) + 1, full, kind, _said(f, held.get("V")), flags, len(_list(f, d.get("Kids"))), sorted(d)])

    for x in _list(f, _dict(f, _catalog(f).get("AcroForm")).get("Fields")):
        walk(x, "", {}, 0)
    return out


def _outlines(f: File):
    pages, out, seen = f.pages(), [], set()

    def walk(ref, level: int, parent: int | None) -> int:
        n = 0
        while isinstance(d := f.get(ref), dict) and id(d) not in seen and level < 64:
            seen.add(id(d))
            n += 1
            place = len(out)
            dest = d.get("Dest", _dict(f, d.get("A")).get("D"))
            out.append([place + 1, level, _said(f, d.get("Title")), _page_of(f, pages, dest), (_int(f.get(d.get("Count"))) or 0) >= 0, 0, parent])
            out[place][5] = walk(d.get("First"), level + 1, place + 1)
            ref = d.get("Next")
        return n

    walk(_dict(f, _catalog(f).get("Outlines")).get("First"), 1, None)
    return out


def _destinations(f: File):
    for i, (name, page, fit, source) in enumerate(_named(f, f.pages()), 1):
        yield [i, name, page, fit, source]


def _labels(f: File):
    for start, v in tree(f, _catalog(f).get("PageLabels"), "Nums"):
        d = _dict(f, v)
        yield [_int(start), _said(f, d.get("S")), _said(f, d.get("P")) or "", _int(f.get(d.get("St"))) or 1]


def _info(f: File):
    for k, v in _dict(f, f.trailer.get("Info")).items():
        yield [k, _said(f, v)]


def xmp_properties(xml: str) -> list[tuple[str, str]]:
    """prefix:name and value of simple properties, elements and attributes; the items of arrays joined by ', '."""
    out = []
    for m in re.finditer(r"<rdf:Description\b([^>]*)>", xml):
        out += [(k, _unxml(v)) for k, v in re.findall(r"\b((?!xmlns|rdf)[A-Za-z]\w*:\w+)\s*=\s*[\"']([^\"']*)[\"']", m[1])]
    for m in re.finditer(r"<((?!rdf|x:)[A-Za-z]\w*:\w+)(?:\s[^>]*)?>(.*?)</\1>", xml, re.S):
        items = re.findall(r"<rdf:li[^>]*>(.*?)</rdf:li>", m[2], re.S)
        out.append((m[1], ", ".join(map(_unxml, items)) if items else _unxml(m[2].strip())))
    return out


def _unxml(s: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = s.replace(a, b)
    return s


def _xmp(f: File):
    x = f.get(_catalog(f).get("Metadata"))
    if isinstance(x, Stream):
        yield from (list(p) for p in xmp_properties(f.decoded(x).decode("utf-8", "replace")))


def _attachments(f: File):
    for name, v in tree(f, _dict(f, _catalog(f).get("Names")).get("EmbeddedFiles"), "Names"):
        d = _dict(f, v)
        files = _dict(f, d.get("EF"))
        s = f.get(files.get("UF") or files.get("F"))
        data = f.decoded(s) if isinstance(s, Stream) else None
        yield [_said(f, d.get("UF")) or _said(f, d.get("F")) or text_string(name), _said(f, d.get("Desc")), _said(f, s.attrs.get("Subtype")) if isinstance(s, Stream) else None, len(data) if data is not None else None, data]


def _signatures(f: File):
    def walk(x, above: str, depth: int):
        d = _dict(f, x)
        full = ".".join(n for n in (above, _said(f, d.get("T"))) if n)
        v = _dict(f, d.get("V"))
        if d.get("FT") == "Sig" and v:
            span = [int(n) for n in _list(f, v.get("ByteRange")) if _int(n) is not None]
            signed = b"".join(f.data[a : a + n] for a, n in zip(span[::2], span[1::2]))
            body = f.get(v.get("Contents"))
            yield [full, _said(f, v.get("Filter")), _said(f, v.get("Reason")), _said(f, v.get("Location")), _said(f, v.get("M")), span, len(body) if isinstance(body, bytes) else None, hashlib.sha256(signed).hexdigest()]
        for k in _list(f, d.get("Kids")) if depth < 64 else []:
            yield from walk(k, full, depth + 1)

    for x in _list(f, _dict(f, _catalog(f).get("AcroForm")).get("Fields")):
        yield from walk(x, "", 0)


def _struct(f: File):
    out = []

    def walk(x, level: int) -> None:
        d = f.get(x)
        if not isinstance(d, dict) or level > 100:
            return
        kids = f.get(d.get("K"))
        kids = kids if isinstance(kids, list) else [] if kids is None else [kids]
        if d.get("S") is not None:
            marks = [int(k) for k in kids if _int(k) is not None] + [int(m) for k in kids if (m := _int(_dict(f, k).get("MCID"))) is not None]
            out.append([len(out) + 1, level, _said(f, d.get("S")), len(kids), marks])
            level += 1
        for k in kids:
            if isinstance(f.get(k), dict):
                walk(k, level)

    walk(_catalog(f).get("StructTreeRoot"), 1)
    return out


def _actions(f: File):
    catalog = _catalog(f)
    act = _dict(f, catalog.get("OpenAction"))
    if act.get("S"):
        yield ["catalog", None, _said(f, act.get("S"))]
    if "AA" in catalog:
        yield ["catalog/AA", None, None]
    for i, p in enumerate(f.pages(), 1):
        if "AA" in p:
            yield ["page/AA", i, None]
        for a in _list(f, p.get("Annots")):
            d = _dict(f, a)
            if "AA" in d:
                yield ["annotation/AA", i, None]
            todo, n = [d.get("A")], 0
            while todo and n < 64:
                n += 1
                act = _dict(f, todo.pop())
                if act.get("S"):
                    yield ["annotation", i, _said(f, act.get("S"))]
                more = f.get(act.get("Next"))
                todo += more if isinstance(more, list) else [more] if more else []


def _catalogs(f: File):
    c = _catalog(f)
    form = _dict(f, c.get("AcroForm"))
    meta = f.get(c.get("Metadata"))
    text = f.decoded(meta).decode("utf-8", "replace") if isinstance(meta, Stream) else None
    yield [sorted(c), _said(f, _dict(f, c.get("MarkInfo")).get("Marked")), _said(f, c.get("Lang")), _said(f, form.get("NeedAppearances")), "XFA" in form, _said(f, c.get("NeedsRendering")), _output_intents(f), text, isinstance(meta, Stream) and "Filter" in meta.attrs, "EmbeddedFiles" in _dict(f, c.get("Names"))]


_READ: dict[str, Callable] = {"files": _files, "trailers": _trailers, "xref": _xref, "objects": _objects, "refs": _refs, "pages": _pages, "operators": _operators, "fragments": _fragments, "images": _images, "resources": _resources, "fonts": _fonts, "annotations": _annotations, "fields": _fields, "outlines": _outlines, "destinations": _destinations, "labels": _labels, "info": _info, "xmp": _xmp, "attachments": _attachments, "signatures": _signatures, "struct_elements": _struct, "actions": _actions, "catalogs": _catalogs}


def rows_of(data: bytes, relation: str) -> list[list]:
    """The rows of one file, without its id."""
    if relation == "errors":
        try:
            f = File(data)
            if not f.version or not f.refs():
                return [["no PDF header" if not f.version else "no objects"]]
        except Exception as e:
            return [[_failure("file", e)]]
        return [[said] for name in _READ for said in [_read(f, name)[1]] if said]
    try:
        return _read(File(data), relation)[0]
    except Exception:  # the file as a whole; errors has a row
        return []


def _failure(name: str, e: Exception) -> str:
    return f"{name}: {type(e).__name__}: {e}"[:200]


def _read(f: File, relation: str) -> tuple[list[list], str | None]:
    """The relation's rows up to a failure, and what failed."""
    rows: list[list] = []
    try:
        for row in _READ[relation](f):
            rows.append(row)
    except Exception as e:
        return rows, _failure(relation, e)
    return rows, None


def scan(files: DataFrame, relation: str, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """The relation's rows of every file, with its id; a null file gives none. No shuffle."""
    kind = files.schema[id_col].dataType.simpleString()
    spark = files.sparkSession
    schema = spark.createDataFrame([], f"id {kind}, {SCHEMAS[relation]}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list] = []
            for id_, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if data.is_valid:
                    held += [[id_, *row] for row in rows_of(data.as_py(), relation)]
                if len(held) >= 4096:
                    yield _batch(held, arrow)
                    held = []
            if held:
                yield _batch(held, arrow)

    return files.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def scan_all(files: DataFrame, relations: list[str], id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Rows of several relations from one parse of every file: its id, __relation, and a struct __<name> for each, null but for the row's own. No shuffle."""
    kind = files.schema[id_col].dataType.simpleString()
    schema = files.sparkSession.createDataFrame([], f"id {kind}, __relation string, " + ", ".join(f"__{r} struct<{_colons(SCHEMAS[r])}>" for r in relations)).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def flush(held: list[tuple], name: str) -> pa.RecordBatch:
        own = arrow.field(f"__{name}").type
        ids, rows = zip(*held)
        parts = [pa.array(c, t.type) for c, t in zip(zip(*rows), own)]
        mine = pa.StructArray.from_arrays(parts, fields=list(own))
        rest = [mine if r == name else pa.nulls(len(held), arrow.field(f"__{r}").type) for r in relations]
        return pa.RecordBatch.from_arrays([pa.array(ids, arrow.field(0).type), pa.array([name] * len(held), pa.string()), *rest], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {r: [] for r in relations}
        for batch in batches:
            for id_, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not data.is_valid:
                    continue
                try:
                    f = File(data.as_py())
                except Exception:  # the file as a whole; errors has a row
                    continue
                for r in relations:
                    held[r] += [(id_, row) for row in _read(f, r)[0]]
                    if len(held[r]) >= 4096:
                        yield flush(held[r], r)
                        held[r] = []
        yield from (flush(rows, r) for r, rows in held.items() if rows)

    return files.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _colons(fields: str) -> str:
    """Columns as the fields of a struct."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2: ", fields)


def create_views(files: DataFrame, prefix: str = "pdf_", relations: list[str] | None = None) -> list[str]:
    """Temporary views of the relations, for spark.sql; their names. A view is read when a statement uses it."""
    names = list(relations or SCHEMAS)
    for name in names:
        scan(files, name).createOrReplaceTempView(prefix + name)
    return [prefix + name for name in names]


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_pdfs(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """doc_id (the file's path), content, length of every file below path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("doc_id"), "content", "length", "modificationTime")


__all__ = ["IDENTITY", "Lexer", "SCHEMAS", "create_views", "point", "read_pdfs", "rows_of", "scan", "scan_all", "tree", "xmp_properties"]
