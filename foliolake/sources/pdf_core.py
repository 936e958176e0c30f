"""PDF bytes to Python objects: lexer, cross references, recovery, pages, instructions.

Everything here is lenient: what cannot be read becomes None, and files whose
cross references are damaged are read by scanning for objects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from . import codecs


class Name(str):
    """A name object, without its slash."""


class Ref(NamedTuple):
    num: int
    gen: int


class Word(str):
    """A keyword or operator."""


class Stream:
    def __init__(self, attrs: dict, raw: bytes):
        self.attrs, self.raw = attrs, raw


_SPACE = b"\x00\t\n\f\r "
_SKIP = re.compile(rb"(?:[\x00\t\n\f\r ]+|%[^\r\n]*)+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)(?=[\x00\t\n\f\r ()<>\[\]{}/%]|$)")
_REGULAR = re.compile(rb"[^\x00\t\n\f\r ()<>\[\]{}/%]+")
_REF = re.compile(rb"(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?=[\x00\t\n\f\r ()<>\[\]{}/%]|$)")
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b")
#: A whole token of the usual forms behind white space: a reference, a name without #, an integer, a real, a string without escapes and parentheses, << >> [ ].
_TOKEN = re.compile(
    rb"[\x00\t\n\f\r ]*(?:(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z)|/([^\x00\t\n\f\r ()<>\[\]{}/%#]*)(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z)"
    rb"|([+-]?\d+)(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z)|([+-]?(?:\d+\.\d*|\.\d+))(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z)|\(([^()\\]*)\)|(<<)|(>>)|(\[)|(\]))"
)
_END = re.compile(rb"[\x00\t\n\f\r ]*endstream")
_ROWS = re.compile(rb"(?:\d{10} \d{5} [nf][\r ][\r\n])*")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_LITERAL = re.compile(rb"[()\\]")


@lru_cache(4096)
def _name(raw: bytes) -> Name:
    return Name(raw.decode("latin-1"))


class Lexer:
    """Tokens of bytes from a position on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        m = _SKIP.match(self.data, self.at)
        if m:
            self.at = m.end()

    def next(self):
        """The next object or Word; StopIteration at the end. References need refs()."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            raise StopIteration
        c = data[at : at + 1]
        if m := _NUMBER.match(data, at):
            self.at = m.end()
            text = m[0]
            return float(text) if b"." in text else int(text)
        if c == b"/":
            m = _REGULAR.match(data, at + 1)
            self.at = m.end() if m else at + 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), m[0]).decode("latin-1") if m else "")
        if c == b"(":
            return self._string()
        if data.startswith(b"<<", at):
            self.at += 2
            return self._dict()
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self._until(b"]")
        if c in b"]{})>":
            self.at += 2 if data.startswith(b">>", at) else 1
            return Word(data[at : self.at].decode("latin-1"))
        m = _REGULAR.match(data, at)
        self.at = m.end()
        word = m[0].decode("latin-1")
        return {"true": True, "false": False, "null": None}.get(word, Word(word))

    def value(self):
        """As next(), with references."""
        self.skip()
        if m := _REF.match(self.data, self.at):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        return self.next()

    def _until(self, close: bytes) -> list:
        out, data, match, is_list = [], self.data, _TOKEN.match, close == b"]"
        while True:
            while m := match(data, self.at):
                self.at, kind = m.end(), m.lastindex
                if kind == 3:
                    out.append(_name(m[3]))
                elif kind == 2:
                    out.append(Ref(int(m[1]), int(m[2])))
                elif kind == 4:
                    out.append(int(m[4]))
                elif kind == 7:
                    out.append(self._dict())
                elif kind == 9:
                    out.append(self._until(b"]"))
                elif kind == 6:
                    out.append(m[6])
                elif kind == 5:
                    out.append(float(m[5]))
                elif is_list == (kind == 10):
                    return out
            self.skip()
            if self.data.startswith(close, self.at):
                self.at += len(close)
                return out
            try:
                x = self.value()
            except StopIteration:
                return out
            if isinstance(x, Word) and x in ("endobj", "endstream", "stream"):
                self.at -= len(x)
                return out
            if not isinstance(x, Word):
                out.append(x)

    def _dict(self) -> dict:
        flat = self._until(b">>")
        keys = flat[: len(flat) - 1 : 2] if len(flat) % 2 else flat[::2]
        if all([type(k) is Name for k in keys]):
            return dict(zip(map(str, keys), flat[1::2]))
        out, i = {}, 0
        while i + 1 < len(flat):
            if isinstance(flat[i], Name):
                out[str(flat[i])] = flat[i + 1]
                i += 2
            else:
                i += 1
        return out

    def _string(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while depth:
            m = _LITERAL.search(data, at)
            if not m:
                out += data[at:]
                at = len(data)
                break
            out += data[at : m.start()]
            at = m.end()
            if m[0] == b"(":
                depth += 1
                out += b"("
            elif m[0] == b")":
                depth -= 1
                out += b")" if depth else b""
            else:
                c = data[at : at + 1]
                octal = re.compile(rb"[0-7]{1,3}").match(data, at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    at = octal.end()
                elif c in b"\r\n":
                    at += 2 if data.startswith(b"\r\n", at) else 1
                else:
                    out += _ESCAPES.get(c, c)
                    at += 1
        self.at = at
        return bytes(out)


class File:
    """One PDF: header, trailer, objects by (num, gen) and how it was read."""

    def __init__(self, data: bytes, cap: int = codecs.CAP):
        self.data, self.cap = data, cap
        m = re.search(rb"%(PDF|FDF)-(\d\.\d)", data[:4096]) or re.search(rb"%(PDF|FDF)-(\d\.\d)", data)
        self.version = m[2].decode() if m else None
        self.trailer: dict = {}
        self.places: dict[Ref, tuple] = {}  # (offset,) or (number of the object stream, index)
        self.rebuilt = False
        self._have: dict[Ref, object] = {}
        self._packs: dict[int, dict[int, object]] = {}
        self._busy: set[Ref] = set()
        self._pages: list[dict] | None = None
        try:
            self._chain()
        except Exception:
            self.places = {}
        if not self.places or not isinstance(self.get(self.trailer.get("Root")), dict) or not self._catalog():
            self._rebuild()

    # cross references

    def _chain(self) -> None:
        at = self.data.rfind(b"startxref")
        todo = [int(re.compile(rb"startxref\s*(\d+)").match(self.data, at)[1])] if at >= 0 else [self.data.rfind(b"xref")]
        seen = set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            trailer = self._table(at) if re.compile(rb"\s*xref\b").match(self.data, at) else self._stream_table(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            todo += [int(trailer[k]) for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), (int, float))]

    def _table(self, at: int) -> dict:
        lex = Lexer(self.data, re.compile(rb"\s*xref").match(self.data, at).end())
        while True:
            first = lex.next()
            if first == "trailer":
                found = lex.value()
                return found if isinstance(found, dict) else {}
            n = lex.next()
            if not isinstance(first, int) or not isinstance(n, int):
                raise ValueError("no cross-reference section")
            lex.skip()
            rows = self.data[lex.at : lex.at + 20 * n] if n > 0 else b""
            if len(rows) == 20 * n and _ROWS.fullmatch(rows):
                lex.at += 20 * n
                for i in range(n):
                    row = rows[20 * i : 20 * i + 18]
                    offset = int(row[:10])
                    if row[17] == 110 and offset:
                        self.places.setdefault(Ref(first + i, min(int(row[11:16]), 65535)), (offset,))
                    else:
                        self.places.setdefault(Ref(first + i, -1), ())
                continue
            for i in range(n):
                offset, gen, kind = lex.next(), lex.next(), lex.next()
                if kind == "n" and offset:
                    self.places.setdefault(Ref(first + i, min(max(int(gen), 0), 65535)), (int(offset),))
                else:
                    self.places.setdefault(Ref(first + i, -1), ())

    def _stream_table(self, at: int) -> dict:
        m = _OBJECT.match(self.data, at) or _OBJECT.search(self.data, at, at + 64)
        found = self._parse(m.end())
        data, attrs = self.decoded(found), found.attrs
        w = [int(x) for x in attrs["W"]]
        index = attrs.get("Index") or [0, attrs["Size"]]
        row = sum(w)
        at = 0
        for first, n in zip(index[::2], index[1::2]):
            for num in range(int(first), int(first) + int(n)):
                raw = data[at : at + row]
                at += row
                if len(raw) < row:
                    break
                a = int.from_bytes(raw[: w[0]], "big") if w[0] else 1
                b, c = int.from_bytes(raw[w[0] : w[0] + w[1]], "big"), int.from_bytes(raw[w[0] + w[1] :], "big")
                if a == 1:
                    self.places.setdefault(Ref(num, c), (b,))
                elif a == 2:
                    self.places.setdefault(Ref(num, 0), (b, c))
                else:
                    self.places.setdefault(Ref(num, -1), ())
        return attrs

    def _rebuild(self) -> None:
        """Every `N G obj` in the file, the last of a number counting; the last catalog is the root."""
        self.rebuilt = True
        self._have, self._packs, self.places = {}, {}, {}
        for m in _OBJECT.finditer(self.data):
            self.places[Ref(int(m[1]), int(m[2]))] = (m.start(),)
        for m in re.finditer(rb"\btrailer\b", self.data):
            try:
                found = Lexer(self.data, m.end()).value()
            except StopIteration:
                continue
            if isinstance(found, dict):
                self.trailer |= found
        for ref in list(self.places):
            found = self.get(ref)
            if isinstance(found, Stream) and found.attrs.get("Type") == "ObjStm":
                for i, num in enumerate(self._pack(ref.num, found)):
                    self.places.setdefault(Ref(num, 0), (ref.num, i))
        if not self._catalog():
            roots = [r for r in self.places if isinstance(x := self.get(r), dict) and x.get("Type") == "Catalog"]
            if roots:
                self.trailer["Root"] = roots[-1]

    def _catalog(self) -> dict | None:
        found = self.get(self.trailer.get("Root"))
        return found if isinstance(found, dict) and (found.get("Type") == "Catalog" or "Pages" in found) else None

    # objects

    def _parse(self, at: int):
        lex = Lexer(self.data, at)
        if (m := _TOKEN.match(self.data, at)) and m.lastindex == 7:
            lex.at = m.end()
            value = lex._dict()
        else:
            value = lex.value()
        if not isinstance(value, dict):
            return value
        lex.skip()
        if not self.data.startswith(b"stream", lex.at):
            return value
        start = lex.at + 6
        start += 2 if self.data.startswith(b"\r\n", start) else 1 if self.data[start : start + 1] in (b"\n", b"\r") else 0
        n = self.get(value.get("Length"))
        end = start + int(n) if isinstance(n, (int, float)) and n >= 0 else -1
        if end < 0 or end > len(self.data) or not _END.match(self.data, end):
            end = self.data.find(b"endstream", start)
            end = len(self.data) if end < 0 else end
            if self.data[end - 2 : end] == b"\r\n":
                end -= 2
            elif self.data[end - 1 : end] in (b"\n", b"\r"):
                end -= 1
        return Stream(value, self.data[start:end])

    def _pack(self, num: int, stream: Stream) -> dict[int, object]:
        if num not in self._packs:
            data, attrs, out = self.decoded(stream), stream.attrs, {}
            lex, first = Lexer(data), int(self.get(attrs.get("First")) or 0)
            pairs = [(lex.next(), lex.next()) for _ in range(int(self.get(attrs.get("N")) or 0))]
            for n, at in pairs:
                out[int(n)] = Lexer(data, first + int(at)).value()
            self._packs[num] = out
        return self._packs[num]

    def get(self, x):
        """What a reference points to; anything else is itself. Missing and circular references are None."""
        hops = 0
        while isinstance(x, Ref):
            hops += 1
            if hops > 32 or x in self._busy:
                return None
            x = self._load(x)
        return x

    def _load(self, ref: Ref):
        if ref in self._have:
            return self._have[ref]
        place = self.places.get(ref)
        self._busy.add(ref)
        try:
            if not place:
                found = None
            elif len(place) == 1:
                m = _OBJECT.search(self.data, max(0, place[0] - 1), place[0] + 32)
                if not m or int(m[1]) != ref.num:
                    raise ValueError("no object there") if not self.rebuilt else LookupError
                found = self._parse(m.end())
            else:
                holder = self._load(Ref(place[0], 0))
                found = self._pack(place[0], holder).get(ref.num) if isinstance(holder, Stream) else None
        except ValueError:
            m = list(re.finditer(rb"(?<!\d)%d\s+%d\s+obj\b" % ref, self.data))
            try:
                found = self._parse(m[-1].end()) if m else None
            except (StopIteration, ValueError):
                found = None
        except (StopIteration, LookupError, TypeError):
            found = None
        finally:
            self._busy.discard(ref)
        self._have[ref] = found
        return found

    def decoded(self, stream: Stream) -> bytes:
        names, params = self.get(stream.attrs.get("Filter", stream.attrs.get("F"))), self.get(stream.attrs.get("DecodeParms", stream.attrs.get("DP")))
        names = [names] if isinstance(names, Name) else [self.get(n) for n in names or []] if not isinstance(names, (dict, bytes)) else []
        params = [params] if isinstance(params, dict) else [self.get(p) for p in params or []]
        params = [{k: self.get(v) for k, v in p.items()} if isinstance(p, dict) else {} for p in params]
        return codecs.decode_chain(stream.raw, [str(n) for n in names], params, self.cap)

    def refs(self) -> list[Ref]:
        return sorted(r for r, place in self.places.items() if place)

    # pages

    def pages(self) -> list[dict]:
        """Pages in tree order with inherited attributes; if /Count says there are more, page-like objects outside the tree follow. Read once, not to be changed."""
        if self._pages is None:
            self._pages = self._find_pages()
        return self._pages

    def _find_pages(self) -> list[dict]:
        catalog = self._catalog() or {}
        out, seen = [], set()

        def walk(ref, held: dict) -> None:
            node = self.get(ref)
            key = ref if isinstance(ref, Ref) else id(node)
            if not isinstance(node, dict) or key in seen:
                return
            seen.add(key)
            held = held | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                for kid in kids:
                    walk(kid, held)
            elif node.get("Type") == "Page" or "Contents" in node or "MediaBox" in node:
                out.append(held | node | {"__ref": ref if isinstance(ref, Ref) else None})

        walk(catalog.get("Pages"), {})
        root = self.get(catalog.get("Pages"))
        said = self.get(root.get("Count")) if isinstance(root, dict) else None
        if isinstance(said, int) and said > len(out) or not out and self.rebuilt:
            have = {p["__ref"] for p in out}
            for ref in self.refs():
                if ref not in have and isinstance(x := self.get(ref), dict) and x.get("Type") == "Page" and (not isinstance(said, int) or len(out) < said):
                    out.append(x | {"__ref": ref})
        return out

    def content(self, page: dict) -> bytes:
        found = self.get(page.get("Contents"))
        parts = found if isinstance(found, list) else [found]
        return b"\n".join(self.decoded(s) for p in parts if isinstance(s := self.get(p), Stream))


def instructions(data: bytes) -> Iterator[tuple[str, list]]:
    """(operator, operands) in order; what is malformed is skipped, an inline image is one BI."""
    lex, held = Lexer(data), []
    while True:
        try:
            x = lex.next()
        except StopIteration:
            return
        if not isinstance(x, Word):
            held.append(x)
        elif x in ("]", "}", "{", ")", ">", ">>"):
            continue
        elif x == "BI":
            attrs = []
            while True:
                try:
                    y = lex.next()
                except StopIteration:
                    return
                if y == "ID":
                    break
                attrs.append(y)
            end = re.compile(rb"[\x00\t\n\f\r ]EI(?=[\x00\t\n\f\r ]|$)").search(data, lex.at)
            body = data[lex.at + 1 : end.start() if end else len(data)]
            lex.at = end.end() if end else len(data)
            yield "BI", [dict(zip(map(str, attrs[::2]), attrs[1::2])), body]
            held = []
        else:
            yield str(x), held
            held = []
