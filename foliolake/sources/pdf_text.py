"""Positioned text of a page: a fold over its instructions, and decoding of character codes."""

from __future__ import annotations

import math
import re

from .pdf_core import File, Lexer, Name, Stream, instructions

# Helvetica's advance widths for codes 32 to 126, in thousandths.
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def multiply(a: tuple, b: tuple) -> tuple:
    """a applied first, then b."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def point(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def cmap(data: bytes) -> dict[int, str]:
    """Codes to text from bfchar and bfrange sections."""
    text = lambda b: b.decode("utf-16-be", "replace") if isinstance(b, bytes) else ""
    out: dict[int, str] = {}
    for op, args in instructions(data):
        if op == "endbfchar":
            for code, to in zip(args[::2], args[1::2]):
                if isinstance(code, bytes):
                    out[int.from_bytes(code, "big")] = text(to)
        elif op == "endbfrange":
            for low, high, to in zip(args[::3], args[1::3], args[2::3]):
                if not isinstance(low, bytes) or not isinstance(high, bytes):
                    continue
                a, b = int.from_bytes(low, "big"), min(int.from_bytes(high, "big"), int.from_bytes(low, "big") + 65535)
                for i in range(a, b + 1):
                    if isinstance(to, list):
                        out[i] = text(to[i - a]) if i - a < len(to) else ""
                    elif isinstance(to, bytes) and to:
                        out[i] = text((int.from_bytes(to, "big") + i - a).to_bytes(len(to), "big"))
    return out


class Font:
    def __init__(self, file: File, attrs: dict | None):
        attrs = attrs if isinstance(attrs, dict) else {}
        get = lambda d, k: file.get(d.get(k)) if isinstance(d, dict) else None
        self.name = str(get(attrs, "BaseFont") or "")
        self.composite = get(attrs, "Subtype") == "Type0"
        mapped = get(attrs, "ToUnicode")
        self.to_unicode = cmap(file.decoded(mapped)) if isinstance(mapped, Stream) else None
        encoding = get(attrs, "Encoding")
        self.table, self.charset = {}, "cp1252"
        base = encoding if isinstance(encoding, Name) else get(encoding, "BaseEncoding")
        if base == "MacRomanEncoding":
            self.charset = "mac-roman"
        code = 0
        for x in get(encoding, "Differences") or [] if isinstance(encoding, dict) else []:
            if isinstance(x, (int, float)):
                code = int(x)
            elif isinstance(x, Name):
                self.table[code] = glyph_text(x)
                code += 1
        self.first, self.widths, self.default = int(get(attrs, "FirstChar") or 0), get(attrs, "Widths"), 0.0
        if self.composite:
            below = file.get((get(attrs, "DescendantFonts") or [None])[0])
            self.default = float(get(below, "DW") or 1000)
            self.cid = self._cid_widths(get(below, "W") or [], file)

    @staticmethod
    def _cid_widths(w: list, file: File) -> dict[int, float]:
        out, i = {}, 0
        w = [file.get(x) for x in w]
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                out |= {int(w[i]) + k: float(x) for k, x in enumerate(w[i + 1])}
                i += 2
            elif i + 2 < len(w):
                out |= dict.fromkeys(range(int(w[i]), min(int(w[i + 1]), int(w[i]) + 65535) + 1), float(w[i + 2]))
                i += 3
            else:
                break
        return out

    def codes(self, data: bytes) -> list[int]:
        return [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2)] if self.composite else list(data)

    def decode(self, data: bytes) -> str:
        out = []
        for code in self.codes(data):
            if self.to_unicode is not None and code in self.to_unicode:
                out.append(self.to_unicode[code])
            elif code in self.table:
                out.append(self.table[code])
            elif self.composite:
                out.append(chr(code) if code < 0x110000 else "\ufffd")
            else:
                out.append(bytes([code]).decode(self.charset, "replace") if code not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(code))
        return "".join(out)

    def width(self, code: int) -> float:
        if self.composite:
            return self.cid.get(code, self.default)
        if isinstance(self.widths, list) and 0 <= code - self.first < len(self.widths) and isinstance(self.widths[code - self.first], (int, float)):
            return float(self.widths[code - self.first])
        return float(HELVETICA[code - 32]) if 32 <= code < 127 else 556.0


def glyph_text(name: str) -> str:
    """uniXXXX and uXXXXX forms, single letters, and the commonest names."""
    # Glyph names of ASCII and some Latin signs.
    known = {"space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}", "bullet": "•", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "fi": "ﬁ", "fl": "ﬂ", "germandbls": "ß", "eacute": "é", "egrave": "è", "agrave": "à", "ccedilla": "ç", "ntilde": "ñ", "adieresis": "ä", "odieresis": "ö", "udieresis": "ü", "Euro": "€", "copyright": "©"}
    base = name.split(".")[0]
    if base in known:
        return known[base]
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})", base) or re.fullmatch(r"u([0-9A-Fa-f]{4,6})", base):
        return chr(min(int(m[1], 16), 0x10FFFF))
    return base if len(base) == 1 else "\ufffd"


def quantized(angle: float) -> int:
    return int(round(math.degrees(angle) / 90.0)) * 90 % 360


class Fold:
    """Runs instructions of a page and of the forms it draws; fragments, placements and marks come out in order."""

    def __init__(self, file: File):
        self.file, self.fragments, self.images, self.points = file, [], [], []
        self._fonts: dict[int, Font] = {}
        self._depth = 0

    def run(self, data: bytes, resources, ctm: tuple = IDENTITY, top: bool = True) -> None:
        get = self.file.get
        resources = resources if isinstance(resources, dict) else {}
        state = {"ctm": ctm, "font": None, "name": "", "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0, "fill": (0.0,), "mode": 0}
        stack, tm, tlm = [], IDENTITY, IDENTITY
        kind = lambda group: get(resources.get(group)) if isinstance(get(resources.get(group)), dict) else {}
        for at, (op, args) in enumerate(instructions(data)):
            try:
                if op == "q":
                    stack.append(dict(state))
                elif op == "Q":
                    state = stack.pop() if stack else state
                elif op == "cm":
                    state["ctm"] = multiply(tuple(map(float, args[:6])), state["ctm"])
                elif op == "BT":
                    tm = tlm = IDENTITY
                elif op == "Tf":
                    found = get(kind("Font").get(str(args[0])))
                    if id(found) not in self._fonts:
                        self._fonts[id(found)] = Font(self.file, found)
                    state |= {"font": self._fonts[id(found)], "name": str(args[0]), "size": float(args[1])}
                elif op in ("Tc", "Tw", "TL", "Ts", "Tr"):
                    state[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise", "Tr": "mode"}[op]] = float(args[0])
                elif op == "Tz":
                    state["scale"] = float(args[0]) / 100
                elif op in ("Td", "TD"):
                    if op == "TD":
                        state["lead"] = -float(args[1])
                    tm = tlm = multiply((1, 0, 0, 1, float(args[0]), float(args[1])), tlm)
                elif op == "Tm":
                    tm = tlm = tuple(map(float, args[:6]))
                elif op == "T*":
                    tm = tlm = multiply((1, 0, 0, 1, 0, -state["lead"]), tlm)
                elif op in ("g", "rg", "k"):
                    state["fill"] = tuple(map(float, args))
                elif op in ("Tj", "'", '"', "TJ"):
                    if op in ("'", '"'):
                        if op == '"':
                            state["word"], state["char"] = float(args[0]), float(args[1])
                        tm = tlm = multiply((1, 0, 0, 1, 0, -state["lead"]), tlm)
                    tm = self._show(args[-1] if op == "TJ" else [args[-1]], state, tm, at)
                elif op == "Do":
                    found = get(kind("XObject").get(str(args[0])))
                    if isinstance(found, Stream) and get(found.attrs.get("Subtype")) == "Image":
                        if top:
                            self.images.append((str(args[0]), state["ctm"], at))
                    elif isinstance(found, Stream) and self._depth < 10:
                        matrix = get(found.attrs.get("Matrix"))
                        matrix = tuple(float(get(x)) for x in matrix) if isinstance(matrix, list) and len(matrix) == 6 else IDENTITY
                        self._depth += 1
                        self.run(self.file.decoded(found), get(found.attrs.get("Resources")) or resources, multiply(matrix, state["ctm"]), False)
                        self._depth -= 1
            except (IndexError, TypeError, ValueError, KeyError):
                continue

    def _show(self, parts: list, state: dict, tm: tuple, at: int) -> tuple:
        font, size = state["font"] or Font(self.file, None), state["size"]
        text, start = [], None

        def flush(end: tuple) -> None:
            nonlocal text, start
            if text:
                m = multiply((1, 0, 0, 1, 0, state["rise"]), multiply(start, state["ctm"]))
                x0, y0 = point(m, 0, 0)
                x1, _ = point(multiply(end, state["ctm"]), 0, 0)
                scale = math.hypot(m[2], m[3])
                self.fragments.append((("".join(text)), x0, y0, abs(x1 - x0), size * scale, quantized(math.atan2(m[1], m[0])), state["name"], font.name, at))
            text, start = [], None

        for part in parts:
            if isinstance(part, (int, float)):
                gap = -part / 1000 * size * state["scale"]
                if text and abs(gap) > 0.45 * size:
                    flush(tm)
                elif text and gap > 0.3 * size:
                    text.append(" ")
                tm = multiply((1, 0, 0, 1, gap, 0), tm)
            elif isinstance(part, bytes):
                start = start or tm
                text.append(font.decode(part))
                advance = sum((font.width(c) / 1000 * size + state["char"]) * state["scale"] for c in font.codes(part))
                advance += state["word"] * state["scale"] * (0 if font.composite else part.count(b" "))
                tm = multiply((1, 0, 0, 1, advance, 0), tm)
        flush(tm)
        return tm


# Codes 0x80-0x9E of the document encoding.
_DOCUMENT = dict(zip(range(0x80, 0x9F), "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž")) | {0xA0: "€"}


def text_string(value) -> str | None:
    """A PDF text string: UTF-16 or UTF-8 by its mark, else the document encoding."""
    if not isinstance(value, bytes):
        return None if value is None else str(value)
    if value.startswith(b"\xfe\xff"):
        return value[2:].decode("utf-16-be", "replace")
    if value.startswith(b"\xef\xbb\xbf"):
        return value[3:].decode("utf-8", "replace")
    return value.decode("ascii") if value.isascii() else value.decode("latin-1").translate(_DOCUMENT)


__all__ = ["Fold", "Font", "Lexer", "cmap", "glyph_text", "multiply", "point", "text_string"]
