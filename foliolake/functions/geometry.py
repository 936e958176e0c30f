"""Matrices, rectangles and colours as Column expressions, and PDF function objects."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, functions as F

from .text import lit_if

# CSS colour names.
CSS_COLOURS = {"black": "000000", "white": "ffffff", "red": "ff0000", "green": "008000", "blue": "0000ff", "yellow": "ffff00", "gray": "808080", "grey": "808080", "silver": "c0c0c0", "maroon": "800000", "olive": "808000", "lime": "00ff00", "aqua": "00ffff", "cyan": "00ffff", "teal": "008080", "navy": "000080", "fuchsia": "ff00ff", "magenta": "ff00ff", "purple": "800080", "orange": "ffa500"}


def matrix(*cells) -> Column:
    return F.array(*[lit_if(c).cast("double") for c in cells])


def multiply(a: Column, b: Column) -> Column:
    """a applied first, then b; six cells each."""
    return F.array(
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def inverse(m: Column) -> Column:
    """Null if the matrix has none."""
    det = m[0] * m[3] - m[1] * m[2]
    return F.when(F.abs(det) > 1e-12, F.array(m[3] / det, -m[1] / det, -m[2] / det, m[0] / det, (m[2] * m[5] - m[3] * m[4]) / det, (m[1] * m[4] - m[0] * m[5]) / det))


def rotation(radians: Column) -> Column:
    return F.array(F.cos(radians), F.sin(radians), -F.sin(radians), F.cos(radians), F.lit(0.0), F.lit(0.0))


def transform(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def rect(llx, lly, urx, ury) -> Column:
    return F.struct(lit_if(llx).cast("double").alias("llx"), lit_if(lly).cast("double").alias("lly"), lit_if(urx).cast("double").alias("urx"), lit_if(ury).cast("double").alias("ury"))


def transform_rect(m: Column, r: Column) -> Column:
    """The bounding box of the turned corners."""
    points = [transform(m, x, y) for x in (r.llx, r.urx) for y in (r.lly, r.ury)]
    xs, ys = [p.x for p in points], [p.y for p in points]
    return rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def contains(outer: Column, inner: Column) -> Column:
    return (inner.llx >= outer.llx) & (inner.lly >= outer.lly) & (inner.urx <= outer.urx) & (inner.ury <= outer.ury)


def intersects(a: Column, b: Column) -> Column:
    """Strict: touching sides don't count."""
    return (a.llx < b.urx) & (a.urx > b.llx) & (a.lly < b.ury) & (a.ury > b.lly)


def intersection(a: Column, b: Column) -> Column:
    return F.when(intersects(a, b), rect(F.greatest(a.llx, b.llx), F.greatest(a.lly, b.lly), F.least(a.urx, b.urx), F.least(a.ury, b.ury)))


def clamp(r: Column, page: Column) -> Column:
    put = lambda v, low, high: F.least(F.greatest(v, low), high)
    return rect(put(r.llx, page.llx, page.urx), put(r.lly, page.lly, page.ury), put(r.urx, page.llx, page.urx), put(r.ury, page.lly, page.ury))


def rotated_size(r: Column, turn: Column) -> Column:
    w, h = r.urx - r.llx, r.ury - r.lly
    swap = turn % 180 == 90
    return F.struct(F.when(swap, h).otherwise(w).alias("width"), F.when(swap, w).otherwise(h).alias("height"))


def quantized(degrees: Column) -> Column:
    return F.pmod(F.floor(degrees / 90 + 0.5).cast("long") * 90, F.lit(360))


def part_rect(r: Column, start: Column, length: Column, total: Column) -> Column:
    """The slice of a text's rectangle that characters start .. start + length take, by proportion."""
    w = (r.urx - r.llx) / total
    return rect(r.llx + w * start, r.lly, r.llx + w * (start + length), r.ury)


def gray(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def cmyk(r: Column, g: Column, b: Column) -> Column:
    k = F.lit(1.0) - F.greatest(r, g, b)
    each = lambda v: F.when(k >= 1, 0.0).otherwise((F.lit(1.0) - v - k) / (F.lit(1.0) - k))
    return F.struct(each(r).alias("c"), each(g).alias("m"), each(b).alias("y"), k.alias("k"))


def rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.struct(((1 - c) * (1 - k)).alias("r"), ((1 - m) * (1 - k)).alias("g"), ((1 - y) * (1 - k)).alias("b"))


def html_colour(text: Column) -> Column:
    """(a, r, g, b) of #RRGGBB or #AARRGGBB, else null."""
    byte = lambda at: F.conv(F.substring(digits, at, 2), 16, 10).cast("int")
    digits = F.when(F.length(text) == 7, F.concat(F.lit("FF"), F.substring(text, 2, 6))).otherwise(F.substring(text, 2, 8))
    return F.when(text.rlike(r"^#([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"), F.struct(byte(1).alias("a"), byte(3).alias("r"), byte(5).alias("g"), byte(7).alias("b")))


def css_colour(text: Column) -> Column:
    """RRGGBB in lower case of a name, #rgb, #rrggbb or rgb(r, g, b), else null."""
    low = F.lower(F.trim(text))
    names = F.create_map(*[F.lit(x) for pair in CSS_COLOURS.items() for x in pair])
    of = lambda i: F.lpad(F.lower(F.hex(F.regexp_extract(low, r"^rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)$", i).try_cast("int"))), 2, "0")
    return (
        F.when(low.rlike(r"^#[0-9a-f]{6}$"), F.substring(low, 2, 6))
        .when(low.rlike(r"^#[0-9a-f]{3}$"), F.concat(*[F.repeat(F.substring(low, i, 1), 2) for i in (2, 3, 4)]))
        .when(low.rlike(r"^rgb\(\s*\d{1,3}\s*,\s*\d{1,3}\s*,\s*\d{1,3}\s*\)$"), F.concat(of(1), of(2), of(3)))
        .otherwise(F.element_at(names, low))
    )


def css_length(text: Column, base: Column | float) -> Column:
    """Points: pt, px as pt, em and % of base, cm, mm, in; base if it cannot be read."""
    base = lit_if(base).cast("double")
    number = F.regexp_extract(text, r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    mark = F.lower(F.regexp_extract(text, r"^\s*-?\d+(?:\.\d+)?\s*(pt|px|em|%|cm|mm|in)?\s*$", 1))
    known = text.rlike(r"(?i)^\s*-?\d+(\.\d+)?\s*(pt|px|em|%|cm|mm|in)?\s*$")
    value = F.when(mark == "em", number * base).when(mark == "%", number * base / 100).when(mark == "cm", number * 28.3465).when(mark == "mm", number * 2.83465).when(mark == "in", number * 72.0).otherwise(number)
    return F.when(known, value).otherwise(base)


def margins(text: Column, base: Column | float) -> Column:
    """(top, right, bottom, left) of one to four lengths."""
    parts = F.split(F.trim(text), r"\s+")
    of = lambda *places: css_length(F.coalesce(*[F.get(parts, F.lit(p)) for p in places]), base)
    return F.struct(of(0).alias("top"), of(1, 0).alias("right"), of(2, 0).alias("bottom"), of(3, 1, 0).alias("left"))


def is_bold(weight: Column) -> Column:
    return F.coalesce(F.lower(F.trim(weight)).isin("bold", "bolder") | (weight.try_cast("int") >= 700), F.lit(False))


def exponential(x: Column, c0: float, c1: float, n: float) -> Column:
    return F.lit(c0) + F.pow(x, F.lit(n)) * (c1 - c0)


def stitching(x: Column, bounds: list[float], parts: list) -> Column:
    """parts[i](x) between bounds[i - 1] and bounds[i]."""
    out = parts[-1](x)
    for b, part in reversed(list(zip(bounds, parts))):
        out = F.when(x < b, part(x)).otherwise(out)
    return out


def sampled(x: Column, samples: list[float]) -> Column:
    """Linear interpolation of samples over 0..1."""
    at = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * (len(samples) - 1)
    table = F.array(*[F.lit(float(s)) for s in samples])
    low = F.least(F.floor(at).cast("int"), F.lit(len(samples) - 2)) if len(samples) > 1 else F.lit(0)
    if len(samples) == 1:
        return F.lit(float(samples[0]))
    return F.get(table, low) + (F.get(table, low + 1) - F.get(table, low)) * (at - low)


def calculator(program: str, inputs: list[float]) -> list[float]:
    """A PostScript calculator function on a stack."""
    tokens = re.findall(r"[{}]|[^\s{}]+", program)

    def block(at: int) -> tuple[list, int]:
        out = []
        while at < len(tokens) and tokens[at] != "}":
            if tokens[at] == "{":
                inner, at = block(at + 1)
                out.append(inner)
            else:
                out.append(tokens[at])
            at += 1
        return out, at

    stack: list = list(inputs)
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    two = {
        "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "idiv": lambda a, b: int(a / b), "mod": lambda a, b: int(math.fmod(a, b)),
        "exp": lambda a, b: a**b, "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360, "and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a ^ b,
        "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
        "bitshift": lambda a, b: a << b if b >= 0 else a >> -b,
    }
    one = {
        "neg": lambda a: -a, "abs": abs, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: math.floor(a + 0.5), "truncate": math.trunc, "sqrt": math.sqrt,
        "ln": math.log, "log": math.log10, "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)), "not": lambda a: not a if isinstance(a, bool) else ~a,
        "cvi": int, "cvr": float,
    }

    def run(code: list) -> None:
        for i, t in enumerate(code):
            if isinstance(t, list):
                continue
            if t in two:
                b, a = stack.pop(), stack.pop()
                stack.append(two[t](a, b))
            elif t in one:
                stack.append(one[t](stack.pop()))
            elif t in ("true", "false"):
                stack.append(t == "true")
            elif t == "if":
                if stack.pop():
                    run(code[i - 1])
            elif t == "ifelse":
                run(code[i - 2] if stack.pop() else code[i - 1])
            elif t == "dup":
                stack.append(stack[-1])
            elif t == "pop":
                stack.pop()
            elif t == "exch":
                stack[-1], stack[-2] = stack[-2], stack[-1]
            elif t == "copy":
                n = int(stack.pop())
                stack.extend(stack[-n:] if n else [])
            elif t == "index":
                stack.append(stack[-1 - int(stack.pop())])
            elif t == "roll":
                j, n = int(stack.pop()), int(stack.pop())
                if n:
                    own = stack[-n:]
                    stack[-n:] = own[-j % n :] + own[: -j % n] if j % n else own
            else:
                number = float(t)
                stack.append(int(number) if whole(int(number)) and "." not in t else number)

    run(block(1 if tokens and tokens[0] == "{" else 0)[0])
    return [float(v) for v in stack]
