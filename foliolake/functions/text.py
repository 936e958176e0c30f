"""String functions as Column expressions; Python ones are marked by their names' `_py`."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F

from ..sources.pdf_text import HELVETICA

# Roman numerals.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
# Bits of an annotation's flags, from the lowest on.
FLAGS = ["invisible", "hidden", "print", "nozoom", "norotate", "noview", "readonly", "locked", "togglenoview", "lockedcontents"]
# Bits of a document's permissions, by name.
PERMISSIONS = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill_forms": 9, "extract_accessibility": 10, "assemble": 11, "print_high": 12}
#: Unicode ranges of strong right-to-left characters.
RTL_RANGES = [(0x0590, 0x05FF), (0x0600, 0x06FF), (0x0700, 0x074F), (0x0750, 0x077F), (0x0780, 0x07BF), (0x08A0, 0x08FF), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFF)]
RTL = "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in RTL_RANGES) + "]"


def lit_if(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def roman(n: Column) -> Column:
    """Upper-case roman numeral of n clamped to 1..3999."""
    begin = F.struct(F.least(F.greatest(n.cast("int"), F.lit(1)), F.lit(3999)).alias("left"), F.lit("").alias("out"))
    steps = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN])
    return F.aggregate(steps, begin, lambda a, x: F.struct((a.left % x.v).alias("left"), F.concat(a.out, F.repeat(x.s, F.floor(a.left / x.v).cast("int"))).alias("out")), lambda a: a.out)


def alpha(n: Column) -> Column:
    """Bijective base 26: 1 A, 26 Z, 27 AA."""
    step = lambda a, _: F.when(a.left <= 0, a).otherwise(F.struct(F.floor((a.left - 1) / 26).cast("long").alias("left"), F.concat(F.char((a.left - 1) % 26 + 65), a.out).alias("out")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(n.cast("long").alias("left"), F.lit("").alias("out")), step, lambda a: a.out)


def page_label(style: Column, prefix: Column, number: Column) -> Column:
    """A label from style D, r, R, a, A or null (prefix alone)."""
    said = (
        F.when(style == "D", number.cast("string")).when(style == "R", roman(number)).when(style == "r", F.lower(roman(number)))
        .when(style == "A", alpha(number)).when(style == "a", F.lower(alpha(number))).otherwise("")
    )
    return F.concat(F.coalesce(prefix, F.lit("")), said)


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def string_hex(data: Column) -> Column:
    return F.hex(data)


def string_unhex(text: Column) -> Column:
    """Bytes of hex digits up to >, white space skipped, an odd digit padded with 0."""
    digits = F.regexp_replace(F.split_part(text, F.lit(">"), F.lit(1)), r"\s", "")
    return F.unhex(F.concat(digits, F.when(F.length(digits) % 2 == 1, "0").otherwise("")))


def decode_text_string(data: Column) -> Column:
    """UTF-16BE after its mark, else Latin-1."""
    return F.when(F.hex(F.substring(data, 1, 2)) == "FEFF", F.decode(F.substring(data, 3, 1 << 30), "UTF-16BE")).otherwise(F.decode(data, "ISO-8859-1"))


def name_escape(name: Column) -> Column:
    """#xx for what a name must not hold as it is."""
    each = F.transform(F.split(name, ""), lambda c: F.when(c.rlike(r"[^!-~]|[#()<>\[\]{}/%]") & (F.length(c) > 0), F.concat(F.lit("#"), F.hex(F.encode(c, "ISO-8859-1")))).otherwise(c))
    return F.array_join(each, "")


def name_unescape(name: Column) -> Column:
    parts = F.split(name, "#")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.decode(F.unhex(F.substring(p, 1, 2)), "ISO-8859-1"), F.substring(p, 3, 1 << 30))).otherwise(F.concat(F.lit("#"), p)))
    return F.concat(parts[0], F.array_join(rest, ""))


def strip_subset(font: Column) -> Column:
    return F.regexp_replace(font, r"^[A-Z]{6}\+(?=.)", "")


def font_bits(font: Column) -> Column:
    """1 for bold, 2 for italic or oblique, by name."""
    low = F.lower(font)
    return F.when(low.contains("bold"), 1).otherwise(0) + F.when(low.contains("italic") | low.contains("oblique"), 2).otherwise(0)


def css_family(font: Column) -> Column:
    low = F.lower(font)
    return (
        F.when(low.contains("courier") | low.contains("mono"), "'Courier New', monospace")
        .when(low.contains("times") | low.contains("serif") & ~low.contains("sans"), "'Times New Roman', serif")
        .when(low.contains("symbol"), "Symbol").otherwise("Arial, Helvetica, sans-serif")
    )


def has_rtl(c: Column) -> Column:
    return c.rlike(RTL)


def gap_multiplier(a: Column, b: Column) -> Column:
    """1.8 between single letters or digits, else 0.5."""
    single = lambda c: (F.length(c) == 1) & c.rlike(r"^[\p{L}\p{N}]$")
    return F.when(single(a) & single(b), 1.8).otherwise(0.5)


def bullets(c: Column) -> Column:
    """A line's leading ?, U+FFFD or private-use character with two spaces becomes a full stop with two spaces."""
    return F.regexp_replace(c, r"(?m)^[?\x{FFFD}\x{E000}-\x{F8FF}]  ", ".  ")


def newlines(c: Column, to: str = "\n") -> Column:
    return F.regexp_replace(c, r"\r\n|\r", to)


def flags_to_names(flags: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.when(flags.bitwiseAND(1 << i) != 0, n) for i, n in enumerate(FLAGS)]), lambda x: x.isNotNull()), ",")


def names_to_flags(names: Column) -> Column:
    """Bits of a list of names, or the number itself."""
    parts = F.transform(F.split(F.lower(names), ","), lambda x: F.trim(x))
    bits = sum((F.when(F.array_contains(parts, n), 1 << i).otherwise(0) for i, n in enumerate(FLAGS)), F.lit(0))
    return F.coalesce(names.try_cast("int"), bits)


def privileges(bits: Column, asked: Iterable[str] = tuple(PERMISSIONS)) -> Column:
    """Names of the permissions that are granted, of those asked for."""
    return F.filter(F.array(*[F.when(bits.cast("long").bitwiseAND(1 << (PERMISSIONS[n] - 1)) != 0, n) for n in asked]), lambda x: x.isNotNull())


def text_width(c: Column, size: Column | float) -> Column:
    """Sum of Helvetica widths of ASCII characters, others without width, times size / 1000."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x))
    widths = F.array(*[F.lit(w) for w in HELVETICA])
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda a, k: a + F.when((k >= 32) & (k < 127), F.get(widths, k - 32)).otherwise(0))
    return total * lit_if(size) / 1000


def line_height(size: Column | float) -> Column:
    return lit_if(size) * 1.2


def readability(c: Column) -> Column:
    """Per character: letter 4, digit 3, space or common sign 2, other ASCII -1, the rest -6."""
    each = F.transform(F.split(c, ""), lambda x: F.when(x == "", 0).when(x.rlike(r"^\p{L}$"), 4).when(x.rlike(r"^[0-9]$"), 3).when(x.rlike(r"^[\s.,:;'\-/&()]$"), 2).when(x.rlike(r"^[!-~]$"), -1).otherwise(-6))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def collapse_spacing(text: str) -> str:
    """`T H I S` becomes `THIS`: runs of three or more single characters, by one space each; longer gaps bound a run."""
    if len(text.split(" ")) > 64:
        return text
    return re.sub(r"(?<!\S)(?:\w )+\w(?!\S)", lambda m: m[0].replace(" ", "") if len(m[0]) >= 5 else m[0], text)


def collapse_doubles(text: str) -> str:
    """`HHeelllloo` becomes `Hello`, word by word, if doubled characters prevail; words of one character or digits stay."""

    def word(m: re.Match) -> str:
        w = m[0]
        pairs = singles = i = 0
        out = []
        while i < len(w):
            if i + 1 < len(w) and w[i] == w[i + 1]:
                pairs, i = pairs + 1, i + 2
            else:
                singles, i = singles + 1, i + 1
            out.append(w[i - 1])
        return "".join(out) if pairs >= 2 and pairs > 2 * singles and len(set(w)) > 1 and not w.isdigit() else w

    return re.sub(r"\S+", word, text)


def reverse_rtl(text: str) -> str:
    """Maximal runs of right-to-left characters, neutral ones inside included, reversed."""
    r = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in RTL_RANGES) + "]"
    return re.sub(f"{r}(?:[^\\w]*{r})*", lambda m: m[0][::-1], text)


def saslprep(text: str) -> str:
    """RFC 4013 mapping and normalisation; prohibited characters raise."""
    mapped = "".join(" " if unicodedata.category(c) == "Zs" else c for c in text if c not in "­͏᠆​⁠﻿" and not "︀" <= c <= "️")
    out = unicodedata.normalize("NFKC", mapped)
    if any(unicodedata.category(c) in ("Cc", "Cs", "Co", "Cn") for c in out):
        raise ValueError("prohibited character")
    return out


def wrap(text: str, width: float, size: float = 12.0) -> list[str]:
    """Greedy lines of at most width, at explicit line feeds and spaces."""
    measure = lambda s: sum(HELVETICA[ord(c) - 32] for c in s if 32 <= ord(c) < 127) * size / 1000
    out = []
    for line in text.split("\n"):
        held = ""
        for word in line.split(" "):
            more = f"{held} {word}" if held else word
            if held and measure(more) > width:
                out.append(held)
                held = word
            else:
                held = more
        out.append(held)
    return out


def _udf(f, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


def python_functions() -> dict:
    """Arrow UDFs for what expressions cannot say, by name; made when a session exists."""
    return {
        "collapse_spacing": _udf(collapse_spacing, "string"),
        "collapse_doubles": _udf(collapse_doubles, "string"),
        "reverse_rtl": _udf(reverse_rtl, "string"),
        "wrap_200": _udf(lambda x: wrap(x, 200.0), "array<string>"),
    }
