"""Secret scans with DataFrame functions only.

Base patterns give spans of three kinds. Beside them, candidate strings get a
sliding-window Shannon entropy by character class: runs of hex digits that stand
between signs or spaces, runs of base64 characters of either alphabet with a
digit, and those of letters in both cases. '=' is in no run, so neither a name
before it nor padding changes a class. Counts of the window's characters change
by one in and one out a step, and with them the sum of c*log2(c), so a step
costs the same whatever the window. Candidates on the allow-list are suppressed;
base spans stay.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The base patterns, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
HEX_RUN = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}+(?![A-Za-z0-9])"
HEX_CLASS = r"^[0-9A-Fa-f]+$"
WINDOW = 20
#: Bits a character from which on a window counts. Of 600 random strings of 20, 30 and 40 characters some window reaches
#: them in 100, 100 and 100 % (hex digits), 96, 100 and 100 % (base64), 70, 95 and 99 % (letters) of cases.
LEAST_BITS = {"entropy_hex": 2.8, "entropy_base64": 3.75, "entropy_letters": 3.9}
# What is known to be no secret.
ALLOW = [
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|placeholder|dummy|changeme",
    r"^[0-9]+$",
]
#: Lengths are added up in blocks of so many matches.
BLOCK = 256
_SPAN = "array<struct<start:int,rank:int,kind:string,`end`:int>>"


def _let(value: Column, then) -> Column:
    """then(value), with value evaluated once a row: inside other functions an expression counts again for each use."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _places(text: Column, pattern: str) -> Column:
    """(start, end) of each match: between matches are the gaps that split() leaves."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("own")))
    empty = F.lit(None).cast("array<struct<start:int,`end`:int>>")

    def of(steps: Column) -> Column:
        return _let(F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK)), of_blocks)

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x.gap + x.own))
        base = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        none = F.array().cast("array<struct<start:int,`end`:int>>")

        def one(block: Column, at: Column) -> Column:
            begin = F.struct(at.alias("at"), none.alias("out"))
            step = lambda a, x: F.struct((a.at + x.gap + x.own).alias("at"), F.concat(a.out, F.array(F.struct((a.at + x.gap).alias("start"), (a.at + x.gap + x.own).alias("end")))).alias("out"))
            return F.aggregate(block, begin, step, lambda a: a.out)

        return F.flatten(F.zip_with(blocks, F.slice(base, 1, F.size(blocks)), one))

    return F.when(text.rlike(pattern), _let(steps, of)).otherwise(F.coalesce(empty, F.array()))


def _spans(places: Column, kind: str, rank: int) -> Column:
    return F.transform(places, lambda p: F.struct(p.start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), p.end.alias("end")))


def _plain(c: Column) -> Column:
    """c * log2(c), 0 for 0."""
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)


def _hot_window(candidate: Column, window: int, least: Column) -> Column:
    """(first, last): the first start and last end of windows of at least `least` bits a character; last is 0 if none is."""
    of = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - 43)  # '+' is the least of the class's characters
    begin = F.struct(F.array_repeat(F.lit(0), 80).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def changed(counts: Column, come: Column, go: Column) -> Column:
        up, down = F.get(counts, come), F.get(counts, F.coalesce(go, F.lit(0)))
        more = _let(up, lambda c: _plain(c + 1) - _plain(c))
        less = F.when(go.isNull(), 0.0).otherwise(_let(down, lambda c: _plain(c - 1) - _plain(c)))
        return F.when(come.eqNullSafe(go), 0.0).otherwise(more + less)

    def step(codes: Column, a: Column, i: Column) -> Column:
        move = F.struct(F.get(codes, i).alias("come"), F.when(i >= window, F.get(codes, i - window)).alias("go"))

        def moved(m: Column) -> Column:
            counts = F.transform(a.counts, lambda x, j: x + F.when(j == m.come, 1).otherwise(0) - F.when(j == m.go, 1).otherwise(0))
            return _let(F.struct(counts.alias("counts"), (a.total + changed(a.counts, m.come, m.go)).alias("total")), seen)

        def seen(now: Column) -> Column:
            full = (i >= window - 1) & (F.log2(F.lit(float(window))) - now.total / window >= least)
            return F.struct(
                now.counts.alias("counts"),
                now.total.alias("total"),
                F.when(full & (a.last == 0), i - window + 1).otherwise(a.first).alias("first"),
                F.when(full, i + 1).otherwise(a.last).alias("last"),
            )

        return _let(move, moved)

    return _let(of, lambda codes: F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, lambda a, i: step(codes, a, i), lambda a: F.struct(a.first.alias("first"), a.last.alias("last"))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", window: int = WINDOW, least_bits: dict[str, float] | None = None, allow: list[str] | None = None) -> DataFrame:
    """docs with `base` and `secrets`: arrays of (start, rank, kind, end), sorted by start, then kind.

    base holds matches of the three patterns, secrets also hot windows of
    candidates. Columns of these names in docs are replaced; other columns,
    repeated rows and null ids stay as they are. A null or empty text has none of
    either; a text is read whole, whatever its length. No shuffle.
    """
    least = LEAST_BITS | (least_bits or {})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    steps = docs.withColumn("__text", text)
    steps = steps.withColumns({"__assign": _places(F.col("__text"), ASSIGN), "__access": _places(F.col("__text"), ACCESS), "__hex": _places(F.col("__text"), HEX), "__at": _places(F.col("__text"), CANDIDATE), "__hexes": _places(F.col("__text"), HEX_RUN)})
    value = F.regexp_extract_all(F.col("__text"), F.lit(ASSIGN), F.lit(2))
    kept = F.filter(F.zip_with(_spans(F.col("__assign"), "assign", 0), value, lambda s, v: F.when(F.length(v) >= ASSIGN_LEAST, s)), lambda s: s.isNotNull())
    assign = F.when(F.size("__assign") > 0, kept).otherwise(F.array().cast(_SPAN))
    base = F.array_sort(F.concat(assign.cast(_SPAN), _spans(F.col("__access"), "access", 1), _spans(F.col("__hex"), "hex", 2)))
    steps = steps.withColumn("base", base)

    def hot(kind: Column, own: Column, place: Column) -> Column:
        allowed = F.lit(False)
        for pattern in ALLOW if allow is None else allow:
            allowed = allowed | own.rlike(pattern)
        bits = F.element_at(F.create_map(*[x for k, v in least.items() for x in (F.lit(k), F.lit(v))]), kind)
        rank = F.array_position(F.array(*[F.lit(k) for k in LEAST_BITS]), kind).cast("int") + 2
        span = lambda f: F.struct((place.start + f.first).alias("start"), rank.alias("rank"), kind.alias("kind"), (place.start + f.last).alias("end"))
        return F.when(kind.isNotNull() & ~allowed, _let(_hot_window(own, window, bits), lambda f: F.when(f.last > 0, span(f))))

    def found(places: str, kind_of) -> Column:
        own = lambda p: F.substring(F.col("__text"), p.start + 1, p.end - p.start)
        each = F.transform(places, lambda p: _let(own(p), lambda o: _let(kind_of(o), lambda k: hot(k, o, p))))
        return F.when(F.size(places) > 0, F.filter(each, lambda s: s.isNotNull())).otherwise(F.array().cast(_SPAN)).cast(_SPAN)

    of_run = lambda o: F.when(o.rlike(HEX_CLASS), F.lit(None)).when(o.rlike("[0-9]"), "entropy_base64").when(o.rlike("[a-z]") & o.rlike("[A-Z]"), "entropy_letters").cast("string")
    extra = F.concat(found("__hexes", lambda o: F.lit("entropy_hex")), found("__at", of_run))
    return steps.withColumn("secrets", F.array_sort(F.concat("base", extra))).drop("__text", "__assign", "__access", "__hex", "__at", "__hexes")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    return scanned.select(
        F.col(id_col).alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )
