"""Positioned text: virtual layout, search, reading order, rows, tables, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G

PER_PAGE, PITCH, LEFT, TOP, SIZE = 50, 14.0, 72.0, 792.0, 12.0


def virtual_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One fragment a line of text: 50 lines a page, 14 points apart."""
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "text"))
    no = F.col("line_no")
    return lines.select(id_col, (F.floor(no / PER_PAGE) + 1).cast("long").alias("page_no"), (no % PER_PAGE + 1).cast("long").alias("frag_idx"), "line_no", "text", F.lit(LEFT).alias("x"), (F.lit(TOP) - PITCH * (no % PER_PAGE)).alias("y"))


def virtual_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One fragment a word, 6 points a character from the line's start."""
    lines = virtual_lines(docs, id_col, text_col)
    words = F.split("text", " ")
    starts = F.aggregate(words, F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.length(w) + 1)))
    each = lines.select(id_col, "page_no", "line_no", "y", F.posexplode(F.zip_with(words, F.slice(starts, 1, F.size(words)), lambda w, s: F.struct(w.alias("text"), s.alias("at")))).alias("word_no", "w"))
    return each.select(id_col, "page_no", "line_no", "word_no", F.col("w.text").alias("text"), (F.lit(LEFT) + 6 * F.col("w.at")).alias("x"), "y").where("text <> ''")


# search

def matches(fragments: DataFrame, phrase: str, regex: bool = False, case_sensitive: bool = True, text_col: str = "text") -> DataFrame:
    """Fragments with match_no and match_text of each match that doesn't overlap the one before; matches of white space alone are dropped."""
    pattern = phrase if regex else r"\Q" + phrase.replace(r"\E", r"\E\\E\Q") + r"\E"
    pattern = pattern if case_sensitive else "(?iu)" + pattern
    found = F.filter(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)), lambda m: F.trim(m) != "")
    return fragments.where(F.col(text_col).rlike(pattern)).select("*", F.posexplode(found).alias("match_no", "match_text"))


def match_count(text: Column, phrase: str, case_sensitive: bool = True) -> Column:
    """How often the phrase is in the text, matches not overlapping."""
    text, phrase = (text, phrase) if case_sensitive else (F.lower(text), phrase.lower())
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def page_text(fragments: DataFrame, keys: list[str], order: list[str], separator: str = "\n") -> DataFrame:
    """Fragments of a page joined in order."""
    item = F.struct(*order, F.col("text").alias("__text"))
    return fragments.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__text"]), separator).alias("text"))


def distinct_matches(found: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """One match for those of the same page and text whose positions agree within the tolerance."""
    near = lambda c: F.round(F.col(c) / tolerance).cast("long")
    return found.withColumns({"__x": near("x"), "__y": near("y")}).dropDuplicates([*keys, "match_text", "__x", "__y"]).drop("__x", "__y")


def within(fragments: DataFrame, area: tuple, mode: str = "contain", exclude: list[tuple] = ()) -> DataFrame:
    """Fragments (with rect) inside an area, or that intersect it and no excluded rectangle."""
    outer = G.rect(*area)
    test = G.contains(outer, F.col("rect")) if mode == "contain" else G.intersects(F.col("rect"), outer)
    test = F.coalesce(test, F.lit(True)) if mode == "contain" else test  # a fragment without a position passes
    for e in exclude:
        test = test & ~G.intersects(F.col("rect"), G.rect(*e))
    return fragments.where(test)


# order

def visual_order(fragments: DataFrame, keys: list[str], band: float = 2.0) -> DataFrame:
    """visual_no: bands of y downwards, then x, from the right where most letters run that way."""
    rtl = F.sum(F.when(F.col("rtl"), F.length("text")).otherwise(0)) if "rtl" in fragments.columns else F.lit(0)
    banded = fragments.withColumn("band", F.floor(F.col("y") / band))
    share = Window.partitionBy(*keys, "band")
    side = F.when(rtl.over(share) * 2 >= F.sum(F.length("text")).over(share), -1).otherwise(1) if "rtl" in fragments.columns else F.lit(1)
    order = Window.partitionBy(*keys).orderBy(F.desc("band"), F.col("x") * F.col("side"), "y", "text")
    return banded.withColumn("side", side).withColumn("visual_no", F.row_number().over(order)).drop("side")


def rotated_order(fragments: DataFrame, keys: list[str], rotation: int, band: float = 3.0) -> DataFrame:
    """Reading order of pages turned by 90 or 270 degrees in the column ord: columns of x, then y up or, for 270, down."""
    y = F.coalesce("y", F.lit(0.0)) * (-1 if rotation == 270 else 1)
    w = Window.partitionBy(*keys).orderBy(F.floor(F.coalesce("x", F.lit(0.0)) / band), y, "frag_idx")
    return fragments.withColumn("ord", F.row_number().over(w).cast("long"))


def line_averages(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Mean y of the fragments of each line."""
    return fragments.groupBy(*keys).agg(F.avg("y").alias("average_y"))


def dominant_rotation(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """The rotation of more than half of a page's characters, else 0."""
    each = fragments.groupBy(*keys, "rotation").agg(F.sum(F.length("text")).alias("n"))
    total = each.groupBy(*keys).agg(F.sum("n").alias("all"), F.max_by("rotation", F.struct("n", -F.col("rotation"))).alias("top"), F.max("n").alias("most"))
    return total.select(*keys, F.when(F.col("most") * 2 > F.col("all"), F.col("top")).otherwise(0).alias("rotation"))


def average_char_width(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Width a character over fragments wider than 1 and longer than 5 characters; 5 if there is none."""
    fit = (F.col("width") > 1) & (F.length("text") > 5)
    return fragments.groupBy(*keys).agg(F.coalesce(F.sum(F.when(fit, F.col("width"))) / F.sum(F.when(fit, F.length("text"))), F.lit(5.0)).alias("char_width"))


def span_offsets(fragments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """start, end of each fragment in the page's joined text: a line feed where y moves by more than 1, a space where x leaves a gap of more than 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.when(F.abs(F.col("y") - F.lag("y").over(w)) > 1, 1).when(F.col("x") - F.lag(F.col("x") + F.col("width")).over(w) > 1, 1).otherwise(0)
    spaced = fragments.withColumn("gap", F.coalesce(gap, F.lit(0)))
    end = F.sum(F.col("gap") + F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spaced.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))


# rows, tables, paragraphs

def anchored_rows(fragments: DataFrame, keys: list[str], tolerance: float = 3.0) -> DataFrame:
    """row_no and cell_no: a row holds what lies within the tolerance below its first fragment (not below the one before).

    A page's fragments are folded in one array; a page is bounded, a document is not.
    """
    item = F.struct((-F.col("y")).alias("down"), "x", "frag_idx", "text")
    page = fragments.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    begin = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(a: Column, i: Column) -> Column:
        new = a.anchor.isNull() | (i.down - a.anchor > tolerance)
        row = F.when(new, a.row + 1).otherwise(a.row)
        return F.struct(F.when(new, i.down).otherwise(a.anchor).alias("anchor"), row.alias("row"), F.concat(a.rows, F.array(row)).alias("rows"))

    rows = F.aggregate("items", begin, step, lambda a: a.rows)
    each = page.select(*keys, F.explode(F.zip_with("items", rows, lambda i, r: F.struct(r.alias("row_no"), i.x.alias("x"), (-i.down).alias("y"), i.frag_idx.alias("frag_idx"), i.text.alias("text")))).alias("f")).select(*keys, "f.*")
    return each.withColumn("cell_no", F.row_number().over(Window.partitionBy(*keys, "row_no").orderBy("x", "frag_idx")))


def tables(rows: DataFrame, keys: list[str], least_cells: int = 2, least_rows: int = 2) -> DataFrame:
    """table_no of cells in maximal runs of at least two rows of at least two cells each."""
    per_row = rows.groupBy(*keys, "row_no").agg(F.count("*").alias("cells"))
    w = Window.partitionBy(*keys).orderBy("row_no")
    full = per_row.where(F.col("cells") >= least_cells).withColumn("island", F.col("row_no") - F.row_number().over(w))
    runs = full.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "island"))).where(F.col("n") >= least_rows)
    runs = runs.withColumn("table_no", F.dense_rank().over(Window.partitionBy(*keys).orderBy("island")))
    return rows.join(runs.select(*keys, "row_no", "table_no"), [*keys, "row_no"])


def table_boxes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, most cells of a row and bounds of each table."""
    return cells.groupBy(*keys, "table_no").agg(F.countDistinct("row_no").alias("n_rows"), F.max("cell_no").alias("max_columns"), F.min("x").alias("llx"), F.min("y").alias("lly"), F.max("x").alias("urx"), F.max("y").alias("ury"))


def paragraphs(lines: DataFrame, keys: list[str], order: str = "line_no", paragraph: float = 14.0, section: float = 28.0) -> DataFrame:
    """section_no and para_no: a gap above the limits (strictly) begins a paragraph or a section."""
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.abs(F.lag("y").over(w) - F.col("y"))
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"__s": F.when(gap > section, 1).otherwise(0), "__p": F.when(gap > paragraph, 1).otherwise(0)})
    return marked.withColumns({"section_no": F.sum("__s").over(up_to) + 1, "para_no": F.sum("__p").over(up_to) + 1}).drop("__s", "__p")


def adjacency(fragments: DataFrame, keys: list[str], order: list[str], reach: float = 2.5) -> DataFrame:
    """joined: a single character that begins within reach of the end of a single character before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    near = (F.length("text") == 1) & (F.lag(F.length("text")).over(w) == 1) & (F.abs(F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)) <= reach)
    return fragments.withColumn("joined", F.coalesce(near, F.lit(False)))


def without_wrap_blanks(fragments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Without blank fragments between two that are not blank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    blank = F.trim("text") == ""
    around = F.coalesce(F.trim(F.lag("text").over(w)) != "", F.lit(False)) & F.coalesce(F.trim(F.lead("text").over(w)) != "", F.lit(False))
    return fragments.withColumn("__drop", blank & around).where("not __drop").drop("__drop")


# instructions

#: Instructions whose presence makes a page not blank.
MARKING = ["Tj", "TJ", "Do", "re", "m", "l", "f", "F", "S", "B", "b"]


def blank_pages(operators: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages without a marking instruction."""
    return pages.select(*keys).join(operators.where(F.col("op").isin(*MARKING)).select(*keys).distinct(), keys, "left_anti")


def colour_class(operators: DataFrame, keys: list[str], eps: float = 1 / 255) -> DataFrame:
    """Rgb, Grayscale, BlackAndWhite or Undefined: the strongest signal of a page's colour instructions."""
    n = F.col("numbers")
    grey = lambda v: F.when((F.abs(v) <= eps) | (F.abs(v - 1) <= eps), 1).otherwise(2)
    even = (F.abs(n[0] - n[1]) <= eps) & (F.abs(n[1] - n[2]) <= eps)
    signal = (
        F.when(F.col("op").isin("g", "G"), grey(n[0]))
        .when(F.col("op").isin("rg", "RG"), F.when(even, grey(n[0])).otherwise(3))
        .when(F.col("op").isin("k", "K"), F.when((F.abs(n[0]) <= eps) & (F.abs(n[1]) <= eps) & (F.abs(n[2]) <= eps), grey(1 - n[3])).otherwise(3))
        .when(F.col("op").isin("cs", "CS") & F.col("operands")[0].isin("DeviceRGB", "DeviceCMYK", "CalRGB"), 3).otherwise(0)
    )
    top = F.max(signal)
    return operators.groupBy(*keys).agg(F.element_at(F.array(*map(F.lit, ["Undefined", "BlackAndWhite", "Grayscale", "Rgb"])), top + 1).alias("colour"))


def gstate_depth(operators: DataFrame, keys: list[str]) -> DataFrame:
    """depth after each instruction; a Q too many counts as none."""
    w = Window.partitionBy(*keys).orderBy("op_idx").rowsBetween(Window.unboundedPreceding, 0)
    raw = F.sum(F.when(F.col("op") == "q", 1).when(F.col("op") == "Q", -1).otherwise(0)).over(w)
    return operators.withColumn("__raw", raw).withColumn("depth", F.col("__raw") - F.least(F.lit(0), F.min("__raw").over(w))).drop("__raw")


def paint_matrices(operators: DataFrame, keys: list[str], which: list[str]) -> DataFrame:
    """The transformation in force at each instruction of `which`: a fold over the page's q, Q and cm alone."""
    own = operators.where(F.col("op").isin("q", "Q", "cm", *which))
    page = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("op_idx", "op", F.transform("numbers", lambda x: x).alias("n"), "operands"))).alias("ops"))
    one = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)])
    begin = F.struct(one.alias("ctm"), F.array().cast("array<array<double>>").alias("stack"), F.array().cast("array<struct<op_idx:bigint,op:string,n:array<double>,operands:array<string>,ctm:array<double>>>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        depth = F.size(a.stack)
        ctm = F.when(i.op == "cm", G.multiply(i.n, a.ctm)).when((i.op == "Q") & (depth > 0), F.element_at(a.stack, -1)).otherwise(a.ctm)
        stack = F.when(i.op == "q", F.concat(a.stack, F.array(a.ctm))).when((i.op == "Q") & (depth > 0), F.slice(a.stack, 1, F.greatest(depth - 1, F.lit(0)))).otherwise(a.stack)
        hit = F.struct(i.op_idx.alias("op_idx"), i.op.alias("op"), i.n.alias("n"), i.operands.alias("operands"), a.ctm.alias("ctm"))
        return F.struct(ctm.alias("ctm"), stack.alias("stack"), F.when(i.op.isin(*which), F.concat(a.out, F.array(hit))).otherwise(a.out).alias("out"))

    return page.select(*keys, F.explode(F.aggregate("ops", begin, step, lambda a: a.out)).alias("p")).select(*keys, "p.*")


def content_boxes(operators: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds of path points, text origins and XObject origins under the transformation in force; the crop box if there is none.

    A text's origin is where Tm or Td puts it; c counts its end point, v and y none.
    """
    at = paint_matrices(operators, keys, ["re", "m", "l", "c", "Tm", "Td", "Do"])
    n, m = F.col("n"), F.col("ctm")
    pt = lambda x, y: F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))
    zero = F.lit(0.0)
    points = (
        F.when(F.col("op") == "re", F.array(pt(n[0], n[1]), pt(n[0] + n[2], n[1]), pt(n[0], n[1] + n[3]), pt(n[0] + n[2], n[1] + n[3])))
        .when(F.col("op").isin("m", "l", "Td"), F.array(pt(n[0], n[1])))
        .when(F.col("op").isin("c", "Tm"), F.array(pt(n[4], n[5])))
        .otherwise(F.array(pt(zero, zero)))
    )
    box = at.select(*keys, F.explode(points).alias("p")).groupBy(*keys).agg(F.min("p.x").alias("llx"), F.min("p.y").alias("lly"), F.max("p.x").alias("urx"), F.max("p.y").alias("ury"))
    crop = pages.select(*keys, "crop_llx", "crop_lly", "crop_urx", "crop_ury")
    return crop.join(box, keys, "left").select(*keys, *(F.coalesce(c, f"crop_{c}").alias(c) for c in ("llx", "lly", "urx", "ury")))


def islands(operators: DataFrame, keys: list[str]) -> DataFrame:
    """artifact_no of instructions between /Artifact BMC or BDC and its EMC."""
    w = Window.partitionBy(*keys).orderBy("op_idx").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.col("op").isin("BMC", "BDC") & (F.get("operands", F.lit(0)) == "Artifact")
    opened = F.sum(F.when(begin, 1).otherwise(0)).over(w)
    closed = F.sum(F.when(F.col("op") == "EMC", 1).otherwise(0)).over(w)
    marked = F.sum(F.when(F.col("op").isin("BMC", "BDC"), 1).otherwise(0)).over(w)
    return operators.withColumns({"artifact_no": opened, "__in": marked - closed}).where("artifact_no > 0 and __in > 0").drop("__in")


def phrase_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, text, item_id, phrase where the text contains the phrase, by hash joins.

    docs: doc_id (distinct), text. phrases: item_id, phrase, of any number. A
    word with a space on either side in the phrase has one in the text too, so the
    longest such word finds the candidates. Phrases of fewer than three words have
    none; only they, which are short, are looked for in every text.
    """
    words = F.split("phrase", " ")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    keyed = phrases.where("phrase <> ''").withColumn("key", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    tokens = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("key"))
    likely = tokens.join(keyed.where("key is not null"), "key").select("doc_id", "item_id", "phrase")
    found = docs.join(likely, "doc_id").where(F.col("text").contains(F.col("phrase"))).select("doc_id", "text", "item_id", "phrase")
    short = docs.join(keyed.where("key is null").select("item_id", "phrase"), F.col("text").contains(F.col("phrase"))).select("doc_id", "text", "item_id", "phrase")
    return found.unionAll(short)
