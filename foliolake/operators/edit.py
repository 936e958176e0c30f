"""Row rewrites of pages, instructions, annotations, trees and metadata."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

SHOW_TEXT = ("Tj", "TJ", "'", '"')


def with_margins(pages: DataFrame, left: float, bottom: float, right: float, top: float, only: list[int] | None = None) -> DataFrame:
    """Media and crop boxes grown; only these pages, or all."""
    hit = F.col("page_no").isin(*only) if only else F.lit(True)
    put = lambda c, by: F.when(hit, F.col(c) + by).otherwise(F.col(c))
    by = {"llx": -left, "lly": -bottom, "urx": right, "ury": top}
    return pages.withColumns({f"{p}{c}": put(f"{p}{c}", v) for p in ("", "crop_") for c, v in by.items()})


def rotated(pages: DataFrame, by: int) -> DataFrame:
    return pages.withColumn("rotate", F.pmod(F.col("rotate") + by, F.lit(360)))


def resized(operators: DataFrame, keys: list[str], sx: float, sy: float, dx: float, dy: float) -> DataFrame:
    """Each page's instructions between q cm and Q, numbered anew."""
    row = lambda at, op, numbers: F.struct(F.lit(at).alias("at"), F.lit(op).alias("op"), numbers.alias("numbers"))
    none = F.array().cast("array<double>")
    head = F.array(row(0, "q", none), row(1, "cm", F.array(*[F.lit(float(v)) for v in (sx, 0, 0, sy, dx, dy)])))
    ends = operators.groupBy(*keys).agg(F.max("op_idx").alias("n")).select(*keys, "n", F.explode(F.concat(head, F.array(row(2, "Q", none)))).alias("r"))
    ends = ends.select(*keys, F.when(F.col("r.at") == 2, F.col("n") + 3).otherwise(F.col("r.at") + 1).cast("long").alias("op_idx"), F.col("r.op").alias("op"), F.col("r.numbers").alias("numbers"))
    return operators.select(*keys, (F.col("op_idx") + 2).alias("op_idx"), "op", "numbers").unionByName(ends)


def to_grey(operators: DataFrame) -> DataFrame:
    """rg, RG, k and K become g and G."""
    n = F.col("numbers")
    grey = (
        F.when(F.col("op").isin("rg", "RG"), n[0] * 0.299 + n[1] * 0.587 + n[2] * 0.114)
        .when(F.col("op").isin("k", "K"), (1 - n[3]) * ((1 - n[0]) * 0.299 + (1 - n[1]) * 0.587 + (1 - n[2]) * 0.114))
    )
    op = F.when(F.col("op").isin("rg", "k"), "g").when(F.col("op").isin("RG", "K"), "G").otherwise(F.col("op"))
    return operators.withColumns({"numbers": F.when(grey.isNotNull(), F.array(grey)).otherwise(n), "op": op})


def redactions(annotations: DataFrame) -> DataFrame:
    """Instructions that paint over Redact annotations; the text below stays where it is."""
    box = F.array("llx", "lly", F.col("urx") - F.col("llx"), F.col("ury") - F.col("lly"))
    return annotations.where("subtype = 'Redact'").select("doc_id", "page_no", "annot_idx", F.lit("re").alias("op"), box.alias("numbers"))


def page_bookmarks(pages: DataFrame, title: Column) -> DataFrame:
    """One outline item a page."""
    return pages.select("doc_id", F.col("page_no").alias("ord"), F.lit(1).cast("long").alias("level"), title.alias("title"), "page_no")


def tree_put(pairs: Column, key: Column, value: Column) -> Column:
    """A name tree's map with a key set."""
    return F.map_concat(F.map_filter(pairs, lambda k, v: k != key), F.create_map(key, value))


def tree_delete(pairs: Column, key: Column) -> Column:
    return F.map_filter(pairs, lambda k, v: k != key)


def tree_pairs(pairs: Column) -> Column:
    """Keys in order, with the limits that a leaf would state."""
    keys = F.array_sort(F.map_keys(pairs))
    return F.struct(keys.alias("names"), F.array(F.element_at(keys, 1), F.element_at(keys, -1)).alias("limits"))


def used_resources(operators: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct names by category that instructions use."""
    group = F.when(F.col("op") == "Tf", "Font").when(F.col("op") == "Do", "XObject").when(F.col("op") == "gs", "ExtGState").when(F.col("op").isin("cs", "CS"), "ColorSpace").when(F.col("op") == "sh", "Shading")
    return operators.withColumn("category", group).where("category is not null").select(*keys, "category", F.col("operands")[0].alias("name")).distinct()


def union_box(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("llx").alias("llx"), F.min("lly").alias("lly"), F.max("urx").alias("urx"), F.max("ury").alias("ury"))


def removed(rows: DataFrame, victims: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those whose keys are among the victims."""
    return rows.join(victims.select(*keys), keys, "left_anti")


def put_rows(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the new ones, which replace rows of equal keys; of columns that new lacks they hold null."""
    return removed(rows, new, keys).unionByName(new, allowMissingColumns=True)


def renumbered(rows: DataFrame, keys: list[str], order: list[str | Column], column: str) -> DataFrame:
    """Rows numbered anew from 1 within the keys."""
    return rows.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def visited(operators: DataFrame, visitors: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Instructions whose operands each visitor has rewritten, by operator."""
    seen = F.col("operands")
    for op, visit in visitors.items():
        seen = F.when(F.col("op") == op, visit(F.col("operands"))).otherwise(seen)
    return operators.withColumn("operands", seen)


def selected(operators: DataFrame, *ops: str) -> DataFrame:
    return operators.where(F.col("op").isin(*ops))


def without_text(operators: DataFrame) -> DataFrame:
    return operators.where(~F.col("op").isin(*SHOW_TEXT))


def with_fragment_text(operators: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Instructions that show text say what texts (keys, op_idx, text) has for them; a TJ becomes a Tj."""
    hit = F.col("__text").isNotNull() & F.col("op").isin(*SHOW_TEXT)
    both = operators.join(texts.select(*keys, "op_idx", F.col("text").alias("__text")), [*keys, "op_idx"], "left")
    said = {"operands": F.when(hit, F.array("__text")).otherwise(F.col("operands")), "op": F.when(hit & (F.col("op") == "TJ"), "Tj").otherwise(F.col("op"))}
    return both.withColumns(said).drop("__text")


def running_text(pages: DataFrame, keys: list[str], template: str = "Page {page} of {pages}") -> DataFrame:
    """Pages with the text of their header or footer in the column overlay."""
    total = F.count("*").over(Window.partitionBy(*keys)).cast("string")
    said = F.replace(F.replace(F.lit(template), F.lit("{pages}"), total), F.lit("{page}"), F.col("page_no").cast("string"))
    return pages.withColumn("overlay", said)


def merged_attachments(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Attachments of all parts; of equal names the first part's stays."""
    rows = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    all_ = rows[0]
    for more in rows[1:]:
        all_ = all_.unionByName(more, allowMissingColumns=True)
    first = Window.partitionBy(*keys, "name").orderBy("__part")
    return all_.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__part")


def used_images(resources: DataFrame, operators: DataFrame, keys: list[str]) -> DataFrame:
    """Images that a page's own Do draws."""
    drawn = operators.where("op = 'Do'").select(*keys, F.col("operands")[0].alias("name"))
    return resources.where("category = 'XObject' and subtype = 'Image'").join(drawn, [*keys, "name"], "left_semi")


def outline_neighbours(outlines: DataFrame, keys: list[str]) -> DataFrame:
    """Items with the titles of the items before and after them below one parent, and of their first and last child."""
    w = Window.partitionBy(*keys, "parent").orderBy("ord")
    kids = outlines.where("parent is not null").groupBy(*keys, F.col("parent").alias("ord")).agg(F.min_by("title", "ord").alias("first_child"), F.max_by("title", "ord").alias("last_child"))
    return outlines.withColumns({"prev": F.lag("title").over(w), "next": F.lead("title").over(w)}).join(kids, [*keys, "ord"], "left")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows with equal keys whose rectangles share an area, as structs l and r."""
    a = left.select(*keys, F.struct(*left.columns).alias("l"))
    b = right.select(*keys, F.struct(*right.columns).alias("r"))
    return a.join(b, keys).where("l.llx < r.urx and r.llx < l.urx and l.lly < r.ury and r.lly < l.ury")


def standard_type(roles: Column, kind: Column) -> Column:
    """The type that a role map gives a structure type, itself where the map has none."""
    return F.coalesce(F.element_at(roles, kind), kind)


def xfa_value(column: str, path: str) -> Column:
    """The value at a dotted path, with places such as name[1] from 0, below the data of an XFA document; null if it is not there."""
    steps = []
    for step in path.split("."):
        if step.startswith("#"):
            continue
        got = re.fullmatch(r"([^\W\d][\w-]*)(?:\[(\d+)\])?", step)
        if got is None:
            raise ValueError(f"no step of a path: {step!r}")
        steps.append(f"*[local-name()=\"{got[1]}\"][{int(got[2] or 0) + 1}]")
    at = "//*[local-name()=\"data\"][1]/" + "/".join(steps)
    return F.when(F.xpath_boolean(F.col(column), F.lit(at)), F.xpath_string(F.col(column), F.lit(at)))


def blank_signatures(fields: DataFrame) -> DataFrame:
    return fields.where("kind = 'signature' and value is null")


def signature_revisions(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Signed fields with their ordinals among the signed ones."""
    return renumbered(fields.where("kind = 'signature' and value is not null"), keys, ["ord"], "revision")
