"""Pages as rows: lookups, set operations and numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import page_label


def pages_of(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a page with its text's lines counted."""
    return lines.groupBy(id_col, "page_no").agg(F.count("*").alias("n_lines"))


def concatenate(parts: list[DataFrame], id_col: str = "doc_id", order: list[str] = ("page_no",)) -> DataFrame:
    """All pages of the parts, part after part, numbered anew."""
    union = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    w = Window.partitionBy(id_col).orderBy("part", *order)
    return union.withColumn("new_page", F.row_number().over(w))


def extract(pages: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """Pages first..last, both included."""
    return pages.where((F.col("page_no") >= first) & (F.col("page_no") <= last if last is not None else F.lit(True)))


def delete(pages: DataFrame, numbers: list[int], id_col: str = "doc_id") -> DataFrame:
    """Without the given pages; the rest is numbered anew."""
    w = Window.partitionBy(id_col).orderBy("page_no")
    return pages.where(~F.col("page_no").isin(*numbers)).withColumn("new_page", F.row_number().over(w))


def insert(pages: DataFrame, more: DataFrame, at: int, id_col: str = "doc_id") -> DataFrame:
    """more's pages before page `at`, all numbered anew."""
    union = pages.withColumn("__o", F.when(F.col("page_no") < at, 0).otherwise(2)).unionByName(more.withColumn("__o", F.lit(1)))
    w = Window.partitionBy(id_col).orderBy("__o", "page_no")
    return union.withColumn("new_page", F.row_number().over(w)).drop("__o")


def booklet(pages: DataFrame) -> DataFrame:
    """sheet and side: pages 1 and 2 on the first sheet, 3 and 4 on the second."""
    return pages.withColumns({"sheet": F.floor((F.col("page_no") - 1) / 2) + 1, "side": F.when(F.col("page_no") % 2 == 1, "left").otherwise("right")})


def page_break(pages: DataFrame, y: float) -> DataFrame:
    """Two rows a page: above and below y."""
    return pages.select("*", F.explode(F.array(F.struct(F.lit(1).alias("part"), F.lit(y).alias("lly"), F.col("height").alias("ury")), F.struct(F.lit(2).alias("part"), F.lit(0.0).alias("lly"), F.lit(y).alias("ury")))).alias("p")).select(*pages.columns, "p.*")


def labelled(pages: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Each page's label: from the range with the greatest start at or before its index; without one, its number."""
    idx = F.col("page_no") - 1
    before = pages.join(ranges, keys, "left").where(F.col("start").isNull() | (F.col("start") <= idx))
    best = before.groupBy(*keys, "page_no").agg(F.max_by(F.struct("start", "style", "prefix", "first"), "start").alias("r"))
    found = pages.join(best, [*keys, "page_no"], "left")
    label = F.when(F.col("r.start").isNull(), F.col("page_no").cast("string")).otherwise(page_label(F.col("r.style"), F.col("r.prefix"), idx - F.col("r.start") + F.col("r.first")))
    return found.select(*keys, "page_no", label.alias("label"))


def balanced(sections: DataFrame, pages: Column, weight: str, keys: list[str], order: str) -> DataFrame:
    """Pages allotted to sections by largest remainder, at least one each."""
    w = Window.partitionBy(*keys)
    spare = pages - F.count("*").over(w)
    share = F.col(weight) / F.sum(weight).over(w) * F.greatest(spare, F.lit(0))
    whole = sections.withColumns({"__base": F.floor(share), "__rest": share - F.floor(share), "__spare": F.greatest(spare, F.lit(0))})
    rank = F.row_number().over(w.orderBy(F.desc("__rest"), order))
    left = F.col("__spare") - F.sum("__base").over(w)
    return whole.withColumn("__rank", rank).withColumn("n_pages", (1 + F.col("__base") + F.when(F.col("__rank") <= left, 1).otherwise(0)).cast("long")).drop("__base", "__rest", "__spare", "__rank")


def paginate(blocks: DataFrame, keys: list[str], order: str, height: str, page_height: float) -> DataFrame:
    """page_no by first fit in order: a block that doesn't fit what is left begins a page. Folded in one array a document part."""
    doc = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.col(height).cast("double").alias("h")))).alias("items"))
    begin = F.struct(F.lit(1).alias("page"), F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        new = (a.used > 0) & (a.used + i.h > page_height)
        page = F.when(new, a.page + 1).otherwise(a.page)
        return F.struct(page.alias("page"), F.when(new, i.h).otherwise(a.used + i.h).alias("used"), F.concat(a.out, F.array(page)).alias("out"))

    out = F.aggregate("items", begin, step, lambda a: a.out)
    return doc.select(*keys, F.explode(F.zip_with("items", out, lambda i, p: F.struct(i[order].alias(order), p.alias("page_no")))).alias("b")).select(*keys, "b.*")


def spans_of(matches: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Source spans that a match's [start, end) overlaps, and which of them is first."""
    m = matches.select(*keys, F.col("m_start"), F.col("m_end"))
    hit = m.join(spans.select(*keys, "start", "end", "frag_idx"), keys).where((F.col("start") < F.col("m_end")) & (F.col("end") > F.col("m_start")))
    return hit.withColumn("is_first", F.col("start") == F.min("start").over(Window.partitionBy(*keys, "m_start")))


def newest(revisions: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(revision))
    return revisions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def changed(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of new that are not the same in old: what an appended revision must hold."""
    h = F.xxhash64(*columns)
    return new.withColumn("__h", h).join(old.select(*keys, h.alias("__h")), [*keys, "__h"], "left_anti").drop("__h")


def reachable(roots: DataFrame, edges: DataFrame, keys: list[str], rounds: int = 64) -> DataFrame:
    """Nodes reachable over edges (src, dst), by frontier joins; each round's frontier is new nodes only."""
    seen = frontier = roots.select(*keys, "node").distinct()
    for _ in range(rounds):
        step = frontier.join(edges.select(*keys, F.col("src").alias("node"), "dst"), [*keys, "node"]).select(*keys, F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, [*keys, "node"], "left_anti").checkpoint()
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier).checkpoint()
    return seen


def visible_outlines(items: DataFrame, keys: list[str]) -> DataFrame:
    """Outline items without a closed item above them, counted a document; a fold over a document's outline in pre-order."""
    doc = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "level", "open"))).alias("items"))
    begin = F.struct(F.lit(1 << 30).cast("long").alias("closed"), F.lit(0).alias("seen"))

    def step(a: Column, i: Column) -> Column:
        shown = i.level <= a.closed
        closed = F.when(~shown, a.closed).when(i.open, F.lit(1 << 30)).otherwise(i.level)
        return F.struct(closed.cast("long").alias("closed"), (a.seen + shown.cast("int")).alias("seen"))

    return doc.select(*keys, F.aggregate("items", begin, step, lambda a: a.seen).alias("visible"), F.size("items").alias("total"))
