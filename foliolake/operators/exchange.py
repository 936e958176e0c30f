"""XML and FDF exchange of annotations, fields, bookmarks and violations, as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import xml_escape, xml_unescape


def _joined(rows: DataFrame, keys: list[str], order: str, part: Column, head: str, tail: str, name: str) -> DataFrame:
    each = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda x: x.p)
    return rows.groupBy(*keys).agg(F.concat(F.lit(head), F.array_join(each, ""), F.lit(tail)).alias(name))


def xfdf(annotations: DataFrame, keys: list[str] = ("doc_id",), kinds: list[str] | None = None) -> DataFrame:
    """One XFDF text a document; pages count from 0. kinds: only these subtypes."""
    rows = annotations.where(F.col("subtype").isin(*kinds)) if kinds else annotations
    part = F.concat(F.lit('<annot type="'), "subtype", F.lit('" page="'), (F.col("page_no") - 1).cast("string"), F.lit('" name="'), F.coalesce("name", F.lit("")), F.lit('"><contents>'), xml_escape(F.coalesce("contents", F.lit(""))), F.lit("</contents></annot>"))
    return _joined(rows.withColumn("__o", F.struct("page_no", "annot_idx")), list(keys), "__o", part, "<xfdf><annots>", "</annots></xfdf>", "xfdf")


def read_xfdf(texts: DataFrame, keys: list[str] = ("doc_id",), column: str = "xfdf") -> DataFrame:
    """Annotations of XFDF texts; attributes and contents by their paths."""
    get = lambda path: F.expr(f"xpath({column}, '/xfdf/annots/annot/{path}')")
    contents = F.transform(F.regexp_extract_all(column, F.lit(r"(?s)<contents>(.*?)</contents>"), F.lit(1)), xml_unescape)
    zipped = F.arrays_zip(get("@type").alias("subtype"), get("@page").alias("page"), get("@name").alias("name"), contents.alias("contents"))
    return texts.select(*keys, F.explode(zipped).alias("a")).select(*keys, F.col("a.subtype").alias("subtype"), (F.col("a.page").cast("long") + 1).alias("page_no"), F.col("a.name").alias("name"), F.col("a.contents").alias("contents"))


def bookmarks_xml(outlines: DataFrame, keys: list[str] = ("doc_id",)) -> DataFrame:
    """One text a document: items in pre-order with their levels."""
    part = F.concat(F.lit('<bookmark level="'), F.col("level").cast("string"), F.lit('" page="'), F.coalesce(F.col("page_no").cast("string"), F.lit("")), F.lit('">'), xml_escape(F.coalesce("title", F.lit(""))), F.lit("</bookmark>"))
    return _joined(outlines, list(keys), "ord", part, "<bookmarks>", "</bookmarks>", "xml")


def read_bookmarks(texts: DataFrame, keys: list[str] = ("doc_id",), column: str = "xml") -> DataFrame:
    found = F.regexp_extract_all(column, F.lit(r'(?s)<bookmark level="\d+" page="\d*">.*?</bookmark>'), F.lit(0))
    rows = texts.select(*keys, F.posexplode(found).alias("ord", "b"))
    get = lambda pattern: F.regexp_extract("b", pattern, 1)
    return rows.select(*keys, (F.col("ord") + 1).cast("long").alias("ord"), get(r'level="(\d+)"').cast("long").alias("level"), get(r'page="(\d*)"').try_cast("long").alias("page_no"), xml_unescape(get(r"(?s)>(.*)</bookmark>")).alias("title"))


def fdf(fields: DataFrame, keys: list[str] = ("doc_id",)) -> DataFrame:
    """One FDF text a document with names and values."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("("), F.lit("\\(")), F.lit(")"), F.lit("\\)"))
    part = F.concat(F.lit("<< /T ("), esc(F.col("name")), F.lit(") /V ("), esc(F.col("value")), F.lit(") >>\n"))
    return _joined(fields, list(keys), "ord", part, "%FDF-1.2\n1 0 obj << /FDF << /Fields [\n", "] >> >> endobj\n", "fdf")


def read_fdf(texts: DataFrame, keys: list[str] = ("doc_id",), column: str = "fdf") -> DataFrame:
    pair = r"/T \(((?:[^()\\]|\\.)*)\) /V \(((?:[^()\\]|\\.)*)\)"
    part = lambda i: F.transform(F.regexp_extract_all(column, F.lit(pair), F.lit(i)), lambda x: F.regexp_replace(x, r"\\(.)", "$1"))
    rows = texts.select(*keys, F.posexplode(F.arrays_zip(part(1).alias("name"), part(2).alias("value"))).alias("ord", "f"))
    return rows.select(*keys, (F.col("ord") + 1).cast("long").alias("ord"), "f.name", "f.value")


def upsert(fields: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Values by key replace those there; others stay."""
    new = values.select(*keys, F.col("value").alias("__new"))
    return fields.join(new, keys, "left").withColumn("value", F.coalesce("__new", "value")).drop("__new")


def xfa_names(texts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Names of fields in an XFA template."""
    return texts.select(*keys, F.posexplode(F.expr(f"xpath({column}, '//field/@name')")).alias("ord", "name"))


def violations_xml(violations: DataFrame, keys: list[str] = ("doc_id",)) -> DataFrame:
    part = F.concat(F.lit('<violation rule="'), "rule_id", F.lit('" severity="'), "severity", F.lit('">'), xml_escape(F.col("message")), F.lit("</violation>"))
    return _joined(violations.withColumn("__o", F.struct("rule_id", "message")), list(keys), "__o", part, "<log>", "</log>", "xml")
