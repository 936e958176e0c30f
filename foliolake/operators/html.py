"""HTML ingestion as expressions: cleaning, text, blocks, links, lists, tables, CSS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Named entities that are known; XML's own five stay as they are while cleaning.
ENTITIES = {"nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "hellip": "…", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "sect": "§", "para": "¶", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "frac12": "½", "frac14": "¼", "frac34": "¾", "laquo": "«", "raquo": "»"}
XML_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
# Sizes of headings in points.
SIZES = {"h1": 24, "h2": 20, "h3": 16, "h4": 14, "h5": 12, "h6": 12}
BLOCKS = "h[1-6]|p|li|td|th|blockquote|pre"
VOID = "br|hr|img|input|meta|link|area|base|col|embed|source|track|wbr"


def clean(html: Column) -> Column:
    """Without conditional comments, CDATA, scripts, styles, comments and name spaces; void tags closed."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<!\[CDATA\[(.*?)\]\]>", "$1")
    out = F.regexp_replace(out, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", "")
    out = F.regexp_replace(out, r"(?i)\s+xmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", "")
    return F.regexp_replace(out, rf"(?i)<({VOID})\b([^>]*?)\s*/?>", "<$1$2/>")


def aggressive(html: Column) -> Column:
    """As clean, and without media, svg, math and processing instructions."""
    out = F.regexp_replace(clean(html), r"(?is)<(svg|math|video|audio|object|iframe|canvas)\b[^>]*>.*?</(svg|math|video|audio|object|iframe|canvas)\s*>", "")
    return F.regexp_replace(out, r"(?s)<\?.*?\?>", "")


def entities(text: Column) -> Column:
    """Known names and numbers to characters, XML's own last; an unknown name becomes U+FFFD."""
    for name, to in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(to))
    text = F.regexp_replace(text, r"&(?!(?:lt|gt|quot|apos|amp);)[A-Za-z][A-Za-z0-9]{1,10};", "�")
    for name, to in XML_ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(to))
    return text


def body(html: Column) -> Column:
    """What is inside body; all of it if there is no body that ends."""
    found = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)</body>", 1)
    return F.when(found != "", found).otherwise(html)


def ensure_body(html: Column) -> Column:
    out = F.when(html.rlike(r"(?i)<body\b"), html).otherwise(F.concat(F.lit("<body>"), html, F.lit("</body>")))
    return F.when(out.rlike(r"(?i)<html\b"), out).otherwise(F.concat(F.lit("<html>"), out, F.lit("</html>")))


def strip_tags(html: Column) -> Column:
    """Tags to spaces, entities to characters, white space collapsed."""
    return F.trim(F.regexp_replace(entities(F.regexp_replace(html, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def title(html: Column) -> Column:
    return strip_tags(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))


def anchors(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every a with a href that isn't empty, in order."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return pages.select(id_col, F.posexplode(found).alias("link_no", "href"))


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row a block that begins with an opening tag: tag, size in points, text up to the next block's tag."""
    html = clean(F.col(html_col))
    parts = F.split(F.regexp_replace(html, rf"(?i)<({BLOCKS})\b([^>]*)>", "\u0001<$1$2>"), "\u0001")
    each = pages.select(id_col, F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("block_no", "part"))
    tag = F.lower(F.regexp_extract("part", r"^<(\w+)", 1))
    until = F.regexp_extract("part", rf"(?is)^<[^>]*>(.*?)(?:</(?:{BLOCKS})\s*>|$)", 1)
    sizes = F.create_map(*[F.lit(x) for pair in SIZES.items() for x in pair])
    return each.select(id_col, "block_no", tag.alias("tag"), F.coalesce(F.element_at(sizes, tag), F.lit(12)).alias("size"), strip_tags(until).alias("text"), F.regexp_extract("part", r"(?i)^<[^>]*\bstyle\s*=\s*[\"']([^\"']*)[\"']", 1).alias("style"), F.regexp_extract("part", r"(?i)^<[^>]*\bclass\s*=\s*[\"']([^\"']*)[\"']", 1).alias("class"))


def list_items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Items of ul and ol with their markers: a bullet, or the number in its list."""
    found = F.regexp_extract_all(clean(F.col(html_col)), F.lit(r"(?is)<(?:ul|ol)\b[^>]*>.*?</(?:ul|ol)>"), F.lit(0))
    lists = pages.select(id_col, F.posexplode(found).alias("list_no", "list"))
    items = lists.select(id_col, "list_no", F.lower(F.regexp_extract("list", r"^<(\w+)", 1)).alias("kind"), F.posexplode(F.regexp_extract_all("list", F.lit(r"(?is)<li\b[^>]*>(.*?)(?=</li>|<li\b|</[uo]l>)"), F.lit(1))).alias("i", "item"))
    return items.select(id_col, "list_no", "kind", F.when(F.col("kind") == "ol", F.concat((F.col("i") + 1).cast("string"), F.lit(". "))).otherwise("• ").alias("marker"), strip_tags(F.col("item")).alias("text"))


def table_cells(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Cells of every table with their spans; th is a header."""
    tables = pages.select(id_col, F.posexplode(F.regexp_extract_all(clean(F.col(html_col)), F.lit(r"(?is)<table\b[^>]*>.*?</table>"), F.lit(0))).alias("table_no", "t"))
    rows = tables.select(id_col, "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|</table>)"), F.lit(1))).alias("row_no", "r"))
    cells = rows.select(id_col, "table_no", "row_no", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>.*?(?=</t[dh]>|<t[dh]\b|$)"), F.lit(0))).alias("cell_no", "c"))
    span = lambda name: F.coalesce(F.regexp_extract("c", rf"(?i)^<[^>]*\b{name}\s*=\s*[\"']?(\d+)", 1).try_cast("int"), F.lit(1)).alias(name)
    return cells.select(id_col, "table_no", "row_no", "cell_no", F.col("c").rlike("(?i)^<th").alias("header"), span("colspan"), span("rowspan"), strip_tags(F.col("c")).alias("text"))


def images(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Images with data: sources, decoded; other sources are ignored."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)<img\b[^>]*?\bsrc\s*=\s*[\"']data:([^\"']+)[\"']"), F.lit(1))
    each = pages.select(id_col, F.posexplode(found).alias("image_no", "d"))
    return each.select(id_col, "image_no", F.split_part("d", F.lit(";"), F.lit(1)).alias("mime"), F.expr("try_to_binary(split_part(d, 'base64,', 2), 'base64')").alias("data"))


def css(style: Column) -> Column:
    """Properties of an inline style, by lower-case name."""
    parts = F.filter(F.transform(F.split(style, ";"), lambda p: F.struct(F.lower(F.trim(F.split_part(p, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.substring_index(p, ":", -1)).alias("v"))), lambda p: (p.k != "") & (p.v != p.k))
    return F.map_from_entries(F.array_distinct(parts))


def page_count_hint(html: Column) -> Column:
    """2 if a class contains page-break, else 1; a larger page number of a span counts."""
    spans = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<span[^>]*class=[\"']page[\"'][^>]*>\s*(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.greatest(F.when(html.rlike(r"(?i)class\s*=\s*[\"'][^\"']*page-break"), 2).otherwise(1), F.coalesce(F.array_max(spans), F.lit(0)))


def text_height(text: Column, size: Column, width: float = 468.0) -> Column:
    """Estimated lines of half-size characters, times 1.2 sizes."""
    return F.ceil(F.greatest(F.length(text), F.lit(1)) * size * 0.5 / width) * size * 1.2


def to_html(fragments: DataFrame, keys: list[str], flow: bool = False) -> DataFrame:
    """Absolutely placed spans, or paragraphs, of a page's fragments in order."""
    esc = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    one = F.concat(F.lit("<p>"), esc, F.lit("</p>")) if flow else F.concat(F.lit('<span style="position:absolute;left:'), F.col("x").cast("int"), F.lit("pt;bottom:"), F.col("y").cast("int"), F.lit('pt">'), esc, F.lit("</span>"))
    return fragments.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frag_idx", one.alias("h")))), lambda x: x.h), "").alias("html"))
