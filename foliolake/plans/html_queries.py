"""Queries over HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import html as H
from .registry import query, table

_CLEAN = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'g')"
_KNOWN = ["nbsp", "copy", "reg", "trade", "mdash", "ndash", "lsquo", "rsquo", "ldquo", "rdquo", "bull", "hellip", "euro", "pound", "yen", "cent", "sect", "para", "deg", "plusmn", "times", "divide", "frac12", "frac14", "frac34", "laquo", "raquo"]


def _strip(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for name in _KNOWN:
        x = f"replace({x}, '&{name};', '{H.ENTITIES[name]}')"
    for name, to in H.XML_ENTITIES.items():
        x = f"replace({x}, '&{name};', chr(57344 + {list(H.XML_ENTITIES).index(name)}))"
    x = f"regexp_replace({x}, '&[A-Za-z][A-Za-z0-9]{{1,10}};', '\ufffd', 'g')"
    for i, to in enumerate(H.XML_ENTITIES.values()):
        x = f"replace({x}, chr({57344 + i}), {chr(39) + to.replace(chr(39), chr(39) * 2) + chr(39)})"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_strip(_CLEAN)} AS text FROM pages")
def html_text(s, d):
    return table(s, d, "pages").select("page_id", H.strip_tags(H.clean(F.col("html"))).alias("text"))


@query(f"SELECT page_id, {_strip('regexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)')} AS title FROM pages")
def html_titles(s, d):
    return table(s, d, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query("SELECT page_id, i - 1 AS link_no, l[i] AS href FROM (SELECT page_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1) AS l FROM pages))")
def html_links(s, d):
    return H.anchors(table(s, d, "pages")).select("page_id", F.col("link_no").cast("long").alias("link_no"), "href")


@query(f"SELECT page_id, lower(t) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all({_CLEAN}, '(?i)<(h[1-6]|p|li|td|th|blockquote|pre)\\b[^>]*>', 1)) AS t FROM pages) GROUP BY ALL")
def html_blocks(s, d):
    return H.blocks(table(s, d, "pages")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, max(CASE lower(t) WHEN 'h1' THEN 24 WHEN 'h2' THEN 20 WHEN 'h3' THEN 16 WHEN 'h4' THEN 14 ELSE 12 END) AS largest FROM (SELECT page_id, unnest(regexp_extract_all({_CLEAN}, '(?i)<(h[1-6]|p|li|td|th|blockquote|pre)\\b[^>]*>', 1)) AS t FROM pages) GROUP BY page_id")
def html_block_sizes(s, d):
    return H.blocks(table(s, d, "pages")).groupBy("page_id").agg(F.max("size").alias("largest"))


@query(f"SELECT page_id, count(*) AS n, '• ' AS marker FROM (SELECT page_id, unnest(regexp_extract_all({_CLEAN}, '(?i)<li\\b', 0)) FROM pages) GROUP BY page_id")
def html_list_items(s, d):
    return H.list_items(table(s, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n"), F.max("marker").alias("marker"))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<body\\b[^>]*>(.+)</body>') THEN length(regexp_extract(html, '(?is)<body\\b[^>]*>(.*)</body>', 1)) ELSE length(html) END AS n_body, regexp_matches(html, '(?i)</html>') AS closed FROM pages")
def html_body(s, d):
    return table(s, d, "pages").select("page_id", F.length(H.body(F.col("html"))).cast("long").alias("n_body"), F.col("html").rlike("(?i)</html>").alias("closed"))


@query("SELECT page_id, 1 AS hint FROM pages")
def html_page_hint(s, d):
    return table(s, d, "pages").select("page_id", H.page_count_hint(F.col("html")).alias("hint"))


@query("SELECT page_id, (page_id % 100)::VARCHAR || 'px' AS margin, 'bold' AS weight, ((page_id % 100) + 0.0)::DOUBLE AS top, ((page_id % 100) * 12 / 100)::DOUBLE AS side FROM pages")
def html_inline_css(s, d):
    from ..functions.geometry import margins

    n = (F.col("page_id") % 100).cast("string")
    style = F.concat(F.lit("Margin: "), n, F.lit("px; font-weight :bold;;broken"))
    css = H.css(style)
    m = margins(F.concat(n, F.lit("px "), n, F.lit("%")), 12.0)
    return table(s, d, "pages").select("page_id", css["margin"].alias("margin"), css["font-weight"].alias("weight"), m.top.alias("top"), F.round(m.right, 6).alias("side"))


@query("SELECT page_id, r AS row_no, c AS cell_no, CASE WHEN r = 0 THEN 2 ELSE 1 END AS colspan, CASE WHEN r = 0 THEN 'Head & ' || page_id ELSE 'v' || c END AS text, r = 0 AS header FROM pages, (VALUES (0, 0), (1, 0), (1, 1)) v(r, c)")
def html_tables(s, d):
    p = table(s, d, "pages").select("page_id", F.concat(F.lit("<table><tbody><tr><th colspan='2'>Head &amp; "), F.col("page_id").cast("string"), F.lit("</th></tr><tr><td><b>v0</b><td>v1</td></tr></table>")).alias("html"))
    return H.table_cells(p).select("page_id", "row_no", "cell_no", "colspan", "text", "header")


@query("SELECT page_id, 'image/png' AS mime, 'x' || page_id AS data FROM pages")
def html_images(s, d):
    p = table(s, d, "pages").select("page_id", F.concat(F.lit("<img src='http://a/b.png'><img alt=x src=\"data:image/png;base64,"), F.base64(F.encode(F.concat(F.lit("x"), F.col("page_id").cast("string")), "UTF-8")), F.lit("\">")).alias("html"))
    return H.images(p).select("page_id", "mime", F.decode("data", "UTF-8").alias("data"))
