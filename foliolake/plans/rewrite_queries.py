"""Queries for lookups among and rewrites of rows: instructions, outlines, annotations, metadata, fixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edit as E, layout as L, pages as P, validate as V
from ..sources.fixtures import to_pdf
from ..sources.relations import create_views, scan
from .registry import LINES, SIZES, query, table

_PAGES = "p AS (SELECT doc_id, n_pages, unnest(generate_series(1, n_pages)) AS p FROM d)"


def _read(s, d, relation, kind="rich"):
    return scan(to_pdf(table(s, d, "documents"), kind), relation)


@query(f"WITH {SIZES} SELECT doc_id, n_lines + 3 * n_pages AS n FROM d")
def remove_all_text(s, d):
    return E.without_text(_read(s, d, "operators", "plain")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, page_no, count(*) AS n FROM lines GROUP BY ALL")
def select_operators(s, d):
    return E.selected(_read(s, d, "operators", "plain"), "Tj").groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))


@query(f"WITH {SIZES} SELECT doc_id, 2 * n_lines + 2 * n_pages AS n FROM d")
def delete_operators(s, d):
    """Without each page's first instruction."""
    ops = _read(s, d, "operators", "plain")
    return E.removed(ops, ops.where("op_idx = 1"), ["doc_id", "page_no", "op_idx"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, page_no, '> ' || text AS text FROM lines")
def set_fragment_text(s, d):
    text = _read(s, d, "fragments", "plain").select("doc_id", "page_no", "op_idx", F.concat(F.lit("> "), "text").alias("text"))
    ops = E.with_fragment_text(_read(s, d, "operators", "plain"), text, ["doc_id", "page_no"])
    return E.selected(ops, "Tj").select("doc_id", "page_no", F.col("operands")[0].alias("text"))


@query(f"WITH {LINES} SELECT doc_id, page_no, sum(length(text) + 2)::BIGINT AS n_chars FROM lines GROUP BY ALL")
def visit_operators(s, d):
    ops = E.visited(_read(s, d, "operators", "plain"), {"Tj": lambda c: F.transform(c, lambda x: F.concat(F.lit("<"), x, F.lit(">")))})
    return E.selected(ops, "Tj").groupBy("doc_id", "page_no").agg(F.sum(F.length(F.col("operands")[0])).alias("n_chars"))


@query("SELECT doc_id, 1::BIGINT AS page_no, 'Im1' AS name FROM documents WHERE doc_id % 3 = 0")
def images_used(s, d):
    return E.used_images(_read(s, d, "resources"), _read(s, d, "operators"), ["doc_id", "page_no"]).select("doc_id", "page_no", "name")


@query(f"""WITH {SIZES}, {_PAGES} SELECT doc_id, 'Page ' || p AS title, CASE WHEN p > 1 THEN 'Page ' || (p - 1) END AS prev, CASE WHEN p < n_pages THEN 'Page ' || (p + 1) END AS next, CASE WHEN p = 1 THEN 'Start' END AS first_child, CASE WHEN p = 1 THEN 'Start' END AS last_child FROM p
UNION ALL SELECT doc_id, 'Start', NULL, NULL, NULL, NULL FROM d""")
def outline_neighbours(s, d):
    return E.outline_neighbours(_read(s, d, "outlines"), ["doc_id"]).select("doc_id", "title", "prev", "next", "first_child", "last_child")


@query(f"WITH {SIZES} SELECT doc_id, 3::BIGINT AS ord, 2::BIGINT AS page_no FROM d WHERE n_pages >= 2")
def bookmark_by_title(s, d):
    return _read(s, d, "outlines").where("title = 'Page 2'").select("doc_id", "ord", "page_no")


@query("SELECT doc_id, i AS ord, 'P' AS kind FROM documents, (VALUES (2), (3)) v(i)")
def structure_by_type(s, d):
    return _read(s, d, "struct_elements").where("kind = 'P'").select("doc_id", "ord", "kind")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'P' WHEN 'de' THEN 'H1' ELSE lang END AS kind FROM documents")
def role_map(s, d):
    roles = F.create_map(*map(F.lit, ["en", "P", "de", "H1"]))
    return table(s, d, "documents").select("doc_id", E.standard_type(roles, F.col("lang")).alias("kind"))


@query("SELECT doc_id, k + 1 AS a, k + 2 AS b FROM (SELECT doc_id, unnest(generate_series(0, doc_id % 4 - 2)) AS k FROM documents)")
def overlapping_annotations(s, d):
    a = _read(s, d, "annotations").select("doc_id", "page_no", "annot_idx", "llx", "lly", "urx", "ury")
    return E.overlapping(a, a, ["doc_id", "page_no"]).where("l.annot_idx < r.annot_idx").select("doc_id", F.col("l.annot_idx").alias("a"), F.col("r.annot_idx").alias("b"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS annot_idx, ['Text', 'Link', 'Highlight', 'Stamp'][k + 1] AS subtype
FROM (SELECT doc_id, unnest(generate_series(0, doc_id % 4 - 1)) AS k FROM documents UNION ALL SELECT doc_id, 3 FROM documents) WHERE k <> 2""")
def annotation_rows(s, d):
    """Highlights deleted, a stamp added to the first page."""
    a = _read(s, d, "annotations").select("doc_id", "page_no", "annot_idx", "subtype")
    stamp = table(s, d, "documents").select("doc_id", F.lit(1).cast("long").alias("page_no"), F.lit(1 << 40).alias("annot_idx"), F.lit("Stamp").alias("subtype"))
    keys = ["doc_id", "page_no", "annot_idx"]
    left = E.put_rows(E.removed(a, a.where("subtype = 'Highlight'"), keys), stamp, keys)
    return E.renumbered(left, ["doc_id", "page_no"], ["annot_idx"], "annot_idx").select("doc_id", "annot_idx", "subtype")


@query("SELECT doc_id, 'Title' AS key, source AS value FROM documents UNION ALL SELECT doc_id, 'Author', lang FROM documents")
def set_meta_info(s, d):
    t = table(s, d, "documents")
    new = t.select("doc_id", F.lit("Title").alias("key"), F.col("source").alias("value")).unionAll(t.select("doc_id", F.lit("Author"), "lang"))
    return E.put_rows(_read(s, d, "info"), new, ["doc_id", "key"]).where("key in ('Title', 'Author')")


@query("SELECT doc_id, 'dc:title' AS key, 'Document ' || doc_id AS value FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'pdfaid:part', '2' FROM documents")
def set_xmp(s, d):
    """A property set everywhere, one removed."""
    new = table(s, d, "documents").select("doc_id", F.lit("pdfaid:part").alias("key"), F.lit("2").alias("value"))
    x = _read(s, d, "xmp")
    return E.put_rows(E.removed(x, x.where("key = 'pdfaid:conformance'"), ["doc_id", "key"]), new, ["doc_id", "key"])


@query("SELECT doc_id, 'notes.txt' AS name, CASE WHEN doc_id % 5 = 0 THEN octet_length(encode(text)) ELSE 1 END::BIGINT AS size FROM documents UNION ALL SELECT doc_id, 'more.txt', 2 FROM documents")
def merge_attachments(s, d):
    more = table(s, d, "documents").select("doc_id", F.explode(F.array(F.struct(F.lit("notes.txt").alias("name"), F.lit(1).cast("long").alias("size")), F.struct(F.lit("more.txt").alias("name"), F.lit(2).cast("long").alias("size")))).alias("f"))
    return E.merged_attachments([_read(s, d, "attachments").select("doc_id", "name", "size"), more.select("doc_id", "f.*")], ["doc_id"])


@query(f"WITH {SIZES}, {_PAGES} SELECT doc_id, p AS page_no, 'Page ' || p || ' of ' || n_pages AS overlay FROM p")
def running_text(s, d):
    p = P.pages_of(L.virtual_lines(table(s, d, "documents"))).select("doc_id", "page_no").distinct()
    return E.running_text(p, ["doc_id"])


@query(f"WITH {LINES} SELECT doc_id, page_no, frag_idx, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY frag_idx // 3, -length(text), frag_idx) AS ord FROM lines")
def rotated_order(s, d):
    f = L.virtual_lines(table(s, d, "documents")).withColumns({"x": F.col("frag_idx").cast("double"), "y": F.length("text").cast("double")})
    return L.rotated_order(f, ["doc_id", "page_no"], 270).select("doc_id", "page_no", "frag_idx", "ord")


@query(f"WITH {LINES} SELECT doc_id, page_no, avg(y) AS average_y FROM lines GROUP BY ALL")
def line_averages(s, d):
    return L.line_averages(L.virtual_lines(table(s, d, "documents")), ["doc_id", "page_no"])


@query("SELECT doc_id, lang AS first_value, doc_id::VARCHAR AS second_value, NULL::VARCHAR AS absent FROM documents")
def xfa_values(s, d):
    x = F.concat(F.lit("<xfa:datasets xmlns:xfa='x'><xfa:data><form><f>"), F.coalesce("lang", F.lit("")), F.lit("</f><f>"), F.col("doc_id").cast("string"), F.lit("</f></form></xfa:data></xfa:datasets>"))
    t = table(s, d, "documents").select("doc_id", x.alias("xfa"))
    return t.select("doc_id", E.xfa_value("xfa", "form.#subform.f").alias("first_value"), E.xfa_value("xfa", "form.f[1]").alias("second_value"), E.xfa_value("xfa", "form.g").alias("absent"))


_SIGNATURES = "f AS (SELECT doc_id, i AS ord, (doc_id + i) % 3 = 0 AS blank FROM documents, (VALUES (1), (2), (3), (4), (5)) v(i) WHERE (doc_id + i) % 2 = 0)"


def _signature_fields(s, d):
    f = table(s, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("ord"))
    k = F.col("doc_id") + F.col("ord")
    return f.withColumns({"kind": F.when(k % 2 == 0, "signature").otherwise("text"), "value": F.when(k % 3 != 0, "signed")})


@query(f"WITH {_SIGNATURES} SELECT doc_id, ord FROM f WHERE blank")
def blank_signatures(s, d):
    return E.blank_signatures(_signature_fields(s, d)).select("doc_id", "ord")


@query(f"WITH {_SIGNATURES} SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS revision FROM f WHERE NOT blank")
def signature_revisions(s, d):
    return E.signature_revisions(_signature_fields(s, d), ["doc_id"]).select("doc_id", "ord", "revision")


@query(f"WITH {SIZES} SELECT doc_id, n_pages, doc_id % 4 AS n_annotations FROM d")
def sql_views(s, d):
    """A statement over views of the relations."""
    create_views(to_pdf(table(s, d, "documents"), "rich"), "pdf_", ["files", "annotations"])
    return s.sql("SELECT doc_id, n_pages, count(annot_idx) AS n_annotations FROM pdf_files LEFT JOIN pdf_annotations USING (doc_id) GROUP BY doc_id, n_pages")


@query("SELECT doc_id, doc_id % 2 = 1 AS had_id, true AS has_id FROM documents")
def fix_trailers(s, d):
    t = _read(s, d, "trailers").withColumn("had_id", F.array_contains("keys", "ID"))
    return V.fixed_trailers(t).select("doc_id", "had_id", F.array_contains("keys", "ID").alias("has_id"))


@query(f"WITH {SIZES}, {_PAGES} SELECT doc_id, p AS page_no, 612.0::DOUBLE AS trim_urx, 806.0::DOUBLE AS trim_ury FROM p")
def fix_trim_boxes(s, d):
    return V.with_trim_boxes(_read(s, d, "pages")).select("doc_id", "page_no", "trim_urx", "trim_ury")


@query("SELECT doc_id, 'Trapped' AS key, CASE doc_id % 3 WHEN 0 THEN 'True' ELSE 'False' END AS value FROM documents UNION ALL SELECT doc_id, 'GTS_PDFXVersion', 'PDF/X-3:2003' FROM documents UNION ALL SELECT doc_id, 'Title', 'Document ' || doc_id FROM documents")
def fix_pdf_x_info(s, d):
    """/Trapped is True, wrong or missing before."""
    t = table(s, d, "documents")
    own = t.where("doc_id % 3 < 2").select("doc_id", F.lit("Trapped").alias("key"), F.when(F.col("doc_id") % 3 == 0, "True").otherwise("perhaps").alias("value"))
    info = E.put_rows(_read(s, d, "info"), own, ["doc_id", "key"])
    return V.fixed_pdf_x_info(info, t, "PDF/X-3:2003").where("key in ('Trapped', 'GTS_PDFXVersion', 'Title')")
