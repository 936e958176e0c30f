"""Queries for exchange formats and row rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edit as E, exchange as X, layout as L, pages as P
from ..sources.fixtures import to_pdf
from ..sources.relations import scan
from .registry import LINES, SIZES, query, table

_ANNOTS = "k AS (SELECT doc_id, unnest(generate_series(0, doc_id % 4 - 1)) AS k FROM documents)"


def _read(s, d, relation, kind="rich"):
    return scan(to_pdf(table(s, d, "documents"), kind), relation)


@query(f"WITH {_ANNOTS} SELECT doc_id, '<xfdf><annots>' || string_agg('<annot type=\"' || ['Text', 'Link', 'Highlight', 'Sound'][k + 1] || '\" page=\"0\" name=\"n' || k || '\"><contents>note ' || k || ' of ' || doc_id || '</contents></annot>', '' ORDER BY k) || '</annots></xfdf>' AS xfdf FROM k GROUP BY doc_id")
def xfdf_export(s, d):
    return X.xfdf(_read(s, d, "annotations"))


@query(f"WITH {_ANNOTS} SELECT doc_id, 'n' || k AS name, ['Text', 'Link', 'Highlight', 'Sound'][k + 1] AS subtype, 1 AS page_no, 'note ' || k || ' of ' || doc_id AS contents FROM k")
def xfdf_import(s, d):
    return X.read_xfdf(X.xfdf(_read(s, d, "annotations")))


@query(f"WITH {SIZES} SELECT doc_id, CASE WHEN p = 1 THEN 1 ELSE p + 1 END AS ord, 1 AS level, 'Page ' || p AS title, p AS page_no FROM (SELECT doc_id, unnest(generate_series(1, n_pages)) AS p FROM d) UNION ALL SELECT doc_id, 2, 2, 'Start', 1 FROM d")
def bookmark_xml_round_trip(s, d):
    return X.read_bookmarks(X.bookmarks_xml(_read(s, d, "outlines")))


@query("SELECT doc_id, k + 1 AS ord, 'form.f' || k AS name, CASE WHEN k = 0 THEN 'value ' || doc_id ELSE 'Off' END AS value FROM (SELECT doc_id, unnest(generate_series(0, doc_id % 3 - 1)) AS k FROM documents)")
def fdf_round_trip(s, d):
    return X.read_fdf(X.fdf(_read(s, d, "fields")))


@query("SELECT doc_id, k + 1 AS ord, CASE WHEN k = 0 THEN lang ELSE 'Off' END AS value FROM (SELECT doc_id, lang, unnest(generate_series(0, doc_id % 3 - 1)) AS k FROM documents)")
def field_upsert(s, d):
    new = table(s, d, "documents").select("doc_id", F.lit("form.f0").alias("name"), F.col("lang").alias("value"))
    return X.upsert(_read(s, d, "fields"), new, ["doc_id", "name"]).select("doc_id", "ord", "value")


@query("SELECT doc_id, i AS ord, ['a', 'b' || doc_id][i + 1] AS name FROM documents, (VALUES (0), (1)) v(i)")
def xfa_field_names(s, d):
    t = table(s, d, "documents").select("doc_id", F.concat(F.lit("<template><subform><field name='a'/><subform><field name='b"), F.col("doc_id").cast("string"), F.lit("'/></subform></subform></template>")).alias("xfa"))
    return X.xfa_names(t, ["doc_id"], "xfa")


@query("SELECT doc_id, '<log><violation rule=\"6.1.3\" severity=\"ERROR\">no &lt;ID&gt;</violation></log>' AS xml FROM documents WHERE doc_id % 2 = 0")
def violation_log(s, d):
    v = _read(s, d, "trailers").where("not has_id").select("doc_id", F.lit("6.1.3").alias("rule_id"), F.lit("ERROR").alias("severity"), F.lit("no <ID>").alias("message"))
    return X.violations_xml(v)


@query(f"WITH {LINES} SELECT doc_id, page_no, octet_length(encode(string_agg(text, chr(10) ORDER BY frag_idx)))::BIGINT AS size FROM lines GROUP BY ALL")
def split_to_pages(s, d):
    """One row a page with its text's bytes, as a text sink would write them."""
    t = L.page_text(L.virtual_lines(table(s, d, "documents")), ["doc_id", "page_no"], ["frag_idx"])
    return t.select("doc_id", "page_no", F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("size"))


@query(f"WITH {SIZES} SELECT doc_id, p AS page_no, (-10.0)::DOUBLE AS llx, 632.0::DOUBLE AS urx, 636.0::DOUBLE AS crop_urx, CASE WHEN p = 1 THEN (90 * (doc_id % 4) + 90) % 360 ELSE 90 END AS rotate FROM (SELECT doc_id, unnest(generate_series(1, n_pages)) AS p FROM d)".replace("636.0", "632.0"))
def page_margins_and_rotation(s, d):
    p = E.rotated(E.with_margins(_read(s, d, "pages"), 10, 5, 20, 15), 90)
    return p.select("doc_id", "page_no", "llx", "urx", "crop_urx", "rotate")


@query(f"WITH {SIZES} SELECT doc_id, n_lines * 2 + 3 * n_pages + 3 * n_pages AS n, 'q' AS first_op, 'Q' AS last_op FROM d")
def resize_contents(s, d):
    ops = E.resized(_read(s, d, "operators", "plain"), ["doc_id", "page_no"], 0.5, 0.5, 10, 10)
    return ops.groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by("op", F.struct("page_no", "op_idx")).alias("first_op"), F.max_by("op", F.struct("page_no", "op_idx")).alias("last_op"))


@query("SELECT doc_id, round([0.299 * 0.8 + 0.587 * 0.1 + 0.114 * 0.2, 0.0][CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 2 END]::DOUBLE, 6) AS grey FROM documents WHERE doc_id % 5 IN (1, 4)")
def convert_colours(s, d):
    ops = E.to_grey(_read(s, d, "operators").where("page_no = 1 and op in ('rg', 'k')"))
    return ops.where("op = 'g'").select("doc_id", F.round(F.col("numbers")[0], 6).alias("grey"))


@query(f"WITH {SIZES} SELECT doc_id, p AS ord, 1 AS level, 'p. ' || p AS title FROM (SELECT doc_id, unnest(generate_series(1, n_pages)) AS p FROM d)")
def bookmarks_for_pages(s, d):
    p = _read(s, d, "pages", "plain")
    return E.page_bookmarks(p, F.concat(F.lit("p. "), F.col("page_no").cast("string"))).select("doc_id", "ord", "level", "title")


@query("SELECT doc_id, 'alpha,beta,last,legacy' AS after_put, 'last,legacy' AS after_delete, 'last,legacy' AS limits FROM documents")
def name_tree_edits(s, d):
    m = _read(s, d, "destinations").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "page_no"))).alias("m"))
    put, cut = E.tree_put(F.col("m"), F.lit("beta"), F.lit(2).cast("long")), E.tree_delete(F.col("m"), F.lit("alpha"))
    return m.select("doc_id", F.array_join(E.tree_pairs(put).names, ",").alias("after_put"), F.array_join(E.tree_pairs(cut).names, ",").alias("after_delete"), F.array_join(E.tree_pairs(cut).limits, ",").alias("limits"))


@query(f"WITH {SIZES} SELECT doc_id, 'Font' AS category, 'F1' AS name FROM d UNION ALL SELECT doc_id, 'XObject', 'Im1' FROM d WHERE doc_id % 3 = 0")
def used_resource_names(s, d):
    return E.used_resources(_read(s, d, "operators"), ["doc_id"])


@query("SELECT doc_id, 0.0::DOUBLE AS llx, (10.0 * (doc_id % 4) + 10)::DOUBLE AS urx FROM documents WHERE doc_id % 4 > 0")
def annotation_union_box(s, d):
    return E.union_box(_read(s, d, "annotations"), ["doc_id"]).select("doc_id", "llx", "urx")


@query("SELECT doc_id, i AS mcid, 2 + i % 100 AS element FROM documents, (VALUES (0), (1), (100), (101)) v(i)")
def mcid_elements(s, d):
    """Marked content to the structure element that holds it."""
    e = _read(s, d, "struct_elements").select("doc_id", F.col("ord").alias("element"), F.explode("mcids").alias("mcid"))
    return e.select("doc_id", "mcid", "element")


@query("SELECT doc_id, n_lines % 3 + 1 AS artifacts FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines FROM documents)")
def artifacts(s, d):
    """Instructions between /Artifact BMC and EMC, on instruction rows made from line counts."""
    n = table(s, d, "documents").select("doc_id", (F.size(F.split("text", "\n")) % 3 + 1).alias("n"))
    ops = n.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n") * 4)).alias("i"))
    ops = ops.select("doc_id", F.lit(1).alias("page_no"), F.col("i").cast("long").alias("op_idx"), F.element_at(F.array(*map(F.lit, ["BMC", "Tj", "EMC", "Tj"])), ((F.col("i") - 1) % 4 + 1).cast("int")).alias("op"))
    ops = ops.withColumn("operands", F.when(F.col("op") == "BMC", F.array(F.lit("Artifact"))).otherwise(F.array(F.lit("text"))))
    found = L.islands(ops, ["doc_id", "page_no"]).where("op = 'Tj'")
    return found.groupBy("doc_id").agg(F.countDistinct("artifact_no").alias("artifacts"))


@query(f"WITH {SIZES} SELECT doc_id, 2 + n_pages * 2 + 1 AS max_number, n_pages AS n_streams FROM d")
def object_counts(s, d):
    o = _read(s, d, "objects", "plain")
    return o.groupBy("doc_id").agg(F.max("obj_num").alias("max_number"), F.count_if("is_stream").alias("n_streams"))


@query("SELECT doc_id, (length(replace(text, ' ', '')) - len(list_filter(string_split(text, ' '), lambda x: x <> '')))::BIGINT AS joined FROM documents WHERE replace(text, ' ', '') <> ''")
def letter_adjacency(s, d):
    """Single characters that touch the one before."""
    c = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "")).alias("i", "text"))
    c = c.where("text <> ' ' and text <> ''").withColumns({"x": F.col("i") * 6.0, "width": F.lit(6.0)})
    return L.adjacency(c, ["doc_id"], ["i"]).groupBy("doc_id").agg(F.count_if("joined").alias("joined"))


@query(f"WITH {SIZES} SELECT doc_id, n_pages AS kept FROM d")
def cross_reference_merge(s, d):
    """Newest entry of each page over two revisions."""
    p = P.pages_of(L.virtual_lines(table(s, d, "documents")))
    both = p.withColumn("revision", F.lit(1)).unionByName(p.withColumn("revision", F.lit(2)))
    return P.newest(both, ["doc_id", "page_no"], "revision").where("revision = 2").groupBy("doc_id").agg(F.count("*").alias("kept"))
