"""Queries over PDF files that are written from documents and read back by the engine's parser."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D, text as T
from ..operators import layout as L, pages as P, validate as V
from ..session import shared_dir
from ..sources import codecs, pdf_core, pdf_writer
from ..sources.fixtures import to_pdf
from ..sources.relations import scan
from .registry import LINES, SIZES, query, table


def _files(s, d, kind: str = "rich") -> DataFrame:
    return to_pdf(table(s, d, "documents"), kind)


def _read(s, d, relation: str, kind: str = "rich") -> DataFrame:
    return scan(_files(s, d, kind), relation)


@query(f"WITH {SIZES} SELECT doc_id, '1.7' AS version, n_pages, false AS rebuilt, false AS encrypted, false AS linearized, 1::BIGINT AS n_startxref FROM d")
def pdf_files(s, d):
    return _read(s, d, "files").select("doc_id", "version", "n_pages", "rebuilt", "encrypted", "linearized", "n_startxref")


@query(f"WITH {SIZES} SELECT doc_id, n_pages, n_lines AS n_fragments FROM d")
def pdf_recovery(s, d):
    """Files without cross references, with wrong lengths or a wrong root still give all their pages and text."""
    files = _files(s, d, "damaged")
    text = scan(files, "fragments").groupBy("doc_id").agg(F.count("*").alias("n_fragments"))
    return scan(files, "files").select("doc_id", "n_pages").join(text, "doc_id")


@query("SELECT doc_id, 'no PDF header' AS error FROM documents WHERE doc_id % 9 = 0")
def pdf_errors(s, d):
    """What is no PDF gives an error row and no failure."""
    files = _files(s, d, "plain").withColumn("content", F.when(F.col("doc_id") % 9 == 0, F.encode(F.lit("nothing here"), "UTF-8")).otherwise(F.col("content")))
    return scan(files, "errors").select("doc_id", "error")


@query(f"""WITH {SIZES} SELECT doc_id, 'Page' AS type, n_pages AS n FROM d UNION ALL SELECT doc_id, 'Annot', doc_id % 4 FROM d WHERE doc_id % 4 > 0 UNION ALL SELECT doc_id, t, 1 FROM d, (VALUES ('Catalog'), ('Pages'), ('Font'), ('ExtGState'), ('Outlines'), ('StructTreeRoot')) v(t)
UNION ALL SELECT doc_id, 'XObject', 2 FROM d UNION ALL SELECT doc_id, 'EmbeddedFile', 1 FROM d WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'Metadata', 1 FROM d WHERE doc_id % 2 = 0""")
def pdf_object_types(s, d):
    return _read(s, d, "objects").where("type is not null").groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query(f"WITH {SIZES} SELECT doc_id, n_pages AS n_stream_pages, 'dictionary' AS page_kind FROM d")
def pdf_find_objects(s, d):
    """Objects by type and key."""
    o = _read(s, d, "objects").where((F.col("type") == "Page") & F.array_contains("keys", "Contents"))
    return o.groupBy("doc_id").agg(F.count("*").alias("n_stream_pages"), F.max("cos_type").alias("page_kind"))


@query(f"WITH {SIZES} SELECT doc_id, n_pages AS n FROM d")
def pdf_references(s, d):
    """Objects whose /Parent is the page tree's root."""
    r = _read(s, d, "refs").where("path = '/Parent' and target = 2")
    return r.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, true AS all_reached FROM documents")
def pdf_reachable(s, d):
    """Objects reachable from the trailer, by joins; in these files the page tree always is."""
    refs = _read(s, d, "refs", "plain").select("doc_id", F.col("obj_num").alias("src"), F.col("target").alias("dst")).distinct()
    if not s.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        s.sparkContext.setCheckpointDir(shared_dir(s))
    roots = refs.where("src = 0").select("doc_id", F.col("src").alias("node")).distinct()
    seen = P.reachable(roots, refs, ["doc_id"])
    n = _read(s, d, "objects", "plain").groupBy("doc_id").agg(F.count("*").alias("n"))
    return seen.where("node > 0").groupBy("doc_id").agg(F.count("*").alias("k")).join(n, "doc_id").select("doc_id", (F.col("k") == F.col("n")).alias("all_reached"))


@query(f"WITH {SIZES} SELECT doc_id, p AS page_no, CASE WHEN p = 1 THEN 90 * (doc_id % 4) ELSE 0 END AS rotate, 612.0::DOUBLE AS urx, 806.0::DOUBLE AS crop_ury FROM (SELECT doc_id, unnest(generate_series(1, n_pages)) AS p FROM d)")
def pdf_pages(s, d):
    """Boxes are inherited, the crop box from the media box."""
    return _read(s, d, "pages").select("doc_id", "page_no", "rotate", "urx", "crop_ury")


@query(f"WITH {SIZES} SELECT doc_id, 'Tj' AS op, n_lines AS n FROM d UNION ALL SELECT doc_id, 'Tm', n_lines FROM d UNION ALL SELECT doc_id, o, n_pages FROM d, (VALUES ('BT'), ('ET'), ('Tf')) v(o)")
def pdf_operators(s, d):
    return _read(s, d, "operators", "plain").groupBy("doc_id", "op").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, page_no, frag_idx, text, x, y FROM lines")
def pdf_fragments(s, d):
    """Text at its place comes back as it was written."""
    return _read(s, d, "fragments", "plain").select("doc_id", "page_no", "frag_idx", "text", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("SELECT doc_id, text FROM documents")
def pdf_text(s, d):
    f = _read(s, d, "fragments", "plain")
    return L.page_text(L.page_text(f, ["doc_id", "page_no"], ["frag_idx"]), ["doc_id"], ["page_no"])


@query(f"WITH {LINES} SELECT doc_id, page_no, count(*) AS n FROM (SELECT doc_id, page_no, unnest(generate_series(1, (length(text) - length(replace(text, 'tion', ''))) // 4)) AS m FROM lines) GROUP BY ALL")
def pdf_search(s, d):
    return L.matches(_read(s, d, "fragments", "plain"), "tion").groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 1::BIGINT AS page_no, 'Im1' AS name, 100.0::DOUBLE AS a, 50.0::DOUBLE AS d, 72.0::DOUBLE AS e, 600.0::DOUBLE AS f FROM documents WHERE doc_id % 3 = 0")
def pdf_image_placements(s, d):
    return _read(s, d, "images").select("doc_id", "page_no", "name", "a", "d", "e", "f")


@query(f"WITH {SIZES} SELECT doc_id, 'XObject' AS category, x AS name, n_pages - CASE WHEN x = 'Im1' AND doc_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM d, (VALUES ('Im1'), ('Fm1')) v(x) WHERE n_pages - CASE WHEN x = 'Im1' AND doc_id % 3 = 0 THEN 1 ELSE 0 END > 0")
def pdf_unused_resources(s, d):
    """XObjects of a page that no Do on it draws."""
    files = _files(s, d)
    drawn = scan(files, "operators").where("op = 'Do'").select("doc_id", "page_no", F.col("operands")[0].alias("name")).distinct()
    x = scan(files, "resources").where("category = 'XObject'").select("doc_id", "page_no", "category", "name")
    return x.join(drawn, ["doc_id", "page_no", "name"], "left_anti").groupBy("doc_id", "category", "name").agg(F.count("*").alias("n"))


@query(f"WITH {SIZES} SELECT doc_id, 'Helvetica' AS base_font, false AS embedded, n_pages AS n_pages FROM d")
def pdf_fonts(s, d):
    """Fonts with the pages whose resources name them."""
    files = _files(s, d)
    used = scan(files, "resources").where("category = 'Font'").groupBy("doc_id", "obj_num").agg(F.count("*").alias("n_pages"))
    return scan(files, "fonts").join(used, ["doc_id", "obj_num"]).select("doc_id", "base_font", "embedded", "n_pages")


@query("""SELECT doc_id, k + 1 AS annot_idx, ['Text', 'Link', 'Highlight', 'Sound'][k % 4 + 1] AS subtype, 'note ' || k || ' of ' || doc_id AS contents, CASE WHEN k % 2 = 0 THEN 'print' ELSE 'hidden' END AS flags, (10.0 * k)::DOUBLE AS llx,
CASE WHEN k = 1 AND doc_id % 8 < 4 THEN 'http://example.org/' || doc_id END AS uri FROM (SELECT doc_id, unnest(generate_series(0, doc_id % 4 - 1)) AS k FROM documents)""")
def pdf_annotations(s, d):
    a = _read(s, d, "annotations")
    return a.select("doc_id", "annot_idx", "subtype", "contents", T.flags_to_names(F.col("flags").cast("int")).alias("flags"), "llx", "uri")


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(generate_series(0, doc_id % 4 - 1)) AS k FROM documents) WHERE contains('note ' || k || ' of ' || doc_id, 'note 1') GROUP BY doc_id")
def pdf_search_annotations(s, d):
    return L.matches(_read(s, d, "annotations"), "note 1", text_col="contents").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, k + 1 AS annot_idx, CASE WHEN k % 2 = 1 THEN 'new' ELSE 'b' END AS title FROM (SELECT doc_id, unnest(generate_series(0, doc_id % 4 - 1)) AS k FROM documents)""")
def pdf_rename_author(s, d):
    """Annotations of one author get another."""
    return _read(s, d, "annotations").select("doc_id", "annot_idx", F.when(F.col("title") == "a", "new").otherwise(F.col("title")).alias("title"))


@query("SELECT doc_id, k + 1 AS ord, 'form.f' || k AS name, CASE WHEN k = 0 THEN 'text' ELSE 'check' END AS kind, CASE WHEN k = 0 THEN 'value ' || doc_id ELSE 'Off' END AS value FROM (SELECT doc_id, unnest(generate_series(0, doc_id % 3 - 1)) AS k FROM documents)")
def pdf_fields(s, d):
    return _read(s, d, "fields").select("doc_id", "ord", "name", "kind", "value")


@query("SELECT doc_id, 'form.f0' AS name, 'filled ' || lang AS value FROM documents WHERE doc_id % 3 > 0")
def pdf_fill_fields(s, d):
    """Values by field name from another table."""
    new = table(s, d, "documents").select("doc_id", F.lit("form.f0").alias("name"), F.concat(F.lit("filled "), "lang").alias("value"))
    return _read(s, d, "fields").select("doc_id", "name").join(new, ["doc_id", "name"])


@query(f"WITH {SIZES} SELECT doc_id, CASE WHEN p = 1 THEN 1 ELSE p + 1 END AS ord, 1 AS level, 'Page ' || p AS title, p AS page_no FROM (SELECT doc_id, unnest(generate_series(1, n_pages)) AS p FROM d) UNION ALL SELECT doc_id, 2, 2, 'Start', 1 FROM d")
def pdf_outlines(s, d):
    return _read(s, d, "outlines").select("doc_id", "ord", "level", "title", "page_no")


@query(f"WITH {SIZES} SELECT doc_id, n_pages + 1 AS visible, n_pages + 1 AS total FROM d")
def pdf_visible_outlines(s, d):
    v = P.visible_outlines(_read(s, d, "outlines"), ["doc_id"])
    return v.select("doc_id", F.col("visible").cast("long").alias("visible"), F.col("total").cast("long").alias("total"))


@query(f"WITH {SIZES} SELECT doc_id, 1 AS ord, 'alpha' AS name, 1 AS page_no, 'tree' AS source FROM d UNION ALL SELECT doc_id, 2, 'last', n_pages, 'tree' FROM d UNION ALL SELECT doc_id, 3, 'legacy', 1, 'legacy' FROM d")
def pdf_destinations(s, d):
    """The name tree first, then the old dictionary; a name counts once."""
    return _read(s, d, "destinations").select("doc_id", "ord", "name", "page_no", "source")


@query(f"WITH {SIZES} SELECT doc_id, p AS page_no, CASE WHEN p <= 4 THEN ['i', 'ii', 'iii', 'iv'][p] ELSE 'A-' || (p - 4) END AS label FROM (SELECT doc_id, unnest(generate_series(1, n_pages)) AS p FROM d)")
def pdf_page_labels(s, d):
    files = _files(s, d)
    return P.labelled(scan(files, "pages").select("doc_id", "page_no"), scan(files, "labels"), ["doc_id"])


@query(f"WITH {SIZES} SELECT doc_id, 'Document ' || doc_id AS title, make_timestamp(2024, (doc_id % 12 + 1)::BIGINT, (doc_id % 28 + 1)::BIGINT, 3, 4, 5) AS created, 120::BIGINT AS off, n_pages::VARCHAR AS pages FROM d")
def pdf_info(s, d):
    i = _read(s, d, "info").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("i"))
    at = lambda k: F.col("i")[k]
    return i.select("doc_id", at("Title").alias("title"), D.parse(at("CreationDate")).alias("created"), D.offset_minutes(at("CreationDate")).cast("long").alias("off"), at("Pages").alias("pages"))


@query("SELECT doc_id, '1' AS part, 'Document ' || doc_id AS title FROM documents WHERE doc_id % 2 = 0")
def pdf_xmp(s, d):
    x = _read(s, d, "xmp")
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return x.groupBy("doc_id").agg(pick("pdfaid:part").alias("part"), pick("dc:title").alias("title"))


@query("SELECT doc_id, 'notes.txt' AS name, 'text/plain' AS mime, octet_length(encode(text))::BIGINT AS size, text FROM documents WHERE doc_id % 5 = 0")
def pdf_attachments(s, d):
    a = _read(s, d, "attachments")
    return a.select("doc_id", "name", "mime", "size", F.decode("data", "UTF-8").alias("text"))


@query("SELECT doc_id, 1 AS ord, 1 AS level, 'Document' AS kind, '' AS mcids FROM documents UNION ALL SELECT doc_id, i + 2, 2, 'P', i || ',' || (i + 100) FROM documents, (VALUES (0), (1)) v(i)")
def pdf_structure(s, d):
    return _read(s, d, "struct_elements").select("doc_id", "ord", "level", "kind", F.array_join(F.transform("mcids", lambda x: x.cast("string")), ",").alias("mcids"))


@query("SELECT doc_id, 'catalog/AA' AS place, NULL::VARCHAR AS kind FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'annotation', CASE WHEN doc_id % 8 < 4 THEN 'URI' ELSE 'JavaScript' END FROM documents WHERE doc_id % 4 >= 2")
def pdf_actions(s, d):
    return _read(s, d, "actions").select("doc_id", "place", "kind")


@query(f"WITH {SIZES} SELECT doc_id, 1 AS page_no, ['Undefined', 'Rgb', 'Grayscale', 'BlackAndWhite', 'BlackAndWhite'][doc_id % 5 + 1] AS colour FROM d")
def pdf_colour_class(s, d):
    ops = _read(s, d, "operators").where("page_no = 1")
    return L.colour_class(ops, ["doc_id", "page_no"])


@query("SELECT doc_id, 1 AS page_no, 10.0::DOUBLE AS llx, 15.0::DOUBLE AS urx, 25.0::DOUBLE AS ury FROM documents")
def pdf_content_box(s, d):
    """A rectangle under a moved matrix; q, Q and cm are folded in order."""
    files = _files(s, d)
    ops = scan(files, "operators").where("page_no = 1 and op in ('q', 'Q', 'cm', 're')")
    box = L.content_boxes(ops, scan(files, "pages").where("page_no = 1"), ["doc_id", "page_no"])
    return box.select("doc_id", "page_no", "llx", "urx", "ury")


@query(f"WITH {SIZES} SELECT doc_id, 1 AS deepest, 0 AS at_end FROM d")
def pdf_gstate_depth(s, d):
    ops = L.gstate_depth(_read(s, d, "operators").where("page_no = 1"), ["doc_id", "page_no"])
    return ops.groupBy("doc_id").agg(F.max("depth").alias("deepest"), F.max_by("depth", "op_idx").alias("at_end"))


@query(f"WITH {SIZES} SELECT doc_id, len([p FOR p IN generate_series(1, n_pages) IF (doc_id + p) % 3 = 0])::BIGINT AS n_blank FROM d WHERE n_lines > 0")
def pdf_blank_pages(s, d):
    """Blank pages of each file, after a path that ends without paint took the place of the instructions of every third page."""
    files = _files(s, d, "plain")
    pages = scan(files, "pages")
    drawn = scan(files, "operators").withColumn("op", F.when((F.col("doc_id") + F.col("page_no")) % 3 == 0, "n").otherwise(F.col("op")))
    blank = L.blank_pages(drawn, pages, ["doc_id", "page_no"]).groupBy("doc_id").agg(F.count("*").alias("n"))
    return pages.select("doc_id").distinct().join(blank, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_blank"))


_FONT = "SELECT doc_id, '6.3.4' AS rule_id, 'Font is missing FontDescriptor (font not embedded): Helvetica' AS message, 1 AS n FROM d"
_SAID = f"""WITH {SIZES}, k AS (SELECT doc_id, unnest(generate_series(0, doc_id % 4 - 1)) AS k FROM documents)
{_FONT} UNION ALL SELECT doc_id, '6.1.3', 'Trailer must contain /ID array', 1 FROM d WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, '6.1.11', 'PDF/A-1 must not have /EmbeddedFiles in the names dictionary', 1 FROM d WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, '6.1.13', 'PDF/A-1 must not have /OCProperties (optional content) in the catalog', 1 FROM d WHERE false
UNION ALL SELECT doc_id, '6.1.13', 'PDF/A-1 must not contain /OCProperties (optional content) in the catalog', 1 FROM d WHERE doc_id % 6 = 0
UNION ALL SELECT doc_id, '6.2.2', 'Device color space DeviceGray used without GTS_PDFA1 OutputIntent', n_pages FROM d
UNION ALL SELECT doc_id, '6.2.4', 'Image XObject /Interpolate must be false', n_pages FROM d WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, '6.4', 'PDF/A-1: ExtGState /CA must be 1.0, found: 0.5', n_pages FROM d WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, '6.5.3', 'Annotation /F flag must have Print bit set', 1 FROM k WHERE k = 1
UNION ALL SELECT doc_id, '6.5.3', 'Annotation /F flag must not have Hidden bit set', 1 FROM k WHERE k = 1
UNION ALL SELECT doc_id, '6.6.2', 'Catalog must not contain /AA (additional actions)', 1 FROM d WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id, '6.6.1', 'Action type ''JavaScript'' is not permitted in PDF/A', 1 FROM d WHERE doc_id % 4 >= 2 AND doc_id % 8 >= 4
UNION ALL SELECT doc_id, '6.7.2', 'Catalog must contain /Metadata stream for PDF/A compliance', 1 FROM d WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id, '6.9.1', 'AcroForm /NeedAppearances must be false or absent for PDF/A compliance', 1 FROM d WHERE doc_id % 3 > 0 AND doc_id % 2 = 0"""


def _spread(docs: DataFrame) -> DataFrame:
    """Documents dealt out evenly: a file's parse takes far longer than its way, and a table may be one row group."""
    s = docs.sparkSession
    return docs.select("doc_id", "text").repartition(max(int(s.conf.get("spark.sql.shuffle.partitions")), s.sparkContext.defaultParallelism))


@query(_SAID)
def validate_pdf_a(s, d):
    v = V.validate(to_pdf(_spread(table(s, d, "documents")), "rich"), "PDF/A-1b")
    return v.groupBy("doc_id", "rule_id", "message").agg(F.count("*").alias("n"))


@query(f"""WITH {SIZES} SELECT doc_id, rule_id, n FROM (SELECT doc_id, 'PDFX-VERSION' AS rule_id, 1 AS n FROM d UNION ALL SELECT doc_id, 'PDFX-CONFORMANCE', 1 FROM d UNION ALL SELECT doc_id, 'PDFX-TRAPPED', 1 FROM d UNION ALL SELECT doc_id, 'PDFX-OUTPUTINTENT', 1 FROM d UNION ALL SELECT doc_id, 'PDFX-TRIMBOX', n_pages FROM d UNION ALL SELECT doc_id, 'PDFX-FONT-EMBED', 1 FROM d)""")
def validate_pdf_x(s, d):
    return V.validate(_files(s, d), "PDF/X-1a:2001").groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, false AS compliant FROM documents")
def compliance(s, d):
    """All files are listed by the table's ids, so that none is written twice."""
    docs = table(s, d, "documents")
    return V.compliant(docs.select(F.col("doc_id").cast("long")), V.validate(to_pdf(_spread(docs), "rich"), "PDF/A-2u")).select("doc_id", "compliant")


@query("SELECT doc_id, count(*) AS n_left, 4::BIGINT AS flags FROM (SELECT doc_id, unnest(generate_series(0, doc_id % 4 - 1)) AS k FROM documents) GROUP BY doc_id")
def fix_annotations(s, d):
    a = V.fixed_annotations(_read(s, d, "annotations"))
    return a.groupBy("doc_id").agg(F.count("*").alias("n_left"), F.max("flags").alias("flags"))


@query(f"WITH {SIZES} SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN n_pages ELSE 0 END::BIGINT AS n_clear, n_pages AS n_smooth, 0::BIGINT AS n_left FROM d")
def fix_resources(s, d):
    """Graphics states that are not opaque and images with /Interpolate, and how many of both the fix leaves."""
    clear = F.coalesce(F.col("attrs")["CA"], F.lit("1")) != "1"
    smooth = F.array_contains("keys", "Interpolate")
    x = V.fixed_resources(_read(s, d, "resources").withColumn("clear", clear).withColumn("smooth", smooth))
    return x.groupBy("doc_id").agg(F.count_if("clear").alias("n_clear"), F.count_if("smooth").alias("n_smooth"), F.count_if(clear | smooth).alias("n_left"))


@query("SELECT doc_id, true AS clean FROM documents")
def fix_catalogs(s, d):
    c = V.fixed_catalogs(_read(s, d, "catalogs"))
    return c.select("doc_id", (~F.arrays_overlap("keys", F.array(F.lit("AA"), F.lit("OCProperties"))) & F.array_contains("keys", "OutputIntents")).alias("clean"))


@query("SELECT doc_id, c AS codec, md5(text) AS digest FROM documents, (VALUES ('FlateDecode'), ('ASCIIHexDecode'), ('ASCII85Decode'), ('RunLengthDecode'), ('LZWDecode'), ('chain')) v(c)")
def codec_round_trip(s, d):
    """Every codec, and a chain of two, gives back what went in."""
    @F.pandas_udf("binary")
    def both(data: pd.Series, name: pd.Series) -> pd.Series:
        chain = lambda n: ["ASCII85Decode", "FlateDecode"] if n == "chain" else [n]
        return pd.Series([codecs.decode_chain(codecs.encode_chain(x, chain(n)), chain(n)) for x, n in zip(data, name)])

    names = F.explode(F.array(*map(F.lit, ["FlateDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode", "LZWDecode", "chain"])))
    t = table(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"), names.alias("codec"))
    return t.select("doc_id", "codec", F.md5(both("data", "codec")).alias("digest"))


@query(f"WITH {SIZES} SELECT doc_id, 2::BIGINT AS n_startxref, n_pages, 'Courier' AS base_font FROM d")
def pdf_incremental(s, d):
    """An appended revision: the newest object of a number counts."""
    @F.pandas_udf("binary")
    def revise(data: pd.Series) -> pd.Series:
        font = {"Type": pdf_core.Name("Font"), "Subtype": pdf_core.Name("Type1"), "BaseFont": pdf_core.Name("Courier")}
        at = lambda x: int(x.rsplit(b"startxref\n", 1)[1].split()[0])
        return data.map(lambda x: pdf_writer.appended(x, {3: font}, 1, 4, at(x)))

    files = _files(s, d, "plain").withColumn("content", revise("content"))
    f = scan(files, "files").select("doc_id", "n_startxref", "n_pages")
    return f.join(scan(files, "fonts").select("doc_id", "base_font"), "doc_id")


@query(f"WITH {LINES} SELECT doc_id, page_no, string_agg('<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>', '' ORDER BY frag_idx) AS html FROM lines GROUP BY ALL")
def pdf_to_html(s, d):
    from ..operators.html import to_html

    return to_html(_read(s, d, "fragments", "plain"), ["doc_id", "page_no"], flow=True)


@query()
def pdf_xref(s, d):
    """Cross references: counts by kind of entry."""
    return _read(s, d, "xref").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
