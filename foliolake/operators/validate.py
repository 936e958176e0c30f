"""Conformance rules: each a filter over relations that gives violations (rule_id, severity, message)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.relations import scan, scan_all

Relations = Callable[[str], DataFrame]
#: Action types that no PDF/A profile permits, and those that later ones forbid as well.
FORBIDDEN_ACTIONS = ["Launch", "Sound", "Movie", "ResetForm", "ImportData", "JavaScript"]
FORBIDDEN_LATER = ["Hide", "SetOCGState", "Rendition", "Trans", "GoTo3DView"]
#: Annotation types that are not permitted in PDF/A-1 and in later profiles.
FORBIDDEN_ANNOTATIONS = {1: ["FileAttachment", "Sound", "Movie"], 2: ["3D", "Sound", "Screen", "Movie"]}
#: Rendering intents.
INTENTS = ["AbsoluteColorimetric", "RelativeColorimetric", "Saturation", "Perceptual"]


class Format:
    """A target: PDF/A part and level, or PDF/X."""

    def __init__(self, name: str):
        self.name = name
        self.is_x = name.startswith("PDF/X")
        self.part = 0 if self.is_x else int(name[6])
        self.level = "" if self.is_x else name[7:8].upper() or "B"

    @property
    def is_x1a(self) -> bool:
        return self.name.startswith("PDF/X-1a")


class Found(NamedTuple):
    """Rows of a relation that break a rule."""

    rows: DataFrame
    test: Column
    rule: str
    severity: str
    message: Column


def _found(df: DataFrame, test: Column, rule: str, message: Column | str, severity: str = "ERROR") -> Found:
    return Found(df, test, rule, severity, message if isinstance(message, Column) else F.lit(message))


def _has(column: str, key: str) -> Column:
    return F.array_contains(column, key)


def file_structure(r: Relations, f: Format) -> list[Found]:
    t, o, c, stream = r("trailers"), r("objects"), r("catalogs"), F.col("is_stream")
    out = [
        _found(t, F.size("keys") == 0, "6.1.3", "No trailer dictionary found"),
        _found(t, ~F.col("has_id"), "6.1.3", "Trailer must contain /ID array"),
        _found(t, F.col("encrypted"), "6.1.3", "Trailer must not contain /Encrypt for PDF/A compliance"),
    ]
    for key in ("F", "FFilter", "FDecodeParms"):
        out.append(_found(o, stream & _has("keys", key), "6.1.7", f"Stream dictionary must not contain /{key} key"))
    out.append(_found(o, stream & F.col("value").contains('"LZWDecode"'), "6.1.10", "LZWDecode filter is not permitted in PDF/A"))
    if f.part == 1:
        out.append(_found(c, F.col("embedded_files"), "6.1.11", "PDF/A-1 must not have /EmbeddedFiles in the names dictionary"))
        out.append(_found(o, (F.col("type") == "Filespec") & _has("keys", "EF"), "6.1.11", "PDF/A-1 file specification must not contain /EF key"))
        out.append(_found(c, _has("keys", "OCProperties"), "6.1.13", "PDF/A-1 must not contain /OCProperties (optional content) in the catalog"))
    return out


def graphics(r: Relations, f: Format) -> list[Found]:
    x = r("resources")
    image, form, state = (F.col("category") == "XObject") & (F.col("subtype") == "Image"), (F.col("category") == "XObject") & (F.col("subtype") == "Form"), F.col("category") == "ExtGState"
    a = F.col("attrs")
    intent = F.coalesce(_has("output_intents", "GTS_PDFA1"), F.lit(False))
    device = (F.col("category") == "XObject") & a["ColorSpace"].isin("DeviceGray", "DeviceRGB", "DeviceCMYK")
    return [
        _found(x, device & ~intent, "6.2.2", F.concat(F.lit("Device color space "), a["ColorSpace"], F.lit(" used without GTS_PDFA1 OutputIntent"))),
        _found(x, (F.col("category") == "XObject") & (F.col("subtype") == "PS"), "6.2.7", "PostScript XObjects (/Subtype=/PS) are not permitted in PDF/A"),
        _found(x, image & _has("keys", "Alternates"), "6.2.4", "Image XObject must not have /Alternates key"),
        _found(x, image & _has("keys", "OPI"), "6.2.4", "Image XObject must not have /OPI key"),
        _found(x, image & (a["Interpolate"] == "true"), "6.2.4", "Image XObject /Interpolate must be false"),
        _found(x, form & _has("keys", "OPI"), "6.2.5", "Form XObject must not have /OPI key"),
        _found(x, form & _has("keys", "PS"), "6.2.5", "Form XObject must not have /PS key"),
        _found(x, form & (a["Subtype2"] == "PS"), "6.2.5", "Form XObject must not have /Subtype2 = PS"),
        _found(x, state & _has("keys", "TR"), "6.2.8", "ExtGState must not have /TR (transfer function)"),
        _found(x, state & (a["TR2"] != "Default"), "6.2.8", "ExtGState /TR2 must be 'Default'"),
        _found(x, state & ~a["RI"].isin(*INTENTS), "6.2.8", F.concat(F.lit("ExtGState /RI contains invalid rendering intent: "), a["RI"])),
    ]


def fonts(r: Relations, f: Format) -> list[Found]:
    x = r("fonts")
    name, kind = F.coalesce("base_font", F.lit("?")), F.col("subtype")
    simple, cid = ~kind.isin("Type0", "Type3", "CIDFontType0", "CIDFontType2"), kind.isin("CIDFontType0", "CIDFontType2")
    subset = F.coalesce(F.col("base_font").rlike(r"^[A-Z]{6}\+."), F.lit(False))
    said = lambda text: F.concat(F.lit(text + ": "), name)
    out = [
        _found(x, simple & ~F.col("has_descriptor"), "6.3.4", said("Font is missing FontDescriptor (font not embedded)")),
        _found(x, simple & F.col("has_descriptor") & ~F.col("embedded"), "6.3.4", said("Font must be embedded (no FontFile/FontFile2/FontFile3 in FontDescriptor)")),
        _found(x, kind.isin("Type1", "MMType1") & subset & F.col("has_descriptor") & ~_has("descriptor_keys", "CharSet"), "6.3.5", said("Subset Type1 font must have /CharSet in FontDescriptor")),
        _found(x, (kind == "Type0") & ~_has("keys", "DescendantFonts"), "6.3.4", said("Type0 font has no DescendantFonts")),
        _found(x, cid & F.col("has_descriptor") & ~F.col("embedded"), "6.3.4", said("CIDFont must be embedded (no FontFile/FontFile2/FontFile3)")),
        _found(x, cid & subset & F.col("has_descriptor") & ~_has("descriptor_keys", "CIDSet"), "6.3.5", said("Subset CIDFont must have /CIDSet in FontDescriptor")),
        _found(x, cid & ~F.col("has_descriptor"), "6.3.4", said("CIDFont is missing FontDescriptor")),
        _found(x, (kind == "CIDFontType2") & ~_has("keys", "CIDToGIDMap"), "6.3.3.2", said("CIDFontType2 must have /CIDToGIDMap")),
        _found(x, (kind == "TrueType") & ~F.coalesce(F.col("encoding").isin("MacRomanEncoding", "WinAnsiEncoding"), F.lit(False)), "6.3.7", F.concat(F.lit("Non-symbolic TrueType font must use MacRomanEncoding or WinAnsiEncoding: "), name, F.lit(" (found: "), F.coalesce("encoding", F.lit("null")), F.lit(")"))),
    ]
    if f.level in ("A", "U"):
        exempt = (kind == "Type3") | F.coalesce(F.col("encoding").isin("MacRomanEncoding", "WinAnsiEncoding", "MacExpertEncoding"), F.lit(False)) | cid
        out.append(_found(x, ~exempt & ~_has("keys", "ToUnicode"), "6.3.8", said("Font must have /ToUnicode CMap for Level A/U compliance")))
    return out


def transparency(r: Relations, f: Format) -> list[Found]:
    if f.part != 1:
        return []
    x, a = r("resources"), F.col("attrs")
    state = F.col("category") == "ExtGState"
    out = [
        _found(x, state & (a["SMask"] != "None"), "6.4", "PDF/A-1: ExtGState /SMask must be 'None'"),
        _found(x, state & ~a["BM"].isin("Normal", "Compatible"), "6.4", F.concat(F.lit("PDF/A-1: ExtGState /BM must be 'Normal' or 'Compatible', found: "), a["BM"])),
        _found(x, (F.col("subtype") == "Form") & a["Group"].contains('"Transparency"'), "6.4", "PDF/A-1: Form XObject must not have transparency group (/Group /S /Transparency)"),
        _found(x, (F.col("subtype") == "Image") & _has("keys", "SMask"), "6.4", "PDF/A-1: Image XObject must not have /SMask"),
    ]
    for key in ("CA", "ca"):
        out.append(_found(x, state & (a[key].try_cast("double") != 1.0), "6.4", F.concat(F.lit(f"PDF/A-1: ExtGState /{key} must be 1.0, found: "), a[key])))
    return out


def annotations(r: Relations, f: Format) -> list[Found]:
    x, flags = r("annotations"), F.col("flags")
    part = "PDF/A-1" if f.part == 1 else "PDF/A-2+"
    bit = lambda i: flags.bitwiseAND(1 << i) != 0
    out = [_found(x, F.col("subtype").isin(*FORBIDDEN_ANNOTATIONS[min(f.part, 2)]), "6.5.2", F.concat(F.lit("Annotation subtype '"), F.col("subtype"), F.lit(f"' is not permitted in {part}")))]
    out.append(_found(x, ~bit(2) & (F.col("subtype") != "Popup"), "6.5.3", "Annotation /F flag must have Print bit set"))
    for i, name in ((1, "Hidden"), (0, "Invisible"), (5, "NoView")):
        out.append(_found(x, bit(i), "6.5.3", f"Annotation /F flag must not have {name} bit set"))
    return out


def actions(r: Relations, f: Format) -> list[Found]:
    x = r("actions")
    out = [
        _found(x, F.col("place") == "catalog/AA", "6.6.2", "Catalog must not contain /AA (additional actions)"),
        _found(x, F.col("place") == "page/AA", "6.6.2", "Page must not contain /AA (additional actions)"),
        _found(x, F.col("place") == "annotation/AA", "6.6.2", "Widget annotation must not contain /AA (additional actions)"),
        _found(x, F.col("kind").isin(*FORBIDDEN_ACTIONS), "6.6.1", F.concat(F.lit("Action type '"), F.col("kind"), F.lit("' is not permitted in PDF/A"))),
    ]
    if f.part >= 2:
        out.append(_found(x, F.col("kind").isin(*FORBIDDEN_LATER), "6.6.1", F.concat(F.lit("Action type '"), F.col("kind"), F.lit("' is not permitted in PDF/A-2+"))))
    return out


def metadata(r: Relations, f: Format) -> list[Found]:
    c, xml = r("catalogs"), F.col("metadata")
    value = lambda key: F.coalesce(F.nullif(F.regexp_extract(xml, rf"pdfaid:{key}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("")), F.nullif(F.regexp_extract(xml, rf"<pdfaid:{key}>\s*([^<]*?)\s*</pdfaid:{key}>", 1), F.lit("")))
    part, conf = value("part"), F.trim(value("conformance"))
    full = xml.isNotNull() & (F.length(xml) > 0)
    return [
        _found(c, F.size("keys") == 0, "6.7.2", "Cannot load catalog to check metadata"),
        _found(c, ~_has("keys", "Metadata"), "6.7.2", "Catalog must contain /Metadata stream for PDF/A compliance"),
        _found(c, _has("keys", "Metadata") & xml.isNull(), "6.7.2", "Catalog /Metadata must be a stream object"),
        _found(c, F.col("metadata_filter"), "6.7.2", "Metadata stream must not have /Filter (must be uncompressed)"),
        _found(c, F.length(xml) == 0, "6.7.11", "Metadata stream is empty"),
        _found(c, full & part.isNull(), "6.7.11", "XMP metadata must contain pdfaid:part element"),
        _found(c, full & (part.try_cast("int") != f.part), "6.7.11", F.concat(F.lit("XMP pdfaid:part is "), part, F.lit(f" but expected {f.part} for {f.name}"))),
        _found(c, full & part.isNotNull() & part.try_cast("int").isNull(), "6.7.11", F.concat(F.lit("Could not parse pdfaid:part value: "), part), "WARNING"),
        _found(c, full & conf.isNull(), "6.7.11", "XMP metadata must contain pdfaid:conformance element"),
        _found(c, full & (F.upper(conf) != f.level), "6.7.11", F.concat(F.lit("XMP pdfaid:conformance is '"), conf, F.lit(f"' but expected '{f.level}' for {f.name}"))),
    ]


def logical_structure(r: Relations, f: Format) -> list[Found]:
    if f.level != "A":
        return []
    c = r("catalogs")
    return [
        _found(c, F.size("keys") == 0, "6.8.2", "Cannot load catalog to check logical structure"),
        _found(c, ~_has("keys", "MarkInfo"), "6.8.2", "Catalog must have /MarkInfo dictionary for Level A compliance"),
        _found(c, _has("keys", "MarkInfo") & (F.coalesce("marked", F.lit("false")) != "true"), "6.8.2", "Catalog /MarkInfo/Marked must be true for Level A compliance"),
        _found(c, ~_has("keys", "StructTreeRoot"), "6.8.3", "Catalog must have /StructTreeRoot for Level A compliance"),
        _found(c, ~_has("keys", "Lang"), "6.8.4", "Catalog must have /Lang for Level A compliance"),
    ]


def forms(r: Relations, f: Format) -> list[Found]:
    c = r("catalogs")
    out = [
        _found(c, F.col("need_appearances") == "true", "6.9.1", "AcroForm /NeedAppearances must be false or absent for PDF/A compliance"),
        _found(r("fields"), _has("keys", "AA"), "6.9.2", "Form field/widget must not contain /AA (additional actions)"),
    ]
    if f.part >= 2:
        out.append(_found(c, F.col("has_xfa"), "6.9.4", "AcroForm must not contain /XFA for PDF/A-2+ compliance"))
        out.append(_found(c, F.col("needs_rendering") == "true", "6.9.4", "Catalog /NeedsRendering must not be true for PDF/A-2+ compliance"))
    return out


def pdf_x(r: Relations, f: Format) -> list[Found]:
    t, c, p, x = r("trailers"), r("catalogs"), r("pages"), r("fonts")
    info = r("info").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("info"))
    i = t.select("doc_id", "keys", "encrypted").join(info, "doc_id", "left")
    at = lambda key: F.try_element_at("info", F.lit(key))
    have = F.array_contains("keys", "Info")
    name = F.coalesce("base_font", F.lit("?"))
    out = [
        _found(t, F.size("keys") == 0, "PDFX-INFO", "No trailer dictionary found"),
        _found(i, ~have, "PDFX-INFO", "PDF/X requires /Info dictionary in trailer"),
        _found(i, have & at("GTS_PDFXVersion").isNull(), "PDFX-VERSION", "Info dict must have /GTS_PDFXVersion for PDF/X compliance"),
        _found(i, have & at("Trapped").isNull(), "PDFX-TRAPPED", "Info dict /Trapped must be present and set to True or False"),
        _found(i, ~at("Trapped").isin("True", "False"), "PDFX-TRAPPED", F.concat(F.lit("Info dict /Trapped must be True or False, not: "), at("Trapped"))),
        _found(c, F.col("output_intents").isNull(), "PDFX-OUTPUTINTENT", "Catalog must have /OutputIntents for PDF/X compliance"),
        _found(c, F.col("output_intents").isNotNull() & ~F.coalesce(_has("output_intents", "GTS_PDFX"), F.lit(False)), "PDFX-OUTPUTINTENT", "Catalog /OutputIntents must contain an entry with /S = GTS_PDFX"),
        _found(p, ~_has("keys", "TrimBox") & ~_has("keys", "ArtBox"), "PDFX-TRIMBOX", "Page must have /TrimBox or /ArtBox for PDF/X compliance"),
        _found(x, ~F.col("subtype").isin("Type0", "Type3") & ~F.col("has_descriptor"), "PDFX-FONT-EMBED", F.concat(F.lit("Font missing FontDescriptor (not embedded): "), name)),
        _found(x, F.col("has_descriptor") & ~F.col("embedded"), "PDFX-FONT-EMBED", F.concat(F.lit("Font must be embedded (no FontFile/FontFile2/FontFile3): "), name)),
    ]
    if f.is_x1a:
        out.append(_found(i, have & at("GTS_PDFXConformance").isNull(), "PDFX-CONFORMANCE", "Info dict must have /GTS_PDFXConformance for PDF/X-1a compliance"))
        out.append(_found(t, F.col("encrypted"), "PDFX-ENCRYPT", "PDF/X-1a must not have /Encrypt in trailer"))
    return out


RULES = [file_structure, graphics, fonts, transparency, annotations, actions, metadata, logical_structure, forms]


def validate(files: DataFrame, target: str = "PDF/A-1b", more: list[Callable[[Relations, Format], list[Found]]] = ()) -> DataFrame:
    """Violations of every file (doc_id, content) against a target; `more` are rules of the caller's own.

    A file is parsed once for all rules over relations as they are, each row
    giving the violations it has. Rules over rows derived from relations, and the
    caller's, run in a pass of their own for each set of rows.
    """
    f, have = Format(target), {}

    def relation(name: str) -> DataFrame:
        if name not in have:
            have[name] = scan(files, name)
        return have[name]

    together: dict[str, list[Found]] = {}
    apart: dict[int, list[Found]] = {}
    for rule in [pdf_x] if f.is_x else RULES:
        for found in rule(relation, f):
            name = next((n for n, rows in have.items() if rows is found.rows), None)
            (together.setdefault(name, []) if name else apart.setdefault(id(found.rows), [])).append(found)
    for rule in more:
        for found in rule(relation, f):  # their columns may be bound to the relation
            apart.setdefault(id(found.rows), []).append(found)
    out = [_violations(group) for group in apart.values()]
    return reduce(DataFrame.unionByName, ([_violations_together(files, together)] if together else []) + out)


def _each(group: list[Found]) -> Column:
    """What each rule says of a row, null where it is kept."""
    return F.array(*[F.when(g.test, F.struct(F.lit(g.rule).alias("rule_id"), F.lit(g.severity).alias("severity"), g.message.alias("message"))) for g in group])


def _exploded(df: DataFrame, each: Column) -> DataFrame:
    return df.select("doc_id", F.explode(F.filter(each, lambda v: v.isNotNull())).alias("v")).select("doc_id", "v.*")


def _violations(group: list[Found]) -> DataFrame:
    return _exploded(group[0].rows, _each(group))


def _violations_together(files: DataFrame, groups: dict[str, list[Found]]) -> DataFrame:
    """Groups by relation; their columns are taken by name from the row's own relation."""
    df = scan_all(files, list(groups)).withColumn("__each", F.lit(None).cast("array<struct<rule_id:string,severity:string,message:string>>"))
    held = [c for c in df.columns if c != "__each"]
    for name, group in groups.items():
        own = df.select(*held, "__each", f"__{name}.*")
        df = own.select(*held, F.when(F.col("__relation") == name, _each(group)).otherwise(F.col("__each")).alias("__each"))
    return _exploded(df, F.col("__each"))


def compliant(files: DataFrame, violations: DataFrame) -> DataFrame:
    """Whether a file has no violation of severity ERROR; warnings don't count."""
    bad = violations.where("severity = 'ERROR'").groupBy("doc_id").agg(F.count("*").alias("n_errors"))
    return files.select("doc_id").join(bad, "doc_id", "left").select("doc_id", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.col("n_errors").isNull().alias("compliant"))


# fixes: rows of relations rewritten

def fixed_annotations(x: DataFrame, part: int = 1) -> DataFrame:
    """Without forbidden types and actions; Print set, Hidden, Invisible and NoView cleared; no /AA."""
    keep = x.where(~F.col("subtype").isin(*FORBIDDEN_ANNOTATIONS[min(part, 2)]))
    flags = F.col("flags").bitwiseOR(4).bitwiseAND(~(1 | 2 | 32))
    return keep.withColumns({"flags": flags, "action": F.when(~F.col("action").isin(*FORBIDDEN_ACTIONS), F.col("action")), "keys": F.array_remove("keys", "AA")})


def fixed_resources(x: DataFrame) -> DataFrame:
    """ExtGState: no soft mask, Normal blending, full alpha; images: no /Alternates, /OPI, /Interpolate; forms: no transparency group."""
    a, state = F.col("attrs"), F.col("category") == "ExtGState"
    put = F.map_from_arrays(F.array(*map(F.lit, ["SMask", "BM", "CA", "ca"])), F.array(*map(F.lit, ["None", "Normal", "1", "1"])))
    own = F.map_filter(put, lambda k, v: F.array_contains(F.map_keys(a), k))
    drop = ["Alternates", "OPI", "Interpolate", "Group", "PS"]
    rest = F.map_filter(a, lambda k, v: ~k.isin(*["SMask", "BM", "CA", "ca"]))
    new = F.when(state, F.map_concat(rest, own)).otherwise(F.map_filter(a, lambda k, v: ~k.isin(*drop)))
    return x.withColumn("attrs", new).withColumn("keys", F.array_sort(F.map_keys("attrs")))


def fixed_catalogs(x: DataFrame) -> DataFrame:
    """Without /AA, /OCProperties, /XFA and embedded files; /NeedAppearances false; an sRGB output intent."""
    keys = F.filter("keys", lambda k: ~k.isin("AA", "OCProperties"))
    return x.withColumns({"keys": F.array_union(keys, F.array(F.lit("OutputIntents"))), "need_appearances": F.when(F.col("need_appearances").isNotNull(), "false"), "has_xfa": F.lit(False), "embedded_files": F.lit(False), "output_intents": F.coalesce("output_intents", F.array(F.lit("GTS_PDFA1")))})


def fixed_trailers(x: DataFrame) -> DataFrame:
    """With /ID, without /Encrypt."""
    keys = F.array_sort(F.array_union(F.array_remove("keys", "Encrypt"), F.array(F.lit("ID"))))
    return x.withColumns({"keys": keys, "has_id": F.lit(True), "encrypted": F.lit(False)})


def without_additional_actions(x: DataFrame) -> DataFrame:
    """Pages or fields without /AA."""
    return x.withColumn("keys", F.array_remove("keys", "AA"))


def with_trim_boxes(pages: DataFrame) -> DataFrame:
    """Pages without a /TrimBox get one, in trim_llx to trim_ury, which is their media box; null where a page has its own."""
    lacks = ~F.array_contains("keys", "TrimBox")
    boxes = {f"trim_{c}": F.when(lacks, F.col(c)) for c in ("llx", "lly", "urx", "ury")}
    return pages.withColumns(boxes).withColumn("keys", F.array_sort(F.array_union("keys", F.array(F.lit("TrimBox")))))


def fixed_pdf_x_info(info: DataFrame, files: DataFrame, version: str, conformance: str | None = None) -> DataFrame:
    """Entries of /Info with the version, the conformance if given, and /Trapped False where it is missing or neither True nor False."""
    trapped = info.where("key = 'Trapped' and value in ('True', 'False')").select("doc_id", "key", "value")
    ids = files.select("doc_id")
    said = {"GTS_PDFXVersion": version, "GTS_PDFXConformance": conformance}
    new = [ids.select("doc_id", F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in said.items() if v is not None]
    new.append(ids.join(trapped, "doc_id", "left").select("doc_id", F.lit("Trapped").alias("key"), F.coalesce("value", F.lit("False")).alias("value")))
    kept = info.where(~F.col("key").isin("Trapped", *(k for k, v in said.items() if v is not None))).select("doc_id", "key", "value")
    return reduce(DataFrame.unionByName, [kept, *new])
