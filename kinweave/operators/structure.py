"""Structure of family-tree files: rules over ``nodes``, dates in house style."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.dates import MONTHS
from kinweave.operators.people import dated
from kinweave.operators.profile import mode_first

#: Standard tags of both versions of the format.
KNOWN = (
    "HEAD TRLR INDI FAM SOUR REPO OBJE NOTE SNOTE SUBM SUBN GEDC VERS FORM CHAR LANG DEST FILE COPR SCHMA TAG CORP NAME NPFX GIVN NICK SPFX SURN NSFX FONE ROMN TYPE TRAN "
    "SEX FAMC FAMS HUSB WIFE CHIL PEDI STAT NCHI NMR ADOP ANCI DESI ANCE DESC BIRT CHR DEAT BURI CREM BAPM BARM BASM BLES CHRA CONF FCOM ORDN NATU EMIG IMMI CENS PROB WILL GRAD "
    "RETI EVEN BAPL CONL ENDL SLGC INIL CAST DSCR EDUC IDNO NATI OCCU PROP RELI RESI SSN TITL FACT MARR MARB MARC MARL MARS ANUL DIV DIVF ENGA SLGS DATE TIME PLAC ADDR ADR1 ADR2 ADR3 "
    "CITY STAE POST CTRY PHON EMAIL FAX WWW AGNC CAUS AGE ASSO RELA RESN MAP LATI LONG EXID PHRASE SDATE NO PAGE DATA TEXT QUAY ROLE AUTH PUBL ABBR EDTN REFN RIN MEDI CALN FILN PERI "
    "BLOB CROP TOP LEFT HEIGHT WIDTH CHAN CREA UID RFN AFN"
).split()
CATEGORIES = ("encoding", "syntax", "level", "strayCont", "danglingXref", "duplicateXref", "version", "unknownTag", "badDate", "customTag")
SEVERITY = {"encoding": "warning", "version": "warning", "unknownTag": "warning", "badDate": "warning", "customTag": "info"}


def dangling_pointers(nodes: DataFrame) -> DataFrame:
    """(file_id, xref, n, tag, family_links): pointers outside vendor subtrees to records that are not there; family_links:
    all of them are family links right below a person or family, which the check of people reports."""
    defined = nodes.filter("parent_id is null and xref is not null").select("file_id", F.col("xref").alias("target")).distinct()
    record = nodes.filter("parent_id is null").select("file_id", "rec_ord", F.col("tag").alias("rec_tag"))
    lines = nodes.filter(~F.col("vendor") & F.trim("value").rlike("^@[^@#][^@]*@$")).withColumn("target", F.trim("value"))
    lost = lines.join(defined, ["file_id", "target"], "left_anti").join(record, ["file_id", "rec_ord"])
    link = (F.col("depth") == 1) & (((F.col("rec_tag") == "INDI") & F.col("tag").isin("FAMC", "FAMS")) | ((F.col("rec_tag") == "FAM") & F.col("tag").isin("HUSB", "WIFE", "CHIL")))
    return lost.groupBy("file_id", F.col("target").alias("xref")).agg(F.count("*").alias("n"), F.min_by("tag", "node_id").alias("tag"), F.min(link).alias("family_links"))


def structure_issues(nodes: DataFrame, warnings: DataFrame | None = None, year_now: int = 2024) -> DataFrame:
    """(file_id, category, severity, sample, n, record): findings of the ten rules, ordered by severity and category.

    What lies below a vendor tag is the vendor's own and is only counted by its outermost tag; tags that a file's own
    source templates declare are counted with them. ``warnings``: see ``read_warnings``.
    """
    record = nodes.filter("parent_id is null").select("file_id", "rec_ord", F.col("xref").alias("record"))
    roots = nodes.filter("parent_id is null and xref is not null")

    def issue(rows: DataFrame, category: str, sample: Column, record: Column | None = None, n: Column | None = None) -> DataFrame:
        return rows.select(
            "file_id", F.lit(category).alias("category"), F.lit(SEVERITY.get(category, "error")).alias("severity"), sample.cast("string").alias("sample"),
            (F.lit(1) if n is None else n).cast("long").alias("n"), (F.lit(None) if record is None else record).cast("string").alias("record"),
        )

    template = nodes.filter("parent_id is null and tag = '_STF'").select("file_id", F.col("node_id").alias("parent_id"))
    declared = nodes.filter("tag = '_TAG'").join(template, ["file_id", "parent_id"]).select("file_id", F.trim("value").alias("tag")).filter(F.col("tag").rlike("^[A-Z][A-Z0-9_]{2,14}$") & ~F.col("tag").isin(*KNOWN)).distinct()
    above = nodes.select("file_id", F.col("node_id").alias("parent_id"), F.col("vendor").alias("above"))
    outermost = nodes.filter("vendor").join(above, ["file_id", "parent_id"], "left").filter("not coalesce(above, false)")
    bare = nodes.filter(~F.col("vendor") & ~F.col("tag").isin(*KNOWN, ""))

    def tallied(rows: DataFrame, category: str) -> DataFrame:
        seen = rows.join(record, ["file_id", "rec_ord"]).groupBy("file_id", "tag").agg(F.count("*").alias("k"), F.min_by("record", "node_id").alias("record"))
        return issue(seen, category, F.col("tag"), F.col("record"), F.col("k"))

    dates = dated(nodes.filter(~F.col("vendor") & (F.col("tag") == "DATE") & (F.trim("value") != "")), year_now, "value")
    # fields that are only placeholders are meant to be unknown
    garbage = (F.col("d.qualifier") == "unknown") & ~F.trim("value").rlike(r"^[\s._?<>/-]+$")
    lost = dangling_pointers(nodes).filter("not family_links")
    twice = roots.groupBy("file_id", "xref").agg(F.count("*").alias("k")).filter("k > 1")
    out = [
        issue(lost, "danglingXref", F.col("xref"), None, F.col("n")),
        issue(twice, "duplicateXref", F.col("xref"), F.col("xref"), F.col("k") - 1),
        tallied(bare.join(declared, ["file_id", "tag"], "left_anti"), "unknownTag"),
        tallied(outermost.select("file_id", "rec_ord", "node_id", "tag").unionByName(bare.join(declared, ["file_id", "tag"], "left_semi").select("file_id", "rec_ord", "node_id", "tag")), "customTag"),
        issue(dates.filter(garbage).join(record, ["file_id", "rec_ord"]), "badDate", F.substring(F.trim("value"), 1, 60), F.col("record")),
    ]
    if warnings is not None:
        for kind in ("encoding", "syntax", "level", "strayCont", "version"):
            out.append(issue(warnings.filter(F.col("kind") == kind), kind, F.concat(F.lit("line "), F.col("line").cast("string"))))
    every = reduce(DataFrame.unionByName, out)
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return every.orderBy(F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2), order, "file_id", "sample")


def date_style(nodes: DataFrame) -> DataFrame:
    """(file_id, style, n): the most used date layout of each file."""
    v = F.upper(F.trim("value"))
    style = (
        F.when(v.rlike(r"^\d{4}-\d\d-\d\d$"), "iso").when(v.rlike(r"^\d{1,2}\.\s?\d{1,2}\.\s?\d{4}$"), "dotted").when(v.rlike(r"^\d{1,2} [A-Z]{3} \d{4}$"), "standard")
    )
    d = nodes.filter("tag = 'DATE'").withColumn("style", style).withColumn("o", F.col("node_id"))
    return mode_first(d, ["file_id"], "style", "o")


def format_date(year: Column, month: Column, day: Column, qualifier: Column, style: str = "standard") -> Column:
    """A partial date in house style; qualifiers are written before it."""
    lead = F.when(qualifier == "about", "ABT ").when(qualifier == "before", "BEF ").when(qualifier == "after", "AFT ").otherwise("")
    names = F.array(*map(F.lit, MONTHS))
    if style == "iso":
        body = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    elif style == "dotted":
        body = F.concat_ws(".", day.cast("string"), month.cast("string"), year.cast("string"))
    else:
        body = F.concat_ws(" ", day.cast("string"), F.get(names, month - 1), year.cast("string"))
    return F.when(year.isNotNull(), F.concat(lead, body))


def dangling_removed(nodes: DataFrame) -> DataFrame:
    """``nodes`` without pointer lines that lead nowhere."""
    xrefs = nodes.filter("parent_id is null and xref is not null").select("file_id", F.col("xref").alias("__x"), F.lit(True).alias("__ok")).distinct()
    out = nodes.join(xrefs, (nodes.file_id == xrefs.file_id) & (nodes.value == F.col("__x")), "left").drop(xrefs.file_id)
    return out.filter(~F.coalesce(F.col("value").rlike("^@[^@#]+@$") & F.col("__ok").isNull(), F.lit(False))).select(*nodes.columns)
