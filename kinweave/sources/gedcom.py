"""Tagged-line family-tree files (GEDCOM 5.5.1 and 7): read, typed projection, write.

A file is one task, as its lines depend on those before; files are the unit of parallel reading.
The tree is an edge list (``nodes``), one row per line with continuation lines folded in, since
Spark types cannot recurse; unknown tags and unparsable lines are kept, so a file can be written back.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

NODES = (
    "file_id string, rec_ord int, node_id long, parent_id long, depth int, child_ord int, xref string, tag string, value string, verbatim string, conc_at array<int>, vendor boolean"
)
FILES = "file_id string, charset string, eol string, final_newline boolean"
WARNINGS = "file_id string, kind string, line int, message string"
_LINE = re.compile(r"^(\d+)\s+(?:(@[^@]+@)\s+)?([A-Za-z0-9_.]+)(?:\s(.*))?$", re.S)
_POINTER = re.compile(r"^@[^@]+@$")
#: Bytes that stand for letters in Windows-1250 and for none or rare signs in 1252.
CENTRAL = frozenset(b"\x8a\x9a\x8e\x9e\x81\x8d\x8f\x90\x9d")
#: The ANSEL character set, letters and signs from A1 on, marks (which stand before their letter) from E0 on.
ANSEL_SIGNS = {
    0xA1: "Ł", 0xA2: "Ø", 0xA3: "Đ", 0xA4: "Þ", 0xA5: "Æ", 0xA6: "Œ", 0xA7: "ʹ", 0xA8: "·", 0xA9: "♭", 0xAA: "®", 0xAB: "±", 0xAC: "Ơ", 0xAD: "Ư", 0xAE: "ʼ", 0xB0: "ʻ",
    0xB1: "ł", 0xB2: "ø", 0xB3: "đ", 0xB4: "þ", 0xB5: "æ", 0xB6: "œ", 0xB7: "ʺ", 0xB8: "ı", 0xB9: "£", 0xBA: "ð", 0xBC: "ơ", 0xBD: "ư", 0xC0: "°", 0xC1: "ℓ", 0xC2: "℗", 0xC3: "©",
    0xC4: "♯", 0xC5: "¿", 0xC6: "¡", 0xC7: "ß", 0xC8: "€", 0xCF: "ß",
}
ANSEL_MARKS = {
    0xE0: "\u0309", 0xE1: "\u0300", 0xE2: "\u0301", 0xE3: "\u0302", 0xE4: "\u0303", 0xE5: "\u0304", 0xE6: "\u0306", 0xE7: "\u0307", 0xE8: "\u0308", 0xE9: "\u030c", 0xEA: "\u030a", 0xEB: "\ufe20", 0xEC: "\ufe21",
    0xED: "\u0315", 0xEE: "\u030b", 0xEF: "\u0310", 0xF0: "\u0327", 0xF1: "\u0328", 0xF2: "\u0323", 0xF3: "\u0324", 0xF4: "\u0325", 0xF5: "\u0333", 0xF6: "\u0332", 0xF7: "\u0326", 0xF8: "\u031c",
    0xF9: "\u032e", 0xFA: "\ufe22", 0xFB: "\ufe23", 0xFE: "\u0313",
}
_SPLIT = re.compile(rb"([\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf4][\x80-\xbf]{0,2})((?:\r\n|\r|\n)\d+ CONC )([\x80-\xbf]{1,3})")


def decode_ansel(data: bytes) -> str:
    """ANSEL text, marks behind their letters and composed with them."""
    out, marks = [], []
    for b in data:
        if b in ANSEL_MARKS:
            marks.append(ANSEL_MARKS[b])
            continue
        out.append(chr(b) if b < 0x80 else ANSEL_SIGNS.get(b, "\ufffd"))
        if marks:
            out += marks[::-1]
            marks = []
    return unicodedata.normalize("NFC", "".join(out + marks))


def repair_mojibake(text: str) -> str:
    """Lines whose UTF-8 was once read as Windows-1252, read again; others stay."""

    def again(line: str) -> str:
        if not re.search("[ÂÃÄÅ][\u0080-\u00bf\u0152-\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2122\u20ac]", line):
            return line
        try:
            return line.encode("cp1252").decode("utf-8")
        except UnicodeError:
            return line

    return "".join(again(x) for x in text.splitlines(keepends=True))


def decode_bytes(data: bytes) -> tuple[str, str]:
    """Text and charset: byte order mark, then valid UTF-8 whatever the label, then the declared charset, then what
    the bytes allow. A UTF-8 letter that a long line's break tore apart is put together first."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name
    if data[:2] in (b"0\x00", b"\x000"):
        name = "utf-16-le" if data[:1] == b"0" else "utf-16-be"
        return data.decode(name, "replace"), name
    declared = re.search(rb"(?m)^\s*1\s+CHAR\s+(\S+)", data[:20_000].replace(b"\r", b"\n"))
    name = declared[1].decode("ascii", "replace").upper() if declared else ""
    healed = data
    while (more := _SPLIT.sub(rb"\1\3\2", healed)) != healed:
        healed = more
    try:
        return repair_mojibake(healed.decode("utf-8")), "utf-8"
    except UnicodeDecodeError:
        pass
    if name == "ANSEL":
        return decode_ansel(data), "ansel"
    if name in {"UTF-8", "UTF8"} and healed.decode("utf-8", "replace").count("\ufffd") * 200 < len(data):
        return healed.decode("utf-8", "replace"), "utf-8"
    charset = "windows-1250" if any(b in CENTRAL for b in data) else "windows-1252"
    return data.decode(charset, "replace"), charset


def line_style(text: str) -> tuple[str, bool]:
    """The file's line ending and whether it ends with one."""
    eol = "\r\n" if "\r\n" in text else "\r" if "\r" in text and "\n" not in text else "\n"
    return eol, text.endswith(("\r", "\n"))


def parse_lines(text: str) -> tuple[list[dict], list[dict]]:
    """Nodes in file order and warnings (kind syntax, level or strayCont) of one file.

    A line that fits the tree nowhere is more of the free text of a TEXT or NOTE line above it, if there is one;
    else it is kept as it stands below the deepest open line. A level that skips its parent is clamped to it.
    """
    nodes: list[dict] = []
    warnings: list[dict] = []
    stack: list[dict] = []
    children: dict[int, int] = {}
    blob: dict | None = None
    rec = -1

    def add(parent: dict | None, **what) -> dict:
        nonlocal rec
        if parent is None:
            rec += 1
        key = -1 if parent is None else parent["node_id"]
        children[key] = children.get(key, -1) + 1
        node = {"rec_ord": rec, "node_id": len(nodes), "parent_id": None if parent is None else key, "depth": 0 if parent is None else parent["depth"] + 1, "child_ord": children[key], "xref": None, "value": None, "verbatim": None, "conc_at": []} | what
        node["vendor"] = node["tag"].startswith("_") or (parent is not None and parent["vendor"])
        nodes.append(node)
        return node

    def warn(kind: str, number: int, message: str) -> None:
        warnings.append({"kind": kind, "line": number, "message": message[:80]})

    for number, line in enumerate(re.split(r"\r\n?|\n", text), 1):
        if not line.strip():
            continue
        m = _LINE.match(line)
        if not m:
            if blob is not None:
                blob["value"] = (blob["value"] or "") + "\n" + line
                continue
            warn("syntax", number, line)
            add(stack[-1] if stack else None, tag="", verbatim=line)
            continue
        level, tag, value = int(m[1]), m[3].upper(), m[4]
        if value is not None and value.startswith("@@"):
            value = value[1:]
        if tag in {"CONT", "CONC"}:
            if not 0 < level <= len(stack):
                warn("strayCont", number, f"{tag} with no parent")
                continue
            owner = stack[level - 1]
            before = owner["value"] or ""
            if tag == "CONC":
                owner["conc_at"].append(len(before))
            owner["value"] = before + ("\n" if tag == "CONT" else "") + (value or "")
            blob = owner
            continue
        if level > len(stack):
            if blob is not None:
                blob["value"] = (blob["value"] or "") + "\n" + line
                continue
            warn("level", number, f"{level} below {len(stack) - 1}")
        parent = stack[min(level, len(stack)) - 1] if level and stack else None
        node = add(parent, tag=tag, xref=m[2], value=value)
        del stack[min(level, len(stack)) :]
        stack.append(node)
        blob = node if tag in {"TEXT", "NOTE"} else None
    return nodes, warnings


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The ``nodes`` of all files below a path (any path Spark can read)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                nodes, _ = parse_lines(decode_bytes(bytes(content))[0])
                if nodes:
                    frame = pd.DataFrame(nodes)
                    frame.insert(0, "file_id", name.rsplit("/", 1)[-1])
                    frame["parent_id"] = frame["parent_id"].astype("Int64")
                    yield frame

    return _files(spark, path).mapInPandas(run, NODES)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, charset, eol, final_newline) of all files."""

    def run(batches):
        for batch in batches:
            rows = [(name.rsplit("/", 1)[-1], *(lambda text, charset: (charset, *line_style(text)))(*decode_bytes(bytes(content)))) for name, content in zip(batch.path, batch.content, strict=True)]
            yield pd.DataFrame(rows, columns=["file_id", "charset", "eol", "final_newline"])

    return _files(spark, path).mapInPandas(run, FILES)


def read_warnings(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, kind, line, message): what reading the files met with, wrong bytes (encoding) included."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                text, charset = decode_bytes(bytes(content))
                _, warnings = parse_lines(text)
                if "\ufffd" in text:
                    warnings.append({"kind": "encoding", "line": text[: text.index("\ufffd")].count("\n") + 1, "message": f"bytes that {charset} has not"})
                if warnings:
                    yield pd.DataFrame([{"file_id": name.rsplit("/", 1)[-1], **w} for w in warnings])

    return _files(spark, path).mapInPandas(run, WARNINGS)


def versions(nodes: DataFrame) -> DataFrame:
    """(file_id, version) from HEAD/GEDC/VERS."""
    n = nodes.select("file_id", "node_id", "parent_id", "tag", "value")
    gedc = n.filter("tag = 'GEDC'").select("file_id", F.col("node_id").alias("parent_id"))
    return n.filter("tag = 'VERS'").join(gedc, ["file_id", "parent_id"]).select("file_id", F.col("value").alias("version"))


def _records(nodes: DataFrame, tag: str) -> DataFrame:
    """Record roots of a tag; of records that share an id the last wins."""
    last = Window.partitionBy("file_id", "xref").orderBy(F.desc("rec_ord"))
    roots = nodes.filter(f"parent_id is null and tag = '{tag}' and xref is not null")
    return roots.withColumn("k", F.row_number().over(last)).filter("k = 1").select("file_id", F.col("xref").alias("id"), F.col("rec_ord").alias("ord"), F.col("node_id").alias("root"))


def individuals(nodes: DataFrame) -> DataFrame:
    """(file_id, id, ord, name, given, surname, sex, child_of, spouse_of, uids, fsids)."""
    kids = nodes.select("file_id", F.col("parent_id").alias("root"), "tag", "value", "child_ord")
    joined = _records(nodes, "INDI").join(kids, ["file_id", "root"], "left")

    def listed(*tags: str):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("tag").isin(*tags) & F.col("value").isNotNull(), F.struct("child_ord", F.trim("value").alias("value"))))), lambda x: x["value"])

    first = F.min_by(F.when(F.col("tag") == "NAME", F.col("value")), F.when(F.col("tag") == "NAME", F.col("child_ord")))
    out = joined.groupBy("file_id", "id", "ord").agg(
        first.alias("raw"), F.max(F.when(F.col("tag") == "SEX", F.upper(F.trim("value")))).alias("sex"), listed("FAMC").alias("child_of"), listed("FAMS").alias("spouse_of"),
        listed("UID", "_UID").alias("uids"), listed("_FID", "_FSFTID").alias("fsids"),
    )
    return out.select(
        "file_id", "id", "ord",
        F.trim(F.regexp_replace(F.regexp_replace("raw", "/", " "), r"\s+", " ")).alias("name"),
        F.nullif(F.trim(F.regexp_extract("raw", r"^([^/]*)", 1)), F.lit("")).alias("given"),
        F.nullif(F.trim(F.regexp_extract("raw", r"/([^/]*)/", 1)), F.lit("")).alias("surname"),
        "sex", "child_of", "spouse_of", "uids", "fsids",
    )


def family_edges(nodes: DataFrame) -> DataFrame:
    """(file_id, fam_id, person_id, role, ord): husband, wife and children of each family."""
    kids = nodes.filter("tag in ('HUSB', 'WIFE', 'CHIL')").select("file_id", F.col("parent_id").alias("root"), "tag", "value", "child_ord")
    role = F.create_map(F.lit("HUSB"), F.lit("husband"), F.lit("WIFE"), F.lit("wife"), F.lit("CHIL"), F.lit("child"))
    return _records(nodes, "FAM").join(kids, ["file_id", "root"]).select("file_id", F.col("id").alias("fam_id"), F.trim("value").alias("person_id"), role[F.col("tag")].alias("role"), F.col("child_ord").alias("ord"))


def families(nodes: DataFrame) -> DataFrame:
    """(file_id, fam_id) of all family records, those without members too."""
    return _records(nodes, "FAM").select("file_id", F.col("id").alias("fam_id"))


def family_links(nodes: DataFrame) -> DataFrame:
    """(file_id, person_id, fam_id, tag, ord, pedi): FAMC and FAMS lines of people, with the kind of the link."""
    lines = nodes.filter("tag in ('FAMC', 'FAMS') and value is not null").select("file_id", F.col("parent_id").alias("root"), "node_id", F.trim("value").alias("fam_id"), "tag", F.col("child_ord").alias("ord"))
    kind = nodes.filter("tag in ('PEDI', '_MREL')").groupBy("file_id", F.col("parent_id").alias("node_id")).agg(F.min_by("value", "child_ord").alias("pedi"))
    people = _records(nodes, "INDI").select("file_id", "root", F.col("id").alias("person_id"))
    return people.join(lines, ["file_id", "root"]).join(kind, ["file_id", "node_id"], "left").select("file_id", "person_id", "fam_id", "tag", "ord", "pedi")


def adoptions(nodes: DataFrame) -> DataFrame:
    """(file_id, person_id, fam_id): families that a person's adoption event names."""
    people = _records(nodes, "INDI").select("file_id", F.col("root").alias("parent_id"), F.col("id").alias("person_id"))
    event = nodes.filter("tag = 'ADOP'").join(people, ["file_id", "parent_id"]).select("file_id", "person_id", F.col("node_id").alias("parent_id"))
    return nodes.filter("tag = 'FAMC' and value is not null").join(event, ["file_id", "parent_id"]).select("file_id", "person_id", F.trim("value").alias("fam_id"))


#: Lines of a person or family that are no event or attribute.
NO_EVENTS = (
    "NAME", "SEX", "FAMC", "FAMS", "HUSB", "WIFE", "CHIL", "NOTE", "SOUR", "OBJE", "REFN", "RIN", "UID", "EXID", "CHAN", "CREA", "RESN", "ASSO", "ALIA", "SUBM", "ANCI", "DESI", "RFN", "AFN",
)


def events(nodes: DataFrame) -> DataFrame:
    """(file_id, owner, tag, ord, date, place, address, value) of person and family events and attributes."""
    roots = _records(nodes, "INDI").select("file_id", "root", F.col("id").alias("owner")).unionByName(_records(nodes, "FAM").select("file_id", "root", F.col("id").alias("owner")))
    found = nodes.filter(~F.col("tag").isin(*NO_EVENTS, "") & ~F.col("vendor"))
    found = found.select("file_id", F.col("parent_id").alias("root"), "node_id", "tag", F.col("child_ord").alias("ord"), "value").join(roots, ["file_id", "root"])
    parts = nodes.filter("tag in ('DATE', 'PLAC', 'ADDR')").groupBy("file_id", F.col("parent_id").alias("node_id")).agg(
        *[F.min_by(F.when(F.col("tag") == t, F.col("value")), F.when(F.col("tag") == t, F.col("child_ord"))).alias(n) for t, n in (("DATE", "date"), ("PLAC", "place"), ("ADDR", "address"))]
    )
    return found.join(parts, ["file_id", "node_id"], "left").select("file_id", "owner", "tag", "ord", "date", "place", "address", "value")


def pointer_index(nodes: DataFrame, tag: str) -> DataFrame:
    """(file_id, xref, record, owner, n): which records point at the records of a tag (SOUR, NOTE, OBJE, REPO), and how often."""
    targets = nodes.filter(F.col("parent_id").isNull() & (F.col("tag") == tag) & F.col("xref").isNotNull()).select("file_id", "xref").distinct()
    owners = nodes.filter("parent_id is null").select("file_id", "rec_ord", F.col("xref").alias("owner"), F.col("tag").alias("record"))
    lines = nodes.filter(F.col("value").rlike("^@[^@#]+@$")).select("file_id", "rec_ord", F.trim("value").alias("xref"))
    return lines.join(targets, ["file_id", "xref"]).join(owners, ["file_id", "rec_ord"]).groupBy("file_id", "xref", "record", "owner").agg(F.count("*").alias("n"))


def pointer_counts(nodes: DataFrame) -> DataFrame:
    """(file_id, xref, n): how often each record is pointed at."""
    return nodes.filter(F.col("value").rlike("^\\s*@[^@#]+@\\s*$")).groupBy("file_id", F.trim("value").alias("xref")).agg(F.count("*").alias("n"))


def people_of(nodes: DataFrame, file_id: str):
    """The ``People`` of one file, for the matcher and the checks, and its links and adoptions."""
    from kinweave.operators.people import People

    one = nodes.filter(F.col("file_id") == file_id)
    bundle = People(individuals(one).drop("file_id"), family_edges(one).drop("file_id"), events(one).drop("file_id", "value"), families=families(one).drop("file_id"))
    return bundle, family_links(one).drop("file_id"), adoptions(one).drop("file_id")


def graph_edges(edges: DataFrame) -> DataFrame:
    """(file_id, src, dst, edge): parent, child and spouse steps from the family edges."""
    parents = edges.filter("role != 'child'").select("file_id", "fam_id", F.col("person_id").alias("p"))
    kids = edges.filter("role = 'child'").select("file_id", "fam_id", F.col("person_id").alias("c"))
    up = kids.join(parents, ["file_id", "fam_id"])
    other = parents.withColumnRenamed("p", "q")
    spouse = parents.join(other, ["file_id", "fam_id"]).filter("p != q")
    return (
        up.select("file_id", F.col("c").alias("src"), F.col("p").alias("dst"), F.lit("parent").alias("edge"))
        .union(up.select("file_id", "p", "c", F.lit("child")))
        .union(spouse.select("file_id", "p", "q", F.lit("spouse")))
        .distinct()
    )


def _segments(text: str, breaks: list[int], room: int, first: int) -> list[str]:
    """A physical line's text in pieces: where the file broke it if these fit, else at ``room`` bytes, letters whole."""
    cuts = [0, *breaks, len(text)]
    pieces = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    if not room or all(len(p.encode()) <= (first if not k else room) for k, p in enumerate(pieces)):
        return pieces
    out, left = [], text
    while len(left.encode()) > (limit := first if not out else room):
        n = len(left.encode()[:limit].decode("utf-8", "ignore"))
        # a piece that ends in a blank would lose it, so the break moves into a word
        while n > 1 and (left[n - 1] == " " or left[n : n + 1] == " "):
            n -= 1
        out.append(left[:n])
        left = left[n:]
    return [*out, left]


def format_lines(frame: pd.DataFrame, newline: str = "\n", limit: int = 253, final: bool = True) -> str:
    """The text of one file's nodes: values break where they did while the pieces fit, else at ``limit`` bytes (0: never).

    A leading ``@`` of a text is doubled; pointers and calendar escapes stay.
    """
    out = []
    for r in frame.sort_values(["rec_ord", "node_id"]).itertuples():
        if isinstance(r.verbatim, str):
            out.append(r.verbatim)
            continue
        head = f"{r.depth} {r.xref + ' ' if isinstance(r.xref, str) else ''}{r.tag}"
        if not isinstance(r.value, str):
            out.append(head)
            continue
        at, breaks = 0, list(r.conc_at) if r.conc_at is not None else []
        for k, line in enumerate(r.value.split("\n")):
            here = [c - at for c in breaks if at < c <= at + len(line)]
            at += len(line) + 1
            if line.startswith("@") and not line.startswith("@#") and not _POINTER.match(line):
                line, here = "@" + line, [c + 1 for c in here]
            lead, more = (f"{r.depth + 1} CONT" if k else head), f"{r.depth + 1} CONC"
            for j, piece in enumerate(_segments(line, here, limit and limit - len(more) - 1, limit and limit - len(lead.encode()) - 1)):
                start = more if j else lead
                out.append(f"{start} {piece}" if piece else start)
    return newline.join(out) + (newline if final else "")


def write_files(nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file_id, text): each file written back, one task per file, with the line endings of ``files`` (see ``read_files``)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        one = frame.iloc[0]
        version = frame[(frame.tag == "VERS") & (frame.rec_ord == 0)].value
        limit = 0 if len(version) and str(version.iloc[0]).startswith("7") else 253
        return pd.DataFrame({"file_id": [one.file_id], "text": [format_lines(frame, one.eol, limit, bool(one.final_newline))]})

    if files is None:
        styled = nodes.withColumns({"eol": F.lit("\n"), "final_newline": F.lit(True)})
    else:
        styled = nodes.join(files.select("file_id", "eol", "final_newline"), "file_id")
    return styled.groupBy("file_id").applyInPandas(run, "file_id string, text string")
