"""Line dedup: explode normalised lines, hash them, count documents per hash, drop, reassemble.

Built-in expressions only. A line's key is the line without white space at either end, A-Z
lower-cased; keys of at least ``min_chars`` code points that stand in ``min_docs`` documents lose
their lines everywhere but in the smallest id that holds them.

Scale: keys travel as 128 bits of hash, and the count is a map-side combined minimum, maximum and
distinct-document test, so a line that a third of all documents share is one row per task. The
lines of a hot key meet the (unique) counts in a plain join, which adaptive execution can split.
Only positions of dropped lines return to the documents; texts are shuffled at most once.

Defined edge cases: a null or empty text is one empty line; rows with a null id keep their lines
and do not count as documents; rows that repeat an id are one document, each row cleaned by
itself; extra columns are left alone, and inner names start with ``__l``; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.line_cleaning import SPACES, _literal
from kinweave.session import materialize, table

MIN_CHARS = 10
#: Only A-Z are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text_col: str) -> str:
    return f"split(coalesce(`{text_col}`, ''), '\\n')"


def _dropped(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(__l_id, __l_row, __l_drop): 0-based positions of the lines that go, by document text."""
    key = f"translate(btrim(col, {_literal(SPACES)}), '{UPPER}', '{LOWER}')"
    lines = (
        docs.filter(F.col(id_col).isNotNull())
        .select(
            F.col(id_col).alias("__l_id"),
            F.expr(f"xxhash64(`{text_col}`)").alias("__l_row"),
            F.expr(f"posexplode({_lines(text_col)})"),
        )
        .select("__l_id", "__l_row", F.col("pos").alias("__l_pos"), F.expr(key).alias("__l_key"))
        .filter(F.length("__l_key") >= min_chars)
        .select("__l_id", "__l_row", "__l_pos", F.expr("xxhash64(__l_key)").alias("__l_h"), F.expr("xxhash64(1, __l_key, 2)").alias("__l_g"))
    )
    shared = materialize(
        lines.groupBy("__l_h", "__l_g")
        .agg(F.min("__l_id").alias("__l_first"), F.max("__l_id").alias("__l_last"))
        .filter("__l_first < __l_last")
        .drop("__l_last")
    )
    return (
        lines.join(shared, ["__l_h", "__l_g"])
        .filter("__l_id > __l_first")
        .groupBy("__l_id", "__l_row")
        .agg(F.collect_set("__l_pos").alias("__l_drop"))
    )


def _with_kept(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``docs`` with __l_lines (all) and __l_kept (those that stay, in their order)."""
    dropped = _dropped(docs, id_col, text_col, min_chars)
    joined = docs.withColumn("__l_row", F.expr(f"xxhash64(`{text_col}`)")).join(
        dropped.withColumnRenamed("__l_row", "__l_row2"),
        (F.col(id_col) == F.col("__l_id")) & (F.col("__l_row") == F.col("__l_row2")),
        "left",
    )
    return joined.withColumn("__l_lines", F.expr(_lines(text_col))).withColumn(
        "__l_kept",
        F.expr(
            """if(__l_drop is null, __l_lines,
                transform(array_except(sequence(0, size(__l_lines) - 1), __l_drop), i -> get(__l_lines, i)))"""
        ),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out of the text; a text that loses nothing stays as it is, null too."""
    joined = _with_kept(docs, id_col, text_col, min_chars)
    text = F.when(F.col("__l_drop").isNull(), F.col(text_col)).otherwise(F.array_join("__l_kept", "\n"))
    return joined.withColumn("__l_text", text).select(*[F.col("__l_text").alias(c) if c == text_col else F.col(c) for c in docs.columns])


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document the number of lines, of dropped lines, and the hash of what stays."""
    return _with_kept(docs.select(id_col, text_col), id_col, text_col, min_chars).select(
        F.col(id_col),
        F.size("__l_lines").cast("bigint").alias("n_lines"),
        (F.size("__l_lines") - F.size("__l_kept")).cast("bigint").alias("n_dropped"),
        F.sha2(F.array_join("__l_kept", "\n"), 256).alias("kept_sha256"),
    )


def op4(spark, sf_dir):
    return line_digest(table(spark, sf_dir, "documents"))


ORACLE = """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                  unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
k as (select doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key, min(doc_id) as first_id from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
j as (select k.doc_id, k.pos, k.line, coalesce(k.doc_id > c.first_id, false) as gone from k left join c using (key))
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by doc_id"""
