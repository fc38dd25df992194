"""Record quality: rule unions, dangling pointers, branch export, redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_union(rules: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(id, rule, severity, n): one query per rule, each given as offending rows, id column, name and severity."""
    out = None
    for rows, id_col, rule, severity in rules:
        found = rows.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).select("id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n")
        out = found if out is None else out.unionByName(found)
    return out


def dangling(rows: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose pointer has no target; null pointers point nowhere and are no error."""
    return rows.filter(F.col(ref).isNotNull()).join(targets.select(F.col(key).alias("__k")), F.col(ref) == F.col("__k"), "left_anti")


def branch_export(people: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """(family, members): families of which at least ``least`` members are kept; people(id), members(family, member)."""
    kept = members.join(people.select(F.col("id").alias("member")), "member", "left_semi")
    return kept.groupBy("family").agg(F.countDistinct("member").alias("members")).filter(F.col("members") >= least)


def redact_text(text: Column) -> Column:
    """Mail and IPv4 addresses replaced by a tag."""
    mail = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[mail]")
    return F.regexp_replace(mail, r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", "[ip]")
