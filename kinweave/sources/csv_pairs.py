"""CSV match lists: two consecutive rows are one match, the main record and the incoming one."""

from __future__ import annotations

import csv
import io
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.text import fold

#: The lists' headers by language; a list has either one column of parents or one for each.
FIELDS = ("given", "surname", "birth_date", "birth_place", "death_date", "death_place", "burial_date", "burial_place", "links", "partners", "parents", "father", "mother", "confidence")
HEADERS = {
    "sl": ("Ime", "Priimek", "Datum rojstva", "Kraj rojstva", "Datum smrti", "Kraj smrti", "Datum pokopa", "Kraj pokopa", "Povezave", "Partnerji", "Starši", "Oče", "Mati", "Zaupanje"),
    "en": ("Name", "Surname", "Date of Birth", "Place of Birth", "Date of Death", "Place of Death", "Burial date", "Burial place", "Links", "Partners", "Parents", "Father", "Mother", "Confidence"),
    "de": ("Vorname", "Nachname", "Geburtsdatum", "Geburtsort", "Sterbedatum", "Sterbeort", "Datum der Beerdigung", "Ort der Beerdigung", "Links", "Partner", "Eltern", "Vater", "Mutter", "Konfidenz"),
    "hr": ("Ime", "Prezime", "Datum rođenja", "Mjesto rođenja", "Datum smrti", "Mjesto smrti", "Datum pokopa", "Mjesto pokopa", "Poveznice", "Partneri", "Roditelji", "Otac", "Majka", "Pouzdanost"),
    "hu": ("Utónév", "Vezetéknév", "Születési dátum", "Születési hely", "Halál dátuma", "Halál helye", "Temetés dátuma", "Temetés helye", "Hivatkozások", "Partnerek", "Szülők", "Apa", "Anya", "Megbízhatóság"),
    "it": ("Nome", "Cognome", "Data di nascita", "Luogo di nascita", "Data di morte", "Luogo di morte", "Data di sepoltura", "Luogo di sepoltura", "Collegamenti", "Partner", "Genitori", "Padre", "Madre", "Confidenza"),
}
ANNOTATION = "🗒"
ROWS = "file string, match_id long, side string, language string, " + ", ".join(f"{f} string" for f in FIELDS)


def detect_fields(header: list[str]) -> tuple[str, dict[str, int]]:
    """The language whose headers fit best, and the column of each of its fields that the header has."""
    place = {h.strip(): i for i, h in reversed(list(enumerate(header)))}
    fits = {lang: {f: place[name] for f, name in zip(FIELDS, names, strict=True) if name in place} for lang, names in HEADERS.items()}
    best = max(fits, key=lambda lang: len(fits[lang]))
    return best, fits[best]


def parse_list(text: str) -> list[dict]:
    """Rows of one list in order, two to a match; rows of fewer columns than the header, such as footers, are dropped.

    Cells that are only an annotation are empty, and a surname loses the bracketed variant at its end.
    """
    rows = list(csv.reader(io.StringIO(text.lstrip("\ufeff"), newline="")))
    head = next((i for i, r in enumerate(rows) if {"given", "surname"} <= set(detect_fields(r)[1])), None)
    if head is None:
        raise ValueError("no header with a given name and a surname")
    language, fields = detect_fields(rows[head])
    out = []
    for r in rows[head + 1 :]:
        if len(r) < len(rows[head]):
            continue
        cells = {f: None if ANNOTATION in (v := r[i].strip()) or not v else v for f, i in fields.items()}
        if cells.get("surname"):
            cells["surname"] = re.sub(r"\s*\([^()]*\)\s*$", "", cells["surname"]).strip() or None
        if cells.get("given") or cells.get("surname"):
            out.append({"language": language} | dict.fromkeys(FIELDS) | cells)
    return [{"match_id": i // 2, "side": "incoming" if i % 2 else "main"} | r for i, r in enumerate(out)]


def read_match_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, match_id, side, language, fields...): cells as strings, of all lists below a path.

    Every list has a header of its own, and quoted cells may hold line breaks, so a file is one task.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                rows = parse_list(bytes(content).decode("utf-8", "replace"))
                if rows:
                    yield pd.DataFrame([{"file": name} | r for r in rows], dtype=object).astype({"match_id": "int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ROWS)


def match_key(given: Column, surname: Column, year: Column) -> Column:
    """The folded key by which a listed person is found again."""
    return F.concat_ws("|", F.coalesce(fold(given), F.lit("")), F.coalesce(fold(surname), F.lit("")), F.coalesce(year.cast("string"), F.lit("")))


def listed_people(rows: DataFrame) -> DataFrame:
    """(person, key, n): who the rows of one side name. Rows of one key are one person only if the birth year is known;
    others are a person each. The year is the last four digits in a row of the birth date."""
    year = F.nullif(F.regexp_extract("birth_date", r"(\d{4})(?!.*\d{4})", 1), F.lit(""))
    keyed = rows.withColumns({"key": match_key(F.col("given"), F.col("surname"), year), "year": year})
    person = F.when(F.col("year").isNotNull(), F.col("key")).otherwise(F.concat_ws("#", "key", "file", "match_id"))
    return keyed.withColumn("person", person).groupBy("side", "person", "key").agg(F.count("*").alias("n"), F.min(F.struct("file", "match_id"))["match_id"].alias("first"))


def relatives_of(rows: DataFrame) -> DataFrame:
    """(file, match_id, side, role, name): father, mother and partners that the cells name, one row each.

    A cell of both parents holds them in this order; several names are parted by line breaks, semicolons or commas.
    """
    parts = F.split(F.coalesce("parents", F.lit("")), r"\s*[;\n,]\s*")
    named = F.array(
        F.struct(F.lit("father").alias("role"), F.coalesce("father", F.get(parts, F.lit(0))).alias("name")),
        F.struct(F.lit("mother").alias("role"), F.coalesce("mother", F.get(parts, F.lit(1))).alias("name")),
    )
    mates = F.transform(F.split(F.coalesce("partners", F.lit("")), r"\s*[;\n,]\s*"), lambda p: F.struct(F.lit("partner").alias("role"), p.alias("name")))
    each = rows.select("file", "match_id", "side", F.explode(F.concat(named, mates)).alias("r")).select("file", "match_id", "side", "r.role", F.trim("r.name").alias("name"))
    return each.filter("name != ''")
