"""Gazetteer dumps: tab files of 19 columns, one place per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the dump, in order.
COLUMNS = (
    "geonameid long, name string, ascii string, alternate string, lat double, lon double, fclass string, fcode string, country string, cc2 string, "
    "admin1 string, admin2 string, admin3 string, admin4 string, population long, elevation string, dem string, timezone string, modified string"
)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(entry, name, ascii, alt, lat, lon, fclass, country, admin1, population); bad lines are left out."""
    raw = spark.read.csv(path, sep="\t", schema=COLUMNS, quote="", mode="DROPMALFORMED")
    alt = F.filter(F.split(F.coalesce("alternate", F.lit("")), ","), lambda a: a != "")
    return raw.filter("name is not null").select(F.col("geonameid").alias("entry"), "name", "ascii", alt.alias("alt"), "lat", "lon", "fclass", "country", "admin1", "population")


def gazetteer_names(places: DataFrame) -> DataFrame:
    """(key, entry): every spelling of every place, folded."""
    names = F.explode(F.array_distinct(F.concat(F.array("name", "ascii"), "alt")))
    return places.select("entry", names.alias("n")).select("entry", F.lower(F.trim("n")).alias("key")).filter("key != ''").distinct()
