"""Places: hierarchy rollup, registers, coordinate clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kinweave.functions.geo import haversine_km, mercator_x, mercator_y
from kinweave.operators.graph import connected_components
from kinweave.session import materialize


def place_tree(uses: DataFrame, path: str, record: str) -> DataFrame:
    """(path, depth, own_uses, subtree_uses): one use per record and path, rolled up to every prefix."""
    u = uses.select(F.col(record).alias("r"), F.col(path).alias("p")).filter(F.size("p") > 0).distinct()
    prefix = u.select("r", "p", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.slice("p", 1, i))).alias("q"))
    return prefix.groupBy(F.array_join("q", " > ").alias("path"), F.size("q").alias("depth")).agg(
        F.count_if(F.size("q") == F.size("p")).alias("own_uses"), F.count("*").alias("subtree_uses")
    )


def search_rank(text: Column, query: Column) -> Column:
    """0 exact, 1 whole word, 2 prefix, 3 substring, null no hit."""
    t, q = F.lower(text), F.lower(query)
    return (
        F.when(t == q, 0)
        .when(F.array_contains(F.split(t, " "), q), 1)
        .when(t.startswith(q), 2)
        .when(t.contains(q), 3)
    )


def grid_cluster(points: DataFrame, lat: str, lon: str, zoom: int, cell: int = 44) -> DataFrame:
    """(cx, cy, n, lat, lon): points of a screen cell, with their mean place."""
    p = points.select(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    p = p.withColumns({"cx": F.floor(mercator_x(F.col("lon"), zoom) / cell), "cy": F.floor(mercator_y(F.col("lat"), zoom) / cell)})
    return p.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def coord_conflicts(points: DataFrame, place: str, lat: str, lon: str, apart: float = 0.0005) -> DataFrame:
    """(place, spot, lat, lon, n): distinct spots of a place; a coordinate joins the first spot, most used first, that
    holds a coordinate less than ``apart`` away on both axes; places with one spot only are left out.

    Coordinates are counted and snapped to cells of ``apart`` first. Cells of a place that touch make up a group:
    only coordinates of one group can join, so a task sees a group, not a place. Null places and coordinates are left out.
    """
    counted = points.filter(F.col(place).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    counted = counted.groupBy(F.col(place).alias("place"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).agg(F.count("*").alias("n"))
    counted = materialize(counted.withColumns({"cy": F.floor(F.col("lat") / apart), "cx": F.floor(F.col("lon") / apart)}).withColumn("cell", F.concat_ws("|", "place", "cy", "cx")))
    cells = counted.select("place", "cy", "cx", "cell").distinct()
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = cells.withColumn("dy", F.explode(near)).withColumn("dx", F.explode(near)).select("place", (F.col("cy") + F.col("dy")).alias("cy"), (F.col("cx") + F.col("dx")).alias("cx"), F.col("cell").alias("src"))
    touching = around.join(cells.withColumnRenamed("cell", "dst"), ["place", "cy", "cx"]).filter("src < dst").select("src", "dst")
    group = connected_components(touching).select(F.col("node").alias("cell"), F.col("component").alias("part"))
    parted = counted.join(group, "cell", "left").withColumn("part", F.coalesce("part", "cell")).select("place", "part", "lat", "lon", "n")
    alone = parted.groupBy("part").agg(F.count("*").alias("__k"))
    parted = materialize(parted.join(alone, "part"))

    def spots(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "lat", "lon"], ascending=[False, True, True])
        found: list[list] = []
        for row in frame.itertuples():
            for f in found:
                if any(abs(row.lat - a) < apart and abs(row.lon - b) < apart for a, b in f[2]):
                    f[2].append((row.lat, row.lon))
                    f[1] += row.n
                    break
            else:
                found.append([row, row.n, [(row.lat, row.lon)]])
        return pd.DataFrame([(f[0].place, f[0].lat, f[0].lon, f[0].n, f[1]) for f in found], columns=["place", "lat", "lon", "top", "n"])

    kind = points.schema[place].dataType.simpleString()
    met = parted.filter("__k > 1").groupBy("part").applyInPandas(spots, f"place {kind}, lat double, lon double, top long, n long")
    every = materialize(met.unionByName(parted.filter("__k = 1").select("place", "lat", "lon", F.col("n").alias("top"), "n")))
    order = Window.partitionBy("place").orderBy(F.desc("top"), "lat", "lon")
    ranked = every.withColumns({"spot": F.row_number().over(order) - 1, "__k": F.count("*").over(Window.partitionBy("place"))})
    return ranked.filter("__k > 1").select("place", "spot", "lat", "lon", "n")


#: Degrees of the grids that ``nearest`` looks at: around a point, and from coarse to fine for what is far from all.
RINGS, LEVELS = (0.25, 1.0, 4.0), (15.0, 1.0, 0.1)


def nearest(points: DataFrame, entries: DataFrame, key: str | None = None) -> DataFrame:
    """(id, entry, km): the entry nearest to each point (of the same ``key`` if one is given), ties by entry.

    points: id, key, lat, lon; entries: entry, key, elat, elon. Points meet the entries of their own and the
    neighbouring cells of a grid; a hit counts if nothing beyond these cells can be nearer, and what has none goes on
    with a coarser grid. Points far from everything go down a hierarchy of cells, keeping those whose nearest possible
    entry is not further than the best certain one, at most 288, then 225 and 100 cells below each. So the
    work follows what lies around a point, not all entries of a key. Nulls have no neighbour.
    """
    by = [key] if key else ["__one"]
    one = {} if key else {"__one": F.lit(1)}
    spots = entries.filter("elat is not null and elon is not null").withColumns(one).groupBy(*by, "elat", "elon").agg(F.min("entry").alias("entry"))
    left, found, spots = materialize(points.withColumns(one).filter("lat is not null and lon is not null").select("id", *by, "lat", "lon")), [], materialize(spots)
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon"))
    for size in RINGS:
        n = int(360 / size)
        near = F.array(F.lit(-1), F.lit(0), F.lit(1))
        around = left.withColumn("dy", F.explode(near)).withColumn("dx", F.explode(near))
        around = around.withColumns({"cy": F.floor(F.col("lat") / size) + F.col("dy"), "cx": F.pmod(F.floor((F.col("lon") + 180) / size) + F.col("dx"), F.lit(n))})
        cells = spots.withColumns({"cy": F.floor(F.col("elat") / size), "cx": F.pmod(F.floor((F.col("elon") + 180) / size), F.lit(n))})
        best = around.join(cells, [*by, "cy", "cx"]).withColumn("km", km).groupBy("id", "lat").agg(F.min(F.struct("km", "entry")).alias("m"))
        # the way out of these cells crosses a parallel or a meridian one cell away
        out_of = F.least(F.lit(size), F.degrees(F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(F.lit(size)))))) * (111.19 * 0.999)
        found.append(materialize(best.filter(F.col("m.km") < out_of).select("id", "m.entry", "m.km")))
        left = materialize(left.join(found[-1].select("id"), "id", "left_anti"))
        if left.isEmpty():
            break
    else:
        cell = [F.concat_ws(":", F.floor(F.col("elat") / s), F.floor((F.col("elon") + 180) / s)).alias(f"c{k}") for k, s in enumerate(LEVELS)]
        tree = materialize(spots.select("*", *cell))
        open_ = left
        for k in range(len(LEVELS)):
            path = [*by, *[f"c{j}" for j in range(k + 1)]]
            mid = tree.groupBy(*path).agg(F.min(F.struct("elat", "elon")).alias("p"))
            away = haversine_km(F.col("elat"), F.col("elon"), F.col("p.elat"), F.col("p.elon"))
            wide = tree.join(mid, path).groupBy(*path).agg(F.max(away).alias("radius"), F.first("p").alias("p"))
            met = open_.join(wide, path[:-1]).withColumn("d", haversine_km(F.col("lat"), F.col("lon"), F.col("p.elat"), F.col("p.elon")))
            least = met.groupBy("id").agg(F.min("d").alias("sure"))
            open_ = materialize(met.join(least, "id").filter("d - radius <= sure + 0.001").select("id", "lat", "lon", *path))
        last = open_.join(tree, [*by, *[f"c{j}" for j in range(len(LEVELS))]]).withColumn("km", km)
        found.append(last.groupBy("id").agg(F.min(F.struct("km", "entry")).alias("m")).select("id", "m.entry", "m.km"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("id", "entry", "km")
