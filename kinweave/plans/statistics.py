"""Queries: statistics, windows, sorts, review and audit, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinweave.functions import dates, geo
from kinweave.functions.text import fold_ascii, shape
from kinweave.operators import gazetteer, places, profile, review
from kinweave.session import table


def infer_profile(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return profile.mode_first(e, ["user_id"], "event_type", "event_id")


def canonical_forms(spark, d):
    p = table(spark, d, "part").withColumn("spelling", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).otherwise(F.col("p_type")))
    return profile.canonical_forms(p, fold_ascii(F.col("p_type")), "spelling", "p_partkey")


def detect_layout(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    r = t.groupBy("source").agg(
        F.avg(F.contains("text", F.lit("|")).cast("int")).alias("piped"),
        F.avg(F.contains("text", F.lit("!!")).cast("int")).alias("shouted"),
        F.avg((F.size(F.split("text", "\n")) > 3).cast("int")).alias("lined"),
    )
    layout = F.when(F.col("piped") > 0.3, "list").when((F.col("shouted") > 0.15) & (F.col("lined") > 0.4), "loud").when(F.col("lined") > 0.4, "lines").otherwise("plain")
    return r.select("source", layout.alias("layout"))


def home_country(spark, d):
    # events of a user by type and value range: the group, its distinct units and their vote
    c = table(spark, d, "customer").withColumn("bucket", F.col("c_custkey") % 97).withColumn("vote", F.when(F.col("c_custkey") % 5 != 0, F.col("bucket") % 25).otherwise(F.col("c_nationkey")))
    return profile.majority(c, "bucket", "vote", "c_custkey").select("bucket", "vote", "n", F.round("share", 6).alias("share"))


def estimate_birth(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.year("l_shipdate")).alias("y")).select("l_orderkey", profile.upper_median(F.col("y")).alias("estimate"))


def best_estimate(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_shipdate", -F.col("l_linenumber"))).alias("line"), F.max(F.year("l_shipdate")).alias("estimate"))
    return li


def content_duplicates(spark, d):
    t = table(spark, d, "documents").filter("text is not null").withColumn("h", F.sha2("text", 256))
    labelled = table(spark, d, "labels").groupBy("doc_id").agg(F.count("*").alias("cited"))
    t = t.select("doc_id", "h").join(labelled, "doc_id", "left").withColumn("cited", F.coalesce("cited", F.lit(0)))
    groups = t.groupBy("h").agg(F.max_by("doc_id", F.struct("cited", -F.col("doc_id"))).alias("survivor"), F.count("*").alias("copies"))
    return groups.filter("copies > 1").select("survivor", "copies")


def repoint(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = t.join(t.groupBy("h").agg(F.min("doc_id").alias("survivor")), "h").select("doc_id", "survivor")
    return table(spark, d, "labels").join(first, "doc_id", "left").select(F.coalesce("survivor", "doc_id").alias("doc_id"), "quality", "toxic").distinct()


def _points(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_custkey") % 140 - 70 + 0.5).cast("double").alias("lat"), (F.col("o_orderkey") % 340 - 170 + 0.25).cast("double").alias("lon"), F.year("o_orderdate").alias("year"))


POINTS = "p as (select o_orderkey, o_custkey, o_orderstatus, cast(o_custkey % 140 - 70 + 0.5 as double) as lat, cast(o_orderkey % 340 - 170 + 0.25 as double) as lon, year(o_orderdate) as year from orders)"


def grid_cluster(spark, d):
    g = places.grid_cluster(_points(spark, d), "lat", "lon", 3)
    return g.select("cx", "cy", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def coord_conflicts(spark, d):
    k = F.col("o_orderkey")
    lat = (F.col("o_custkey") % 1400) / 10 - 70 + F.when(k % 3 == 0, 0.0004).when(k % 3 == 1, 0.0008).otherwise(0.0)
    s = table(spark, d, "orders").select(F.concat("o_orderpriority", F.lit("-"), F.col("o_custkey") % 5000).alias("place"), lat.alias("lat"), F.lit(14.5).alias("lon"))
    return places.coord_conflicts(s, "place", "lat", "lon").select("place", "spot", F.round("lat", 6).alias("lat"), "n")


def coord_fill(spark, d):
    p = _points(spark, d)
    agreed = p.filter("o_orderkey % 4 != 0").groupBy("o_custkey").agg(F.countDistinct("lat").alias("k"), F.min("lat").alias("known")).filter("k = 1")
    return p.filter("o_orderkey % 4 = 0").join(agreed, "o_custkey").select("o_orderkey", F.col("known").alias("lat"))


def map_points(spark, d):
    return _points(spark, d).filter("o_orderstatus in ('F', 'O') and year between 1996 and 1998").select("o_orderkey", "lat", "lon", "year")


def haversine(spark, d):
    p = _points(spark, d)
    return p.select("o_orderkey", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(46.05), F.lit(14.5)), 5).alias("km"))


def web_mercator(spark, d):
    p = _points(spark, d)
    return p.select("o_orderkey", F.round(geo.mercator_x(F.col("lon"), 4), 5).alias("x"), F.round(geo.mercator_y(F.col("lat"), 4), 5).alias("y"))


def parse_coord(spark, d):
    s = table(spark, d, "supplier")
    text = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "N").otherwise("S"), (F.col("s_suppkey") % 90).cast("string"), F.lit("."), (F.col("s_suppkey") % 7).cast("string"))
    return s.select("s_suppkey", geo.parse_coord(text).alias("degrees"))


def nearest_register(spark, d):
    p = _points(spark, d)
    q = p.filter("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("key"), "lat", "lon")
    e = p.select(F.col("o_orderkey").alias("entry"), F.col("o_orderstatus").alias("key"), (F.col("lat") * 0.9 + 3).alias("elat"), (F.col("lon") * 0.7 + 11).alias("elon"))
    return places.nearest(q, e, "key").select("id", F.round("km", 4).alias("km"))


def person_paths(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("last", F.lag("event_type").over(w)).filter("last is null or last != event_type")
    e = e.withColumn("stops", F.count("*").over(Window.partitionBy("user_id"))).filter("stops >= 2")
    return e.select("user_id", "event_type", F.row_number().over(w).alias("stop"))


def pick_survivor(spark, d):
    return profile.top_one(table(spark, d, "orders"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


def confident_best(spark, d):
    return profile.confident_best(table(spark, d, "orders"), "o_custkey", "o_totalprice", 5000.0, F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


def birth_order(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("place"))


def parallel_families(spark, d):
    r = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    a, b = r.toDF("c", "status_a", "alo", "ahi"), r.toDF("c", "status_b", "blo", "bhi")
    inside = "status_a != status_b and blo >= add_months(to_date(alo), 9) and bhi <= add_months(to_date(ahi), -9) and datediff(ahi, alo) >= 548"
    return a.join(b, "c").filter(inside).select(F.col("c").alias("o_custkey"), "status_a", "status_b")


def _partial(day, qualifier, has_month, has_day, end=None):
    """A partial date of a timestamp; parts that are switched off are null."""
    none = F.lit(None).cast("int")
    return F.struct(
        F.lit(None).cast("string").alias("raw"), qualifier.alias("qualifier"), F.year(day).alias("year"),
        F.when(has_month, F.month(day)).alias("month"), F.when(has_month & has_day, F.dayofmonth(day)).alias("day"),
        (none if end is None else F.when(qualifier.isin("between", "range"), F.year(day) + end)).cast("int").alias("year2"), none.alias("month2"), none.alias("day2"),
    )


def date_sort_key(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    q = F.when(k % 5 == 0, "before").when(k % 5 == 1, "after").when(k % 7 == 2, "range").otherwise("exact")
    o = o.withColumn("d", F.when(k % 11 != 0, _partial(F.col("o_orderdate"), q, k % 3 != 0, k % 2 == 0, 2)))
    return o.select("o_orderkey", dates.sort_key(F.col("d")).cast("long").alias("sort_key"))


def _date_pairs(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").withColumn("prev", F.lag("o_orderdate").over(w)).filter("prev is not null")
    return o, [f(c) for c in ("prev", "o_orderdate") for f in (F.year, F.month, F.dayofmonth)]


def date_similarity(spark, d):
    o, _ = _date_pairs(spark, d)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    qa = F.when(k % 6 == 1, "about").when(k % 6 == 2, "before").when(k % 6 == 3, "between").otherwise("exact")
    qb = F.when(c % 5 == 1, "about").when(c % 5 == 2, "after").otherwise("exact")
    a = _partial(F.add_months(F.to_date("prev"), -12 * (k % 9).cast("int")), qa, k % 4 != 0, k % 8 != 1, 1)
    b = _partial(F.to_date("o_orderdate"), qb, c % 4 != 0, c % 7 != 1, 1)
    return o.select("o_orderkey", F.round(dates.date_similarity(a, b), 9).alias("similarity"))


def age_between(spark, d):
    o, parts = _date_pairs(spark, d)
    return o.select("o_orderkey", dates.age_between(*parts).cast("int").alias("age"))


def parse_date(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 3 == 0, "ABT ").otherwise(""), F.upper(F.date_format("o_orderdate", "d MMM yyyy"))).alias("phrase"))
    # phrases repeat: each is parsed once
    parsed = o.select("phrase").distinct().withColumn("p", dates.parse_date(2024)("phrase"))
    return o.join(parsed, "phrase").select("o_orderkey", "p.qualifier", "p.year", "p.month", "p.day")


def place_tree(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.array(F.col("r_name"), F.col("n_name"), F.col("c_mktsegment"))
    return places.place_tree(c.withColumn("path", F.when(F.col("c_custkey") % 7 == 0, F.slice(path, 1, 2)).otherwise(path)), "path", "c_custkey")


PLACE_TREE = """with c as (select c_custkey, r_name, n_name, case when c_custkey % 7 <> 0 then c_mktsegment end as s from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select r_name as path, 1 as depth, 0 as own_uses, count(*) as subtree_uses from c group by r_name
union all select r_name || ' > ' || n_name, 2, count(*) filter (s is null), count(*) from c group by r_name, n_name
union all select r_name || ' > ' || n_name || ' > ' || s, 3, count(*), count(*) from c where s is not null group by r_name, n_name, s"""


def place_groups(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_nationkey").agg(F.count("*").alias("uses"), F.count_if(F.col("o_totalprice") < 50000).alias("missing"), F.countDistinct("o_custkey").alias("people"))


def register_lookup(spark, d):
    """Nations as a gazetteer, with their regions as what they lie in; names written small, with a typo, or under the wrong region."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    entries = n.select(
        k.alias("entry"), F.col("n_name").alias("name"), F.concat(F.lit("OLD "), "n_name").alias("ascii"), F.array(F.concat("n_name", F.lit(" LAND"))).alias("alt"), (k * 2.0).alias("lat"), (k * 3.0).alias("lon"),
        F.lit("P").alias("fclass"), F.col("n_regionkey").cast("string").alias("country"), F.array("r_name").alias("admin"), (k * 10).alias("population"), F.lit(False).alias("register"),
    )
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == k)
    i = F.col("c_custkey")
    name = F.when(i % 4 == 0, F.concat(F.lit("Old "), F.initcap("n_name"))).when(i % 4 == 1, F.concat("n_name", F.lit("X"))).otherwise(F.lower("n_name"))
    parents = F.when(i % 3 == 0, F.array("r_name")).when(i % 3 == 1, F.array(F.lit("Nowhere")))
    country = F.when(i % 5 == 0, F.col("n_regionkey").cast("string")).when(i % 5 == 1, F.lit("77"))
    written = c.select(i.alias("id"), name.alias("name"), parents.alias("parents"), country.alias("country"))
    return gazetteer.lookup(written, entries).select("id", "entry", F.round("score", 9).alias("score"))


REGISTER_LOOKUP = """with w as (select c_custkey as id, n_nationkey as entry, length(n_name) as l, c_custkey % 4 as f, c_custkey % 3 as p, c_custkey % 5 as c from customer join nation on c_nationkey = n_nationkey)
select id, entry, round(cast(case when f = 0 then 0.97 when f = 1 then 0.94 * ((l / l + l / (l + 1) + 1) / 3 + 0.4 * (1 - (l / l + l / (l + 1) + 1) / 3)) else 1 end - case when p = 1 then 0.06 else 0 end as double), 9) as score from w where c <> 1"""


def ranked_search(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name").withColumn("rank", places.search_rank(F.col("p_name"), F.lit("ring")))
    return p.filter("rank is not null").orderBy("rank", "p_name", "p_partkey").limit(50).select("p_partkey", "rank")


def place_compare_key(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", gazetteer.place_key(F.concat_ws(" ,", "n_name", "r_name", F.lit("Österreich"), "n_name", F.lit("Združene države Amerike"))).alias("key"))


def example_shapes(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", shape(F.col("c_name")).alias("shape"))
    return profile.top_one(c, ["shape"], F.asc("c_custkey")).select("shape", "c_custkey")


def batch_filter(spark, d):
    c = table(spark, d, "customer")
    own = F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") > 0) & F.contains("c_name", F.lit("1"))
    buyers = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey")
    return c.filter(F.coalesce(own, F.lit(False))).join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def people_search(spark, d):
    p = table(spark, d, "part")
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    hits = p.filter(F.contains(hay, F.lit("ring")) & F.contains(hay, F.lit("brand#1")))
    return hits.orderBy(F.lower("p_name"), "p_size", "p_partkey").limit(50).select("p_partkey", "p_name")


def candidate_filter(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice >= 80000")
    rejected = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return o.join(rejected, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


def candidate_sort(spark, d):
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), F.asc_nulls_last("far"), "o_orderkey")
    o = table(spark, d, "orders").withColumn("far", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 17))
    return o.withColumn("k", F.row_number().over(w)).filter("k <= 20").select("o_orderstatus", "o_orderkey", F.col("k").cast("int").alias("k"))


def kinship_rerank(spark, d):
    c = table(spark, d, "customer").withColumn("distance", F.when(F.col("c_custkey") % 4 != 0, F.floor(F.log2("c_custkey"))))
    w = Window.partitionBy("c_nationkey").orderBy(F.asc_nulls_last("distance"), F.desc("c_acctbal"), "c_custkey")
    return c.select("c_nationkey", "c_custkey", F.row_number().over(w).alias("rank"))


def _snapshots(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    a = c.filter("c_custkey % 5 != 0").withColumn("segment", F.when(F.col("c_custkey") % 4 != 0, F.col("segment")))
    b = c.filter("c_custkey % 7 != 0").withColumn("nation", F.when(F.col("c_custkey") % 6 == 0, "99").when(F.col("c_custkey") % 9 != 0, F.col("nation")))
    return a, b


FIELDS = ["c_name", "segment", "nation"]
SNAPS = """a as (select c_custkey, c_name, case when c_custkey % 4 <> 0 then c_mktsegment end as segment, cast(c_nationkey as varchar) as nation from customer where c_custkey % 5 <> 0),
b as (select c_custkey, c_name, c_mktsegment as segment, case when c_custkey % 6 = 0 then '99' when c_custkey % 9 <> 0 then cast(c_nationkey as varchar) end as nation from customer where c_custkey % 7 <> 0),
j as (select coalesce(a.c_custkey, b.c_custkey) as id, f.field, coalesce(case f.field when 'c_name' then a.c_name when 'segment' then a.segment else a.nation end, '') as main,
      coalesce(case f.field when 'c_name' then b.c_name when 'segment' then b.segment else b.nation end, '') as incoming
      from a full join b on a.c_custkey = b.c_custkey, (values ('c_name'), ('segment'), ('nation')) as f(field)),
s as (select *, case when main = '' and incoming = '' then 'agree' when main = '' then 'incoming-only' when incoming = '' then 'main-only' when main = incoming then 'agree' else 'conflict' end as state from j)"""


def field_states(spark, d):
    return review.field_states(*_snapshots(spark, d), "c_custkey", FIELDS)


def diff_counts(spark, d):
    return review.diff_counts(field_states(spark, d))


def default_choice(spark, d):
    return review.default_choice(field_states(spark, d)).select("id", "field", "choice")


def merge_choices(spark, d):
    return review.merge_choices(field_states(spark, d)).select("id", "field", "value")


def audit_diff(spark, d):
    a, b = _snapshots(spark, d)
    return review.audit_diff(a, b, "c_custkey", FIELDS)


def record_fingerprint(spark, d):
    p = table(spark, d, "part").withColumn("f", review.fingerprint(["p_name", "p_brand", "p_size"]))
    return p.groupBy("f").agg(F.count("*").alias("records"), F.min("p_partkey").alias("first")).select("first", "records")


def coalesce_patches(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumns({"before": F.lag("event_type").over(w), "after": F.col("event_type"), "ord": F.row_number().over(w)}).filter("ord > 1")
    return review.coalesce_patches(e, "user_id", "ord")


def report_totals(spark, d):
    s = field_states(spark, d)
    return s.agg(
        F.countDistinct(F.when(F.col("state") == "incoming-only", F.col("id"))).alias("added"),
        F.countDistinct(F.when(F.col("state") == "conflict", F.col("id"))).alias("changed"),
        F.count_if(F.col("state") == "conflict").alias("fields"),
    )


def link_diff(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return c.select("l_orderkey", F.size(F.array_except("a", "b")).alias("only_a"), F.size(F.array_union("a", "b")).alias("either"))


def relationship_count(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("relatives"))


def infer_sex(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_linestatus").alias("k"), F.min("l_linestatus").alias("role"))
    return li.filter("k = 1").select("l_orderkey", "role")


def yearly(spark, d):
    return table(spark, d, "orders").agg(F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"), F.count_if(F.col("o_totalprice") > 100000).alias("covered"))


SIM = """with q as (select o_orderkey as k, o_custkey as c, cast(o_orderdate as date) as b, cast(lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as date) as a from orders),
p as (select k, c, (a - to_months(12 * (k % 9)::int))::date as a, b from q where a is not null),
r as (select k, case k % 6 when 1 then 'about' when 2 then 'before' when 3 then 'between' else 'exact' end as qa, case c % 5 when 1 then 'about' when 2 then 'after' else 'exact' end as qb,
  year(a) as ya, case when k % 4 <> 0 then month(a) end as ma, case when k % 4 <> 0 and k % 8 <> 1 then day(a) end as da,
  year(b) as yb, case when c % 4 <> 0 then month(b) end as mb, case when c % 4 <> 0 and c % 7 <> 1 then day(b) end as db from p),
t as (select *, case when qa = 'before' then -9999999 else ya end as la, case when qa = 'between' then ya + 1 else ya end as ha,
  yb as lb, case when qb = 'after' then 9999999 else yb end as hb, abs(ya - yb) as gap, case when qa <> 'exact' or qb <> 'exact' then 10 else 4 end as tol from r)
select k as o_orderkey, round(cast(case
  when (qa in ('before', 'between') or qb = 'after') and la <= hb and lb <= ha then 0.9
  when (qa in ('before', 'between') or qb = 'after') then case when (case when la > hb then la - hb else lb - ha end) > 10 then 0 else 1 - (case when la > hb then la - hb else lb - ha end) / 11.0 end
  when gap > tol then 0 when gap > 0 then 1 - gap / (tol + 1.0)
  when ma <> mb then 0.55 when da <> db then 0.9
  when qa = 'exact' and qb = 'exact' and da is not null and db is not null then 1.0 else 0.9 end as double), 9) as similarity from t"""
PREV = "q as (select o_orderkey, o_orderdate as b, lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as a from orders), p as (select o_orderkey, year(a) as y1, month(a) as m1, day(a) as d1, year(b) as y2, month(b) as m2, day(b) as d2 from q where a is not null)"

QUERIES = {
    "infer_profile": (infer_profile, "with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by 1, 2) select user_id, event_type, n from c qualify row_number() over (partition by user_id order by n desc, f) = 1"),
    "canonical_forms": (canonical_forms, """with s as (select lower(p_type) as key, case when p_partkey % 3 = 0 then upper(p_type) else p_type end as canonical, p_partkey from part),
        c as (select key, canonical, count(*) as n, min(p_partkey) as f from s group by 1, 2), k as (select key, count(*) as spellings from c group by 1)
        select key, canonical, n, spellings from c join k using (key) qualify row_number() over (partition by key order by n desc, f) = 1"""),
    "detect_layout": (detect_layout, """with r as (select source, avg(contains(text, '|')::int) as piped, avg(contains(text, '!!')::int) as shouted, avg((len(string_split(text, chr(10))) > 3)::int) as lined from documents where text is not null group by 1)
        select source, case when piped > 0.3 then 'list' when shouted > 0.15 and lined > 0.4 then 'loud' when lined > 0.4 then 'lines' else 'plain' end as layout from r"""),
    "home_country": (home_country, """with v as (select c_custkey % 97 as bucket, c_custkey, case when c_custkey % 5 <> 0 then c_custkey % 97 % 25 else c_nationkey end as vote from customer),
        c as (select bucket, vote, count(distinct c_custkey) as n from v group by 1, 2), t as (select *, n / sum(n) over (partition by bucket) as share from c)
        select bucket, vote, n, round(share, 6) as share from t where share >= 0.75 and n >= 2"""),
    "estimate_birth": (estimate_birth, "select l_orderkey, list_sort(list(year(l_shipdate)))[(count(*) // 2 + 1)::int] as estimate from lineitem group by 1"),
    "best_estimate": (best_estimate, "select l_orderkey, l_linenumber as line, year(l_shipdate) as estimate from lineitem qualify row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber) = 1"),
    "content_duplicates": (content_duplicates, """with t as (select doc_id, text, coalesce(c, 0) as c from documents left join (select doc_id, count(*) as c from labels group by 1) using (doc_id) where text is not null)
        select first(doc_id order by c desc, doc_id) as survivor, count(*) as copies from t group by text having count(*) > 1"""),
    "repoint": (repoint, "with f as (select doc_id, min(doc_id) over (partition by text) as s from documents where text is not null) select distinct coalesce(s, doc_id) as doc_id, quality, toxic from labels left join f using (doc_id)"),
    "grid_cluster": (grid_cluster, f"with {POINTS}, q as (select lat, lon, cast(floor((lon + 180) / 360 * 2048 / 44) as bigint) as cx, cast(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * 3.141592653589793)) * 2048 / 44) as bigint) as cy from p) select cx, cy, count(*) as n, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon from q group by 1, 2"),
    "coord_conflicts": (coord_conflicts, None),
    "coord_fill": (coord_fill, f"with {POINTS}, a as (select o_custkey, min(lat) as k from p where o_orderkey % 4 <> 0 group by 1 having count(distinct lat) = 1) select o_orderkey, k as lat from p join a using (o_custkey) where o_orderkey % 4 = 0"),
    "map_points": (map_points, f"with {POINTS} select o_orderkey, lat, lon, year from p where o_orderstatus in ('F', 'O') and year between 1996 and 1998"),
    "haversine": (haversine, f"with {POINTS} select o_orderkey, round(2 * 6371 * asin(sqrt(least(1, power(sin(radians(46.05 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(46.05)) * power(sin(radians(14.5 - lon) / 2), 2)))), 5) as km from p"),
    "web_mercator": (web_mercator, f"with {POINTS} select o_orderkey, round((lon + 180) / 360 * 4096, 5) as x, round((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * 3.141592653589793)) * 4096, 5) as y from p"),
    "parse_coord": (parse_coord, "select s_suppkey, (case when s_suppkey % 2 = 0 then 1 else -1 end) * cast((s_suppkey % 90) || '.' || (s_suppkey % 7) as double) as degrees from supplier"),
    "nearest_register": (nearest_register, f"""with {POINTS}, e as (select distinct o_orderstatus as key, lat * 0.9 + 3 as elat, lon * 0.7 + 11 as elon from p), q as (select * from p where o_orderkey % 20 = 0)
        select o_orderkey as id, round(min(2 * 6371 * asin(sqrt(least(1, power(sin(radians(elat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(elat)) * power(sin(radians(elon - lon) / 2), 2))))), 4) as km
        from q join e on key = o_orderstatus group by 1"""),
    "person_paths": (person_paths, """with e as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as last from events), k as (select * from e where last is null or last <> event_type),
        c as (select *, count(*) over (partition by user_id) as stops from k) select user_id, event_type, cast(row_number() over (partition by user_id order by ts, event_id) as int) as stop from c where stops >= 2"""),
    "pick_survivor": (pick_survivor, "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1"),
    "confident_best": (confident_best, "with r as (select *, row_number() over w as k, lead(o_totalprice) over w as nx from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)) select o_custkey, o_orderkey from r where k = 1 and (nx is null or nx <= o_totalprice - 5000)"),
    "birth_order": (birth_order, "select o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int) as place from orders"),
    "parallel_families": (parallel_families, """with r as (select o_custkey, o_orderstatus as s, min(o_orderdate) as lo, max(o_orderdate) as hi from orders group by 1, 2)
        select a.o_custkey, a.s as status_a, b.s as status_b from r a join r b on a.o_custkey = b.o_custkey and a.s <> b.s
        where cast(b.lo as timestamp) >= cast(cast(a.lo as date) + interval 9 month as timestamp) and cast(b.hi as timestamp) <= cast(cast(a.hi as date) - interval 9 month as timestamp) and date_diff('day', cast(a.lo as date), cast(a.hi as date)) >= 548"""),
    "date_sort_key": (date_sort_key, """with o as (select o_orderkey as k, case when o_orderkey % 11 <> 0 then year(o_orderdate) end as y, case when o_orderkey % 3 <> 0 then month(o_orderdate) end as m,
          case when o_orderkey % 3 <> 0 and o_orderkey % 2 = 0 then day(o_orderdate) end as dd from orders)
        select k as o_orderkey, cast(case when y is null then 9999999 when k % 5 = 0 then y * 10000 - 1 when k % 5 = 1 then y * 10000 + 9999 when k % 7 = 2 then (y + 2) * 10000 + 9000
          when m is null then y * 10000 + 9000 when dd is null then y * 10000 + m * 100 + 50 else y * 10000 + m * 100 + dd end as bigint) as sort_key from o"""),
    "date_similarity": (date_similarity, SIM),
    "age_between": (age_between, f"with {PREV} select o_orderkey, cast(y2 - y1 - (case when m2 < m1 or (m2 = m1 and d2 < d1) then 1 else 0 end) as int) as age from p"),
    "parse_date": (parse_date, "select o_orderkey, case when o_orderkey % 3 = 0 then 'about' else 'exact' end as qualifier, year(o_orderdate) as year, month(o_orderdate) as month, day(o_orderdate) as day from orders"),
    "place_tree": (place_tree, PLACE_TREE),
    "place_groups": (place_groups, "select c_nationkey, count(*) as uses, count(*) filter (o_totalprice < 50000) as missing, count(distinct o_custkey) as people from orders join customer on o_custkey = c_custkey group by 1"),
    "register_lookup": (register_lookup, REGISTER_LOOKUP),
    "ranked_search": (ranked_search, "select p_partkey, cast(r as int) as rank from (select p_partkey, p_name, case when lower(p_name) = 'ring' then 0 when list_contains(string_split(lower(p_name), ' '), 'ring') then 1 when starts_with(lower(p_name), 'ring') then 2 when contains(lower(p_name), 'ring') then 3 end as r from part) as t where r is not null order by r, p_name, p_partkey limit 50"),
    "place_compare_key": (place_compare_key, """with t as (select n_nationkey, case replace(lower(n_name), ' ', '') when 'unitedstates' then 'unitedstates' else replace(lower(n_name), ' ', '') end as n, replace(lower(r_name), ' ', '') as r from nation join region on n_regionkey = r_regionkey)
        select n_nationkey, n || case when r <> n then ',' || r else '' end || ',austria' || case when n <> 'unitedstates' then ',unitedstates' else '' end as key from t"""),
    "example_shapes": (example_shapes, "select shape, min(c_custkey) as c_custkey from (select c_custkey, regexp_replace(regexp_replace(c_name, '\\d', '#', 'g'), '\\p{L}', 'A', 'g') as shape from customer) as t group by 1"),
    "batch_filter": (batch_filter, "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal > 0 and contains(c_name, '1') and c_custkey in (select o_custkey from orders where o_orderstatus = 'F')"),
    "people_search": (people_search, "select p_partkey, p_name from part where contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring') and contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1') order by lower(p_name), p_size, p_partkey limit 50"),
    "candidate_filter": (candidate_filter, "select o_orderkey from orders where o_totalprice >= 80000 and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')"),
    "candidate_sort": (candidate_sort, "select o_orderstatus, o_orderkey, cast(row_number() over w as int) as k from orders window w as (partition by o_orderstatus order by o_totalprice desc, case when o_orderkey % 3 <> 0 then o_custkey % 17 end nulls last, o_orderkey) qualify k <= 20"),
    "kinship_rerank": (kinship_rerank, "select c_nationkey, c_custkey, cast(row_number() over (partition by c_nationkey order by case when c_custkey % 4 <> 0 then floor(log2(c_custkey)) end nulls last, c_acctbal desc, c_custkey) as int) as rank from customer"),
    "field_states": (field_states, f"with {SNAPS} select id, field, main, incoming, state from s"),
    "diff_counts": (diff_counts, f"with {SNAPS} select id, count(*) filter (state = 'incoming-only') as n_new, count(*) filter (state = 'conflict') as n_diff, count(*) filter (state = 'agree') as n_agree from s group by id"),
    "default_choice": (default_choice, f"with {SNAPS} select id, field, case when main = '' and incoming <> '' then 'incoming' else 'main' end as choice from s"),
    "merge_choices": (merge_choices, f"with {SNAPS} select id, field, case when main = '' then incoming else main end as value from s"),
    "audit_diff": (audit_diff, f"""with {SNAPS} select coalesce(a.c_custkey, b.c_custkey) as id, case when a.c_custkey is null then 'added' when b.c_custkey is null then 'removed' else 'changed' end as change
        from a full join b on a.c_custkey = b.c_custkey where a.c_custkey is null or b.c_custkey is null or a.segment is distinct from b.segment or a.nation is distinct from b.nation"""),
    "record_fingerprint": (record_fingerprint, "select min(p_partkey) as first, count(*) as records from part group by p_name, p_brand, p_size"),
    "coalesce_patches": (coalesce_patches, """with e as (select user_id, event_type as after, lag(event_type) over w as before, row_number() over w as o from events window w as (partition by user_id order by ts, event_id)),
        g as (select user_id, first(before order by o) as before, last(after order by o) as after from e where o > 1 group by 1) select * from g where before is distinct from after"""),
    "report_totals": (report_totals, f"with {SNAPS} select count(distinct id) filter (state = 'incoming-only') as added, count(distinct id) filter (state = 'conflict') as changed, count(*) filter (state = 'conflict') as fields from s"),
    "link_diff": (link_diff, """with c as (select l_orderkey, list_distinct(list(l_returnflag)) as a, list_distinct(list(l_linestatus)) as b from lineitem group by 1)
        select l_orderkey, cast(len(list_filter(a, lambda x: not list_contains(b, x))) as int) as only_a, cast(len(list_distinct(list_concat(a, b))) as int) as either from c"""),
    "relationship_count": (relationship_count, "select l_suppkey, count(distinct l_partkey) as relatives from lineitem group by 1"),
    "infer_sex": (infer_sex, "select l_orderkey, min(l_linestatus) as role from lineitem group by 1 having count(distinct l_linestatus) = 1"),
    "year_range": (yearly, "select min(year(o_orderdate)) as first_year, max(year(o_orderdate)) as last_year, count(*) filter (o_totalprice > 100000) as covered from orders"),
}
