"""Queries: record quality, graph walks, privacy and text helpers, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import graph
from kinweave.operators.quality import branch_export, dangling, redact_text, rule_union
from kinweave.functions.links import link_key, page_title
from kinweave.session import table


def validate_records(spark, d):
    o, li, c = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer")
    both = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    twice = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")
    return rule_union(
        [
            (both.filter("l_shipdate < o_orderdate"), "l_orderkey", "shipBeforeOrder", "error"),
            (o.filter("o_orderdate > timestamp '2001-07-01'"), "o_orderkey", "futureDate", "error"),
            (o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "o_orderkey", "orphan", "error"),
            (li.filter("l_quantity > 49 or l_discount < 0"), "l_orderkey", "outOfRange", "warning"),
            (twice, "l_orderkey", "duplicatePointer", "warning"),
            (c.filter("c_acctbal < -900"), "c_custkey", "balance", "info"),
        ]
    )


VALIDATE = """select l_orderkey as id, 'shipBeforeOrder' as rule, 'error' as severity, count(*) as n from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate group by 1
union all select o_orderkey, 'futureDate', 'error', count(*) from orders where o_orderdate > timestamp '2001-07-01' group by 1
union all select o_orderkey, 'orphan', 'error', count(*) from orders where o_custkey not in (select c_custkey from customer) group by 1
union all select l_orderkey, 'outOfRange', 'warning', count(*) from lineitem where l_quantity > 49 or l_discount < 0 group by 1
union all select l_orderkey, 'duplicatePointer', 'warning', count(*) from (select l_orderkey from lineitem group by l_orderkey, l_linenumber having count(*) > 1) as t group by 1
union all select c_custkey, 'balance', 'info', count(*) from customer where c_acctbal < -900 group by 1"""


def validate_structure(spark, d):
    t, p = table(spark, d, "documents"), table(spark, d, "pages")
    return rule_union(
        [
            (t.filter("text is null or text = ''"), "doc_id", "missingText", "error"),
            (t.filter("n_chars != length(text)"), "doc_id", "lengthMismatch", "warning"),
            (p.filter(~F.contains("html", F.lit("</html>"))), "page_id", "unclosed", "warning"),
            (p.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("k")).filter("k > 1"), "page_id", "duplicateId", "warning"),
        ]
    )


STRUCTURE = """select doc_id as id, 'missingText' as rule, 'error' as severity, count(*) as n from documents where text is null or text = '' group by 1
union all select doc_id, 'lengthMismatch', 'warning', count(*) from documents where n_chars <> length(text) group by 1
union all select page_id, 'unclosed', 'warning', count(*) from pages where not contains(html, '</html>') group by 1
union all select page_id, 'duplicateId', 'warning', count(*) from (select min(page_id) as page_id from pages group by url having count(*) > 1) as t group by 1"""


def issue_counts(spark, d):
    return validate_records(spark, d).groupBy("rule", "severity").agg(F.count("*").alias("subjects"))


def dangling_refs(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey % 13 != 0")
    return dangling(table(spark, d, "lineitem"), "l_orderkey", o, "o_orderkey").select(F.col("l_orderkey").alias("ref")).distinct()


def branch(spark, d):
    c = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("id"))
    members = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("family"), F.col("o_custkey").alias("member"))
    return branch_export(c, members, 2)


def _tree(spark, d):
    p = table(spark, d, "customer")
    return p.filter("c_custkey > 1").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 2).alias("parent"))


def _edges(spark, d):
    t = _tree(spark, d)
    return t.select(F.col("child").alias("src"), F.col("parent").alias("dst")).union(t.select(F.col("parent").alias("src"), F.col("child").alias("dst")))


def bfs_distance(spark, d):
    return graph.bfs_distance(_edges(spark, d), spark.createDataFrame([(5,)], "node long"))


def kinship_sets(spark, d):
    return graph.closure(_tree(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("node")))


def descendants(spark, d):
    t = _tree(spark, d).select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return graph.closure(t, spark.createDataFrame([(3,)], "node long")).select("node", "generation")


def branch_ids(spark, d):
    t = _tree(spark, d).select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return graph.closure(t, spark.createDataFrame([(2,)], "node long"), 4).select("node", "generation")


def ahnentafel(spark, d):
    c = table(spark, d, "customer")
    up = c.select(F.col("c_custkey").alias("child"), (F.col("c_custkey") * 2).alias("parent"), F.lit("father").alias("role"))
    up = up.union(c.select("c_custkey", F.col("c_custkey") * 2 + 1, F.lit("mother")))
    known = c.select(F.col("c_custkey").alias("parent"))
    return graph.ahnentafel(up.join(known, "parent", "left_semi").select("child", "parent", "role"), 1, 20).select("number", "node", "generation")


def shortest_path(spark, d):
    path = graph.shortest_path(_edges(spark, d), 9, 14)
    return spark.createDataFrame(list(enumerate(path)), "step int, node long")


def kinship_label(spark, d):
    t = _tree(spark, d)
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    up = graph.closure(t, people)
    home = up.filter("start = 20").select("node", F.col("generation").alias("hg"))
    both = up.join(home, "node").groupBy("start").agg(F.min_by(F.struct("hg", "generation"), F.struct(F.col("hg") + F.col("generation"), F.col("node"))).alias("m"))
    h, t_ = F.col("m.hg"), F.col("m.generation")
    label = (
        F.when((h == 0) & (t_ == 0), "self").when(t_ == 0, F.concat(F.lit("ancestor "), h.cast("string"))).when(h == 0, F.concat(F.lit("descendant "), t_.cast("string")))
        .when((h == 1) & (t_ == 1), "sibling").when(h == 1, "nephew or niece").when(t_ == 1, "uncle or aunt")
        .otherwise(F.concat(F.lit("cousin "), (F.least(h, t_) - 1).cast("string"), F.lit(" removed "), F.abs(h - t_).cast("string")))
    )
    return both.select(F.col("start").alias("person"), label.alias("label"))


UP = "recursive up as (select c_custkey as start, c_custkey as node, 0 as generation from customer union all select start, node // 2, generation + 1 from up where node > 1)"
LABEL = f"""with {UP}, b as (select u.start, h.generation as hg, u.generation as tg from up u join up h on u.node = h.node and h.start = 20),
m as (select *, row_number() over (partition by start order by hg + tg) as k from b)
select start as person, case when hg = 0 and tg = 0 then 'self' when tg = 0 then 'ancestor ' || hg when hg = 0 then 'descendant ' || tg when hg = 1 and tg = 1 then 'sibling' when hg = 1 then 'nephew or niece'
  when tg = 1 then 'uncle or aunt' else 'cousin ' || (least(hg, tg) - 1) || ' removed ' || abs(hg - tg) end as label from m where k = 1"""


def pedigree_loops(spark, d):
    li = table(spark, d, "lineitem")
    e = li.select((F.col("l_partkey") % 40).alias("src"), (F.col("l_suppkey") % 40).alias("dst")).filter("src < dst or (src = 7 and dst = 3)").filter("src != dst")
    return graph.cycle_members(e.distinct())


def living_reason(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.count_if(F.col("o_orderstatus") == "P").alias("declared"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    reason = (
        F.when(F.col("declared") > 0, "declared").when(F.col("last") < F.to_timestamp(F.lit("1999-01-01")), "deceased")
        .when(F.col("last") >= F.to_timestamp(F.lit("2000-01-01")), "recent").when(F.col("last").isNotNull(), "birth").otherwise("unknown")
    )
    return c.select("c_custkey", reason.alias("reason"))


def redact(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    clean = redact_text(F.col("text"))
    return t.filter(clean != F.col("text")).select("doc_id", F.sha2(clean, 256).alias("redacted"))


def link_keys(spark, d):
    k = F.col("page_id")
    n = k.cast("string")
    # beside the pages' own addresses those of sites with rules of their own
    url = (
        F.when(k % 6 == 1, F.concat(F.lit("http://Data.Matricula-Online.eu/sl/slovenia/"), n, F.lit("//")))
        .when(k % 6 == 2, F.concat(F.lit("https://familysearch.org/ark:/61903/1:1:AB"), n, F.lit("?view=explore&cat="), n, F.lit("&lang=en")))
        .when(k % 6 == 3, F.concat(F.lit("https://youtu.be/aB"), n))
        .when(k % 6 == 4, F.concat(F.lit(" https://www.geneanet.org/cimetieres/view/"), n, F.lit("/")))
        .otherwise(F.col("url"))
    )
    return table(spark, d, "pages").select("page_id", link_key(url).alias("key"))


LINK_KEY = """select page_id, case page_id % 6 when 1 then 'https://data.matricula-online.eu/xx/slovenia/' || page_id when 2 then 'https://www.familysearch.org/ark:/61903/1:1:ab' || page_id || '?cat=' || page_id
    when 3 then 'https://youtu.be/ab' || page_id || '#id=aB' || page_id when 4 then 'https://xx.geneanet.org/cemetery/view/' || page_id
    else regexp_replace(regexp_replace(lower(trim(url)), '^http://', 'https://'), '/+$', '') end as key from pages"""


def titles(spark, d):
    return table(spark, d, "pages").select("page_id", page_title(F.col("html")).alias("title"))


def normalize_report(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    shaped = words.withColumn("to", F.initcap("word"))
    return shaped.filter("word != to").groupBy(F.col("word").alias("from"), "to").agg(F.count("*").alias("n"))


def importable_counts(spark, d):
    t = _tree(spark, d)
    matched = table(spark, d, "customer").filter("c_custkey % 7 = 0")
    up = graph.closure(t, matched.select(F.col("c_custkey").alias("node")))
    free = up.join(matched.select(F.col("c_custkey").alias("node")), "node", "left_anti")
    return free.groupBy("start").agg(F.count("*").alias("ancestors"))


CUST_UP = "recursive up as (select c_custkey as start, c_custkey as node, 0 as generation from customer where {w} union all select start, node // 2, generation + 1 from up where node > 1)"

QUERIES = {
    "validate_records": (validate_records, VALIDATE),
    "validate_structure": (validate_structure, STRUCTURE),
    "issue_counts": (issue_counts, f"select rule, severity, count(*) as subjects from ({VALIDATE}) as v group by 1, 2"),
    "dangling_refs": (dangling_refs, "select distinct l_orderkey as ref from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 13 <> 0)"),
    "branch_export": (branch, """with c as (select c_custkey as id from customer where c_nationkey = 3) select cast(o_orderdate as date) as family, count(distinct o_custkey) as members from orders where o_custkey in (select id from c) group by 1 having count(distinct o_custkey) >= 2"""),
    "bfs_distance": (bfs_distance, """with recursive t as (select c_custkey as child, c_custkey // 2 as parent from customer where c_custkey > 1), e as (select child as src, parent as dst from t union all select parent, child from t),
        b as (select 5::bigint as node, 0 as distance union select e.dst, b.distance + 1 from b join e on e.src = b.node where b.distance < 30) select node, min(distance) as distance from b group by 1"""),
    "kinship_sets": (kinship_sets, f"with {CUST_UP.format(w='true')} select start, node, generation from up"),
    "descendants": (descendants, "with recursive d as (select 3::bigint as node, 0 as generation union all select c_custkey, generation + 1 from d join customer on c_custkey // 2 = node and c_custkey > 1) select node, generation from d"),
    "branch_ids": (branch_ids, "with recursive d as (select 2::bigint as node, 0 as generation union all select c_custkey, generation + 1 from d join customer on c_custkey // 2 = node and c_custkey > 1 where generation < 4) select node, generation from d"),
    "ahnentafel": (ahnentafel, "select c_custkey as number, c_custkey as node, cast(floor(log2(c_custkey)) as int) as generation from customer where c_custkey >= 1"),
    "shortest_path": (shortest_path, """with recursive u as (select 9::bigint as n, 0 as g union all select n // 2, g + 1 from u where n > 1), v as (select 14::bigint as n, 0 as g union all select n // 2, g + 1 from v where n > 1),
        top as (select u.g as ug, v.g as vg from u join v using (n) order by u.g + v.g limit 1) select cast(g as int) as step, n as node from u, top where g <= ug union all select cast(ug + vg - g as int), n from v, top where g < vg"""),
    "kinship_label": (kinship_label, LABEL),
    "pedigree_loops": (pedigree_loops, None),
    "living_reason": (living_reason, """with o as (select o_custkey, max(o_orderdate) as last, count(*) filter (o_orderstatus = 'P') as declared from orders group by 1)
        select c_custkey, case when declared > 0 then 'declared' when last < timestamp '1999-01-01' then 'deceased' when last >= timestamp '2000-01-01' then 'recent' when last is not null then 'birth' else 'unknown' end as reason from customer left join o on c_custkey = o_custkey"""),
    "redact": (redact, """with r as (select doc_id, text, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[mail]', 'g'), '\\b[0-9]{1,3}(\\.[0-9]{1,3}){3}\\b', '[ip]', 'g') as t from documents where text is not null)
        select doc_id, sha256(t) as redacted from r where t <> text"""),
    "link_key": (link_keys, LINK_KEY),
    "page_title": (titles, "select page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')), '') as title from pages"),
    "normalize_report": (normalize_report, "with w as (select unnest(string_split(p_name, ' ')) as word from part), s as (select word, upper(left(word, 1)) || lower(substr(word, 2)) as t from w) select word as \"from\", t as \"to\", count(*) as n from s where word <> t group by 1, 2"),
    "importable_counts": (importable_counts, f"with {CUST_UP.format(w='c_custkey % 7 = 0')} select start, count(*) as ancestors from up where node % 7 <> 0 group by 1"),
}
