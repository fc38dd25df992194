"""URL filters: rules by host and path, spread over redirect and canonical-link equivalence.

The rule of a url is the longest one that fits its host (or a parent domain) and the start of its
path. Urls joined by a redirect or a canonical link are aliases; a url without a rule of its own is
blocked if an alias is blocked and none is allowed by a rule (explicit allow precedence).

Nodes are normalised urls: scheme and host in lower case, usual ports and fragments cut, an empty
path is ``/``. Targets have their entities decoded and are resolved against the page's url as RFC 3986
says, dot segments included.

Scale: rules meet distinct hosts in an equi-join on the host's suffixes, so the rule list may be long
(up to ``BROADCAST_RULES`` it is broadcast); pages meet the rules of their host by host, and the longest
is picked inside the row, so a hot host is split by the skew join and nothing is grouped by page. Edges
are extracted in the scan; only urls that have an edge enter the component search, whose levels are
written to the shared folder. Besides the rules, Spark broadcasts a table only if its own measure of it
is below ``spark.sql.autoBroadcastJoinThreshold``.

Defined edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and
is allowed unless an alias of the same text is blocked; null html gives no edges; repeated urls are one
node; edges to urls that are no page count as nodes all the same; links of other schemes (mailto) and
empty ones are none; extra columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.graph import connected_components
from kinweave.session import materialize, table

#: The rules of the contract, (verdict, rule).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: A rule list up to this length is broadcast.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _parts(url: str) -> tuple[str, str]:
    """SQL for a url's host and path."""
    rest = f"if(locate('://', {url}) > 0, substring({url}, locate('://', {url}) + 3), '')"
    bare = f"regexp_replace({rest}, '(?s)[?#].*$', '')"
    host = f"translate(substring_index({bare}, '/', 1), '{UPPER}', '{LOWER}')"
    path = f"substring({bare}, length(substring_index({bare}, '/', 1)) + 1)"
    return f"coalesce({host}, '')", f"coalesce({path}, '')"


def node_of(url: str) -> str:
    """SQL for a url's node."""
    bare = f"regexp_replace({url}, '(?s)#.*$', '')"
    scheme = f"lower(regexp_extract({bare}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    rest = f"regexp_extract({bare}, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://(.*)$', 1)"
    host = f"lower(regexp_extract({rest}, '^[^/?]*', 0))"
    tail = f"regexp_extract({rest}, '(?s)^[^/?]*(.*)$', 1)"
    port = f"regexp_replace({host}, if({scheme} = 'https', ':443$', if({scheme} = 'http', ':80$', '^$')), '')"
    path = f"case when {tail} = '' then '/' when startswith({tail}, '?') then concat('/', {tail}) else {tail} end"
    return f"if({scheme} = '', {bare}, concat({scheme}, '://', {port}, {path}))"


def _decoded(text: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "\\'"), ("&#39;", "\\'"), ("&#x27;", "\\'"), ("&#x2F;", "/"), ("&#47;", "/"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


def _attribute(tag: str, name: str) -> str:
    """SQL for an attribute's value, quoted either way or not at all."""
    found = f"""regexp_extract({tag}, '(?is)\\\\b{name}\\\\s*=\\\\s*("[^"]*"|\\'[^\\']*\\'|[^\\\\s>]+)', 1)"""
    return f"""trim(btrim({found}, '"\\''))"""


def _resolved(t: str, base: str) -> str:
    """SQL for a target as a url; empty if it is none."""
    site = f"regexp_extract({base}, '^([^:]*://[^/?#]*)', 1)"
    path = f"regexp_extract({base}, '^[^:]*://[^/?#]*([^?#]*)', 1)"
    folder = f"regexp_replace(if({path} = '', '/', {path}), '[^/]*$', '')"
    straight = f"""aggregate(split(regexp_extract(j, '^[^?#]*', 0), '/'), cast(array() as array<string>), (s, x) -> case
        when x = '..' then slice(s, 1, greatest(1, size(s) - 1)) when x = '.' then s else array_append(s, x) end)"""
    closing = "if(regexp_like(regexp_extract(j, '^[^?#]*', 0), '/[.]{1,2}$'), '/', '')"
    joined = f"""transform(array(if(startswith({t}, '/'), {t}, concat({folder}, {t}))), j -> concat({site}, array_join({straight}, '/'), {closing}, regexp_extract(j, '(?s)^[^?#]*(.*)$', 1)))[0]"""
    return f"""case when {t} = '' or startswith({t}, '#') then '' when regexp_like({t}, '^[A-Za-z][A-Za-z0-9+.-]*://') then {t}
        when regexp_like({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') or {site} = '' then '' when startswith({t}, '//') then concat(substring_index({base}, '://', 1), ':', {t})
        when startswith({t}, '?') then concat({site}, {path}, {t}) else {joined} end"""


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): a page's url and the resolved targets of its canonical links and refresh redirects."""
    h = f"coalesce(`{html_col}`, '')"
    tags = f"concat(regexp_extract_all({h}, '(?is)<link\\\\b[^>]*>', 0), regexp_extract_all({h}, '(?is)<meta\\\\b[^>]*>', 0))"
    refresh = f"""trim(btrim(regexp_extract({_attribute("tag", "content")}, '(?is)^[^;,]*[;,]\\\\s*(?:url\\\\s*=)?\\\\s*(.*)$', 1), '"\\''))"""
    target = f"""case when startswith(lower(tag), '<link') and array_contains(split(lower({_attribute("tag", "rel")}), '\\\\s+'), 'canonical') then {_attribute("tag", "href")}
        when startswith(lower(tag), '<meta') and lower({_attribute("tag", "http-equiv")}) = 'refresh' then {refresh} else '' end"""
    found = (
        pages.filter(F.col(url_col).isNotNull())
        .select(F.col(url_col).alias("src"), F.explode(F.expr(tags)).alias("tag"))
        .select("src", F.expr(target).alias("t"))
        .filter("t != ''")
        .select("src", F.expr(f"trim({_decoded('t')})").alias("t"))
    )
    return found.select("src", F.expr(_resolved("t", "src")).alias("dst")).filter("dst != ''").distinct()


def _with_rules(urls: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``urls`` with __u_host, __u_path, the longest fitting __u_rule and its verdict __u_own."""
    host, path = _parts(f"`{url}`")
    parts = urls.withColumns({"__u_host": F.expr(host), "__u_path": F.expr(path)})
    table_ = urls.sparkSession.createDataFrame(
        [(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for v, r in rules], "r_host string, r_path string, r_rule string, r_verdict string"
    )
    if len(rules) <= BROADCAST_RULES:
        table_ = F.broadcast(table_)
    suffixes = "transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, 1000), '.'))"
    hosts = parts.select(F.col("__u_host").alias("host")).filter("host != ''").distinct()
    fits = hosts.select("host", F.explode(F.expr(suffixes)).alias("r_host")).join(table_, "r_host")
    fits = fits.groupBy("host").agg(F.collect_list(F.struct(F.length("r_rule").alias("n"), "r_rule", "r_path", "r_verdict")).alias("__u_fits"))
    out = parts.join(fits, F.col("__u_host") == F.col("host"), "left").drop("host")
    out = out.withColumn("__u_best", F.expr("array_max(filter(__u_fits, f -> startswith(__u_path, f.r_path)))")).drop("__u_fits")
    return out.withColumns({"__u_rule": F.col("__u_best.r_rule"), "__u_own": F.col("__u_best.r_verdict")}).drop("__u_best")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, edges: DataFrame | None = None, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, host, path, the rule that fits (null if none) and the verdict.

    ``edges`` (src, dst) adds redirects known from elsewhere, such as a crawl log.
    """
    rules = RULES if rules is None else rules
    own = pages.select(F.col(id_col).alias("__u_id"), F.col(url_col).alias("__u_url"), F.col(html_col).alias("__u_html"))
    links = page_edges(own, "__u_url", "__u_html")
    if edges is not None:
        links = links.unionByName(edges.select("src", "dst").filter("src is not null and dst is not null"))
    links = materialize(links)
    part = materialize(connected_components(links.select(F.expr(node_of("src")).alias("src"), F.expr(node_of("dst")).alias("dst"))))
    # every spelling of a node that is linked or stands for a page counts with its own rule
    ends = links.select(F.col("src").alias("url")).union(links.select("dst")).distinct().withColumn("__u_node", F.expr(node_of("url")))
    spellings = own.select(F.col("__u_url").alias("url")).filter("url is not null").withColumn("__u_node", F.expr(node_of("url")))
    spellings = spellings.join(part.select(F.col("node").alias("__u_node")), "__u_node", "left_semi").union(ends.select("__u_node", "url")).distinct()
    spread = (
        _with_rules(spellings, rules)
        .join(part, F.col("__u_node") == F.col("node"))
        .groupBy("component")
        .agg(F.max((F.col("__u_own") == "allow").cast("int")).alias("a"), F.max((F.col("__u_own") == "block").cast("int")).alias("b"))
        .filter("coalesce(a, 0) = 0 and b = 1")
    )
    alias = part.join(spread.select("component"), "component", "left_semi").select(F.col("node").alias("__u_alias"), F.lit("block").alias("__u_spread"))
    out = _with_rules(own.drop("__u_html"), rules, "__u_url").withColumn("__u_node", F.expr(node_of("__u_url")))
    out = out.join(materialize(alias), F.col("__u_node") == F.col("__u_alias"), "left")
    return out.select(
        F.col("__u_id").alias(id_col),
        F.col("__u_host").alias("host"),
        F.col("__u_path").alias("path"),
        F.col("__u_rule").alias("rule"),
        F.coalesce("__u_own", "__u_spread", F.lit("allow")).alias("verdict"),
    )


def op3(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def oracle(rules: list[tuple[str, str]] = RULES, pages: str = "pages") -> str:
    """DuckDB SQL of ``op3``: links that stand in ``href`` or a refresh, absolute or below the page's site or folder."""
    values = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in rules)
    node = """regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^:]*://[^/?#]*')), '^(https://[^:]*):443$', '\\1'), '^(http://[^:]*):80$', '\\1')
        || case when regexp_matches(u, '^[^:]*://[^/?#]*(\\?|#|$)') then '/' else '' end || regexp_replace(substr(u, length(regexp_extract(u, '^[^:]*://[^/?#]*')) + 1), '(?s)#.*$', '')"""
    return f"""
with recursive pg as (select page_id, url, coalesce(html, '') as html from {pages}),
tg as (select url, unnest(list_concat(regexp_extract_all(html, '(?i)<link\\b[^>]*>'), regexp_extract_all(html, '(?i)<meta\\b[^>]*>'))) as tag from pg where url is not null),
tt as (select url, replace(case when regexp_matches(tag, '(?i)^<link.*rel\\s*=\\s*["'']?canonical') then regexp_extract(tag, '(?i)href\\s*=\\s*["'']?([^"''\\s>]+)', 1)
    when regexp_matches(tag, '(?i)^<meta.*http-equiv\\s*=\\s*["'']?refresh') then regexp_extract(tag, '(?i)url\\s*=\\s*["'']?([^"''\\s>]+)', 1) else '' end, '&amp;', '&') as t from tg),
e as (select distinct url as src, case when contains(t, '://') then t when starts_with(t, '//') then split_part(url, '://', 1) || ':' || t
    when starts_with(t, '/') then regexp_extract(url, '^[^:]*://[^/?#]*') || t else regexp_replace(case when regexp_matches(url, '^[^:]*://[^/?#]+$') then url || '/' else url end, '[^/]*$', '') || t end as dst from tt
    where t <> '' and not starts_with(t, '#') and (contains(t, '://') or not regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:')) and contains(url, '://')),
us as (select url as u from pg where url is not null union select dst from e),
un as (select u, case when contains(u, '://') then {node} else u end as node from us),
ge as (select a.node as x, b.node as y from e join un a on a.u = src join un b on b.u = dst union select b.node, a.node from e join un a on a.u = src join un b on b.u = dst),
reach as (select x, x as y from ge union select r.x, g.y from reach r join ge g on g.x = r.y),
u as (select u as url, case when position('://' in u) > 0 then regexp_replace(substr(u, position('://' in u) + 3), '(?s)[?#].*$', '') else '' end as bare from us),
h as (select url, coalesce(translate(split_part(bare, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
             coalesce(substr(bare, length(split_part(bare, '/', 1)) + 1), '') as path from u),
r as (select * from (values {values}) as t(v, rule, rh, rp)),
m as (select h.url, h.host, h.path, r.rule, r.v, row_number() over (partition by h.url order by length(r.rule) desc, r.rule desc) as k
      from h left join r on (h.host = r.rh or ends_with(h.host, '.' || r.rh)) and starts_with(h.path, r.rp)),
own as (select url, node, host, path, rule, v from m join un on un.u = url where k = 1),
bad as (select reach.x as node from reach join own on own.node = reach.y group by 1 having bool_or(coalesce(v = 'block', false)) and not bool_or(coalesce(v = 'allow', false)))
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(v, case when own.node in (select node from bad) then 'block' end, 'allow') as verdict
from pg left join own on own.url = pg.url"""


ORACLE = oracle()
