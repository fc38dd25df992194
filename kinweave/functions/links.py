"""Links and pages: comparable keys and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Cemetery pages of one site by language, as host and the word in the path.
CEMETERIES = (
    ("en.geneanet.org", "cemetery"),
    ("de.geneanet.org", "friedhof"),
    ("es.geneanet.org", "cementerio"),
    ("fi.geneanet.org", "siviilihautausmaa"),
    ("www.geneanet.org", "cimetieres"),
    ("it.geneanet.org", "cimitero"),
    ("nl.geneanet.org", "kerkhof"),
    ("no.geneanet.org", "gravlund"),
    ("pt.geneanet.org", "cemitério"),
    ("pt.geneanet.org", "cemit%c3%a9rio"),
    ("sv.geneanet.org", "kyrkogård"),
    ("sv.geneanet.org", "kyrkog%c3%a5rd"),
)
#: Addresses whose ids differ by case.
CASED = (
    r"(?:youtube\.com/watch\?(?:[^#]*&)?v=|youtu\.be/|books\.google\.[a-z.]+/books\?(?:[^#]*&)?id=|google\.[a-z.]+/books/edition/[^/?#]+/)([A-Za-z0-9_-]+)"
)
ARK = r"^(https?://)(?:www\.)?familysearch\.org/(?:[a-z]{2}/)?ark:/61903/([^?#\s]+).*$"
PARISH = r"^(https?://data\.matricula-online\.eu)/([a-z]{2})/"


def canonical_ark(url: Column) -> Column:
    """A FamilySearch page without the viewer's state; the film number stays."""
    film = F.regexp_extract(url, r"(?i)[?&]cat=(\d+)", 1)
    bare = F.regexp_replace(F.trim(url), "(?i)" + ARK, "$1www.familysearch.org/ark:/61903/$2")
    return F.when(F.trim(url).rlike("(?i)" + ARK), F.concat(bare, F.when(film != "", F.concat(F.lit("?cat="), film)).otherwise(""))).otherwise(url)


def parish_lang(url: Column) -> Column:
    """The language code in a parish register's address, or null."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), "(?i)" + PARISH, 2)), F.lit(""))


def with_parish_lang(url: Column, lang: str) -> Column:
    return F.regexp_replace(url, "(?i)" + PARISH, f"$1/{lang}/")


def link_key(url: Column) -> Column:
    """One key for the addresses of one page: case, http or https, closing slashes, languages of the
    sites above and a viewer's state do not count; the query does, and so do ids that differ by case."""
    key = F.regexp_replace(canonical_ark(F.lower(F.trim(url))), "^http://", "https://")
    key = F.regexp_replace(F.regexp_replace(key, "/+$", ""), PARISH, "$1/xx/")
    for host, word in CEMETERIES:
        key = F.regexp_replace(key, f"^https://{host.replace('.', '[.]')}/{word}(/view/.*)$", "https://xx.geneanet.org/cemetery$1")
    own = F.regexp_extract(F.trim(url), CASED, 1)
    return F.when(own != "", F.concat(key, F.lit("#id="), own)).otherwise(key)


def unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def page_title(html: Column) -> Column:
    """The title of a page, entities decoded, blanks squeezed; null without one."""
    title = F.trim(F.regexp_replace(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " "))
    return F.when(title != "", title)
