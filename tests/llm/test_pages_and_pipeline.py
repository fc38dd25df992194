"""URL filters and the pipeline."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
import __spark_entry__
from kinweave.llm import url_filters

PAGES = [
    (1, "https://a.example.net/en/x?q=1#top", None),
    (2, "http://WWW.Example.NET/de/", ""),
    (3, "https://example.com/de/seite", "<link rel='canonical' href='https://other.org/a'>"),
    (4, "https://other.org/a", None),
    (5, "https://other.org/b", '<META http-equiv="refresh" content="0; url=https://other.org/a">'),
    (6, "https://safe.org/fr/1", '<link href="/plain" rel="canonical">'),
    (7, "https://safe.org/plain", '<link rel="canonical" href="https://bad.net/">'),
    (8, "no scheme", None),
    (9, None, "<link rel=canonical href=https://bad.net/>"),
    (10, "https://a.net", None),
    (11, "https://other.org/a", None),
    (12, "https://xexample.com/de/", None),
    # targets with entities, in the page's folder, on the site, of the page's scheme; nodes that differ by case, port and fragment
    (20, "https://blog.org/d/e?x=1", '<link rel="canonical" href="f?a=1&amp;b=2">'),
    (21, "https://blog.org/d/f?a=1&b=2#part", '<link rel="canonical" href="//EXAMPLE.com/de/z">'),
    (22, "https://Shop.org:443", "<link href='https://b.net/1' rel='canonical'>"),
    (23, "https://shop.org/#top", None),
    (24, "https://shop.org/?q", "<link rel='canonical' href='#top'><link rel='canonical' href='mailto:x@b.net'><link rel='stylesheet' href='https://b.net/css'>"),
    (25, "HTTPS://one.org/a", '<meta http-equiv="Refresh" content="5;URL=https://two.org/A">'),
    (26, "https://two.org/A", '<link rel="canonical" href="https://c.net/">'),
    (27, "https://two.org/a", None),
]
#: Dot segments, several words in rel, entities of the other kind: beyond the oracle's simpler reading.
MORE = [
    (40, "https://deep.org/x/y/z", '<link rel="alternate canonical" href="../../up/./page">'),
    (41, "https://deep.org/up/page", '<link rel="canonical" href="https&#x3a;//kept.example">'),
    (42, "https://deep.org/up/gone", '<link rel="canonical" href="?v=2">'),
    (43, "https://deep.org/up/gone?v=2", '<link rel="canonical" href="https:&#x2F;&#47;d.net/">'),
    (44, "https://deep.org/up/page?", '<link rel="canonical" href="  https://deep.org/x/y/z  ">'),
    (45, "https://deep.org/up/sub/", '<link rel="canonical" href="..">'),
    (46, "https://deep.org/up/", '<link rel="canonical" href="/../../%41">'),
    (47, "https://deep.org/%41", '<META HTTP-EQUIV=refresh CONTENT="0, https://d.net/">'),
]


def test_url_filters(spark):
    df = spark.createDataFrame([(*p, "host", "rule") for p in PAGES], "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in url_filters.judge_urls(df).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("www.example.net", "/de/", "net/", "block"),
        3: ("example.com", "/de/seite", "example.com/de/", "block"),
        4: ("other.org", "/a", None, "block"),
        5: ("other.org", "/b", None, "block"),
        6: ("safe.org", "/fr/1", "org/fr/", "allow"),
        7: ("safe.org", "/plain", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("a.net", "", None, "allow"),
        11: ("other.org", "/a", None, "block"),
        12: ("xexample.com", "/de/", None, "allow"),
        20: ("blog.org", "/d/e", None, "block"),
        21: ("blog.org", "/d/f", None, "block"),
        22: ("shop.org:443", "", None, "block"),
        23: ("shop.org", "/", None, "block"),
        24: ("shop.org", "/", None, "allow"),
        25: ("one.org", "/a", None, "block"),
        26: ("two.org", "/A", None, "block"),
        27: ("two.org", "/a", None, "allow"),
    }
    duck = pytest.importorskip("duckdb").connect()
    duck.execute("create table pages (page_id bigint, url varchar, html varchar)")
    duck.executemany("insert into pages values (?, ?, ?)", PAGES)
    assert {r[0]: r[1:] for r in duck.execute(url_filters.ORACLE).fetchall()} == got
    more = spark.createDataFrame(MORE, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filters.judge_urls(more).collect()} == {40: "allow", 41: "allow", 42: "block", 43: "block", 44: "allow", 45: "block", 46: "block", 47: "block"}
    assert url_filters.judge_urls(df.limit(0)).count() == 0
    crawl = spark.createDataFrame([("https://xexample.com/de/", "https://b.net/")], "src string, dst string")
    assert {r.page_id: r.verdict for r in url_filters.judge_urls(df, edges=crawl).collect()}[12] == "block"


def test_pipeline_stages(spark, tmp_path):
    lines = lambda i: "\n".join(f"A{i}{j} sentence{i}{j} of plain{i}{j} words numbered{i}{j} nobody{i}{j} wrote." for j in range(12))
    good = [(i, lines(i), "en", "s", 0) for i in range(1, 9)]
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [
        *good,
        (20, good[0][1] + "\nextra words", "en", "s", 0),  # near copy of 1, once its lines are gone nothing is left of it
        (21, good[1][1] + "\n" + item, "en", "s", 0),  # the item's line stays here, where it stands first, and goes from 22
        (22, lines(22) + "\n" + item, "en", "s", 0),
        (23, "too short", "en", "s", 0),
        (24, None, None, None, None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("i1", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "decontamination", "bpe"]
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert left[0] == left[1] == {*range(1, 9), 20, 21, 22}
    assert set(range(1, 9)) <= left[2] and left[3] >= {*range(1, 9), 22} and 21 not in left[3]
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) == left[3]
    assert all(r.n_tokens == len(r.ids) and len(r.ids_sha256) == len(hashlib.sha256().hexdigest()) for r in final.values())


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
