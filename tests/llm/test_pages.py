"""Archives and url verdicts."""

import base64
import hashlib
import os

from loomdex.llm.common import new_folder
from loomdex.llm.components import connected_components
from loomdex.llm.url_filter import judge_urls, unescaped
from loomdex.llm.warc import WarcSettings, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, sha string, step string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


PAGES = [
    (5, "http://a.example/x", "<p>one</p>"), (2, "http://b.example/y z\r\n", "<p>one</p>"), (9, None, None), (3, "", ""),
    (7, "http://c.example/é", "long " * 30_000), (None, "http://d.example/", "<p>one</p>"), (None, "http://e.example/", "alone"),
    (5, "http://a.example/x", "<p>one</p>"), (11, "http://f.example/", "WARC/1.1\r\n\r\n\r\n"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def archive(spark, settings, parts):
    folder = new_folder(spark, "test-warc")
    manifest = write_warc(pages_of(spark, PAGES).repartition(parts), folder, settings)
    return folder, sorted((r["file"], r["sha1"]) for r in manifest.collect())


def test_round_trip(spark):
    folder, files = archive(spark, WarcSettings(shard_bytes=100, file_bytes=300), 4)
    assert len(files) > 3
    got = sorted(((r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r["payload"] and bytes(r["payload"]).decode()) for r in read_warc(spark, folder).collect()), key=repr)
    owner = {"<p>one</p>": 5, "": 9}
    expected = []
    for key, _, html in PAGES:
        body = html or ""
        other = owner.get(body, key)
        revisit = other != key
        expected.append((key, "revisit" if revisit else "response", len(body.encode()), digest(html), other if revisit else None, None if revisit else body))
    # An empty payload reads back as no bytes.
    assert [(*g[:5], g[5] or None) for g in got] == sorted([(*e[:5], e[5] or None) for e in expected], key=repr)


def test_same_bytes_whatever_the_partitions(spark):
    settings = WarcSettings(shard_bytes=200, file_bytes=500)
    assert archive(spark, settings, 1)[1] == archive(spark, settings, 5)[1]


def test_outlying_and_missing_ids_spread_over_shards(spark):
    """Ids 1..400 beside two far ones, and rows without id, of 1000 bytes each."""
    ids = [*range(1, 401), 10**18, -(2**63), *[None] * 300]
    rows = [(key, f"http://a.example/{n}", f"{n % 650:04d}" * 250) for n, key in enumerate(ids)]
    folder = new_folder(spark, "test-warc")
    settings = WarcSettings(shard_bytes=20_000)
    manifest = write_warc(pages_of(spark, rows).repartition(4), folder, settings).collect()
    shards = {}
    for r in manifest:
        shards[r["shard"]] = shards.get(r["shard"], 0) + r["records"]
    assert sum(shards.values()) == len(rows) and len(shards) >= 30
    # 20 payloads fill a shard; those without id are dealt by hash, so some shards have more.
    assert max(shards.values()) < 50
    owner = {}
    for key, _, html in rows:
        owner[html] = max(owner.get(html) or key, key, key=lambda k: -(2**64) if k is None else k)
    expected = []
    for key, _, html in rows:
        revisit = owner[html] is not None and owner[html] != key
        expected.append((key, "revisit" if revisit else "response", digest(html), owner[html] if revisit else None))
    got = [(r["page_id"], r["record_type"], r["payload_digest"], r["refers_to"]) for r in read_warc(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_files_outside_the_manifest_are_not_read(spark):
    folder, files = archive(spark, WarcSettings(), 2)
    with open(os.path.join(folder.removeprefix("file:"), "part-000099-00000.warc.gz"), "wb") as file:
        file.write(b"of a lost attempt")
    assert read_warc(spark, folder).count() == len(PAGES)
    empty = new_folder(spark, "test-warc")
    write_warc(pages_of(spark, []), empty)
    assert read_warc(spark, empty).count() == 0


def test_urls(spark):
    def link(href):
        return f'<html><head><link href="{href}" rel="canonical"></head></html>'

    rows = [
        (1, "http://x.net/a", None), (2, "https://EXAMPLE.net/en/1", "x"), (3, "http://a.example.com/de/", ""), (4, "http://q.org/fr/x", ""),
        (5, None, link("http://x.net/a")), (6, "no scheme", ""), (7, "http://x.net", ""), (8, "http://x.net?q=/", ""),
        # Aliases: 10 -> 11 (relative) -> a blocked address without a row.
        (10, "http://a.com/p", link("/q#f")), (11, "https://a.com/q", '<META content="0; URL=http://spam.net/z" http-equiv=refresh>'), (12, "http://a.com/q?x", ""),
        # A component with an explicitly allowed address is allowed, ruled addresses keep their own verdict.
        (20, "http://b.com/p", link("http://y.net/1")), (21, "http://y.net/1", link("http://z.org/fr/")), (22, "http://z.org/fr/", ""),
        (30, "http://c.com/", link("http://[bad")), (31, "http://c.com", ""), (10, "http://a.com/p", None),
    ]
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages_of(spark, rows)).collect()}
    assert got == {
        (1, "x.net", "/a", "net/", "block"), (2, "example.net", "/en/1", "example.net/en/", "allow"), (3, "a.example.com", "/de/", "example.com/de/", "block"),
        (4, "q.org", "/fr/x", "org/fr/", "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "x.net", "", None, "allow"), (8, "x.net", "", None, "allow"),
        (10, "a.com", "/p", None, "block"), (11, "a.com", "/q", None, "block"), (12, "a.com", "/q", None, "allow"),
        (20, "b.com", "/p", None, "allow"), (21, "y.net", "/1", "net/", "block"), (22, "z.org", "/fr/", "org/fr/", "allow"),
        (30, "c.com", "/", None, "allow"), (31, "c.com", "", None, "allow"),
    }
    assert judge_urls(pages_of(spark, [])).count() == 0


def test_tokens_of_rel_and_entities_in_targets(spark):
    def page(tag):
        return f"<html><head>{tag}</head></html>"

    # Every page names a blocked address, or one that leads there; 9 to 11 do not name it as canonical.
    rows = [
        (1, "http://a.com/1", page('<link rel="shortlink canonical" href="http://spam.net/1">')),
        (2, "http://a.com/2", page("<link href='http://spam.net/2' rel='canonical\tshortlink'>")),
        (3, "http://a.com/3", page("<link href=http://spam.net/3 rel=canonical>")),
        (4, "http://a.com/4", page('<link rel="canonical" href="/t?a=1&amp;b=2">')),
        (5, "http://a.com/t?a=1&b=2", page('<meta http-equiv="refresh" content="0; url=http://spam.net/?x&#x3D;1&#38;y=2">')),
        (6, "http://a.com/6", page('<link rel="canonical" href="/t?a=1&copy=2&lang;=3">')),
        (7, "http://a.com/t?a=1&copy=2\u27e8=3", page('<link rel="canonical" href="http://spam.net/7">')),
        (9, "http://a.com/9", page('<link rel="canonical-like" href="http://spam.net/9">')),
        (10, "http://a.com/10", page('<link data-rel="canonical" href="http://spam.net/10">')),
        (11, "http://a.com/11", page('<link rel="alternate" title="canonical" href="http://spam.net/11">')),
    ]
    got = {r["page_id"]: r["verdict"] for r in judge_urls(pages_of(spark, rows)).collect()}
    assert got == {k: "block" for k in range(1, 8)} | {k: "allow" for k in (9, 10, 11)}


def test_unescaped():
    assert unescaped("?a=1&amp;b=2&lt;&copy=3&copyx&reg&#65;&#x42&amp;amp;&nosuch;&") == "?a=1&b=2<&copy=3&copyx®AB&amp;&nosuch;&"


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(200, 260)]
    edges = [*chain, *star, (300, 300), (200, 200), (5, None), (None, 6), (260, 7), (260, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = dict(tuple(r) for r in connected_components(df, limit=10).collect())
    expected = {k: 100 for k in range(100, 161)} | {k: 7 for k in range(200, 261)} | {7: 7, 300: 300}
    assert got == expected
