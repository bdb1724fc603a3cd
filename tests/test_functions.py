"""Column functions, trees and feeds on small cases with hand-derived results."""

import pytest
from pyspark.sql import functions as F

from weft.functions import dom, html, locale, similarity, text, urls
from weft.operators import branding, expansion, graph, ranking, ranks, records, templates, vectors
from weft.operators.extract import extract
from weft.sources import feeds
from weft.streaming import events


def value(spark, make, *args):
    names = [f"c{i}" for i in range(len(args))]
    row = spark.createDataFrame([tuple(args)], ", ".join(f"{n} {'string' if isinstance(a, (str, type(None))) else 'array<string>' if isinstance(a, list) and (not a or isinstance(a[0], str)) else 'array<double>' if isinstance(a, list) else 'bigint'}" for n, a in zip(names, args)))
    return row.select(make(*(F.col(n) for n in names)).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://EXAMPLE.com/path", "https://example.com/path"), ("https://example.com:443/a", "https://example.com/a"), ("http://example.com:80/a", "http://example.com/a"), ("https://example.com:8443/a", "https://example.com:8443/a"),
        ("https://example.com/path/", "https://example.com/path"), ("https://example.com/", "https://example.com/"), ("https://example.com", "https://example.com/"), ("https://example.com/?b=2&a=1", "https://example.com/?a=1&b=2"),
        ("https://example.com/?z=1&tag=a&tag=b&a=2", "https://example.com/?a=2&tag=a&tag=b&z=1"), ("https://example.com/?tag=z&tag=a&tag=m", "https://example.com/?tag=z&tag=a&tag=m"), ("https://example.com/a#top", "https://example.com/a"), ("not-a-url", None), (None, None),
    ],
)
def test_normalize(spark, url, want):
    assert value(spark, urls.normalize, url) == want


def test_url_scalars(spark):
    assert value(spark, urls.normalize_for_dedup, "http://www.Example.com/a/?b=&c=2&c=3&a=1#x") == "http://example.com/a?a=1&c=2#x"
    assert value(spark, urls.depth, "https://a.b/x//y/") == 2 and value(spark, urls.is_file, "https://a.b/x.PDF") is True
    assert value(spark, urls.is_subdomain, "https://x.a.b/", "https://a.b") is True and value(spark, urls.is_subdomain, "https://xa.b/", "https://a.b") is False
    assert value(spark, urls.path_pattern, "https://a.b/x/y/z") == "/x/y/..." and value(spark, urls.bare_domain, "https://www.A.b/x?y") == "a.b"
    for href, want in (("/x", "https://a.b/x"), ("x", "https://a.b/d/x"), ("../x", "https://a.b/x"), ("//c.d/x", "https://c.d/x"), ("http://e.f", "http://e.f"), ("?q=1", "https://a.b/d/p?q=1")):
        assert value(spark, urls.resolve, href, "https://a.b/d/p") == want
    assert value(spark, urls.humanize, "https://a.b/docs/getting-started.html") == "Getting started" and value(spark, urls.humanize, "https://a.b/") == "Home"


def test_text_scalars(spark):
    assert [value(spark, text.syllables, w) for w in ("the", "table", "syllable", "queue", "rhythms")] == [1, 1, 2, 1, 1]
    assert [value(spark, text.stem, w) for w in ("cities", "running", "boxes", "is")] == ["city", "runn", "boxe", "is"]
    assert value(spark, text.clean_lines, "a  b \r\n\r\n\r\n\r\n c ") == "a b\n\nc"
    assert value(spark, lambda x: text.sentiment(x)["label"], "good great day") == "positive"
    assert [tuple(e) for e in value(spark, text.emotions, "happy happy angry")] == [("joy", 1.0), ("anger", 1.0)]
    assert value(spark, lambda x: text.language(x)["language"], "the cat is in the house") == "en" and value(spark, lambda x: text.language(x)["language"], "xyz") is None
    assert value(spark, text.script, "日本のテキスト") == "chinese" and value(spark, text.script, "שלום") == "hebrew"
    v = text.vocabulary
    assert value(spark, lambda x: v(x)["unique_words"], "one two two three") == 3 and value(spark, lambda x: v(x)["diversity"], "one two two three") == 0.67


def test_similarity(spark):
    assert value(spark, similarity.jaccard, ["a", "b"], ["b", "c"]) == pytest.approx(1 / 3) and value(spark, similarity.jaccard, [], []) == 1.0
    assert value(spark, similarity.cosine, [1.0, 0.0], [1.0, 1.0]) == pytest.approx(0.70710678) and value(spark, similarity.cosine, [0.0], [1.0]) == 0.0
    with pytest.raises(Exception, match="differ in length"):
        value(spark, similarity.cosine, [1.0], [1.0, 2.0])
    assert value(spark, similarity.edit_similarity, "kitten", "sitting") == pytest.approx(1 - 3 / 7)

    def fnv(s, h):
        for c in s:
            h = (h ^ ord(c)) * 0x01000193 % 2**32
        return h

    assert value(spark, lambda s: similarity.fnv1a32(s, 0x811C9DC5), "héllo") == fnv("héllo", 0x811C9DC5)
    tokens = "a b b c".split()
    want = 0
    for bit in range(64):
        s = sum(1 if (fnv(t, 0x811C9DC5) >> bit if bit < 32 else fnv(t, 0x84222325) >> (bit - 32)) & 1 else -1 for t in tokens)
        want |= (s > 0) << bit
    assert value(spark, similarity.simhash64, "a b b c") % 2**64 == want


PAGE = """<html lang="EN"><head><meta charset="utf-8"><meta property="og:title" content="OG &amp; co"><meta name="keywords" content="a, ,b"><title>T</title><link rel="canonical" href="/c">
<script type="application/ld+json">{"@type": "Article"}</script><script type="application/ld+json">broken</script><script>var x = "</p>";</script></head>
<body><nav><a href="/n">Nav</a></nav><!-- <a href="/no">no</a> --><article><h1>Head <b>one</b></h1><p>First &lt;p&gt;<p>Second <a href="http://x.y/">out</a></article>
<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table><ul><li>a<li>b</ul><img src="i.png" alt="pic"><a href="#x">skip</a><a href="javascript:1">skip</a></body></html>"""


def test_html_functions(spark):
    assert value(spark, html.title, PAGE) == "OG & co" and value(spark, html.language, PAGE) == "en" and value(spark, html.charset, PAGE) == "utf-8"
    assert value(spark, html.keywords, PAGE) == ["a", "b"] and value(spark, html.canonical, PAGE) == "/c" and value(spark, html.json_ld, PAGE) == ['{"@type": "Article"}']
    assert [a.href for a in value(spark, html.anchors, PAGE)] == ["/n", "http://x.y/"]
    assert value(spark, lambda h: html.prefixed_meta(h, "og:"), PAGE) == {"title": "OG & co"}
    assert "var x" not in value(spark, html.text, PAGE) and "Nav" not in value(spark, html.text, PAGE) and "First <p>" in value(spark, html.text, PAGE)
    assert [tuple(h) for h in value(spark, html.headings, PAGE)] == [(1, "Head one")]
    for c, want in (("#ABC", "#aabbcc"), ("#a1b2c3d4", "#a1b2c3"), ("rgb(255, 0,16)", "#ff0010"), ("blue-ish", None)):
        assert value(spark, html.color, c) == want
    assert value(spark, html.suspicious, "x' OR 1=1 ../") == ["sql", "traversal"]


def test_trees():
    root = dom.parse(PAGE)
    assert [dom.squeeze(n.text()) for n in dom.select(root, "article > p")] == ["First <p>", "Second out"]
    assert [n.text() for n in dom.select(root, "li")] == ["a", "b"] and len(dom.select(root, "tr td:first-child, h1")) == 3
    assert dom.scrape(root, {"a": "a[href*='x.y']@href", "none": ".zip", "many": "td", "bad": "!!"}) == {"a": "http://x.y/", "none": None, "many": ["1", "2", "3"], "bad": {"error": "selector: '!!'"}}
    assert dom.split_attribute('a[href*="@"]') == ('a[href*="@"]', None) and dom.split_attribute("img@src") == ("img", "src")
    assert dom.markdown(dom.parse("<h2>A</h2><p>b <em>c</em> <a href='/d'>d</a></p><ol><li>x</li><li>y<ul><li>z</li></ul></li></ol>")) == "## A\n\nb *c* [d](/d)\n\n1. x\n2. y\n  - z"
    assert "| 1 | 2 |" in dom.markdown(root) and dom.formatted_text(dom.parse("<h1>a</h1><li>b</li><img alt=c>")) == "A\n• b\n[Image: c]"
    item = dom.parse("<div itemscope itemtype=T><span itemprop=name>N</span><a itemprop=url href=/u>x</a><div itemprop=inner itemscope><meta itemprop=k content=v></div></div>")
    assert dom.microdata(item) == [{"type": "T", "properties": {"name": ["N"], "url": ["/u"], "inner": [{"type": "", "properties": {"k": ["v"]}}]}}]
    got = dom.structured(dom.parse("<p class=price>$ 12.50</p><h1>T</h1>"), {"properties": {"price": {"type": "number"}, "title": {"type": "string"}, "sku": {"type": "string"}}, "required": ["sku"]})
    assert got["data"] == {"price": 12.5, "title": "T", "sku": None} and got["errors"] == ["missing required field: sku"]
    assert dom.balanced_json('x ```json\n{"a": [1, {"b": 2}]} trailing }') == {"a": [1, {"b": 2}]} and dom.balanced_json("none {") is None
    assert dom.json_ld(root) == [{"@type": "Article"}]


def test_extract_keeps_every_page(spark):
    rows = extract(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string"), ("text", "markdown", "fields"), {"h": "h1"}).collect()
    assert [r.page_id for r in rows] == [1, 2, 3] and all(r.error is None for r in rows) and "Head" in rows[0].markdown
    with pytest.raises(ValueError):
        extract(spark.createDataFrame([(1, "")], "page_id long, html string"), ("pdf",))


def test_feeds(spark):
    files = spark.createDataFrame(
        [
            ("i", "<sitemapindex><sitemap><loc>s</loc></sitemap><sitemap><loc>r</loc></sitemap></sitemapindex>"),
            ("s", "<urlset><url><loc>https://A.b/x/</loc><lastmod>2024-01-02</lastmod><priority>0.9</priority></url><url><loc>https://a.b/y</loc></url></urlset>"),
            ("r", "<rss><item><link>https://c.d/1</link><pubDate>never</pubDate></item></rss>"),
        ],
        "url string, xml string",
    )
    entries = feeds.sitemap_closure(files, spark.createDataFrame([("i",)], "url string"))
    assert sorted(r.loc for r in entries.collect()) == ["https://a.b/x", "https://a.b/y", "https://c.d/1"]
    assert {r.loc for r in feeds.sitemap_filter(entries, priority=(0.6, 1.0)).collect()} == {"https://a.b/x"}
    assert {r.loc for r in feeds.sitemap_filter(entries, since="2024-06-01").collect()} == {"https://a.b/y", "https://c.d/1"}
    robots = spark.createDataFrame([("a.b", "User-agent: *\nDisallow: /p\nAllow: /p/open\nSitemap: https://a.b/m.xml\n\nUser-agent: bad\nDisallow: /")], "host string, body string")
    got = {r.url: r.allowed for r in feeds.allowed(spark.createDataFrame([("https://a.b/p/x",), ("https://a.b/p/open/y",), ("https://a.b/q",), ("https://z.z/p",)], "url string"), robots).collect()}
    assert got == {"https://a.b/p/x": False, "https://a.b/p/open/y": True, "https://a.b/q": True, "https://z.z/p": True}
    assert feeds.robots_sitemaps(robots).count() == 9


def test_ranking_is_finite_and_handles_empty_queries(spark):
    rows = spark.createDataFrame([(0, "Node guide", "a guide to node", "https://x.org/a"), (1, "Other", "nothing", "not a url"), (2, None, None, None)], "doc_id long, title string, snippet string, link string")
    for query in ("node guide", "C#"):
        got = ranking.rank_results(rows, query).orderBy("rank").collect()
        assert len(got) == 3 and all(0 <= r.bm25 <= 1 and r.final == r.final for r in got)
    assert sum(ranking.renormalised({"bm25": 1.0}).values()) == pytest.approx(1)


def test_graph_operators(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (3, 4, 1), (4, 5, 1), (5, 4, 1)], "src long, dst long, weight long")
    assert {r.node: r.component for r in graph.strong_components(e).collect()} == {1: 3, 2: 3, 3: 3, 4: 5, 5: 5}
    assert graph.shortest_path(e, 1, 5) == [1, 2, 3, 4, 5] and graph.shortest_path(e, 5, 1) is None
    assert sorted(r.path for r in graph.simple_cycles(e, 4).collect()) == [[1, 2, 3], [4, 5]]
    ranks = {r.node: r["rank"] for r in graph.pagerank(e).collect()}
    want = {n: 0.2 for n in range(1, 6)}
    for _ in range(100):
        want = {1: 0.03 + 0.85 * want[3] / 2, 2: 0.03 + 0.85 * want[1], 3: 0.03 + 0.85 * want[2], 4: 0.03 + 0.85 * (want[3] / 2 + want[5]), 5: 0.03 + 0.85 * want[4]}
    assert all(abs(ranks[n] - want[n]) < 2e-3 for n in want)


def replay(step, times, failed=()):
    state, out = {}, []
    for i, t in enumerate(times):
        state, made = step(state, t, {"failed": i in failed})
        out += [m["detail"] for m in made] or ["-"]
    return out


def test_state_machines():
    assert replay(events.throttle(100), [0, 50, 100, 150, 260]) == ["sent", "-", "sent", "-", "sent"]
    assert replay(events.rate_limit(2, 3), [0, 1, 2, 1001, 1002, 61000]) == ["allowed", "allowed", "limited", "allowed", "limited", "allowed"]
    assert replay(events.breaker(2, 0.9, 10, 1000, 100, 2), [0, 1, 2, 150, 160, 170], {0, 1}) == ["closed", "open", "rejected", "half_open", "closed", "closed"]
    assert replay(events.alert_buffer(100), [0, 10, 101, 150, 250]) == ["-", "-", "flushed 2", "-", "flushed 2"]


def test_streams_equal_a_replay(spark, tmp_path):
    data = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, ["error", "view"][i % 2], float(i)) for i in range(60)]
    df = spark.createDataFrame(data, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    out = events.run_available(events.stateful(events.read_events(spark, str(tmp_path / "e")), events.throttle(600_000), "user_id"), str(tmp_path))
    want = sum((["sent"] for u in range(3) for x in replay(events.throttle(600_000), [60_000.0 * i for i in range(u, 60, 3)]) if x == "sent"), [])
    assert out.count() == len(want)


def test_sentences_go_on_after_abbreviations(spark):
    assert value(spark, text.sentences_merged, "Dr. Smith met Mr. Jones. They use v2.0. today! Fine") == ["Dr. Smith met Mr. Jones.", "They use v2.0. today!", "Fine"]


def test_expansion():
    got = expansion.expand("fast guide", most=50)
    assert got[0] == "fast guide" and got[1:5] == ["quick guide", "rapid guide", "fast tutorial", "fast manual"] and "fast AND guide" in got and '"fast guide"~5' in got and len(set(got)) == len(got)
    assert expansion.expand("teh price", most=3)[2] == "the price" and len(expansion.expand("a b c")) <= 5
    with pytest.raises(ValueError):
        expansion.expand(" ")


def test_records(spark):
    jobs = spark.createDataFrame([("a", "COMPLETED", 1, [], 1), ("b", "PENDING", 1, ["a"], 2), ("c", "PENDING", 5, ["b"], 3), ("d", "PENDING", 9, [], 4)], "id string, status string, priority int, dependencies array<string>, created_at long")
    assert [r.id for r in records.ready(jobs).collect()] == ["d", "b"]
    snaps = records.store_snapshots(spark.createDataFrame([("u", 1000 * i, "x" * i, "t") for i in range(5)] + [("v", 9, None, "t")], "url string, timestamp long, content string, content_type string"))
    assert [r.timestamp for r in records.query_snapshots(snaps, url="u", start=1000, limit=2, offset=1).collect()] == [3000, 2000]
    assert records.retained(snaps, 5000, most=2).count() == 3 and records.retained(snaps, 5000, bytes_=0).count() == 0
    row = spark.range(1).select(*(records.backoff(F.lit(3), s).alias(s) for s in ("linear", "exponential", "fibonacci", "fixed")), records.retryable(F.lit("X"), F.lit(None).cast("int"), F.lit("a timeout b")).alias("r"), locale.country_of(F.lit("https://a.de/")).alias("c"), records.health(F.array(F.lit("healthy"), F.lit("warning"))).alias("h")).first()
    assert tuple(row) == (4000.0, 8000.0, 3000.0, 1000.0, True, "DE", "warning")


def test_branding_and_templates(spark):
    page = "<meta name='theme-color' content='#123'><style>:root{--main:#ABCDEF;--main:#000} a{color:#abcdef;font-family:'Open Sans', serif} b{color:rgb(1,2,3)}</style><article><h1>T</h1><p>a</p><p>b</p></article>"
    pages = spark.createDataFrame([(1, "https://x.y/", page), (2, "https://z.w/", None)], "page_id long, url string, html string")
    assert [(r.color, r.n, r.source) for r in branding.colors(pages).orderBy("rank").collect()] == [("#abcdef", 2, "css-var"), ("#000000", 1, "css-var"), ("#112233", 1, "theme-color"), ("#010203", 1, "declaration")]
    assert [r.font for r in branding.fonts(pages).collect()] == ["Open Sans"] and [(r.name, r.value) for r in branding.variables(pages).collect()] == [("--main", "#ABCDEF")]
    templates.register("site", ("x.y",), {"title": "h1", "parts": "p"})
    got = templates.run(pages, "site").collect()
    assert len(got) == 1 and got[0].fields == '{"title": "T", "parts": ["a", "b"]}'
    with pytest.raises(ValueError):
        templates.run(pages, "none")


def test_ranks_over_ranges(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"), (F.col("id") % 3).alias("y"))
    got = ranks.with_rank(df, [F.col("y").desc(), F.col("x")], partitions=7).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501)) and [(r.y, r.x) for r in got] == sorted(((r.y, r.x) for r in got), key=lambda t: (-t[0], t[1]))


def test_nearest_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)] + [(99, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    a = vectors.nearest(df, F.col("vec_id") % 10 == 0, 3).collect()
    b = vectors.nearest(df, F.col("vec_id") % 10 == 0, 3, chunk=7, block_bytes=600).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 12
