"""Rules, changes, entities, result lists, graph helpers: against small cases and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import entities, rules, similarity, text
from weft.operators import changes, dedup, fingerprints, graph, metrics, monitors, summary


def value(spark, make, *args):
    df = spark.createDataFrame([args], [f"c{i}" for i in range(len(args))])
    return df.select(make(*(F.col(c) for c in df.columns)).alias("x")).first()["x"]


def test_sums_over_text_equal_sums_over_words(spark):
    rng = random.Random(3)
    parts = ["a", "the", "Table", "free", "rhythm", "sky.", "42", "é", "queue", "be", "cake!", "eee", "x-y", "straße", "THE", "sees", "...", "one's"]
    data = [(" ".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) + rng.choice(["", " ", "\n", ". "]),) for _ in range(120)] + [("",), (" ",)]
    df = spark.createDataFrame(data, ["t"])
    t = F.col("t")
    word_sum = lambda f: F.aggregate(F.transform(text.words(t), f), F.lit(0), lambda a, x: a + x)
    rows = df.select("t", text.syllable_sum(t).alias("a"), word_sum(text.syllables).alias("b"), text.syllable_letters_sum(t).alias("c"), word_sum(text.syllables_letters).alias("d"), text.n_words(t).alias("e"), F.size(text.words(t)).alias("f"),
                     text.n_sentences(t).alias("g"), F.size(text.sentences(t)).alias("h"), text.n_sentences_simple(t).alias("i"), F.size(text.sentences_simple(t)).alias("j"), text.n_spaced(t).alias("k"), F.size(F.split(t, r"\s+")).alias("l")).collect()
    assert not [r for r in rows if (r.a, r.c, r.e, r.g, r.i, r.k) != (r.b, r.d, r.f, r.h, r.j, r.l)]


def test_runs_count_items(spark):
    got = value(spark, text.runs, ["b", "a", "b", "c", "b"])
    assert [(r["term"], r["n"]) for r in got] == [("a", 1), ("b", 3), ("c", 1)]


def test_simhash_in_batches_equals_the_columns(spark):
    texts = ["one two  three", "", "héllo wörld", "a a a b", " x ", "😀 smile"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    want = {r.doc_id: r.h for r in df.select("doc_id", similarity.simhash64(F.col("t")).alias("h")).collect()}
    assert {r.doc_id: r.simhash for r in fingerprints.with_simhash(df, F.col("t")).collect()} == want


def test_summary_of_short_and_long_texts():
    assert summary.summary(None) == [] and summary.summary("One. Two.") == ["One.", "Two."]
    body = "Opening words here. " + "Filler sentence about nothing much. " * 8 + "Rivers carry stones and rivers carry water past rivers."
    assert summary.summary(body) == ["Filler sentence about nothing much."]


def test_predicates(spark):
    assert value(spark, lambda u: rules.should_crawl(u, ["/a/"], ["b$"]), "http://x/a/c") and not value(spark, lambda u: rules.should_crawl(u, ["/a/"], ["b$"]), "http://x/a/b")
    assert value(spark, lambda t: rules.is_relevant(t, "the engine"), "Engines run") and not value(spark, lambda t: rules.is_relevant(t, "the engine"), "no such thing") and value(spark, lambda t: rules.is_relevant(t, ""), "x")
    assert value(spark, rules.geo_blocked, 451, "") and value(spark, rules.geo_blocked, 200, "Not available in YOUR country") and not value(spark, rules.geo_blocked, 200, "fine")
    assert value(spark, rules.needs_rendering, "https://x.org/app/#y") and not value(spark, rules.needs_rendering, "https://x.org/apple")
    assert value(spark, rules.sanitized_url, "https://me:pw@x.org/p?q=1#f") == "https://x.org/p?q=1"
    assert value(spark, lambda t: rules.line_value(t, "unit_price", "number"), "Name: A\nUnit price: $12.50 each") == 12.5
    assert value(spark, lambda a, b: rules.extraction_confidence(F.lit(3), F.lit(True), F.lit(2)), 1, 1) == 0.4
    assert value(spark, rules.query_score, "rust research", "rust") == pytest.approx(1.1) and value(spark, rules.query_score, "rust", "rust") == 1.0
    assert value(spark, lambda t: rules.variations(t, "broad"), "tea")[:2] == ["tea", "tea review"] and "best tea" in value(spark, lambda t: rules.variations(t, "broad"), "tea")


def test_changes(spark):
    df = spark.createDataFrame([(1, "a b c c", "a c d", '<p>1</p><b>x</b>', '<p>1</p><i>y</i>')], "id long, old string, new string, h0 string, h1 string")
    r = df.select(*(c.alias(k) for k, c in changes.differing_words(F.col("old"), F.col("new")).items()), changes.structural_similarity(F.col("h0"), F.col("h1")).alias("s")).first()
    assert (r.added, r.removed) == (["d"], ["b"]) and r.s == pytest.approx((1 / 3 + 1) / 2)
    d = changes.text_changes(df, "id", "old", "new").first()
    assert '"value": "d"' in d.word_diff and '"removed": true' in d.word_diff
    links = spark.createDataFrame([([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")])], "x array<struct<href: string, text: string>>, y array<struct<href: string, text: string>>")
    got = links.select(*(c.alias(k) for k, c in changes.keyed_changes(F.col("x"), F.col("y"), "href", "text").items())).first()
    assert [[e["href"] for e in got[k]] for k in ("added", "removed", "modified")] == [["c"], ["a"], ["b"]]
    base = changes.baseline(spark.createDataFrame([("u", "<nav>a</nav><p>b</p><nav>c</nav>")], "url string, html string")).first()
    assert set(base.sections) == {"nav_0", "nav_1"} and base.version == 1


def test_entities():
    t = "Dr. Jane Smith met Acme Corp. in Paris on March 3, 2021. The board of Acme paid $2.5 million to the University of Oslo. Everyone agreed; the NASA (NASA Corp) plan was Borealis. Roe v. Wade was cited."
    e = entities.extract(t)
    assert "Dr. Jane Smith" in e["people"] and "Paris" in e["places"] and "March 3, 2021" in e["dates"] and "$2.5 million" in e["money"]
    assert any(o.startswith("Acme Corp") for o in e["organizations"]) and any("University of Oslo" in o for o in e["organizations"])
    assert "Everyone" not in e["other"] and "Borealis" in e["other"] and e["total"] >= e["unique"] > 0
    assert entities.extract(None)["total"] == 0 and entities.clean("“Acme Inc.”,") == "Acme Inc." and entities.is_case("Roe v. Wade")


def test_result_lists_against_brute_force(spark):
    rng = random.Random(6)
    words = "alpha beta gamma delta river stone cloud tree house light".split()
    data = []
    for q in range(3):
        for i in range(14):
            t = " ".join(rng.choice(words) for _ in range(4))
            data.append((q, 100 * q + i, t if i % 4 else "same title words", " ".join(rng.choice(words) for _ in range(30)) if i % 3 else "the very same snippet " * 3, f"http{'s' if i % 2 else ''}://www.site{i % 5}.org/{rng.choice(['x', 'page/one', 'page/two'])}/", i))
    df = spark.createDataFrame(data, "query_id long, doc_id long, title string, snippet string, link string, position int")
    rows = dedup.lists(df)
    pairs = dedup.duplicate_pairs(rows)
    found = {(r.query_id, r.a_at, r.b_at) for r in pairs.collect()}
    held = {(r.query_id, r.at): r for r in rows.collect()}
    lev = lambda a, b: float(spark.range(1).select(F.levenshtein(F.lit(a), F.lit(b))).first()[0])
    for (q, at), x in list(held.items())[:12]:
        for other in range(at + 1, 15):
            y = held[q, other]
            url = 1.0 if x.u == y.u else 1 - lev(x.u, y.u) / max(len(x.u), len(y.u))
            inter, union = len(set(x.tt) & set(y.tt)), len(set(x.tt) | set(y.tt))
            title = 1.0 if x.t == y.t else 0.7 * inter / union + 0.3 * (1 - lev(x.t, y.t) / max(len(x.t), len(y.t)))
            content = 1 - ((x.h ^ y.h) & (2**64 - 1)).bit_count() / 64
            hit = url >= 0.95 or (url >= 0.8) + (title >= 0.75) + (content >= 0.7) >= 2 or 0.4 * url + 0.35 * title + 0.25 * content >= 0.6
            assert ((q, at, other) in found) == hit
    led = {(r.query_id, r.at): r.leader_at for r in dedup.leaders(rows, pairs).collect()}
    for q in range(3):
        done = {}
        for at in range(1, 15):
            mine = [a for a in range(1, at) if done.get(a) == a and (q, a, at) in found]
            done[at] = mine[0] if mine else at
        assert {a: led[q, a] for a in done} == done
    out = dedup.merged(rows, dedup.leaders(rows, pairs)).collect()
    assert len(out) == sum(a == b for (_, a), b in led.items()) and sum(r.duplicates + 1 for r in out) == len(data)
    stats = dedup.statistics(rows, dedup.leaders(rows, pairs), pairs).collect()
    assert sum(s.removed for s in stats) == len(data) - len(out)


def test_result_lists_against_their_sql_beyond_ascii(spark):
    import duckdb

    from weft.plans import search
    from weft.sources.tables import RESULT_LISTS_SQL

    titles = ["Échpaan trepa.", "Et treêaux treleai pourenêaire.", "De la èamentch", "de la eamentch", "Was.", "Éaux en, éreon laèelle."]
    data = [(1, i + 1, 4 * i, t, f"wörter 😀 von\x0bheute {'😁' if i % 2 else 'und'} morgen", f"https://sité.edu/doc/{4 * i}") for i, t in enumerate(titles)]
    df = spark.createDataFrame(data, "query_id long, position int, doc_id long, title string, snippet string, link string")
    got = dedup.duplicate_pairs(dedup.lists(df)).select("query_id", "a", "b", *(F.round(c, 6) for c in ("url", "title", "content", "combined")), "reason").collect()
    db = duckdb.connect()
    db.execute("create table lists (query_id bigint, position int, doc_id bigint, title varchar, snippet varchar, link varchar)")
    db.executemany("insert into lists values (?, ?, ?, ?, ?, ?)", data)
    sql = search.Q["duplicate_pairs"][1].removeprefix(f"with {RESULT_LISTS_SQL},")
    want = db.execute(f"with {sql.lstrip()}").fetchall()
    assert len(want) > 5 and sorted(tuple(r) for r in got) == sorted(want)


def test_monitors_metrics_and_graph_helpers(spark):
    m = spark.createDataFrame([(1, 100, 50, True), (2, 100, 950, True), (3, 10, 0, False), (4, 100, 2000, True)], "id long, interval long, next_due long, enabled boolean")
    assert [tuple(r) for r in monitors.run_due(m, 1000).orderBy("id").collect()] == [(1, True, 9, 1050), (2, True, 0, 1050), (3, False, 0, 0), (4, False, 0, 2000)]
    calls = spark.createDataFrame([("a", 5.0, False), ("a", 70.0, True)], "name string, v double, bad boolean")
    lines = {r.line for r in metrics.prometheus(calls, "name", "v", "bad").collect()}
    assert {'weft_calls_total{name="a"} 2', 'weft_errors_total{name="a"} 1', 'weft_duration_bucket{name="a",le="10"} 1', 'weft_duration_bucket{name="a",le="+Inf"} 2'} <= lines
    e = spark.createDataFrame([(1, 2, 1), (2, 1, 2), (2, 3, 1)], "src long, dst long, weight long")
    assert graph.relationship(e, 1, 2)["kind"] == "mutual" and graph.relationship(e, 1, 3) == {"forward": [1, 2, 3], "backward": None, "kind": "indirect"} and graph.relationship(e, 3, 1)["kind"] == "indirect"
    assert {tuple(r) for r in graph.adjacency(e).collect()} == {(0, 1, 1), (1, 0, 2), (1, 2, 1)}
    assert {tuple(r) for r in graph.merged(e, e).collect()} == {(1, 2, 2), (2, 1, 4), (2, 3, 2)}
    pages = spark.createDataFrame([(i,) for i in (1, 2, 3, 9)], "node long")
    assert {r.node: r.issue for r in graph.recommendations(e, pages).collect()} == {1: "few inbound links", 2: "few inbound links", 3: "dead end", 9: "orphan"}
    ranks = spark.createDataFrame([(i, float(i)) for i in range(11)], "node long, rank double")
    assert [(r.bucket, r.n) for r in graph.importance_distribution(ranks).orderBy("bucket").collect()] == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]
    assert np.isclose(sum(r["rank"] for r in graph.pagerank(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")).collect()), 1.0)


def test_robots_groups_wildcards_and_delays(spark):
    from weft.sources import feeds

    body = "# note\nUser-agent: one\nUser-agent: two\nDisallow: /*.pdf$\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /a\nAllow: /a/b?x\nDisallow: /c*d  # why\n"
    robots = spark.createDataFrame([("h.org", body)], "host string, body string")
    urls = [f"https://h.org{p}" for p in ("/a", "/a/b?x=1", "/c/1/d", "/f.pdf", "/f.pdf.html", "/ok")]
    got = lambda agent: {r.url.removeprefix("https://h.org"): r.allowed for r in feeds.allowed(spark.createDataFrame([(u,) for u in urls], "url string"), robots, agent).collect()}
    assert got("two") == {"/a": True, "/a/b?x=1": True, "/c/1/d": True, "/f.pdf": False, "/f.pdf.html": True, "/ok": True}
    assert got("other") == {"/a": False, "/a/b?x=1": True, "/c/1/d": False, "/f.pdf": True, "/f.pdf.html": True, "/ok": True}
    assert [tuple(r) for r in feeds.crawl_delays(robots, "one").collect()] == [("h.org", 2.0)] and not feeds.crawl_delays(robots).collect()


def test_sitemap_media_and_packed_files(spark):
    import gzip

    from weft.sources import feeds

    xml = "<urlset><url><loc>https://a.b/x</loc><image:image><image:loc>https://a.b/i.png</image:loc><image:title>T</image:title></image:image><news:news><news:name>N</news:name><news:publication_date>2024-01-01</news:publication_date><news:title>H</news:title></news:news></url></urlset>"
    files = spark.createDataFrame([("u", bytearray(gzip.compress(xml.encode()))), ("v", bytearray(b"\x1f\x8bbroken")), ("w", bytearray(b"<a/>"))], "url string, content binary")
    texts = feeds.unpacked(files)
    assert {r.url: r.xml for r in texts.collect()} == {"u": xml, "v": None, "w": "<a/>"}
    assert {tuple(r) for r in feeds.sitemap_media(texts).collect()} == {("u", "https://a.b/x", "image", "https://a.b/i.png", "T", None), ("u", "https://a.b/x", "news", "N", "H", "2024-01-01")}


def test_site_templates(spark):
    from weft.operators import sites

    hn = '<table><tr class="athing" id="7"><td><span class="titleline"><a href="https://x.y">A story</a> <span class="sitebit">(<a>x.y</a>)</span></span></td></tr><tr><td class="subtext"><span class="score">12 points</span> <a class="hnuser">me</a> <span class="age"><a href="item?id=7">1 hour ago</a></span> <a href="item?id=7">3 comments</a></td></tr></table>'
    so = '<div id="question-header"><h1>Why?</h1></div><div class="question"><div class="s-prose">Because</div><time datetime="2024"></time></div><a class="post-tag">a</a><a class="post-tag">b</a><div class="answer accepted-answer"><span class="js-vote-count">5</span><div class="s-prose">Yes</div></div>'
    pages = [(1, "https://news.ycombinator.com/news", hn), (2, "https://stackoverflow.com/questions/1/x", so), (3, "https://github.com/a/b", '<meta property="og:description" content="D"><a class="topic-tag">t</a>'), (4, "https://example.org/", "<h1>x</h1>"), (5, "https://www.youtube.com/watch?v=q", '<link rel="canonical" href="https://www.youtube.com/watch?v=q1">')]
    import json

    got = {r.page_id: (r.site, json.loads(r.fields)) for r in sites.run_sites(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert set(got) == {1, 2, 3, 5} and got[1][1]["stories"] == [{"id": "7", "title": "A story", "url": "https://x.y", "site": "x.y", "score": "12", "author": "me", "posted": "1 hour ago", "comments": "3 comments"}]
    assert got[2][1]["title"] == "Why?" and got[2][1]["tags"] == ["a", "b"] and got[2][1]["answers"] == [{"votes": "5", "accepted": True, "body": "Yes"}] and got[2][1]["answered"]
    assert got[3][0] == "github-repo" and got[3][1]["description"] == "D" and got[3][1]["topics"] == ["t"] and got[5][1]["video_id"] == "q1"


def test_schema_items_clean_html_and_colours(spark):
    import json

    from weft.functions import dom, html

    page = '<script type="application/ld+json">{"@type": "BlogPosting", "name": "H", "author": {"name": "A"}}</script><script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "P", "offers": {"price": "3", "priceCurrency": "EUR"}, "gtin13": "1"}]}</script>'
    items = dom.schema_items(dom.parse(page))
    assert items["article"]["headline"] == "H" and items["article"]["author"] == "A" and items["product"]["price"] == "3" and items["product"]["currency"] == "EUR" and items["product"]["gtin"] == "1" and items["event"] is None
    assert dom.clean(dom.parse('<nav>x</nav><div onclick="a()" class="c"><p></p><p>Hi &amp; bye<!-- no --></p><img src="i" width="3"><span> </span></div><script>y</script>')) == '<div class="c"><p>Hi &amp; bye</p><img src="i"></div>'
    colors = ["#ABC", "rgb(1, 2, 300)", "hsl(120, 100%, 25%)", "hsl(0, 0%, 50%)", "hsla(240deg 100% 50% / .5)", "Navy", "none"]
    got = [r.c for r in spark.createDataFrame(list(enumerate(colors)), "i int, v string").select("i", html.color(F.col("v")).alias("c")).orderBy("i").collect()]
    assert got == ["#aabbcc", "#0102ff", "#008000", "#808080", "#0000ff", "#000080", None] and json.dumps(got)


def test_blocks_of_a_diff_against_difflib_and_in_time():
    import difflib
    import time

    rng = random.Random(4)
    for n in range(300):
        kinds = rng.choice([2, 3, 12, 200])
        a = [str(rng.randrange(kinds)) for _ in range(rng.randrange(120))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(9)] = [str(rng.randrange(kinds)) for _ in range(rng.randrange(9))]
        b = b if n % 3 else [str(rng.randrange(kinds)) for _ in range(rng.randrange(120))]
        assert changes._Blocks(a, b).get_opcodes() == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    page = [w for i in range(8000) for w in (f"w{i % 3000}", " ")]
    began = time.time()
    runs = changes.diff(page, [*page[:5000], "new", " ", *page[5200:]])
    assert [r["count"] for r in runs] and time.time() - began < 4


def test_entities_are_read_once_and_counted_by_kind(spark):
    from weft.operators import entities as named

    text = "Dr. Jane Stone of the River Institute (RI) paid $5 in Paris. River water. On May 4, 2024 Cloud said: 'Cloud ACME, Inc. won'."
    docs = spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")
    found = named.with_entities(docs)
    counts = named.entity_counts(found)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = {(k, e.lower()) for k in named.KINDS for e in entities.extract(text)[k]}
    assert {(r.kind, r.entity, r.n) for r in counts.collect()} == {(k, e, 2) for k, e in want} and len({k for k, _ in want}) >= 5
    assert entities.organisation_acronyms(text) == {"RI", "ACME"} and entities.words_of("A. River ran. The River’s Edge. Then") == ({"A", "River", "ran", "The", "s", "Edge", "Then"}, {"River", "Edge"})
