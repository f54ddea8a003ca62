"""HTML extraction, WARC, URL filters and the pipeline."""

import base64
import gzip
import hashlib
import html as entities
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from chatprep.llm import html_extract as H, url_filter as U, warc as X
from chatprep.llm.common import Scratch
from chatprep.llm.queries import URL_RULES
from tests.conftest import SF0001, SF001


def test_min_cut_is_minimal():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randrange(1, 8)
        costs = np.array([rnd.choice([-2, -1, -.5, .25, .5, 1, 2, 3]) for _ in range(n)])
        edges = [(rnd.randrange(n), rnd.randrange(n), rnd.choice([.1, .5, 1, 2])) for _ in range(rnd.randrange(0, 14))]

        def cost(labels):
            own = sum(max(c, 0) if not y else max(-c, 0) for c, y in zip(costs, labels))
            return own + sum(w for i, j, w in edges if i != j and labels[i] != labels[j])

        assert abs(cost(H.min_cut(costs, edges)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-6


def test_extract_given_pages(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet").withColumn("text", F.lit(1))
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body))
        want[r.page_id] = "\n".join(p for p in parts if p)
    got = {r.page_id: (r.text, r.n_chars) for r in H.extract(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_extract_boilerplate_kinds(spark):
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header>
      <div class="cookie-notice">We use cookies</div><div id="menu"><a href=/>Home</a></div>
      <div class="content sidebar-left"><main><header><h1>Title &amp; more</h1></header><p>First   para <b>bold</b>word.
      <p>Second &eacute;&#233; a<br>b <ul><li>one<li>two</ul><div class="ad-slot">Buy!</div><form>Name <input></form>
      <p>Third</main></div><section id="comments"><article class="comment"><p>Nice post, very good indeed.</p></article></section>
      <aside>Side</aside><footer>(c)</footer><script>if(a<b){"</p>"}</script><style>p{}</style><!-- <p>no</p> --></body></html>"""
    assert H.extract_text(page, np.zeros(H.N_FEATURES)) == "Title & more\nFirst para boldword.\nSecond éé a b\none\ntwo\nThird"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>x"), (3, "u", "<p>x"), (4, "u", "a < b <"), (5, "v", "<p>w " * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in H.extract(df).collect()]
    assert got[:5] == [(1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1), (4, "a < b <", 7)] and got[5][2] == 39_999
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page,want", [
    ("<html><head><title>T</title><meta charset=utf-8><body><p>One<p>Two", "One\nTwo"),  # no </head>
    ("<head><title>T</title><script>x</script><link rel=a><p>One", "One"),  # neither </head> nor <body>
    ("<head><title>T</title> One", "One"),
    ("<head></head><body><p>One<head><p>Two</body>", "One\nTwo"),  # a stray head
    ("<div><p>One<button>Buy<p>Two</p> tail<div>Three</div></div><p>Four", "One\nTwo\ntail\nThree\nFour"),  # no </button>
    ("<p>One</p><button>Buy<p>Two</p><button><div>Share</div></button><p>Three", "One\nTwo\nThree"),
    ("<p>One</p><object><param name=a>Old<p>Two</p><object><p>Old</p></object><p>Three", "One\nTwo\nThree"),
    ("<p>One</p><select><option>a<option>b<p>Two", "One\nTwo"),
    ("<p>One</p><select><option>a<select><option>b</select><p>Two", "One\nTwo"),
    ("<p>One</p><svg><g><text>icon<p>Two</p></svg><span>Three</span>", "One\nTwo\nThree"),
    ("<p>One</p><svg><foreignObject><p>icon</p></foreignObject></svg><p>Two", "One\nTwo"),
    ("<p>One</p><video><button>Buy<p>No</p></video><canvas>No<section>Two</section>", "One\nTwo"),
    ("<button>Buy<video><p>No</p></video><p>One", "One"),
])
def test_unclosed_skipped_elements(page, want):
    assert H.extract_text(page, np.zeros(H.N_FEATURES)) == want


@pytest.mark.parametrize("page,want", [
    ('<article><h2 id="related-work">Related</h2><p>One</p><section id="discussion"><h2 id="search">S</h2><p>Two</p></section>'
     '<section id="social-history"><p>Three</p></section></article>', "Related\nOne\nS\nTwo\nThree"),
    ('<article><div class="entry-header"><p>One</p></div><p class="share-price">Two</p><p data-id="ad" title="id=ad">Three</p>'
     '</article>', "One\nTwo\nThree"),
    ('<div class="post comments-open"><article><p>One</article></div><div id="comments"><p>Two, with much more text', "One"),
    ('<div class="site has-sidebar"><p>One</p><div class="sidebar"><p>S</p></div></div>', "One"),
    ('<div class="sidebar"><p>One</p><p>Two</p></div><div class="ad-slot">Buy</div>', "One\nTwo"),  # around most of it
    ('<div id="discussion"><article><p>One</article></div>', "One"),
    ('<div class="comments"><article><p>One</article></div>', "One"),  # all there is
    ('<main><article><p>One</article><section id="comments"><article class="comment"><p>Two</article></section></main>', "One"),
    ('<article><p>One</p><div class="ad-slot">Buy</div><div class="related-posts"><p>R</p></div><p>Two</p></article>', "One\nTwo"),
])
def test_names_count_as_whole_names(page, want):
    assert H.extract_text(page, np.eye(H.N_FEATURES)[0]) == want  # every text counts as content by 1


@pytest.fixture(scope="module")
def weights(spark):
    return H.fit(spark.read.parquet(f"{SF001}/pages.parquet"))


def test_pages_without_marks(spark, weights):
    """Elements renamed to div, class, id and role taken out: text and tree alone tell the article."""
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("html", r"<(/?)(article|nav|footer|aside|header|section|form|main)\b", "<$1div"),
                            r"\s(class|id|role)=\"[^\"]*\"", "")
    with_marks = {r.page_id: r.text for r in H.extract(pages, weights).collect()}
    without = {r.page_id: r.text for r in H.extract(pages.withColumn("html", bare), weights).collect()}
    assert without == with_marks


def test_neighbours_decide_a_doubtful_block(weights):
    line = "<p>Words of the story go on, and the reader follows them to the end of the line.</p>"
    page = ("<div><div><h2>A story of some kind</h2>" + line * 3 + "<div><a href=/x>See this one</a></div>" + line * 3
            + "</div><div>Copyright us</div></div>")
    blocks, elements = H.blocks_of(page)
    costs = np.clip(H.features(blocks, elements) @ weights, -H.TEXT_LIMIT, H.TEXT_LIMIT)
    assert H.min_cut(costs, [])[4] is False  # its own cost alone
    assert H.min_cut(costs, H.smoothness(blocks, elements))[4] is True
    assert H.extract_text(page, weights).split("\n")[4] == "See this one"


@pytest.mark.parametrize("part", ["<script>x()</script>", "<svg><g/></svg>", "<button>go</button>", "<noscript>n</noscript>",
                                  "<nobr></nobr>", "<textarea>t</textarea>", "<x-y></x-y>", "<select><option>a</select>"])
def test_removed_elements_do_not_split_a_block(part):
    page = f"<article><p>The price{part} rose.</p><p>More.</p></article>"
    assert H.extract_text(page, np.zeros(H.N_FEATURES)) == "The price rose.\nMore."


@pytest.mark.parametrize("page", [
    "<p>a</p>" + "<b" * 20_000, "<div>" * 20_000 + "a" + "</div>" * 20_000, "<p>a</p>" + "<a href=\"x>y</a>'" * 8_000,
    "<p>a" + "<![CDATA[" * 20_000, "<svg>" + "<g>" * 20_000 + "</svg><p>a", "<script>" + "</script " * 20_000,
    "<button>" + "<div>a" * 20_000, "<b>" * 20_000 + "a"])
def test_odd_markup_takes_linear_time(page):
    start = time.process_time()
    H.extract_text(page, np.zeros(H.N_FEATURES))
    assert time.process_time() - start < 2


def test_fit_reads_a_bounded_number_of_blocks(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    assert len(H.fit(pages, fit_pages=5, fit_blocks=20)) == H.N_FEATURES
    assert not H.fit(pages.limit(0)).any()


WARC_ROWS = [(3, "u3", "x"), (1, "u1", "x"), (2, "u2", None), (4, None, ""), (5, "a\r\nb: c", "é😀"), (5, "z", "é😀"),
             (None, "n", "x"), (None, "n2", "only null"), (None, "n3", "y"), (None, "n4", "only null"), (6, "q", "y" * 100_000),
             (7, "w", "y" * 100_000), (6, "v", "other")]


def slow_warc(rows, least):
    first, seen, out = {}, set(), []
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None:
            first[b] = min(p, first.get(b, p))
    for p, _, h in rows:
        b = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        new = len(b) < least or (p == first.get(b) and (p, b) not in seen)
        seen.add((p, b))
        out.append((p, len(b), digest, "response" if new else "revisit", None if new else first.get(b)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 5])
def test_warc_round_trip(spark, least):
    df = spark.createDataFrame([(*r, 1) for r in WARC_ROWS], "page_id long, url string, html string, sha int").repartition(3)
    scratch = Scratch(spark, "t")
    index = X.write_archives(df, scratch, least)
    got = X.read_records(index, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) \
        == slow_warc(WARC_ROWS, least)
    assert all(len(r.payload) == r.payload_bytes for r in got if r.record_type == "response")
    # the files are WARC files of one gzip member a record, as the index says
    for name in {r.file for r in index.collect()}:
        fs, path = pafs.FileSystem.from_uri(name if "://" in name else f"file://{name}")
        data = fs.open_input_file(path).read()
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == index.filter(F.col("file") == name).count()
    some = X.read_records(index.filter("page_id in (3, 6)"))
    assert sorted(r.page_id for r in some.collect()) == [3, 6, 6]


def test_warc_rows_that_repeat_an_id_and_payload_have_one_response(spark):
    """Where the small side of the join is broadcast, equal rows may stay in tasks of their own until they are written."""
    html = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=400_000))
    rows = [(p, f"u{k}", html + str(p)) for p in (5, None) for k in range(4)] + [(7, "w", html + "5"), (8, "s", "x"), (8, "t", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # less than the payloads
    try:
        got = X.write_archives(df, Scratch(spark, "t"), 2).select("page_id", "record_type", "refers_to").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert Counter(tuple(r) for r in got) == {(5, "response", None): 1, (5, "revisit", 5): 3, (None, "response", None): 1,
                                              (None, "revisit", None): 3, (7, "revisit", 5): 1, (8, "response", None): 2}


def test_warc_coalesces_ranges(spark):
    index = spark.createDataFrame([("f", 0, 10), ("f", 10, 10), ("f", 25, 5), ("f", 500, 5), ("g", 0, 3)],
                                  "file string, offset long, length long")
    got = sorted((r.file, r.begin, r.end, len(r.records)) for r in X.coalesced(index, gap=8, read=1000).collect())
    assert got == [("f", 0, 30, 3), ("f", 500, 505, 1), ("g", 0, 3, 1)]


def test_warc_reads_are_dealt_by_archive_bytes(spark):
    """A record over the size of a read is one range, and many tasks read few index rows."""
    rnd = random.Random(3)
    rows = [(i, f"u{i}", "".join(chr(rnd.randrange(33, 5000)) for _ in range(60_000 if i == 7 else 3000))) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = X.write_archives(df, Scratch(spark, "t"))
    ranges = X.dealt_ranges(index, gap=0, read=20_000, task_bytes=100_000)
    tasks = ranges.groupBy(F.spark_partition_id()).agg(F.sum(F.col("end") - F.col("begin")).alias("b")).collect()
    total = sum(r.b for r in tasks)
    assert total == index.agg(F.sum("length")).first()[0] and len(tasks) >= 8
    assert max(r.b for r in tasks) < total / 3
    got = X.read_records(index, with_payload=True, read=20_000, task_bytes=100_000).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {r[0]: r[2] for r in rows}
    assert index.filter("page_id = 7").first().length > 20_000


def test_warc_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert X.read_records(X.write_archives(df, Scratch(spark, "t"))).count() == 0


def test_url_filter(spark):
    rows = [(1, "http://a.net/x", '<link rel="canonical" href="http://b.example.org/es/1">'), (2, "http://b.example.org/es/1#t", ""),
            (3, "http://c.net/", '<meta http-equiv="refresh" content="0; url=/y">'), (4, "http://c.net/y", "<link href=http://a.net/x rel=canonical>"),
            (5, "http://d.net/q", '<link rel=canonical href="http://e.org/">'), (6, "http://f.com/de/1", '<link rel=canonical href="http://d.net/q">'),
            (7, None, None), (8, "nourl", '<link rel=canonical href="http://f.com/de/1">'), (9, "http://ORG", ""),
            (10, "HTTP://X.Example.ORG/en/123?x", ""), (None, "http://a.net/x", '<!-- <link rel=canonical href="http://zzz.org/"> -->'),
            (1, "http://a.net/x", '<link rel="canonical" href="http://b.example.org/es/1">'), (11, "http://notorg/", ""), (12, "http://x.org/", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, verdict int")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in U.judge(df, URL_RULES, Scratch(spark, "t")).collect()}
    assert got == {(1, "a.net", "/x"): (None, "block"), (None, "a.net", "/x"): (None, "block"),
                   (2, "b.example.org", "/es/1"): ("example.org/es/", "block"), (3, "c.net", "/"): (None, "block"),
                   (4, "c.net", "/y"): (None, "block"), (5, "d.net", "/q"): (None, "allow"),  # explicit allow goes first
                   (6, "f.com", "/de/1"): ("com/de/", "block"), (7, "", ""): (None, "allow"), (8, "", ""): (None, "allow"),
                   (9, "org", ""): (None, "allow"), (10, "x.example.org", "/en/123"): ("example.org/en/1", "block"),
                   (11, "notorg", "/"): (None, "allow"), (12, "x.org", "/"): ("org/", "allow")}
    assert U.judge(df.limit(0), URL_RULES, Scratch(spark, "t")).count() == 0


def test_alias_urls_are_compared_as_urls(spark):
    link = '<link rel="canonical" href="{}">'.format
    target = "http://b.com/de/1?p=1&q=2"  # blocked by its own url
    rows = [("http://a.net/1", link("http://b.com/de/1?p=1&amp;q=2")), ("http://a.net/2", link("HTTP://B.com/de/1?p=1&#38;q=2")),
            ("http://a.net/3", link("http://b.com/x/../de/./1?p=1&#x26;q=2#t")), ("HTTP://A.net/4/x", link("http://b.com/de/1?p=1&q=2")),
            ("http://a.net/5", '<link rel="alternate canonical" href="http://b.com/de/1?p=1&q=2">'),
            ("http://a.net/6", "<link href='http://b.com/de/1?p=1&q=2' rel='canonical alternate'>"),
            ("http://a.net/7/8/9", link("../../1")), ("http://A.NET/q/w", '<meta http-equiv=refresh content="0; url=&#39;../7/8/9&#39;">'),
            ("http://a.net/8", '<link rel="canonicals" href="http://b.com/de/1?p=1&q=2">'),
            ("http://a.net/9", link("http://b.com/de/1?p=1&amp;amp;q=2")), (target, "")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.alias_of) for r in U.judge(df, URL_RULES, Scratch(spark, "t")).collect()}
    assert {k for k, (_, alias) in got.items() if alias == "http://a.net/1"} == {1, 2, 3, 4, 5, 6, 7, 8, 11}
    assert {k for k, (verdict, _) in got.items() if verdict == "allow"} == {9}
    texts = ["a&amp;b", "a&ampb", "a&amp=b", "&amp", "&copy=1&lt;&eacute;", "&#233;&#xE9&#x1F600;", "&#128;", "&#xD800;&#0;&#99999999;",
             "&nosuch;&", "&#;&#x;&#xg", "x\ny&lt;"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    want = ["a&b", "a&ampb", "a&amp=b", "&", "&copy=1<é", "éé😀", "€", "\ufffd" * 3, "&nosuch;&", "&#;&#x;&#xg", "x\ny<"]
    assert [r[0] for r in frame.select(U.decoded(F.col("t"))).collect()] == want
    urls = {"http://a/b/../c": "http://a/c", "http://a/../..": "http://a/", "http://a/b/.": "http://a/b/", "HTTP://U:P@A?Q/..": "http://U:P@a?Q/..",
            "http://a/%2E%2e/b//..": "http://a/b/", "http://A": "http://a", "No/..#x": "No/..", None: None}
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in frame.select(U.url_node(F.col("u"))).collect()] == list(urls.values())


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline as P
    from chatprep.llm import language_id as L
    from tests.llm.test_pairs_and_groups import slow_groups, slow_report
    from tests.llm.test_texts import slow_measures
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in P.run(spark, SF0001).collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]

    def kept(t):
        words, chars, symbols, _, repeat = slow_measures(t)
        upper = sum(c.isupper() for c in t)
        return words >= 50 and 100 * repeat <= 50 * words and 10 * symbols <= words and 100 * upper <= 30 * chars

    rows = [(d, t) for d, t, _ in rows if kept(t) and L.has_letter(t)]
    groups = slow_groups(rows)
    stay = {c for _, _, c in groups}
    rows = [(d, t) for d, t in rows if d in stay]
    items = [tuple(r) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {int(d) for d, *_, bad in slow_report(rows, items) if not bad}
    lib = Tokenizer.from_file(P.tokenizer_path())
    want = {}
    for d, t in rows:
        if d in clean:
            ids = lib.encode(t, add_special_tokens=False).ids
            want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                       hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == want


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as P

    long_ = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None, None, None, 0, 1), (None, long_, "en", "s", 1, 2), (2, long_, "en", "s", 1, 3), (2, long_, "en", "s", 1, 3), (3, "", "fr", "s", 0, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for sample in (docs, docs.limit(0)):
        rows_ = sample
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, rows_, SF0001)
            if k < 4:
                assert out.columns == docs.columns
                rows_ = Scratch(spark, "t").table(out, str(k))
        assert [r.doc_id for r in out.collect()] == ([2] if sample is docs else [])


def test_language_stage_without_labels_keeps_all_rows(spark):
    import corpus_pipeline as P

    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (3, "more words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(map(str, P.language(spark, docs, SF0001).collect())) == sorted(map(str, docs.collect()))
    labelled = docs.union(spark.createDataFrame([(4, "one", "en")], docs.schema))
    assert sorted(r.doc_id for r in P.language(spark, labelled, SF0001).collect()) == [1, 3, 4]
