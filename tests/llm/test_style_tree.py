"""The style tree against a plain Python one, and what it decides on made-up sites."""

import math
import time
from collections import defaultdict

from lumenframe.llm import style_tree

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def plain_importance(pages):
    """Importance by host and path, recomputed page by page."""
    once = {}
    for i, url, html in pages:
        article, found = style_tree.features(html)
        once.setdefault((style_tree.host_of(url), article), (i, found))
    m, blocks, shapes, chains = defaultdict(int), defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int)), {}
    for (host, _), (_, found) in once.items():
        for path, kind, feature, chain in found:
            if kind == 0:
                m[host, path] += 1
                chains[host, path] = chain
            elif kind in (1, 2):
                (blocks if kind == 1 else shapes)[host, path][feature] += 1
    entropy, count = defaultdict(float), defaultdict(int)
    for key, chain in chains.items():
        own = sum(math.log(n) for n in blocks[key].values()) / math.log(max(m[key], 2))
        for up in chain:
            entropy[key[0], up] += own
            count[key[0], up] += len(blocks[key])
    out = {}
    for key in chains:
        content = 1 - entropy[key] / count[key] if count[key] else 1.0
        total = sum(shapes[key].values())
        if total > 1:
            variety = (math.log(total) - sum(n * math.log(n) for n in shapes[key].values()) / total) / math.log(max(m[key], 2))
            content = 0.9 * content + 0.1 * variety
        out[key] = content
    return out


def test_importance_is_that_of_a_plain_style_tree(spark, sf_dir):
    page = lambda i: f"<body><div class=top>Welcome<span> all</span></div><div class=body><p>story {i % 9}</p>{'<ul><li>x<li>y</ul>' * (i % 2)}<p>end</p></div></body>"
    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", page(i)) for i in range(30)]
    rows += [(100 + r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = {(r.host, r.path): r.importance for r in style_tree.style_tree(style_tree.evidence(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = plain_importance(rows)
    # chains start at html or body, and every node on a chain with features of its own is a row
    assert got.keys() <= want.keys() and len(got) > 50
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_the_tree_decides_about_prose_of_marked_articles(spark):
    page = lambda i: f"<body><article><h1>Head {i}</h1><p>story {i}</p><div class='k7'><p>Our terms</p><p>have changed</p></div></article></body>"
    got = texts(spark, [(i, f"http://a.example/{i}", page(i)) for i in range(12)])
    assert all(got[i] == f"Head {i}\nstory {i}" for i in range(12))
    assert style_tree.main_text(page(1)) == "Head 1\nstory 1\nOur terms\nhave changed", "without the tree they stay"


def test_names_in_doubt_are_asked_of_the_tree(spark):
    page = lambda i: f"<body><div class='text'><p>story {i}</p></div><div class='search'><p>results of study {i}</p><p>method {i}</p></div><div class='social'><p>Follow us</p><p>Tell a friend</p></div><div class=comments><p>reader {i}</p></div></body>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(40)] + [(100 + i, f"http://b.example/{i}", page(i)) for i in range(3)]
    got = texts(spark, rows)
    assert all(got[i] == f"story {i}\nresults of study {i}\nmethod {i}" for i in range(40))
    assert all(got[100 + i] == f"story {i}" for i in range(3)), "without evidence the name decides"


def test_sites_without_article_marks_or_telling_names(spark):
    page = lambda i: f"<body><div class='a1'><a href=/>Home</a> <a href=/x>World</a></div><div class='article-header'>Daily paper</div><div class='b2'><div><p>story {i}</p><p>goes on {i}</p></div></div><div class='main-content'><p>All rights</p></div></body>"
    got = texts(spark, [(i, f"http://a.example/{i}", page(i)) for i in range(12)])
    assert all(got[i] == f"story {i}\ngoes on {i}" for i in range(12))


def test_copies_of_an_article_count_once(spark):
    page = lambda i: f"<body><article><p>story {i}</p><p>more {i}</p></article></body>"
    got = texts(spark, [(i, f"http://a.example/{i}", page(0 if i < 40 else i)) for i in range(60)])
    assert all(got[i] == "story 0\nmore 0" for i in range(40)) and got[50] == "story 50\nmore 50"


def test_nesting_takes_linear_time():
    for piece in ("<div>x", "<font>x", "<font><div>x", "<div>x</p></b>", "<table><tr><td>x", "<i></i></div><div>x"):
        page = piece * (20000 // piece.count("<"))
        style_tree.main_text(page)
        at = time.process_time()
        _, found = style_tree.features(page)
        assert style_tree.main_text(page, frozenset([1]), frozenset([2])).count("x") >= 5000
        assert time.process_time() - at < 5 and sum(len(x[3] or ()) for x in found) < 64 * 70, piece


def test_inline_elements_and_misnested_ends():
    assert style_tree.main_text("<div class='sidebar'><article><p>a <a href=x>b</a> c</p></article></div>") == "a b c"
    assert style_tree.main_text("<p>a <span class='ad'>buy <b>now</b></span> b</p>") == "a b"
    assert style_tree.main_text("<i>a<p>b</i> c</p>d") == "a\nb c\nd"
    assert style_tree.main_text("<article><nav><article><p>x</p></article></nav><p>y</p></article>") == "y"


def test_empty_and_null_pages(spark):
    assert texts(spark, [(1, None, None), (2, "x", ""), (2, "x", ""), (None, "http://a/", "<p>a")]) == {1: "", 2: "", None: "a"}
    assert style_tree.extract(spark.createDataFrame([], SCHEMA)).collect() == []
