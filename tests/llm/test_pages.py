import random
from html.parser import HTMLParser

import numpy as np

from botlog.llm import pages as G


def test_blocks_and_zones():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar">
    <nav><a>Menu</a></nav><header><h1>Site</h1></header><!-- <p>no</p> --><div class='ad-box'>Buy</div>
    <article class="post"><header><h1>Head &amp; line</h1></header><p title="a > b">One <b>bo</b>ld<br>two&nbsp;three
    <p>Next &lt;tag&gt;&#33; <span hidden>x</span><ul><li>a<li>b</ul><div class="share">Tweet</div>
    <form><p>Mail</p></form><style>p{}</style>tail</article><aside>Side</aside><section id="comments"><article>Nice</article></section>
    <div role="contentinfo">legal</div><footer>&copy;</footer><p>cut <"""
    kept = [t for z, t in G.blocks_of(page) if z == G.MAIN]
    assert kept == ["Head & line", "One bold two three", "Next <tag>!", "a", "b", "tail"]
    assert [t for z, t in G.blocks_of(page) if z == G.PLAIN] == ["cut <"]
    assert G.blocks_of("") == [] and G.blocks_of("a < b") == [(G.PLAIN, "a < b")]
    assert G.blocks_of('<p class="x') == []


def test_hints_are_no_facts():
    prose = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen."
    of = lambda body: G.blocks_of(f"<body>{body}</body>")
    main = lambda body: of(f"<article>{body}</article>")
    assert main('<div class="entry-header"><h1>Title</h1></div><p>x') == [(G.MAIN, "Title"), (G.MAIN, "x")]
    assert of('<div class="entry-header"><h1>Site</h1></div><p>x') == [(G.PLAIN, "x")]
    assert of(f'<div class="post-content share-enabled"><p>{prose}</div>') == [(G.PLAIN, prose)]
    assert main(f'<div class="has-sidebar no-comments"><p>{prose}</div>') == [(G.MAIN, prose)]
    # A paragraph under a layout class: prose is for the array to decide, links and short lines go.
    assert main(f'<p class="related">{prose}<p>x') == [(G.PLAIN, prose), (G.MAIN, "x")]
    assert main(f'<p class="related"><a href="/">{prose}</a><p class="share">Tell a friend<p>x') == [(G.MAIN, "x")]
    assert main(f'<p class="related-ad">{prose}<div class="related"><p>{prose}</div><p class="notice">{prose}<p>x') == [(G.MAIN, "x")]
    # Forms that are wrappers, and forms that are not.
    assert of(f"<form><nav>Menu</nav><p>{prose}</p><input><button>Go</button></form>") == [(G.PLAIN, prose)]
    assert of("<form><p>Please log in</p><label>Name</label><input></form>") == []
    assert of(f"<form><article><p>x</article></form><form><p>{prose}</form><div>y</div>") == [(G.MAIN, "x"), (G.PLAIN, "y")]
    assert main(f"<p>x</p><form><p>{prose}</form>") == [(G.MAIN, "x")]


def test_related_paragraphs_go_by_repetition(spark):
    rng = random.Random(5)
    text = lambda: " ".join("w%d" % rng.randrange(3000) for _ in range(30))
    same, own, story = text(), [text() for _ in range(10)], [text() for _ in range(10)]
    page = "<article><p>{}</p><p class='related'>{}</p><p class='related'>{}</p></article>"
    rows = [(i, f"https://a.example.com/{i}", page.format(story[i], own[i], same)) for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (G.SHARD_CHARS, 1000):
        got = {r.page_id: r.text for r in G.extract(df, shard_chars=shard).collect()}
        assert got == {i: f"{story[i]}\n\n{own[i]}" for i in range(10)}


def test_broken_markup_takes_linear_time():
    for t in ("<" * 200_000, '<a "' * 100_000, "<a '>" * 100_000, "<p>" * 100_000, "<div>" * 5_000, "</p>" * 100_000, "<!--" * 100_000,
              "<script>" * 50_000, "<form>" * 50_000, "<article><form></form>" * 30_000, '<p class="' + "nav-" * 100_000 + '">', "&" * 300_000, '<a b="x>' * 50_000):
        G.blocks_of(t)


def brute(streams):
    seen = {}
    for p, s in enumerate(streams):
        for i in range(len(s) - G.DEPTH + 1):
            seen.setdefault(tuple(s[i:i + G.DEPTH]), set()).add(p)
    out = []
    for s in streams:
        m = np.zeros(len(s), bool)
        for i in range(len(s) - G.DEPTH + 1):
            if len(seen[tuple(s[i:i + G.DEPTH])]) > 1:
                m[i:i + G.DEPTH] = True
        out.append(m.tolist())
    return out


def test_suffix_array_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        v = rng.choice([1, 2, 3, 50])
        run = [str(rng.randrange(v)) for _ in range(12)]
        streams = [[str(rng.randrange(v)) for _ in range(rng.randrange(0, 25))] + run[:rng.randrange(13)] for _ in range(rng.randrange(0, 6))]
        got = G.repeated_words(streams, np.zeros(0, np.uint64))
        assert [m.tolist() for m in got] == brute(streams)


SOUP = ("<div><div>Home News Sport Weather Travel Shop Mail Help Jobs</div><div><div>{body}</div></div>"
        "<div>All rights reserved by the owners of this very fine site and its friends</div></div>")


def test_unmarked_boilerplate_goes_by_repetition_across_shards(spark):
    rng = random.Random(6)
    body = lambda: " ".join("w%d" % rng.randrange(3000) for _ in range(40))
    rows = [(i, f"https://www.a.example.com:80/{i}", SOUP.format(body=body())) for i in range(40)]
    rows += [(100, "https://b.example.com/x", SOUP.format(body="only page of its host")), (101, None, None), (102, "", ""),
             (None, "nohost", "<p>x &amp; y"), (103, "https://c.example.com/1", SOUP.format(body="p q")),
             (103, "https://c.example.com/1", SOUP.format(body="p q")), (104, "https://d.example.com/", "<p>" + "long " * 100_000),
             (105, "https://a.example.com/z", "<article><p>" + SOUP[:60] + "</p></article>")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string")
    want = []
    for i, u, h in rows:
        blocks = G.blocks_of(h or "")
        if u and "a.example.com" in u and i != 105:
            want.append((i, u, blocks[1][1]))
        else:
            want.append((i, u, "\n\n".join(t for _, t in blocks)))
    for shard in (G.SHARD_CHARS, 2000):
        got = G.extract(df, shard_chars=shard).collect()
        assert sorted([(r.page_id, r.url, r.text) for r in got], key=str) == sorted(want, key=str)
        assert all(r.n_chars == len(r.text) for r in got)
    assert G.extract(df.limit(0)).count() == 0


class Plain(HTMLParser):
    """Text of the article elements of a page by the standard parser: blocks end at block tags."""

    BLOCK = {"article", "h1", "h2", "h3", "p", "ul", "ol", "li", "div", "blockquote", "section"}

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.held = 0, [], []
        self.feed(html)
        self.close()

    def block(self):
        text = " ".join("".join(self.held).split())
        self.out += [text] * bool(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.block()
        if tag == "br":
            self.held.append(" ")
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.block()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.held.append(data)


def test_query(spark, sf):
    rows = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = G.op1_html_extraction(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.url == rows[r.page_id].url and r.text
        assert r.text == "\n\n".join(Plain(rows[r.page_id].html).out) and r.n_chars == len(r.text)


def test_plain_story_beside_an_article_card(spark):
    """The array decides on plain blocks of every page, with an article or without."""
    rng = random.Random(11)
    text = lambda n: " ".join("w%d" % rng.randrange(3000) for _ in range(n))
    legal = "All rights reserved by the owners of this very fine site and its friends"
    story, card = [text(60) for _ in range(12)], [text(12) for _ in range(12)]
    page = "<div>{}</div><article class='card'><p>{}</p></article><div>{}</div>"
    rows = [(i, f"https://a.example.com/{i}", page.format(story[i], card[i], legal)) for i in range(12)]
    rows.append((20, "https://a.example.com/20", f"<article><p>{text(30)}</p></article><div>{card[3]}</div><div>{legal}</div>"))
    df = spark.createDataFrame(rows + [(21, "https://a.example.com/21", "")], "page_id long, url string, html string")
    for shard in (G.SHARD_CHARS, 1000):
        got = {r.page_id: r.text for r in G.extract(df, shard_chars=shard).collect()}
        assert {i: got[i].split("\n\n") for i in range(12)} == {i: [story[i], card[i]] for i in range(12)}
        assert got[20] == G.blocks_of(rows[-1][2])[0][1]  # a copy of another page's card goes from a plain block
