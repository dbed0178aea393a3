"""Extraction from pages of known text."""

import html
import random

from pyspark.sql import functions as F

from loomstead.llm import pages


def test_blocks_and_boilerplate():
    text = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div id="cookie-bar">We use cookies</div><main><article class="post p12"><header><h1>Head &amp; <i>shoulders</i></h1></header><p>One<br>two &lt;b&gt; &eacute;&#x41;
    <p>Three <a href="/">link</a> 3 < 4<ul><li>x<li>y</ul><div class="ad">Buy</div><script>if (a < b) "</p>"</script><form>Name <input></form><!-- <p>no</p> -->Tail</article>
    <section class="comments"><p>First!</p></section></main><aside>Side</aside><footer>&copy;</footer></body></html>"""
    page = pages.read(text)
    got = page.text({page.propose()})
    assert got == "Head & shoulders\n\nOne two <b> éA\n\nThree link 3 < 4\n\nx\n\ny\n\nTail"
    for odd in ("", "<", "<p", "<p>a</", "a<script>b", "</div></div>x", "<!-- a", "<p class='", "&am", "<a<b>c"):
        pages.read(odd).propose()
    assert pages.read("<body><p>cut off in the mid").text({0}) == "cut off in the mid"


def test_provided_pages(spark, data):
    df = spark.read.parquet(f"{data}/pages.parquet")
    for r in pages.extract(df).join(df.select("page_id", F.col("html").alias("h")), "page_id").collect():
        body = r.h.partition("<article>")[2].partition("</article>")[0].partition("<footer")[0]
        want = [" ".join(html.unescape(x).split()) for x in body.replace("<b>", "").replace("<br>", "").replace("</p>", "<p>").replace("<h1>", "<p>").replace("</h1>", "<p>").split("<p>")]
        assert r.text == "\n\n".join(x for x in want if x), r.page_id
        assert r.n_chars == len(r.text)


def test_host_consensus_and_odd_rows(spark):
    rng = random.Random(0)
    words = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(n))
    rows, want = [], {}
    for i in range(30):
        want[i] = words(200 if i else 3)  # page 0 is short beside a long box that nothing marks
        rows.append((i, "http://h.org/a", f"<body><div class=x{i}><p>{want[i]}</p></div><div class=zz><p>{words(30)}</p></div></body>", "t"))
    rows += [(98, None, None, "t"), (98, None, "<p>a</p>", "t"), (None, "http://h.org", "", None), (97, "http://other.org", "<div><p>b b</p></div>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = pages.extract(df).collect()
    assert len(out) == len(rows)
    assert all(r.text == want[r.page_id] for r in out if r.page_id in want)
    assert sorted(r.text for r in out if r.page_id not in want) == ["", "", "a", "b b"]
    assert pages.extract(df.limit(0)).count() == 0


def test_rare_templates_vote(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(n))
    rows, want = [], []

    def page(host, template, n):
        want.append(words(n))
        rows.append((len(rows), f"http://{host}/a", f"<body><div class={template}><p>{want[-1]}</p></div><div class=zz><p>{words(30)}</p></div></body>"))

    for t in "abcdefghijklmnopqrstuvwxy":  # no template has a twentieth of the first host's pages, and one page is short
        for n in (200 if t > "a" else 3, 200, 200, 200):
            page("many.org", f"topic-{t}", n)
    for n in [200] * 120 + [3]:
        page("one.org", "usual", n)
    for n in (3, 200, 200):
        page("one.org", "rare", n)
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in sorted(out, key=lambda r: r.page_id)] == want


def test_nothing_but_boilerplate_is_lost():
    def got(x):
        page = pages.read(x)
        return page.text({page.propose()})

    whole = {
        '<main class="with-sidebar"><p>Text here.</p></main>': "Text here.",
        '<article class="post has-comments"><p>Text here.</p></article>': "Text here.",
        '<div id="notice-board"><p>Text here.</p></div>': "Text here.",
        '<form id="aspnetForm"><nav>Menu</nav><article><p>Text here.</p></article><input></form>': "Text here.",
        '<form id="aspnetForm"><div><p>Text here.</p></div></form>': "Text here.",
        '<div class="article-header"><h1>Title</h1></div><p>Text here.</p>': "Title\n\nText here.",
        "<p>Let <math><mi>x</mi></math> be <noscript>small</noscript> <object>and</object> <canvas>even</canvas></p>": "Let x be small and even",
        "<p>a<select><option>1</p><p>b</p>": "a\n\nb",
        "<object><p>a</p><p>b</p>": "a\n\nb",
        "<p data-x=it's>One don't</p><p>Two can't</p>": "One don't\n\nTwo can't",
        "<html><head><title>T</title><body><p>No end of head</p>": "No end of head",
        '<div class="comments"><p>Nothing else here.</p></div>': "Nothing else here.",
        '<div class="sidebar"><main><p>Odd.</p></main></div>': "Odd.",
        '<section><header><h2>Part</h2></header><p>Text.</p></section>': "Part\n\nText.",
        '<p title="a > b">Text.</p>': "Text.",
        '<p>Hello <span class="ad">Buy</span> world</p>': "Hello world",
        '<p>A <a class="share" href=x>Share</a> b</p><p>c</p>': "A b\n\nc",
        "<p>Click <button>here</button> now <b class=notice>!</b>or <label>later</label>.</p><p>d</p>": "Click now or .\n\nd",
        '<app-root class="layout"><p>a</p></app-root><p>b</p>': "a\n\nb",
        '<p>x</p><my-box class="ad"><p>a</p></my-box><p>b</p>': "x\n\nb",
    }
    assert {x: got(x) for x in whole} == whole
    article = "<article><p>The text of the article is here.</p></article>"
    for box in (
        '<div class="cookie-bar">Cookies?</div>', '<div id="cookieNotice">Cookies?</div>', '<form><p>Mail <input></p></form>', '<section id="comments"><p>' + "First! " * 40 + "</p></section>",
        '<div class="post-comments">Hi</div>', '<article class="comment">Hi</article>', '<div class="related-posts">More</div>', '<div class="sidebar-left">Side</div>', '<div role="search">Find</div>',
        '<ol class="commentlist"><li>Hi</ol>', "<select><option>a</select>", '<div id="header">Site</div>', '<span class="ad">Buy</span>', "<label>Name</label>", "<textarea>t</textarea>",
    ):
        assert got(f"<body>{box}{article}{box}</body>") == "The text of the article is here.", box
        assert got(f"<body><article>{article[9:-10]}{box}</article></body>") == "The text of the article is here.", box


def test_deep_nesting_takes_linear_room():
    n = 50_000
    page = pages.read("<div class=a>" * n + "<p>deep</p>" + "</div>" * n + "<p>end</p>")
    assert page.text({0}) == "deep\n\nend"
    assert len(page.candidates()) == n + 1
    assert pages.read("<b></i>" * n + "<ul><li>" * n + "x").text({0}) == "x"


def brute_vote(rows):
    """Each page's path by counting its host's proposals in plain Python."""
    read = [(r, pages.read(r.html or "")) for r in rows]
    host = lambda r: (r.url or "").partition("://")[2].partition("/")[0].lower() or None
    votes = {}
    for r, p in read:
        if host(r) and p.blocks:
            count = votes.setdefault(host(r), {})
            count[p.path(p.propose())] = count.get(p.path(p.propose()), 0) + 1
    out = []
    for r, p in read:
        full = {c for b in p.blocks for c in up(p, b[0])}
        own = {p.path(c) for c in full} & votes.get(host(r), {}).keys()
        path = min(own, key=lambda x: (-votes[host(r)][x], x)) if own else p.path(p.propose())
        text = p.text({c for c in range(len(p.parents)) if p.path(c) == path})
        out.append((r.page_id, text, path if text else None))
    return sorted(out, key=str)


def up(page, c):
    while c:
        yield c
        c = page.parents[c]
    yield 0


def test_votes_against_brute_force(spark, data):
    rng = random.Random(2)
    made = []
    for i in range(300):
        boxes = [f"<div class={rng.choice('abcd')}{rng.randrange(9)}>" + "<p>word word</p>" * rng.randrange(6) + "</div>" for _ in range(rng.randrange(5))]
        made.append((f"p{i}", f"http://h{rng.randrange(6)}.org/x" if i % 9 else None, f"<body><section class={rng.choice('xy')}>{''.join(boxes)}</section>{''.join(boxes[:1])}</body>" if i % 11 else None))
    for df in (spark.createDataFrame(made, "page_id string, url string, html string"), spark.read.parquet(f"{data}/pages.parquet")):
        got = pages.extract(df).collect()
        assert sorted(((r.page_id, r.text, r.path) for r in got), key=str) == brute_vote(df.collect())
