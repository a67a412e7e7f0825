import pytest

from pitspark.llm.extraction import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head>
<body class="has-sidebar"><header><a href="/">Site</a> of news, and more.</header><nav><ul><li><a href="/a">The</a></li><li>Other</li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy this, now. Buy it.</div>{}<aside><p>Long side text, with commas, and dots. And more of it, too.</p></aside>
<div class="cookie-notice"><p>We use cookies, sorry.</p></div><form><p>Your name, please.</p><input name="x"></form>
<section id="comments"><h2>Comments</h2><p>First! Great, great read, thank you so much for it.</p></section><footer>&copy; me &middot; all.</footer></body></html>"""


@pytest.mark.parametrize("body,want", [
    ("<article><h1>Head  line</h1><p><b>One &amp; two.<br>\n three<p>Four</p><p>Sh.</p></article>", "Head line\nOne & two. three\nFour\nSh."),
    ("<main><h1>H</h1><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><blockquote>q</blockquote><pre>x  y</pre></main>", "H\na\nb\n1\n2\nq\nx y"),
    ("<article><header><h1>In</h1></header><div><div><div><p>deep</p></div></div></div><p>A long paragraph, with marks, and more. Yes.</p><div class='share'>Share me</div><form>send</form></article>", "In\ndeep\nA long paragraph, with marks, and more. Yes."),
    ("<article><p>One</p><div class=comments><article class=comment><p>me</p></article></div></article>", "One"),
    ("<div id=content><h2>Sub</h2><p>Text in a plain box, long enough, with marks. And another sentence here.</p><p>x</p></div><div><a href=x>one</a></div>", "Sub\nText in a plain box, long enough, with marks. And another sentence here.\nx"),
    ("<article><p>a &lt;b&gt; &#233; &eacute; &nbsp;c</p><p hidden>no</p><script>if (a<b) x('</article>')</script><p>d", "a <b> é é c\nd"),
    ("", ""),
])
def test_blocks(body, want):
    page = PAGE.replace("{}", body, 1)
    if body.endswith("<p>d"):
        page = page[: page.index(body) + len(body)]
    assert main_text(page) == want


LONG = "<p>" + "A long sentence of the text, with marks, and more. And another one, for weight. " * 6 + "</p>"


@pytest.mark.parametrize("body", [
    f"<div class='content has-sidebar'><article>{LONG}</article></div>",
    f"<div class='content has-sidebar'><div>{LONG}</div></div>",
    f"<div class='sidebar'><article>{LONG}</article></div>",
    f"<form id=form1><main>{LONG}</main></form>",
    f"<form id=form1><div class=widget>{LONG}</div></form>",
    f"<div id=content>{LONG}</div><article class=card><h3>Other</h3><p>A teaser, short.</p></article>",
    f"<div class='content widget'>{LONG}</div><article class=card><h3>Other</h3><p>A teaser, short.</p></article>",
])
def test_names_and_teasers_do_not_hide_the_text(body):
    assert main_text(PAGE.replace("{}", body, 1)) == main_text(LONG)


def test_parts_of_an_article_named_like_its_surroundings_stay():
    body = f"<article>{LONG}<section id='related-work'><h2 id='social-impact'>Social impact</h2><p>Earlier work, in short.</p></section><h2 id=comments>Comments on it</h2><div class='share-links'>Share me</div></article>"
    assert main_text(PAGE.replace("{}", body, 1)).split("\n")[1:] == ["Social impact", "Earlier work, in short.", "Comments on it"]


@pytest.mark.parametrize("source", [None, "", "plain", "<", "<p", "</p></p>", "<a href=\"x>y", "<!-- open", "<script>x", "<" * 50_000, "<p>" * 20_000 + "deep", "<div>" * 50_000 + "x", "\x00<p>\x00", "<p a='" + "b" * 100_000])
def test_broken_sources_end(source):
    assert isinstance(main_text(source), str)


def test_rows(spark):
    long = "<article>" + "<p>word, word.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "u", PAGE.replace("{}", "<article><p>x é</p></article>"), "old"), (1, "u", PAGE.replace("{}", "<article><p>x é</p></article>"), "old"), (None, None, None, None), (2, "v", "", "z"), (3, "w", long, "z")],
                               "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extract(df).collect()), key=str)
    assert [(g[0], g[1], g[2], g[3]) for g in got if g[0] != 3] == [(1, "u", "x é", 3)] * 2 + [(2, "v", "", 0), (None, None, "", 0)]
    assert [len(g[2].split("\n")) for g in got if g[0] == 3] == [20_000]
    assert extract(df.limit(0)).count() == 0
