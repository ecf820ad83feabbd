import pytest

from tallyshelf.llm import html_text, html_tree

CASES = {
    "plain article": ("<html><body><nav>menu</nav><article><h1>T</h1><p>One  two<br>three</p><p>f<b>ou</b>r</article><footer>f</footer>", "T One two three four"),
    "references": ("<article><p>a &amp;amp; b&nbsp;&lt;c&gt; &copy &#233;&#x27;</p></article>", "a &amp; b <c> © é'"),
    "script and comment": ('<article><script>var t="</p>";</script><!-- no --><p>yes</p><style>p{}</style></article>', "yes"),
    "in-article noise": ('<article><header><h1>T</h1><p class="byline">by me</p></header><div class="share-buttons">share</div><p>body</p><aside>see</aside>'
                         '<form><input value=x>send</form><section id="comments"><p>first!</p></section><div class="ad">buy</div></article>', "T body"),
    "no article": ('<body><header>head</header><div class="sidebar">side</div><div id="content"><p>main text</p></div><div class="cookie-notice">ok?</div></body>', "main text"),
    "main with role": ("<div>top</div><div role=main><p>in main</p></div>", "in main"),
    "unclosed": ("<article><p>one<p>two <b>bold<ul><li>x<li>y</ul><div>z", "one two bold x y z"),
    "quoted bracket": ('<article><p title="a > b">t</p></article>', "t"),
    "apostrophe in a quoted value": ("""<article><p title="today's note">First words kept, it isn't lost</p><p>next</p></article>""",
                                     "First words kept, it isn't lost next"),
    "quote in a quoted value": ("""<article><p title='5" x 7'>a "b" c</p><p title="a" alt='"'>d</p></article>""", 'a "b" c d'),
    "apostrophe in a bare value": ("<article><p title=it's>don't go</p><p>next</p></article>", "don't go next"),
    "long quoted value": ("<article><p data-json='" + '{"a": "<b>"},' * 2000 + "' srcdoc=\"" + "<p>no</p> isn't " * 1000 + '">t</p></article>', "t"),
    "never closed": ("""<article><p title="a>one</p><p class='b>two</p></article>""", "one two"),
    "stray": ("</div><article></p>a < b </span>c</article>", "a < b c"),
    "hidden": ('<article><p hidden>no</p><p style="display: none">no</p><p>yes</p></article>', "yes"),
    "class on the article": ('<body class="has-sidebar ads"><article class="post comments-open"><p>kept</p></article></body>', "kept"),
    "plain text": ("just words", "just words"),
    "nothing": ("", ""),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b c"),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    html, want = CASES[name]
    assert html_tree.text(html) == want


def test_null_and_cut_pages():
    assert html_tree.text(None) == ""
    page = CASES["in-article noise"][0]
    for k in range(len(page)):
        html_tree.text(page[:k])
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert html_tree.text(deep) == "deep"
    assert len(html_tree.text("<article>" + "<p>word</p>" * 100_000 + "</article>")) == 5 * 100_000 - 1


def test_recurring_subtrees_go_and_content_stays(spark):
    box = "<div><b>Visit our shop</b> <span>today</span></div>"
    rows = [(i, f"https://Site.example:80/{i}", f"<body>{box}<div><p>story {i} of the day</p><p>A passage all share.</p></div></body>") for i in range(12)]
    rows += [(100 + i, f"https://other.example/{i}", f"<body>{box}<p>lone</p></body>") for i in range(2)]
    # Copies of one page make no template; nor do paragraphs inside articles, however often they recur.
    rows += [(200 + i, f"https://copies.example/{i}", "<body><div><p>same page</p></div></body>") for i in range(20)]
    rows += [(300 + i, f"https://art.example/{i}", f"<article><p>shared passage</p><div>box of the site</div><p>own {i}</p></article>") for i in range(12)]
    rows += [(400, None, "<p>no host</p>"), (401, "not a url", None), (402, "", ""), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, _page int")
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "html", "text", "_page", "text_1"]
    got = out.collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text_1"] for r in got}
    assert text[3] == "story 3 of the day" and text[100] == "Visit our shop today lone" and text[205] == "same page"
    assert text[304] == "shared passage own 4" and text[400] == "no host" and text[401] == text[402] == ""
    assert html_text.extract(pages.filter("false")).count() == 0


def test_template_is_a_share_of_the_host(spark):
    """What a few pages of a large host have in common is content; what nearly all of them have is template."""
    box = "<div><b>Visit our shop</b></div>"
    few = "<h2>Introduction</h2><table><tr><td>1</td></tr></table><ul><li>Salt</li></ul><div><p>A quoted passage.</p></div>"
    most = "<h2>References</h2>"
    page = lambda i: f"<body>{box}<p>story {i}</p>{few if i < 10 else ''}{most if i % 4 else ''}</body>"
    rows = [(i, f"https://large.example/{i}", page(i)) for i in range(100)]
    rows += [(200 + i, f"https://art.example/{i}", f"<article>{box}<p>own {i}</p>{few if i < 10 else ''}</article>") for i in range(100)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == "story 1 Introduction 1 Salt A quoted passage. References" and got[50] == "story 50 References"
    assert got[203] == "own 3 Introduction 1 Salt A quoted passage." and got[250] == "own 50"
