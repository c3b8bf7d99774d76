import html as entities
import re

from gleaner.llm import html
from gleaner.llm.queries import op4_html_text

PAGES = "page_id bigint, url string, html string, text string, host int"

SHELL = """<html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li>More</ul></nav>
<div class="cookie-notice">We use cookies here, do accept them please.</div>
<div class="layout"><div class="%s">%s</div><aside><p>Related things to read in the side bar</p></aside></div>
<section id="comments"><h2>Comments</h2><p>Nice one! I liked it very much, thank you for it.</p></section>
<form>Mail: <input><button>Send</button></form><footer>&copy; site</footer></body></html>"""


def _extract(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)
    return {r.page_id: r.text for r in html.extract_main_text(df).collect()}


def _text(page):
    reader = html.PageReader(page)
    return reader.text({reader.best()})


def test_article_without_its_surroundings():
    body = (
        "<h1>Title &amp; more</h1><p>First with <b>bold</b> text,\n  and&nbsp;space &eacute;&#8212;x."
        "<p>Second one, unclosed<br>after a break<ul><li>one<li>two</ul>"
        '<div class="ad-slot">Buy now</div><script>if(a<b){"</p>"}</script><!-- c --><blockquote>Quote</blockquote>'
        "<table><tr><td>a<td>b</table>"
    )
    assert _text(SHELL % ("post-12", body)).split("\n") == [
        "Title & more", "First with bold text, and space é—x.", "Second one, unclosed after a break",
        "one", "two", "Quote", "a", "b",
    ]


def test_broken_and_odd_pages():
    assert _text("") == "" and _text("<<<>>&&") is not None
    assert _text("plain words only") == "plain words only"
    assert _text("<p>a</p></div></p><p>b") == "a\nb"
    assert _text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert _text("<body><p>" + "long " * 100_000 + "</body>").count("long") == 100_000
    assert _text("<script>only code</script>") == ""


def test_names_do_not_hide_the_article():
    page = '<body><div class="content has-sidebar"><p>' + "The article itself. " * 20 + "</p></div></body>"
    assert _text(page).startswith("The article itself.")


def test_hosts_agree_on_a_path(spark):
    page = lambda main, side: (
        f'<body><div class="a1"><p>{main}</p></div><div class="b"><p>{side}</p></div></body>'
    )
    rows = [(i, "http://h.example/x", page(f"main {i} " * 30, "aside")) for i in range(6)]
    rows += [(6, "http://H.example:80/y", page("short main", "very long other text " * 20))]
    rows += [(7, "https://other.example/", page("short main", "very long other text " * 20))]
    rows += [(8, None, page("m " * 50, "")), (9, "http://h.example/", None), (10, "http://h.example/", "<p>no such path</p>")]
    rows += [(None, "http://h.example/", rows[0][2]), (0, rows[0][1], rows[0][2])]
    got = _extract(spark, rows)
    assert got[0] == ("main 0 " * 30).strip() and got[6] == "short main"
    assert got[7].startswith("very long") and got[8] == ("m " * 50).strip()
    assert got[9] == "" and got[10] == "no such path"
    assert _extract(spark, []) == {}


def test_given_pages(spark, sf_dir="/root/testdata/sf0.001"):
    out = {r.page_id: r for r in op4_html_text(spark, sf_dir).collect()}
    for page in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        lines = [" ".join(entities.unescape(p).split()) for p in parts]
        expected = "\n".join(line for line in lines if line)
        assert out[page.page_id].text == expected and out[page.page_id].n_chars == len(expected)


def test_longer_comments_are_not_the_article():
    article, remark = "The article itself. " * 20, "<p>A remark of some reader.</p>" * 60
    for name in ("comments", "sidebar", "related"):
        for page in ("<article><p>%s</p><div class=%s>%s</div></article>", "<div><p>%s</p></div><div class=%s>%s</div>"):
            assert _text("<body>" + page % (article, name, remark) + "</body>") == article.strip()
    wrapped = "<body class=comments-open><div class=comments-on><article><p>%s</p></article></div></body>"
    assert _text(wrapped % article) == article.strip()


def _prose(n, word="words"):
    return " ".join(f"{word} number {i} of the text." for i in range(n))


def test_no_part_of_an_article_is_left_out():
    lead, rest = _prose(8, "lead"), _prose(32, "rest")
    for page in (
        "<div class=page><div class=lead>%s</div><div class=rest>%s</div></div><nav>a b c</nav>",
        "<div><section><p>%s</p></section><section><p>%s</p></section></div><div class=ad>Buy this now.</div>",
        "<main><p>%s</p><div class=post-body><p>%s</p></div></main><div class=menu>One, two, three.</div>",
    ):
        assert _text("<body>" + page % (lead, rest) + "</body>") == f"{lead}\n{rest}"
    page = "<div class=post><h1>Title</h1><p>%s</p><div class=post-body><p>%s</p></div></div>"
    assert _text("<body><div>Site</div>" + page % (lead, rest)) == f"Title\n{lead}\n{rest}"
    titled = "<body><div>Site</div><div><h1>Title</h1><p>By me</p><div><p>%s</p><p>%s</p></div></div></body>"
    assert _text(titled % (lead, rest)) == f"Title\nBy me\n{lead}\n{rest}"
    assert _text(f"<body><h1>T</h1><article><p>{lead}</p></article></body>") == f"T\n{lead}"


def test_short_article_beside_a_long_sidebar():
    page = "<body><div class=story>%s</div><div class=sidebar><p>%s</p></div></body>"
    assert _text(page % ("It rained all day long.", _prose(40))) == "It rained all day long."
    assert _text(page % ("Rain", _prose(40))) == "Rain"
    assert _text("<body><nav>a</nav><div class=sidebar>" + _prose(5) + "</div></body>") == ""


def test_names_that_only_sound_like_noise():
    page = (
        "<article><p>%s</p><div class=no-ads><p>Kept one, as it is text.</p></div><p class=alert-level>Level three</p>"
        "<p>The <span class=alert-level>third</span> one.</p><div class=ad-slot>Buy this now, it is cheap.</div>"
        "<div class=ad-level-x>Buy</div></article>"
    )
    text = _prose(3)
    assert _text(page % text).split("\n") == [text, "Kept one, as it is text.", "Level three", "The third one."]


def test_links_and_imprints_do_not_widen_the_container():
    links = "".join(f"<p><a href=/{i}>Another story that one may read next.</a></p>" for i in range(9))
    page = f"<body><div>{links}</div><div class=x><p>{_prose(4)}</p></div><div>© 2020 Us. All rights reserved.</div></body>"
    assert _text(page) == _prose(4)


def test_host_with_pages_of_two_makes(spark):
    one = "<body><div class=a><p>%s</p></div><div class=z><p><a href=x>Read this other story of today.</a></p></div></body>"
    two = "<body><div class=b><h1>T</h1><section>%s</section><section>%s</section></div></body>"
    rows = [(i, "http://h.example/x", one % _prose(i + 2)) for i in range(5)]
    rows += [(i, "http://h.example/x", two % (_prose(2, "m"), _prose(i))) for i in range(5, 9)]
    got = _extract(spark, rows)
    assert all(got[i] == _prose(i + 2) for i in range(5))
    assert all(got[i] == f"T\n{_prose(2, 'm')}\n{_prose(i)}" for i in range(5, 9))
