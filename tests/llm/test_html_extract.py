import html
import re

from boxloom.llm.html_extract import extract, main_text
from boxloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1><p>A slogan, with words, many words, and more of them, all over the page.</p></header>
<nav><ul><li><a href=/a>menu</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, yes, really, all the time, please accept them all.</p></div>
<article class="post"><h1>Head &amp; line</h1><p>First para, with   commas,
and an <a href=x>inner link</a>, long enough.<p>Second&nbsp;one.<div class="ad"><p>Buy, buy, buy it now.</p></div>
<ul><li>one<li>two</ul><form><p>Your mail, please, here, now.</p></form><script>if (a < b) { "</p>" }</script>
<blockquote>quoted, &#233;</blockquote><!-- no --></article>
<aside><p>Aside, aside, aside, with a lot of commas, and words.</p></aside>
<section id="comments"><h2>Comments</h2><p>I like this, it is a very long comment, from a reader, and more.</p></section>
<footer>&copy; us</footer></body></html>"""


def test_only_the_article_is_kept():
    assert main_text(PAGE).split("\n\n") == [
        "Head & line", "First para, with commas, and an inner link, long enough.", "Second one.", "one", "two", "quoted, é"]


def test_plain_containers_and_siblings():
    text = "Words, words and more words, so that this counts as a paragraph of prose, really."
    assert main_text(f"<div id=a><p>{text}</p><p>{text}</p></div><div class=links><a href=x>one</a> <a href=y>two</a></div>") == f"{text}\n\n{text}"
    assert main_text("no markup at all") == "no markup at all"


def test_defined_results_for_odd_pages(spark):
    odd = [None, "", "<p>", "<a<b>x", "<div>" * 3000 + "deep", "<!-- open", "<p>cut &am", "<script>var a", "&amp;&bogus; <",
           '<p title="a > b">q</p>', "<p>" + "word, " * 40_000]
    rows = [(i, f"u{i}", h, "extra") for i, h in enumerate(odd)] + [(None, None, "<p>x</p>", None)] * 2
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, tag string")).collect()}
    assert [got[i] for i in range(10)] == ["", "", "", "x", "deep", "", "cut &am", "", "&&bogus; <", "q"]
    assert got[10] == ("word, " * 40_000).strip() and got[None] == "x"
    assert extract(spark.createDataFrame([], "page_id bigint, html string")).count() == 0


def test_query_equals_a_plain_reading_of_the_layout(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op3_html_extraction"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", body))
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
        want = "\n\n".join(p for p in plain if p)
        assert r["text"] == want and r["n_chars"] == len(want)


PROSE = "The article itself, with words, many words, and more of them, over the whole line."


def test_code_in_raw_elements_is_no_markup():
    for code in ("<script>for(i=0;i<n;i++){t(i)}</script>", "<style>a{content:'<b'}</style>", "<script>x = '<!--'</SCRIPT >",
                 "<nav><script>if(a<b)c()</script></nav>", "<textarea><nav></textarea>", "<title>1 <b 2</title>"):
        assert main_text(f"<div><p>{PROSE}</p>{code}<p>{PROSE}</p></div>") == f"{PROSE}\n\n{PROSE}", code


def test_open_head_ends_at_the_body():
    for start in ("<body>", "", "<body class=x><div>"):
        page = f"<html><head><meta charset=utf-8><title>T</title><style>p{{}}</style>{start}<p>{PROSE}</p>"
        assert main_text(page) == PROSE, start


def test_open_furniture_ends_where_html_says():
    assert main_text(f"<div><p class=ad>Buy it.<p>{PROSE}<p>{PROSE}</div>") == f"{PROSE}\n\n{PROSE}"
    assert main_text(f"<div><p class=ad>Buy <label>it</label> now.<p>{PROSE}</div>") == PROSE
    assert main_text(f"<article><ul><li class=share>Share<li>{PROSE}</ul><p>{PROSE}</p></article>") == f"{PROSE}\n\n{PROSE}"
    assert main_text(f"<article><dl><dt class=ad>x<dd>{PROSE}</dl></article>") == PROSE
    assert main_text(f"<article><table><tr class=ad><td>x<tr><td class=ad>y<td>{PROSE}</table></article>") == PROSE
    assert main_text(f"<article><div><nav><ul><li><a href=x>menu</a></div><p>{PROSE}</p></article>") == PROSE
    assert main_text(f"<article><nav><p>a<nav>b</nav><p>c</nav><p>{PROSE}</p></article>") == PROSE


FOUR = "".join(f"<p>{PROSE}</p>" for _ in range(4))
WHOLE = "\n\n".join([PROSE] * 4)


def test_names_that_state_a_layout_lose_no_article():
    for name in ("content-wrap no-sidebar", "page has-sidebar", "post comments-open", "layout-with-sidebar", "sidebar", "widget", "menu-enabled"):
        assert main_text(f'<body><div class="{name}">{FOUR}</div><div class="footer"><p>Us.</p></div></body>') == WHOLE, name


def test_furniture_beside_an_article_word_goes():
    for name in ("main-nav", "main-menu", "article-share", "post-tags", "discussion", "comment-body", "sidebar-content", "entry-footer"):
        assert main_text(f'<div class="post">{FOUR}<div class="{name}"><p>Words, more of them, here.</p></div></div>') == WHOLE, name
    assert main_text(f'<div class=post><div class="post-header"><h1>Head</h1></div>{FOUR}</div>') == f"Head\n\n{WHOLE}"


def test_long_comments_do_not_replace_the_article():
    remarks = f"<div class=comments>{FOUR}{FOUR}</div>"
    assert main_text(f"<article>{FOUR}</article>{remarks}") == WHOLE
    assert main_text(f"<div>{FOUR}</div>{remarks}") == WHOLE


def test_hidden_elements_go():
    for tag in ("<div hidden>", '<div style="display: none">', "<div aria-hidden=true>", '<p class="hidden">', "<section style='visibility:hidden'>"):
        name = tag[1:].split()[0].rstrip(">")
        assert main_text(f"<article>{FOUR}{tag}Not, to be, seen.</{name}></article>") == WHOLE, tag


def test_short_siblings_of_the_article_stay():
    for before, after, want in (
            ("<div class=lead>In short.</div>", "", f"In short.\n\n{WHOLE}"), ("", "<ul><li>one<li>two</ul>", f"{WHOLE}\n\none\n\ntwo"),
            ("", "<div class=b><p>A short last word.</p></div>", f"{WHOLE}\n\nA short last word.")):
        assert main_text(f"<body>{before}<div class=b>{FOUR}</div>{after}</body>") == want
    between = f"<div class=b>{FOUR}</div><div class=x>So far.</div><div class=b>{FOUR}</div>"
    assert main_text(f"<body>{between}</body>") == f"{WHOLE}\n\nSo far.\n\n{WHOLE}"


def test_quotes_in_values_and_controls_in_paragraphs():
    assert main_text(f"<div><p title=it's>{PROSE}</p><p id=\"a>b\" title='x>y'>{PROSE}</p></div>") == f"{PROSE}\n\n{PROSE}"
    assert main_text(f"<div><p>{PROSE} <button>Press</button> and <label>name</label> go on.</p></div>") == f"{PROSE} and go on."
    assert main_text(f"<article>One part<nav>menu</nav>another part<p>{PROSE}</p></article>") == f"One part\n\nanother part\n\n{PROSE}"


def test_columns_named_like_the_result(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{FOUR}</article>", "old", 3)], "page_id long, url string, html string, text string, n_chars long")
    row = extract(df).first()
    assert (row["text"], row["n_chars"], row["url"]) == (WHOLE, len(WHOLE), "u")
