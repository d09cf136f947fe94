from tidemark.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="with-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href=x>Menu, one.</a></li></ul></nav><div class="cookie-notice">We use cookies, yes.</div>
<!-- ad --><div class="layout"><div id='content'><h1>The   head</h1><p>First <b>bo</b>ld &amp; text, with commas, and more words here.<br>Second&nbsp;line.
<p>Third, unclosed paragraph; it has words.</p><blockquote>Said &quot;so&quot;.</blockquote><p>Tiny</p><form><input value=1><button>Send, now.</button></form></div>
<div class="sidebar"><p>Related, links, here.</p></div></div><div class="comments"><p>Nice, very nice, comment, indeed it is so long that it wins.</p></div><footer>&copy; x</footer></body></html>"""


def test_article_alone_in_page_order():
    assert h.main_text(PAGE) == 'The head First bold & text, with commas, and more words here. Second line. Third, unclosed paragraph; it has words. Said "so". Tiny'


def test_layouts_around_an_article():
    page = '<div class="page withSidebar"><article class="post"><p>Text, one.</p><p>Text, two.</p></article><div class="sidebar"><p>Side, one.</p></div><section id="userComments"><article><p>Comment, one, and so on.</p></article></section></div>'
    assert h.main_text(page) == "Text, one. Text, two."


LONG = "A long sentence, with commas, that is the text of the article; it goes on."
PAR = f"<p>{LONG}</p>"
SCORED = [  # page, and its main text with L for LONG
    (f"<article class='post comments-open'>{PAR * 3}</article>", "L L L"),
    (f"<article class='article tags-none'>{PAR * 3}</article>", "L L L"),
    (f"<form id=aspnetForm><nav>Menu, a.</nav><div class=sidebar>Side, one.</div><div id=main><h1>Head</h1>{PAR * 3}</div></form>", "Head L L L"),
    (f"<div class=a>{PAR * 9}</div><div class=b>{PAR * 2}</div>", " ".join("L" * 11)),
    (f"<div><p class=it's>{LONG}</p><p class=\"x>{LONG}</p><p title='a > b'>{LONG}</p></div>", "L L L"),
    (f"<div id=story><h1>Head</h1><p class=lead>{LONG}</p><div class=entry>{PAR * 9}</div></div>", "Head " + " ".join("L" * 10)),
    (f"<div class='content with-sidebar'>{PAR * 4}</div>", "L L L L"),
    (f"<body><h1>Head</h1>{PAR * 3}<ul><li>One</li></ul><div class=box>Links</div></body>", "Head L L L One"),
    (f"<article>{PAR * 3}<section class=comments>{PAR * 9}</section></article><article class=comment>{PAR * 2}</article>", "L L L"),
    (f"<article>{PAR * 3}<form><p>Send, us.</p></form></article>", "L L L"),
    (f"<div id=w><div class=box>Home News</div><h1>T</h1><div class=entry>{PAR * 3}<h2>Sub</h2><p>Tiny</p><ul><li>a</li></ul></div><div class=x9>Other, links</div></div>", "T L L L Sub Tiny a"),
    (f"<main><header><h1>T</h1></header>{PAR}<div class='share-buttons'>Share, it.</div>{PAR}</main><div class=b>{PAR}</div>", "T L L"),
    (f"<div class=wrap><table><tr><td class=side><ul><li>A</li><li>B</li></ul></td><td>{PAR * 4}<blockquote>{LONG}</blockquote></td></tr></table></div>", None),
    (f"<div hidden>{PAR * 5}</div><div>{PAR * 2}</div><div style='display: none'>{PAR}</div><div role=navigation>{PAR}</div>", "L L"),
]


ARTICLE = f"<article>{PAR * 3}</article>"
MARKED = [  # marks in class and id are evidence; what an element holds decides
    (f"<div class='site cookie-consent-active'>{ARTICLE}</div>", "L L L"),
    (f"<div class='site cookie-consent-active'><main>{PAR * 3}</main><div class=sidebar>{PAR * 2}</div></div><footer>{PAR}</footer>", "L L L"),
    (f"<div class='newsletter-popup-visible'><main>{PAR * 3}</main></div>", "L L L"),
    (f"<div class='cookie-consent-active'><div class=newsletter-popup-visible>{ARTICLE}</div><div id=comments>{PAR * 9}</div></div>", "L L L"),
    (f"<div class='social-policy'>{PAR * 3}</div>", "L L L"),
    (f"<nav>Home</nav><div class='html-tags-guide'>{PAR * 3}</div><div class='cookie-notice'>We use cookies, yes.</div>", "L L L"),
    (f"<div class='theme-legal content'><h1>T</h1>{PAR * 3}</div>", "T L L L"),
    (f"<article>{PAR * 3}<section id=discussion><h2>Discussion</h2>{PAR * 2}</section></article>", "L L L Discussion L L"),
    (f"<article>{PAR * 3}<section id=discussion><ol><li>{PAR}</li><li>{PAR}</li></ol></section></article>", "L L L"),
    (f"<article>{PAR * 3}<section class=discussion><div class=c><b>Ann</b>{PAR}</div><div class=c>{PAR}</div></section></article>", "L L L"),
    (f"<div class=post><header><h1>Title</h1></header>{PAR * 3}</div>", "Title L L L"),
    (f"<div id=wrap><header><h1>Site</h1></header><div class=post>{PAR * 3}</div></div>", "L L L"),
    (f"<div id=content>{PAR * 3}</div><div class=comments>{f'<article class=comment-body>{PAR}</article>' * 9}</div>", "L L L"),
    (f"{ARTICLE}<div class=related>{f'<article>{PAR}</article>' * 9}</div>", "L L L"),
    (f"<form>{PAR * 3}</form><div class=cookie-notice>{PAR}</div>", "L L L"),
    # content paths decide: lists of names, links and figures are longer than the text, but no content
    (f"<div class=entry>{PAR * 3}</div><div class=b><ul>{'<li><a href=x>The name of another page of this site</a></li>' * 40}</ul></div>", "L L L"),
    (f"<div class=cloud>{'<a href=x>a topic of many words that is linked</a> ' * 40}</div><div class=entry>{PAR * 3}</div>", "L L L"),
    (f"<table><tr><td>{'<a href=x>Names of sections without marks</a><br>' * 40}</td><td><div>{PAR * 3}</div></td></tr></table>", "L L L"),
    (f"<div class=entry>{PAR * 3}</div><div class=data><table>{'<tr><td>Quantity sold in a month of the year</td><td>12 000 000</td></tr>' * 30}</table></div>", "L L L"),
    (f"<div class=share-bar>{'<span>Send this page to someone you know</span> ' * 40}</div><div class=entry>{PAR * 3}</div>", "L L L"),
    (f"<div>{PAR * 3}</div><div class=widget>{'<span>Name of a page without marks</span><br>' * 40}</div>", "L L L"),
]


def test_marked_pages():
    for page, want in MARKED:
        assert h.main_text(page).replace(LONG, "L") == want, page


def test_path_ratios_decide(monkeypatch):
    """With the ratios put out of work, either way, pages come out otherwise."""
    pages = [p for p, _ in SCORED + MARKED]
    scored = [h.main_text(p) for p in pages]
    for content in (lambda p, kept, params: set(kept), lambda p, kept, params: set()):
        with monkeypatch.context() as m:
            m.setattr(h, "_content", content)
            assert sum(h.main_text(p) != x for p, x in zip(pages, scored)) >= 4


def test_nested_marks_take_time_in_proportion():
    import time

    def seconds(n):
        t = time.perf_counter()
        h.main_text("".join(f"<div class='{'social' if k % 2 else 'sidebar'}'><article>Text, {k}, and more." for k in range(n)) + "<b>x, y." * n)
        return time.perf_counter() - t

    seconds(100)
    assert seconds(16_000) < 8 * seconds(4_000) + 1


def test_scored_pages():
    for page, want in SCORED:
        got = h.main_text(page).replace(LONG, "L")
        if want is None:
            assert got.count("L") == 5
        else:
            assert got == want, page


def test_every_article_of_the_sample(spark):
    """The sample's pages hold their text in one article element."""
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect():
        inner = re.search("<article>(.*)</article>", r[0], re.S)[1]
        want = html.unescape(re.sub("</?(?:p|h1|br|li|ul)>", " ", inner).replace("<b>", "").replace("</b>", ""))
        assert h.main_text(r[0]) == " ".join(want.split())


def test_deep_and_broken_pages_are_linear():
    n = 100_000
    assert h.main_text("<div>" * n + "deep, text." + "</div>" * n) == "deep, text."
    assert h.main_text("<span>" * n + "<div>x, y.</div>" * 1000 + "</b>" * n).count("x, y.") == 1000
    assert h.main_text("<p a='" * 20_000 + "x") is not None


def test_odd_pages(spark):
    assert h.main_text(None) == h.main_text("") == h.main_text("<script>x") == h.main_text("<!-- x") == ""
    assert h.main_text("just text &am more") == "just text &am more"
    assert h.main_text("<article><h1>A</h1><p>b</article>") == "A b"
    assert h.main_text("<p>" * 3000 + "deep, text.") == "deep, text."
    assert h.main_text("a <b <i>c") is not None
    rows = [(1, "u", PAGE, 3), (2, None, None, 3), (None, "u", "x" * 200_000, 3), (1, "u", PAGE, 3)]
    got = h.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert h.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_stray_end_tags_in_deep_pages_take_time_in_proportion():
    import time

    def seconds(n):
        t = time.perf_counter()
        h.main_text("<i><article>" + "<div>" * n + "Text, that is long enough to count as such." + "</i>" * n)
        return time.perf_counter() - t

    seconds(100)
    assert seconds(16_000) < 8 * seconds(4_000) + 1
