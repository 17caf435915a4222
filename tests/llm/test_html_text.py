import html
import re
import time

import pandas as pd
import pytest

from wireloom.llm import html_text
from wireloom.llm.html_text import extract

BODY = "<p>First, a paragraph of some length; it has points.</p><p>Second one, also with several words.</p>"
TEXT = "First, a paragraph of some length; it has points.\nSecond one, also with several words."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<html></html>", ""), ("plain text", "plain text"), ("a < b and c", "a < b and c"),
        (f"<article>{BODY}</article>", TEXT),
        (f"<nav><ul><li><a href=/>Home</a></ul></nav><header><h1>Site</h1></header><article><h1>Title</h1>{BODY}</article><footer>&copy; us, all rights.</footer>", "Title\n" + TEXT),
        (f"<aside>Side, text here.</aside><main>{BODY}<form><label>Name, please.</label><input></form></main>", TEXT),
        (f'<article>{BODY}<div class="ad">Buy, now, today.</div><div id="comments"><p>Nice, post, indeed.</p></div></article>', TEXT),
        (f'<div class="cookie-notice">We use cookies, accept, please.</div><div role=navigation>a b</div><article>{BODY}</article>', TEXT),
        (f'<script>var a="</p>";</script><style>p{{x:y}}</style><!-- <p>no, no</p> --><noscript>none, of it</noscript><article>{BODY}<script>1<2</script></article>', TEXT),
        ("<article><h1>A &amp; B &lt;c&gt;</h1><p>x&nbsp;y\n\t z &eacute;&#233;, and more.</article>", "A & B <c>\nx y z éé, and more."),
        ("<article><p><b>Bold, start.<br><p>Next, one.<li>item, one<li>item, two</article>", "Bold, start.\nNext, one.\nitem, one\nitem, two"),
        (f"<div><div class=menu>one two three</div><div id=c><h2>Head</h2>{BODY}</div><div class=footer>(c) us.</div></div>", "Head\n" + TEXT),
        (f"<div class=ad><article>{BODY}</article>", TEXT),
        (f'<div id="header"><h1>Site, of things.</h1></div><div id=c><div class="post-header"><h1>Own</h1></div>{BODY}</div><ol class="commentlist"><li>Good, one, yes.</ol>', "Own\n" + TEXT),
        (f"<ARTICLE>{BODY.upper()}</ARTICLE>", TEXT.upper()),
        ("<article><p>in<b>li</b>ne, <i>words</i> here.</p></article>", "inline, words here."),
        (f"<article>{BODY}", TEXT), (f"</div></p>{BODY}</article>", TEXT),
        ("<article><p>Text, that <a href='x>y'>links</a> on.</p></article>", "Text, that links on."),
        ("<p>unended, tag <b", "unended, tag <b"),
    ],
)
def test_pages(page, text):
    assert extract(page) == text


def test_articles_of_the_test_pages():
    """The whole article of each page, found by its tags, which the extractor may not rely on alone."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    for page in pages:
        article = re.search("<article>(.*?)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article)]
        want = "\n".join(filter(None, blocks))
        assert extract(page) == want
        # without the semantic element the ratios alone find it
        assert extract(page.replace("<article>", "<div>").replace("</article>", "</div>")) == want


def test_table(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "x"), (1, "u", f"<article>{BODY}</article>", "x"), (2, None, None, "x"), (None, "v", "t", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted(map(tuple, html_text.texts(df).collect()), key=str)
    assert found == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "v", "t", 1)], key=str)
    assert html_text.texts(df.limit(0)).collect() == []


def test_very_long_page():
    assert extract("<article>" + "<p>Some, words here.</p>" * 50000 + "</article>").count("\n") == 49999
    assert extract("<div>" * 3000 + "deep, text." + "</div>" * 3000) == "deep, text."


def test_parts_in_sibling_containers_are_kept():
    long, short = "A sentence of the article, with points. " * 15, "A shorter paragraph, with points too. " * 4
    many = f"<p>{long}</p>" * 5
    line = " ".join(long.split())
    found = extract(f"<article><h1>Title</h1><p class=lead>The lead, in short.</p><div class=body>{many}</div></article>")
    assert found.split("\n") == ["Title", "The lead, in short.", *[line] * 5]
    for outer in ("article", "div"):
        found = extract(f"<{outer}><section>{many}</section><section>{f'<p>{short}</p>' * 3}</section></{outer}>")
        assert found.split("\n") == [line] * 5 + [" ".join(short.split())] * 3


LONG = "A sentence of the article, with points. " * 8
LINE = " ".join(LONG.split())
JUNK = "<div class=q9><a href=x>JUNKLINK</a></div>"


@pytest.mark.parametrize("outer", ["body", "div", "article"])
def test_ratios_choose_the_blocks(monkeypatch, outer):
    """Nothing names the junk; only its path's ratios tell it."""
    page = f"<{outer}><p>{LONG}</p>{JUNK}<p>{LONG}</p><ul class=z><li><a>one</a><li><a>two</a></ul></{outer}>"
    assert extract(page) == f"{LINE}\n{LINE}"
    monkeypatch.setattr(html_text, "ratios", lambda nodes, found: [1.0] * len(found))
    assert "JUNKLINK" in extract(page)


def unmarked(page):
    """The page without what marks its article and its advert: elements without meaning, names that say nothing."""
    for a, b in {"<article>": '<div class="q3">', "</article>": "</div>", '<div class="ad">': '<div class="q2">'}.items():
        page = page.replace(a, b)
    return page


def test_ratios_on_unmarked_pages(monkeypatch):
    """Without any mark ratios find most articles alone, the others with a short block more; no article loses text."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    want = [extract(page) for page in pages]
    found = [extract(unmarked(page)) for page in pages]
    assert sum(a == b for a, b in zip(found, want)) > 0.7 * len(pages)
    assert sum(set(b.split("\n")) <= set(a.split("\n")) for a, b in zip(found, want)) >= 0.99 * len(pages)
    monkeypatch.setattr(html_text, "ratios", lambda nodes, found: [1.0] * len(found))
    for change in (str, unmarked):
        assert not any(extract(change(page)) == b for page, b in zip(pages, want))


def test_ratios_match_a_plain_sum():
    """Bottom-up sums and fused ratios against sums taken anew for each path, over all blocks under it."""
    page = f"<body><div class=a><h2>Head</h2><p>{LONG}</p><p>Short, one.</p><ul><li><a>x</a> y<li>z.</ul></div><div class=b><section><p>{LONG[:80]}</p></section></div><div class=a><p>More, of it.</p></div><p>Last <a>link</a></p>"
    scanner = html_text.Scanner(page)
    scanner.run()
    fused = html_text.ratios(scanner.nodes, scanner.found)
    points = lambda t: sum(c in html_text._PUNCTUATION for c in t)

    def ends(node):
        while node:
            yield node
            node = node.parent

    def under(path):
        some = [b for b in scanner.found if any(n.path == path for n in ends(b[0]))]
        return len(some), sum(len(p) for _, _, p in some), sum(points(p) for _, _, p in some), sum(len(t) for _, t, _ in some)

    def ratio(node):
        n, length, marks, _ = under(node.path)
        around = next((e for e in ends(node.parent) if e.hold is e), None)
        if around is None or around.tag in ("", "html", "body"):
            return length / n, marks / n
        m, more, points_, _ = under(around.path)
        return (2 * length / n + more / m) / 3, (2 * marks / n + points_ / m) / 3

    def held(node):
        if node.tag not in html_text._HEADINGS:
            return next(e for e in ends(node) if e.hold is e)
        return next(e for e in ends(node) if e.hold is e and any(e in ends(b[0]) and b[0].tag not in html_text._HEADINGS for b in scanner.found))

    every = [ratio(held(b[0])) for b in scanner.found]
    most = [max(x) + 0.1 for x in zip(*every)]
    whole = sum(len(t) for _, t, _ in scanner.found)
    for (node, _, _), (a, b), got in zip(scanner.found, every, fused, strict=True):
        want = ((a + 0.1) / most[0] * (b + 0.1) / most[1] * under(held(node).path)[3] / whole) ** 0.5
        group = node if node.tag in html_text._HEADINGS else next(e for e in ends(node) if e.tag in html_text._LISTS or e.hold is e)
        _, plain, _, text = under(group.path)
        assert got == pytest.approx(want * (0.05 + 0.95 * plain / text))


@pytest.mark.parametrize("paragraph", ['<p data-id="ad-1">', '<p class="social-science">', '<p class="alert-theory">', "<p><video src=x>", "<p class='content-first ad2x'>", "<p title='a > b'>", "<p don't>"])
def test_no_text_is_lost_to_names(paragraph):
    assert extract(f"<article><p>{LONG}</p>{paragraph}{LONG}</p></article>") == f"{LINE}\n{LINE}"
    assert extract(f"<div><p>{LONG}</p>{paragraph}{LONG}</p></div>") == f"{LINE}\n{LINE}"


def test_named_and_closed_parts_are_left_out():
    for junk in ['<div class="reader-comments"><p>%s</p></div>', '<section id=comments><article class=comment><p>%s</p></article></section>', "<aside><article><p>%s</p></article></aside>", '<div class="cookie-notice box">%s</div>', '<div role="dialog"><p>%s</p></div>']:
        assert extract(f"<body><div class=c><p>{LONG}</p></div>{junk % LONG}") == LINE
        assert extract(f"<body><article><p>{LONG}</p></article>{junk % LONG}") == LINE
    assert extract(f"<form><article><p>{LONG}</p></article></form>") == LINE


@pytest.mark.parametrize("page", ["<div>x", "<a '", "<a ='", "<a ='>", "<div><h1>a", "<b><h1>x", "<li>a<b>", "<video>x", "<!--", "<td>x<p>", "<nav><article>x", "</p></b>", "<ul><li>x"])
def test_time_is_linear(page):
    def took(n):
        began = time.process_time()
        extract(page * n)
        return time.process_time() - began

    took(100)
    assert took(40000) < 12 * max(took(8000), 0.02)
