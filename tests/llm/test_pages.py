import random
import time

import pytest

from ionquill.llm import pages

RNG_WORDS = "river stone under amber light walked slowly toward quiet harbour while gulls & terns cried over <waves> and sails".split()


def words(rnd, n):
    return " ".join(rnd.choice(RNG_WORDS) for _ in range(n)) + "."


def escaped(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&#62;")


def page(rnd, article=True, ends=True):
    blocks = [words(rnd, rnd.choice([1, 4, 60, 150])) for _ in range(rnd.randint(3, 12))]
    links = "".join(f'<li><a href="/{k}">{words(rnd, 1)}</a></li>' for k in range(6))
    body = f"<h1>{escaped(blocks[0])}</h1>\n"
    for k, b in enumerate(blocks[1:]):
        body += f"<p>{escaped(b)}</p>" if k % 3 else f"<p><b>{escaped(b)}</b><br>\n"
        if k == 1:
            body += f'<div class="advert-box"><p>{words(rnd, 30)}</p></div><aside>{words(rnd, 40)}</aside>'
    tag = "article" if article else 'div id="content"'
    html = f"""<!DOCTYPE html><html><head><title>{escaped(blocks[0])}</title><style>p{{x:1}}</style><script>var t="</p>";</script></head><body>
      <header><h2>{words(rnd, 3)}</h2></header><nav><ul>{links}</ul></nav><div class="cookieNotice">{words(rnd, 50)}</div>
      <{tag}>{body}</{tag.split()[0]}><!-- {words(rnd, 9)} --><form><p>{words(rnd, 20)}</p><button>{words(rnd, 1)}</button></form>
      <section id="comments"><article class="comment"><p>{words(rnd, 80)}</p></article></section><ul class="related">{links}</ul>
      <footer>&copy; {words(rnd, 20)}"""
    return html + "</footer></body></html>" * ends, "\n\n".join(blocks)


@pytest.mark.parametrize("seed", range(30))
def test_extracts_just_the_article(seed):
    html, want = page(random.Random(seed), ends=seed % 2 == 0)
    assert pages.extract(html) == want


PARAGRAPH = "<p>" + "Slow water moved under the old bridge while gulls cried over the harbour wall. " * 6 + "</p>"


@pytest.mark.parametrize("inside,kept", [
    (f'<div class="related-work">{PARAGRAPH}</div>', True), ('<div class="related-work"><p>See also this.</p></div>', False),
    ('<p id="social-policy">' + PARAGRAPH[3:], True), ('<ul><li><a href="/a">A link of some words</a><li><a href="/b">Another link of words</a></ul>', False),
    ('<p>Short.</p>', True), (f'<section data-kind="x">{PARAGRAPH}</section>', True),
])
def test_ratios_decide_within_an_article(inside, kept):
    html = f"<article><h1>Title</h1>{PARAGRAPH * 3}{inside}{PARAGRAPH}</article>"
    got = pages.extract(html)
    assert got.count("\n\n") == 4 + kept
    if not kept:  # without ratios, the outcome is another
        assert pages.extract(html, ratio_of=lambda line: 1.0) != got


def test_pages_without_names():
    html = f'<body><div>Home and more</div><div><h1><a href="/">A linked headline</a></h1>{PARAGRAPH * 3}<p>End.</p></div><div>Made by us in some year</div></body>'
    got = pages.extract(html).split("\n\n")
    assert got[0] == "A linked headline" and got[-1] == "End." and len(got) == 5


def test_time_is_linear_in_nesting():
    began = time.time()
    assert pages.extract("<div>" * 20_000 + "word" + "</p>" * 20_000) == "word"
    assert pages.extract("<div><b>" * 10_000 + "word" + "</i></div>" * 10_000) == "word"
    assert time.time() - began < 4


@pytest.mark.parametrize("seed", range(30))
def test_pages_without_an_article_element(seed):
    html, want = page(random.Random(seed), article=False)
    assert pages.extract(html) == want


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"), ("<nav>menu</nav>", ""), ("<script>x", ""),
    ("<article>a &eacute;&#x2014;&nbsp;b\n  c</article>", "a é— b c"), ("<article><p>one<br>two</p><ul><li>x<li>y</ul></article>", "one two\n\nx\n\ny"),
    ("</div></p><article><p>x</b></p></div></article>", "x"), ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b\n\nc"),
    ("<main><p>t</p><div hidden>no</div><div style='display: none'>no</div></main>", "t"),
    ("<div class='with-sidebar'><article><p>x</p><div class='ad'>no</div></article><div class='sidebar'>no</div></div>", "x"),
    ("<div class='wrap sidebar-left'><p>x y z</p></div>", "x y z"), ("<div id='comments'><article><p>talk</p></article></div><p>own</p>", "own"),
    ("<div class='sidebar'><main><p>x</p></main>no</div>", "x"), ("<article><div class='post-header'><h1>T</h1><span>by me</span></div><p>x</p></article>", "T\n\nx"),
    ("<article><header><h1>T</h1><p>by me</p></header><p>x</p></article>", "T\n\nx"),
])
def test_small_pages(html, want):
    assert pages.extract(html) == want


def test_pages_table(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 5000 + "</article>"
    rows = [(1, "u", "<p>a</p>", 1), (1, "u", "<p>a</p>", 1), (2, None, None, 2), (None, "v", "", 3), (4, "w", long, 4)]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(p, u, t := pages.extract(h), len(t)) for p, u, h, _ in rows], key=str)
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
