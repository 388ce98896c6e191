import random
import time

import pytest

from afterbell.llm.html import decoded, extract_pages, host_of, page_blocks

ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";track(0);</script></head>
<body class="no-sidebar"><nav><ul><li><a href="/a>b">Menu</a></ul></nav><!-- ad > --><div class="ad">Buy <b>now</div>
<header><h1>Site</h1></header><div class="cookie-notice"><p>Cookies</p></div>
<article><header><h1>Head&shy;line &lt;1&gt;</h1></header><p><b>First
  para<br>graph &amp; more&nbsp;text<p>Second &am<script>x</script> one<aside>Side</aside>
<ul><li>One<li>Two</ul><form>Name <input></form><table><tr><td>a<td>b<tr><td>c</table>
<section class="comments"><p>Nice!</p></section><p class="share">Share<p>Last</article>
<div id="sidebar">Links</div><footer>&copy; F</footer></body></html>"""


def test_blocks_of_an_article():
    main, free = page_blocks(ARTICLE)
    assert main == ["Head\xadline <1>", "First para graph & more text", "Second &am one", "One", "Two", "a b", "c", "Last"]
    assert free == []


def test_odd_markup():
    assert page_blocks("just text < 5 & more") == ([], ["just text < 5 & more"])
    assert page_blocks("<p>a<!-- open") == ([], ["a"])
    assert page_blocks("<p title='x>y' data=\"'\">a</p></div></p>b") == ([], ["a", "b"])
    assert page_blocks("<article></article><div>x</div>") == ([], ["x"])
    assert page_blocks("<p class=ad>x<p>y") == ([], ["y"])
    assert page_blocks("<script>never closed <p>x") == ([], [])
    assert page_blocks("<article>" + "<p>é x</p>" * 3 + "<svg><text>no</text></svg>")[0] == ["é x"] * 3


@pytest.mark.parametrize(
    "piece",
    ["<a", "<textarea", "<textarea>", "</textarea", "<div ", "<a href='", "<a href='x' ", "<div>", "<b><li>", "<ul><b>", "<p><table><td>", "<", "<!-", "<![CDATA", "<!--", "&#9", "&#x", "= ", "<li></x>", "<a b=\"'>", "<script></scrip"],
)
@pytest.mark.parametrize("end", ["", ">", "'>x</a>"])
def test_a_megabyte_of_odd_markup_takes_a_moment(piece, end):
    began = time.process_time()
    page_blocks(piece * (1_000_000 // len(piece)) + end)
    assert time.process_time() - began < 6


def test_references():
    assert decoded("&#0000065; &#x00041; &amp; &#" + "9" * 6000 + ";x &#x" + "f" * 6000 + " &#" + "0" * 6000 + "66;") == "A A & \ufffdx \ufffd B"


def test_article_parts_with_words_of_clutter():
    page = "<article><section class='ad-hoc'>a</section><ul class='social-history'><li>b</ul><p class='related-work'>c</p><p class='share-buttons'>no</p><p class='ad ad-slot-2'>no</p><p id='cookie-bar'>no</p></article>"
    assert page_blocks(page)[0] == ["a", "b", "c"]
    assert page_blocks("<article><p title=it's>x</p><p>don't</p></article>")[0] == ["x", "don't"]
    deep = "<div>" * 3000 + "<article><p>x</p></article><div class='ad'>y</div>" + "</div>" * 3000
    assert page_blocks(deep) == (["x"], [])


@pytest.mark.parametrize(
    "kept",
    ["<div class='teaser'>lead</div>", "<h2 class='subscribe'>lead</h2>", "<p class='promo-code-guide'>lead</p>", "<table class='comparison-banner'><td>lead</table>", "<div class='widget'>lead</div>", "<p class='overlay'>lead</p>", "<p><span class='skip'>lead</span></p>"],
)
def test_one_word_of_a_class_costs_an_article_nothing(kept):
    assert page_blocks(f"<article><p>a</p>{kept}<p>b</p></article>")[0] == ["a", "lead", "b"]


def test_one_main_part():
    page = "<article><p>the long text of the page</p></article><div><article><p>a teaser</p></article></div><p>free</p>"
    assert page_blocks(page) == (["the long text of the page"], ["free"])
    assert page_blocks("<main><article><p>a</p></article><article><p>b</p></article></main>")[0] == ["a", "b"]
    assert page_blocks("<article><div class='related'><a href=x>one</a> <a href=y>two</a></div><p>b</p></article>")[0] == ["b"]


def test_suspect_blocks_are_judged_by_their_host(spark):
    promo = "<div class='promo'><p>Get our paper for half the price now</p><p>Go on</p></div>"
    page = lambda i, more: f"<article><p>Text number {i} of its own</p>{more}<p>same end</p></article>"
    rows = [(i, "http://h.example/a", page(i, promo if i < 4 else "")) for i in range(6)] + [(10, "http://h.example/b", page(10, "<div class='promo'>A lead of its own that nobody else has</div>"))]
    rows += [(20 + i, "http://copy.example/", page(20, "<div class='teaser'>All copies have this lead of nine words here</div>")) for i in range(5)] + [(30, "http://other.example/", page(30, promo))]
    out = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i] for i in range(6)] == [f"Text number {i} of its own\nsame end" for i in range(6)]
    assert "A lead of its own" in out[10] and "half the price now\nGo on" in out[30]
    assert all("All copies have this lead" in out[20 + i] for i in range(5))


def test_other_main_parts_and_clutter():
    page = """<div class="side-bar">s</div><div id="content"><h2>T</h2><p>One<ins class="adsbygoogle">ad</ins> two</p><div class="alert notice">n</div>
    <div class="newsletter-signup">x</div><ol class="comment-list"><li>c</ol></div><div>outside</div>"""
    assert page_blocks(page) == (["T", "One two"], ["outside"])
    assert page_blocks('<div role="main"><p>a</p></div><p>b</p>') == (["a"], ["b"])
    assert page_blocks('<article><p>a</p><article class="comment"><p>c</p></article><footer>f</footer></article>')[0] == ["a"]
    assert page_blocks("<main><header><h1>H</h1></header><p>a</main><header>site</header>") == (["H", "a"], [])
    assert page_blocks("<body class='has-sidebar'><p hidden>x</p><p style='display:none'>y</p><p>z")[1] == ["z"]


def test_host():
    assert [host_of(u) for u in (None, "", "https://u@A.example.com:80/x?y", "//b.org", "nothing")] == ["", "", "a.example.com", "b.org", ""]


def test_pages(spark):
    menu = " ".join(f"menu{i}" for i in range(12))
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><div>{' '.join(f'own{i}x{k}' for k in range(20))}</div>") for i in range(5)]
    rows += [(i, "http://h.example/copy", f"<div>{' '.join(f'same{k}' for k in range(30))}</div>") for i in (20, 21, 22)]
    rows += [(30, "http://other.example/", f"<div>{menu}</div>"), (31, None, None), (32, "u", ""), (None, "http://h.example/a", ARTICLE)]
    rows += [(40 + i, "http://h.example/a", ARTICLE) for i in range(4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in extract_pages(df).collect()}
    assert len(out) == len(rows)
    for i in range(5):
        assert out[i].text == " ".join(f"own{i}x{k}" for k in range(20))
    for i in (20, 21, 22):
        assert out[i].text == " ".join(f"same{k}" for k in range(30))
    assert out[30].text == menu and out[31].text == "" == out[32].text
    assert out[None].text == out[40].text and out[40].text.endswith("c\nLast")
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert extract_pages(df.limit(0)).count() == 0


def test_repeats_of_hosts_match_brute_force(spark):
    r = random.Random(7)
    lines = [" ".join(f"{h}line{k}w{r.randrange(50)}" for _ in range(r.randint(4, 14))) for k in range(8) for h in "ab"]
    rows = []
    for i in range(60):
        host = "ab"[i % 2]
        parts = [line for line in lines if line[0] == host and r.random() < 0.25] + [" ".join(f"u{i}x{r.randrange(9)}" for _ in range(r.randint(0, 20))) for _ in range(2)]
        r.shuffle(parts)
        rows.append((i, f"http://{host}.example/", "".join(f"<div>{p}</div>" for p in parts)))
    pages = {i: [p.split() for p in html.replace("<div>", "").split("</div>") if p.strip()] for i, _, html in rows}
    windows = {}
    for i, url, _ in rows:
        flat = [w for b in pages[i] for w in b]
        for a in range(len(flat) - 7):
            windows.setdefault((url, tuple(flat[a : a + 8])), set()).add(i)
    want = {}
    for i, url, _ in rows:
        flat = [w for b in pages[i] for w in b]
        gone = {k for a in range(len(flat) - 7) if len(windows[url, tuple(flat[a : a + 8])]) >= 3 for k in range(a, a + 8)}
        kept, at = [], 0
        for b in pages[i]:
            own = [w for k, w in enumerate(b, at) if k not in gone]
            at += len(b)
            if own:
                kept.append(" ".join(own))
        want[i] = "\n".join(kept or [" ".join(b) for b in pages[i]])
    got = {x.page_id: x.text for x in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == want and any(want[i] != "\n".join(" ".join(b) for b in pages[i]) for i in want)
