"""What goes from an article and what stays, hosts without <article>, and pages made to be slow."""

import time

import pytest

from slatewise.llm import html_text

ARTICLE = "<body><nav>menu</nav><article><h1>Title</h1><p>The first paragraph of the article stands here.</p>%s<p>The last one.</p></article></body>"


def inside(part):
    lines = html_text.text_at(ARTICLE % part, None).split("\n")
    assert lines[:2] == ["Title", "The first paragraph of the article stands here."] and lines[-1] == "The last one."
    return lines[2:-1]


@pytest.mark.parametrize(
    "part,text",
    [
        ('<div class="table-footer">Sum 12</div>', ["Sum 12"]),
        ('<p class="notice-of-motion">Moved.</p>', ["Moved."]),
        ('<figure class="photo-banner">A picture.</figure>', ["A picture."]),
        ('<ul class="menu"><li>Soup</li><li>Fish</li></ul>', ["Soup", "Fish"]),
        ('<div class="widget-spec">The widget weighs 3 kg.</div>', ["The widget weighs 3 kg."]),
        ('<p class="promotion">They were promoted.</p>', ["They were promoted."]),
        ('<p class="consent">By consent.</p>', ["By consent."]),
        ('<p class="cookies">Bake for ten minutes.</p>', ["Bake for ten minutes."]),
        ("<p>Press <button>OK</button> now.</p>", ["Press OK now."]),
        (f'<div class="notice">{"A long text about notices. " * 20}</div>', [("A long text about notices. " * 20).strip()]),
        ("<header><h2>Part</h2></header>", ["Part"]),
    ],
)
def test_stays(part, text):
    assert inside(part) == text


@pytest.mark.parametrize(
    "part",
    [
        '<div class="responses"><p>I disagree with every word of it, and so on for a long time.</p></div>',
        '<section id="comments-area"><p>first!</p></section>',
        '<ol class="comment-list"><li>second</li></ol>',
        '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/b">More</a></li></ul>',
        '<div class="cookie-banner">We use cookies on this site.</div>',
        '<div class="notice">This page is old.</div>',
        '<div class="ad-box">Buy this.</div>',
        '<p class="sponsored">Buy that.</p>',
        '<div class="related-posts"><a href="/x">Another</a></div>',
        '<div class="left-sidebar"><p>About us</p></div>',
        "<button>Share</button>",
        '<form><p>Name <input></p></form><aside>x</aside><footer>y</footer><nav>z</nav><div role="navigation">n</div><div hidden>h</div><div style="display: none">d</div>',
    ],
)
def test_goes(part):
    assert inside(part) == []


def test_sites_without_an_article(spark):
    """Containers by class alone, one host a template; votes carry a page whose own best container is another."""
    page = '<body><div class="top"><a href="/">Home</a></div><div class="wrap%d"><div class="story"><h1>Head %d</h1><p>%s</p></div><div class="box">%s</div></div></body>'
    body = "A paragraph with enough words to be the text of a page. "
    rows = [(i, f"https://a.example/{i}", page % (i, i, body * 3, "small")) for i in range(6)]
    rows.append((6, "https://a.example/6", page % (6, 6, "Short.", "much more text in a box beside it than in the story " * 3)))
    rows.append((7, "https://b.example/7", "<main><p>Only this.</p></main>"))
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"Head {i}\n{(body * 3).strip()}" for i in range(6))
    assert got[6] == "Head 6\nShort." and got[7] == "Only this."


@pytest.mark.parametrize(
    "page",
    ["<b>x" * 100_000, "<div>x" * 100_000, "<b>x</i>" * 100_000, "<p><b>x" * 50_000, "<ul><li>x" * 50_000, '<div class="notice">' * 20_000 + "x", '<script "' * 20_000, "<!-" * 100_000, "<a " * 100_000, "&amp" * 100_000],
    ids=range(10),
)
def test_hostile_pages(page):
    began = time.process_time()
    html_text.text_at(page, html_text.best_path(page))
    assert time.process_time() - began < 8  # some 1.5 s each; quadratic cost would be minutes


def test_deep_pages_keep_their_text():
    deep = "<div>" * 2000 + "<p>the text of it</p>" + "<p>and after it</p>" + "</div>" * 2000
    assert html_text.text_at(deep, None).split("\n") == ["the text of it", "and after it"]
    assert html_text.text_at('<body><div class="w-1/2">text in a box</div></body>', "/body/div.w-N_N") == "text in a box"
