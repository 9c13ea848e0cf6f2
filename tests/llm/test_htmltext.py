import math
import random
import time

import pytest

from tallyward.llm import htmltext as h

SCHEMA = "page_id long, url string, html string, text string"
LONG = "The ferry left at noon, and the quay was empty again. Nobody had come to see it go, which was usual for the season. "
PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="</p><p>no";</script></head>
<body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept them, please.</div><!-- <p>hidden</p> -->
<main><article><h2>A  day&nbsp;out</h2><p>{long}<p>Short&mdash;one.<br>Line two <b>b</b>old <a href="x">link</a>.
<blockquote>He said: 1 &lt; 2 &amp; 3 &gt; 2.</blockquote><div class="ad-slot">Buy now, buy here!</div><ul><li>first item, of two<li>second item</ul></article>
<aside>Related things to read.</aside><section id="comments"><p>I liked this a lot, thanks for it. {long}</p></section><form><p>Your name, please.</p><input></form></main>
<div role="complementary">Popular now</div><footer>&copy; someone</footer></body></html>""".format(long=LONG * 3)
WANT = "A day out " + (LONG * 3).strip() + " Short—one. Line two bold link. He said: 1 < 2 & 3 > 2. first item, of two second item"


def test_article_without_what_is_around_it():
    assert h.main_text(PAGE) == WANT


def test_pages_without_article_tags():
    body = "".join(f"<p>{LONG}{i}</p>" for i in range(5))
    page = f'<html><body><div class="menu"><a href=1>One</a> <a href=2>Two</a></div><div id="x"><h1>Title</h1>{body}</div><div class="footer">Legal, and so on.</div></body></html>'
    assert h.main_text(page) == "Title " + " ".join(f"{LONG}{i}" for i in range(5))
    links = "".join(f'<li><a href="{i}">Link number {i} to go to</a></li>' for i in range(30))
    assert h.main_text(f"<body><ul>{links}</ul><div>{body}</div></body>") == " ".join(f"{LONG}{i}" for i in range(5))


def test_one_long_part_leaves_the_others():
    body = "".join(f"<p>{LONG}{i}</p>" for i in range(8))
    text = " ".join(f"{LONG}{i}" for i in range(8))
    assert h.main_text(f"<body><article><h1>Title</h1><p>A lead, in short.</p><div class=content>{body}</div></article></body>") == "Title A lead, in short. " + text
    assert h.main_text(f"<body><main><h1>Title</h1><article>{body}</article></main></body>") == "Title " + text
    for part in ("div", "blockquote", "section"):
        got = h.main_text(f"<body><div><{part}><p>{LONG}first</p></{part}><{part}>{body}</{part}><{part}><p>{LONG}last</p></{part}></div></body>")
        assert got == f"{LONG}first {text} {LONG}last"
    got = h.main_text(f"<body><table><tr><td><p>{LONG}first</p></td><td>{body}</td></tr></table></body>")
    assert got == f"{LONG}first {text}"
    got = h.main_text(f"<body><article>{body}</article><div><p>{LONG * 2}more</p></div></body>")
    assert got == f"{text} {LONG * 2}more"


def test_odd_pages():
    assert h.main_text(None) == h.main_text("") == h.main_text("<!-- only -->") == h.main_text("<nav>x</nav>") == ""
    assert h.main_text("just text, no tags &amp; all") == "just text, no tags & all"
    assert h.main_text('<div class="sidebar-layout"><p>All of it, really.</p></div>') == "All of it, really."
    assert h.main_text("<p>open <p>ended <b>and <script>never closed") == "open ended and"
    assert h.main_text("<head><title>t</title><p>Body, without a body tag.") == "Body, without a body tag."
    many = "<article>" + "".join(f"<p>{LONG}{i}</p>" for i in range(20_000)) + "</article>"
    assert h.main_text(many).count("ferry") == 20_000


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "y"), (None, None, None, None), (3, "v", "", "z")]
    got = h.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted([("1", WANT, len(WANT))] * 2 + [("None", "", 0), ("3", "", 0)])
    assert h.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def chain(page, k):
    return [] if k < 0 else [*chain(page, page.above[k]), k]


def brute_scores(page):
    """The ratios by their definition: every path asks every block."""
    rows = []
    for k, t, n in zip(page.path, page.text, page.linked):
        size = sum(c != " " for c in t)
        rows.append((chain(page, k), max(0, size - n), sum(c in ".,;:!?…。，、！？；：" for c in t) * max(0, size - n) / size))
    mean = lambda some, at: sum(r[at] for r in some) / len(some) if some else 0.0

    def smoothed(k, at):
        if page.base[k] == k:
            return mean([r for r in rows if page.base[r[0][-1]] == k], at)
        # blocks of elements that start anew lean on those
        own = [r for r in rows if k in r[0] and all(page.base[x] != x for x in r[0][r[0].index(k) + 1 :])]
        return 0.25 * mean(own, at) + 0.75 * smoothed(page.above[k], at)

    full = math.log1p(200) * math.log1p(4)
    score = [min(1.0, math.log1p(smoothed(k, 1)) * math.log1p(smoothed(k, 2) + 0.5) / full) * page.prior[k] for k in range(len(page.above))]
    weight = sum(r[1] * score[r[0][-1]] for r in rows)
    return score, 0.25 * sum(r[1] * score[r[0][-1]] ** 2 for r in rows) / weight if weight else 0.0


def random_page(rng):
    def some(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            words = " ".join(rng.choice(["one", "two,", "three.", "<b>four</b>", '<a href="x">five six</a>', "seven!"]) for _ in range(rng.randint(1, 40)))
            return f"<p>{words}</p>" if kind < 0.2 else words
        tag = rng.choice(["div", "div class=a", 'div class="b c"', "section", "article", "main", "nav", "aside", "ul", "li", "table", "td", 'div class="ad-slot"', "h2", "form", "blockquote"])
        return f"<{tag}>" + " ".join(some(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag.split()[0]}>"

    return "<html><body>" + "".join(some(4) for _ in range(3)) + "</body></html>"


def test_scores_agree_with_their_definition():
    rng = random.Random(7)
    changed = 0
    for _ in range(200):
        page = h.Page(random_page(rng))
        score, least = h.path_scores(page)
        want, want_least = brute_scores(page)
        assert score.tolist() == pytest.approx(want) and least == pytest.approx(want_least)
        changed += any(score[k] < least or score[k] == 0 for k in page.path)
    assert changed > 100  # the scores decide


def test_scores_decide_without_names():
    text = "".join(f"<p>{LONG}{i}</p>" for i in range(4))
    page = f"<body><div class=top><span>12 May</span> <span>Log out</span></div><div class=x><p>{LONG}</p>{text}<ul><li>one, two<li>three</ul></div><div class=end>All rights reserved 2020</div></body>"
    got = h.main_text(page)
    assert got.startswith(LONG[:20]) and got.endswith("one, two three")
    assert h.main_text(f"<div class=x><p>{LONG}</p>{text}</div><div class=y>{'<a href=x>Some other story.</a> ' * 40}</div>").endswith(f"{LONG}3")


def test_attributes_and_hidden_parts():
    assert h.main_text(f'<article><p title="the hidden truth">{LONG}</p><p hidden>{LONG}no</p><p>a<span style="display: none">b<span>c</span>d</span>e <b class="notice">f</b></p></article>') == LONG + "ae f"
    assert h.main_text(f'<article><header><h1>Title</h1></header><p>{LONG}</p><footer>no</footer></article><header>no</header>') == f"Title {LONG.strip()}"
    assert h.main_text(f'<article class="post category-notices"><p>{LONG}</p></article><article class="comment"><p>{LONG}no</p></article>') == LONG.strip()
    assert h.main_text(f'<form><div class="menu">no, no.</div><div><p>{LONG}</p></div></form>') == LONG.strip()
    assert h.main_text(f'<p class="a>b" id=c>{LONG}</p><p data-x=\'>\'>x&#0;&#xD800;&#{"9" * 5000};</p>').startswith(LONG)


def test_broken_pages_take_time_by_their_length():
    parts = ("<div>x", "<a ", "<button>", '<p title="x>y', "</p>x", "<", "<!-- ", "<ul><li>x", "<a =\'\"> \'\"> x", "<span hidden>", "<!x", "<h1>a", "</section>", "<table><tr><td>x")
    start = time.process_time()
    for p in parts:
        h.main_text(p * (1_000_000 // len(p)))
    assert time.process_time() - start < 60
    assert h.main_text("<div>" * 50_000 + LONG) == LONG.strip()
