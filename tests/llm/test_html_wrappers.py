"""Wrappers: inferred expressions, and main text of planted and broken pages."""

import html
import pickle
import random
import re
import time

import pytest

from lodestar.llm import common, html_wrappers as hw


def page(title, paragraphs, rng, template):
    words = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    body = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
    nav = "<nav><ul>" + "".join(f"<li><a href='/{i}'>{words(1)}</a></li>" for i in range(rng.randrange(2, 6))) + "</ul></nav>"
    if template == "plain":
        return f"<!doctype html><html><head><title>{title}</title><script>var x='</p><p>no';</script></head><body>{nav}<div class=ad>{words(4)}</div><article><h1>{title}</h1>{body}</article><footer>&copy; {words(3)}</footer></body></html>"
    if template == "rich":
        return (
            f"<html><body class='has-sidebar'><header><h2>{words(3)}</h2></header><div class='cookie-notice'>{words(6)}</div>{nav}<div id=layout><main><article class=post>"
            f"<header><h1>{title}</h1></header><!-- <p>no</p> -->{body}<div class='share-buttons'>{words(2)}</div><aside>{words(9)}</aside>"
            f"<form>{words(2)}<input></form><footer>{words(2)}</footer></article><section id='comments'><article class='comment'><p>{words(8)}</p></article></section></main>"
            f"<div class='sidebar'>{words(10)}</div></div><noscript>{words(2)}</noscript></body>"
        )
    return (
        f"<html><body><div class=top><a href=/>Home</a> <a href=/a>About us</a></div><div class=content><h1>{title}</h1>{body}</div>"
        f"<div class=bottom>All about this site, the same on each page.</div><div class=links><a href=/x>{words(3)}</a> <a href=/y>{words(3)}</a></div></body></html>"
    )


def corpus(templates=("plain", "rich", "bare")):
    rng, rows, want = random.Random(6), [], {}
    for k in range(48):
        template = templates[k % len(templates)]
        title = f"Title {k} & more"
        paragraphs = [f"Text {k} {i} <b> & “quoted” " + " ".join(f"t{rng.randrange(99)}" for _ in range(5)) for i in range(rng.randrange(1, 7))]
        rows.append((k, f"http://{template}.Example/{k}", page(title.replace("&", "&amp;"), paragraphs, rng, template)))
        want[k] = "\n".join([title, *paragraphs])
    return rows, want


@pytest.mark.parametrize("broadcast", [True, False])
def test_planted_pages(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(hw, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(common, "HOT_KEYS", 1)
        monkeypatch.setattr(hw, "HOT_KEYS", 1)
    rows, want = corpus()
    rows += [(100, "http://x.y/", None), (101, None, ""), (None, "not a url", "<p>Lone page</p>"), (1, rows[1][1], rows[1][2]), (102, None, "<article>only</article>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = hw.extract(df).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    for k, text in want.items():
        assert texts[k] == text
    assert texts[100] == texts[101] == "" and texts[None] == "Lone page" and texts[102] == "only"
    assert all(r.n_chars == len(r.text) for r in got)
    assert hw.extract(df.limit(0)).collect() == []


def test_expression():
    def infer(*pages):
        out = None
        for p in pages:
            f = hw._bare(hw.form(hw.parse(p))[0])
            out = f if out is None else hw.merge(out, f)
        return hw.expression(out)

    assert infer("<div><p>a</p></div>", "<div><p>b</p></div>") == "<#>[<div>[<p>[TEXT]]]"
    assert infer("<div><p>a</p></div>", "<div><p>a</p></div>") == '<#>[<div>[<p>["..."]]]'
    assert infer("<ul><li>a<li>b</ul>", "<ul><li>c</ul><hr><h2>d</h2>") == '<#>[<ul>[<li>[TEXT]+] <h2>["..."]?]'
    assert infer("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p>") == "<#>[(<h2>[TEXT] <p>[TEXT])+]"


@pytest.mark.parametrize(
    "markup, text",
    [
        ("<article><p><b>One<br>two<p>three &amp; &lt;x&gt; &#8364; &am", "One two\nthree & <x> € &am"),
        ("<article>a<b>b</b>c <span class=ad>no</span>d</article>", "abc d"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
        ("<article>x<script>if (a<b) '</article>'</script>y</article><script>never closed", "xy"),
        ("<article>5 < 6 and 7 > 3 <!-- c --> end", "5 < 6 and 7 > 3 end"),
        ("<article><ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
        ("<article><p>a</p>tail <a title='x > y'>link</a></article>", "a\ntail link"),
        ("<div " * 3 + "<article>", ""),
        ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>", "deep"),
        ("no markup\n\n at   all", "no markup at all"),
        ("<article><div hidden>no</div><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    ],
)
def test_markup(markup, text):
    assert hw.main_text(markup) == text


def folded(pages):
    """The packed wrapper of some pages."""
    out = None
    for p in pages:
        f = hw._bare(hw.form(hw.parse(p))[0])
        out = f if out is None else hw.merge(out, f)
    return pickle.dumps(out)


def test_open_wrappers_fall_back_to_the_page(monkeypatch):
    monkeypatch.setattr(hw, "MAX_CHILDREN", 2)
    rows, want = corpus(("plain",))
    packed = folded(p for _, _, p in rows)
    assert "ANY" in hw.expression(pickle.loads(packed))
    assert all(hw.main_text(p, packed) == want[k] for k, _, p in rows)


def untold(k, rng):
    """A page without an article element or telling names, and its main text."""
    words = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    paragraphs = [words(12) for _ in range(rng.randrange(1, 6))]
    extra = "<section class=c9>Free delivery on all orders this week.</section>" if k % 2 else ""
    page = (
        f"<div class=c1>Example Gazette, since 1901</div><div class=c2><h1>Title {k}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}"
        f"<p>Write to our desk if you know more.</p></div>{extra}<div class=c3>Printed in Exampletown by Example &amp; Sons.</div>"
    )
    return page, "\n".join([f"Title {k}", *paragraphs])


def test_wrappers_decide_where_pages_alone_fail():
    rng = random.Random(9)
    pages = [untold(k, rng) for k in range(30)]
    packed = folded(p for p, _ in pages)
    assert all(hw.main_text(p, packed) == want for p, want in pages)
    assert all(hw.main_text(p) != want and "Gazette" in hw.main_text(p) for p, want in pages)
    # The same within article elements.
    inside = [(f"<article>{p}</article>", want) for p, want in pages]
    packed = folded(p for p, _ in inside)
    assert all(hw.main_text(p, packed) == want for p, want in inside)
    assert all(hw.main_text(p) != want for p, want in inside)


@pytest.mark.parametrize("kinds", [5, 20, 70, 400])
def test_a_text_of_all_pages_goes_however_many_kinds_its_parent_has(kinds):
    rng = random.Random(kinds)
    names = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(kinds)]
    pages = []
    for k in range(12):
        own = [f"<div class=x{n}>t{k}{n} {rng.random()}</div>" for n in rng.sample(names, max(3, kinds // 2))]
        pages.append("<body>" + "".join(own) + "<div class=xend>The same on each page.</div></body>")
    packed = folded(pages)
    for p in pages:
        got = hw.main_text(p, packed).split("\n")
        assert "The same on each page." not in got and len(got) == max(3, kinds // 2)


def test_pages_with_the_same_article_keep_it():
    pages = [f"<title>{k}</title><article><h1>Title {k}</h1><p>One text on all pages.</p></article>" for k in range(9)]
    packed = folded(pages)
    assert [hw.main_text(p, packed) for p in pages] == [f"Title {k}\nOne text on all pages." for k in range(9)]
    pages = ["<article><h1>A title</h1><p>One text.</p></article>"] * 9
    assert hw.main_text(pages[0], folded(pages)) == "A title\nOne text."


def test_names_are_hints():
    body = "<p>Real body of the story.</p><p>And more of it.</p>"
    for page in (f'<div id="content"><div class="story-social-issues">{body}</div></div>', f'<h1>Title</h1><div class="widget-area">{body}</div>', f'<div class="sidebar-left">{body}</div>'):
        assert hw.main_text(page).endswith("Real body of the story.\nAnd more of it.")
    for name in ("post-ad-3", "site-footer-wrapper", "left-sidebar-inner", "post-comments-list", "ad", "mainNav", "cookie-bar", "newsletter_box2"):
        assert hw.main_text(f"<div class=text>{body}</div><div class={name}>No part of it.</div>") == "Real body of the story.\nAnd more of it.", name
    for name in ("breaking-advert-free-news", "content", "page-content", "story-social-issues", "col-8"):
        assert hw.main_text(f"<h1>T</h1><p>Short.</p><div class={name}>{body}</div>").endswith("And more of it."), name
    comments = "<div class='comment-list'>" + "<p>A reader says a lot of things here.</p>" * 9 + "</div>"
    assert hw.main_text(f"<div class=text>{body}</div>{comments}") == "Real body of the story.\nAnd more of it."
    menu = "<main><h1>Title</h1><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul><p>Text.</p></main>"
    assert hw.main_text(menu) == "Title\nText."
    items = "<article><p>Text.</p><ul><li>One <a href=/>thing</a> of two</li><li>Another</li></ul></article>"
    assert hw.main_text(items) == "Text.\nOne thing of two\nAnother"
    pages = [f"<main><h1>Title {k}</h1><p>Text {k}.</p><div class=k>We use cookies.</div></main>" for k in range(5)]
    assert hw.main_text(pages[3], folded(pages)) == "Title 3\nText 3."


def test_what_stands_deep_is_still_what_its_parents_are():
    deep = "<div>" * 400
    page = f"<article>{deep}<p>text</p><nav><ul><li>menu</li></ul></nav><form><p>field</p></form><p>more</p></article>"
    assert hw.main_text(page) == "text\nmore"
    assert hw.main_text(f"{deep}<article><p>text</p></article><p>tail</p>") == "text"


@pytest.mark.parametrize("markup", ["<p>x<div>", "<ul><div><li>x</li>", "<div>x</p>", "<p>a<h2>b<hr>", "<table><tr><td>x", "<a><b>y</a>"])
def test_hostile_pages_take_time_in_proportion(markup):
    def seconds(n):
        began = time.process_time()
        hw.main_text(markup * n)
        return time.process_time() - began

    seconds(2000)
    assert seconds(32_000) < 4 * 4 * max(0.2, seconds(8000))


def test_alignment_against_brute_force(monkeypatch):
    rng = random.Random(3)

    def common(x, y):
        best = {(): 0}
        for c in x:
            for s in list(best):
                at = next((k for k in range(best[s], len(y)) if y[k] == c), None)
                if at is not None:
                    best[(*s, c)] = min(at + 1, best.get((*s, c), at + 1))
        return max(map(len, best))

    for k in range(300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        got = hw._pairs([[c] for c in x], [[c] for c in y])
        both = [(i, j) for i, j in got if i is not None and j is not None]
        assert [i for i, _ in got if i is not None] == list(range(len(x))) and [j for _, j in got if j is not None] == list(range(len(y)))
        assert all(x[i] == y[j] for i, j in both) and len(both) == common(x, y)
    # Without the table: every position once and in order, and anchors that all pages have are found.
    monkeypatch.setattr(hw, "CELLS", 0)
    for k in range(300):
        x, y = ([rng.choice("abcdefghijkl") for _ in range(rng.randrange(20))] for _ in range(2))
        x.insert(rng.randrange(len(x) + 1), "Z")
        y.insert(rng.randrange(len(y) + 1), "Z")
        got = hw._pairs([[c] for c in x], [[c] for c in y])
        assert [i for i, _ in got if i is not None] == list(range(len(x))) and [j for _, j in got if j is not None] == list(range(len(y)))
        assert all(x[i] == y[j] for i, j in got if i is not None and j is not None)
    assert hw._pairs([[c] for c in "aZbY"], [[c] for c in "ZcYd"]) == [(0, None), (1, 0), (2, None), (None, 1), (3, 2), (None, 3)]


def test_tables_of_the_driver(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in hw.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
