"""Main text of usual layouts: marks on the article itself, marks beside it, wrappers of the whole page, and the scores by brute force."""

from __future__ import annotations

import html as entities
import random
import re

import pytest

from evidentia.llm import html_text

PROSE = [f"Paragraph {k} of the article, with commas, and enough words in it that it is plainly prose and nothing else. {'More of it follows here. ' * k}".strip() for k in range(1, 5)]
BODY = "".join(f"<p>{x}</p>" for x in PROSE)
LINKS = "<ul>" + "".join(f"<li><a href=/{k}>Other page number {k}</a></li>" for k in range(6)) + "</ul>"
WORDS = "<p>Some words that are not of the article, with a comma or two, but which are long enough to count as prose.</p>"
WANT = "\n\n".join(PROSE)

AROUND = [  # a wrapper of the article that a word list would take for something else
    'class="layout has-sidebar"', 'id="content" class="no-sidebar"', 'class="page-header-fixed"', 'class="entry-content tags"', 'class="article-share-wrap"', 'class="with-footer wide"', 'class="header-fixed"', 'class="sidebar-right layout"',
    'class="social-page"', 'class="related-topics-page"', 'class="post-tags"', 'class="contentSidebarOpen"', 'class="is-menu-open"', 'class="navigation-top"', 'class="wrapper nav"', 'class="widget"', 'id="side"', 'class="page banner"', 'class="not-hidden"', 'class="comments-open post"',
    'class="cookies-accepted"', 'class="js-ads"', 'class="ad-free"', 'class="Sharing"',
]
BESIDE = [  # an element beside the paragraphs that is not of the article
    'class="commentlist"', 'class="comments"', 'id="comments-area"', 'class="commentBody"', 'class="comment-respond"', 'id="disqus_thread"', 'class="ad"', 'class="box advertisement"', 'class="site-footer"', 'class="left-sidebar"', 'class="sidebar"', 'class="sidebarLeft"', 'class="cookie-notice"', 'class="gdpr-consent"',
    'class="newsletter-signup"', 'class="social-share"', 'class="related-posts"', 'class="main-menu"', 'role="navigation"', 'role="complementary"', 'hidden', 'style="display: none"', 'aria-hidden="true"', 'class="breadcrumbs"', 'class="pagination"',
]


@pytest.mark.parametrize("mark", AROUND)
@pytest.mark.parametrize("tag", ["div", "section"])
def test_mark_on_the_article(mark, tag):
    page = f"<body><nav>{LINKS}</nav><{tag} {mark}><h1>A title</h1>{BODY}<div class=sidebar>{WORDS}</div></{tag}><footer>{WORDS}</footer></body>"
    assert html_text.extract(page) == "A title\n\n" + WANT


@pytest.mark.parametrize("mark", BESIDE)
@pytest.mark.parametrize("where", ["in", "after"])
def test_mark_beside_the_article(mark, where):
    other = f"<div {mark}>{WORDS}<p>Second thing that is said there, at some length, by somebody else.</p></div>"
    page = f"<body><article><h1>A title</h1>{BODY}{other if where == 'in' else ''}</article>{other if where == 'after' else ''}</body>"
    assert html_text.extract(page) == "A title\n\n" + WANT


@pytest.mark.parametrize("page", [
    f"<form id=aspnetForm><div id=main>{BODY}</div><div class=menu>{LINKS}</div><label>Name</label><input></form>",  # a form around the whole page
    f"<div class='page sidebar-layout'><div class=header-wrap><div class='content share'>{BODY}</div></div></div>",  # marks on every wrapper
    f"<div class=sidebar>{WORDS}</div><div id=main>{BODY}</div><form><label for=q>Search for words, of any length, here</label><input></form>",
    f"<table class=layout><tr><td class=nav>{LINKS}<td class=content>{BODY}<td class=side>{WORDS}</table>",
    f"<main class='has-comments'>{BODY}<section id=comments><h2>Comments</h2>{WORDS * 8}</section></main>",  # more comments than article
])
def test_wrappers(page):
    assert WANT in html_text.extract(page) and "Some words" not in html_text.extract(page) and "Other page" not in html_text.extract(page)


def test_labels_and_empty_pages():
    sentence = "A sentence with a label in it, which is text, and with more words to be prose."
    assert html_text.extract(f"<article><p>{sentence.replace('label', '<label>label</label>')}</p></article>") == sentence
    assert html_text.extract(f"<body><div class=ad>{WORDS}</div><article></article></body>") == ""  # an advert is never the article
    assert html_text.extract(f"<body><article><p>Short.</p></article><div class=cookie-notice>{WORDS * 9}</div></body>") == "Short."


def brute_points(page):
    """Points, lengths and linked lengths of all containers by a plain recursion over nested tags without attributes."""
    tokens = re.findall(r"<(/?)(\w+)>|([^<]+)", page)

    def build(at, name):
        node = {"name": name, "parts": []}
        while at < len(tokens):
            end, tag, text = tokens[at]
            at += 1
            if text:
                node["parts"].append(text)
            elif end:
                return node, at
            else:
                child, at = build(at, tag)
                node["parts"].append(child)
        return node, at

    root, _ = build(0, "root")
    found = []

    def walk(node, above):
        node["points"] = 0.0
        chain = [node, *above]
        own = " ".join("".join(x if isinstance(x, str) else "".join(x["parts"]) for x in node["parts"] if isinstance(x, str) or x["name"] == "a").split())
        if len(own) >= 25 and node["name"] != "a":
            points, holder = 1 + own.count(",") + min(len(own) // 100, 3), chain if node["name"] == "div" else chain[1:]
            for step, h in enumerate(holder[:5]):
                h["points"] = h.get("points", 0) + points * (1 if step == 0 else 0.5 if step == 1 else 1 / (3 * step))
        node["length"], node["linked"] = sum(len(" ".join(x.split())) for x in node["parts"] if isinstance(x, str)), 0
        for x in node["parts"]:
            if isinstance(x, dict):
                walk(x, chain)
                node["length"] += x["length"]
                node["linked"] += x["linked"]
        if node["name"] == "a":
            node["linked"] = node["length"]
        if node["name"] == "div":
            found.append(node)

    walk(root, [])
    return found


def test_scores_by_brute_force():
    """Points, their way up, and link density of every container equal those of a plain recursion."""
    rng = random.Random(9)
    word = lambda: rng.choice(["word", "other,", "something,", "and", "longer"])

    def tree(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.5:
                out.append(f"<p>{' '.join(word() for _ in range(rng.randint(1, 60)))}</p>")
            elif kind < 0.65:
                out.append(f"<a>{' '.join(word() for _ in range(rng.randint(1, 20)))}</a>")
            elif depth < 5:
                out.append(f"<div>{tree(depth + 1)}</div>")
        return "".join(out)

    for _ in range(200):
        page = f"<div>{tree(0)}</div>"
        order = html_text._in_order(html_text.parse(page))
        html_text._measure(order)
        html_text._score(order)
        own = [(e.points, e.length, e.linked) for e in order if e.name == "div"]
        want = sorted((round(n["points"], 9), n["length"], n["linked"]) for n in brute_points(page))
        assert sorted((round(p, 9), length, linked) for p, length, linked in own) == want


def test_escapes():
    assert html_text.extract(f"<article><p>{entities.escape(PROSE[0])} &lt;b&gt; &amp;amp;</p></article>") == PROSE[0] + " <b> &amp;"
