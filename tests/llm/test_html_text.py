import random
import time

import numpy as np
import pytest

from voxgrain.llm.html_text import extract, main_text, smoothed

ARTICLE = (
    '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">home</a></li></ul></nav>'
    '<div class="ad">buy</div><div class="cookie-notice">we use</div><header>top</header><article><h1>Head &amp; line</h1><p>First <b>bold</b>\n  text.<br>More<p>Of.</p>'
    "<aside>side</aside><form>f<input value=x></form><blockquote>q&#39;uote&nbsp;&copy;</blockquote><ul><li>one<li>two</ul><pre>a\n b</pre></article>"
    '<section id="comments"><article><p>a reader says a long long long long thing</p></article></section><footer>foot</footer>'
)


def test_article():
    assert main_text(ARTICLE) == "Head & line\nFirst bold text. More\nOf.\nq'uote ©\none\ntwo\na b"


def test_without_article_the_dense_region_is_kept():
    menu = "".join(f'<div><a href="/{i}">m{i}</a> <a href="/x">n</a></div>' for i in range(8))
    text = "".join(f"<p>{'long running text of the page ' * 8}{i}</p>" for i in range(5))
    page = f"<body><div>{menu}</div><div>{text}<p>Short.</p></div><div>{menu}</div></body>"
    lines = main_text(page).split("\n")
    assert len(lines) == 6 and lines[-1] == "Short." and "m1" not in main_text(page)


def test_odd_pages(spark):
    pages = [None, "", "   ", "plain text", "<p>unclosed", "</p></div>x", "<![weird[ x", "<!-- c", "<script>x", "<article></article>", "<p hidden>x</p>", "<article>" + "<p>word</p>" * 5000 + "</article>", "&lt;p&gt; a < b"]
    rows = [(i, "u", h, "clash", 3) for i, h in enumerate(pages * 2)]
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()}
    assert len(got) == len(rows)
    assert [got[i]["text"] for i in (0, 1, 2, 3, 4, 5, 9, 10)] == ["", "", "", "plain text", "unclosed", "x", "", ""]
    assert got[11]["n_chars"] == 5000 * 5 - 1 and got[12]["text"] == "<p> a < b"
    assert extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


LONG = "A long sentence of the article that goes on for a while, as sentences of articles do."


def test_nothing_of_an_article_is_lost():
    """Names that only contain a mark's word, unclosed elements, and short parts between long ones."""
    assert main_text(f"<body class='post right-sidebar'><article><p>{LONG}</p></article></body>") == LONG
    assert main_text(f"<article id='search-engine-history'><p>{LONG}</article>") == LONG
    assert main_text(f"<article><p>{LONG}</p><section id='related-work'><p>{LONG}</p></section></article>") == f"{LONG}\n{LONG}"
    assert main_text(f"<article><p class='ad'>Buy<p>{LONG}<p>{LONG}</article>") == f"{LONG}\n{LONG}"
    assert main_text(f"<article><ul><li>{LONG}<li class=promo>x<li>Third</ul></article>") == f"{LONG}\nThird"
    parts = [LONG * 4, *(f"Part {i}." for i in range(8)), LONG]
    page = f"<article><p>{parts[0]}</p>" + "".join(f"<section><p>{p}</p></section>" for p in parts[1:-1]) + f"<p>{parts[-1]}</p></article>"
    assert main_text(page) == "\n".join(parts)
    assert main_text(f"<article><i><div>{LONG}</i> more</div><table><tr><td>a<td>b<tr><td>c</table></article>") == f"{LONG} more\na\nb\nc"
    for name in ("ad", "site-footer", "cookie-notice left", "comment-17", "related-posts", "newsletter_signup box"):
        assert main_text(f"<article><p>{LONG}</p><div class='{name}'>{LONG}</div></article>") == LONG, name


def test_broken_pages_cost_no_more_than_their_size():
    began = time.perf_counter()
    assert main_text("<div>" * 15_000 + LONG + "</i>" * 15_000) == LONG
    assert main_text(f"<article><p>{LONG}" + "<b><p>x" * 5000 + "</article>").startswith(LONG)
    assert time.perf_counter() - began < 5


def test_smoothing_keeps_the_level():
    assert np.allclose(smoothed(np.full(9, 7.0)), 7)


def test_marks_and_regions_of_articles():
    """Names of the page's and the article's own element mark nothing, and short parts of an article stay with it."""
    text = "".join(f"<p>{'long running text of the page ' * 8}{i}</p>" for i in range(5))
    whole = main_text(f"<body><article>{text}</article></body>")
    assert whole and main_text(f'<html class="menu"><body class="right-sidebar"><article class="post social">{text}</article></body>') == whole
    links = "".join(f'<p><a href="/{i}">a</a> <a href="/x">b</a></p>' for i in range(9))
    assert main_text(f"<body><article>{text}<div>{links}<p>Short.</p></div></article></body>").endswith("\nShort.")


EIGHT = [f"part {i}" for i in range(8)]
CELLS = [f"{c}{i}" for i in range(5) for c in ("cell", "v")]


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        (f"<body><form id=aspnetForm><article><p>{LONG}", [LONG]),
        (f"<body><form id=aspnetForm><div><p>{LONG}</p><p>{LONG}</p></div></form>", [LONG, LONG]),
        (f"<body><div><p>{LONG}</p><form>Your name <input></form><p>{LONG}</p></div>", [LONG, LONG]),
        *[(f"<article><section id={i}><p>{LONG}</section><p>{LONG}</article>", [LONG, LONG]) for i in ("social", "search", "form")],
        (f"<article><header><h1>Title</h1></header><p>{LONG}</article>", [LONG]),
        (f"<div id=content><p>{LONG}</p>" + "".join(f"<div><p>{p}</p></div>" for p in EIGHT) + f"<p>{LONG}</p></div>", [LONG, *EIGHT, LONG]),
        (f"<div id=content><p>{LONG}</p><table>" + "".join(f"<tr><td>cell{i}<td>v{i}" for i in range(5)) + f"</table><p>{LONG}</p></div>", [LONG, *CELLS, LONG]),
        (f"<body><div><h1>Headline</h1></div><div><p>{LONG}</p><p>{LONG}</p></div>", ["Headline", LONG, LONG]),
        *[(f"<article><p>{LONG}</p><div class='{c}'><p>{LONG}</p></div></article>", [LONG]) for c in ("ad-300x250", "cookie-law-info-bar", "wp-sidebar", "comment-list-v2")],
        (f"<div class='content has-sidebar'><p>{LONG}</p><p>{LONG}</p></div>", [LONG, LONG]),
        (f"<div class='layout-sidebar'><article><p>{LONG}</p></article></div>", [LONG]),
        (f"<form><article><p>{LONG}</article><section id=comments><article><p>{LONG}</article></section></form>", [LONG]),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><section class=comment-list-v2><article><p>{LONG}</article></section>", [LONG, LONG]),
        (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div><a href=1>one</a> <a href=2>two</a></div><div><p>{LONG}</p><p>{LONG}</p></div>", [LONG] * 4),
    ],
)
def test_what_wraps_and_what_lies_between(page, lines):
    assert main_text(page).split("\n") == lines


@pytest.mark.parametrize("page", ["<li><ul>" * 15_000 + "<p>x" * 15_000, "<p><button>" + "<b><div>" * 15_000 + "<p>x" * 15_000, "<i><div>" + "<b>" * 15_000 + "</i>" * 15_000, "<div>" * 15_000 + LONG + "<div><p>x" * 5000])
def test_nesting_costs_no_more_than_its_size(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 3  # below 1 s on an idle machine


def random_page(rnd):
    """Tags in order, and lines with the path of elements around them."""
    tokens, lines, made = [], [], [0]

    def fill(path, depth):
        for _ in range(rnd.randrange(1, 5)):
            if depth < 4 and rnd.random() < 0.5:
                made[0] += 1
                tokens.append("<div>")
                fill((*path, made[0]), depth + 1)
                tokens.append("</div>")
            else:
                words = " ".join(["word"] * rnd.choice([1, 2, 40, 60])) + f" {len(lines)}"
                linked = rnd.random() < 0.3
                tokens.extend(["<p>", f"<a>{words}</a>" if linked else words, "</p>"])
                lines.append((words, path, linked))

    fill((), 0)
    return tokens, lines


def model(tokens, lines):
    """The rule read off the tree: seeds, their regions, and what lies between them below their common path; no page has an article or a heading."""
    ratios, tags, k = [], 0, 0
    for token in tokens:
        if token[0] == "<" and not token.startswith("<a>"):
            tags += 1
            if token == "</p>":  # a line ends with its paragraph
                ratios.append(len(lines[k][0]) / (tags + 2 * lines[k][2]))
                tags, k = 0, k + 1
    ratio = smoothed(np.array(ratios))
    own = {p: [(len(w), linked) for w, q, linked in lines if q == p] for _, p, _ in lines}
    linked = {p for p, x in own.items() if 2 * sum(n for n, a in x if a) >= sum(n for n, _ in x)}
    seeds = [i for i, r in enumerate(ratio) if r > ratio.std()] or [i for i, r in enumerate(ratio) if r == ratio.max()]
    seeds = [i for i in seeds if lines[i][1] not in linked] or seeds
    chosen = {lines[i][1] for i in seeds}
    common = min(chosen, key=len)
    while any(p[: len(common)] != common for p in chosen):
        common = common[:-1]
    between = lambda i: seeds[0] < i < seeds[-1] and lines[i][1][: len(common)] == common and lines[i][1] not in linked
    return [w for i, (w, p, _) in enumerate(lines) if p in chosen or between(i)]


def test_regions_against_a_model():
    rnd = random.Random(7)
    for _ in range(800):
        tokens, lines = random_page(rnd)
        assert main_text("".join(tokens)).split("\n") == model(tokens, lines), "".join(tokens)
