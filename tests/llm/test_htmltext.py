"""Main text: pages whose classes mislead, deep markup, a plain version of every decision, and hard cases of the table."""

import random
import time

import numpy as np
import pytest

from harrow.llm import htmltext as H
from harrow.llm import q03_html

LONG = "This sentence of an article reads like prose and goes on for a while, as the sentences of articles do. " * 2


def has(page, *names):
    text = H.main_text(page)
    return [n for n in names if f"{LONG}{n}" in text]


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout with-sidebar"><article><p>{LONG}A</p><p>{LONG}B</p></article></div>',
        f'<div id="header-fixed-layout"><main><p>{LONG}A</p><p>{LONG}B</p></main></div>',
        f"<form action=x><p>{LONG}A</p><p>{LONG}B</p>",
        f"<form action=x><div><p>{LONG}A</p><input><p>{LONG}B</p></div></form>",
        f"<article><form><input><p>{LONG}A</p><p>{LONG}B</p></article>",
        f'<article><section class="discussion"><p>{LONG}A</p></section><p class="search-term">{LONG}B</p></article>',
        f'<article><p class="alert-level">{LONG}A</p><p>so <span class="share">{LONG}B</span></p></article>',
        f'<body class="has-menu no-comments"><div class="page-content nav-open"><p>{LONG}A</p><p>{LONG}B</p></div><footer>x</footer>',
        f"<article><article><p>{LONG}A</p></article><article><p>{LONG}B</p></article></article>",
    ],
)
def test_articles_under_misleading_names_stay(page):
    assert has(page, "A", "B") == ["A", "B"]


@pytest.mark.parametrize(
    "part",
    [
        f"<nav><p>{LONG}Z</p></nav>", f"<footer>{LONG}Z</footer>", f"<aside><p>{LONG}Z</p></aside>", f"<form><p>{LONG}Z</p><button>{LONG}Z</button></form>", f'<div class="ad-slot"><p>{LONG}Z</p></div>', f'<section id="comments"><p>{LONG}Z</p></section>',
        f'<div class="commentList"><p>{LONG}Z</p><p>{LONG}Z</p></div>', f'<div role="complementary"><p>{LONG}Z</p></div>', f'<div class="x cookie-banner">{LONG}Z</div>', f"<script>{LONG}Z</script>", f"<article><p>{LONG}Z</p></article>",
    ],
)
def test_boilerplate_in_an_article_goes(part):
    page = f"<body><header>h</header><article><p>{LONG}A</p>{part}<p>{LONG}B</p></article><footer>f</footer>"
    assert has(page, "A", "B", "Z") == ["A", "B"]


def test_links_in_an_article_go():
    links = "".join(f"<li><a href=x>Zed {k} of the links</a></li>" for k in range(4))
    text = H.main_text(f'<article><p>{LONG}A</p><ul class="search-links">{links}</ul><div>{links}</div><p>{LONG}B</p></article>')
    assert text == f"{LONG}A\n\n{LONG}B"


def test_spoken():
    want = {"sidebar": 2, "site-footer": 2, "adSlot": 2, "x comments-area": 2, "with-sidebar": 1, "search-term": 1, "header-fixed-layout": 1, "discussion": 1, "story": 0, "": 0, "shared": 0}
    assert {n: H.spoken(n) for n in want} == want


@pytest.mark.parametrize("page", ["<div><p>x</p>" * 20_000, "<div>" * 30_000 + "x" + "</p>" * 30_000, "<pre>" * 20_000 + "<li></li><div>a</div>" * 3_000, "<p><b>" * 30_000, "<table><tr><td>" * 15_000 + "y", "<li>" * 30_000 + "</ul>" * 30_000, "<a>" * 30_000 + "z" + "</a>" * 30_000])
def test_deep_markup_is_linear(page):
    began = time.process_time()
    H.main_text(page)
    assert time.process_time() - began < 6


def plain_text(html):
    """Every decision by its definition: sums over all lines in an element, found by walking up from each line."""
    events = H.read_lines(html)
    n, parent, kind, says = len(events.parent), events.parent, events.kind, events.says
    if not events.lines:
        return ""

    def above(k):
        out = [k]
        while out[-1]:
            out.append(parent[out[-1]])
        return out

    inside = {k: set(above(k)) for k in range(n)}
    lowered = lambda at: next((says[k] and kind[k] != "article" for k in above(at) if k == 0 or (says[k] and kind[k] != "article")), 0)
    ratio = [len(t) / max(tags, 1) * (H.LOWERED if lowered(at) else 1.0) for t, tags, _, at in events.lines]
    kernel = {d: np.exp(-0.5 * (d / H.SIGMA) ** 2) for d in range(-H.RADIUS, H.RADIUS + 1)}
    smooth = [sum(kernel[d] * ratio[i + d] for d in kernel if 0 <= i + d < len(ratio)) / sum(kernel[d] for d in kernel if 0 <= i + d < len(ratio)) for i in range(len(ratio))]
    content = np.array(smooth) > H.threshold(np.array(smooth))

    def total(k, what, out):
        rows = [(len(t), len(t) * bool(yes), linked, 1) for (t, _, linked, at), yes in zip(events.lines, content) if k in inside[at] and not out & inside[at]]
        return sum(r[what] for r in rows)

    size, held, links, lines = (lambda k, out, w=w: total(k, w, out) for w in range(4))
    none = frozenset()
    main = {k for k in range(n) if kind[k] in ("article", "main") and size(k, none)}
    cut = set()
    for k in range(1, n):
        up = [a for a in above(k)[1:] if a in main]
        anchor = up[0] if up else None if main else 0
        spared = any(k in inside[m] for m in main) or anchor is not None and held(k, none) > 0 and held(k, none) >= (1 if anchor else H.HALF) * held(anchor, none)
        how = says[k] if events.closed[k] or kind[k] not in H.MARKED else 1
        dull = held(k, none) < H.LINKS * size(k, none) and (links(k, none) >= H.LINKS * size(k, none) or size(k, none) < H.SHORT * lines(k, none))
        if not spared and (how == 2 or how == 1 and dull):
            cut.add(k)
    articles = [k for k in range(n) if kind[k] == "article"]
    over = {k: next((a for a in above(k)[1:] if kind[a] == "article"), None) for k in articles}
    out = cut | {k for k in articles if over[k] is not None and 2 * sum(held(m, cut) for m in articles if over[m] == over[k]) <= held(over[k], cut)}
    boxes = [k for k in range(1, n) if kind[k] in H.CONTAINERS and size(k, out)]
    children = lambda k: [c for c in boxes if next(a for a in above(c)[1:] if kind[a] in H.CONTAINERS or a == 0) == k]
    deeper = lambda k: next((c for c in children(k) if held(c, out) >= H.MOST * held(k, out)), None)
    region = 0
    while kind[region] not in ("article", "main") and deeper(region) is not None:
        region = deeper(region)
    gone = {k for k in boxes if k != region and links(k, out) >= H.LINKS * size(k, out) and (held(k, out) < H.LINKS * size(k, out) or links(k, out) >= H.MOST * size(k, out) and held(k, out) < H.LINKS * held(0, out))}
    level = region
    while level is not None and kind[level] != "article":
        parts = [k for k in children(level) if kind[k] in H.PARTS]
        gone |= {k for k in parts if held(k, out) == 0 or kind[k] == "article" and held(k, out) < H.SHARE * max(held(m, out) for m in parts)}
        level = deeper(level)
    return "\n\n".join(t for t, _, _, at in events.lines if region in inside[at] and not (out | gone) & inside[at])


TAGS = "div p article main section nav footer form ul li aside h1 pre span a table td br button header blockquote".split()
NAMES = ["", "", ' class="ad"', ' class="with-sidebar"', ' id="comments"', ' class="search x"', ' role="main"', " hidden", ' class="discussion"']


@pytest.mark.parametrize("seed", range(120))
def test_against_plain_version(seed):
    rng = random.Random(seed)
    page = ""
    for _ in range(rng.randrange(1, 60)):
        tag = rng.choice(TAGS)
        page += rng.choice([f"<{tag}{rng.choice(NAMES)}>", f"</{tag}>", f"<{tag}>short {tag}</{tag}>", LONG[: rng.randrange(200)], f"<p>{LONG[: rng.randrange(205)]}</p>", f"<a href=x>{LONG[: rng.randrange(60)]}</a>"])
    assert H.main_text(page) == plain_text(page), page


def test_pages_of_the_table_against_plain_version(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in q03_html.query(spark, sf).collect()}
    for r in pages:
        want = plain_text(r["html"] or "")
        assert found[r["page_id"]] == (want, len(want))


def test_frame(spark):
    rows = [(1, None, "a", "b"), (1, None, "a", "b"), (2, "", "a", "b"), (3, "<p>x &amp; y<br>z</p>", "a", "b")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, _row string")
    out = H.with_main_text(df)
    assert out.columns == df.columns and sorted((r["page_id"], r["text"], r["_row"]) for r in out.collect()) == [(1, "", "b"), (1, "", "b"), (2, "", "b"), (3, "x & y z", "b")]
    beside = H.with_main_text(df, out="main")
    assert beside.columns == [*df.columns, "main"] and {r["text"] for r in beside.collect()} == {"a"}
    nothing = H.with_main_text(df.limit(0), out="main")
    assert nothing.columns == [*df.columns, "main"] and nothing.collect() == []
