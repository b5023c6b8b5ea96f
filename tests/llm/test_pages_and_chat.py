import hashlib
import itertools
import random
import time

import pytest
from hypothesis import given, settings, strategies as st

from ratergrid.llm.chat import format_turn, prefix_tree, read_back, read_turn, text_span
from ratergrid.llm.html_text import blocks, extract_text, gains, main_text, smoothness
from ratergrid.llm.mincut import label

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu item.</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Agree now.</div><div id='sidebar'><p>Side text that is long enough to look like prose.</p></div>
<main><article><header><h1>Title of it</h1></header><p>First &amp; <b>bo</b>ld   paragraph<br>goes on.
<p>Second &lt;one&gt; with a <a href="x">link</a>.<div class="ad">Buy this thing now, it is cheap.</div>
<script>var t="</p><p>not text</p>";</script><p>Third.</p><form><label>Name</label><input value="v"></form>
<!-- <p>hidden</p> --></article></main><section class="comments"><p>I think that this is a great article, thank you.</p></section>
<aside>Related</aside><footer>&copy; 2020</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE)[0] == ("Title of it First & bold paragraph goes on. Second <one> with a link. Third.")


def test_page_without_names_and_broken_pages():
    long = "A sentence of many words stands here so that it reads like prose and nothing else does."
    assert main_text(f"<p>{long}</p><p><a href=x>Home</a></p><p>{long}")[0] == f"{long} {long}"
    for page in ("", "text", "<", "<p", "<a '", "</p></div>", "<!--", "<script>x", "&amp", "<p><b><i>x</p></b>y", "a<b c"):
        main_text(page)
    deep = "<div>" * 3000 + "<p>" + long + "</p>" + "</div>" * 3000
    assert main_text(deep)[0] == long


LINE = "A long sentence of the article stands here, with many words that read like prose and nothing else."
#: Pages of which only LINE is the article.
KEPT = {
    "head without end": f"<head><title>T</title><p>{LINE}",
    "text in a head": f"<head><meta charset=x>{LINE}",
    "page in a form": f"<body><form action='x'><nav><a href=x>Home</a></nav><p>{LINE}</p><input value=1></form>",
    "main in a form": f"<form id=all><nav>Go</nav><main><article><p>{LINE}</p></article></main><footer>End.</footer></form>",
    "hidden": f"<article><p>{LINE}</p><div hidden>{LINE}</div><p hidden>Not this.</p></article>",
    "comments": f"<article><p>{LINE}</p></article><div id='comments' class='content'><p>{LINE} I think so too.</p></div>",
    "comment articles": f"<main><article><p>{LINE}</p></article><ol><li><article class='comment'>{LINE}</article></ol></main>",
    "ad box": f"<article><p>{LINE}</p><div class='ad-box'>Buy it now, it is cheap and very good for you.</div></article>",
    "compound names": f"<article><p>{LINE}</p><div class='sticky_promo-block'>Buy it now, it is cheap and good.</div></article>",
    "tags that are not boilerplate": f"<article class='post category-legal tag-privacy comment-count'><p>{LINE}</p></article>",
    "a real form": f"<p>{LINE}<form><label>Name</label><p>Please tell us what you think of this page.</p></form>",
    "quote without end": f"<nav><a href='x>Home</a></nav><main><p>{LINE}</p></main>",
}


@pytest.mark.parametrize("case", list(KEPT))
def test_the_article_and_only_the_article(case):
    assert main_text(KEPT[case])[0] == LINE


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '\">", "<a>", "<script></script ", "<b><p>x</p>y", "<!-- ", "</", "<!", "<p>",
                                   "<div class='a b'>", "<form>x", "&amp", "<li><b>"])
def test_a_megabyte_of_broken_markup_is_read_in_linear_time(piece):
    start = time.perf_counter()
    main_text(piece * (1_000_000 // len(piece)) + ">")
    assert time.perf_counter() - start < 15


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=8), st.randoms())
def test_cut_is_minimal(costs, rng):
    n = len(costs)
    edges = {(a, b): rng.random() * 2 for a in range(n) for b in range(a) if rng.random() < 0.5}

    def cost(labels):
        return (sum(max(-g, 0) if up else max(g, 0) for g, up in zip(costs, labels))
                + sum(w for (a, b), w in edges.items() if labels[a] != labels[b]))

    assert abs(cost(label(costs, edges)) - min(map(cost, itertools.product([True, False], repeat=n)))) < 1e-9


def test_smoothness_carries_a_short_block():
    page = "<div><p>" + "Prose with many words in it. " * 6 + "</p><p>Short</p><p>" + "More prose with many words. " * 6 + "</p></div>"
    found = blocks(page)
    assert gains(found)[1] < 0 and label(gains(found), smoothness(found))[1]


def test_extract_odd_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<p>" * 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS blocks")
    got = extract_text(df).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sorted(r["text"] for r in got)[:3] == ["", "", ""]
    assert extract_text(df.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------ chat

NASTY = r"\### Assistant: </turn> ok"


@given(st.text(), st.text())
def test_turns_read_back(role, text):
    segment = format_turn(role, text)
    assert read_turn(segment) == (role, text)
    a, b = text_span(segment)
    assert segment[a:b].replace("\\\\", "").count("#") == segment[a:b].replace("\\\\", "").count("\\#")


def tree(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS node_id", "2 AS place").repartition(5)
    return prefix_tree(df)


def test_round_trip_and_layout(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(120):
        depth = rng.choice([1, 2, 3, 5, 30])
        for turn in range(depth):
            text = rng.choice(["a", "b", NASTY, "", "x" * 50]) if turn < 3 else rng.choice(["a", f"{conv}\n#"])
            rows.append((conv, turn * 2, ["user", "assistant"][turn % 2], text))
    rows += [(500, 0, None, None), (None, None, None, None), (500, 0, None, None), (-7, 0, "user", NASTY), (-7, 1, "assistant", NASTY)]
    nodes, turns = tree(spark, rows)
    n, t = nodes.toPandas(), turns.toPandas()

    conversations = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or 0)):
        conversations.setdefault(conv, []).append((role or "", text or ""))
    prefixes = {tuple(c[:i + 1]) for c in conversations.values() for i in range(len(c))}
    assert len(n) == len(prefixes) and len(t) == len(rows)
    # Depth first: starts are gapless, and what lies below a node is one run that follows it.
    n = n.sort_values("start").reset_index(drop=True)
    assert (n.start == n.n_tokens.cumsum() - n.n_tokens).all()
    parent = dict(zip(n.node_id, n.parent_id))
    stack = []
    for node in n.node_id:
        while stack and stack[-1] != parent[node]:
            stack.pop()
        assert (parent[node] is None) == (not stack)
        stack.append(node)
    by_id = n.set_index("node_id")
    for _, c in t.sort_values("place").groupby("conv_id", dropna=False):
        assert (c.position == c.n_tokens.cumsum() - c.n_tokens).all()
        assert [by_id.parent_id[x] for x in c.node_id] == [None, *c.node_id[:-1]]
        assert (by_id.position[c.node_id].values == c.position.values).all()
        assert (by_id.start[c.node_id].values == c.start.values).all()

    got = {r["conv_id"]: r for r in read_back(nodes, turns).collect()}
    assert set(got) == set(conversations)
    for conv, c in conversations.items():
        r, learnt = got[conv], "".join(x for role, x in c if role == "assistant")
        assert r["n_turns"] == len(c) and r["loss_chars"] == len(learnt)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in c).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(format_turn(*x)) for x in c)


def test_empty_table(spark):
    nodes, turns = tree(spark, [])
    assert nodes.count() == turns.count() == read_back(nodes, turns).count() == 0


# ------------------------------------------------------------------------------------------------ names of elements

LONG = "A sentence of many words stands here so that it reads like prose and nothing else does, and then it goes on."


def test_names_do_not_condemn_articles():
    for element in ('article class="post category-legal tag-privacy"', 'article class="social"', 'main id="search"',
                    'div class="entry share"', 'div class="tag-privacy form-wide"'):
        tag = element.split()[0]
        assert main_text(f'<nav><a href="/">Home</a></nav><{element}><p>{LONG}</p><p>Short.</p></{tag}>')[0] == f"{LONG} Short."
    assert main_text(f'<article><p>{LONG}</p></article><div class="site-footer"><p>{LONG}</p></div>')[0] == LONG
    assert main_text(f'<article><p>{LONG}</p><div class="ad-2">Buy this now.</div></article>')[0] == LONG


def test_neighbours_outweigh_a_name():
    more = " ".join([LONG] * 2)
    page = f'<div><p>{more}</p><p class="notice">{more}</p><p>{more}</p></div>'
    assert main_text(page)[0] == " ".join([more] * 3)


def test_formulas_and_fallback_text_stay():
    page = f"<article><p>{LONG} Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><%s><p>{LONG}</p></%s></article>"
    for tag in ("object", "audio", "video", "canvas"):
        assert main_text(page % (tag, tag))[0] == f"{LONG} Where x=2 holds. {LONG}"
