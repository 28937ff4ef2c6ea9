"""HTML extraction: pages made from known articles, with and without elements that say what they are."""

from __future__ import annotations

import html
import random

import pytest

pytest.importorskip("decisium.llm")
from decisium.llm import html_extract as X  # noqa: E402

SCHEMA = "page_id long, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgé&<'\"") for _ in range(rng.randint(2, 8))) for _ in range(n)).strip()


def labelled(rng, blocks):
    """A page of elements with names, whose menu, notices and comments differ from page to page."""
    e = html.escape
    body = "".join(f"<p>{e(b)}</p>\n" for b in blocks[1:])
    return (
        f"<!DOCTYPE html><html><head><title>{e(blocks[0])} | site</title><style>p{{}}</style></head><body class='page has-sidebar'><header><h2>{e(words(rng, 2))}</h2></header>"
        f"<nav><ul>{''.join(f'<li><a href=x>{e(words(rng, 1))}</a>' for _ in range(rng.randint(2, 6)))}</ul></nav>"
        f"<div class='cookie-notice'>{e(words(rng, 5))}</div><div class=ad>{e(words(rng, 6))}</div><script>if (a < b) x('</p><article>no')</script>"
        f"<article><header><h1>{e(blocks[0])}</h1></header>{body}<aside>{e(words(rng, 4))}</aside><section id=comments><p>{e(words(rng, 9))}</p></section></article>"
        f"<div class='sidebar'>{e(words(rng, 20))}</div><form><p>{e(words(rng, 3))}</p><button>go</button></form><footer>&copy; {e(words(rng, 2))}</footer></body></html>"
    )


def unnamed(rng, blocks):
    """A page of bare divisions: only the template tells what is the page's own."""
    e = html.escape
    menu = "".join(f"<div><a href=x>{e(words(rng, 2))}</a></div>" for _ in range(5))
    return (
        f"<html><body><div><div>Home of the test pages</div>{menu}<div>We keep what you tell us. Read how.</div></div><div><h1>{e(blocks[0])}</h1>"
        + "".join(f"<p>{e(b)}<br>" for b in blocks[1:])
        + "<p>Write to the editors about this page.</p></div><div>All rights are kept, for ever and a day, by us.</div>"
    )


def article(rng):
    return [words(rng, 6), *[words(rng, rng.randint(10, 40)) for _ in range(rng.randint(2, 6))]]


def got(df):
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in X.extract(df).collect()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_known_articles(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(X, "TEMPLATE_BYTES", 0)
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        blocks = article(rng)
        rows.append((i, f"https://{'a.example' if i % 3 else 'B.example'}/p/{i}", (labelled if i % 3 else unnamed)(rng, blocks)))
        text = " ".join(" ".join(blocks).split())
        want[i] = (text, len(text))
    rows += [(100 + i, *rows[0][1:]) for i in range(30)]  # copies of one page don't make a template
    want |= {100 + i: want[0] for i in range(30)}
    # a page alone, labelled
    blocks = article(rng)
    rows.append((200, "https://alone.example/", labelled(rng, blocks)))
    want[200] = (" ".join(" ".join(blocks).split()), len(" ".join(" ".join(blocks).split())))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as host", "2 as tokens", "'x' as text", "3 as template").repartition(3)
    assert got(df) == want


def test_edges(spark):
    rows = [
        (1, None, None),
        (2, "x", ""),
        (3, "http://h", "plain text\n  of one   block &amp; &#233;&nbsp;&eacute;"),
        (4, "http://h/", "<article><p>cut off in the mid"),
        (5, "http://h/", "<article>a<b>b</b>c<br>d<!-- no --><p>e<p>f<div class='x"),
        (6, "http://h/", "<main><div>" * 900 + "deep"),
        (7, "http://h/", "<p>a < b and 3 > 2 <article>x &amp;lt; y</article>"),
        (8, None, "<nav>only a menu</nav>"),
        (8, "http://h/", "<article><span class='share'>tell <span>all</span> of them</span>text</article>"),
        (None, "http://h/", "<script>unclosed <article>no</article>"),
    ]
    out = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in X.extract(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    want = [
        (1, None, ""), (2, "x", ""), (3, "http://h", "plain text of one block & é é"), (4, "http://h/", "cut off in the mid"), (5, "http://h/", "abc d e f"), (6, "http://h/", "deep"),
        (7, "http://h/", "x &lt; y"), (8, None, ""), (8, "http://h/", "text"), (None, "http://h/", ""),
    ]
    assert out == sorted(((*w, len(w[2])) for w in want), key=repr)
    assert X.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_page():
    text = "x" * 3_000_000
    assert X.text_of(X.parsed(f"<article><p>{text}</p></article>"), None) == text


def test_classes(spark):
    """Tokens of equal vectors make one class; a class out of order isn't valid."""
    page = lambda i: f"<html><body><div>Top</div><ul>{'<li><h2>x</h2></li>' * (i % 3 + 1)}</ul><h3>t{i}</h3>{'<h4></h4><h5></h5>' if i % 2 else '<h5></h5><h4></h4>'}<div>End</div></body></html>"
    df = spark.createDataFrame([(i, "http://h/", page(i)) for i in range(12)], SCHEMA).selectExpr("'h' as host", "html")
    tokens = X.page_tokens(df).cache()
    sizes = tokens.groupBy("host").count().withColumnRenamed("count", "n_pages")
    candidates = X._pickled(X.classes(X.token_vectors(tokens), sizes), X._candidates)
    import pickle

    groups, root = pickle.loads(candidates.first()["template"])
    sets = [set(g.tolist()) for g in groups]
    names = {t[0]: t[2] for t in X.parsed(page(0))}
    assert any("Top" in [names.get(t) for t in s] and "End" in [names.get(t) for t in s] for s in sets)
    checks = {r["class"]: (r["valid"], r["gap"]) for r in X.checked(tokens, candidates).collect()}
    items = next(i for i, s in enumerate(sets) if any(names.get(t) == "x" for t in s))
    assert items != root and checks[items][0] and checks[items][1] is not None
    assert not checks[root][0]  # h4 and h5 change places
