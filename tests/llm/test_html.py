"""Main text of pages whose article is known."""

import pytest

from orderloom.llm import html

PROSE = "Rivers carve wide valleys over time, and towns grow beside them, slowly, where bridges stand."
MORE = "Markets open early, carts roll in from the hills, and by noon, the square is full of voices."

CASES = {
    "none": (None, ""),
    "empty": ("", ""),
    "text only": ("just words", "just words"),
    "plain": (f"<html><body><nav><ul><li><a href=/a>A</a></li></ul></nav><article><h1>T &amp; U</h1><p>{PROSE}</p><p>{MORE}</p></article><footer>&copy; x</footer></body></html>", f"T & U\n{PROSE}\n{MORE}"),
    "unclosed": (f"<article><h1>Head</h1><p><b>{PROSE}<br><p>Short.<p>{MORE}</article><footer>end</footer>", f"Head\n{PROSE}\nShort.\n{MORE}"),
    "no article": (f"<body><div id=menu><a href=x>One</a> <a href=y>Two</a></div><div class='post-content'><p>{PROSE}</p><p>{MORE}</p></div><div class=sidebar><p>{MORE}</p></div></body>", f"{PROSE}\n{MORE}"),
    "two parts": (f"<body><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><div><p>{MORE}</p><p>{MORE}</p><p>{MORE}</p><p>{MORE}</p></div></body>", "\n".join([PROSE] * 3 + [MORE] * 4)),
    "comments": (f"<main><p>{PROSE}</p><section class='comments'><p>{MORE}</p><p>{MORE}</p><p>{MORE}</p></section></main>", PROSE),
    "cookie notice and form": (f"<div class='cookie-notice'><p>{MORE}</p></div><article><p>{PROSE}</p><form><p>{MORE}</p><input></form></article>", PROSE),
    "script with a tag in it": (f"<article><script>var t='</p><p>';</script><style>p{{}}</style><p>{PROSE}</p></article>", PROSE),
    "white space": ("<article><p>a\n\t b&nbsp;&nbsp;c<br>d</p>  <p> </p></article>", "a b c d"),
    "references": ("<article><p>&lt;b&gt; &#233;&#x41; &amp;amp; &unknown; &amp</p></article>", "<b> éA &amp; &unknown; &"),
    "broken attributes": (f"<article class=\"x><p>{PROSE}</p></article>", PROSE),
    "inline tags": ("<article><p>one<b>two</b> <i>three</i></p></article>", "onetwo three"),
    "lists and tables": (f"<article><p>{PROSE}</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", f"{PROSE}\na\nb\nc\nd"),
    "menu inside": (f"<article><p>{PROSE}</p><div><a href=a>One thing</a> <a href=b>Two</a></div></article>", PROSE),
    "headline outside": (f"<body><h1>Title</h1><div class=post><p>{PROSE}</p><p>{MORE}</p></div></body>", f"Title\n{PROSE}\n{MORE}"),
    "headline in a block of its own": (f"<body><div><h1>Title</h1></div><div><div><p>{PROSE}</p><p>{MORE}</p></div></div></body>", f"Title\n{PROSE}\n{MORE}"),
    "short second part": (f"<body><div>{f'<p>{PROSE}</p>' * 20}</div><div><p>{MORE}</p><p>Two, words, here.</p></div><p>End.</p><div><a href=a>One</a> <a href=b>Two</a></div></body>", "\n".join([PROSE] * 20 + [MORE, "Two, words, here.", "End."])),
    "linked cells": (f"<article><p>{PROSE}</p><div><table><tr><td><a href=p>Paris</a><td>2</tr><tr><td><a href=l>Lyon</a><td>1</tr></table></div></article>", f"{PROSE}\nParis\n2\nLyon\n1"),
    "sources": (f"<article><p>{PROSE}</p><section><h2>Sources</h2><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></section><div><ul><li><a href=a>{PROSE}</a><li><a href=b>{MORE}</a></ul></div></article>", f"{PROSE}\nSources\nOne\nTwo\n{PROSE}\n{MORE}"),
    "a link in a wrapper and in a quote": (f"<article><p>{PROSE}</p><div><p><a href=a>Read on</a></p></div><blockquote><a href=a>A word</a> <a href=b>and more</a></blockquote></article>", f"{PROSE}\nRead on\nA word and more"),
    "menu of blocks inside": (f"<article><p>{PROSE}</p><div><div><a href=a>One</a></div><div><a href=b>Two</a></div></div></article>", PROSE),
    "code comments": ("<article><pre><span class='hljs-comment'># add</span> a + <span class='token comment'>/* b */</span> b</pre></article>", "# add a + /* b */ b"),
    "headline in a block named header": (f"<body><div class=post><div class=post-header><h1>Title</h1></div><p>{PROSE}</p></div><div class=header><p>{MORE}</p></div></body>", f"Title\n{PROSE}"),
    "class words on prose": ("<article><p>" + PROSE + "</p>" + "".join(f"<p class='{w}'>{w} {MORE}</p><div class={w}><p>{PROSE}</p></div>" for w in ("share", "social", "related", "notice", "login", "skip")) + "</article>", "\n".join([PROSE] + [x for w in ("share", "social", "related", "notice", "login", "skip") for x in (f"{w} {MORE}", PROSE)])),
    "class words on links": (f"<article><p>{PROSE}</p><div class=related><p>Also <a href=a>{MORE}</a></p></div><p class=share><a href=b>Share</a></p></article>", PROSE),
    "class words on all": (f"<body><div class=page-header><p>{PROSE}</p></div></body>", PROSE),
    "comment marks": (f"<article><!-- <p>hidden</p> --><p>{PROSE}</p><!-- open", PROSE),
}


@pytest.mark.parametrize("name", CASES)
def test_article_of_a_page(name):
    page, expected = CASES[name]
    assert html.main_text(page) == expected


def test_table_of_pages(spark):
    rows = [(i % 5 if i else None, f"u{i}", page, "clash", "clash") for i, (page, _) in enumerate(CASES.values())]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, k string")
    result = {r["url"]: r for r in html.extract(pages).collect()}
    assert len(result) == len(CASES)
    for i, (_, expected) in enumerate(CASES.values()):
        assert result[f"u{i}"]["text"] == expected and result[f"u{i}"]["n_chars"] == len(expected)
    assert html.extract(pages.limit(0)).count() == 0


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + f"<p>{PROSE}</p>" + "</div>" * 3000
    assert html.main_text(deep) == PROSE
    long = "<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>"
    assert html.main_text(long).count("\n") == 4999
    assert html.main_text("<" * 50_000 + "a=\"" * 1000) is not None
