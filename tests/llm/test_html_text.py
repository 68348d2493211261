from __future__ import annotations

import html
import re

import pytest

from modlark.llm import html_text as H

LONG = "many words of an article that goes on and on for quite a while so that it is long enough to be taken for main text by anyone at all"


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""),
        ("", ""),
        ("<article><h1>T &amp; U</h1><p>a  b\n c<br>d<p>e</article>", "T & U\na b c d\ne"),
        ("<article><p><b>never closed<p>next</article><footer>gone</footer>", "never closed\nnext"),
        ("<nav><a href=x>Home</a></nav><main><p>text</p><aside>side</aside><p>more</p></main>", "text\nmore"),
        (f"<div class='content'><p>{LONG}</p><p>{LONG}</p></div><div class='comments'><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
        (f"<div id=cookie-notice>{LONG}</div><p>{LONG}</p>", LONG),
        ("<article><p>x<script>var a='<p>no</p>';</script>y</p><!-- <p>no</p> --><style>p{}</style></article>", "x y"),
        ("<article><p>a<form><label>name</label></form><p>b</article>", "a\nb"),
        ("<article><p>1 < 2 &lt;b&gt; &#233; &nbsp;&amp</p></article>", "1 < 2 <b> é &"),
        ("<article><p title=\"a>b\">c</p></article>", "c"),
        ("<article><p>cut off <a href=", "cut off <a href="),
        ("<article><header><h1>Title here</h1></header><p>body</p></article>", "Title here\nbody"),
        ("<article>a</div></p>b</article>", "a\nb"),
    ],
)
def test_pages(page, expected):
    assert H.main_text(page) == expected


@pytest.mark.parametrize(
    "page, expected",
    [
        ("a<svg/>b<p>c", "a b c"),
        ("a<svg width='1'/>b<math/>c", "a b c"),
        ("a<video-player></video-player>b<p>c", "a b c"),
        ("a<map-view x=1></map-view><button-group>b</button-group><template-x>c</template-x>d", "a b c d"),
        ("a<button>x<p>c", "a x c"),
        ("a<select><option>x<p>b<object>c<p>d", "a x b c d"),
        ("a<button>x<p>b</p><button>no</button>c", "a x b c"),
        ("a<object>no<object>no</object>no</object>b", "a b"),
        ("a<video>no</video >b<script>'</video>'</script>c", "a b c"),
        ("a<svg><title/><style/><path/></svg>b", "a b"),
        ("a<script>no<p>no", "a"),
        ("a<title/>no", "a"),
        ("a<!-- no <p>no", "a"),
    ],
)
def test_elements_without_text_end_where_they_do(page, expected):
    assert H.main_text(f"<article>{page}").split() == expected.split()


def test_unclosed_elements_take_linear_time():
    assert H.main_text("<article>" + "<button><object>x " * 30_000).split() == ["x"] * 30_000


@pytest.mark.parametrize(
    "page",
    [
        "<div class='overflow-hidden'><article><p>a</p></article></div>",
        "<body class='has-sidebar'><div class='page no-sidebar'><article><p>a</p></article></div>",
        "<article class='post category-news tag-search'><p>a</p></article>",
        "<article><section id='related-work'><p>a</p></section></article>",
        "<article><p class='foo hidden-xs' title='a hidden one'>a</p></article>",
        "<div class='sidebar widget'><div class='widget'><main><p>a</p></main></div></div>",
        "<article class='promo'><p>a</p></article>",
        "<form><article><p>a</p></article></form>",
        "<article><p>a</p><section class='comments'><article><p>no</p></article></section></article>",
        "<main><article><p>a</p></article><div id='comments' class='comments-area'><ol><li><article class='comment-body'><p>no</p></article></ol></div></main>",
        "<article><p>a</p></article><div class='related-posts'><article class='teaser'><p>no</p></article></div>",
        "<article><p>a</p><div class='ad-slot-3'>no</div><div class='share-buttons'>no</div><div class='cookie_notice'>no</div><div style='display: none'>no</div><p hidden>no</p></article>",
    ],
)
def test_names_of_elements(page):
    assert H.main_text(page) == "a"


def test_doubtful_names_within_an_article():
    """Paragraphs stay whatever their length, lists of links go; other names say what an element is."""
    page = f"<p class='alert'>Short one.</p><p class=legal>{LONG}</p><div class='social-history'>a b c</div><div class='warning box'><p>d e</p><p>{LONG}</p></div><div class='elementor-widget'><p>{LONG} f</p></div>"
    kept = f"Short one.\n{LONG}\na b c\nd e\n{LONG}\n{LONG} f"
    assert H.main_text(f"<article>{page}</article><div class=legal>{LONG}</div>") == kept
    assert H.main_text(f"<main><p>{LONG}</p><ul class='links'>{lines(5, 2, True)}</ul><div class='search'><a href=x>all</a></div><p>{LONG}</p></main>") == f"{LONG}\n{LONG}"
    assert H.main_text(f"<article><p>{LONG}</p><div class='notice'>{LONG}</div><div role='alert'>{LONG}</div><div class='ad'>x</div><div class='comments'><p>{LONG}</p></div></article>") == LONG


def test_names_of_elements_on_a_page_without_article():
    assert H.main_text(f"<div class='content has-sidebar'><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div>") == LONG


def lines(n, words, link=False):
    return "".join(f"<p>{'<a href=x>' if link else ''}{' '.join(f'l{i}w{k}' for k in range(words))}{'</a>' if link else ''}</p>" for i in range(n))


def text(page):
    return "\n".join(re.findall(">(?:<a href=x>)?([^<]+)<", page))


@pytest.mark.parametrize("short", [lines(8, 5), lines(8, 12), lines(8, 2) + lines(8, 20), lines(8, 15, True)])
def test_runs_of_short_blocks(short):
    for around in ("", f"<p>{LONG}</p>"):
        page = around + short + around
        assert H.main_text(f"<article>{page}</article>") == text(page)
        assert H.main_text(f"<div>{page}</div>") == text(page)


def test_links_that_belong_to_the_article():
    page = f"<h2><a href=x>A linked title</a></h2><p>short one</p><p>{LONG}</p><p><a href=x>Read more</a></p>" + lines(3, 15, True) + lines(5, 2, True)
    assert H.main_text(f"<article>{page}</article>") == text(page)
    page = f"<p>{LONG}</p><h2><a href=x>A linked title</a></h2><p>{LONG}</p>"
    assert H.main_text(f"<div>{page}</div>") == text(page)


def test_menus_without_names():
    for n in (1, 2, 4):
        assert H.main_text(f"<ul>{lines(6, n, True)}</ul><p>{LONG}</p><p>{LONG}</p><ul>{lines(6, n, True)}</ul>") == f"{LONG}\n{LONG}"
    one = "".join(f"<a href=x>menu {i}</a> " for i in range(12))
    assert H.main_text(f"<div>{one}</div><p>{LONG}</p><p>{LONG}</p><div>{one}</div>") == f"{LONG}\n{LONG}"


def test_blocks_know_their_links():
    found = H.blocks("<p>one <a href=x>two three</a> four</p><ul><li><a>five</a><li>six</ul>")
    assert [(b.text, b.words, b.linked) for b in found] == [("one two three four", 4, 2), ("five", 1, 1), ("six", 1, 0)]


def test_tree_agrees_with_its_table():
    table = H.labelled()
    assert (H.classify(H.tree(), table[:, :-1]) == table[:, -1].astype(bool)).mean() >= 0.97


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r.page_id: r for r in H.extract(pages).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        text = "\n".join(x for x in parts if x)
        assert found[p.page_id].text == text and found[p.page_id].n_chars == len(text) and found[p.page_id].url == p.url


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, "t"), (1, "u", "<article>" + "<div>" * 5000 + "deep", "t"), (1, "u", "<p" * 50_000, "t"), (2, "", "plain", "t"), (2, "", "plain", "t")], "page_id long, url string, html string, text string")
    found = H.extract(df).collect()
    assert len(found) == 5 and {r.text for r in found if r.page_id is None} == {""} and any(r.text == "deep" for r in found)
    assert H.extract(df.limit(0)).count() == 0


STORY = "It was a long day in the old town, and many people came to see what the river had left on its banks after the storm of the week before. " * 3
MENU = '<nav><a href="/">Home</a> <a href="/x">News</a></nav>'


@pytest.mark.parametrize(
    "page, kept",
    [
        (f"<body><form id='aspnetForm'><input type='hidden' name='v'><div class='content'><p>{STORY}</p><p>{STORY}</p></div></form></body>", [STORY, STORY]),
        (f"<body>{MENU}<article><p>{STORY}</p><p>We have <math><mi>x</mi><mo>=</mo><mn>42</mn><annotation>x=42</annotation></math> here</p></article></body>", [STORY, "We have x=42 here"]),
        (f"<body><article><div class='hidden md:block'><p>{STORY}</p></div><p>{STORY}</p></article></body>", [STORY, STORY]),
        (f"<body><article><p class='article-teaser'>{STORY}</p><p>{STORY}</p></article></body>", [STORY, STORY]),
        (f"<body><article><section class='html-tags'><p>{STORY}</p></section><section id='menu'><p>{STORY}</p></section></article></body>", [STORY, STORY]),
        (f"<body><article><div class='tags'><a href='/a'>one</a></div><p>{STORY}</p><div class='menu'><a href='/b'>two three</a></div></article></body>", [STORY]),
        (f"<body><div><p>{STORY}</p><figure><img><figcaption>The river after the storm</figcaption></figure><p>{STORY}</p></div></body>", [STORY, "The river after the storm", STORY]),
        (f"<body><article><p>{STORY}</p><div class='newsletter'><p>{STORY}</p></div><div class='hidden'><p>{STORY}</p></div></article><form><label>Your name and what you think of it</label><input><button>Send</button></form></body>", [STORY]),
    ],
)
def test_nothing_of_an_article_is_lost(page, kept):
    assert H.main_text(page) == "\n".join(" ".join(k.split()) for k in kept)
