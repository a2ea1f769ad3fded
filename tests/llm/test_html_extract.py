import random
import time

import pytest

from subtide.llm import html_extract as h

CASES = [
    ("", ""),
    ("plain text only", "plain text only"),
    ("<p>one<p>two", "one\ntwo"),
    ("<body><nav>menu</nav><main><h1>A &amp; B</h1><p>x&nbsp;y\n z</p></main><footer>f</footer>", "A & B\nx y z"),
    ("<article><header><h1>T</h1></header><p>a <b>b</b><i>c</i><br>d</p><aside>no</aside><div class='comments'><p>no</p></div></article>", "T\na bc d"),
    ("<article><script>var t='</p>';</script><style>p{}</style><p>a &lt;b&gt; &copy;</p><form><input>no</form></article>", "a <b> ©"),
    ("<div id='sidebar'>no</div><div class='post'><p>yes</p></div><div class='ad-box'>no</div><div role=navigation>no</div><p hidden>no</p>", "yes"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc\nd\ne"),
    ("<article><p>first</p></article><article><p>second</article>", "first\nsecond"),
    ("<p>5 < 6 and <3</p><!-- c --><p>unclosed <a href='x>y'>link", "5 < 6 and <3\nunclosed link"),
    ("<textarea>no</textarea><title>no</title><p>ok</p></div></p>end", "ok\nend"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_pages(page, text):
    assert h.main_text(h.parse(page)) == text


def test_deep_and_long_pages():
    assert h.main_text(h.parse("<div>" * 20_000 + "x" + "</div>" * 20_000), {1}) == "x"
    assert h.main_text(h.parse("<p>" + "word " * 200_000)) == ("word " * 200_000).strip()


def test_templates(spark):
    box = "<div><p>Read our other sites</p></div>"
    rows = [(i, f"http://A.com/{i}", f"<body>{box}<div><h2>Title {i}</h2><p>Text {i}</p></div><section>Site foot</section>", "t") for i in range(6)]
    rows += [(10 + i, "http://b.com/1", f"<body>{box}<p>copy</p>", "t") for i in range(5)]  # copies of one page make no template
    rows += [(20, None, None, "t"), (21, "http://a.com/x", "", "t"), (22, None, "<p>no host</p>", "t"), (0, "http://A.com/0", rows[0][2], "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(3)
    got = h.extract_text(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["page_id"]
        want = f"Title {i}\nText {i}" if i < 6 else "Read our other sites\ncopy" if i < 20 else {20: "", 21: "", 22: "no host"}[i]
        assert r["text"] == want and r["n_chars"] == len(want)
    assert h.extract_text(pages.limit(0)).count() == 0


def test_recurring_paragraphs_of_articles_stay(spark):
    rows = [(i, "http://a.com/", f"<nav>n</nav><article><p>Same lead.</p><p>Body {i}.</p></article>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in h.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Same lead.\nBody {i}." for i in range(8)}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    rows = [(i, f"http://a.com/{i}", f"<div>box</div><p>T{i}</p>") for i in range(5)]
    monkeypatch.setattr(h, "BROADCAST_ROWS", 0)
    got = {r["page_id"]: r["text"] for r in h.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"T{i}" for i in range(5)}


def texts_of(spark, rows):
    return {r["page_id"]: r["text"] for r in h.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_copies_with_other_surroundings_make_no_template(spark):
    own = "<section><p>Part of the copied article.</p></section><ul><li>its list</ul>"
    around = "<script>track({0});</script><nav>menu {0}</nav><div class='ad'>advert {0}</div>"
    rows = [(i, f"http://a.com/{i}", around.format(i) + f"<article><p>Lead.</p>{own}</article>") for i in range(4)]
    rows += [(10 + i, f"http://a.com/{i}", around.format(i) + f"<article><div>Site box</div><p>Other {i}.</p></article>") for i in range(6)]
    assert texts_of(spark, rows) == {i: "Lead.\nPart of the copied article.\nits list" for i in range(4)} | {10 + i: f"Other {i}." for i in range(6)}


def test_template_of_a_part_of_a_large_site(spark):
    page = "<body>{}<div><h2>Title {}</h2><p>Text {}</p></div>"
    menus = {i: "<div>Menu of one section</div>" if i < 12 else "<figure>Shown on few pages</figure>" if i < 16 else "" for i in range(60)}
    got = texts_of(spark, [(i, f"http://a.com/{i}", page.format(menus[i], i, i)) for i in menus])
    assert got == {i: ("Shown on few pages\n" if 12 <= i < 16 else "") + f"Title {i}\nText {i}" for i in menus}


LONG = "<p>" + "A paragraph of the article. " * 5 + "</p>"
KEPT = ("A paragraph of the article. " * 5).strip()


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "menu-open", "social-share-enabled", "widget", "sidebar", "share-price", "social_history"])
def test_names_that_hold_the_article(name):
    for inside in (LONG, f"<article>{LONG}</article>"):
        page = f"<body><div class='{name}'>{inside}<div class='related'><p>no</p></div></div><div class='sidebar-left'>no</div><div class='cookie-banner'>no</div></body>"
        assert h.main_text(h.parse(page)) == KEPT


def test_names_that_do_not_hold_the_article():
    for name in ("comments", "comment-list", "reply"):
        assert h.main_text(h.parse(f"<div><p>short</p></div><div class='{name}'>{LONG}</div>")) == "short"
    for name in ("sidebar", "related-posts", "site_footer"):
        assert h.main_text(h.parse(f"<article><p>short</p></article><div class='{name}'>{LONG}</div>")) == "short"


def test_article_that_is_a_teaser():
    teaser = "<article><header>Read on</header></article>"
    assert h.main_text(h.parse(f"<body><div>{LONG}</div>{teaser}</body>")) == KEPT + "\nRead on"
    assert h.main_text(h.parse(f"<main><div>{LONG}</div>{teaser}</main><p>foot</p>")) == KEPT + "\nRead on"
    box = f"<div>{LONG}</div>"
    assert h.main_text(h.parse(f"{box}<article><p>short</p></article>"), set(h.subtree_hashes(h.parse(box)).values())) == "short"


def test_broken_tags_leave_no_markup_and_lose_no_text():
    text = lambda page: h.main_text(h.parse(page))
    assert text("<article><p>one</p><a title=it's>two</a></article>") == "one\ntwo"
    assert text('<p>a</p><p title="x>b') == "a\nb"
    assert text("<p>a</p><p title='x") == "a"
    assert text("<p>1 < 2</p></ x><p>b</p></") == "1 < 2\nb"
    for n in (3, 20, 2000):
        assert text("<article><p class='ad'>" + "<i>" * n + "promo<div>real text</div></article>") == "real text"
    assert text("<article><div class='widget search-results'>found</div><h2 id='comments'>on comments</h2><p>x</p><div class='ad-box'>buy</div></article>") == "found\non comments\nx"


def test_hostile_pages_take_time_in_proportion():
    for page in ("<a '" * 250_000, "<i>" * 200_000 + "<hr>" * 100_000, "<div>" * 100_000 + "</b>" * 100_000, "<p><table><td>" * 50_000, '<a b="' * 100_000):
        began = time.process_time()
        h.main_text(h.parse(page))
        assert time.process_time() - began < 8


def test_templates_decide_on_sites_of_plain_blocks(spark):
    """Pages of unnamed blocks alone: what recurs on a host goes, counted by hand from the blocks the pages were made of."""
    r = random.Random(4)
    rows, blocks = [], {}
    for page in range(120):
        host = page % 4
        made = [f"Site {host} menu {r.randrange(3)}", f"Site {host} legal", *[f"Story {page} part {k}" for k in range(r.randint(1, 4))], f"Aside {r.randrange(400)}"]
        blocks[page] = made
        rows.append((page, f"https://h{host}.example/{page}", "<html><body>" + "".join(f"<div><div>{b}</div></div>" for b in made) + "</body></html>"))
    want = {}
    for page, made in blocks.items():
        same = [b for p, b in blocks.items() if p % 4 == page % 4]
        on = lambda x: sum(x in b for b in same)
        want[page] = "\n".join(b for b in made if not (on(b) >= h.MANY_PAGES or on(b) >= h.MIN_PAGES and on(b) >= h.MIN_SHARE * len(same)))
    got = {x["page_id"]: x["text"] for x in h.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want and all("legal" not in t for t in got.values())


def text_of(page):
    return h.main_text(h.parse(page))


def test_comments_end_where_they_do():
    assert text_of("<p>a</p><!--><p>b</p><!---><p>c</p>") == "a\nb\nc"
    assert text_of("<p>a</p><!-- x --!><p>b</p><!-- <p>no</p> --><p>c</p><!-- open <p>no</p>") == "a\nb\nc"


def test_a_form_around_the_page_is_no_form():
    page = "<body><form id='aspnet'><div class='menu'><a>x</a></div><article><p>One long paragraph.</p><p>Another one.</p></article><button>Go</button></form><footer>f</footer></body>"
    assert text_of(page) == "One long paragraph.\nAnother one."
    assert text_of("<body><p>Body text that is long enough.</p><form><p>Your name</p><input></form></body>") == "Body text that is long enough."


def test_references_end_with_their_text():
    assert text_of("<p>a &no<b>t</b> &amp;lt; &am<i>p;</i> &eacute;</p>") == "a &not &lt; &amp; \u00e9"


def test_readers_words_after_the_article():
    for name in ("class='user-comments'", "class='blog-comments'", "class='reader-responses'", "id='disqus_thread'", "id='comments-42'", "class='x commentlist'"):
        assert text_of(f"<body><article><p>Text.</p></article><div {name}><p>{'Said a reader. ' * 9}</p></div></body>") == "Text."
        assert text_of(f"<body><article><p>Text.</p><div {name}><p>{'Said a reader. ' * 9}</p></div></article></body>") == "Text."
    assert text_of("<body><div class='post has-comments'><p>Text.</p></div><div class='reader-comments-page'></div></body>") == "Text."
    assert text_of("<body><div class='blog-comments-layout'><p>A text of its own.</p></div><p>x</p></body>") == "A text of its own.\nx"


def test_small_menus_inside_articles():
    for name in ("sidebar", "menu", "navbar", "breadcrumbs"):
        page = f"<article><p>{'A long text of an article. ' * 4}</p><div class='{name}'><p>Other things</p></div><p>End.</p></article>"
        assert text_of(page).endswith("article.\nEnd.")
    assert "Soup" in text_of("<article><p>Our dishes</p><div class='menu'><p>Soup of the day with bread and butter</p></div></article>")
