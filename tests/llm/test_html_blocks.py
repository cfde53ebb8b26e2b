from civicframe.llm import html_blocks as H

ARTICLE = "The cat sat on the mat and it was warm in the sun for most of the day, as it is in the summer."
PAGE = (
    '<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, it is the best of all.</div>'
    f'<article><h1>Head &eacute;</h1><p><b>First  line.<br><p>{ARTICLE}</p><p>Ok.</p>'
    '<form><label>Mail</label><input name=x></form><div id="comments"><p>I think that this is the best of the things I have seen on the web.</p></div>'
    '<p>Last &lt;b&gt; &#8364;\n 5</p></article><aside>More of the same on this site.</aside><footer>&copy; me</footer></body></html>'
)


def test_article_without_the_rest():
    assert H.extract(PAGE) == f"Head é\nFirst line.\n{ARTICLE}\nOk.\nLast <b> € 5"


def test_without_article_element_rules_decide():
    page = f"<div><a href=x>one</a> <a href=y>two</a></div><h1>Title</h1><p>{ARTICLE}</p><p>Short.</p><p>{ARTICLE}</p><div><a href=z>link</a></div><p>All rights.</p>"
    assert H.extract(page) == f"Title\n{ARTICLE}\nShort.\n{ARTICLE}"


def test_article_inside_a_main_part_and_comments_as_articles():
    page = (
        f'<main id="content"><header><h2>Site</h2></header><div class="breadcrumbs">a / b</div><article class="post has-comments"><header><h1>Title</h1></header>'
        f'<p class="notice">We use cookies, as it is the law.</p><p>{ARTICLE}</p><ul><li>one</li><li>two</li></ul><table><tr><td>cell</td></tr></table>'
        f'<article class="comment"><p>{ARTICLE}</p></article></article><article class="comment"><p>{ARTICLE}</p></article>'
        f'<section class="comments"><p>{ARTICLE}</p></section><button>Go</button></main><div class="cookie-banner">{ARTICLE}</div>'
    )
    assert H.extract(page) == f"Title\n{ARTICLE}\none\ntwo\ncell"


def test_main_part_without_article():
    page = f'<div class="sidebar"><p>{ARTICLE}</p></div><div id="main-content"><h1>T</h1><p>{ARTICLE}</p><p>End.</p></div><div>{ARTICLE}</div>'
    assert H.extract(page) == f"T\n{ARTICLE}\nEnd."


def test_body_beside_card_articles():
    body, card = f"<h1>Title</h1><p>{ARTICLE}</p><p>{ARTICLE}</p><p>{ARTICLE}</p>", "<h3>Other</h3><p>Read it.</p>"
    whole = "\n".join(["Title", *[ARTICLE] * 3])
    for page in (
        f'<main>{body}</main><article class="card">{card}</article>',
        f'<div class="post-content">{body}</div><article class="related-post">{card}</article>',
        f'<nav>Menu</nav><div>{body}</div><footer>Foot</footer><article class="card">{card}</article>',
        f'<main>{body}<aside>More</aside><article class="card">{card}</article></main>',
    ):
        assert H.extract(page).startswith(whole), page
    assert H.extract(f'<main>{body}</main><article class="card">{card}</article><aside>More</aside>') == whole


def test_link_lists_inside_an_article_stay():
    sources = "<ul><li><a href=a>Report of the water board</a></li><li><a href=b>Minutes</a>, 2019</li></ul>"
    page = f"<article><p>{ARTICLE}</p><h2>Sources</h2>{sources}</article><ul><li><a href=c>Home</a></li></ul>"
    assert H.extract(page) == f"{ARTICLE}\nSources\nReport of the water board\nMinutes, 2019"


def test_article_in_a_language_without_stop_words_stays():
    text = "Szybki brązowy lis przeskoczył nad leniwym psem, potem wrócił lasem przed zmrokiem. " * 4
    assert H.extract(f"<article><p>{text}</p></article><div><p>{ARTICLE}</p></div>") == text.strip()


def test_odd_pages():
    assert H.extract("") == ""
    assert H.extract("<article>") == ""
    assert H.extract("<article><p>cut off") == "cut off"
    assert H.extract("<article><p title='a>b' x=\">\">kept</p></article>") == "kept"
    assert H.extract("<article><p>a < b and <3</p>") == "a < b and <3"
    assert H.extract("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert H.extract("<article><p>before<script>if (a<b) x('</p>')") == "before"


def test_long_page_is_whole():
    text = " ".join(["the word"] * 50_000)
    assert H.extract(f"<main><p>{text}</p></main>") == text


def test_spark_rows(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, None), (None, None, None, "x"), (3, "", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in H.apply(pages).collect()}
    text = H.extract(PAGE)
    assert H.apply(pages).count() == 4
    assert found == {(1, "u", text, len(text)), (None, None, "", 0), (3, "", "", 0)}
    assert H.apply(pages.limit(0)).count() == 0
