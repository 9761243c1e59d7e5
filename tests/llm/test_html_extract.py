import html
import random
import re

import pytest
from pyspark.sql import functions as F

from spanlight.llm import queries
from spanlight.llm.html_extract import extract_main_text, main_text

PROSE = "The committee, which met on Tuesday, heard three reports and agreed on none of them."


def plain(page):
    """What this table's pages hold: the heading and paragraphs of their article element."""
    body = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"<p>|</p>|<h1>|</h1>", body[1]) if body else []
    texts = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in blocks)
    return "\n\n".join(t for t in texts if t)


def test_table_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{path}/pages.parquet").collect()
    found = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op4_html_extract(spark, path).collect()}
    assert found == {p.page_id: (p.url, plain(p.html), len(plain(p.html))) for p in pages}


@pytest.mark.parametrize(
    "wrap",
    [
        "<article>{}</article>",
        "<main><div class='has-sidebar'>{}</div></main>",
        "<div id=content>{}</div>",
        "<div class=wrap><div class='post body'>{}</div><div class=sidebar><p>{}</p></div></div>".replace("{}", "{}", 1).replace("<p>{}</p>", "<p>Side, side, side, side, side and more side text here.</p>"),
    ],
)
def test_only_the_article_stays(wrap):
    inner = f"<h1>A &amp; B</h1><p>{PROSE}<p>Short.</p><div class='ad-slot'><p>{PROSE} Buy.</p></div><ul><li>One&nbsp;item<li>Two</ul><p>{PROSE}<br>More \n text &#8212; &eacute;</p><form>{PROSE}</form><blockquote><p>{PROSE}</p></blockquote>"
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>{PROSE}";</script></head><body class="page">
    <header><p>{PROSE} Header.</p></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice"><p>{PROSE} Cookies.</p></div>
    {wrap.format(inner)}<section id="comments"><h2>Comments</h2><p>{PROSE} I agree.</p></section><aside><p>{PROSE}</p></aside><footer>&copy; {PROSE}</footer></body></html>"""
    want = ["A & B", PROSE, "Short.", "One item", "Two", f"{PROSE} More text — é", PROSE]
    assert main_text(page) == "\n\n".join(want)


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<html><nav>x</nav>") == ""
    assert main_text("just text, &lt;b&gt;") == "just text, <b>"
    assert main_text(f"<p>{PROSE}<p>{PROSE}<div") == f"{PROSE}\n\n{PROSE}"
    assert main_text(f"</div></b><p>a < b {PROSE}</i></p><!-- never closed <p>{PROSE}") == f"a < b {PROSE}"
    long = "<article>" + "".join(f"<p>{PROSE} {i}</p>" for i in range(20000)) + "</article>"
    assert main_text(long).count("\n\n") == 19999
    assert main_text("<div>" * 5000 + f"<p>{PROSE}</p>") == PROSE


def test_edges(spark):
    schema = "page_id long, url string, html string"
    assert extract_main_text(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", f"<p>{PROSE}</p>")], schema).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    assert [tuple(r) for r in extract_main_text(df).collect()] == [(None, None, "", 0), (1, "u", "", 0), (1, "u", PROSE, len(PROSE))]


def test_unclosed_cut_elements_end_and_short_siblings_stay():
    from spanlight.llm.html_extract import main_text

    long = "A long paragraph, with commas, that reads like the article of this page and goes on for a while."
    assert main_text(f"<body><article><p class='notice'>Cut<p>{long}<p>Two, and more.</article>") == f"{long}\n\nTwo, and more."
    assert main_text(f"<body><article><div><p class='ad'>x</div><p>{long}</p></article>") == long
    assert main_text(f"<body><article><ul><li class='ad'>x<li>{long}</ul></article>") == long
    assert main_text(f"<body><article><div><table class='ad'><tr><td>x</div>y</table></div><p>{long}</p></article>") == long
    page = f"<body><div><div><p>{long}</p><p>{long}</p></div><section><h3>Short</h3><ul><li>One</li></ul></section></div>"
    assert main_text(page) == f"{long}\n\n{long}\n\nShort\n\nOne"


@pytest.mark.parametrize(
    "script",
    [
        "<script>for (var i=0;i<n;i++){x()}</script>",
        "<script>var s = '<!-- never closed';</script>",
        "<SCRIPT>var s = \"<a href='\" + u;</SCRIPT >",
        "<style>p > a::before{content:'<p'}</style>",
        "<svg><path d='M0 0'>",
        "<div><object data=x></div>",
        "<noscript><img src=x><p>Turn scripts on, please.</p></noscript>",
        "<textarea><p>not markup</textarea>",
        "<iframe src=x><p>old</iframe>",
    ],
)
def test_what_stands_before_the_article_does_not_swallow_it(script):
    for page in (f"<body><div>{script}</div><article><p>{PROSE}</p></article>", f"<body>{script}<main><p>{PROSE}</p></main>", f"<html><head>{script}</head><body><article><p>{PROSE}</p></article>"):
        assert main_text(page) == PROSE


@pytest.mark.parametrize(
    "inner, want",
    [
        (f"<p title='the hidden valley'>{PROSE}</p>", PROSE),
        (f"<p data-x='class=\"ad\"'>{PROSE}</p>", PROSE),
        (f"<p class='share-price'>{PROSE}</p>", PROSE),
        (f"<p>{PROSE} <a href='/p?id=ad-5'>the words of a link</a></p>", f"{PROSE} the words of a link"),
        (f"<p>{PROSE} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p>", f"{PROSE} x=2"),
        (f"<div class='share-bar'>{PROSE}</div><p>{PROSE}</p>", PROSE),
        (f"<div class=related-posts><p>{PROSE}</p></div><p>{PROSE}</p>", PROSE),
        (f"<p hidden>{PROSE}</p><p>{PROSE}</p>", PROSE),
        (f"<p data-hidden=no aria-hidden='true'>{PROSE}</p><p>{PROSE}</p>", PROSE),
    ],
)
def test_attributes_are_read_one_by_one(inner, want):
    assert main_text(f"<body><nav>x</nav><article>{inner}</article>") == want


def test_both_articles_stay():
    assert main_text(f"<body><main><article><p>{PROSE}</p><p>{PROSE}</p></article><article><p>Short, but an article.</p></article></main>") == f"{PROSE}\n\n{PROSE}\n\nShort, but an article."


def test_generated_pages_equal_what_went_in():
    """Pages put together at random from blocks that belong to the article and parts that do not."""
    rng = random.Random(7)
    word = lambda: rng.choice("the a river stone, lamp walked slowly. under & over <b>bright</b> &amp; &lt;tag&gt;".split())
    plain = lambda t: " ".join(html.unescape(re.sub("</?b>", "", t)).split())
    junk = [
        "<script>if (a<b && c>d) { s = '</p><p>' }</script>", "<style>a>b{}</style>", "<!-- <p>gone</p> -->", "<nav><a href=/>Home</a></nav>", "<form><p>Name, please</p><input name=q></form>",
        "<div class='ad-box'><p>Buy, buy and buy again today</p></div>", "<aside><p>Aside, with commas, and words</p></aside>", "<div id=cookie-notice>We use cookies, many of them.</div>",
        "<button>Press</button>", "<ul class='share-buttons'><li>Post</li></ul>", "<svg><text>chart</text></svg>", "<p style='display: none'>unseen text, with commas</p>",
    ]
    for _ in range(300):
        blocks = [" ".join(word() for _ in range(rng.randrange(12, 60))).replace(" & ", " &amp; ").replace(" <b>bright</b>", " <b>bright</b>") for _ in range(rng.randrange(2, 9))]
        open_tag = rng.choice(["<article>", "<main>", "<article title='the hidden menu'>", "<main data-ad='x y'>"])
        parts = []
        for t in blocks:
            if rng.random() < 0.4:
                parts.append(rng.choice(junk))
            parts.append(f"<p{rng.choice(['', ' class=lead', ' title=\"a footer\"'])}>{t}{rng.choice(['</p>', '</p>', ''])}")
        tail = "".join(rng.sample(junk, rng.randrange(4)))
        page = f"<html><head>{rng.choice(junk[:3])}<title>A <b> title</title></head><body>{''.join(rng.sample(junk, rng.randrange(4)))}{open_tag}{''.join(parts)}</{open_tag[1:].split()[0].rstrip('>')}>{tail}<footer><p>Foot, note, and more</p></footer></body></html>"
        assert main_text(page) == "\n\n".join(map(plain, blocks)), page


@pytest.mark.parametrize("name", ["class='commentary'", "id='promotion-of-health'", "id='bannerman-castle'", "id='sponsors-of-the-bill'", "id='informed-consent'", "class='cookie-recipes'", "id='menu-of-the-week'", "class='recommended-reading-ages'"])
def test_names_of_article_parts_do_not_cut(name):
    page = f"<body><nav>Home</nav><article><h1>T</h1><p>{PROSE}</p><section {name}><h2>Part</h2><p>{PROSE} Inside.</p></section></article></body>"
    assert main_text(page) == f"T\n\n{PROSE}\n\nPart\n\n{PROSE} Inside."


@pytest.mark.parametrize("name", ["class='comments'", "id='comment-list'", "class='promo-box'", "class='ad-slot'", "class='advert-leaderboard-unit'", "class='sponsored-content'", "id='cookie-notice'", "class='newsletter-signup'", "class='share-bar'", "class='user-comments-section'"])
def test_names_of_other_parts_cut_inside_articles(name):
    page = f"<body><article><h1>T</h1><p>{PROSE}</p><div {name}><p>{PROSE} Other.</p></div><p>{PROSE}</p></article></body>"
    assert main_text(page) == f"T\n\n{PROSE}\n\n{PROSE}"


def test_a_page_inside_one_form():
    body = f"<div id=content><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>"
    fields = "<input name=q><select><option>One</select><button>Go</button>"
    want = "\n\n".join(["T", *[PROSE] * 3])
    assert main_text(f"<body><form method=post>{fields}{body}</form></body>") == want
    assert main_text(f"<body><form><article><h1>T</h1><p>{PROSE}</p></article>{fields}</form></body>") == f"T\n\n{PROSE}"
    assert main_text(f"<body>{body}<form><p>Your mail address, please, for news.</p>{fields}</form></body>") == want


def test_lists_and_titles_of_articles():
    links = "".join(f"<li><a href=/{k}>Source number {k}, a report</a></li>" for k in range(4))
    page = f"<body><h1>Title</h1><article><p>{PROSE}</p><ul>{links}</ul><p>Go on.</p><p><button>Share</button></p></article></body>"
    want = ["Title", PROSE, *(f"Source number {k}, a report" for k in range(4)), "Go on."]
    assert main_text(page) == "\n\n".join(want)
    assert main_text(f"<body><h1>Site</h1><article><h1>Title</h1><p>{PROSE}</p></article><h1>After</h1></body>") == f"Title\n\n{PROSE}"


@pytest.mark.parametrize("opening", ["<div>", "<nav><div>", "<p><table><tr><td><div>", "<ul><li>", "<div><p>Some words that are long enough to earn points, here.", "<span>", "<aside><svg><g>"])
def test_deep_pages_take_linear_time(opening):
    import time

    page = f"<article><p>{PROSE}</p></article>" + opening * (100_000 // opening.count("<")) + "x"
    main_text(page[:1000])
    began = time.process_time()
    text = main_text(page)
    assert (PROSE in text) != ("earn points" in text)  # what has most points is the article
    assert time.process_time() - began < 3


def test_generated_pages_give_back_what_went_in():
    """Blocks inside elements with harmless names, between parts that go."""
    rng = random.Random(11)
    kept = ["", "class=commentary", "id=promotion-of-health", "class='lead story'", "id=bannerman-castle", "class=has-sidebar", "id=share-price"]
    gone = ["<div class=comments>{}</div>", "<aside>{}</aside>", "<div class='ad-slot'>{}</div>", "<form><input>{}</form>", "<div role=navigation>{}</div>", "<section id=related-posts>{}</section>", "<footer>{}</footer>"]
    for _ in range(200):
        want, parts = [], []
        for k in range(rng.randint(2, 8)):
            text = f"{PROSE} Number {k}."
            if rng.random() < 0.3:
                parts.append(rng.choice(gone).format(f"<p>{text} Gone.</p>"))
            tag = rng.choice(["p", "p", "h2", "blockquote", "li"])
            inner = f"<{tag}>{html.escape(text)}</{tag}>"
            parts.append(f"<div {rng.choice(kept)}>{f'<ul>{inner}</ul>' if tag == 'li' else inner}</div>")
            want.append(text)
        wrap = rng.choice(["<article>{}</article>", "<form action=/x><main>{}</main><input></form>", "<main><article>{}</article></main>"])
        page = f"<html><body><header><p>{PROSE} Head.</p></header>{wrap.format(''.join(parts))}<footer>F</footer></body></html>"
        assert main_text(page) == "\n\n".join(want), page
