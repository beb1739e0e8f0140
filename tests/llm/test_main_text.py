"""Main text by site style trees: planted sites, what the tree decides alone, the driver's pages and odd cases."""

import os
import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import html_extract as h

DATA = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def main(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.page_id: r.main for r in h.extract_main_text(df, text_col="main", **options).collect()}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def page(i):
    body = " ".join(f"word{i}x{k}" for k in range(40))
    return f"<html><head><title>t</title><script>var a='<p>';</script></head><body><div class='x1'><a href='/'>Home</a> Shop</div><div class='x2'><p>{body} &amp; more</p><p>Second\n  part {i}</p></div><div class='x3'>All rights kept</div></body></html>"


def test_what_a_site_repeats_goes(spark):
    rows = [(i, f"http://Site.example/{i}", page(i)) for i in range(12)]
    rows += [(20, None, None), (21, "http://one.example/", ""), (22, "http://two.example", "<p>a &lt; b <b>c</b>d<br>e<nav>menu</nav>"), (23, "no url", "<div>1 < 2 <p>open <div>text</p></b>")]
    got = main(spark, rows)
    for i in range(12):
        assert got[i] == " ".join(f"word{i}x{k}" for k in range(40)) + f" & more Second part {i}"
    assert [got[i] for i in (20, 21, 22, 23)] == ["", "", "a < b cd e", "1 < 2 open text"]
    assert main(spark, rows, broadcast_entries=0) == got
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError):
        h.extract_main_text(df, text_col="html")
    assert h.extract_main_text(df.limit(0), text_col="main").count() == 0
    extra = h.extract_main_text(df.withColumn("site", F.lit(1)).withColumn("node", F.lit("n")), text_col="main")
    assert extra.columns == ["page_id", "url", "html", "site", "node", "main"] and extra.where("site = 1 and node = 'n'").count() == len(rows)


def varied(rng, i):
    """Menus, adverts and a footer of ever other words in elements without telling names, and a story of any length."""
    menu = "".join(f"<li><a href='/{k}'>{words(rng, 1)}</a></li>" for k in range(6))
    story = [words(rng, rng.randint(5, 120)) for _ in range(rng.randint(1, 9))]
    html = f"<body><div class='k1'><ul>{menu}</ul></div><div class='k2'>{words(rng, 7)}</div><div class='k3'><h1>{words(rng, 5)}</h1>" + "".join(f"<p>{p}</p>" for p in story) + f"</div><div class='k4'>{words(rng, 9)} {i}</div></body>"
    return html, " ".join(" ".join(re.sub("<[^>]*>", " ", html.split("class='k3'>")[1].split("</div>")[0]).split()).split())


def test_varying_parts_without_names_go_by_the_tree_alone(spark):
    rng = random.Random(5)
    made = {i: varied(rng, i) for i in range(60)}
    rows = [(i, "http://plain.example/x", html) for i, (html, _) in made.items()]
    rows += [(100 + k, "http://plain.example/x", made[0][0]) for k in range(40)]  # copies count once
    got = main(spark, rows)
    assert all(got[i] == text for i, (_, text) in made.items()) and all(got[100 + k] == made[0][1] for k in range(40))
    trees = h.site_style_trees(spark.createDataFrame(rows, SCHEMA)).where("size(up) = 1").first()
    assert round(trees.n) == 60


def test_parts_of_an_article_stay(spark):
    inner = "<header><h1>T{i}</h1></header><p class='byline'>By Ann</p><p>Body {i} text</p><div class='related'>See also {i}</div><div class='share'>tell {i}</div><blockquote class='notice'>mind {i}</blockquote>"
    html = "<body><nav><a>Home</a></nav><div class='cookie-notice'>We use them</div><article>" + inner + "<section class='comments'><p>first!</p></section><form>go</form></article><aside>side</aside><footer>f</footer></body>"
    for n in (1, 3, 30):
        got = main(spark, [(i, "https://a.example/", html.replace("{i}", str(i))) for i in range(n)])
        assert all(got[i] == f"T{i} By Ann Body {i} text See also {i} tell {i} mind {i}" for i in range(n))


def test_a_story_beside_an_article_teaser_stays(spark):
    rng = random.Random(6)
    stories = [[words(rng, rng.randint(20, 150)) for _ in range(rng.randint(2, 9))] for _ in range(40)]
    rows = [(i, "http://b.example", f"<article><p>read {i}</p></article><div class='story'>" + "".join(f"<p>{p}</p>" for p in s) + "</div>") for i, s in enumerate(stories)]
    got = main(spark, rows)
    assert all(got[i] == f"read {i} " + " ".join(s) for i, s in enumerate(stories))


def test_long_and_deep_pages(spark):
    deep = "<div>" * 5000 + "<p>core</p>" + "</div>" * 5000
    long_ = "<article>" + "".join(f"<p>w{k} &amp;</p>" for k in range(60_000)) + "</article><footer>end</footer>"
    got = main(spark, [(1, "http://d.example", deep), (2, "http://l.example", long_), (2, "http://l.example", long_)])
    assert got[1] == "core" and got[2] == " ".join(f"w{k} &" for k in range(60_000))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_query_gives_the_articles_and_the_tree_agrees_with_the_roles(spark):
    """Brute force: the article element of every page. Without roles (no prior) the tree itself puts the menus, adverts and
    footers of every host with enough pages below the yardstick, and no article."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {r.page_id: (r.url, " ".join(unescape(re.sub(r"<[a-zA-Z/][^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", re.search("<article>(.*?)</article>", r.html, re.S)[1]))).split())) for r in pages.collect()}
    got = h.op3_site_style_tree(spark, DATA).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    trees = h.site_style_trees(pages, prior_pages=0.0).where("n >= 10 and outer")
    yard = trees.where("role = 2").groupBy("site").agg(F.min("importance").alias("yard"))
    judged = trees.where("role = 0").join(yard, "site").agg(F.count("*").alias("n"), F.count_if(F.col("importance") < h.RATIO * F.col("yard")).alias("low")).first()
    assert judged.n == judged.low >= 10


STORY = " ".join(f"Word{i} of the story goes on." for i in range(12))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><head><title>t</title><meta charset=utf-8><body><nav>Menu</nav><article><h1>Head</h1><p>{STORY}</p></article></body></html>", f"Head {STORY}"),
        (f"<html><head><title>t</title><div><article><p>{STORY}</p></article></div></html>", STORY),
        (f"<head><title>t</title>loose <article><p>{STORY}</p></article>", None),
        (f"<body><form id=aspnetForm><nav>Menu</nav><input name=a><select><option>one</select><article><h1>Head</h1><p>{STORY}</p></article><button>Send</button></form>", f"Head {STORY}"),
        (f"<body><form><div><p>{STORY}</p></div></form><form><p>Your mail</p></form></body>", STORY),
        (f'<body><article class="no-comments"><p>{STORY}</p></article>', STORY),
        (f'<body><div class="post comments-enabled"><article><p>{STORY}</p></article><div class="comment-list"><article class="comment"><p>I disagree</p></article></div></div>', STORY),
        (f'<body><div class="content comments"><h1>Head</h1><article><p>{STORY}</p></article><section id="comments"><p>I disagree</p></section></div>', f"Head {STORY}"),
        (f"<body><article><p>{STORY}</p><p>So <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds</p><svg><style>x</style><text>Axis</text></svg><object>Other</object><noscript><p>Plain</p></noscript></article>", f"{STORY} So E=m holds Axis Other Plain"),
        (f"<body><noscript>Switch it on</noscript><article><p>{STORY}</p></article>", STORY),
    ],
)
def test_articles_that_valid_pages_hold(page, text):
    found = h.main_text(page, set())
    assert found == text if text is not None else STORY in found
