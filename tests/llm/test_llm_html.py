"""Main text of pages: parsing, Viterbi against enumeration, labelled pages."""

import html
import itertools
import random
import re
import time

from weftgraph.llm import html_text
from weftgraph.llm.queries import REGISTRY

SF = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in html_text.leaf_blocks(page)]


def test_leaf_blocks():
    assert texts("<p>a <b>b</b>\n c<br>d<p>e&amp;f &lt;x&gt;&nbsp;g</div>h") == ["a b c d", "e&f <x> g", "h"]
    assert texts("<script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no --><p>yes</p><!-- open") == ["yes"]
    assert texts("<head><title>no</title></head><body>1 < 2 &am <ul><li>x<li>y</ul><p>cut <a href='q") == [
        "1 < 2 &am", "x", "y", "cut"]
    assert texts("") == [] and texts("plain") == ["plain"] and texts("<p></p><div> </div>") == []
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert texts(deep) == ["x"]
    assert len(texts("<p>word</p>" * 20_000)) == 20_000


def test_viterbi_is_the_best_of_all_sequences():
    rng = random.Random(3)
    for _ in range(50):
        field = html_text.Field({}, [[[rng.uniform(-2, 2) for _ in "ab"] for _ in "ab"] for _ in "abc"])
        s = [rng.uniform(-2, 2) for _ in range(rng.randint(1, 7))]
        changes = [rng.randint(0, 2) for _ in s[1:]]

        def value(y):
            return sum(a for a, l in zip(s, y) if l) + sum(field.moves[k][a][b] for k, a, b in zip(changes, y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(s)), key=value)
        assert abs(value(field.decode(s, changes)) - value(best)) < 1e-9
    assert html_text.Field({}, [[[0, 0], [0, 0]]] * 3).decode([], []) == []


def test_query_against_the_article_element(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = REGISTRY["op4_crf_html"](spark, SF).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(x for x in want if x)
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_furniture_of_other_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    field = html_text.fit(pages)
    long = "This is a paragraph of an article, and it is long enough to be read as one."
    note = "Readers may want to know that this is not a part of what the article says."
    for before, inside, after in (
            ("<header><h1>Site</h1><nav><a href=1>Home</a></nav></header>", "", f"<aside><p>{note}</p></aside>"),
            ("<div class='cookie-notice'><p>" + note + "</p></div>", f"<div class=comments><p>{note}</p></div>", ""),
            ("<ul id=menu><li>One<li>Two</ul>", f"<form><p>{note}</p><button>Send</button></form>", "<footer><p>(c)</p></footer>"),
            (f"<div class='ad'>{note}</div>", f"<div class='sidebar'><p>{note}</p></div>", f"<div id='related'><p>{note}</p></div>")):
        for name in ("article", "main"):
            page = f"<html><body>{before}<{name}><h1>Title</h1><p>{long}</p>{inside}<p>{long}</p></{name}>{after}</body></html>"
            assert field.main_text(page) == f"Title\n{long}\n{long}"


def test_names_do_not_decide(spark):
    field = html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    a = "This is a paragraph of an article, and it is long enough to be read as one."
    b = "Another long paragraph follows here, with more words that tell what happened next in the story."
    note = "Readers may want to know that this is not a part of what the article says."
    top, body = "<div class=topbar><a href=1>Home</a> <a href=2>News</a></div>", f"<p>{a}</p><p>{b}</p>"
    for page, want in (
            (f"<body class=widget><main>{body}</main></body>", [a, b]), (f"<article class='tags story'>{body}</article>", [a, b]),
            (f"<article><div class='widget post'>{body}</div></article>", [a, b]), (body, [a, b]),
            (f"<article><h1>T</h1>{body}<p>{a}</p><section class=discussion><p>{note}</p><p>I agree with that.</p></section></article>"
             f"<div class=responses><p>{note}</p><p>Nice one, thanks.</p></div>", ["T", a, b, a]),
            (f"<body>{top}{body}<p>{a}</p><div class=legal><p>All rights reserved by the owner.</p></div></body>", [a, b, a]),
            (f"<body>{top}<div class=qqq><h2>Head</h2>{body}<p>{a}</p></div><div class=legal><p>{note}</p></div></body>",
             ["Head", a, b, a])):
        assert field.main_text(page).split("\n") == want


def test_deep_nesting_takes_time_in_proportion():
    n = 100_000
    start = time.time()
    assert texts("<div>" * n + "x" + "</div>" * n) == ["x"]
    assert len(texts("".join(f"<div class=c{i % 7}>word " for i in range(n)))) == n
    assert len(texts("<span>" * n + "<li>a" * n)) == n
    assert len(texts("<div><table><tr><td>a" * (n // 4))) == n // 4
    field = html_text.Field({"in:li": 1.0}, [[[0, 0], [0, 0]]] * 3)
    assert field.main_text("<ul><li>" + "<div>a" * n).count("a") == n
    assert time.time() - start < 60


def test_sample_of_equal_pages(spark):
    same = "<article><p>The same words on every page, over and over.</p></article>"
    rows = [(i, "u", same if i % 3 else f"<article><p>Words of the page number {i} are here.</p></article>") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_text.fit(df).weights == html_text.fit(df.repartition(7)).weights


def test_edge_cases(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, None, None, "t"), (2, "u", "", "t"), (None, "u", "<article><p>Hello there, this is text.</p></article>", "t"),
            (2, "u", "", "t"), (3, "u", "<article>" + "<p>Words of a long page, one after the other.</p>" * 5000 + "</article>", "t")]
    df = spark.createDataFrame(rows, schema)
    got = html_text.text_report(df).collect()
    assert sorted(str(r["page_id"]) for r in got) == ["1", "2", "2", "3", "None"]
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == "" and by[None] == "Hello there, this is text." and by[3].count("\n") == 4999
    assert html_text.text_report(spark.createDataFrame([], schema)).collect() == []
