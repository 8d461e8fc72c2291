"""Extraction against the texts that pages were made from, and wrappers against their pages."""

import html
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geohotspots.llm import markup, queries
from geohotspots.llm import page_wrappers as pw

WORDS = "alpha beta gamma delta épsilon zeta <eta> theta & iota kappa".split()


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, n)))


def paragraphs(rng):
    return [sentence(rng, 30) for _ in range(rng.randint(1, 7))]


def marked(text, rng):
    text = html.escape(text).replace("é", "&eacute;")
    if " " in text and rng.random() < 0.4:
        head, tail = text.split(" ", 1)
        text = f"<b>{head}</b> <a href='/x'><em>{tail}</em></a>" if rng.random() < 0.2 else f"<strong>{head}</strong>\n\t {tail}"
    return text


def named_page(rng, no):
    """An article with a title, lists and quotes, and every kind of noise in and around it."""
    body, blocks = "", []
    for text in paragraphs(rng):
        blocks.append(text)
        kind = rng.randrange(5)
        if kind == 0:
            more = [sentence(rng) for _ in range(rng.randint(1, 4))]
            body += f"<p>{marked(text, rng)}<ul>" + "".join(f"<li>{marked(m, rng)}" for m in more) + "</ul>"
            blocks += more
        elif kind == 1:
            body += f"<h2>{marked(text, rng)}</h2>"
        elif kind == 2:
            body += f"<blockquote><p>{marked(text, rng)}</blockquote>"
        else:
            body += f"<p>{marked(text, rng)}</p>\n"
        if rng.random() < 0.2:
            body += f"<div class='ad-slot'>{sentence(rng)}</div><script>if (1 < 2) {{ '</p>' }}</script>"
    title = sentence(rng)
    notice = f"<div id=cookie-notice><p>{sentence(rng, 40)}</p></div>" if rng.random() < 0.4 else ""
    comments = "".join(f"<li><article class='comment'><p>{sentence(rng, 40)}</p></article>" for _ in range(rng.randrange(5)))
    side = f"<aside><h3>More</h3><p>{sentence(rng, 60)}</p></aside>" if rng.random() < 0.5 else ""
    return (
        f"<!DOCTYPE html><html><head><title>T {no}</title><style>p {{}}</style></head><body class='has-sidebar'>{notice}"
        f"<header><p>{sentence(rng)}</p></header><nav><ul><li><a href=/>Home</a><li><a href=/a>{sentence(rng)}</a></ul></nav>"
        f"<!-- <p>hidden</p> --><div class='content'><article><h1>{marked(title, rng)}</h1>{body}</article>{side}"
        f"<section id='comments'><h2>Comments</h2><ol>{comments}</ol></section></div>"
        f"<form><p>{sentence(rng)}</p><input><button>Go</button></form><footer>&copy; {sentence(rng)}</footer></body></html>"
    ), "\n".join([title, *blocks])


def unnamed_page(rng, no):
    """Plain containers: fixed menu, text, fixed footer; only the text differs by page."""
    texts = paragraphs(rng) + [sentence(rng, 40)]
    body = "".join(f"<p>{marked(t, rng)}</p>" for t in texts)
    return (
        f"<body><div><ul><li><a href=/1>Start</a><li><a href=/2>All the long list of topics of this site</a></ul></div>"
        f"<div>{body}</div><div><span>Printed and published by the makers of this site, all rights reserved.</span></div>"
    ), "\n".join(texts)


def clean(text):
    return " ".join(text.split())


@pytest.fixture(scope="module")
def hosts(spark):
    rng = random.Random(7)
    rows = []
    for no in range(400):
        make, host = (named_page, "Named.Example") if no % 2 else (unnamed_page, "plain.example:8080")
        if no % 10 == 9:
            host = f"single{no}.example"
            make = named_page
        page, text = make(rng, no)
        rows.append((no, f"https://u@{host}/p/{no}", page, text))
    return spark.createDataFrame(rows, "page_id long, url string, html string, wanted string")


def test_texts_come_back(hosts):
    got = {r.page_id: r for r in pw.page_texts(hosts).collect()}
    wanted = {r.page_id: r.wanted for r in hosts.collect()}
    wrong = [i for i, t in wanted.items() if got[i].text != t]
    assert not wrong, (wanted[wrong[0]], got[wrong[0]].text, len(wrong))
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_small_fan_in_gives_the_same_texts(hosts, monkeypatch):
    wanted = {tuple(r) for r in pw.page_texts(hosts).collect()}
    monkeypatch.setattr(pw, "FAN_IN", 3)
    assert {tuple(r) for r in pw.page_texts(hosts).collect()} == wanted


def test_wrapper_does_not_depend_on_partitions(hosts):
    wanted = sorted(map(tuple, pw.wrappers(hosts.repartition(1)).collect()))
    assert sorted(map(tuple, pw.wrappers(hosts.repartition(7)).collect())) == wanted
    assert len(wanted) == 42


def test_two_layouts_of_one_host(spark):
    rng = random.Random(3)
    rows = [(n, "http://x.example/", *(named_page if n % 3 else unnamed_page)(rng, n)) for n in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wanted string")
    got = {r.page_id: r.text for r in pw.page_texts(pages).collect()}
    assert {r[0]: r[3] for r in rows} == got


def expression(page):
    return pw._read(page)[0]


def test_repetition_and_options():
    one = expression("<div class=a><p>x</p></div><ul><li>1</ul>")
    two = expression("<div class=a><p>x</p><p>y</p></div><p>new</p><ul><li>1<li>2<li>3</ul>")
    assert one == "div/-(p/-(#)) ul/-(li/-(#))"
    assert pw._merge([one, two]) == "div/-(p/-(#)+) p/-(#)? ul/-(li/-(#)+)"
    terms = expression("<dl><dt>a<dd>b<dt>c<dd>d</dl>")
    assert terms == "dl/-([dt/-(#) dd/-(#)]+)"
    assert pw._merge([terms, expression("<dl><dt>a<dd>b</dl>")]) == "dl/-([dt/-(#) dd/-(#)]+)"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<p>t", "<div class=q>", "</div>", "<ul><li>a<li>b</ul>", "<h2>h</h2>", "x", "<section>", "</section>"]), max_size=14), min_size=1, max_size=6))
def test_every_page_fits_its_wrapper(pages):
    forms = [expression("".join(p)) for p in pages]
    wrapper = pw._merge(forms)
    assert markup.write(markup.parse(wrapper)) == wrapper
    for form, page in zip(forms, pages):
        assert markup.write(markup.parse(form)) == form
        assert -1 not in markup.places(form, wrapper)
        items, texts, _ = markup.read("".join(page))
        held = sorted(t for leaf in markup.leaves(markup.folded(items)) for t in leaf.texts)
        assert held == list(range(len(texts)))


@pytest.mark.parametrize(
    "page, texts",
    [
        ("a &lt;b&gt; &amp c&nbsp;&#100;<br>e", ["a <b> & c d e"]),
        ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]),
        ("<script>var x = '<p>no</p>'</script>yes<style>p{}</style><!-- no --> too", ["yes too"]),
        ("1 < 2 and <3 <notatag", ["1 < 2 and <3 <notatag"]),
        ("<p title=\"a > b\">in</p><p title=it's>out</p> it's", ["in", "out", "it's"]),
        ("<!--><p>seen</p><!-- open <p>gone</p>", ["seen"]),
        ("</div></p>text</b>", ["text"]),
        ("<script>never closed <p>x", []),
        ("<head><title>t</title><body><p>x", ["x"]),
        ("", []),
    ],
)
def test_reading(page, texts):
    assert markup.read(page)[1] == texts


def test_large_and_deep_pages():
    deep = "<div>" * 20_000 + "core" + "</div>" * 20_000
    items, texts, _ = markup.read(deep)
    assert texts == ["core"] and len(markup.write(markup.folded(items))) < 2_000
    rng = random.Random(1)
    wide = "".join(f"<{t}>{t}</{t}>" for t in rng.choices(["p", "h2", "ul", "pre", "h3", "table", "dl"], k=20_000))
    items, texts, _ = markup.read(wide)
    assert len(texts) == 20_000 and len(markup.write(markup.folded(items))) < 1_000
    names = "".join(f"<div class='{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{chr(97 + i // 676)}'>t</div>" for i in range(3_000))
    assert len(markup.write(markup.folded(markup.read(names)[0]))) < 1_000


def test_odd_rows(spark):
    rows = [
        (1, "http://a.example/", None), (2, None, None), (3, None, "<p>no address</p>"), (4, "relative", ""),
        (None, "http://a.example/", "<html><body></body></html>"), (5, "HTTP://A.example", "plain words only"),
        (6, "http://b.example", "<article><p>" + "long " * 100_000 + "</article>"),
        (7, "http://c.example", "<article>same</article>"), (7, "http://c.example", "<article>same</article>"),
        (8, "http://d.example", "<nav>only a menu</nav>"), (9, "http://e.example", "<p>\U0001F600 \U00010348</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in "text host row read page_form leaves blocks kept leaf slot expression wrapper".split():
        pages = pages.selectExpr("*", f"'{name}' as {name}")
    got = [(r.page_id, r.text) for r in pw.page_texts(pages).collect()]
    assert len(got) == len(rows)
    found = dict(got)
    assert [found[i] for i in (1, 2, 3, 4, None, 5, 7)] == ["", "", "no address", "", "", "plain words only", "same"]
    assert found[6] == ("long " * 100_000).strip() and found[9] == "\U0001F600 \U00010348"
    assert got.count((7, "same")) == 2
    assert pw.extract(pages).select("row.*").columns == pages.columns
    assert pw.page_texts(pages.limit(0)).count() == 0 and pw.wrappers(pages.limit(0)).count() == 0


def test_query_on_given_pages(spark):
    """The given pages keep their text in one article, with blocks of h1 and p only."""
    folder = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in queries.op12_wrappers(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [clean(html.unescape(re.sub(r"<[^>]*>", " ", b))) for b in re.split(r"</?(?:h1|p)>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].url == r.url
