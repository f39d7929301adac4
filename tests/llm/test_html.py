"""Wrapper induction: template blocks go wherever they stand, varying slots decide, odd pages neither crash nor are cut."""

import random
from itertools import combinations

import pytest

from tidewater.llm import html_text as H


def run(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r.text for r in H.main_text(df).collect()}


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_constant_line_in_the_article(spark):
    page = "<body><article><h1>T%d</h1><p>%s</p><p>Share this story with friends</p><p>%s</p></article></body>"
    rows = [(i, f"http://a.com/{i}", page % (i, words(20, i), words(9, -i))) for i in range(3)]
    assert run(spark, rows) == {i: f"T{i}\n\n{words(20, i)}\n\n{words(9, -i)}" for i in range(3)}


def test_slots_decide_without_article(spark):
    """A long constant part would win by length: only the comparison of pages shows that it is template."""
    about = "".join(f"<p>{words(30, 1000 + k)}</p>" for k in range(10))
    page = '<div class="x1"><h2>About us</h2>%s</div><div class="f("><div class="w-[calc(100%%-1rem)] a"><h1>Title %d</h1></div><div class="b)"><p>%s</p><p>%s</p></div></div><div class="z"><p>See %d</p></div>'
    rows = [(i, f"http://b.com/{i}", page % (about, i, words(40, i), words(30, 50 + i), i)) for i in range(5)]
    want = {i: f"Title {i}\n\n{words(40, i)}\n\n{words(30, 50 + i)}" for i in range(5)}
    assert run(spark, rows) == want
    assert all(H.extract(H.parse(html)) != want[i] for i, _, html in rows)


def test_copies_keep_their_text(spark):
    """Pages that are copies but for a line: what is constant is most of the text, so nothing says that it is template."""
    rows = [(i, f"http://c.com/{i}", f"<article><h1>Same</h1><p>{words(40, 7)}</p><p>page {i}</p></article>") for i in range(4)]
    assert run(spark, rows) == {i: f"Same\n\n{words(40, 7)}\n\npage {i}" for i in range(4)}


@pytest.mark.parametrize("name", ["entry-header", "w-[calc(100%-1rem)]", "f(", ")", "chapter search", "social-history", "related-work", "badge", "x\x1fy"])
def test_names_that_only_look_like_parts(spark, name):
    assert H.extract(H.parse(f'<article><div class="{name}"><h1>Head</h1></div><p>text</p></article>')) == "Head\n\ntext"


@pytest.mark.parametrize("part", ["<nav>m</nav>", '<div class="sidebar">s</div>', "<aside>s</aside>", '<p class="ad">buy</p>', "<form>q</form>", '<div id="comments"><p>great</p></div>', '<div class="cookie-notice">c</div>', "<script>x</script>", "<style>y</style>", "<footer>f</footer>", '<section class="x comment-list"><p>hm</p></section>'])
def test_parts_set_aside(part):
    assert H.extract(H.parse(f"<header>H</header><article><h1>Head</h1>{part}<p>text</p></article>{part}")) == "Head\n\ntext"


def test_any_width_and_depth(spark):
    wide = "".join(f'<p class="c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}">para {i}</p>' for i in range(20_000))
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000 + "</b></section>" * 5000
    got = run(spark, [(1, "http://d.com/1", f"<article>{wide}</article>"), (2, "http://d.com/2", deep), (3, "http://d.com/3", f'<div class="{"q" * 100_000}">x <a href="{"u" * 100_000}">y</a></div>')])
    assert got[1].count("\n\n") == 19_999 and got[2] == "deep" and got[3] == "x y"


def test_two_articles_and_ties():
    assert H.extract(H.parse('<article class="a"><p>long text here</p></article><article class="b"><p>x</p></article>')) == "long text here"
    assert H.extract(H.parse('<article class="a"><p>same</p></article><article class="b"><p>also</p></article>')) == "same"
    assert H.extract(H.parse("<article><p>one</p></article><article><p>two</p></article>")) == "one\n\ntwo"


def test_matching_against_all_pairings():
    """The heaviest pairing of two lists of siblings, by brute force over all subsets."""
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 8)
        js, ws = rng.sample(range(20), n), [rng.randint(1, 9) for _ in range(n)]
        best = max(sum(ws[i] for i in c) for k in range(n + 1) for c in combinations(range(n), k) if all(js[a] < js[b] for a, b in zip(c, c[1:])))
        got = H._heaviest_rise(js, ws)
        assert all(js[a] < js[b] for a, b in zip(got, got[1:])) and sum(ws[i] for i in got) == best


def test_references_and_white_space():
    assert H.extract(H.parse("<p>a&nbsp;&amp;\n b<br>c<b>d</b>&#x41; < e</p>stray")) == "a & b cdA < e\n\nstray"
    assert H.extract(H.parse('<p title="a>b">x</p><p title="open>y</p>')) == "x\n\ny"


def test_hostile_pages_take_linear_time():
    """A megabyte each of tags that don't end, quotes, nested articles and unclosed raw text."""
    import time

    from tidewater.llm.html_text import parse

    for piece in ("<a ", '<p "', "<article>", "<nav><article>", "<!-- ", "<!--> ", "<script></script ", "<div <", "</p", "<li><div>"):
        began = time.time()
        parse("<p>one two three</p>" + piece * (1_000_000 // len(piece)))
        assert time.time() - began < 20, piece
    deep = "<article>" * 20_000 + "<li>x" * 20_000 + "<nav><article>" * 20_000
    began = time.time()
    parse(deep)
    assert time.time() - began < 20


def test_ends_of_pages():
    from tidewater.llm.html_text import parse

    for tail, blocks in (("", ["a b"]), ("<!-- c", ["a b"]), ("<!-- c > d", ["a b"]), ("<!-- c --> d", ["a b", "d"]), (" < c", ["a b", "< c"]), ("<em", ["a b", "<em"]), ("<!-->", ["a b"]), ("<script> c > d", ["a b"])):
        assert parse("<p>a b</p>" + tail).blocks == blocks, tail
