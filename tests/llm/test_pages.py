"""Main text and web archives of small pages."""

import base64
import hashlib
import random

import pytest

from trendloom.llm import warc, wrapper
from trendloom.session import work_folder


def page(title, paragraphs, body=""):
    text = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title} | Site</title><style>p{{}}</style><script>if (a < b) '<p>no</p>'</script></head><body>"
        f"<div class=q1><a href='/'>Home</a> <a href='/x'>More &raquo;</a></div><!-- <p>gone</p> --><div class=q2><h1>{title}</h1>{text}{body}</div>"
        "<div class=q3>All rights reserved by Site</div></body></html>"
    )


def texts(frame, rows):
    got = wrapper.main_texts(frame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "'x' as text")).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def test_constant_nodes_are_template(frame):
    """Nothing but their sameness marks menu and footer here."""
    rows = [(i, f"http://user@Host.example:80/{i}", page(f"Title {i}", [f"First {i}.", f"Second&nbsp;{i} &amp;  <b>more</b>\n of it."])) for i in range(6)]
    got = texts(frame, rows)
    assert got == {i: f"Title {i}\n\nFirst {i}.\n\nSecond {i} & more of it." for i in range(6)}


def test_different_numbers_of_children_align(frame):
    rows = [(i, "http://h.example/", page(f"T{i}", [f"p{i}-{j}" for j in range(i)], f"<ul><li>item {i}</ul>" if i % 2 else "")) for i in range(1, 8)]
    got = texts(frame, rows)
    assert got[3] == "T3\n\np3-0\n\np3-1\n\np3-2\n\nitem 3" and got[4] == "T4\n\np4-0\n\np4-1\n\np4-2\n\np4-3"


def test_marks_and_order(frame):
    html = (
        "<body><header>Site</header><nav>Menu</nav><main>lead <p>one<p>two<br>lines</p> tail <aside>Side</aside><div class='post-comments'>Nice!</div>"
        "<form>Mail</form><div id=cookie-notice>Cookies</div><article class=comment>Reply</article><p hidden>No</p><section>three</section>"
        "</main><div class=advert>Buy</div><div>Other</div><footer>&copy;</footer>"
    )
    assert texts(frame, [(1, "http://a.example/", html)]) == {1: "lead\n\none\n\ntwo lines\n\ntail\n\nthree"}


def test_copies_on_one_host_keep_their_article(frame):
    html = "<body><div>Menu</div><article><h1>A</h1><p>Same text</p></article></body>"
    got = texts(frame, [(i, "http://copy.example/", html) for i in range(9)])
    assert set(got.values()) == {"A\n\nSame text"}


def test_odd_pages(frame):
    rows = [
        (1, None, None), (2, "", ""), (3, "no address", "just text"), (4, "http://z.example", "<p>unclosed <b>bold"), (5, "http://z.example", "</div></p>x<!-- open"),
        (6, "http://z.example", "<script>var a = 1"), (7, None, "<div>" * 3000 + "deep" + "</div>" * 3000), (8, None, "<p>" + "long " * 60_000), (None, None, "<p>a"), (9, None, "1 < 2 &lt; 3 &#x41;&bogus;"),
    ]
    got = texts(frame, rows)
    assert got[1] == got[2] == got[6] == "" and got[3] == "just text" and got[4] == "unclosed bold" and got[5] == "x" and got[7] == "deep"
    assert len(got[8]) == 300_000 - 1 and got[None] == "a" and got[9] == "1 < 2 < 3 A&bogus;"


def test_no_pages(frame):
    assert texts(frame, []) == {}


def test_matching_takes_the_most_nodes():
    a, _ = wrapper.parsed("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>")
    b, nodes = wrapper.parsed("<div><ul><li>x</li></ul><p>2</p><p>3</p></div>")
    met = wrapper.matched(a, b)
    assert len(met) == 5 and sorted(nodes[i].label for i in met.values()) == ["#root", "div", "li", "p", "ul"]


ROWS = [
    (1, "http://a.example/x?y=1", "<p>one</p>"), (5, "http://a.example/", "<p>one</p>"), (3, None, "<p>one</p>"), (7, "bad url\r\nX: y", "two\r\n\r\nWARC/1.1\r\n"),
    (8, "http://é.example/ü", None), (9, "http://b.example", ""), (10, "x", "é" * 100_000), (10, "x", "é" * 100_000), (2, "x", "é" * 100_000), (None, "x", "lone"), (None, None, "lone"),
]


@pytest.mark.parametrize("least", [0, 11])
def test_captures_equal_brute_force(frame, spark, least):
    pages = frame(ROWS, "page_id long, url string, html string").selectExpr("*", "'d' as digest", "1 as revisit")
    folder = work_folder(spark)
    manifest = warc.write_archives(pages, folder, least)
    got = sorted(map(tuple, warc.resolved(warc.captures(warc.read_records(manifest, folder))).collect()), key=str)
    best, want = {}, []
    for page_id, _, html in ROWS:
        payload = (html or "").encode()
        best[payload] = max(best.get(payload, -1), -1 if page_id is None else page_id)
    for page_id, _, html in ROWS:
        payload = (html or "").encode()
        again = len(payload) >= least and best[payload] not in (-1, page_id)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((page_id, len(payload), digest, "revisit" if again else "response", best[payload] if again else None))
    assert got == sorted(want, key=str)


def test_captures_carry_all_parts(frame, spark):
    folder = work_folder(spark)
    manifest = warc.write_archives(frame(ROWS[:1], "page_id long, url string, html string"), folder)
    records = warc.read_records(manifest, folder, with_payload=True)
    row = warc.captures(records).first()
    assert row.request.head.startswith("GET /x?y=1 HTTP/1.1") and row.response.payload == b"<p>one</p>" and row.metadata.page_id == 1
    alone = warc.captures(records.where("type = 'response'")).first()
    assert alone.request is None and alone.metadata is None and alone.response.payload_bytes == 10


def test_no_captures(frame, spark):
    assert warc.archived(frame([], "page_id long, url string, html string"), work_folder(spark)).count() == 0


OWN = "A sentence that is only on this page: "


@pytest.mark.parametrize("words", ["page has-sidebar", "no-sidebar", "with-comments", "search-result"])
@pytest.mark.parametrize("tag", ["article", "main", "section"])
def test_words_of_a_wrapper_do_not_drop_the_article(frame, words, tag):
    related = "<div class='related posts'><article class=card>Other {i}</article></div>" if tag == "article" else ""
    html = (
        f"<body><div class='sidebar menu'>Links</div><form id=aspnet><div class='{words}'><{tag}><h1>T{{i}}</h1><p>{OWN}{{i}}</p><div class='share'>Post {{i}}</div></{tag}>"
        f"{related}</div></form><div class='footer'>Site {{i}}</div>"
    )
    got = texts(frame, [(i, "http://wrapped.example/", html.format(i=i)) for i in range(4)])
    assert got == {i: f"T{i}\n\n{OWN}{i}" for i in range(4)}


def test_marks_that_leave_nothing_do_not_count(frame):
    rows = [(i, "http://marked.example/", f"<body><div>Menu</div><div class=promo>First half {i}</div><div class=widget>Other half {i}</div>") for i in range(4)]
    assert texts(frame, rows) == {i: f"First half {i}\n\nOther half {i}" for i in range(4)}


def test_lists_of_articles_and_comments_of_copies(frame):
    hits = "".join(f"<div class=search-result><article>Hit {{i}} {j}</article></div>" for j in range(5))
    copy = "<body><article><p>The same long text on every page of it</p><div class=comments>Reply {i}</div></article>"
    got = texts(frame, [(i, "http://hits.example/", f"<body><main><h1>Hits {{i}}</h1>{hits}</main>".format(i=i)) for i in range(4)])
    assert got == {i: "\n\n".join([f"Hits {i}", *(f"Hit {i} {j}" for j in range(5))]) for i in range(4)}
    assert set(texts(frame, [(i, "http://copy.example/", copy.format(i=i)) for i in range(12)]).values()) == {"The same long text on every page of it"}


def weighed(met, left, right):
    return sum(1 + (bool(left[i].blocks) and left[i].blocks == right[j].blocks) for i, j in met.items())


def most(a, b):
    """Weight of the best matching by plain recursion."""
    table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            pair = table[i - 1][j - 1] + most(x, y) if x.label == y.label else 0
            table[i][j] = max(table[i - 1][j], table[i][j - 1], pair)
    return 1 + (bool(a.blocks) and a.blocks == b.blocks) + table[-1][-1]


@pytest.mark.parametrize("cells", [0, 6, 250_000])
def test_matching_is_exact_at_every_size(monkeypatch, cells):
    monkeypatch.setattr(wrapper, "CELLS", cells)
    draw = random.Random(7)

    def tree(depth):
        return "".join(f"<{t}>{draw.choice('xyz')}{tree(depth - 1) if draw.random() < 0.6 and depth else ''}</{t}>" for t in draw.choices(["div", "section", "ul"], k=draw.randrange(7)))

    for _ in range(150):
        (a, left), (b, right) = wrapper.parsed(tree(3)), wrapper.parsed(tree(3))
        met = wrapper.matched(a, b)
        assert len(set(met.values())) == len(met) and all(left[i].label == right[j].label for i, j in met.items())
        assert weighed(met, left, right) == most(a, b)


def test_template_between_long_runs_is_found(frame):
    def html(i):
        def run(name, n):
            return "".join(f"<p>{name} {i} {j}</p>" for j in range(n))

        return f"<body>{run('a', 400 + 9 * i)}<div class=x>Between</div>{run('b', 400 + 7 * i)}<div class=y>Again</div>{run('c', 300 + i)}"

    for got in texts(frame, [(i, "http://long.example/", html(i)) for i in range(4)]).values():
        assert "Between" not in got and "Again" not in got and got.count("\n\n") > 1000


def test_every_layout_has_its_template(frame):
    """Three layouts, a third of the host's pages each, and what is constant in one only."""
    def html(i):
        kind = "abc"[i % 3]
        return f"<body><div class=top>Site</div><div class={kind}><div class=box>Only in {kind}</div><div class=text>Text {i}</div><div class=tail>{kind} ends</div></div>"

    assert texts(frame, [(i, "http://layouts.example/", html(i)) for i in range(15)]) == {i: f"Text {i}" for i in range(15)}


def test_template_that_no_single_page_has(frame):
    """Three notices, each on six of ten pages, and every page lacks one."""
    lacks = {"x": (0, 1, 2, 3), "y": (4, 5, 6, 0), "z": (7, 8, 9, 1)}

    def html(i):
        notices = "".join(f"<p class={name}>Notice {name}</p>" for name, pages in lacks.items() if i not in pages)
        return f"<body><div><div><div><p class=text>Text {i}</p>{notices}</div></div></div>"

    assert texts(frame, [(i, "http://notices.example/", html(i)) for i in range(10)]) == {i: f"Text {i}" for i in range(10)}
