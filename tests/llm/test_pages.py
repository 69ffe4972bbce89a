import random
import time

import pytest

from careflow.llm import wrapper as W

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- ad --><div class="ad">Buy!</div><div id="sidebar"><p>side</p></div><{main}><h1>Title {n}</h1><p><b>First &amp; best &eacute; {n}<br>
next   line<p>Second {n}</p><form><input name=x>send</form><script>if (a<b) x();</script><ul><li>one {n}<li>two {n}</ul><div class="comments"><p>reader says</p></div></{main}><footer>&copy; foot</footer></body></html>"""
TEXT = "Title {n}\n\nFirst & best é {n} next line\n\nSecond {n}\n\none {n}\n\ntwo {n}"


@pytest.mark.parametrize("main", ["article", "main", "div"])
def test_main_text(spark, with_clashes, main):
    rows = [(i, f"http://h.example.com/{i}", PAGE.format(n=i * 7, main=main)) for i in range(12)]
    edge = [(100, None, None), (101, "http://h.example.com/x", ""), (102, "nonsense", "plain text"), (103, "http://one.example.com/", PAGE.format(n=1, main=main)), (None, "http://h.example.com/0", rows[0][2]), (0, rows[0][1], rows[0][2])]
    df = with_clashes(spark.createDataFrame(rows + edge, "page_id long, url string, html string").repartition(4))
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in W.main_text(df).collect()), key=str)
    text = {i: TEXT.format(n=i * 7) for i in range(12)} | {100: "", 101: "", 102: "plain text", 103: TEXT.format(n=1), None: TEXT.format(n=0)}
    assert got == sorted(((i, u, text[i], len(text[i])) for i, u, _ in rows + edge), key=str)
    assert W.main_text(df.limit(0)).count() == 0


def test_template_is_told_from_content_without_names(spark):
    """Nothing in these pages says what is menu and what is text but that it stays or changes."""
    page = "<body><div><span>Home</span> Shop</div><section><div>{a}</div><div>{b}</div></section><div>Imprint</div></body>"
    rows = [(i, f"http://x.example.org/{i}", page.format(a=f"story {i} " * 5, b=f"more {i * i}")) for i in range(15)]
    got = {r["page_id"]: r["text"] for r in W.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == ("story 3 " * 5).strip() + "\n\nmore 9"


@pytest.mark.parametrize("copied", ["<p>{n}</p>", "<p>{n}</p><p>and {n}</p><p>again {n}</p>"])
def test_copies_of_a_page_vote_once(spark, copied):
    """95 rows of one page, which is the reference (fewest nodes) or not, and 5 other pages."""
    page = "<body><div>Shop</div><article>{a}</article></body>"
    texts = [copied.format(n="the copied story " * 3)] * 95 + [f"<p>{'other story ' * 3}{i}</p><p>its end {i * i}</p>" for i in range(5)]
    rows = [(i, f"http://c.example.org/{i}", page.format(a=t)) for i, t in enumerate(texts)]
    got = {r["page_id"]: r["text"] for r in W.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    want = {i: "\n\n".join(x.strip() for x in t.replace("</p>", "").split("<p>")[1:]) for i, t in enumerate(texts)}
    assert got == want


def texts(spark, pages):
    rows = [(i, f"http://w.example.org/{i}", x) for i, x in enumerate(pages)]
    got = W.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


@pytest.mark.parametrize("tag", ["article", "section"])
@pytest.mark.parametrize("pages", [5, 15])
def test_varying_text_outside_the_largest_element_is_kept(spark, tag, pages):
    page = "<body><div>Shop</div><{tag}><h1>title {i}</h1><p>lead {i}</p><div>{body}</div></{tag}><div>Imprint</div><div>seen {j} times</div></body>"
    body = [f"body {i} " * 40 for i in range(pages)]
    got = texts(spark, [page.format(tag=tag, i=i, j=i * i + 3, body=body[i]) for i in range(pages)])
    assert got == [f"title {i}\n\nlead {i}\n\n{body[i].strip()}\n\nseen {i * i + 3} times" for i in range(pages)]


def test_all_nodes_of_a_large_page_vote_and_are_read(spark):
    page = "<body><div>Shop</div><section>{a}</section><main>{b}</main><div>Imprint</div></body>"
    a = ["<hr>".join(f"{i}-{k}" for k in range(5_000)) for i in range(3)]
    b = [f"<p>second {i} part</p><p>its end {i}</p>" for i in range(3)]
    for i, got in enumerate(texts(spark, [page.format(a=x, b=y) for x, y in zip(a, b)])):
        assert got == "\n\n".join([f"{i}-{k}" for k in range(5_000)] + [f"second {i} part", f"its end {i}"])


def test_constant_text_within_the_content_needs_many_pages(spark):
    page = "<body><div>Shop</div><section><p>{i} story</p><p>Read on</p><p>{i} end</p></section></body>"
    assert texts(spark, [page.format(i=f"{i} " * 9) for i in range(12)])[1] == f"{'1 ' * 9}story".replace("  ", " ") + "\n\n" + f"{'1 ' * 9}end"
    assert "Read on" in texts(spark, [page.format(i=f"{i} " * 9) for i in range(5)])[1]


#: Layouts in which no element, role or name says what is what; {m}: a menu with other entries on each page.
LAYOUTS = [
    "<div><p>Brand {host}</p><div>{m}</div></div><div><div>{c}</div><div><p>Old side</p></div></div><div><p>Imprint {host}</p></div>",
    "<table><tr><td>{m}</td><td>{c}</td></tr><tr><td>Imprint {host}</td></tr></table>",
    "<div class='x1'><div class='x2'>Brand {host}</div><ul class='x3'>{m}</ul></div><div class='x4'><section>{c}</section></div><p>Imprint {host}</p><p>All rights</p>",
    "<center><div>{m}</div></center><div><div><div>{c}</div></div></div><dl><dt>Imprint</dt><dd>{host}</dd></dl>",
]


@pytest.mark.parametrize("errors", [0, 2])
def test_votes_decide_on_many_hosts_and_layouts(spark, errors):
    rows, want = [], {}
    for h in range(12):
        for k in range(12):
            n = len(rows)
            menu = "".join(f"<li><a href='/{n}{j}'>entry {n * j} of many</a></li>" for j in range(5))
            parts = [f"Heading {n}"] + [f"Paragraph {j} of page {n} with some words in it, {n * j}" for j in range(1 + (n * 7) % 9)]
            rows.append((n, f"http://host{h}.example.net/{k}", "<html><body>" + LAYOUTS[h % 4].format(host=h, m=menu, c=f"<h2>{parts[0]}</h2>" + "".join(f"<p>{p}</p>" for p in parts[1:])) + "</body></html>"))
            want[n] = "\n\n".join(parts)
        rows += [(10_000 + 10 * h + e, f"http://host{h}.example.net/error{e}", f"<body><p>Error {e}</p></body>" if e else "<p></p>") for e in range(errors)]
    got = {r["page_id"]: r["text"] for r in W.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert {n: got[n] for n in want} == want


def test_deep_pages_and_a_large_host(spark, monkeypatch):
    monkeypatch.setattr(W, "LARGE_HOST", 5)
    page = "<body><div>Shop</div>{deep}<p>text {i}</p><p>more {i}</p>{shut}<div>Imprint</div></body>"
    for got, i in zip(texts(spark, [page.format(deep="<div>" * (1_500 + i), shut="</div>" * (1_500 + i), i=i) for i in range(8)]), range(8)):
        assert got == f"text {i}\n\nmore {i}"


def plain_match(a, b):
    """Size of the largest match by the textbook recursion."""
    trees = []
    for depth, label in (a, b):
        nodes = [[x, []] for x in label]
        path = []
        top = []
        for d, n in zip(depth, nodes):
            del path[d:]
            (path[-1][1] if path else top).append(n)
            path.append(n)
        trees.append(top)

    def lists(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                g = 1 + lists(p[1], q[1]) if p[0] == q[0] else 0
                t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + g)
        return t[-1][-1]

    return lists(*trees)


@pytest.mark.parametrize("small", [W.SMALL, 0])
def test_matching_equals_the_textbook(monkeypatch, small):
    monkeypatch.setattr(W, "SMALL", small)
    rng = random.Random(5)
    for _ in range(300):
        both = []
        for _ in range(2):
            depth, label = [], []
            for _ in range(rng.randint(0, 14)):
                depth.append(rng.randint(0, depth[-1] + 1) if depth else 0)
                label.append(rng.choice("ab#"))
            both.append((depth, label))
        pairs = W.match(*both)
        assert len(pairs) == plain_match(*both)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) and all(both[0][1][i] == both[1][1][j] for i, j in pairs)
        up = lambda depth, i: next((k for k in range(i - 1, -1, -1) if depth[k] < depth[i]), None)
        assert all((up(both[0][0], i), up(both[1][0], j)) in {*pairs, (None, None)} for i, j in pairs)


def test_matching_is_the_largest_in_order():
    a = ([0, 1, 1, 1, 2], ["r", "x", "y", "x", "z"])
    b = ([0, 1, 1, 2], ["r", "y", "x", "z"])
    assert sorted(W.match(a, b)) == [(0, 0), (2, 1), (3, 2), (4, 3)]
    assert W.match(([], []), b) == []


def test_broken_markup():
    assert W.extract("<article><p>a &am<p>b < c <b>d</i><br>e</p><p", None) == "a &am\n\nb < c d e"
    assert W.extract("<div class='x><article><p>in</p></article>", None) == "in"
    assert W.extract("<article><script>x</article>", None) == ""
    assert W.extract("<p>" * 3000 + "deep" + "<div>" * 3000 + "er", None) == "deep\n\ner"


@pytest.mark.parametrize("deep", [100, W.DEEPEST, 600, 5000])
def test_text_behind_deep_elements_stays(deep):
    page = "<html><body><div class='x'><article><p>before</p>" + "<div>" * deep + "in<p>two" + "</div>" * deep + "<p>after</p></article></div><div>outside</div></body></html>"
    assert W.extract(page, None) == "before\n\nin\n\ntwo\n\nafter"


def test_names_decide_whole_and_never_by_a_fragment():
    for name in ("social-science", "search-results-2024", "notice-of-award", "entry-header", "header-of-state", "ad-hoc", "shared", "recommendations-for-adults"):
        assert W.extract(f"<article><p>a</p><div class='{name}'><p>b</p></div><section id='{name}'>c</section></article>", None) == "a\n\nb\n\nc", name
    for name in ("ad", "ad_banner", "comment-list", "cookie-notice", "sidebar-2", "site-header", "post_comments", "share-buttons", "x related-posts newsletter"):
        assert W.extract(f"<article><p>a</p><div class='{name}'><p>b</p></div></article>", None) == "a", name


def test_many_unlike_siblings_align_fast():
    rng = random.Random(1)
    pages = []
    for n in (10_000, 9_000):
        depth, label = [], []
        for i in range(n):
            for d, x in [(0, "div"), (1, rng.choice("pqrs")), *((2, rng.choice("abcdefgh")) for _ in range(rng.randrange(4)))]:
                depth.append(d)
                label.append(x)
        pages.append((depth, label))
    began = time.process_time()
    pairs = W.match(*pages)
    assert time.process_time() - began < 8  # about two seconds on a free machine
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) > 9_000
    assert all(pages[0][1][i] == pages[1][1][j] and pages[0][0][i] == pages[1][0][j] for i, j in pairs)
