import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.llm import wrappers
from lineweave.llm.wrappers import content, from_skeleton, leaves, match, parse, skeleton


def blocks(page):
    return [x.text for x in leaves(content(parse(page)))]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div id="cookie-notice">We use</div>
<article><h1>Title &amp; more</h1><p><b>Lead  text<br>goes on<p>Second&nbsp;par &#233; &am <i>x</i>y</p><form><p>mail</p></form><ul><li>one<li>two</ul>
<div class="share-buttons">Share</div><pre>a
 b</pre></article><aside>Side</aside><section class="comments"><article><p>nice!</p></article></section><footer>&copy; me</footer></body></html>"""


def test_blocks():
    assert blocks(PAGE) == ["Title & more", "Lead text goes on", "Second par é &am xy", "one", "two", "a b"]
    assert blocks(None) == blocks("") == blocks("<p></p>") == []
    assert blocks("plain <b>text") == ["plain text"]
    assert blocks("<div>a<p>b</div>c</p>d") == ["a", "b", "c", "d"]
    assert blocks("a < b & c <p title='>'>d<script>x") == ["a < b & c", "d"]
    assert blocks("<div>" * 500 + "deep" + "</div>" * 500 + "after") == ["deep", "after"]
    assert blocks("<button>no</button><p>yes<select><option>n</option></select> on</p>") == ["yes on"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a b'>", "</div>", "<li>", "x y", " ", "<br>", "<b>", "</ul>", "<ul>", "<article>", "</article>", "<", "&lt;", "<!--", "-->", "<table><tr><td>", "</script>"]), max_size=30).map("".join))
def test_any_markup_parses(page):
    tree = parse(page)
    again = from_skeleton(skeleton(tree))
    assert [(x.chars, x.links) for x in leaves(again)] == [(len(x.text), x.links) for x in leaves(tree)]
    assert [(x.label, x.outside, x.article) for x in wrappers.preorder(again)] == [(x.label.replace(" ", "_"), x.outside, x.article) for x in wrappers.preorder(tree)]


def brute_match(a, b):
    if a.label != b.label:
        return 0
    if not a.children and not b.children:
        return 1 + (a.text == b.text)

    def best(i, j):
        if i == len(a.children) or j == len(b.children):
            return 0
        return max(best(i + 1, j), best(i, j + 1), best(i + 1, j + 1) + brute_match(a.children[i], b.children[j]) if a.children[i].label == b.children[j].label else 0)

    return 1 + best(0, 0)


@settings(max_examples=60, deadline=None)
@given(*[st.recursive(st.sampled_from("uvw").map(lambda t: wrappers.Node("#text", text=t)), lambda c: st.builds(lambda k, x: wrappers.Node(k, children=x), st.sampled_from(["p", "div"]), st.lists(c, min_size=1, max_size=3)), max_leaves=6)] * 2)
def test_matching_is_largest(a, b):
    a, b = wrappers.Node("r", children=[a]), wrappers.Node("r", children=[b])
    pairs = [(x, y) for x, y in match(a, b) if x.text and y.text]
    order = [id(x) for x in leaves(a)]
    assert [order.index(id(x)) for x, _ in pairs] == sorted(order.index(id(x)) for x, _ in pairs)
    if all(not c.children for n in (a, b) for c in n.children):
        assert sum(1 + (x.text == y.text) for x, y in pairs) == brute_match(a, b) - 1


def test_long_lists_are_matched_in_full():
    leaf = lambda t: wrappers.Node("p", children=[wrappers.Node("#text", text=t)])
    tree = lambda k, n: wrappers.Node("div", children=[*(leaf(f"{k} {i}") for i in range(n)), leaf("constant"), *(leaf(f"{k} end {i}") for i in range(9))])
    pairs = [(x, y) for x, y in match(tree("a", 230), tree("b", 350)) if x.text]
    assert len(pairs) == 240 and [x.text for x, y in pairs if x.text == y.text] == ["constant"]
    a, b = wrappers.Node("div", children=[wrappers.Node("h2"), *tree("a", 2000).children]), tree("b", 9)
    assert "constant" in [y.text for x, y in match(a, b) if x.text == y.text != ""]


def test_malformed_pages_take_linear_time():
    for page in ("<a " * 100_000, "<a x='" * 50_000 + ">", '<a "' * 100_000 + ">" * 10, "<div>" * 50_000 + "</p>" * 50_000, "<li>" + "<h1>" * 50_000, "<button>" + "<b>" * 50_000 + "</i>" * 50_000, "<!--" * 100_000, "<" * 100_000):
        begun = time.time()
        parse(page)
        assert time.time() - begun < 3
    assert [x.text for x in leaves(parse("<a " * 100_000))] == [("<a " * 100_000).strip()]


def page(k, constant="Follow us every day"):
    body = "".join(f"<p>story {k} part {i} goes on and on</p>" for i in range(k % 4 + 1))
    return f"<html><body><div><h1>Head {k}</h1>{body}<p>{constant}</p></div><footer>f</footer></body></html>"


def test_template_is_removed(spark):
    rows = [(k, f"http://Host.example/{k}", page(k)) for k in range(40)]
    rows += [(100, "http://lone.example/1", page(1)), (101, None, page(2)), (102, "http://host.example/x", None), (103, "http://host.example/y", PAGE), (104, "nourl", "")]
    rows += [(200 + k, f"http://copies.example/{k}", page(5)) for k in range(12)] + [(100, "http://lone.example/1", page(1))]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    out = wrappers.extracted(pages).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(rows)
    for k in range(40):
        assert got[k].text == "\n\n".join([f"Head {k}", *(f"story {k} part {i} goes on and on" for i in range(k % 4 + 1))]) and got[k].decided_by == "wrapper"
    assert got[100].text.endswith("Follow us every day") and got[101].text.endswith("Follow us every day") and got[100].decided_by == "names"
    assert got[102].text == got[104].text == "" and got[102].n_chars == 0
    assert got[103].text.startswith("Title & more") and got[205].text == "Head 5\n\nstory 5 part 0 goes on and on\n\nstory 5 part 1 goes on and on\n\nFollow us every day"
    assert got[5].n_chars == len(got[5].text)
    assert wrappers.extracted(pages.limit(0)).count() == 0
    limit, wrappers.BROADCAST_BYTES = wrappers.BROADCAST_BYTES, 0
    try:
        parted = {r.page_id: r.text for r in wrappers.extracted(pages).collect()}
    finally:
        wrappers.BROADCAST_BYTES = limit
    assert parted == {k: r.text for k, r in got.items()}


def odd_page(rng, k):
    """No name tells what is what, and menus, notices and footers change from page to page."""
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    title, paragraphs = words(5), [words(rng.randrange(20, 60)) for _ in range(rng.randrange(1, 7))]
    menu = "".join(f'<div class="q"><a href="/{words(1)}">{words(1)}</a></div>' for _ in range(rng.randrange(3, 8)))
    notice = f'<div class="z7">{words(6)}</div>' if k % 4 else ""
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    tail = f'<div class="t"><div class="u"><a href="#">{words(2)}</a></div><div class="u"><a href="#">{words(3)}</a></div></div>'
    html = f'<html><body><div class="k1">{menu}</div>{notice}<div class="m"><div class="k2"><h1>{title}</h1>{body}</div>{tail}</div><div class="k9">{words(4)} {k}</div></body></html>'
    return html, "\n\n".join([title, *paragraphs])


def test_wrapper_without_names(spark):
    rng = random.Random(4)
    made = [odd_page(rng, k) for k in range(60)]
    rows = [(k, f"http://odd.example/{k}", html) for k, (html, _) in enumerate(made)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in wrappers.extracted(pages, by_name=False).collect()}
    assert [k for k, (_, want) in enumerate(made) if got[k].text != want] == []
    assert {r.decided_by for r in got.values()} == {"wrapper"}
    without = {r.page_id: r.text for r in wrappers.extracted(pages, by_wrapper=False).collect()}
    assert all(without[k] != want for k, (_, want) in enumerate(made))


def test_too_few_pages_have_no_wrapper(spark):
    rng = random.Random(6)
    for n in (wrappers.MIN_PAGES - 1, wrappers.MIN_PAGES):
        pages = spark.createDataFrame([(k, "http://few.example/", odd_page(rng, k)[0]) for k in range(n)], "page_id long, url string, html string")
        assert {r.decided_by for r in wrappers.extracted(pages).collect()} == {"wrapper" if n == wrappers.MIN_PAGES else "names"}


def test_several_layouts_and_near_copies(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for k in range(30):  # another layout of the same host
        story = [words(30), words(25)]
        rows.append((k, f"http://two.example/a/{k}", f"<body><table><tr><td><a>{words(1)}</a> <a>{words(1)}</a></td></tr></table><section><p>{story[0]}</p><p>{story[1]}</p></section></body>"))
        want[k] = "\n\n".join(story)
    for k in range(30, 70):
        html, want[k] = odd_page(rng, k)
        rows.append((k, f"http://two.example/b/{k}", html))
    base = [words(20) for _ in range(8)]
    for k in range(100, 130):  # near copies of one article
        story = [*base[:3], words(20), *base[4:]]
        rows.append((k, f"http://near.example/{k}", f"<body><div class='x'><a>{words(1)}</a></div><div class='y'>{''.join(f'<p>{x}</p>' for x in story)}</div></body>"))
        want[k] = "\n\n".join(story)
    got = {r.page_id: r.text for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), by_name=False).collect()}
    assert [k for k in want if got[k] != want[k]] == []
