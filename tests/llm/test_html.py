"""HTML extraction on hand-written pages and on the test table."""

import random
import re
import time
from html import unescape

from millrace.llm import html_extract as h
from millrace.llm import queries


def text(source):
    return "\n".join(t for _, t in h.Page(source).candidates())


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
    <div id="cookie-notice">Cookies</div><article><header><h1>Head &amp; tail</h1></header><p><b>One &lt;two&gt;<br><p>three <a href=x>link</a>, <i>four</i>.
    &eacute;&#233;&#xe9;</p><aside>side</aside><form><p>Mail</p><input></form><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><div class="comments"><p>First!</p></div></article>
    <footer>&copy; x</footer></body></html>"""
    assert text(page) == "Head & tail\nOne <two>\nthree link, four. ééé\na\nb\nc\nd"


def test_broken_markup():
    assert text("<p>a<p>b") == "a\nb"
    assert text("a < b & c") == "a < b & c"
    assert text("<article><div><p>x</article><p>out</p>") == "x"
    assert text("</p></div>x") == "x"
    assert text("<script>never ends") == ""
    assert text("<!-- never ends") == ""
    assert text("") == ""
    assert text("<div hidden>x</div><div aria-hidden='true'>y</div><p>z</p>") == "z"


def test_names():
    assert text('<div class="with-sidebar"><div class="sidebar">s</div><article class="post comments-open"><p>a</p></article><article class="comment"><p>c</p></article></div>') == "a"
    assert text('<div id="cookieBar">x</div><p style="display: none">n</p><p>z</p>') == "z"
    assert text('<main><p>a</p><section class="user-comments"><article><p>c</p></article></section><span class="ad">x</span></main>') == "a"
    assert text('<nav><article>no</article></nav><p>yes <em>it</em> is</p>') == "yes it is"


def test_query(spark, sf_dir):
    got = {r.page_id: r for r in queries.op5_html_extraction(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(x).split()) for x in re.split(r"</?(?:p|h1)>|<b>|<br>", article)]
        assert got[r.page_id].text == "\n".join(filter(None, blocks))
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_template_and_odd_rows(spark):
    schema = "page_id long, url string, html string, host string, drop string, text string"
    def page(i):
        parts = "".join(f"<p>Part {i} {j}</p>" for j in range(4))
        return f"<body><div><p>All rights belong to us.</p><p>Story number {i} about {i * 7} things.</p><div>{parts}</div></div></body>"
    rows = [(i, f"http://one.example/{i}", page(i), "", "", "") for i in range(40)]
    rows += [(100 + i, f"https://two.example/{i}", "<article><h1>Same</h1><p>copied text</p></article>", "", "", "") for i in range(40)]
    rows += [(300 + i, f"https://three.example/{i}", f"<article><h1>Same head</h1><p>Same text.</p><p>Edited {i}</p></article>", "", "", "") for i in range(40)]
    rows += [(200, None, None, "", "", ""), (201, "", "", "", "", ""), (None, "x", "<p>q", "", "", ""), (202, "http://one.example/x", "<p>alone</p>", "", "", ""), (202, "http://one.example/x", "<p>alone</p>", "", "", "")]
    got = h.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == f"Story number {i} about {i * 7} things.\n" + "\n".join(f"Part {i} {j}" for j in range(4)) for i in range(40))
    assert all(by[300 + i] == "Same head\nSame text.\n" + f"Edited {i}" for i in range(40))
    assert all(by[100 + i] == "Same\ncopied text" for i in range(40))
    assert by[200] == by[201] == "" and by[None] == "q" and by[202] == "alone"
    assert h.extract(spark.createDataFrame([], schema)).count() == 0


def test_template_slot_by_slot(spark):
    def small(i):
        return f"<body><div><p>All rights belong to us.</p><p>Story number {i} about {i * 7} things.</p><div><p>Part {i}</p></div></div></body>"

    def pieces(i):
        rng = random.Random(i)
        return [" ".join(f"w{rng.randrange(500)}" for _ in range(4)) for _ in range(6)]

    def short(i):
        own = "".join(f"<p>{x}</p>" for x in pieces(i))
        return f"<body><div><p>Site line.</p><div>{own}</div><p>Printed by us.</p><section><p>Ring us.</p></section></div></body>"

    def edited(i):
        words = " ".join(f"word{k}" if k != i % 60 else f"other{i}" for k in range(60))
        return f"<body><div><p>An article's first part.</p><div><p>{words}</p></div></div></body>"

    rows = [(i, f"http://small.example/{i}", small(i)) for i in range(40)]
    rows += [(100 + i, f"http://short.example/{i}", short(i)) for i in range(40)]
    rows += [(200 + i, f"http://few.example/{i}", short(i)) for i in range(4)]
    rows += [(300 + i, f"http://copies.example/{i}", edited(i)) for i in range(60)]
    by = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(by[i] == f"Story number {i} about {i * 7} things.\nPart {i}" for i in range(40))
    assert all(by[100 + i] == "\n".join(pieces(i)) for i in range(40)) and all(by[200 + i] == "\n".join(pieces(i)) for i in range(4))
    assert all(by[300 + i].startswith("An article's first part.\n") for i in range(60))


def test_alignment():
    a = h.Page("<body><div class=x><p>1</p></div><section><h1>a</h1><p>b</p></section></body>").tree()
    b = h.Page("<body><section><h1>a</h1><div>z</div><p>b</p></section></body>").tree()

    def slot(path):
        found = 0
        for label in path.split("/")[1:]:
            found = h._slot(found, label)
        return found

    found = h.align(a, b)
    own = slot("/body/div.x")
    assert found[slot("/body/section/p")] == slot("/body/section/p") and found[own] == h._slot(own, "own") and len(found) == 6


def matched(a, b):
    """Simple tree matching by its definition, of trees as (label, children)."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + matched(x, y))
    return 1 + best[-1][-1]


def test_alignment_is_the_largest():
    rng = random.Random(3)

    def grow(depth):
        out = []
        for _ in range(rng.randrange(5) if depth else 0):
            label = rng.choice("abc")
            if not out or out[-1][0] != label:
                out.append((label, grow(depth - 1)))
        return out

    def lines(nodes, depth=0):
        return [x for label, inner in nodes for x in (f"{depth} {label}", *lines(inner, depth + 1))]

    for _ in range(400):
        a, b = grow(3), grow(3)
        found = h.align("\n".join(lines(a)), "\n".join(lines(b)))
        slots = set(h.Tree("\n".join(lines(b))).slot)
        common = [x for x in found.values() if x in slots]
        assert len(set(common)) == len(common) == matched(("", a), ("", b)) - 1


def test_names_are_hints():
    assert text("<article><math><mi>x</mi></math><label>kept</label><h2 class='share'>Market share</h2><div class='related'>Prose of a story.</div><p class='header-note'>A note.</p></article>") == "x\nkept\nMarket share\nProse of a story.\nA note."
    assert text("<article><p>a</p><div class='related'><a href=1>One</a> <a href=2>Two</a></div></article>") == "a"
    assert text("<form id=f><input><article><p>in a form</p><form><p>Mail</p></form></article></form>") == "in a form"
    assert text("<form action=/x><h1>Head</h1><p>text</p></form>") == "Head\ntext" and text("<p>a</p><form><p>Mail</p></form>") == "a"
    assert text("<div class='page-with-sidebar'><p>text</p><div class='sidebar'>s</div></div>") == "text"
    assert text(f"<article><p>Teaser.</p></article><div class='content'><p>{'The story goes on. ' * 20}</p></div>") == ("The story goes on. " * 20).strip()
    assert text("<article><pre><span class='hljs-comment'># code</span></pre><p>b</p></article>") == "# code\nb"


def test_large_and_broken():
    deep = 20_000
    page = h.Page("<div>" * deep + "<p>x</p>" + "</div>" * deep)
    assert [t for _, t in page.candidates()] == ["x"]
    tree = page.tree()
    found = h.align(tree, "\n".join(["0 section", *tree.split("\n")[: deep // 2]]))
    assert len(found) == deep + 1
    began = time.perf_counter()
    for odd in ("<a " * 350_000, "<a b='" * 160_000, "<a b=\"" * 160_000 + ">", "<!-" * 300_000, "</x>" * 250_000, "<div>" * 100_000 + "</p>" * 100_000, "<" * 1_000_000, "<li>" * 200_000, "&" * 1_000_000):
        h.Page(odd).candidates()
    assert time.perf_counter() - began < 60


def test_much_boilerplate(spark):
    same = "".join(f"<div><p>House rule number {k} of this site.</p></div>" for k in range(12))
    rows = [(i, f"http://h.example/{i}", f"<body>{same}<section><p>Story {i} tells of {i * 31} ships and {i * 17} harbours.</p><p>It ends with {i * 13} sails and number {i}.</p></section></body>") for i in range(60)]
    by = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(by[i] == f"Story {i} tells of {i * 31} ships and {i * 17} harbours.\nIt ends with {i * 13} sails and number {i}." for i in range(60))
