"""Operator 6: wrappers and the main text of pages whose article is known."""

from __future__ import annotations

import html
import re

from pyspark.sql import functions as F

from churnlens.llm import common, wrappers

PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href='/x'>menu</a></li></ul></nav><div class=\"cookie-notice\">We use cookies</div>"
        "<article><h1>{0}</h1>{1}<aside>more</aside><form><input name=q>find</form><div class='comments'><p>nice</p></div>"
        "</article><div id='ad-12' class=ad>Buy</div><footer>&copy; end</footer></body></html>")


def run(monkeypatch, table):
    monkeypatch.setattr(common, "table", lambda *a: table)
    return wrappers.op6_page_wrappers(table.sparkSession, "-").collect()


def test_given_pages(monkeypatch, spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = {r.page_id: r for r in table.collect()}
    got = run(monkeypatch, table)
    assert len(got) == len(pages)
    for r in got:
        source = pages[r.page_id].html
        article = source[source.index("<article>") + 9:source.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def test_boilerplate_entities_and_truncation(monkeypatch, spark):
    rows = [(i, f"https://Host.example/{i}?a=b", PAGE.format(f"Title {i}", f"<p>One &amp; <b>two</b>\n  three</p><p>{i}&#233;<br>x</p>"))
            for i in range(4)]
    rows += [(10, None, None), (11, "no url", ""), (12, "http://u:p@h.example:80/", "<p>plain <!-- <p>no</p> --> text"),
             (13, "https://host.example/cut", PAGE.format("Cut", "<p>end of")[:330]), (0, *rows[0][1:]),
             (14, "https://host.example/long", PAGE.format("L", "<p>word</p>" * 5000)), (15, "http://deep.example", "<div>" * 3000 + "deep"),
             (16, "http://odd.example", "a < b <3 </nope> &lt;p&gt; <p>c"), (None, "http://odd.example", "<article>x</article>")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    for t in (table, table.withColumns({c: F.lit("own") for c in ("host", "wrapper", "n_pages", "text", "n_chars")})):
        got = {}
        for r in run(monkeypatch, t):
            got.setdefault(r.page_id, []).append(r.text)
        assert got[0] == ["Title 0\nOne & two three\n0é x"] * 2 and got[3] == ["Title 3\nOne & two three\n3é x"]
        assert got[10] == got[11] == [""] and got[12] == ["plain text"] and got[13][0].startswith("Cut")
        assert got[14] == ["L\n" + "\n".join(["word"] * 5000)] and got[15] == ["deep"]
        assert got[16][0].startswith("a < b <3") and got[None] == ["x"]
    assert run(monkeypatch, table.limit(0)) == []


def units(source):
    return wrappers.expression(wrappers.parse(source))


def test_mismatches_become_slots_options_and_repeats():
    w = wrappers.align(units("<ul><li>a<li>b</ul><p>same</p>"), units("<h2>t</h2><ul><li>c</ul><p>same</p>"))
    keys = [(u[0], u[1][0], u[1][2]) if u[0] == "+" else (u[0][0], u[0][2]) for u in w]
    assert keys == [("h2", True), ("ul", False), ("p", False)]
    repeated = w[1][0][1][0]
    assert repeated[0] == "+" and repeated[1][0] == "li" and repeated[1][1][0][0][1] is None
    assert w[2][0][1][0][0][1] is not None  # the same text on both pages stays constant


def test_expression_stands_for_all_its_pages_in_any_order():
    pages = ["<p>1</p><b>2</b><p>3</p>", "<b>1</b>", "<i>x</i><p>1</p>", "", "<p>4</p><i>5</i><b>6</b><i>7</i>"]

    def accepts(expr, node):
        known = {item[0]: item for unit in expr for item in wrappers._items(unit)}
        return all((wrappers.TEXT if isinstance(c, str) else c.key) in known
                   and (isinstance(c, str) or accepts(known[c.key][1], c)) for c in node.children)
    for order in (pages, pages[::-1], pages[2:] + pages[:2]):
        w = units(order[0])
        for p in order[1:]:
            w = wrappers.align(w, units(p))
        keys = [item[0] for unit in w for item in wrappers._items(unit)]
        assert len(keys) == len(set(keys)) and all(accepts(w, wrappers.parse(p)) for p in pages)


def test_template_texts_go_where_no_article_is_marked(monkeypatch, spark):
    rows = [(i, "http://plain.example/", f"<body><div>Site name</div><p>Story {i}</p></body>") for i in range(4)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert sorted(r.text for r in run(monkeypatch, table)) == [f"Story {i}" for i in range(4)]


def test_space_between_inline_elements_and_closed_icons(monkeypatch, spark):
    pages = {"http://a.example": "<p><b>foo</b> <i>bar</i></p>", "http://b.example": "<p><a>one</a>\n<a>two</a><a>three</a></p>",
             "http://c.example": "<p>a <svg/> b</p><p>c</p>", "http://d.example": "<p>a<svg class='x/>' d=\"M0 0\" /> b</p><p>c</p>",
             "http://e.example": "<p>a <svg><title>icon</title><path d='M1'/></svg> b</p><p>c</p>"}
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pages.items())], "page_id bigint, url string, html string")
    assert {r.url[7]: r.text for r in run(monkeypatch, table)} == {
        "a": "foo bar", "b": "one twothree", "c": "a b\nc", "d": "a b\nc", "e": "a b\nc"}


def test_only_texts_of_nearly_all_different_pages_are_template(monkeypatch, spark):
    story = "<body><div>Site name</div><p>Story {0}</p>{1}</body>"
    pages = [("http://once.example/", story.format(i, "<blockquote>Only here</blockquote>" if i == 2 else "")) for i in range(5)]
    pages += [("http://copies.example/", story.format("same", ""))] * 4
    pages += [("http://two.example/", story.format(i, "")) for i in (0, 1, 1, 1)]
    pages += [("http://alike.example/", f"<!-- {i} -->" + story.format("alike", "")) for i in range(3)]
    pages += [("http://blank.example/", story.format(i, "") if i else None) for i in range(4)]
    pages += [("http://large.example/", story.format(i, "") if i else "<body><p>Cut") for i in range(40)]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string").repartition(5)
    got: dict = {}
    for r in run(monkeypatch, table):
        got.setdefault(r.url.split(".")[0][7:], []).append(r.text)
    assert sorted(got["once"]) == ["Story 0", "Story 1", "Story 2\nOnly here", "Story 3", "Story 4"]
    assert got["copies"] == ["Site name\nStory same"] * 4 and got["alike"] == ["Site name\nStory alike"] * 3
    assert sorted(got["two"]) == ["Site name\nStory 0"] + ["Site name\nStory 1"] * 3
    assert sorted(got["blank"]) == ["", "Story 1", "Story 2", "Story 3"]
    assert sorted(got["large"]) == sorted(["Cut", *[f"Story {i}" for i in range(1, 40)]])


def test_wrapper_decides_inside_regions(monkeypatch, spark):
    pages = [("http://notes.example/", f"<article><h1>Title {i}</h1><p>Story {i}</p><div class=x1>Buy now</div><p>More {i}</p>"
              f"<p>By <b>us</b></p>{'<p><i>Once</i></p>' if i == 1 else ''}</article>") for i in range(4)]
    form = "<head><title>Page {0}</title></head><form><nav>Menu {0}</nav><div class=banner>Shop</div><p>{1}</p></form>"
    pages += [("http://form.example/", form.format(i, f"Long story {i} " * 20)) for i in range(4)]
    pages += [("http://side.example/", f"<main class=has-sidebar><p>{f'Text {i} ' * 20}</p><div class=sidebar>Other {i}</div></main>")
              for i in range(4)]
    pages += [("http://talk.example/", f"<article><p>Short {i}</p><div class=comments><article>{f'Opinion {i} ' * 2}</article></div></article>")
              for i in range(4)]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in run(monkeypatch, table)}
    for i in range(4):
        once = "\nOnce" if i == 1 else ""
        assert got[i] == f"Title {i}\nStory {i}\nMore {i}\nBy{once}"  # "By" shares its place with the stories: a slot
        assert got[4 + i] == (f"Long story {i} " * 20).strip()
        assert got[8 + i] == (f"Text {i} " * 20).strip()
        assert got[12 + i] == f"Short {i}"


def test_comments_headings_and_whole_words(monkeypatch, spark):
    remarks = "".join(f"<p>I think {k} {{0}}</p>" for k in range(30))
    pages = [("http://in.example/", f"<article><p>Short {i}</p><div class=comments>{remarks.format(i)}</div></article>") for i in range(5)]
    pages += [("http://out.example/", f"<body><p>Short {i}</p><div class=comments>{remarks.format(i)}</div></body>") for i in range(5)]
    pages += [("http://head.example/", f"<article><h2>Summary</h2><p>Story {i}</p><table><tr><th>Name</th><td>n{i}</td></tr></table></article>")
              for i in range(5)]
    pages += [("http://word.example/", f"<article><div class='social-science'>Study {i}</div><p class='notice-period'>Weeks {i}</p>"
               f"<div class='site-header top'>Menu {i}</div><div id=cookie-banner>Cookies {i}</div><div class=comment-list>So {i}</div></article>")
              for i in range(5)]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in run(monkeypatch, table)}
    for i in range(5):
        assert got[i] == got[5 + i] == f"Short {i}"
        assert got[10 + i] == f"Summary\nStory {i}\nName\nn{i}"
        assert got[15 + i] == f"Study {i}\nWeeks {i}"
