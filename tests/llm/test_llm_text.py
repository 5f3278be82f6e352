"""Rendering of pages and linking of quotes."""

import re
import time
from html.parser import HTMLParser

import pandas as pd
import pytest

from ebbtide.llm import chat, html_text
from ebbtide.llm.queries import QUERIES

CASES = {
    "<p>one <b>two</b>   three<p>four": "one two three\n\nfour",
    "<p>a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": "- a\n- b\n  - c\n- d\n\ne",
    "<ol start=3><li>x<li>y<li value=9>z</ol>": "3. x\n4. y\n9. z",
    "<table><tr><th>Name<th>Qty<tr><td>Apple<td>3<tr><td>F<td>12<br>13</table>": "Name  | Qty\nApple | 3\nF     | 12\n      | 13",
    "<table><tr><td>a<td><table><tr><td>x<td>y</table><td>z</table>": "a | x | y | z",
    "<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>": "ab |   | c\n1  | 2 | 3",
    "<pre>a\n   b\n</pre>c": "a\n   b\n\nc",
    "x<div hidden>no</div><span style='display: none'>no</span>y": "xy",
    "<div style='visibility:hidden'>no<i style='visibility:visible'>yes</i></div>": "yes",
    "<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>": "S\nT\nyes",
    "<title>no</title><script>if (a < b) {'</p>'}</script><style>p{}</style>x": "x",
    "<head><meta charset=x><p>y": "y",
    "a &lt; b &amp;amp; &eacute;&nbsp;! 1 < 2 <3": "a < b &amp; é ! 1 < 2 <3",
    "<!-- a --> b <!-- open": "b",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n  d\nu",
    "<textarea>no</textarea><select><option>no</select>ok</b></p>.": "ok\n\n.",
    "": "",
}


@pytest.mark.parametrize("page", CASES)
def test_rendering(page):
    assert html_text.visible_text(page) == CASES[page]


FOREIGN = {
    "so <math><mi>x</mi><mo>+</mo><mn>1</mn></math> holds": "so x+1 holds",
    "<math><semantics><mi>y</mi><annotation>no</annotation><annotation-xml><mi>no</mi></annotation-xml></semantics></math>!": "y!",
    "<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3</mtd><mtd>4</mtd></mtr></mtable></math>": "1 2\n3 4",
    "<p>Plan<svg viewBox='0 0 1 1'><title>no</title><desc>no</desc><metadata>no</metadata><defs><text>no</text></defs>"
    "<rect width=1 /><text x=1>North</text><text x=2>South</text></svg>end": "Plan\nNorth\nSouth\nend",
    "<svg><defs/><desc/><title/><style/><path d='M0'/><text>a<tspan>b</tspan><tspan x='0' dy='1em'>c</tspan></text></svg>d": "ab\nc\nd",
    "<svg><style>text{}</style><script>no</script><text display='none'>no</text><text visibility=hidden>no</text></svg>z": "z",
    "<svg hidden><text>no</text></svg><svg><foreignObject><p>yes</p></foreignObject></svg>": "yes",
    "<desc>yes</desc> <text>a</text><text>b</text>": "yes ab",
}


@pytest.mark.parametrize("page", FOREIGN)
def test_formulas_and_drawings(page):
    assert html_text.visible_text(page) == FOREIGN[page]


def test_odd_pages():
    assert html_text.visible_text(None) == ""
    for page in ("<div>" * 30_000 + "x", "<p><b>" * 20_000 + "x", "<a href='" * 20_000 + "x", "<" * 50_000, "<ul><li>" * 3_000 + "x"):
        assert isinstance(html_text.visible_text(page), str)


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style") and tag == "head"
        self.raw = tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag == "head"
        self.raw = False

    def handle_data(self, data):
        if not self.hidden and not getattr(self, "raw", False):
            self.out.append(data)


def test_all_words_of_whole_pages(spark, sf):
    rows = {r["page_id"]: r for r in QUERIES["op9_visible_text"](spark, sf).collect()}
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    assert len(rows) == len(pages)
    for page in pages.itertuples():
        parser = Words()
        parser.feed(page.html)
        plain = re.sub(r"\s+", "", "".join(parser.out))
        found = re.sub(r"\s+", "", re.sub(r"^ *- ", "", rows[page.page_id]["text"], flags=re.M))
        assert found == plain
        assert rows[page.page_id]["n_chars"] == len(rows[page.page_id]["text"])


def test_pages_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "u"), (None, "<p>x", "v"), (2, "<p>x", "w"), (2, "<p>x", "w")], "page_id long, html string, text string")
    rows = html_text.extract(pages).collect()
    assert sorted(str(r["page_id"]) + r["text"] for r in rows) == ["1", "2x", "2x", "Nonex"]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_nested_quotes(spark):
    rows = [
        ("c", 1, "user", "Hello there\nfriend"),
        ("c", 2, "assistant", "Hi!\n> hello   THERE\n> friend"),
        ("c", 3, "user", "Thanks\n>hi!\n>> Hello there\n> > friend\nBye"),
        ("c", 4, "user", "Also\n> hello there friend"),
        ("c", 5, "user", "New topic\n> nobody said this"),
        ("c", 6, "user", "> New topic"),
        ("d", 1, "user", "x\n> Hello there friend"),
    ]
    frame = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    found = {(r["conv_id"], r["turn"]): r for r in chat.conversations(frame).collect()}
    want = {1: (None, 1, 0, 0), 2: (1, 1, 1, 1), 3: (2, 1, 2, 2), 4: (1, 1, 1, 3), 5: (None, 5, 0, 0), 6: (5, 5, 1, 1)}
    for turn, (parent, thread, depth, position) in want.items():
        r = found["c", turn]
        assert (r["parent"], r["thread"], r["depth"], r["position"]) == (parent, thread, depth, position)
    assert found["d", 1]["parent"] is None
    assert found["c", 3]["text"] == "Thanks\nBye" and found["c", 3]["n_quotes"] == 2 and found["c", 3]["n_linked"] == 2
    assert found["c", 6]["text"] == "" and found["c", 6]["formatted"] == "<|user|>\n\n"


def test_long_reply_chains(spark):
    turns = spark.range(300).selectExpr("1L conv_id", "id turn", "'user' role", "concat('message ', id) text")
    rows = chat.conversations(chat.quoting_messages(turns)).collect()
    assert all((r["thread"], r["depth"], r["position"]) == (0, r["turn"], r["turn"]) for r in rows)
    assert all(r["text"] == f"message {r['turn']}" for r in rows)


def test_messages_odd_rows(spark):
    rows = [
        (1, 0, None, None, "z"), (1, 1, "user", "", "z"), (1, 2, "user", "> ", "z"), (1, 3, "a", "same", "z"),
        (1, 4, "a", "same", "z"), (1, 5, "a", "r\n> same", "z"), (1, 5, "a", "r\n> same", "z"), (None, 6, "a", "> same", "z"),
        (1, None, "a", "> same", "z"), (1, 7, "a", "w " * 100_000 + "\n> same", "z"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, scope string")
    found = {(r["conv_id"], r["turn"]): r for r in chat.conversations(frame).collect()}
    assert len(found) == 9 and found[1, 5]["parent"] == 3 and found[1, 7]["parent"] == 3
    assert found[None, 6]["parent"] is None and found[None, 6]["thread"] == 6 and found[1, None]["thread"] is None
    assert found[1, 0]["text"] == "" and found[1, 2]["n_linked"] == 0
    assert chat.conversations(frame.limit(0)).count() == 0


def test_partial_and_interleaved_quotes(spark):
    rows = [
        (1, "Where do we meet?\nAnd when?\n\nI could bring\nsome cake.\n\nBest"),
        (2, "> And  when?\nAt noon."),  # one line
        (3, "> I could bring some cake.\nPlease do."),  # a paragraph, wrapped otherwise
        (4, "> Where do we meet?\nAt the bridge.\n> and when?\nAt one.\n> I could bring\n> some cake.\nNo need."),
        (5, "> At the bridge.\n> At one.\n> No need.\nFine."),  # all of an interleaved reply in one run
        (6, "> At one.\nLate!\n> > And when?"),  # one part of an interleaved reply, and an older line deeper
        (7, "Fine."),
        (8, "> Late!\n> nobody said this\nOh"),
        (9, "> Best\n> At the bridge.\nok"),  # the longest part decides
        (10, "Best"),
        (11, "> best\nyes"),  # who says just that comes before who says it among other things
        (12, "> nobody said this either\nhm\n> \n"),
    ]
    frame = spark.createDataFrame([("c", n, "user", text) for n, text in rows], "conv_id string, turn long, role string, text string")
    found = {r["turn"]: r for r in chat.conversations(frame).collect()}
    parents = {1: None, 2: 1, 3: 1, 4: 1, 5: 4, 6: 4, 7: None, 8: 6, 9: 4, 10: None, 11: 10, 12: None}
    assert {n: r["parent"] for n, r in found.items()} == parents
    assert {n: r["n_linked"] for n, r in found.items()} == {
        1: 0, 2: 1, 3: 1, 4: 3, 5: 1, 6: 2, 7: 0, 8: 1, 9: 1, 10: 0, 11: 1, 12: 0}
    assert {n: r["thread"] for n, r in found.items()} == {
        1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 1, 9: 1, 10: 10, 11: 10, 12: 12}


def test_every_message_stays(spark):
    rows = [
        (1, None, "a", "x"), (1, None, "a", "y"), (1, None, None, None), (1, None, "a", "x"), (None, None, "a", "x"),
        (None, None, None, "x"), (None, 3, "a", "x"), (None, 3, "b", "x"), (2, 1, None, "one"), (2, 1, "a", None),
        (2, 1, "a", "one"), (2, 1, "a", "two"), (2, 1, "a", "two"), (2, 1, "b", "two"), (2, 2, "a", "r\n> two"),
        (2, 2, "a", "s\n> one"), (2, 3, "b", "t\n> r"), (2, 3, "b", "u\n> s"), (2, 3, "b", "v\n> t"),
        (2, 4, "one", None), (2, 4, None, "one"), (2, 5, "a", "w\n> s\n>> two"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.conversations(frame.repartition(5)).collect()
    own = [(c, t, r, "\n".join(x for x in (text or "").split("\n") if x[:1] != ">")) for c, t, r, text in rows]
    own.remove((2, 1, "a", "two"))
    by = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r["conv_id"], r["turn"], r["role"], r["text"]) for r in found), key=by) == sorted(own, key=by)
    said = {r["text"]: (r["parent"], r["thread"], r["depth"]) for r in found if r["conv_id"] == 2 and r["turn"] in (2, 3, 5)}
    assert said == {"r": (1, 1, 1), "s": (1, 1, 1), "t": (2, 1, 2), "u": (2, 1, 2), "v": (None, 3, 0), "w": (2, 1, 2)}
    assert all((r["parent"], r["depth"], r["position"]) == (None, 0, 0) for r in found if r["conv_id"] != 2)
    places = [(r["thread"], r["position"]) for r in found if r["conv_id"] == 2 and r["text"] in ("r", "t", "s", "u", "w")]
    assert sorted(p for _, p in places) == [1, 1, 2, 2, 3]


def test_linking_runs_without_python(spark, sf):
    plan = QUERIES["op7_quotation_linking"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)


HOSTILE = {
    "tags without end": lambda n: "<a " * n,
    "open quotes": lambda n: "<i x='" * n,
    "ends in quotes": lambda n: "<a x='>'" * n,
    "items below many elements": lambda n: "<div>" * n + "<li>x</li>" * n,
    "end tags behind a barrier": lambda n: "<b><table><tr><td>" + "<div>" * n + "</b>" * n,
    "deep quotations": lambda n: "<blockquote>x" * n,
    "equals signs": lambda n: "<svg><a " + "=" * n + '"/>',
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_grows_with_the_page(name):
    def seconds(n):
        taken = []
        for _ in range(3):
            start = time.process_time()
            html_text.visible_text(HOSTILE[name](n))
            taken.append(time.process_time() - start)
        return min(taken)

    assert seconds(40_000) < 3 * seconds(20_000) + 0.05  # the square would be fourfold


def test_a_megabyte_of_open_tags():
    start = time.process_time()
    assert html_text.visible_text("<a " * 350_000) == ("<a " * 350_000).strip()
    assert time.process_time() - start < 1


def test_tags_end_where_quotes_let_them():
    cases = {"<a x='>'>b": "b", "<a x='>b": "b", '<a x=">" y=\'>c': "c", "<a <b>c": "c", "1 <a x='>' y": "1 <a x='>' y", "<a x='> <b>' y<p>z": "z"}
    long = "y" * 2 * html_text.NEAR
    cases |= {f"<a x='{long}>'>b": "b", f"<a {long}>b": "b", f"<a x='{long}>b": "b"}
    assert {k: html_text.visible_text(k) for k in cases} == cases
