"""Main text of pages: markup rules, the alignment of lines, and differencing within a host."""

import random

import pytest

from pyspark.sql import functions as F

from terrane.llm import html_extract as H

ARTICLE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav>
<article><h1>A &amp; B</h1><p>One  <b>two</b>\n three&nbsp;four</p><script>x()</script><p class="ad">Buy</p><ul><li>x</li><li>y</li></ul></article>
<aside>side</aside><div id="comments"><p>first!</p></div><footer>foot</footer></body></html>"""


def main_text(html):
    lines, zones = H.lines_of(html)
    return "\n".join(x for x, z in zip(lines, zones) if z != H.DROPPED)


def test_structure():
    assert main_text(ARTICLE) == "A & B\nOne two three four\nx\ny"
    assert main_text("plain <i>text</i> &lt;b&gt;") == "plain text <b>"
    assert main_text("<main><p>in</p><form><input>q</form></main><p>out</p>") == "in"
    assert main_text("") == "" and main_text("<script>only()") == ""
    assert main_text("<p>a<br>b</p><!-- c --><p>d") == "a b\nd"
    assert main_text("<p title='>'>q</p>") == "q"


def test_names_that_hold_a_marked_word_keep_the_article():
    assert main_text('<article class="post tag-social category-search"><h2 id="search-algorithms">S</h2><p>x</p><section id="related-work">R</section><h3 id="ads">A</h3></article>') == "S\nx\nR\nA"
    assert main_text('<h2 id="search-algorithms">S</h2><div class="post tag-social">x</div><div class="site-footer">f</div><div class="cookie-notice">c</div>') == "S\nx"
    assert main_text('<article><p>x</p><div class="box ads">ad</div><p role="search">q</p><div class="comments">c</div></article>') == "x"
    assert main_text('<article><p>x</p><article class="comment">first!</article><p>y</p></article><p>z</p>') == "x\ny"
    wordpress = '<ol id="comments"><li class="comment even"><article id="div-comment-3" class="comment-body"><p>first!</p></article></li></ol>'
    assert main_text(f"<article><p>x</p></article>{wordpress}") == main_text(f"<article><p>x</p>{wordpress}</article>") == "x"


def test_unclosed_skipped_elements_end_where_html_ends_them():
    assert main_text('<article><p class="ad">Buy<p>one<p>two</article>') == "one\ntwo"
    assert main_text('<article><ul><li class="share">Share<ul><li>deep</ul><li>one</ul><p>two</article>') == "one\ntwo"
    assert main_text('<article><div><ul><li>one<li class="share">Share</ul><p>two</div></article>') == "one\ntwo"
    assert main_text('<article><div><p class="ad">Buy</div>one <span class="ad">Buy</span> two<div><aside>side</div><p>three</article>') == "one\ntwo\nthree"
    assert main_text('<article><table><tr><td class="ad">Buy<td>one<tr><td>two</table></article>') == "one\ntwo"
    assert main_text('<article><div class="ad"><div>Buy</div>now</div>one</article>') == "one"


def longest(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        for bits in (1 << 20, 8):  # whole, and in halves
            found = H.shared_lines(a, b, bits)
            assert found == sorted(set(found)) and len(found) == longest(a, b)
            rest = iter(b)
            assert all(any(a[i] == y for y in rest) for i in found)


def test_differencing_deletes_what_the_nearest_page_shares(spark):
    page = lambda body: f"<div>Menu</div><div>Welcome</div><p>{body}</p><div>Imprint</div>"
    rows = [(k, f"http://h.example/a/{k}", page(f"text {k}")) for k in range(30)]
    rows += [(100, "http://other.example/a/1", page("alone")), (101, None, page("no url")), (102, "http://h.example/x", None), (103, "http://h.example/y", "")]
    rows += [(0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit(0))
    got = H.extract(pages.repartition(3)).select("page_id", "text").collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[k] == f"text {k}" for k in range(30))
    assert text[100] == "Menu\nWelcome\nalone\nImprint" and text[101].endswith("no url\nImprint")
    assert text[102] == text[103] == ""
    assert H.extract(pages.limit(0)).count() == 0


def test_copies_are_passed_over_for_the_nearest_other_page(spark):
    page = lambda *body: "<div>Menu</div><div>Welcome</div>" + "".join(f"<p>{x}</p>" for x in body) + "<div>Imprint</div>"
    story = [f"line {i}" for i in range(8)]
    rows = [(1, "http://a.example/n/1", page(*story, "old")), (2, "http://a.example/n/1", page(*story, "new"))]  # one URL again
    rows += [(3, "http://a.example/n/2", page("two")), (4, "http://a.example/n/3", page("three"))]
    rows += [(10, "http://b.example/n/1", page(*story, "web")), (11, "http://b.example/n/1/print", page(*story, "print"))]  # another URL
    rows += [(12, "http://b.example/n/2", page("two")), (13, "http://b.example/n/3", page("three"))]
    rows += [(k, f"http://c.example/n/{k}", page("same", "text")) for k in range(20, 40)] + [(40, "http://c.example/o", page("other"))]  # a run
    rows += [(50, "http://d.example/1", page(*story, "old")), (51, "http://d.example/1", page(*story, "new"))]  # nothing else
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).select("page_id", "text").collect()
    text = {r["page_id"]: r["text"] for r in got}
    told = "\n".join(story)
    assert [text[k] for k in (1, 2, 3, 4)] == [f"{told}\nold", f"{told}\nnew", "two", "three"]
    assert [text[k] for k in (10, 11, 12, 13)] == [f"{told}\nweb", f"{told}\nprint", "two", "three"]
    assert {text[k] for k in range(20, 40)} == {"same\ntext"} and text[40] == "other"
    assert told in text[50] and told in text[51]


def test_articles_stay_where_neighbours_repeat_them(spark):
    rows = [(k, f"http://h.example/{k}", f"<nav>m</nav><article><p>the same passage</p><p>own {k}</p></article><p>advert {k}</p>") for k in range(4)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"the same passage\nown {k}" for k in range(4)}


def test_what_opens_and_closes_articles_stays(spark):
    rows = [(k, f"http://h.example/{k}", f"<article><h1>Chapter notes</h1><p>unique text {k}</p><p>more {7 * k}</p><p>The end.</p></article>") for k in range(12)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r["page_id"], r["text"]) for r in got} == {(k, f"Chapter notes\nunique text {k}\nmore {7 * k}\nThe end.") for k in range(12)}


@pytest.mark.parametrize("name", ["ad-slot-3", "ad-container", "cookie-notice", "comment-list", "newsletter-signup", "sponsored_content"])
def test_marked_blocks_go_within_articles(name):
    for kind in ("id", "class"):
        lines, zones = H.lines_of(f"<article><p>A</p><div {kind}='{name}'>Buy now</div><p class='tag-social related-work comment-worthy adverse'>B</p></article>")
        assert [x for x, zone in zip(lines, zones) if zone == H.INSIDE] == ["A", "B"]
    lines, zones = H.lines_of("<article><div class='share-buttons'>Share</div><p id='share'>C</p></article>")
    assert [x for x, zone in zip(lines, zones) if zone == H.INSIDE] == ["C"]


def test_a_very_long_page(spark):
    rows = [(k, f"http://h.example/{k}", "<div>Menu</div>" + "".join(f"<p>line {k} {i}</p>" for i in range(60_000)) + "<div>Imprint</div>") for k in range(2)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "\n".join(f"line {k} {i}" for i in range(60_000)) for k in range(2)}


def sites(n_hosts=4, n_pages=12):
    """Pages with known main texts: templates without marks, with and without an article element, passages that a site repeats, copies."""
    rng = random.Random(8)
    words = [f"word{i}" for i in range(500)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], {}
    for h in range(n_hosts):
        menu, foot, quote = [f"Menu {h} {i}" for i in range(5)], [f"Imprint {h}", f"Contact {h}"], some(9)
        for k in range(n_pages):
            body = [some(rng.randrange(3, 20)) for _ in range(rng.randrange(2, 9))]
            if k % 4 == 1:
                body.insert(1, quote)  # a passage that some pages of the site repeat
            lines = "".join(f"<p>{x}</p>" for x in body)
            if h % 2:
                share = "<div class='share-buttons'>Share this page</div>", "<div id='newsletter-signup'>Read our letter</div>"
                page = "".join(f"<div>{x}</div>" for x in menu) + f"<article>{share[0]}{lines}{share[1]}</article><div>advert {some(3)}</div>" + "".join(f"<div>{x}</div>" for x in foot)
                own = body
            else:
                page = "".join(f"<div>{x}</div>" for x in menu) + lines + "".join(f"<div>{x}</div>" for x in foot)
                own = body
            at = 100 * h + k
            rows.append((at, f"http://host{h}.example/{'ab'[k % 2]}/{k:02}", page))
            want[at] = "\n".join(own)
            if k % 5 == 0:  # a copy at another path
                rows.append((at + 50, rows[-1][1] + "/print", page))
                want[at + 50] = want[at]
    return rows, want


def test_known_main_texts(spark):
    rows, want = sites()
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert len(got) == len(rows)
    wrong = {r["page_id"]: (r["text"], want[r["page_id"]]) for r in got if r["text"] != want[r["page_id"]]}
    assert not wrong, wrong


def test_blocks_and_parts_of_blocks_give_the_same(spark, monkeypatch):
    rows, want = sites()
    rows += [(1000 + i, f"http://host0.example/a/zz{i}", rows[0][2]) for i in range(40)]  # a large group of copies
    want |= {1000 + i: want[0] for i in range(40)}
    monkeypatch.setattr(H, "BLOCK", 4)
    monkeypatch.setattr(H, "PAGES", 6)
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_without_structure_differencing_alone_decides(spark):
    rows = [(k, f"http://h.example/{k}", f"<nav>m</nav><article><p>the same passage</p><p>own {k}</p></article><p>advert {k}</p>") for k in range(4)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), structure=False).collect()
    assert {r["text"] for r in got} == {f"own {k}\nadvert {k}" for k in range(4)}
