import duckdb
import numpy as np
import pytest

from loomgraph.llm import mainext
from loomgraph.llm.mainext import Weights, best_run, main_text

LONG = "Here are quite a few words of an article that goes on for a while and then ends."
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
FOOT = "<footer>&copy; 2020 somebody who wrote a rather long line of text at the foot of the page</footer>"


@pytest.mark.parametrize("seed", range(30))
def test_scan_against_all_runs(seed):
    rng = np.random.default_rng(seed)
    x = [float(v) for v in rng.integers(-3, 4, int(rng.integers(0, 30)))]
    runs = {(i, j): sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    most = max(runs.values(), default=0)
    if most <= 0:
        assert best_run(x) == (0, 0)
    else:
        first = min(i for (i, j), v in runs.items() if v == most)
        assert best_run(x) == (first, max(j for (i, j), v in runs.items() if v == most and i == first))


def page(body, head="<title>A title</title><style>p{}</style><script>var x='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def labelled():
    """Weights of pages with marked content, as the fixture's pages have them."""
    pages = [page(f"{MENU}<div class='ad'>Buy {i} of our things now</div><article><h1>Title {i}</h1>{'<p>' + LONG * 2 + '</p>'} <p>{LONG}</p></article>{FOOT}") for i in range(20)]
    counts = sum((mainext.evidence(mainext.read(x)) for x in pages), mainext.Counter())
    return mainext.weighed(counts)


def test_weights_of_labelled_pages():
    w = labelled()
    assert w.word > 0 > w.tag and w.of_tag("li") < w.of_tag("p") < 0 and w.of_tag("footer") < -2 and w.shares["ad"] < 0.2
    assert all(w.of_tag(t) < 0 for t in ("p", "h1", "div", "unknown", "section"))
    nothing = mainext.weighed({})
    assert (nothing.word, nothing.tag) == (1.0, -3.25)
    assert mainext.evidence(mainext.read(page("<p>no mark</p>"))) == {}


CASES = {
    "marked": (f"{MENU}<header><h1>Site</h1></header><main><h1>T</h1><p>{LONG}</p></main><aside><p>{LONG} {LONG} {LONG}</p></aside>{FOOT}", ["T", LONG]),
    "one word": (f"{MENU}<article><h1>T</h1><p>Yes.</p></article>{FOOT}", ["T", "Yes."]),
    "article header stays": (f"<header>{MENU} Some site</header><article><header><h1>T</h1></header><p>{LONG}</p><footer>Tags: a, b</footer></article>", ["T", LONG]),
    "left open": (f"<nav><ul><li>a<li>b<article><h1>T</h1><p><b>{LONG}<br><p>{LONG}</article>{FOOT}", ["T", LONG, LONG]),
    "cut page": (f"{MENU}<article><h1>T</h1><p>{LONG}<p>And so it", ["T", LONG, "And so it"]),
    "cut in a tag": (f"{MENU}<article><p>{LONG}</p><a href='/x", [LONG]),
    "noise inside": (f"<article><h1>T</h1><p>{LONG}</p><div class='advert-box'>Buy this</div><form><p>Your mail</p><input><button>Send</button></form><p>{LONG}</p><div class='share-bar'>Share</div><section id='comments'><article class='comment'><p>{LONG} {LONG}</p></article></section></article>", ["T", LONG, LONG]),
    "cookie notice": (f"<div class='cookie-notice'><p>{LONG} {LONG}</p><button>OK</button></div><article><p>{LONG}</p></article>", [LONG]),
    "hidden": (f"<article><p>{LONG}</p><p hidden>not</p><p style='display: none'>not</p><noscript>not</noscript><template><p>not</p></template></article>", [LONG]),
    "inline": ("<article><p>a<b>b</b>c <i>d</i>\n\t e&nbsp;f<!-- x > y --> g<br>h &lt;i&gt; &amp;amp; &#x41;&#66; &eacute;t&eacute &am</p></article>", ["abc d e f g h <i> &amp; AB été &am"]),
    "lists and tables": (f"<article><p>{LONG}</p><ul><li>one<li>two <b>x</b></ul><table><tr><td>1<td>2<tr><td>3<td>4</table><blockquote>q</blockquote><pre>a\n  b</pre></article>", [LONG, "one", "two x", "1", "2", "3", "4", "q", "a b"]),
    "strange markup": (f"<article><p>1 < 2 and 3 > 2, <3</p><? php ?><!-- <p>no</p> --><p title='a > b' data-x=\"it's\" checked>{LONG}</p></span></article>", ["1 < 2 and 3 > 2, <3", LONG]),
    "wrapped in a form": (f"<form id='all'>{MENU}<article><h1>T</h1><p>{LONG}</p></article></form>", ["T", LONG]),
    "states aren't names": (f"<article class='post has-sidebar comments-open'><h1>T</h1><p>{LONG}</p></article>", ["T", LONG]),
    "no article, divs": (f"<div class='menu'><a href=x>a</a> <a href=y>b</a></div><div id='content'><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>End.</p></div><div class='sidebar'>{LONG} {LONG} {LONG} {LONG} {LONG}</div>", ["T", LONG, LONG, "End."]),
    "no article, bare": (f"{MENU}<h1>T</h1><p>{LONG}</p><p>{LONG}</p>{FOOT}", ["T", LONG, LONG]),
    "menu without a name": (f"<div><ul><li><a>a</a></li><li><a>b</a></li><li><a>c</a></li></ul></div><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div><ul><li><a>d</a></li><li><a>e</a></li></ul></div>", ["T", LONG, LONG]),
    "script words": (f"<article><p>{LONG}</p><script>if (a < b) {{ document.write('<p>{LONG}</p>') }}</script><style>p {{ x }}</style><textarea><p>no</p></textarea></article>", [LONG]),
    "no words": (f"{MENU}{FOOT}", []),
    "no spaces": ("<article><p>" + "日本語の文章" * 30 + "</p></article>" + FOOT, ["日本語の文章" * 30]),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    body, want = CASES[name]
    assert main_text(page(body) if not name.startswith("cut") else page(body)[: page(body).index("</body>")], labelled()) == "\n\n".join(want)


@pytest.mark.parametrize("name", [n for n in CASES if n not in ("menu without a name",)])
def test_pages_by_the_prior_alone(name):
    body, want = CASES[name]
    if "one word" in name or "inline" in name or name == "no spaces":
        return  # too few words to outweigh their tags without labelled pages
    assert main_text(page(body) if not name.startswith("cut") else page(body)[: page(body).index("</body>")]) == "\n\n".join(want)


def test_plain_text_and_edges():
    assert main_text(None) == main_text("") == main_text("   ") == main_text("<") .replace("<", "") == ""
    assert main_text("just text, no markup at all") == "just text, no markup at all"
    assert main_text("<p>" * 3000 + LONG) == LONG
    deep = "<div>" * 20000 + f"<p>{LONG}</p>"
    assert main_text(deep) == LONG
    many = "<article>" + f"<p>{LONG}</p>" * 20000 + "</article>"
    assert main_text(many) == "\n\n".join([LONG] * 20000)
    assert main_text("<a " * 20000 + '"' * 20000) == ""


def test_table(spark):
    rows = [(i, f"u{i}", page(f"{MENU}<article><h1>Title {i}</h1><p>{LONG}</p></article>{FOOT}")) for i in range(50)]
    rows += [(None, None, None), (50, None, ""), (1, "u1", rows[1][2]), (51, "u", "<p>" + LONG)]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = mainext.extracted(df, mainext.fitted(df)).collect()
    text = lambda i, h: "" if not h else LONG if i == 51 else f"Title {i}\n\n{LONG}"
    assert sorted(map(str, got)) == sorted(f"Row(page_id={i!r}, url={u!r}, text={text(i, h)!r}, n_chars={len(text(i, h))})" for i, u, h in rows)
    none = df.where("false")
    assert mainext.extracted(none, mainext.fitted(none)).count() == 0 and mainext.fitted(none) == Weights()
    assert mainext.fitted(df, most=10).word > 0


def test_given_pages(spark):
    """The given pages mark their article, which is known by a plain cut and must be what the scan finds."""
    from loomgraph.llm import queries

    rows = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()
    want = {i: mainext.main_text("<article>" + h.split("<article>")[1].split("</article>")[0] + "</article>") for i, h in rows}
    assert {r["page_id"]: r["text"] for r in queries.op12_main_text(spark, "/root/testdata/sf0.001").collect()} == want
