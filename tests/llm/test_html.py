import html
import re

from scriptoria.llm import html_tree as H
from scriptoria.llm.op3_html import run


def test_held_out_pages():
    import numpy as np

    forest = H.labelled_forest(200, 77)
    p, _ = H.trained().marginals(*forest.arrays())
    leaf = np.array([t is not None for t in forest.text])
    assert ((p > 0.5) == np.array(forest.labels))[leaf].mean() > 0.97


def test_marginals_are_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    model = H.Model(rng.normal(size=H.FEATURES), rng.normal(size=(H._KINDS, 2, 2)))
    parent, depth, kind = np.array([-1, 0, 0, 1, 1, 2]), np.array([0, 1, 1, 2, 2, 2]), np.array([1, 2, 1, 0, 0, 0])
    rows, columns = np.arange(6).repeat(2), rng.integers(0, H.FEATURES, 12)
    weight = {}
    for y in itertools.product((0, 1), repeat=6):
        s = sum(model.unary[c] * y[r] for r, c in zip(rows, columns, strict=True)) + sum(model.edge[kind[k], y[parent[k]], y[k]] for k in range(1, 6))
        weight[y] = np.exp(s)
    z = sum(weight.values())
    p, pair = model.marginals(parent, depth, kind, rows, columns)
    for k in range(6):
        assert abs(p[k] - sum(w for y, w in weight.items() if y[k]) / z) < 1e-9
    for k in range(1, 6):
        assert abs(pair[k][1, 0] - sum(w for y, w in weight.items() if y[parent[k]] == 1 and y[k] == 0) / z) < 1e-9


PAGE = """<html><head><title>t</title><style>p{}</style><script>var x="</p><article>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">More</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies. Accept all of them.</p></div>
<article><h1>Title &amp; more</h1><p>First  paragraph,\n with <b>bold</b> text.<p>Second&nbsp;one &lt;here&gt;.<div class="ad">Buy this now. Great.</div><ul><li>point one<li>point two</ul></article>
<aside class="sidebar"><h3>Side</h3><p>Other things. Not here.</p></aside><form action="/s"><label>Your name</label><input></form>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I like it. A lot.</p></div></section><footer>&copy; me. All rights.</footer></body></html>"""


def test_parts_of_a_page():
    assert H.extract([PAGE], H.trained()) == ["Title & more\nFirst paragraph, with bold text.\nSecond one <here>.\npoint one\npoint two"]


def test_edge_pages_and_linear_scan():
    out = H.extract([None, "", "<", "<p", "<!-- x", "<script>x", "<a \"" * 20_000, "<" * 50_000, "<div>" * 2000 + "x", "<article><p>" + "word " * 200_000 + "</article>"], H.trained())
    assert out[:6] == ["", "", out[2], "", "", ""] and len(out[-1]) == 999_999


def test_query(spark, sf_dir):
    out = {r["page_id"]: r for r in run(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(out) == len(pages)
    for d in pages:
        lo, hi = d["html"].find("<article>") + 9, d["html"].find("</article>")
        body = d["html"][lo : hi if hi >= 0 else None]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body))
        assert out[d["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert out[d["page_id"]]["n_chars"] == len(out[d["page_id"]]["text"])


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<article><p>a", "y"), (1, "u", "<article><p>a", "y")], "page_id long, url string, html string, text string")
    assert sorted(r["n_chars"] for r in H.main_text(df).collect()) == [0, 1, 1]
    assert H.main_text(df.where("false")).count() == 0
