import time

from scriptoria.llm import html_tree as H

BODY = "<article><p>One first paragraph of the text.</p><p>Another paragraph, and more of it.</p></article>"


def tree(page):
    forest = H.Forest()
    forest.add(page, 0)
    return forest.parent, forest.kind, forest.text, forest.zone


def test_long_attribute_values_keep_their_element():
    for q, value in (('"', "x" * 5000), ("'", '{"a": "<p>b</p>"}' * 1000), ('"', "if (a > b) { c('d') }" * 1000)):
        for page in ("<nav{}><p>Home and more.</p></nav>" + BODY, "<div{} class=sidebar><div><p>Links here.</p></div></div>" + BODY, BODY.replace("<p>", "<p{}>"), "<script{}>var a = 1; b.</script>" + BODY):
            long, short = (page.replace("{}", f" data-v={q}{v}{q}") for v in (value, "y"))
            assert tree(long) == tree(short)
            assert H.extract([long], H.trained()) == H.extract([short], H.trained())


def test_quotes_are_followed_once():
    began = time.perf_counter()
    pages = ['<a ">"' * 100_000, "<a '>\">" * 50_001, '<p "' + "<p '>x" * 50_000, "<p>a" + "<b x=\"'>\" y='>" * 50_001]
    H.extract(pages, H.trained())
    assert time.perf_counter() - began < 20
    assert tree('<p>a</p><div title="b>c</div>')[2] == tree("<p>a</p>c</div>")[2]


def test_deep_nesting_takes_linear_time():
    import time

    took = []
    for n in (2000, 16000):
        page = "<div>" * n + "<p>Some words here. " + "</section></article>" * n + "<li>a" * n + "</div>" * n + "<object>" * n + "</svg>" * n
        t0 = time.perf_counter()
        H.extract([page], H.trained())
        took.append(time.perf_counter() - t0)
    assert took[1] < 30 * max(took[0], 0.05)


def test_what_a_start_tag_closes():
    page = "<article><ul><li>one<ul><li>inner<li>other</ul><li>two</ul><table><tr><td>a<td>b<tr><td>c</table><p>End of it.</article>"
    assert H.extract([page], H.trained())[0].split("\n") == ["one", "inner", "other", "two", "a", "b", "c", "End of it."]
