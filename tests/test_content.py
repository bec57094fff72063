"""Page content as Markdown: hand-written pages of each kind."""

from sitelore.sources import html

CASES = {
    "plain": ("<h1>A</h1><p>b <b>c</b><br>d</p>", "# A\n\nb **c**\nd"),
    "list": ("<p>x</p><ul>\n <li> a</li>\n <li>b\n  c</li>\n</ul><p>y</p>", "x\n\n- a\n- b c\n\ny"),
    "nested": ("<ul><li>a<ul><li>b<ul><li>c</li></ul></li></ul></li><li>d</li></ul>", "- a\n  - b\n    - c\n- d"),
    "numbers": ("<ol><li>a</li><li>b<ol start='7'><li>c</li><li>d</li></ol></li><li>e</li></ol>",
                "1. a\n2. b\n  7. c\n  8. d\n3. e"),
    "mixed": ("<OL><LI>a<UL><LI>b</UL><LI>c</OL>z", "1. a\n  - b\n2. c\n\nz"),
    "item alone": ("<li>a<li>b", "- a\n- b"),
    "ends alone": ("</ul></ol></table></pre></a>x", "x"),
    "table": ("<table><tr><th>k</th><th>v|w</th></tr>\n<tr><td>1</td><td><p>2\n3</p></td></tr></table>after",
              "| k | v\\|w |\n| --- | --- |\n| 1 |  2 3  |\n\nafter"),
    "table in table": ("<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>", "| a   b  |\n| --- |"),
    "pre": ("<p>a</p><pre>\nif x:\n\n\n    y  \n\t<b>z</b>&lt;1</pre><p>b</p>", "a\n\n```\nif x:\n\n\n    y  \n\tz<1\n```\n\nb"),
    "link": ("<p>see <a class=x href=\"/a?b=1&amp;c=2\">the <b>page</b></a> <a name=n>here</a></p>",
             "see [the **page**](/a?b=1&c=2) here"),
    "link in list": ("<ul><li><a href='u'>t</a></li></ul>", "- [t](u)"),
    "open": ("<ul><li>a<table><tr><td>b", "- a\n\n| b"),
    "entities": ("&#65;&#x1F600;&#0;&#xD800; &amp;#66; &#; &#12 &mdash;&hellip;&nbsp;x",
                 "A\U0001F600\ufffd\ufffd &#66; &#; &#12 \u2014\u2026 x"),
    "less": ("<ul><li>1 < 2</li></ul>", "- 1 < 2"),
    "dropped": ("<nav><ul><li>n</li></ul></nav><p>x</p><footer><a href='f'>f</a></footer>", "x"),
    "empty": ("", ""),
    "null": (None, None),
}


def test_kinds_of_content(spark):
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", h) for i, (h, _) in enumerate(CASES.values())],
                                  "page_id long, url string, html string")
    got = {r.page_id: r.markdown for r in html.extract_content(pages).collect()}
    for i, (name, (_, want)) in enumerate(CASES.items()):
        assert got[i] == want, name


def test_page_of_many_items(spark):
    many = 20_000
    page = "<ol>" + "".join(f"<li>w{i}" + ("<ul><li>x</ul>" if i % 1000 == 0 else "") + "</li>" for i in range(many)) + "</ol>"
    out = html.extract_content(spark.createDataFrame([(1, "http://a.org/", page)], "page_id long, url string, html string"))
    want = "\n".join(f"{i + 1}. w{i}" + ("\n  - x" if i % 1000 == 0 else "") for i in range(many))
    assert out.collect()[0].markdown == want
