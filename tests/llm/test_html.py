import numpy as np
import pytest

from markbook.llm.html import extract, main_text, smoothed, threshold

PAGES = [
    ("<p>a b<p>c", "a b\n\nc"),
    ("<div class=ad>x</div><article><h1>T &amp; U</h1><p>Hello&nbsp;w\n  o<br>x<b>r</b>ld<ul><li>one<li>two</ul>"
     "<div class='user-comments'><p>bad</p></div></article><footer>z", "T & U\n\nHello w o xrld\n\none\n\ntwo"),
    ("<article><p>a<script>var t='</p>';</script><style>p{}</style> b<aside>side</aside><form><label>q</label></form></article>", "a b"),
    ("<nav><p>menu</nav><main><header><h1>Head</h1></header><p>&#x41;&eacute;&lt;b&gt;</main><p>outside", "Head\n\nAé<b>"),
    ("<![if x]><p>kept<![endif]><!-- <p>gone --><![CDATA[gone]]>", "kept"),
    ("<article>" + "<p><b>bold.<br><p>next" * 100 + "</article><p>after", "\n\n".join(["bold.", "next"] * 100)),
    (None, ""), ("", ""), ("  \n", ""), ("plain  text", "plain text"), ("<div hidden><p>x</div><p role=note>y<p>z", "z"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_extract(html, text):
    assert extract(html) == text


def test_without_article_the_ratio_decides():
    menu = "".join(f"<div><a href=/{i}>go {i}</a></div>" for i in range(20))
    prose = "".join(f"<div>{'word ' * 60}{i}.</div>" for i in range(8))
    text = extract(f"<body>{menu}{prose}{menu}</body>")
    assert text.count("word") == 480 and "go" not in text


def test_smoothing_keeps_constants_and_threshold_parts_two_clusters():
    assert np.allclose(smoothed(np.full(7, 3.0)), 3.0) and np.allclose(smoothed(np.array([5.0])), 5.0)
    assert 1 < threshold(np.array([1.0, 1.2, 50, 60])) < 50 and threshold(np.array([5.0, 6, 7])) == 0


def test_rows(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "v", "<article><p>" + "long text " * 20000)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "page_id long, url string, html string, n_chars int, parts string")
    got = sorted(((r.page_id or 0, len(r.text)) for r in main_text(df).collect()))
    assert got == [(0, 0), (1, 1), (1, 1), (2, 199999)]
    assert main_text(df.limit(0)).count() == 0
