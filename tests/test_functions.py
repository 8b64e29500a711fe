"""Golden values of column expressions."""

import random

import pytest
from pyspark.sql import functions as F

from quoin.functions import geometry as G
from quoin.functions import html as H
from quoin.operators import similarity as M


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


BOXES = "a_l int, a_t int, a_r int, a_b int, b_l int, b_t int, b_r int, b_b int"


def test_overlap_metrics(spark):
    row = (0, 0, 10, 10, 5, 0, 15, 10)
    assert one(spark, G.intersection("a_", "b_"), BOXES, row) == 50
    assert one(spark, G.iou("a_", "b_"), BOXES, row) == pytest.approx(1 / 3)
    assert one(spark, G.share_of("a_", "b_"), BOXES, row) == 0.5
    assert one(spark, G.iou("a_", "b_"), BOXES, (0, 0, 0, 0, 5, 5, 5, 5)) == 0


@pytest.mark.parametrize(("kind", "box", "role"), [("Text", (0, 0, 200, 20), "foreground"), ("Compo", (0, 80, 200, 100), "container"), ("Block", (0, 0, 200, 100), "background"), ("Compo", (0, 0, 20, 20), "foreground")])
def test_roles(spark, kind, box, role):
    column = G.role(F.lit(kind), F.lit(None).cast("string"), F.lit(200), F.lit(100))
    assert one(spark, column, "l int, t int, r int, b int", box) == role


def test_rounding_is_half_to_even_and_clamped(spark):
    assert [one(spark, G.clip(F.lit(v), F.lit(12))) for v in (-2.0, 2.5, 3.5, 40.0)] == [0, 2, 4, 12]


def test_portions_and_sources(spark):
    assert list(one(spark, G.portions(F.array(*map(F.lit, (300, 700)))))) == [3, 7]
    assert one(spark, G.line_source(F.array(F.lit("whitespace"), F.lit("lsd")))) == "lsd"
    assert one(spark, G.source_weight(F.array(F.lit("whitespace"), F.lit("lsd"), F.lit("lsd")))) == pytest.approx(1.14)


def test_colour_similarity_against_published_pairs(spark):
    same = one(spark, G.ciede2000_similarity(*[tuple(map(F.lit, (10, 200, 30)))] * 2))
    black_white = one(spark, G.ciede2000_similarity(tuple(map(F.lit, (0, 0, 0))), tuple(map(F.lit, (255, 255, 255)))))
    assert same == 1 and black_white == pytest.approx(0, abs=0.01)


@pytest.mark.parametrize(
    ("column", "text", "expected"),
    [
        (lambda c: H.remove_element(c, "script"), "a<script x>b</script>c<script>d</script>e", "ace"),
        (H.remove_meta, '<meta charset="u"><meta name="a"><meta name="viewport" c>', '<meta charset="u"><meta name="viewport" c>'),
        (H.remove_comments, "a<!-- b\nc -->d<!-- e", "ad<!-- e"),
        (H.remove_blank_lines, "a\n  \n\nb", "a\nb"),
        (H.blank_links, 'x="https://a/b" y="www.c" z="d"', 'x="" y="" z="d"'),
        (H.redact, "mail a.b@c.org or 555-123-4567.", "mail [EMAIL REDACTED] or [PHONE REDACTED]."),
        (H.wrap_document, "p", "<html><body><p>p</p></body></html>"),
        (H.wrap_document, "<HTML lang=x>p", "<HTML lang=x>p"),
        (H.strip_fences, "```html\n<p>x</p>\n```", "<p>x</p>"),
        (H.unwrap_document, "<!DOCTYPE html><html><head><title>t</title></head><body class=a><p>x</p></body></html>", "<p>x</p>"),
        (H.placeholder_images, '<img class="c" src="a.png" alt="b"> "d.jpg"', '<img class="c" src="rick.jpg" alt="b"> "rick.jpg"'),
        (H.neutral_links, '<a href="https://a"> url(x.png) url(//b/c.css)', '<a href="#"> url(placeholder.png) url()'),
        (H.remove_imports, "a\n@import x;\nb", "a\nb"),
        (H.escape, '<a b="c">&', "&lt;a b=&quot;c&quot;&gt;&amp;"),
    ],
)
def test_html_columns(spark, column, text, expected):
    assert one(spark, column(F.col("x")), "x string", (text,)) == expected


@pytest.mark.parametrize(("link", "expected"), [("b.html#x", "http://h/d/b.html"), ("/r", "http://h/r"), ("//k/z", "http://k/z"), ("https://q/", "https://q/"), ("?a=1", "http://h/d/p?a=1"), ("", "http://h/d/p?q")])
def test_absolute_urls(spark, link, expected):
    assert one(spark, H.absolute_url(F.lit("http://h/d/p?q#f"), F.col("x")), "x string", (link,)) == expected


def test_snippet_reasons_and_validity(spark):
    assert one(spark, H.snippet_reasons(F.col("x")), "x string", ("```css\na{position: fixed;width:100vw}```",)) == ["code_fence", "positioned", "viewport_sized"]
    assert one(spark, H.valid(F.col("x")), "x string", ("All good",)) is True
    assert one(spark, H.valid(F.col("x")), "x string", ("Page Not Found",)) is False


def test_text_similarities():
    assert M.indel("kitten", "sitting") == pytest.approx(100 * 8 / 13)
    assert M.indel("", "") == 100 and M.ratcliff("abcd", "bcde") == 0.75


def test_assignment_is_optimal():
    from itertools import permutations

    import numpy as np

    draw = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 3), (4, 6)):
        cost = draw.random((n, m))
        rows, cols = M.assign(cost)
        assert len(set(rows)) == len(set(cols)) == min(n, m)
        if n <= m:
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n))
        else:
            best = min(sum(cost[p[j], j] for j in range(m)) for p in permutations(range(n), m))
        assert cost[rows, cols].sum() == pytest.approx(best)


def test_chunks_that_repeat_are_cut_at_their_first():
    from quoin.operators import similarity as M

    draw = random.Random(2)
    own = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz <") for _ in range(430)).replace("<", " ")
    unit = "".join(draw.choice("0123456789 ") for _ in range(100))
    near = [unit[:k] + "#" + unit[k + 1 :] for k in (3, 40, 77)]
    bare = own[:400] + unit + near[0] + unit + near[1] + near[2]
    text = "<p class='x'>" + bare[:250] + "</p><b>" + bare[250:] + "</b>"
    cut = M.cut_after_repeats(text)
    assert M.cut_after_repeats(bare) == bare[:400] and M.cut_after_repeats(own) == own and M.cut_after_repeats("") == ""
    assert M.cut_after_repeats(bare[:-200]) == bare[:-200]  # four alike only
    assert text.startswith(cut) and len(own[:250]) < len(cut) < len(text)
    for _ in range(300):  # the bound never refuses what the ratio accepts
        a = "".join(draw.choice("ab ") for _ in range(20))
        b = "".join(c if draw.random() < 0.85 else draw.choice("ab ") for c in a)
        assert M.alike(a, b, 0.8) == (M.ratcliff(a, b) >= 0.8)


def test_links_and_css_urls(spark):
    from quoin.functions import html as H

    page = '<a class="k" href="https://o.example/z">z</a><a href="/in">i</a><link href="https://o.example/s.css"><style>a{b:url( "x/y.PNG?v=1" )} c{d:url(font.woff)} e{f:url(\'data:image/png;base64,AA\')} g{h:url()}</style>'
    got = spark.createDataFrame([(page,)], "h string").select(H.neutral_links(F.col("h"))).first()[0]
    assert got == '<a class="k" href="#">z</a><a href="/in">i</a><link href="https://o.example/s.css"><style>a{b:url(placeholder.png)} c{d:url()} e{f:url(data:image/png;base64,AA)} g{h:url()}</style>'


def test_elements_repeated_too_often_are_cut():
    from quoin.operators import dom

    page = "<body>" + "<p>same</p>" * 60 + "<div><p>same</p><i>x</i></div>" + "<p>other</p>"
    root = dom.parse(page)
    dom.repeats(root, 1)
    assert root.html().count("<p>same</p>") == dom.MOST_REPEATS and root.html().endswith("<div><i>x</i></div><p>other</p></body>")
