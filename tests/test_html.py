"""Blocks and articles of HTML against a walk over the elements with the standard library's parser."""

import re
from html.parser import HTMLParser

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewise.operators import html as pages

CHAPTERS, HEADINGS = set(pages.CHAPTER_CLASSES), set(pages.HEADING_CLASSES)


def tidy(text):
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


class Walk(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.all, self.stack, self.silent = [], [], False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.silent = tag in ("script", "style")
        if tag in ("p", "table"):
            if self.stack and self.stack[-1]["name"] == "p":
                self.stack.pop()
            self.all.append({"name": tag, "classes": (dict(attrs).get("class") or "").split(), "pieces": []})
            self.stack.append(self.all[-1])

    def handle_endtag(self, tag):
        self.silent = False
        if tag in ("p", "table") and tag in [b["name"] for b in self.stack]:
            while self.stack.pop()["name"] != tag:
                pass

    def handle_data(self, data):
        for b in self.stack:
            if data.strip() and not self.silent:
                b["pieces"].append(data.strip())


def walked_blocks(page):
    return [(b["name"], b["classes"], tidy(" ".join(b["pieces"]))) for b in Walk(page).all]


def walked_articles(page):
    made, chapters, chapter = [], [], ""
    for name, classes, text in walked_blocks(page):
        if CHAPTERS & set(classes):
            chapters += [text] if text else []
        elif HEADINGS & set(classes):
            chapter, chapters = " — ".join(chapters) or chapter, []
            number = re.match(r"Article\s+(\d+\w*)", text, re.IGNORECASE)
            made.append([number[1] if number else text, "", chapter, []])
        elif made and text:
            if len(text) < 200 and not made[-1][1] and not made[-1][3]:
                made[-1][1] = text
            elif name == "p":
                made[-1][3].append(text)
    return [(n, t, c, tidy("\n".join(b))) for n, t, c, b in made if b]


def read(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "page int, html string")
    found, arts = [[] for _ in texts], [[] for _ in texts]
    for r in pages.blocks(table, "page", "html").orderBy("page", "block").collect():
        found[r.page].append((r.name, [c for c in r.classes if c], r.text))
    for r in pages.articles(table, "page", "html").orderBy("page", "seq").collect():
        assert r.seq == len(arts[r.page])
        arts[r.page].append((r.article_number, r.article_title, r.chapter, r.text))
    return found, arts


PARTS = [
    "<p>", "<P>", "</p>", "<p/>", "<table>", "</table>", "<tr><td>", "<table class='x oj-ti-art'>", '<p class="oj-ti-art">Article 3a</p>', '<p class="x ti-art">ARTICLE  12', '<p class=ti-art>Annex',
    '<p class="oj-ti-section-1">CHAPTER I</p>', "<p id=q class='ti-section-2'>Part</p>", "<p title='a > b' class=\"oj-ti-section-2\">", "a b", " \t x", "\n\n\n\ny", "<b>c</b>", "<br>", "&amp;", "&eacute;t&eacute;", "&#233;", "&#x1F600;", "&#150;", "&#0;", "&nosuch;", " &copy ",
    "&", "<!-- <p>no</p> -->", "<script>var t='</p><p>';</script>", "<style>p{}</style>", "long words " * 25, " ", "1 < 2", "é",
]


def test_fixed_pages(spark):
    texts = [
        '<div><p class="oj-ti-section-1">CHAPTER I</p><p class="oj-ti-section-2">General</p><p class="oj-ti-art">Article 1</p><p>Scope</p><p>First &amp; <b>bold</b> text.</p>'
        '<table><tr><td><p>(a)</p></td><td><p>cell</p></td></tr></table><p class="ti-art">Article 2</p><p>Terms</p><p>Second.</p></div>',
        "", None, "no markup", "<p>", "<table><tr><td>short</td></tr></table>",
        '<p class="ti-art">Article 1</p><table><tr><td>Title</td><td><p>in a cell</p><table><tr><td><p>deep</p></td></tr></table></td></tr></table></table></table><p>after',
        '<p class="ti-art">Article 1</p>' + "<p>" + "w " * 150 + "</p><p>short</p>", '<p class="ti-art"></p><p>t</p><p>x</p>',
        "<p " + "a='b' " * 2000 + ">many</p><p>" + "\"'" * 20000 + "</p>", "<p>" + "word & " * 50000,
    ]
    found, arts = read(spark, texts)
    assert arts[0] == [("1", "Scope", "CHAPTER I — General", "First & bold text.\n(a)\ncell"), ("2", "Terms", "CHAPTER I — General", "Second.")]
    for text, b, a in zip(texts, found, arts, strict=True):
        assert b == walked_blocks(text or "") and a == walked_articles(text or ""), (text or "")[:300]


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30), min_size=150, max_size=200))
def test_random_pages(spark, made):
    texts = ["".join(parts) for parts in made]
    found, arts = read(spark, texts)
    for text, b, a in zip(texts, found, arts, strict=True):
        assert b == walked_blocks(text), text
        assert a == walked_articles(text), text


def test_one_shuffle_and_constant_entities(spark, tmp_path):
    spark.createDataFrame([(1, "<p>x &amp; y</p>")], "page int, html string").write.parquet(str(tmp_path / "t"))
    plan = pages.articles(spark.read.parquet(str(tmp_path / "t")), "page", "html")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text
    assert "from_json" not in plan.optimizedPlan().toString()


def test_clashing_and_null_columns(spark):
    table = spark.createDataFrame([(None, "<p class='ti-art'>Article 1<p>t<p>x", "own"), (3, None, None)], "page int, html string, text string")
    assert [tuple(r) for r in pages.articles(table, "page", "html").collect()] == [(None, 0, "1", "t", "", "x")]
    assert pages.blocks(table.where(F.lit(False)), "page", "html").isEmpty()
