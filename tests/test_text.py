"""Cleaning, tokens, n-grams; checked against stdlib stand-ins."""

import html
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from skillsift.functions.text import clean_html, ngrams, phrase_tokens, tokens

from .conftest import SF0001


class _Text(HTMLParser):
    """Stdlib stand-in for a parser's get_text(): text nodes only, no script/style/template."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template"):
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template") and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def py_clean(doc: str) -> str:
    p = _Text()
    p.feed(doc)
    p.close()
    t = "".join(p.out).replace("&", "and")
    t = re.sub(r"[^a-zA-Z0-9\s]", "", t)
    return t.replace("\n\n", " ").replace("\n", " ").replace("  ", " ").lower()


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_clean_html_edge_cases(spark):
    cases = {
        "<p>caf&amp;eacute;</p>": "cafandeacute",
        "<div><p>a <b>b</b></p></div>": "a b",
        "<!-- a > b -->x": "x",
        '<script>var t="</p>";</script>ok': "ok",
        "a   b": "a  b",
        "a\n\n\nb": "a b",
        "a b": "a b",
        "Déjà vu": "dj vu",
        "R & D": "r and d",
        "a&nbsp;b": "a b",
        "<style>p{}</style><template>t</template>v": "v",
    }
    for src, want in cases.items():
        assert one(spark, clean_html, src) == want, src
        assert py_clean(src) == want, src


def test_clean_html_character_references(spark):
    """Literal expectations, each also what the stdlib parser gives."""
    cases = {
        "x&#65;y": "xay", "&#65;&#49;": "a1", "a&#160;b": "a\u00a0b", "a&ensp;b": "a\u2002b", "a&#38;b": "aandb",
        "&AMP;": "and", "R&#x26;D": "randd", "a&#x20;b": "a b", "a&Tab;b": "a\tb", "a&NewLine;b": "a b",
        "&amp;lt;": "andlt", "&amp;#65;": "and65", "a&#8195;b": "a\u2003b", "a&#150;b": "ab", "a&#133;b": "ab",
        "a&#3;b": "ab", "a&#233;b": "ab", "&#65b": "ab", "&#X41;&#x61;": "aa", "a & b": "a and b", "&": "and", "&;": "and",
        "a&#128512;b": "ab", "x&copy;y&hellip;z": "xyz", "&#0;x": "x", "&#9999999;x": "x", "a&emsp13;b&VeryThinSpace;c":
        "a\u2004b\u200ac", "&#xZ;": "andxz",
    }
    for src, want in cases.items():
        assert one(spark, clean_html, src) == want, src
        assert py_clean(src) == want, src


def test_clean_html_matches_stdlib_on_pages(spark):
    pages = spark.read.parquet(f"{SF0001}/pages.parquet")
    got = {r["page_id"]: r["d"] for r in pages.select("page_id", clean_html("html").alias("d")).collect()}
    for r in pages.select("page_id", "html").collect():
        assert got[r["page_id"]] == py_clean(r["html"]), r["page_id"]


def test_tokens_match_python_word_regex(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    got = {r["doc_id"]: r["t"] for r in docs.select("doc_id", tokens("text").alias("t")).collect()}
    pat = re.compile(r"(?u)\b\w\w+\b")
    for r in docs.select("doc_id", "text").collect():
        assert got[r["doc_id"]] == pat.findall(r["text"].lower()), r["doc_id"]


def test_tokens_edge_cases(spark):
    assert one(spark, tokens, "a bb c_d é x9 Ünïcode") == ["bb", "c_d", "x9", "ünïcode"]
    assert one(spark, tokens, "") == []
    assert one(spark, tokens, None) is None


def test_phrase_tokens_edge_cases(spark):
    assert one(spark, phrase_tokens, "C, R and c++/C# too; node.js 3.5+") == \
        ["c", "r", "and", "c++", "c#", "too", "node", "js", "3", "5+"]
    assert one(spark, phrase_tokens, "+ # é_1#") == ["é_1#"]
    assert one(spark, phrase_tokens, "") == [] and one(spark, phrase_tokens, None) is None


def test_ngrams(spark):
    df = spark.createDataFrame([("aa bb, cc dd",), ("aa",), ("",)], "x string")
    out = [r["g"] for r in df.select(ngrams(tokens("x"), 2).alias("g")).collect()]
    assert out == [["aa bb", "bb cc", "cc dd"], [], []]
    out3 = [r["g"] for r in df.select(ngrams(tokens("x"), 3).alias("g")).collect()]
    assert out3 == [["aa bb cc", "bb cc dd"], [], []]


def test_html_unescape_sanity():
    assert html.unescape("&amp;") == "&"


def test_clean_html_random_fragments_match_stdlib(spark):
    """400 fragments from a small HTML grammar (the supported subset: no '<' + letter in text,
    no unknown named entities) agree with the stdlib stand-in."""
    import random

    rnd = random.Random(7)
    pieces = ["ab", "Z9", " ", "  ", "   ", "\n", "\n\n", "\t", "é", "ü", ".", ",", "!", "&amp;", "&nbsp;",
              "&copy;", "&quot;", "& ", "<p>", "</p>", '<div class="x">', "</div>", "<br/>", "<b>", "</b>",
              "<!-- c > d -->", '<script>var t="</p>";</script>', "<style>p{}</style>", " ", "R&D "]
    frags = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(frags)), "i int, h string")
    got = {r["i"]: r["c"] for r in df.select("i", clean_html("h").alias("c")).collect()}
    for i, h in enumerate(frags):
        assert got[i] == py_clean(h), repr(h)
