from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from encaje import lexicon
from encaje.functions import html as H
from encaje.operators import records as R



def t():
    return F.col("t")


class Reader(HTMLParser):
    """All texts outside script and style, stripped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.out.append(data.strip())


def element(value, html, name):
    return value(H.element_texts(H.html_tokens(t()), [lexicon.JOB_ELEMENTS[name]]), t=html)[0]


def test_page_text_equals_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html")
    for row in pages.withColumn("text", H.text_of(H.html_tokens(F.col("html")))).collect():
        reader = Reader()
        reader.feed(row["html"])
        reader.close()
        assert row["text"] == " ".join(reader.out)


@pytest.mark.parametrize("html, wanted", [
    ("<p>a &amp; b &lt;i&gt; &eacute;&#233;&#xE9; &#150; &nada; &amp</p>",
     "a & b <i> ééé – &nada &"),
    ("a<!-- <p>no</p> -->b<script>var x='</p>'</script>c<STYLE>p{}</STYLE>", "a b c"),
    ("<p>3 < 4 y 5<6</p>", "3 < 4 y 5<6"),
    ("<p title='a > b'>x</p>", "x"),
    ("", ""),
    ("&#0;&#55296;&#99999999;", "���"),
])
def test_page_text(value, html, wanted):
    assert value(H.text_of(H.html_tokens(t())), t=html) == wanted


def test_elements(value):
    assert element(value, '<h2 class="job-title">Desarrollador <b>Python</b></h2>', "title"
                   ) == "DesarrolladorPython"
    nested = '<div><div class="a description"><div>uno</div> dos<br>tres</div>no</div>'
    assert element(value, nested, "description") == "uno dos tres"
    assert element(value, '<div class="x">a</div>', "description") is None
    assert element(value, '<div class="details"></div>descripción del puesto x', "description") == ""
    assert element(value, '<div class="details"/>fuera', "description") == ""
    # Left open inside its parent: the parent's end tag closes it.
    assert element(value, '<section><div class="details">uno<p>dos</section>tres</div>',
                   "description") == "uno dos"
    # Never closed: runs to the end; a stray end tag of a tag that is not open is ignored.
    assert element(value, '<div class="details">uno</span>dos', "description") == "uno dos"
    assert element(value, "<P CLASS='Empresa'>Ñ</P>", "company") == "Ñ"
    assert element(value, "<span class=ciudad>Lima</span>", "location") == "Lima"


def cv(spark, text):
    row = R.cv_records(spark.createDataFrame([("1", text)], "cv_id string, raw_text string"))
    return row.first()


def job(spark, html):
    return R.job_records(spark.createDataFrame([("1", html)], "job_id string, html string")).first()


def test_cv_record(spark):
    row = cv(spark, "PERFIL ana HABILIDADES python sql IDIOMAS Inglés avanzado")
    assert row["sections"]["personal_info"] == "perfil ana"
    assert row["sections"]["skills"] == "habilidades python sql"
    assert row["keywords"]["skills"] == ["habilidades", "python", "sql"]
    assert row["keywords"]["languages"] == ["inglés avanzado"]
    assert row["keywords"]["education"] is None
    words = "habilidades python sql inglés avanzado"
    assert row["text"] == " ".join(
        ["habilidades python sql"] * 2 + ["idiomas inglés avanzado", "perfil ana"] + [words] * 2)


def test_cv_without_sections_and_empty(spark):
    row = cv(spark, "solo texto")
    assert row["sections"]["other"] == "solo texto" and row["text"] == "solo texto"
    for text in ("", None):
        row = cv(spark, text)
        assert row["text"] == "" and row["success"]


def test_job_by_text(spark):
    row = job(spark, "<p>Puesto: Analista. Empresa: Beta. Ciudad: Sevilla. Requisitos dominio de "
                     "sql y react. Experiencia 3 years. Responsabilidades informes</p>")
    f = row["fields"]
    assert (f["title"], f["company"], f["location"]) == ("analista", "beta", "sevilla")
    assert f["requirements"] == "requisitos dominio de sql y react. experiencia 3 years."
    assert f["skills"] == "sql y react"
    assert f["experience"] == "experiencia 3 years"
    assert row["keywords"]["skills"] == ["react", "sql", "y"]
    assert row["keywords"]["experience"] == ["3 year"]
    assert row["text"].startswith("analista analista analista requisitos")


@pytest.mark.parametrize("text, wanted", [
    ("formación requerida grado", []), ("grado superior", None),
    ("degree in bachelor science", ["degree in bachelor"]),
])
def test_education_keywords(spark, text, wanted):
    assert job(spark, f"<p>{text}</p>")["keywords"]["education"] == wanted


def test_job_patterns_stay_on_one_line(spark):
    assert job(spark, "<p>experiencia\nde 3 años</p>")["fields"]["experience"] == ""


def test_empty_job(spark):
    row = job(spark, None)
    assert row["text"] == "" and row["keywords"]["skills"] == [] and row["success"]


def test_pages_with_very_many_quotes(value):
    stray = "<p>si (a<b " + '"k":"v", ' * 100_000 + "</p>"
    attributes = "<p " + 'a="1" ' * 100_000 + ">hola &apos;b&apos;</p>"
    for page in (stray, attributes):
        assert value(F.size(H.html_tokens(F.col("h"))), h=page) >= 1
    assert value(H.unescape(F.col("h")), h="&apos;a&apos; &hellip;") == "'a' …"
    open_quote = '<p><a title="x>hola</a> mundo</p>'
    tokens = value(H.html_tokens(F.col("h")), h=open_quote)
    assert " ".join(t["text"] for t in tokens if t["text"]) == "hola mundo"
