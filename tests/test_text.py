import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from encaje import lexicon
from encaje.functions import present
from encaje.functions import text as T
from encaje.functions import vectors as V



def t():
    return F.col("t")


def reference_clean(s):
    """The cleaning steps with Python's own Unicode patterns."""
    s = s.lower()
    for pattern in (lexicon.EMAIL, lexicon.URL, lexicon.PHONE, r"\s+"):
        s = re.sub(pattern, " ", s)
    return re.sub(r"[^\w\s.,;:¿?¡!@#$%&*()-]", "", s).strip()


@pytest.mark.parametrize("raw, wanted", [
    ("C++, C#, CI/CD y .NET | node.js 2015-2019, 12000 EUR, 5 años",
     "c, c#, cicd y .net  node.js , eur, 5 años"),
    ("desde 2019 x", "desde 2019 x"),
    ("a@b.c  http://x.y www.z fin", "fin"),
    ("@solo y tarde@ y @@b", "@solo y tarde@ y"),
    ("", ""),
])
def test_clean(value, raw, wanted):
    assert value(T.clean(t()), t=raw) == wanted


def test_phone_takes_short_numbers(value):
    assert re.findall(r"\d", value(T.clean(t()), t="desde 2019 5 años")) == []


def test_clean_equals_python_on_random_text(spark):
    random.seed(7)
    alphabet = "abcÁñ ü@@  .\t\n  -+()0123456789/|€http www"
    rows = [("".join(random.choice(alphabet) for _ in range(random.randint(0, 80))),)
            for _ in range(400)]
    df = spark.createDataFrame(rows, "t string").select("t", T.clean(t()).alias("c"))
    assert [r["c"] for r in df.collect()] == [reference_clean(r[0]) for r in rows]


def test_words_and_ngrams(value):
    assert value(T.words(t()), t="c++ y SQL, r 5 años") == ["sql", "años"]
    assert value(T.ngrams(T.words(t())), t="uno dos tres") == [
        "uno", "dos", "tres", "uno dos", "dos tres"]
    assert value(T.ngrams(T.words(t()), 3), t="uno dos tres")[-1] == "uno dos tres"
    assert value(T.ngrams(T.words(t())), t="uno") == ["uno"]
    assert value(T.ngrams(T.words(t())), t="") == []


def test_term_counts_against_counter(spark):
    random.seed(3)
    texts = [" ".join(random.choice(["ab", "cd", "é1", "zz"]) for _ in range(random.randint(0, 30)))
             for _ in range(50)]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(
        V.term_counts(T.words(t())).alias("c"))
    for text, row in zip(texts, df.collect()):
        assert [(e["term"], e["n"]) for e in row["c"]] == sorted(Counter(text.split()).items())


def test_dot_and_cosine(spark):
    df = spark.createDataFrame([("sql java", "java spark"), ("aa aa bb", "aa bb bb cc"), ("", "aa")],
                               "a string, b string")
    a, b = (V.term_counts(T.words(F.col(c))) for c in "ab")
    both = df.select(a.alias("a"), b.alias("b")).select(
        V.dot(F.col("a"), F.col("b")).alias("d"), V.square_norm(F.col("a")).alias("x"),
        V.square_norm(F.col("b")).alias("y"))
    rows = both.select("d", V.cosine(F.col("d"), F.col("x"), F.col("y")).alias("c")).collect()
    assert [r["d"] for r in rows] == [1, 4, 0]
    assert rows[0]["c"] == 0.5 and rows[2]["c"] == 0.0


def test_find_all_uses_unicode_words(value):
    assert value(T.find_all(t(), [r"técnico\s+\w+"]), t="técnico áéí ñandú") == ["técnico áéí"]
    assert value(T.find_all(t(), [lexicon.TOKEN]), t="programación c# node.js .net sql. inglés c"
                 ) == ["c", "node.js", "net", "sql", "c"]


@pytest.mark.parametrize("name", list(lexicon.CV_SECTIONS))
def test_sections_equal_python(spark, name):
    heads, stops = lexicon.CV_SECTIONS[name]
    words = ["información personal", "formación", "EXPERIENCIA", "habilidades", "idiomas",
             "certificaciones", "proyectos", "perfil", "estudios", "xx", "Ñandú\n", "conocimientos"]
    random.seed(len(name))
    texts = [" ".join(random.choice(words) for _ in range(random.randint(0, 12)))
             for _ in range(100)]
    pattern = re.compile(f"(?:{'|'.join(heads)}).*?(?={'|'.join(stops)}|$)", re.S | re.I)
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(
        T.section(t(), heads, stops).alias("s"))
    for text, row in zip(texts, df.collect()):
        found = pattern.search(text)
        assert row["s"] == (found.group(0).strip() if found else "")


def test_section_word_boundary_option(value):
    heads, stops = lexicon.CV_SECTIONS["education"]
    text = "información personal ana experiencia x educación grado"
    assert value(T.section(t(), heads, stops), t=text) == "formación personal ana"
    assert value(T.section(t(), heads, stops, word_boundary=True), t=text) == "educación grado"


def test_presentation(value):
    shown = [value(present.score_text(F.col("s")), s=x) for x in (0.125, 59.995, 1.005, 100.0)]
    assert shown == ["0.13%", "60.00%", "1.00%", "100.00%"]
    bands = [value(present.match_band(F.col("s")), s=x) for x in (79.994, 79.996, 59.994, 59.996)]
    assert bands == ["medium", "high", "low", "medium"]
    assert value(present.match_advice(F.col("s")), s=85.0) == "suitable"
    assert value(present.match_advice(F.col("s")), s=70.0) == "not_suitable"


def test_sections_of_lower_case_text_equal_those_of_the_general_pattern(spark):
    from pyspark.sql import functions as F

    from encaje.functions import text as T

    headers, stops = ["formación", "perfil", "formación académica", "per"], ["idiomas", "idea", "experiencia"]
    texts = ["", None, "formación académica x\ny idiomas z", "Formación a IDIOMAS b", "xper id idea perfil",
             "formación a ıdıomas b", "perfil ideas", "de perfil i e id\n\nexperienci experiencia", "sin nada",
             "perfil " + "idi e " * 30000 + "idiomas no"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    general = f"(?isu)(?:{'|'.join(headers)}).*?(?=(?:{'|'.join(stops)})|\\z)"
    rows = df.select(T.section(F.col("t"), headers, stops).alias("now"),
                     T.strip(F.regexp_extract("t", general, 0)).alias("general"),
                     F.regexp_extract("t", T._plain_section(headers, stops), 0).alias("plain"), "t").collect()
    assert all(r["now"] == r["general"] for r in rows)
    assert all(r["plain"].strip() == r["general"] for r in rows
               if r["t"] and r["t"] == r["t"].lower() and "ı" not in r["t"])


def test_strip_takes_every_kind_of_space(spark):
    rows = [(n, chr(n)) for n in range(1, 0x10000) if not 0xD800 <= n <= 0xDFFF]
    df = spark.createDataFrame(rows, "n int, c string").where(
        F.regexp_replace("c", T.SPACE, "") != T.strip(F.col("c")))
    assert df.count() == 0


def test_find_all_ignores_case_and_spares_it_for_lower_texts(spark):
    patterns = [*lexicon.CV_KEYWORDS["experience"], lexicon.TOKEN]
    texts = ["analista senior, 5 años", "ANALISTA Senior 5 AÑOS", "analıſta analiſta ı", "analista K k", ""]
    found = T.find_all(t(), patterns)
    assert "CASE WHEN" in str(found) and "(?iu)" in str(found)
    plain = F.concat(*[F.regexp_extract_all(t(), F.lit(T.ignoring_case(p)), F.lit(0)) for p in patterns])
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(found.alias("a"), plain.alias("b"))
    assert all(r["a"] == r["b"] for r in rows.collect())
