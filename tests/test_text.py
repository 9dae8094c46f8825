"""Tokens, stems, synonyms and spans against known vectors."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import decide, tools


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "ident, tokens",
    [
        ("ValidateToken", ["validatetoken", "validate", "validat", "token"]),
        ("apply_vat", ["apply_vat", "apply", "app", "vat"]),
        ("order_orders", ["order_orders", "order_order", "order", "ord", "orders", "order"]),
        ("HTMLParser", ["htmlparser", "htmlpars", "html", "parser", "pars"]),
        ("orders", ["orders", "order"]),
    ],
)
def test_tokens(spark, ident, tokens):
    assert one(spark, T.ident_tokens(F.col("x")), x=ident) == tokens
    assert one(spark, T.folded_tokens(F.col("x")), x=ident) == tokens


@pytest.mark.parametrize("word, stem", [("проверяется", "проверя"), ("карточке", "карточк"), ("заказа", "заказ"), ("vat", "vat"), ("для", "для"), ("workers", "worker"), ("services", "servic"), ("order", "ord")])
def test_stems(spark, word, stem):
    assert one(spark, T.stem(F.col("x")), x=word) == one(spark, T.short_stem(F.col("x")), x=word) == stem


def test_expansion(spark):
    assert one(spark, T.expand(F.array(F.lit("заказ"), F.lit("x"), F.lit("order")))) == ["заказ", "order", "x"]


@pytest.mark.parametrize("scores, kept", [([0.65, 0.59, 0.56, 0.56, 0.55], 1), ([0.66, 0.63, 0.62, 0.56, 0.54], 3), ([0.55, 0.49, 0.49], 1), ([0.62, 0.60, 0.59, 0.58], 4), ([0.3], 1), ([0.51, 0.50, 0.50, 0.49], 1), ([0.2, 0.1, 0.1], 1)])
def test_cut_off(spark, scores, kept):
    hits = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(scores)], "query_id int, rank int, score double")
    assert decide.filter_relevant(hits).count() == kept


@pytest.mark.parametrize("scores, value", [([0.65], 0.579324), ([0.66, 0.63, 0.62], 0.400832), ([2 / 61], 0.196519)])
def test_noul(spark, scores, value):
    hits = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(scores)], "query_id int, rank int, score double")
    row = decide.noul(hits).first()
    assert abs(row["noul"] - value) < 1e-6 and row["need_more"] == (value < 0.5)


def test_read_span_and_references(spark):
    files = spark.createDataFrame([("a.py", "python", "one\ntoken = 'token'  # token\nx_token\n")], "file_path string, language string, content string")
    assert tools.read_span(files, F.lit(-5), F.lit(2)).first()["span"] == "one\ntoken = 'token'  # token"
    assert [r["line"] for r in tools.all_references(files, "token").collect()] == [2]


def test_estimates_and_passages(spark):
    rows = spark.createDataFrame([("éé", "f", "", None, "body")], "x string, symbol_name string, signature string, doc string, content string")
    got = rows.select(T.token_estimate(F.octet_length("x") + 3), T.passage_text("symbol_name", "signature", "doc", "content"), T.grep_terms(F.col("x"))).first()
    assert tuple(got) == (1, "f\nbody\n", [])
    assert one(spark, T.grep_terms(F.lit("Where is the Orders_Table orders?"))) == ["where", "orders", "table", "orders"]


@pytest.mark.parametrize("line, language, bare", [("x = 'a # b' # c", "python", "x =  "), ('go("//x") // y', "go", "go() "), ("a `b` 'it\\'s' c", "go", "a   c"), ("# not cut", "go", "# not cut")])
def test_strip_code(spark, line, language, bare):
    assert one(spark, T.strip_code(F.lit(line), F.lit(language))) == bare


def test_first_references_only(spark):
    files = spark.createDataFrame([("b.py", "python", "name\n" * 30), ("a.py", "python", "name\n" * 21)], "file_path string, language string, content string")
    got = tools.find_references(files, "name").orderBy("file_path", "line").collect()
    assert len(got) == 50 and got[0]["file_path"] == "a.py" and got[-1]["line"] == 29 and all(r["truncated"] for r in got)
    assert not any(r["truncated"] for r in tools.find_references(files, "name", 51).collect()) and tools.find_references(files, "none").count() == 0


def test_resolve_many_names(spark):
    projects = spark.createDataFrame([("Api", "/srv/api", 0), ("api", "/srv/two", 1), ("web", "/srv/web/", 2)], "name string, path string, pos int")
    asked = spark.createDataFrame([("api",), ("API",), (" web",), ("/srv/web",), ("",), ("nobody",)], "asked string")
    got = {r["asked"]: r["path"] for r in tools.resolve_projects(projects, asked, "web").collect()}
    assert got == {"api": "/srv/two", "API": "/srv/api", " web": "/srv/web/", "/srv/web": "/srv/web/", "": "/srv/web/"}
    assert {r["asked"]: r["path"] for r in tools.resolve_projects(projects, asked, "ghost").collect()}[""] == "/srv/api"
