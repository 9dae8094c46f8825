"""Terms, index and searches without shuffles of texts or of pairs of queries and chunks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.tokens import tokens
from quarry.operators import index as ix
from quarry.operators import scoring, stats
from quarry.plans import corpus
from quarry.session import cut

FIELDS = ("file_path", "symbol_name", "signature", "doc", "content")
IDENTS = "HTTPServer2Go getURLs snake_case_words __x__ ЗаказыПользователей пользователями2 Ünïcode ΣΊΣΥΦΟΣ İstanbul a1b22C run running errors ошибка_User x ＡＢc ٣٤abc ǅungla _ 12ab_34".split()


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def chunks(spark, texts):
    rows = [(i, 1, 3, *(i if f != "content" else t for f in FIELDS)) for i, t in texts]
    return spark.createDataFrame(rows, "chunk_id string, start_line int, end_line int, " + ", ".join(f"{f} string" for f in FIELDS))


def test_tokens_equal_the_expression(spark):
    rows = spark.createDataFrame([(x,) for x in IDENTS], "x string").select("x", T.ident_tokens(F.col("x"))).collect()
    assert {r[0]: r[1] for r in rows} == {x: tokens(x) for x in IDENTS}


def plain(texts):
    found = {}
    for i, t in texts:
        for f in FIELDS:
            for word in (i if f != "content" else t or "").split():
                for term in tokens(word):
                    tf, points = found.get((i, term), (0, 0))
                    found[i, term] = tf + ix.FIELDS[f], max(points, ix.POINTS[f])
    return found


def test_rows_that_repeat_a_chunk(spark):
    texts = [("a", "one two"), ("a", "two Three"), ("b", "two"), ("c", ""), ("d", None), ("d", "")]
    built = ix.build(chunks(spark, texts), cut)
    assert {(r[0], r[1]): (r[2], r[3]) for r in built.postings.collect()} == plain(texts)
    assert built.entries.count() == 4 and built.corpus.first()["n_chunks"] == 6


def words(r, n):
    return " ".join(f"w{min(int(r.paretovariate(0.6)), 5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def searched(spark):
    r = random.Random(2)
    texts = [(f"c{k}", words(r, 40)) for k in range(300)] + [(f"copy{k}", "w1 w2 w3") for k in range(90)]
    asked = spark.createDataFrame([(k, words(r, 12)) for k in range(30)] + [(99, "w1 w2 w3")], "query_id int, query string")
    return texts, ix.build(cut(chunks(spark, texts)), cut), asked


@pytest.mark.parametrize("most", [0, 3, 10**6])
def test_vector_lengths(searched, most):
    texts, built, _ = searched
    weight = {r["term"]: r["idf"] for r in built.terms.collect()}
    wanted = {}
    for (i, term), (tf, _) in plain(texts).items():
        wanted[i] = wanted.get(i, 0) + (tf * weight[term]) ** 2
    got = {r["chunk_id"]: r["norm"] for r in ix.vector_lengths(built.entries, built.terms, most).collect()}
    assert got == pytest.approx({i: math.sqrt(v) for i, v in wanted.items()})


@pytest.mark.parametrize("block, products, held", [(scoring.BLOCK, scoring.PRODUCTS, scoring.HELD), (7, 100, 1)])
def test_searches_equal_plain_ones(spark, searched, monkeypatch, block, products, held):
    texts, built, asked = searched
    monkeypatch.setattr(scoring.blocks, "__defaults__", (block,))
    monkeypatch.setattr(scoring, "PRODUCTS", products)
    monkeypatch.setattr(scoring, "HELD", held)
    tf = {k: v[0] for k, v in plain(texts).items()}
    idf = {r["term"]: r["idf"] for r in built.terms.collect()}
    terms = {}
    for r in scoring.terms_of(asked).collect():
        terms.setdefault(r["query_id"], []).append(r["term"])
    length, norm = {}, {}
    for (i, t), n in tf.items():
        length[i] = length.get(i, 0) + n
        norm[i] = norm.get(i, 0) + (n * idf[t]) ** 2
    mean = sum(length.values()) / len(length)
    ways = {
        "fts": lambda q, i: sum(idf[t] * tf[i, t] * 2.5 / (tf[i, t] + 1.5 * (0.25 + 0.75 * length[i] / mean)) for t in terms[q] if (i, t) in tf),
        "vec": lambda q, i: sum(idf[t] ** 2 * tf[i, t] for t in terms[q] if (i, t) in tf) / math.sqrt(sum(idf.get(t, 0) ** 2 for t in terms[q]) * norm[i]),
    }
    for mode, score in ways.items():
        got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in scoring.search(built, asked, mode, 50).collect()}
        for q in terms:
            best = sorted(((-round(s, 9), i) for i in length if (s := score(q, i)) > 0))[:50]
            assert [got[q, k + 1][0] for k in range(len(best))] == [i for _, i in best] and (q, len(best) + 1) not in got
            assert [got[q, k + 1][1] for k in range(len(best))] == pytest.approx([-s for s, _ in best])


def test_nothing_large_is_shuffled(spark, searched):
    texts, built, asked = searched
    rows = chunks(spark, texts)
    assert "Exchange" not in plan_of(ix.counted(rows))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # What has a row for each query and chunk, or a text, is in no exchange.
        assert "Exchange" not in plan_of(scoring.bm25_scores(built, asked))
        assert "Join" not in plan_of(stats.grep_cost(asked, rows)).split("MapInArrow")[-1]
        found = plan_of(corpus.relevant(spark, "/root/testdata/sf0.001"))
        assert "SortMergeJoin" not in found and "ShuffledHashJoin" not in found
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_grep_of_many_queries(spark):
    r = random.Random(5)
    files = [(f"f{k}", "\n".join(words(r, 4).replace("w", "word") for _ in range(5))) for k in range(40)] + [("f0", None)]
    asked = [(k, " ".join(words(r, 2).replace("w", "word").split() + ["abc"])) for k in range(150)] + [(900, "zzzz"), (901, None)]
    got = stats.grep_cost(spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame([(f, t or "") for f, t in files], "file_path string, content string"), 60)
    wanted = {}
    for q, text in asked:
        terms = [w for w in (text or "").split() if len(w) > 3]
        read = [(f, t) for f, t in files if t and any(w in t for w in terms)]
        grep = sum(len(f"{f}:{i}: {x}\n") for f, t in read for i, x in enumerate(t.split("\n"), 1) if any(w in x for w in terms))
        wanted[q] = (grep + sum(len(t or "") for _, t in (read or files))) // 4
    assert {x["query_id"]: x["tokens"] for x in got.collect()} == wanted
