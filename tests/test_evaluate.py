"""Questions over a tree of code, from files to metrics, report and token costs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quarry.chunkers.registry import chunk_files
from quarry.operators import decide, evaluate, index, scoring, stats
from quarry.plans import fixtures
from quarry.session import cut
from quarry.sources import tree

QUESTIONS = [
    ("q01", "add a line into the basket", "en", "go", ["shop/basket.go"]),
    ("q02", "openCart", "en", "js", ["web/cart.js"]),
    ("q03", "the rate of a country", "en", "python", ["tax/rates.py"]),
    ("q04", "ставка страны rate_for", "ru", "python", ["tax/rates.py"]),
    ("q09", "something else entirely zzz", "ru", "go", ["nowhere.go"]),
]
SCHEMA = "id string, question string, question_lang string, language string, expected_files array<string>"


@pytest.fixture(scope="module")
def code(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    for name, text in fixtures.FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    files = cut(tree.source_files(spark, str(root)))
    return files, index.build(cut(chunk_files(files)), cut), spark.createDataFrame(QUESTIONS, SCHEMA)


def test_quality_from_files_to_report(code, tmp_path):
    files, built, questions = code
    results = evaluate.evaluate(built, questions, 5)
    assert [(r["label"], r["mode"]) for r in results] == list(evaluate.CONFIGS)
    queries = questions.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    for r in results:
        hits = scoring.search(built, queries, r["mode"], 5).join(built.chunks.select("chunk_id", "file_path"), "chunk_id").collect()
        ranks = {q[0]: min((h["rank"] for h in hits if h["query_id"] == q[0] and h["file_path"] in q[4]), default=None) for q in QUESTIONS}
        assert r["n"] == 5 and r["recall_1"] == pytest.approx(sum(x == 1 for x in ranks.values()) / 5) and r["mrr"] == pytest.approx(sum(1 / x for x in ranks.values() if x) / 5)
        assert r["language"]["python"] == pytest.approx(sum(bool(ranks[q] and ranks[q] <= 5) for q in ("q03", "q04")) / 2) and set(r["question_lang"]) == {"en", "ru"}
        assert r["recall_5"] >= 0.6
    missed = next(r["missed"] for r in results if r["mode"] == "hybrid+rerank")
    assert "q09" in [m["id"] for m in missed]
    evaluate.write_report(str(tmp_path / "deep" / "report.md"), results)
    text = (tmp_path / "deep" / "report.md").read_text()
    assert text.startswith("# Retrieval report\n\n| config | mode | Recall@1 |") and "| A | fts |" in text and "- **q09** something else" in text and "not among the hits" in text
    assert "None: every question" in evaluate.report([r | {"missed": []} for r in results])


def test_bench_questions(spark, code):
    questions = code[2]
    assert {r["id"] for r in evaluate.bench_questions(questions).collect()} == {"q01", "q03", "q04", "q09"}
    other = questions.withColumn("id", F.concat(F.lit("x"), "id"))
    assert {r["id"] for r in evaluate.bench_questions(other, first=3).collect()} == {"xq01", "xq02", "xq03"}


def safe_json(value):
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def test_token_bench_equals_plain_version(code):
    files, built, questions = code
    queries = questions.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    got = {r["query_id"]: r for r in evaluate.token_bench(built, queries, files, 5).collect()}
    chunks = {r["chunk_id"]: r for r in built.chunks.collect()}
    whole = {r["file_path"]: r["content"] for r in files.collect()}
    six = lambda x: f"{x:.6f}"

    def call(q, k):
        asked = queries.where(F.col("query_id") == q)
        raw = scoring.search(built, asked, "hybrid+blend", k).orderBy("rank").collect()
        top = raw[0]["score"] if raw else 0
        hits = [h for h in raw if h["rank"] == 1 or h["score"] > max(0.5, top - 0.05)]
        noul = 0.0
        if hits:
            rest = [h["score"] for h in hits[1:5]]
            noul = 1 / (1 + math.exp(-(1.6 * top + 1.2 * (top - (sum(rest) / len(rest) if rest else 0)) - 1.5)))
        shown = []
        for h in hits:
            c = chunks[h["chunk_id"]]
            parts = {"file": c["file_path"], "start_line": c["start_line"], "end_line": c["end_line"], "symbol": c["symbol_name"], "kind": c["kind"], "language": c["language"]}
            parts |= {n: c[n] for n in ("signature", "doc") if c[n]} | {"content": c["content"]}
            shown.append(safe_json(parts)[:-1] + f',"score":{six(h["score"])}}}')
        more = ',"more_available":true' if len(raw) == k or len(hits) < len(raw) else ""
        text = f'{{"query":{safe_json(dict((i, t) for i, t, *_ in QUESTIONS)[q])},"need_more":{"true" if noul < 0.5 else "false"},"noul":{six(noul)}{more},"results":' + (f"[{','.join(shown)}]" if shown else "null") + "}"
        return len(text.encode()) // 4, hits, noul < 0.5

    for q, text, *_ in QUESTIONS:
        rag, hits, need = call(q, 5)
        if need:
            more, again, _ = call(q, 10)
            rag += more
            hits = again or hits
            if hits:
                c = chunks[hits[0]["chunk_id"]]
                lines = whole[c["file_path"]].split("\n")
                a, b = max(1, c["start_line"] - 15), min(len(lines), c["end_line"] + 15)
                rag += len("\n".join(lines[a - 1 : b]).encode()) // 4
        terms = [w for w in __import__("re").findall(r"[^\W_]+", text.lower()) if len(w) > 3]
        read = [(f, t) for f, t in whole.items() if any(w in t.lower() for w in terms)]
        grep = sum(len(f"{f}:{i}: {x}\n".encode()) for f, t in read for i, x in enumerate(t.split("\n"), 1) if any(w in x.lower() for w in terms))
        base = (grep + sum(len(t.encode()) for _, t in (read or whole.items()))) // 4
        assert (got[q]["rag"], got[q]["need_more"], got[q]["baseline"]) == (rag, need, base), q
        assert got[q]["ratio"] == pytest.approx(base / rag)
    assert any(r["need_more"] for r in got.values())


def test_json_bytes(spark):
    texts = ['a"b\\c\n\t<>&é ', "", None, "\x01\x7f/"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(evaluate.json_bytes(F.col("x"))).collect()
    assert [r[0] for r in rows] == [len(safe_json(t or "").encode()) for t in texts]


def test_grep_without_matches_reads_all(spark):
    files = spark.createDataFrame([("a", "one two\nthree"), ("b", "xthreex THREE\nfour")], "file_path string, content string")
    queries = spark.createDataFrame([(1, "three"), (2, "zz zzzzz"), (3, "")], "query_id int, query string")
    got = {r["query_id"]: r["tokens"] for r in stats.grep_cost(queries, files).collect()}
    assert got == {1: (13 + 18 + len("a:2: three\n") + len("b:1: xthreex THREE\n")) // 4, 2: 31 // 4, 3: 31 // 4}


def test_counts_and_last_calls(spark):
    rows = spark.createDataFrame([("go",)] * 10 + [("py",)] * 5 + [("",)], "language string")
    as_dict = lambda n: {r["name"]: r["count"] for r in stats.top_counts(rows, "language", n).collect()}
    assert as_dict(8) == {"go": 10, "py": 5, "other": 1} and as_dict(1) == {"go": 10, stats.REST: 6} and stats.top_counts(rows.limit(0), "language", 3).count() == 0
    calls = spark.createDataFrame([(k, k // 2) for k in range(12)], "event_id int, ts int")
    ids = lambda **m: [r["event_id"] for r in evaluate.last_calls(calls, 4, **m).orderBy("place").collect()]
    assert ids() == [11, 10, 9, 8] and ids(newest_first=False) == [8, 9, 10, 11]


def test_gate_of_no_hits(spark):
    hits = spark.createDataFrame([], "query_id int, rank int, score double, chunk_id string")
    assert decide.noul(hits).count() == 0
