"""Substring dedup against brute force, the exchange of keys, and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quarry.llm import _exchange as X
from quarry.llm import substring_dedup as S

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    parsed = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in parsed for i in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, parsed, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    r = random.Random(6)
    words = lambda n, size: [f"w{r.randrange(size)}" for _ in range(n)]
    passages = [words(n, 10**6) for n in (34, 35, 36, 55, 90)]
    rows = []
    for i in range(150):
        text = words(r.randrange(80), 10**6)
        for _ in range(r.randrange(3)):
            at = r.randrange(len(text) + 1)
            text[at:at] = r.choice(passages)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(text)))
    rows += [(200, "same " * 36), (200, "same " * 36), (None, "x " * 34), (None, "y " * 35), (1, None), (2, ""), (3, " \n"), (4, "long " * 30_000 + "é " * 50)]
    docs = spark.createDataFrame([(*x, 1, "s", 2) for x in rows], "doc_id long, text string, slice int, keys string, N_WORDS int").repartition(3)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in S.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == brute(rows)
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_keys_that_agree_in_64_bits_only():
    keys, more = np.array([5, 5, 9, 5, 7], np.uint64), np.array([1, 2, 3, 1, 4], np.uint32)
    asked = pa.concat_tables([X.ask(0, keys[:3], 4, more[:3]), X.ask(1, keys[3:], 4, more[3:])])
    answers = pa.concat_tables(X._answer(asked.filter(pa.array(asked["bucket"].to_numpy() == b))) for b in set(asked["bucket"].to_pylist()))
    got = {s: X.columns_of(answers.filter(pa.array(answers["slice"].to_numpy() == s))) for s in (0, 1)}
    assert all(list(zip(k, m, strict=True)) == [(5, 1)] for k, m, _ in got.values())
    own = answers.filter(pa.array(answers["slice"].to_numpy() == 0))
    assert X.repeated(keys[:3], more[:3], own).tolist() == [True, False, False]
    assert X.repeated(np.array([5, 5, 6], np.uint64), np.array([2, 2, 2], np.uint32), own).tolist() == [True, True, False]


def test_second_hashes_are_independent():
    a, b = (S.Slice(pa.table({"text": [t]})) for t in ("a b c a", "b a c b"))
    assert a.second[0] == a.second[3] == b.second[1] and len({*a.hashes.tolist(), *a.second.tolist()}) == 6


def test_rows_alike_are_dealt_by_block(spark, tmp_path):
    rows = spark.range(400).selectExpr("cast(null as long) AS doc_id", "repeat('one and the same ', 20) AS text")
    rows.repartition(20).write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    assert X.deal(docs, X.Plan.of(spark, 10**6, 10**5), "doc_id", "text").select("slice").distinct().count() > 10
    got = S.remove_repeats(docs)
    assert {(r["n_words"], r["n_removed"], r["text"]) for r in got.collect()} == {(80, 80, "")} and got.count() == 400
    # Texts are shuffled once for all three steps.
    assert got._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2


def test_plan_grows_within_bounds(spark):
    for size in (0, 10**9, 3 * 10**10, 10**12, 10**14):
        plan = X.Plan.of(spark, size, size // 24)
        assert plan.slices >= X.LEAST and plan.buckets >= X.LEAST
        assert size / plan.slices <= X.MOST_SLICE and size / 24 / plan.buckets <= X.MOST_BUCKET
        assert size / plan.slice_parts <= X.SLICES * X.MOST_SLICE and size / 24 / plan.bucket_parts <= X.MOST_BUCKET
    assert 10**12 / 24 / (X.Plan.of(spark, 10**12, 10**12 // 24).slices * X.Plan.of(spark, 10**12, 10**12 // 24).buckets) >= X.PACKET / 2
