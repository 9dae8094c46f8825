"""Near-dedup against all pairs, with hot keys, and odd rows."""

import os
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quarry.llm import near_dedup as N

WORD = re.compile("[^\x20\x09-\x0d]+")
SMALL = "/root/testdata/sf0.001"


def shingles(text, n):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def all_pairs(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def family(r, n_docs, n_words, edits):
    """Documents around one text: some link, some don't, all share much."""
    base = [f"w{r.randrange(10**6)}" for _ in range(n_words)]
    out = []
    for _ in range(n_docs):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def found(docs, n, percent):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, n, percent).collect()}


@pytest.mark.parametrize("shingle, percent", [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, shingle, percent):
    r = random.Random(shingle)
    texts = [t for k in range(6) for t in family(r, 40, 60 + 40 * k, 14)] + ["", None, " \n", "one", "ONE", "one two", "long " * 30_000]
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), shingle, percent) == all_pairs(rows, shingle, percent)


def test_hot_keys(spark, monkeypatch):
    """A template that hundreds of unlike documents share, in keys cut by a second band and into many blocks."""
    r = random.Random(9)
    rows = list(enumerate(family(r, 220, 120, 30)))
    wanted = all_pairs(rows, 3, 85)
    assert len({c for _, c in wanted.values()}) > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block, pairs in ((8, N.HOT_PAIRS), (8, 50), (128, 50)):
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N._left_over, "__defaults__", (pairs,))
        assert found(docs, 3, 85) == wanted


def test_hot_keys_that_share_one_band(spark, monkeypatch):
    """With a single band no class of a hot key has a second one, and the key is finished all the same."""
    r = random.Random(4)
    rows = list(enumerate(family(r, 60, 120, 12)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(N, "BANDS", 1)
    whole = found(docs, 3, 85)
    keys = {x["doc_id"]: x["bands"][0] for x in N.sketch(docs, 3).collect()}
    sets = {i: shingles(t, 3) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if keys[a] == keys[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    wanted = {i: i for i in sets}
    for _ in rows:
        for a, b in links:
            wanted[a] = wanted[b] = min(wanted[a], wanted[b])
    assert whole == {i: (len(s), wanted[i]) for i, s in sets.items()}
    monkeypatch.setattr(N._left_over, "__defaults__", (1,))
    assert found(docs, 3, 85) == whole


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert found(docs, 3, 85) == all_pairs([tuple(r) for r in docs.collect()], 3, 85)
    got = N.op5_near_dedup(spark, SMALL)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0


def test_recall_of_bands(spark):
    """Pairs at the threshold meet in two bands all but always."""
    miss = sum((0.85**5) ** b * (1 - 0.85**5) ** (N.BANDS - b) * (1 if b == 0 else N.BANDS) for b in (0, 1))
    assert miss < 6e-6


def test_odd_rows(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    schema = "doc_id long, text string, _id string, kept_id string, own0 string, KEPT string, label string"
    rows = [(3, a, "p", "q", "r", "s", "t"), (1, a, "p", "q", "r", "s", "t"), (1, a, "p", "q", "r", "s", "t"), (None, a, None, None, None, None, None), (None, b, "p", "q", "r", "s", "t"), (5, None, "p", "q", "r", "s", "t"), (6, "", "p", "q", "r", "s", "t"), (7, None, "p", "q", "r", "s", "t")]
    docs = spark.createDataFrame(rows, schema)
    kept = N.dedup_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, spark.createDataFrame([rows[k] for k in (1, 2, 4, 5, 6, 7)], schema).collect()))
    assert N.dedup_documents(docs.limit(0)).count() == 0
