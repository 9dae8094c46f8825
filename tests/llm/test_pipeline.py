"""The corpus pipeline, stage by stage against plain versions, and over odd tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_decontaminate import plain_leak, plain_words

import corpus_pipeline as P
from quarry.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(2 + r.randrange(6)))
    words = lambda n: [word() for _ in range(n)]
    items = [" ".join(words(20)) for _ in range(3)]
    shared = ["a line that many documents share", "and another one of that kind"]
    rows = []
    for k in range(60):
        body = words(30 + r.randrange(60))
        if k % 9 == 0:
            body[5:5] = r.choice(items).split()
        lines = [" ".join(body[j : j + 12]) for j in range(0, len(body), 12)]
        if k % 4 == 0:
            lines.insert(r.randrange(len(lines)), r.choice(shared))
        rows.append((k, "\n".join(lines)))
    for k in range(12):  # near copies, on one line, as equal lines go before
        text = rows[3 * k + 1][1].replace("\n", " ").split(" ")
        text[r.randrange(len(text))] = "changed"
        rows.append((200 + k, " ".join(text)))
    rows += [(300, "too short"), (301, "again and again " * 30), (302, None), (303, "")]
    return [(i, t, "en", r.choice(["a", "a", "a", "b", None]), len(t or "")) for i, t in rows], items


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, items = corpus(4)
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*enumerate(items), (9, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items, str(folder)


def plain_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = {}
    for i, t, *_ in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t, *rest in rows:
        kept = "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i)
        out.append((i, kept, *rest[:2], len(kept)))
    return out


def plain_groups(rows):
    sets = {}
    for i, t, *_ in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((up[a], up[b]))
                up = {k: x if v == y else v for k, v in up.items()}
    return [row for row in rows if up[row[0]] == row[0]]


def collected(frame):
    assert tuple(frame.columns) == P.COLUMNS
    return sorted(tuple(r) for r in frame.collect())


def test_stages_equal_plain_versions(spark, made):
    rows, items, folder = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = collected(P.quality_rules(spark, docs, folder))
    judged = {r["doc_id"]: r["kept"] for r in quality.verdicts(docs).collect()}
    assert first == sorted(r for r in rows if judged[r[0]]) and {r[0] for r in rows} - {r[0] for r in first} >= {300, 301, 302, 303} and len(first) > 60
    again = lambda found: spark.createDataFrame(found, SCHEMA).repartition(3)
    second = collected(P.dedup_lines(spark, again(first), folder))
    assert second == sorted(plain_lines(first)) and second != first
    third = collected(P.dedup_documents(spark, again(second), folder))
    assert third == sorted(plain_groups(second)) and len(third) < len(second)
    fourth = collected(P.drop_leaks(spark, again(third), folder))
    assert fourth == [r for r in third if not any(plain_leak(plain_words(x), plain_words(r[1])) for x in items)] and len(fourth) < len(third)
    mix = P.mix_sources(spark, again(fourth), folder).collect()
    size, of = {r[0]: len(WORD.findall(r[1])) for r in fourth}, {r[0]: r[3] for r in fourth}
    taken, whole = Counter(), Counter()
    for r in mix:
        taken[r["doc_id"]] += r["copy_words"]
        assert len(WORD.findall(r["text"])) == r["copy_words"] <= size[r["doc_id"]]
    assert all(taken[i] <= 3 * size[i] for i in size)
    for i in size:
        whole[of[i]] += size[i]
    target, left, weight = {}, sum(size.values()), dict(zip(sorted(whole, key=lambda s: (s is None, s or "")), (5, 2, 1), strict=False))
    while open_ := [s for s in weight if s not in target]:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 3 * whole[s]]
        for s in over or open_:
            target[s] = 3 * whole[s] if over else share * weight[s]
            left -= target[s] if over else 0
    assert all(abs(sum(n for i, n in taken.items() if of[i] == s) - target[s]) <= 1 for s in whole)


def test_run_goes_through_the_stages(spark, made):
    _, _, folder = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
    key = lambda frame: sorted(map(repr, frame.collect()))
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources"]
    assert key(P.run(spark, folder)) == key(docs) and docs.columns == [*P.COLUMNS, "copy", "copy_words"]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_odd_tables(spark, made, name):
    """Nulls in every column, empty, very long and repeated rows, clashing names, and no rows."""
    stage, folder = dict(P.STAGES)[name], made[2]
    good = " ".join(f"word{k}" for k in range(40))
    rows = [(None,) * 5, (1, None, "en", "a", None), (1, "", "en", "a", 0), (2, good, None, None, None), (2, good, None, None, None), (None, good + " more", "en", "a", 5), (3, "long words, all of them alike\n" * 30_000, "en", "a", 1), (4, " \n", "xx", "", 2)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(k).alias(c) for k, c in enumerate(["own0", "hash", "kept", "leaks", "size", "n_lines", "TEXT"])))
    found = stage(spark, docs, folder)
    wanted = list(P.COLUMNS) + (["copy", "copy_words"] if name == "mixing sources" else [])
    assert found.columns == wanted
    got = Counter((r["doc_id"], r["text"]) for r in found.collect())
    assert got[(2, good)] >= 2
    if name in ("line dedup", "MinHash near-dedup", "benchmark decontamination"):
        assert sum(got.values()) == len(rows)
    if name == "quality rules":
        assert set(got) == {(2, good), (None, good + " more")}
    none = stage(spark, docs.limit(0), folder)
    assert none.columns == wanted and none.count() == 0
