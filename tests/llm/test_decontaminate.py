"""Decontamination against a plain version of its rule, in one pass and in many, and with seeds that many items share."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontaminate as D


def plain_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_leak(item, doc):
    """The rule, diagonal by diagonal, in plain Python."""
    n = len(item)
    if n < D.MIN_ITEM_WORDS:
        return 1.0 if n and any(doc[k : k + n] == item for k in range(len(doc) - n + 1)) else 0.0
    shifts = []
    for shift in range(-n, len(doc) + 1):
        same = [0 <= a + shift < len(doc) and doc[a + shift] == item[a] for a in range(n)]
        if any(all(a + o < n and same[a + o] for o in mask) for mask in D.MASKS for a in range(n) if a + mask[-1] < n and a + shift >= 0 and a + mask[-1] + shift < len(doc)):
            shifts.append((shift, same))
    best, group, last = 0, set(), None
    for shift, same in shifts:
        if last is not None and shift - last > D.NEAR_DIAGONALS:
            group = set()
        group |= {a for a in range(n) if same[a]}
        best, last = max(best, len(group)), shift
    if best >= D.MIN_OVERLAP * n:
        return best / n
    longest, covered, pairs = 0, set(), []
    for shift, same in shifts:
        run = []
        for a in [a for a in range(n) if same[a]] + [10**9]:
            if run and a - run[-1] > D.MAX_GAP + 1:
                if len(run) >= 5:
                    longest = max(longest, len(run))
                    covered |= set(run)
                    pairs += [(x, x + shift) for x in run]
                run = []
            run.append(a)
    if longest >= D.RUN_WORDS:
        return max(best, len(covered)) / n
    if len(covered) < D.MIN_OVERLAP * n:
        return 0.0
    chain = {}
    for a, p in sorted(pairs, key=lambda x: (x[0], -x[1])):
        chain[(a, p)] = 1 + max((v for (b, q), v in chain.items() if b < a and q < p), default=0)
    best = max(best, max(chain.values()))
    return best / n if best >= D.MIN_OVERLAP * n else 0.0


def tables(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(60)}"  # noqa: E731  few words, so that chance hits and repeats abound
    items = [[word() for _ in range(r.choice([1, 3, 6, 8, 12, 20, 45]))] for _ in range(14)]
    docs = []
    for _ in range(40):
        doc = [word() for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            part = list(r.choice(items))
            for _ in range(r.randrange(4)):
                part[r.randrange(len(part))] = word()
            if r.random() < 0.4:
                k = r.randrange(len(part))
                part[k:k] = [word() for _ in range(r.randrange(25))]
            if r.random() < 0.3:
                part = part[r.randrange(len(part)) :]
            at = r.randrange(len(doc) + 1)
            doc[at:at] = part
        docs.append(" ".join(doc))
    return [(100 + k, " ".join(x)) for k, x in enumerate(items)], list(enumerate(docs))


@pytest.mark.parametrize("seed", range(6))
def test_equals_plain_version(seed):
    items, docs = tables(seed)
    index = D.Index(np.array([i for i, _ in items]), pa.array([t for _, t in items]))
    _, data, offsets = None, *D.buffers(pa.array([t for _, t in docs]))
    found = index.leaks(data, offsets)
    wanted = {}
    for d, text in docs:
        leaks = [(i, plain_leak(plain_words(t), plain_words(text))) for i, t in items]
        if any(x for _, x in leaks):
            wanted[d] = sorted((i, round(x, 9)) for i, x in leaks if x)
    assert {d: sorted((i, round(x, 9)) for i, x in set(v)) for d, v in found.items()} == wanted
    assert wanted


def test_passes_agree(spark):
    items, docs = tables(11)
    bench = spark.createDataFrame([*items, items[0], (None, "w1 w2 w3"), (7, None), (8, " ")], "item_id long, text string")
    table = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in [*docs, docs[0], (None, docs[1][1]), (900, None), (901, "")]], "doc_id long, text string, own0 string, item_id int, Leaks double")
    rows = lambda n: sorted(map(repr, D.find_leaks(table, bench, n).collect()))
    assert D.find_leaks(table, bench).columns == ["doc_id", "text", "own0", "item_id", "leaks"]
    assert rows(D.MAX_INDEX_WORDS) == rows(60) == rows(17)
    kept = D.decontaminate(table, bench)
    assert kept.columns == table.columns and 0 < kept.count() < table.count()
    assert D.find_leaks(table.limit(0), bench).count() == 0 and D.decontaminate(table, bench.limit(0)).count() == table.count()


def test_common_openings():
    """Many items with one opening, in texts that repeat it."""
    r = random.Random(4)
    word = lambda: f"v{r.randrange(10**6)}"
    short, long = ([word() for _ in range(n)] for n in (9, 20))
    for opening, leak in ((short, False), (long, True)):
        items = [" ".join([*opening, *(word() for _ in range(30))]) for _ in range(1000)]
        index = D.Index(np.arange(1000), pa.array(items))
        text = " ".join(w for _ in range(120) for w in [*opening, word(), word()])
        began = time.process_time()
        found = index.leaks(*D.buffers(pa.array([text, "nothing here"])))
        assert time.process_time() - began < 20
        assert found.keys() == ({0} if leak else set())
        assert not leak or len({i for i, _ in found[0]}) == 1000


def test_very_long_text():
    item = " ".join(f"q{k}" for k in range(30))
    text = "long words " * 300_000 + item + " more" * 1000
    index = D.Index(np.array([5]), pa.array([item]))
    assert index.leaks(*D.buffers(pa.array([text]))) == {0: [(5, 1.0)]}
    assert index.leaks(*D.buffers(pa.array(["long " * 500_000]))) == {}
