"""Quotation links, threads and reply order against plain Python."""

import random
import re

from quarry.llm import quotes

PREFIX = re.compile(r"^((?:[ \t]?>)+)[ \t]?")


def normal(text):
    return re.sub(r"[ \t\n\x0b\x0c\r]+", " ", "".join(c.lower() if c.isascii() else c for c in text)).strip(" ")


def lines_of(text):
    out = []
    for line in (text or "").split("\n"):
        m = PREFIX.match(line)
        out.append((m[1].count(">") if m else 0, PREFIX.sub("", line, count=1)))
    return out


def passages(text):
    """(level, key) of all runs of a level, and of all lines of a level, with their lines and paragraphs."""
    lines, found = lines_of(text), set()
    runs, start = [], 0
    for k in range(1, len(lines) + 1):
        if k == len(lines) or lines[k][0] != lines[start][0]:
            runs.append((lines[start][0], "\n".join(x for _, x in lines[start:k])))
            start = k
    runs += [(v, "\n".join(x for w, x in lines if w == v)) for v in {v for v, _ in lines}]
    for level, part in runs:
        for key in [*part.split("\n"), *re.split(r"\n[ \t]*\n", part), part]:
            if normal(key):
                found.add((level, normal(key)))
    return found


def plain(messages):
    """conv -> {turn: (reply_to, root, depth, position)}"""
    out = {}
    for conv in {c for c, _, _ in messages}:
        turns = {t: x for c, t, x in messages if c == conv}
        parent = {}
        for t, text in turns.items():
            best = None
            for level, key in passages(text):
                if level == 0:
                    continue
                origin = min((u for u, x in turns.items() if (0, key) in passages(x)), default=None)
                if origin is not None and origin < t:
                    best = max(best or (-99,), (-level, len(key), origin))
            if best:
                parent[t] = best[2]
        rows = {}

        def walk(t, root, depth, rows=rows, parent=parent):
            rows[t] = (parent.get(t), root, depth, sum(r[1] == root for r in rows.values()))
            for u in sorted(u for u, q in parent.items() if q == t):
                walk(u, root, depth + 1)

        for t in sorted(turns):
            if t not in parent:
                walk(t, t, 0)
        out[conv] = rows
    return out


def talk(seed):
    r = random.Random(seed)
    words = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    rows = []
    for conv in range(4):
        said = []
        for turn in range(25):
            text = [words(3 + r.randrange(6)) for _ in range(1 + r.randrange(3))]
            if said and r.random() < 0.8:
                origin = said[max(0, len(said) - 1 - r.randrange(3))] if r.random() < 0.7 else r.choice(said)
                mark = r.choice(["> ", ">", " > "])
                text = [mark + x for x in origin.split("\n")[: 1 + r.randrange(3)]] + text
                if r.random() < 0.3:
                    text += ["> " + r.choice(said).split("\n")[-1], words(2)]
            said.append("\n".join(text))
            rows.append((conv, turn * 3, said[-1]))
    return rows


def test_threads_equal_plain_version(spark):
    rows = [r for seed in (1, 2) for r in [(c + 10 * seed, t, x) for c, t, x in talk(seed)]]
    table = spark.createDataFrame([(*r, "u") for r in rows], "conv_id long, turn long, text string, role string").repartition(3)
    ordered = quotes.conversations(table).collect()
    wanted = plain(rows)
    assert {(r["conv_id"], r["turn"]): (r["reply_to"], r["root_turn"], r["depth"], r["reply_pos"]) for r in ordered} == {(c, t): v for c, x in wanted.items() for t, v in x.items()}
    assert max(v[2] for x in wanted.values() for v in x.values()) >= 4
    assert [(r["conv_id"], r["turn"]) for r in ordered] == [(c, t) for c in sorted(wanted) for t, _ in sorted(wanted[c].items(), key=lambda kv: (kv[1][1], kv[1][3]))]
    assert all(">" not in r["text"] for r in ordered)


def test_long_chain_and_wide_thread(spark):
    chain = [(1, k, f"> message number {k - 1} of all\nmessage number {k} of all") for k in range(150)]
    wide = [(2, 0, "the first of them")] + [(2, k, f"> the first of them\nanswer {k} to it") for k in range(1, 200)]
    got = quotes.link_quotations(spark.createDataFrame(chain + wide, "conv_id long, turn long, text string")).collect()
    assert {(r["conv_id"], r["turn"]): (r["depth"], r["reply_pos"]) for r in got} == {(1, k): (k, k) for k in range(150)} | {(2, k): (min(k, 1), k) for k in range(200)}


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, own0 string, _lines int, parent string, _root string, DEPTH string"
    rows = [
        (1, 0, None, "Hello there.", "a", 1, "p", "r", "d"),
        (1, 1, "u", ">>> print(1)\n> markdown", "b", 2, None, "r", "d"),
        (1, 2, "u", "> Hello there.\n" + "very long " * 100_000, "c", 3, "p", "r", "d"),
        (1, 2, "u", "> Hello there.\n" + "very long " * 100_000, "c", 3, "p", "r", "d"),
        (1, None, "u", "> Hello there.", "e", 4, "p", "r", "d"),
        (None, 1, "u", "> Hello there.", "f", 5, "p", "r", "d"),
        (2, 0, "u", None, "g", 6, "p", "r", "d"),
        (2, 1, "u", "", "h", 7, "p", "r", "d"),
    ]
    table = spark.createDataFrame(rows, schema)
    got = quotes.conversations(table)
    assert got.columns == ["conv_id", "turn", "role", "text", "own0", "_lines", "parent", "_root", *quotes.ADDED]
    found = {r["own0"]: r for r in got.collect()}
    assert got.count() == len(rows) and [found[k]["_lines"] for k in "abcefgh"] == [1, 2, 3, 4, 5, 6, 7]
    assert (found["b"]["unlinked"], found["b"]["text"], found["b"]["n_quoted"], found["b"]["reply_to"]) == (">>> print(1)\n> markdown", "", 2, None)
    assert (found["c"]["reply_to"], found["c"]["unlinked"], found["c"]["reply_pos"]) == (0, "", 1) and len(found["c"]["text"]) > 900_000
    assert found["e"]["reply_to"] is None and found["f"]["reply_to"] is None and found["g"]["text"] == found["h"]["text"] == ""
    assert quotes.conversations(table.limit(0)).count() == 0
