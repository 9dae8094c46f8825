"""Every operator over nulls, empty and very long texts, ties, repeated rows, empty tables,
and columns named like anything that an operator makes inside."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, html_text, line_dedup, mixing, near_dedup, quality, quotes, secrets, substring_dedup, toxicity

#: Names that operators use inside, of columns and of their own fields.
INSIDE = (
    "own0 own1 own own_i own_j _lines lines gone drop_doc drop_row drop_pos _dedup_line_array line row pos hash key keeper last n "
    "mix_hash mix_range mix_key mix_inside at_key at_range start rest whole part of at weight cap tried place total free "
    "_id _hash kept_id kept_hash text_hash id label component set_a set_b bands unit pivot leader blocks group "
    "ref_classes ref_commons _words _chars _left0 _hashes _windows _order _found _common _leaks0 item_id overlap "
    "parent root _conv _turn _root _depth _place passage level slice bucket keys more y turn_ bytes upto spans dotted.name"
).split()
LONG = "word after word, line.\n" * 40_000


def texts():
    return [
        (1, "the same line of text here\nand then some more of it", "en", "a"),
        (2, "the same line of text here\nbut this differs a lot", "en", "a"),
        (2, "the same line of text here\nbut this differs a lot", "en", "a"),
        (3, None, None, None),
        (None, "the same line of text here", "en", "b"),
        (None, None, None, None),
        (4, "", "en", "b"),
        (5, " \n\t\x0b\x0c\r ", "xx", ""),
        (6, LONG, "en", "a"),
        (7, "é 漢字 \U0001f600 ﬁ İ", "zh", "c"),
        (8, 'password = "hunter22" \\u0000 > quoted', "en", "c"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(*r, k) for k, r in enumerate(texts())], "doc_id long, text string, lang string, source string, nr int")
    return rows.select("*", *(F.concat(F.lit(f"{n}/"), "nr").alias(n) for n in INSIDE)).repartition(3)


def marks(frame, added=()):
    """(nr, all clashing columns as they should be) of each row."""
    assert [c for c in frame.columns if c in INSIDE] == INSIDE
    rows = frame.select("nr", *(F.col(f"`{n}`") for n in INSIDE)).collect()
    assert all(r[n] == f"{n}/{r['nr']}" for r in rows for n in INSIDE)
    return sorted(r["nr"] for r in rows)


ALL = list(range(len(texts())))
OPERATORS = {
    "line dedup": (line_dedup.dedup_lines, ALL),
    "find_leaks": (lambda d: decontaminate.find_leaks(d, bench(d)), ALL),
    "decontaminate": (lambda d: decontaminate.decontaminate(d, bench(d)), [k for k in ALL if k not in (1, 2)]),
    "mix_sizes": (lambda d: mixing.mix_sizes(d.withColumn("size", F.coalesce(F.length("text"), F.lit(0)).cast("long"))), ALL),
    "dedup_documents": (near_dedup.dedup_documents, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]),
    "find_secrets": (secrets.find_secrets, ALL),
    "tag": (lambda d: toxicity.tag(d, toxicity.Model(0.25)), ALL),
    "features": (quality.features, ALL),
    "verdicts": (lambda d: quality.verdicts(d, texts=True), ALL),
    "quality_rules": (quality.quality_rules, [0]),
    "quotes": (lambda d: quotes.link_quotations(turns(d)), ALL),
    "pages": (lambda d: html_text.extract(d.withColumn("html", F.concat(F.lit("<p>"), "text"))), ALL),
}


def bench(d):
    return d.sparkSession.createDataFrame([(1, "but this differs a lot"), (2, None), (None, "word after word line"), (3, "")], "item_id long, text string")


def turns(d):
    return d.withColumn("conv_id", F.col("doc_id") % 3).withColumn("turn", F.col("doc_id"))


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_and_columns_pass(docs, name):
    work, kept = OPERATORS[name]
    found = work(docs)
    if name == "quality_rules":
        assert set(marks(found)) <= set(ALL)
    else:
        assert marks(found) == kept
    assert work(docs.limit(0)).count() == 0


def test_mix_of_copies(docs):
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == [*docs.columns, "copy", "copy_words"]
    rows = mixed.select("nr", "copy", "copy_words", *(F.col(f"`{n}`") for n in INSIDE)).collect()
    assert rows and all(r[n] == f"{n}/{r['nr']}" for r in rows for n in INSIDE)
    assert len({(r["nr"], r["copy"]) for r in rows}) == len(rows) and mixing.mix_documents(docs.limit(0)).count() == 0


def test_substring_dedup_leaves_others_out(docs):
    found = substring_dedup.remove_repeats(docs)
    assert found.columns == ["doc_id", "text", "n_words", "n_removed", "removed"] and found.count() == len(ALL) and substring_dedup.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "work, added",
    [
        (line_dedup.dedup_lines, ["n_lines", "n_dropped"]),
        (lambda d: decontaminate.find_leaks(d, bench(d)), ["leaks"]),
        (secrets.find_secrets, ["secrets"]),
        (lambda d: toxicity.tag(d, toxicity.Model()), ["score", "toxic_spans"]),
        (quality.features, ["quality"]),
        (lambda d: quality.verdicts(d, texts=True), ["quality", "base_failed", "class_distance", "word_distance", "kept"]),
        (lambda d: mixing.mix_sizes(d.withColumn("size", F.lit(1).cast("long"))), ["source_size", "target", "taken"]),
        (lambda d: quotes.link_quotations(turns(d)), list(quotes.ADDED)),
        (lambda d: html_text.extract(d.withColumnRenamed("text", "html")), ["text"]),
    ],
)
def test_added_names_replace_in_any_case(spark, tmp_path, work, added):
    base = spark.createDataFrame(texts()[:3], "doc_id long, text string, lang string, source string")
    got = work(base.select("*", *(F.lit(1).alias(a.upper()) for a in added if a != "text")))
    assert len({c.lower() for c in got.columns}) == len(got.columns) and set(added) <= set(got.columns)
    got.write.parquet(str(tmp_path / "out"))


def test_ties_of_lines(spark):
    rows = [(i, "a line of ten or more\nown line number %s" % i) for i in (5, 3, 9, 3)]
    got = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, rows[1][1]), (5, "own line number 5"), (9, "own line number 9")}


def test_ties_of_the_mix(spark):
    """Rows alike in id, source and size: reruns take the same words in all."""
    rows = spark.createDataFrame([(1, "s", "a b c")] * 40 + [(2, "t", "a b")] * 3 + [(None, None, "x")] * 5, "doc_id long, source string, text string").repartition(7)
    runs = [sorted((r["doc_id"] or 0, r["taken"]) for r in mixing.mix_sizes(mixing.with_size(rows)).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 48


def test_many_sources(spark):
    """Water-filling against the plain rounds of clamping and resharing."""
    import random

    r = random.Random(2)
    sizes = {f"s{k:03d}": r.choice([1, 5, 40, 900]) * (1 + r.randrange(9)) for k in range(120)} | {None: 70}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    names = sorted((k for k in sizes if k is not None), key=lambda k: k) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, full, left = {}, set(), sum(sizes.values())
    while True:
        share = left / sum(weight[k] for k in names if k not in full)
        over = [k for k in names if k not in full and share * weight[k] >= 3 * sizes[k]]
        if not over:
            target |= {k: share * weight[k] for k in names if k not in full}
            break
        for k in over:
            target[k] = 3 * sizes[k]
            full.add(k)
            left -= target[k]
    got = {x["source"]: x["target"] for x in mixing.source_targets(rows).collect()}
    assert got.keys() == target.keys() and all(abs(got[k] - target[k]) < 1e-6 * target[k] for k in got)
