"""Retrieval quality and token cost over sets of questions, and reports of them."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import BYTES_PER_TOKEN, lines_of
from quarry.operators import decide, scoring, stats
from quarry.operators.index import Index
from quarry.session import cut

#: Label and mode of each compared configuration.
CONFIGS = (("A", "fts"), ("B", "vec"), ("C", "hybrid"), ("D", "hybrid+rerank"), ("E", "hybrid+blend"))
RANKS = (1, 3, 5)
# Questions of the token benchmark, how many are taken if none of them is there, and lines read around a hit.
BENCH_IDS, BENCH_FIRST, AROUND = ("q01", "q03", "q04", "q05", "q09", "q12"), 6, 15


def first_expected(hits: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``id, question, question_lang, language, expected_files, first_rank`` for each question: the rank of the first hit in an expected file, null if none."""
    at = hits.join(chunks.select("chunk_id", "file_path"), "chunk_id").select(F.col("query_id").alias("of"), "rank", "file_path")
    good = questions.join(at, F.col("id") == F.col("of")).where(F.array_contains("expected_files", F.col("file_path")))
    ranks = good.groupBy(F.col("id").alias("of")).agg(F.min("rank").alias("first_rank"))
    wanted = ("id", "question", "question_lang", "language", "expected_files")
    return questions.join(ranks, F.col("id") == F.col("of"), "left").select(*wanted, "first_rank")


def metrics(first: DataFrame) -> DataFrame:
    """Recall at RANKS and the mean reciprocal rank: over all, by code language and by question language."""
    return first.groupingSets([[], ["language"], ["question_lang"]], "language", "question_lang").agg(F.grouping_id().alias("slice"),
        F.count("*").alias("n"), *stats.recall_mrr(RANKS)).select(
        F.when(F.col("slice") == 3, "all").when(F.col("slice") == 1, "language").otherwise("question_lang").alias("slice"),
            F.coalesce("language", "question_lang").alias("value"), "n", *(f"recall_{k}" for k in RANKS), "mrr"
    )


def evaluate(index: Index, questions: DataFrame, k: int = 5, configs: Sequence[tuple[str, str]] = CONFIGS, **search) -> list[dict]:
    """Per configuration: label, mode, overall metrics, slices of recall at 5, and for the
    reranked one the questions that its first five miss. Questions are a stated set."""
    queries, out = scoring.ask(questions.select(F.col("id").alias("query_id"), F.col("question").alias("query"))), []
    for label, mode in configs:
        hits = cut(scoring.search(index, queries, mode, k, **search))
        first = cut(first_expected(hits, questions, index.chunks))
        rows = metrics(first).collect()  # a row per language
        whole = next(r for r in rows if r["slice"] == "all")
        result = {"label": label, "mode": mode, "n": whole["n"], "mrr": whole["mrr"]} | {f"recall_{r}": whole[f"recall_{r}"] for r in RANKS}
        result |= {s: {r["value"]: r["recall_5"] for r in rows if r["slice"] == s} for s in ("language", "question_lang")}
        if mode == "hybrid+rerank":
            named = hits.join(index.chunks.select("chunk_id", "file_path", "symbol_name"), "chunk_id").groupBy(F.col("query_id").alias("of"))
            shown = named.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(":", "file_path", "symbol_name").alias("hit")))),
                lambda x: x["hit"]).alias("got"))  # k hits
            missed = first.where("first_rank IS NULL OR first_rank > 5").join(shown, F.col("id") == F.col("of"), "left")
            result["missed"] = [r.asDict() for r in missed.select("id", "question", "expected_files", "got", "first_rank").orderBy("id").collect()]
        out.append(result)
    return out


def report(results: Sequence[dict], title: str = "Retrieval report") -> str:
    """Markdown of :func:`evaluate`."""
    shares = lambda of: ", ".join(f"{k} {v:.2f}" for k, v in sorted(of.items()))
    out = [f"# {title}", "", "| config | mode | " + " | ".join(f"Recall@{k}" for k in RANKS) + " | MRR |", "|" + "---|" * (3 + len(RANKS))]
    out += [f"| {r['label']} | {r['mode']} | " + " | ".join(f"{r[f'recall_{k}']:.2f}" for k in RANKS) + f" | {r['mrr']:.2f} |" for r in results]
    out += ["", "## Recall@5 by language", "", "| config | code | question |", "|---|---|---|"]
    out += [f"| {r['label']} ({r['mode']}) | {shares(r['language'])} | {shares(r['question_lang'])} |" for r in results]
    missed = [m for r in results for m in r.get("missed", ())]
    out += ["", "## Missed by hybrid+rerank", ""]
    for m in missed:
        why = "not among the hits" if m["first_rank"] is None else f"found at rank {m['first_rank']} only"
        out += [f"- **{m['id']}** {m['question']}", f"  - expected: {', '.join(m['expected_files'])}", f"  - first hits: {', '.join(m['got'] or [])}", f"  - {why}"]
    return "\n".join([*out, *([] if missed else ["None: every question is answered in the first five."]), ""])


def write_report(path: str, results: Sequence[dict]) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(report(results))


def bench_questions(questions: DataFrame, ids: Sequence[str] = BENCH_IDS, first: int = BENCH_FIRST) -> DataFrame:
    """The questions of the token benchmark; the first few by id if it has none of them."""
    named = questions.where(F.col("id").isin(*ids))
    return named if named.limit(1).count() else questions.orderBy("id").limit(first)


# Token costs


def json_text(text: Column) -> Column:
    """A JSON string with the escapes of a web-safe encoder."""
    quoted = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("x")))
    plain = F.substring(quoted, 6, 1 << 30)
    return F.left(plain, F.length(plain) - 1)


def json_bytes(text: Column) -> Column:
    """Bytes of :func:`json_text`, where ``< > &`` and the two line separators take six."""
    some = lambda pattern, each: each * F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{pattern}]", ""))
    return F.octet_length(json_text(text)) + some("<>&", 5) + some("  ", 3)


def number(value: Column) -> Column:
    return value.cast("decimal(9,6)").cast("string")


def hit_bytes() -> Column:
    """Bytes of a hit in a response: file, lines, symbol, kind, language, signature and doc if they aren't empty, content and score."""
    keys = '{"file":,"start_line":,"end_line":,"symbol":,"kind":,"language":,"content":,"score":}'
    size = F.lit(len(keys)) + F.length(F.col("start_line").cast("string")) + F.length(F.col("end_line").cast("string")) + F.length(number(F.col("score")))
    for c in ("file_path", "symbol_name", "kind", "language", "content"):
        size = size + json_bytes(F.col(c))
    for c, key in (("signature", ',"signature":'), ("doc", ',"doc":')):
        size = size + F.when(F.coalesce(F.col(c), F.lit("")) == "", 0).otherwise(F.lit(len(key)) + json_bytes(F.col(c)))
    return size


def payload_tokens(queries: DataFrame, hits: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``query_id, tokens, need_more, top`` of one search call each: what its response
    costs, whether its hits suffice, and the first hit's chunk. Queries without hits answer too."""
    kept = cut(decide.filter_relevant(hits))
    raw = hits.groupBy("query_id").agg(F.count("*").alias("n_raw"))
    # Hits are a few per query and go to where the chunks are.
    shown = chunks.join(F.broadcast(kept), "chunk_id").groupBy("query_id").agg(F.sum(hit_bytes()).alias("bytes"), F.count("*").alias("n"),
        F.max(F.when(F.col("rank") == 1, F.col("chunk_id"))).alias("top"))
    gate = decide.noul(kept)
    all_ = queries.select("query_id", "query").join(raw, "query_id", "left").join(shown, "query_id", "left").join(gate, "query_id", "left")
    noul, need = F.coalesce("noul", F.lit(0.0)), F.coalesce("need_more", F.lit(True))
    n, n_raw = F.coalesce("n", F.lit(0)), F.coalesce("n_raw", F.lit(0))
    size = F.lit(len('{"query":,"need_more":,"noul":,"results":}')) + json_bytes(F.col("query")) + F.when(need, 4).otherwise(5) + F.length(number(noul))
    size = size + F.when((n_raw == k) | (n < n_raw), F.lit(len(',"more_available":true'))).otherwise(0)
    size = size + F.when(n == 0, F.lit(len("null"))).otherwise(F.coalesce("bytes", F.lit(0)) + n - 1 + 2)
    return all_.select("query_id", F.floor(size / BYTES_PER_TOKEN).cast("long").alias("tokens"), need.alias("need_more"), "top")


def span_tokens(tops: DataFrame, chunks: DataFrame, files: DataFrame, around: int = AROUND) -> DataFrame:
    """``query_id, tokens`` of reading a chunk (``top``) with lines around it."""
    at = chunks.select(F.col("chunk_id").alias("top"), "file_path", "start_line", "end_line").join(F.broadcast(tops), "top")
    at = files.select("file_path", F.col("content").alias("whole")).join(F.broadcast(at), "file_path")
    lines = lines_of(F.col("whole"))
    first, last = F.greatest(F.col("start_line") - around, F.lit(1)), F.least(F.col("end_line") + around, F.size(lines))
    span = F.array_join(F.slice(lines, first, last - first + 1), "\n")
    return at.select("query_id", F.floor(F.octet_length(span) / BYTES_PER_TOKEN).cast("long").alias("tokens"))


def rag_tokens(index: Index, queries: DataFrame, files: DataFrame, k: int, **search) -> DataFrame:
    """``query_id, rag, need_more``: what an agent pays that searches for ``k`` hits (at most
    half of what a search may give), and where they do not suffice searches again for twice
    as many and reads around the best of them."""
    if not 0 < 2 * k <= scoring.MOST:
        raise ValueError(f"k is {k}, not between 1 and {scoring.MOST // 2}")
    queries = scoring.ask(cut(queries))
    # The pool and its order are the same for any number of hits, so one search gives both.
    wide = cut(scoring.search(index, queries, "hybrid+blend", 2 * k, **search))
    once = cut(payload_tokens(queries.queries, wide.where(F.col("rank") <= k), index.chunks, k))
    more = queries.queries.join(once.where("need_more"), "query_id", "left_semi")
    again = cut(payload_tokens(more, wide.join(more, "query_id", "left_semi"), index.chunks, 2 * k))
    tops = again.select("query_id", F.col("tokens").alias("more"),
        F.col("top").alias("second")).join(once.select("query_id", F.col("top").alias("first")), "query_id")
    spans = span_tokens(tops.select("query_id", F.coalesce("second", "first").alias("top")), index.chunks, files)
    both = once.join(tops.select("query_id", "more"), "query_id", "left").join(spans.withColumnRenamed("tokens", "span"), "query_id", "left")
    return both.select("query_id", (F.col("tokens") + F.coalesce("more", F.lit(0)) + F.coalesce("span", F.lit(0))).alias("rag"), "need_more")


def token_bench(index: Index, queries: DataFrame, files: DataFrame, k: int, **search) -> DataFrame:
    """``query_id, baseline, rag, ratio, need_more``: reading what grep finds against searching."""
    base = stats.grep_cost(queries, files).withColumnRenamed("tokens", "baseline")
    both = base.join(rag_tokens(index, queries, files, k, **search), "query_id")
    return both.select("query_id", "baseline", "rag", F.when(F.col("rag") > 0, F.col("baseline") / F.col("rag")).otherwise(F.lit(0.0)).alias("ratio"), "need_more")


def mean_median(rows: DataFrame, column: str = "ratio") -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg(column).alias("mean_ratio"), F.median(column).alias("median_ratio"))


def last_calls(calls: DataFrame, n: int, newest_first: bool = True) -> DataFrame:
    """The last ``n`` calls of a log (``ts`` and ``event_id`` say when), in either order."""
    last = calls.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
    place = F.row_number().over(W.orderBy(F.desc("ts") if newest_first else F.asc("ts"), F.desc("event_id") if newest_first else F.asc("event_id")))
    return last.withColumn("place", place)
