"""DuckDB SQL for the engine's queries, composed from shared common table expressions."""

from __future__ import annotations

from quarry.functions.text import EN_SUFFIXES, LEXICON, RU_SUFFIXES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def stem_sql(w: str) -> str:
    base = f"(CASE WHEN ends_with({w}, 'ся') OR ends_with({w}, 'сь') THEN left({w}, length({w}) - 2) ELSE {w} END)"

    def first(suffixes: list[str]) -> str:
        cases = " ".join(f"WHEN ends_with({base}, {_q(s)}) AND length({base}) >= {len(s) + 3} THEN left({base}, length({base}) - {len(s)})" for s in dict.fromkeys(suffixes))
        return f"CASE {cases} ELSE {base} END"

    return f"(CASE WHEN length({w}) <= 4 OR NOT regexp_matches({w}, '^\\p{{L}}') THEN {w} WHEN regexp_matches({w}, '^[\\x00-\\x7F]') THEN {first(EN_SUFFIXES)} ELSE {first(RU_SUFFIXES)} END)"


def split_sql(s: str) -> str:
    mark = "chr(1)"
    for left, right in ((r"\p{Nd}", r"\P{Nd}"), (r"\P{Nd}", r"\p{Nd}"), (r"[^\p{Lu}\p{Nd}]", r"\p{Lu}"), (r"\p{Lu}", r"\p{Lu}\p{Ll}")):
        s = f"regexp_replace({s}, '({left})({right})', '\\1' || {mark} || '\\2', 'g')"
    return f"string_split({s}, {mark})"


def vocabulary(source: str) -> str:
    """CTEs ``stems`` (word, stem) and ``tokens_of`` (ident, toks) over a CTE with a column ident."""
    return f"""
cands AS (
  SELECT ident, list_filter(list_transform(list_concat([ident], coalesce(flatten(list_transform(list_filter(string_split(ident, '_'), lambda s: s <> ''),
         lambda s: list_concat([s], {split_sql("s")}))), [])), lambda z: lower(z)), lambda z: z <> '') AS c
  FROM (SELECT DISTINCT ident FROM {source})),
parts AS (SELECT DISTINCT unnest(c) AS w FROM cands),
stems AS (SELECT w, {stem_sql("w")} AS st FROM parts),
paired AS (
  SELECT k.ident, list({{'w': s.w, 'st': s.st}} ORDER BY k.pos) AS p
  FROM (SELECT ident, unnest(c) AS w, unnest(range(len(c))) AS pos FROM cands) k JOIN stems s USING (w) GROUP BY k.ident),
tokens_of AS (
  SELECT ident, list_reduce(p, lambda acc, x: CASE WHEN list_contains(acc, x.w) THEN acc
         ELSE list_concat(acc, CASE WHEN x.st = x.w THEN [x.w] ELSE [x.w, x.st] END) END, []::VARCHAR[]) AS toks
  FROM paired)"""


# list_reduce wants an accumulator of its elements' type, so the fold walks positions by recursion instead.
def folded(source: str) -> str:
    return (
        vocabulary(source).rsplit("tokens_of AS", 1)[0]
        + """walk AS (
  SELECT ident, p, 0 AS i, []::VARCHAR[] AS acc FROM paired
  UNION ALL
  SELECT ident, p, i + 1, CASE WHEN list_contains(acc, p[i + 1].w) THEN acc
         ELSE list_concat(acc, CASE WHEN p[i + 1].st = p[i + 1].w THEN [p[i + 1].w] ELSE [p[i + 1].w, p[i + 1].st] END) END
  FROM walk WHERE i < len(p)),
tokens_of AS (SELECT ident, acc AS toks FROM walk WHERE i = len(p))"""
    )


IDENT = r"regexp_extract_all({}, '[\p{{L}}\p{{Nd}}_]+')"

CHUNKS = """
chunks AS (
  SELECT doc_id, source, lang, source || '/doc_' || doc_id || '.txt' AS file_path, 'doc_' || doc_id AS symbol_name,
         source || '/doc_' || doc_id || '.txt:1:doc_' || doc_id AS chunk_id, coalesce(text, '') AS content,
         len(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) AS end_line
  FROM documents)"""

FIELDS = f"""
fields AS (
  SELECT chunk_id, 'symbol_name' AS field, 3 AS weight, symbol_name AS text FROM chunks
  UNION ALL SELECT chunk_id, 'file_path', 2, file_path FROM chunks
  UNION ALL SELECT chunk_id, 'signature', 1, symbol_name FROM chunks
  UNION ALL SELECT chunk_id, 'content', 1, content FROM chunks),
field_idents AS (SELECT chunk_id, field, weight, unnest({IDENT.format("text")}) AS ident FROM fields),
item_idents AS (
  SELECT item_id, unnest({IDENT.format("coalesce(text, '')")}) AS ident,
         unnest(range(len({IDENT.format("coalesce(text, '')")}))) AS pos FROM benchmark),
all_idents AS (SELECT ident FROM field_idents UNION SELECT ident FROM item_idents)"""

TABLES = f""", {folded("all_idents")},
field_tokens AS (SELECT f.chunk_id, f.field, f.weight, unnest(t.toks) AS term FROM field_idents f JOIN tokens_of t USING (ident)),
postings AS (SELECT chunk_id, term, CAST(sum(weight) AS BIGINT) AS tf FROM field_tokens GROUP BY ALL),
docs AS (SELECT chunk_id, CAST(sum(tf) AS BIGINT) AS dlen FROM postings GROUP BY ALL),
corpus AS (SELECT (SELECT count(*) FROM chunks) AS n_chunks, CASE WHEN (SELECT count(*) FROM chunks) > 0 THEN coalesce(sum(tf), 0)::DOUBLE / (SELECT count(*) FROM chunks) ELSE 0 END AS avgdl FROM postings),
terms AS (SELECT term, count(*) AS df, ln(1 + (any_value(n_chunks) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, corpus GROUP BY term)"""
INDEX = f"WITH RECURSIVE {CHUNKS}, {FIELDS}" + TABLES

_LEX = "CASE t[i + 1] " + " ".join(f"WHEN {_q(k)} THEN [{', '.join(map(_q, v))}]" for k, v in LEXICON.items()) + " ELSE []::VARCHAR[] END"

QTERMS = f""",
item_tokens AS (SELECT k.item_id, flatten(list(o.toks ORDER BY k.pos)) AS t FROM item_idents k JOIN tokens_of o USING (ident) GROUP BY k.item_id),
grown AS (
  SELECT item_id, t, 0 AS i, []::VARCHAR[] AS acc FROM item_tokens
  UNION ALL
  SELECT item_id, t, i + 1, CASE WHEN list_contains(acc, t[i + 1]) THEN acc
         ELSE list_concat(list_append(acc, t[i + 1]), list_filter({_LEX}, lambda s: NOT list_contains(list_append(acc, t[i + 1]), s))) END
  FROM grown WHERE i < len(t)),
qterms AS (SELECT item_id AS query_id, unnest(acc) AS term FROM grown WHERE i = len(t))"""

BM25 = """,
bm25 AS (
  SELECT q.query_id, p.chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dlen / avgdl))) AS score
  FROM qterms q JOIN terms USING (term) JOIN postings p USING (term) JOIN docs USING (chunk_id), corpus GROUP BY ALL)"""

COSINE = """,
known AS (SELECT query_id, term, idf, count(*) * idf AS q FROM qterms JOIN terms USING (term) GROUP BY query_id, term, idf),
qnorm AS (SELECT query_id, sqrt(sum(q * q)) AS qn FROM known GROUP BY 1),
norms AS (SELECT chunk_id, sqrt(sum((tf * idf) * (tf * idf))) AS norm FROM postings JOIN terms USING (term) GROUP BY 1),
cosine AS (
  SELECT query_id, chunk_id, sum(q / qn * tf * idf / norm) AS score
  FROM known JOIN qnorm USING (query_id) JOIN postings USING (term) JOIN norms USING (chunk_id) GROUP BY ALL)"""


def top(scores: str, k: int) -> str:
    return f"(SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {scores} WHERE score > 0 QUALIFY rank <= {k})"


RRF = f""",
fused AS (
  SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score
  FROM (SELECT * FROM {top("bm25", 50)} UNION ALL SELECT * FROM {top("cosine", 50)}) GROUP BY ALL),
pool AS (SELECT query_id, chunk_id, score AS rrf, rank AS rrf_rank FROM {top("fused", 20)})"""

RELEVANCE = """,
best AS (SELECT chunk_id, term, max(CASE field WHEN 'symbol_name' THEN 3 WHEN 'signature' THEN 2 ELSE 1 END) AS points FROM field_tokens WHERE chunk_id IN (SELECT chunk_id FROM pool) GROUP BY ALL),
relevance AS (
  SELECT p.query_id, p.chunk_id, p.rrf, p.rrf_rank,
         least(5.0, (5.0 * coalesce(sum(b.points), 0) / (3 * any_value(n.n)) + CASE WHEN strlen(lower(any_value(c.symbol_name))) > 2 AND contains(lower(any_value(i.text)), lower(any_value(c.symbol_name))) THEN 1.5 ELSE 0 END)
               * CASE WHEN any_value(c.end_line) > 120 THEN 0.7 ELSE 1.0 END)::DOUBLE AS relevance
  FROM pool p JOIN (SELECT query_id, count(*) AS n FROM qterms GROUP BY 1) n USING (query_id) JOIN benchmark i ON i.item_id = p.query_id JOIN chunks c USING (chunk_id)
  JOIN qterms q USING (query_id) LEFT JOIN best b ON b.chunk_id = p.chunk_id AND b.term = q.term
  GROUP BY p.query_id, p.chunk_id, p.rrf, p.rrf_rank)"""


def reranked(alpha: float, k: int) -> str:
    return f"""(SELECT query_id, chunk_id, {alpha} * relevance / 5 + {1 - alpha} * rrf / max(rrf) OVER (PARTITION BY query_id) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round({alpha} * relevance / 5 + {1 - alpha} * rrf / top_rrf, 9) DESC, rrf_rank) AS rank
  FROM (SELECT *, max(rrf) OVER (PARTITION BY query_id) AS top_rrf FROM relevance) QUALIFY rank <= {k})"""


FULL = INDEX + QTERMS + BM25 + COSINE + RRF + RELEVANCE
HITS = f", hits AS (SELECT * FROM {reranked(0.5, 5)}), kept AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM hits QUALIFY rank = 1 OR score > greatest(0.5, top - 0.05))"
GATE = """, gate AS (
  SELECT query_id, 1 / (1 + exp(-(1.6 * s1 + 1.2 * (s1 - rest) - 1.5))) AS noul
  FROM (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS s1, coalesce(avg(score) FILTER (WHERE rank BETWEEN 2 AND 5), 0) AS rest FROM kept GROUP BY 1))"""
SHOW = "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM "
RELEVANT = """, relevant AS (SELECT b.item_id AS query_id, c.chunk_id, c.lang FROM chunks c JOIN benchmark b ON contains(c.content, b.text)),
first AS (SELECT r.query_id, min(h.rank) AS first_rank FROM relevant r LEFT JOIN hits h USING (query_id, chunk_id) GROUP BY 1)"""
METRICS = ", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{k}" for k in (1, 3, 5)) + ", round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr"
LINES = "string_split(replace({0}, chr(13) || chr(10), chr(10)), chr(10))"


SHORT = "length(x) BETWEEN 1 AND 60"

# Documents as Python files, chunked: a function per line with the line as its docstring.
BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
PROGRAMS = f"""
program_lines AS (SELECT 'src/doc_' || doc_id || '.py' AS file_path, {LINES.format("coalesce(text, '')")} AS l FROM documents),
functions AS (
  SELECT file_path, unnest(list_transform(l, lambda x: replace(replace(replace(x, chr(92), ''), '"', ''), chr(39), ''))) AS x, unnest(range(1, len(l) + 1)) AS i
  FROM program_lines),
chunks AS (
  SELECT file_path || ':' || (3 * i - 2) || ':line_' || i AS chunk_id, file_path, 'python' AS language, CAST(3 * i - 2 AS INTEGER) AS start_line,
         CAST(3 * i AS INTEGER) AS end_line, 'line_' || i AS symbol_name, 'func' AS kind, 'def line_' || i || '()' AS signature,
         regexp_replace(x, '^{BLANK}|{BLANK}$', '', 'g') AS doc, 'def line_' || i || '():' || chr(10) || '    \"\"\"' || x || '\"\"\"' || chr(10) AS content
  FROM functions)"""
CODE_INDEX = f"WITH RECURSIVE {PROGRAMS}, {FIELDS.replace('symbol_name FROM chunks', 'signature FROM chunks UNION ALL SELECT chunk_id, ' + chr(39) + 'doc' + chr(39) + ', 1, doc FROM chunks')}" + TABLES


def changed_lines(how: str) -> str:
    """Documents whose lines x (numbered i from 1) are changed."""
    return f"(SELECT doc_id, source || '/doc_' || doc_id || '.txt' AS file_path, array_to_string(list_transform({LINES.format("coalesce(text, '')")}, lambda x, i: {how}), chr(10)) AS text FROM documents)"


def boundaries(table: str, path: str, text: str, pattern: str, name: str, kind: str) -> str:
    lines = LINES.format(f"coalesce({text}, '')")
    return f"""WITH l AS (SELECT {path} AS file_path, len({lines}) AS n, unnest({lines}) AS line, unnest(range(1, len({lines}) + 1)) AS start_line FROM {table}),
s AS (SELECT * FROM l WHERE regexp_matches(line, '{pattern}'))
SELECT file_path, CAST(start_line AS INTEGER) AS start_line, CAST(coalesce(lead(start_line) OVER (PARTITION BY file_path ORDER BY start_line) - 1, n) AS INTEGER) AS end_line, {name} AS symbol_name, {kind} AS kind FROM s"""


def hits_of(k: int, name: str) -> str:
    """The kept hits of a blended search for k, and its gate."""
    return f""", raw_{name} AS (SELECT * FROM {reranked(0.5, k)}),
kept_{name} AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM raw_{name} QUALIFY rank = 1 OR score > greatest(0.5, top - 0.05)),
gate_{name} AS (
  SELECT query_id, 1 / (1 + exp(-(1.6 * s1 + 1.2 * (s1 - rest) - 1.5))) AS noul
  FROM (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS s1, coalesce(avg(score) FILTER (WHERE rank BETWEEN 2 AND 5), 0) AS rest FROM kept_{name} GROUP BY 1)),
paid_{name} AS (
  SELECT item_id AS query_id, coalesce(noul, 0) < 0.5 AS need_more,
         ({len('{"query":,"need_more":,"noul":,"results":}')} + {json_bytes("coalesce(i.text, '')")} + CASE WHEN coalesce(noul, 0) < 0.5 THEN 4 ELSE 5 END + length({number("coalesce(noul, 0)")})
          + CASE WHEN coalesce(n_raw, 0) = {k} OR coalesce(n, 0) < coalesce(n_raw, 0) THEN {len(',"more_available":true')} ELSE 0 END
          + CASE WHEN coalesce(n, 0) = 0 THEN 4 ELSE bytes + n + 1 END) // 4 AS tokens, top_chunk
  FROM benchmark i
  LEFT JOIN (SELECT query_id, count(*) AS n_raw FROM raw_{name} GROUP BY 1) r ON r.query_id = i.item_id
  LEFT JOIN (SELECT query_id, count(*) AS n, CAST(sum({HIT_BYTES}) AS BIGINT) AS bytes, max(CASE WHEN rank = 1 THEN chunk_id END) AS top_chunk FROM kept_{name} JOIN chunks USING (chunk_id) GROUP BY 1) s ON s.query_id = i.item_id
  LEFT JOIN gate_{name} g ON g.query_id = i.item_id)"""


def json_bytes(text: str) -> str:
    return f"(strlen(CAST(to_json({text}) AS VARCHAR)) + 5 * len(regexp_extract_all({text}, '[<>&]')) + 3 * len(regexp_extract_all({text}, '[\u2028\u2029]')))"


def number(value: str) -> str:
    return f"CAST(CAST({value} AS DECIMAL(9, 6)) AS VARCHAR)"


HIT_BYTES = (
    str(len('{"file":,"start_line":,"end_line":,"symbol":,"kind":,"language":,"content":,"score":}') + len(',"signature":'))
    + f" + 1 + length(CAST(end_line AS VARCHAR)) + length({number('score')}) + {json_bytes('file_path')} + 2 * {json_bytes('symbol_name')} + {len('file') + 2} + {len('text') + 2} + {json_bytes('content')}"
)
BENCH = (
    FULL
    + hits_of(5, "a")
    + hits_of(10, "b")
    + """,
gterms AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+'), lambda t: length(t) > 3)) AS ts FROM benchmark),
grep AS (
  SELECT query_id, sum(strlen(content) + list_sum(list_transform(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)),
         lambda x, i: CASE WHEN len(list_filter(ts, lambda t: contains(lower(x), t))) > 0 THEN strlen(file_path) + length(CAST(i AS VARCHAR)) + strlen(x) + 4 ELSE 0 END))) AS bytes
  FROM chunks, gterms WHERE len(list_filter(ts, lambda t: contains(lower(content), t))) > 0 GROUP BY 1),
base AS (SELECT item_id AS query_id, CAST(floor(coalesce(bytes, (SELECT sum(strlen(content)) FROM chunks)) / 4) AS BIGINT) AS baseline FROM benchmark LEFT JOIN grep ON query_id = item_id),
bench AS (
  SELECT a.query_id, baseline, a.need_more, CAST(a.tokens + CASE WHEN a.need_more THEN b.tokens + coalesce(strlen(c.content) // 4, 0) ELSE 0 END AS BIGINT) AS rag,
         round(baseline / CAST(a.tokens + CASE WHEN a.need_more THEN b.tokens + coalesce(strlen(c.content) // 4, 0) ELSE 0 END AS DOUBLE), 6) AS ratio
  FROM base JOIN paid_a a USING (query_id) JOIN paid_b b USING (query_id) LEFT JOIN chunks c ON c.chunk_id = coalesce(b.top_chunk, a.top_chunk))"""
)

SPOKEN = f"""
WITH RECURSIVE asked AS (
  SELECT 'item:' || item_id AS item_id, coalesce(text, '') AS text FROM benchmark
  UNION ALL SELECT 'talk:' || conv_id || ':' || turn, coalesce(text, '') FROM conversations),
item_idents AS (SELECT item_id, unnest({IDENT.format("text")}) AS ident, unnest(range(len({IDENT.format("text")}))) AS pos FROM asked),
{folded("item_idents")}""" + QTERMS
