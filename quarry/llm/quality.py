"""Quality rules: counts of a document, and its divergence from its language.

Each text gets two histograms: over character classes, and over common words of
several languages (others together). References per language are the medians, bin by
bin, of the histograms of all long enough documents that pass the base rules (medians,
because a third of the rows may be one source's junk; exact ones over shares rounded to
``1 / GRID``, so their partial states are counts of ``GRID`` values at most and reruns
agree): one for every value of ``lang`` that has ``MIN_DOCS`` such documents. A document
whose Jensen-Shannon distance to its reference exceeds a threshold is rejected, unless it
is too short for its histogram to mean anything. All is built-in functions: repeated word
windows are found inside the row, first by a comparison of the counts of all and of
distinct window hashes (64 bits), and only documents with repeats are sorted and measured.

Defined cases: null or empty text has no words and fails the base rules; very long texts
are measured whole; a null ``lang``, or one with fewer than ``MIN_DOCS`` long enough
documents, has no reference and rejects nothing by divergence; a distance that equals a
threshold passes; repeated rows are judged alike, and a null ``doc_id`` like any other; an
empty table gives no rows; other columns pass, whatever their names, but those named like
the added ones in any case are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._native import BLANKS, finished, inner_names, words
from quarry.session import cut

SYMBOLS = "[#*$%&|<>]+"
WINDOW = 5
#: Frequent function words of German, English, Spanish and French, as they stand inside a sentence.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "be",
    "der", "die", "und", "das", "von", "zu", "den", "mit", "nicht", "ist",
    "de", "la", "le", "les", "et", "des", "un", "une", "que", "qui", "pour", "dans",
    "el", "los", "las", "y", "en", "con", "por", "se", "su", "al", "del",
)
#: Guards: characters and words from which a histogram counts.
MIN_CHARS, MIN_WORDS = 200, 50
#: Long enough documents that make a reference.
MIN_DOCS = 10
#: Steps of a share in a reference.
GRID = 1000
#: Distances (0 to 1) over which a document goes: of classes alone, or of both together.
FAR_CLASSES, ODD_CLASSES, ODD_WORDS = 0.35, 0.2, 0.25


#: Character classes after a-z, taken away one after the other: capitals, digits, stops, symbols; what remains is beyond ASCII.
CLASSES = ("[A-Z]+", "[0-9]+", "[.,;:!?'\"()-]+", "[\\x21-\\x7E]+")


def features(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with a struct ``quality``: the counts and both histograms."""
    names = inner_names(docs.columns, "doc_id", "lang", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.toDF(*names).withColumn("_words", words(text))
    df = df.withColumn("_chars", F.length(F.array_join("_words", "")))
    # Each step works on the little that the last one left; white space goes with the first.
    df = df.withColumn("_left0", F.regexp_replace(text, "[a-z\\x20\\x09-\\x0D]+", ""))
    for k, pattern in enumerate(CLASSES):
        df = df.withColumn(f"_left{k + 1}", F.regexp_replace(f"_left{k}", pattern, ""))
    sizes = [F.col("_chars"), *(F.length(f"_left{k}") for k in range(len(CLASSES) + 1))]
    sizes = [a - b for a, b in zip(sizes, [*sizes[1:], F.lit(0)], strict=True)]
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    at = lambda i, k: F.get(F.col("_hashes"), i + k)
    hashed = F.transform("_hashes", lambda h, i: F.xxhash64(h, *(at(i, k) for k in range(1, window))))
    count = F.size("_words")
    df = df.withColumn("_windows", F.slice(hashed, F.lit(1), F.greatest(count - (window - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_order", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_found", _repeated(F.col("_order")))
    df = df.withColumn("_common", F.filter("_words", lambda w: w.isin(*COMMON_WORDS)))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
    df = df.withColumn("_lines", lines)
    counted = F.transform(F.array(*map(F.lit, COMMON_WORDS)), lambda w: F.size("_common") - F.size(F.array_remove(F.col("_common"), w)))
    share = lambda counts, total: F.transform(counts, lambda c: c / F.greatest(total, F.lit(1)))
    quality = F.struct(
        F.col("_chars").cast("long").alias("word_chars"),
        count.cast("long").alias("n_words"),
        (F.length("_left0") - F.length(F.regexp_replace("_left0", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("_found"), window), F.lit(0)).cast("long").alias("n_repeat_words"),
        share(F.array(*sizes), F.col("_chars")).alias("classes"),
        share(F.concat(counted, F.array(count - F.size("_common"))), count).alias("commons"),
    )
    return finished(df, docs.columns, names, {"quality": quality})


def _neighbours(array: Column, with_next) -> Column:
    n = F.size(array) - 1
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(2), n), with_next)


def _repeated(order: Column) -> Column:
    """Starts of windows whose hash another window of the row has, from the ordered (hash, start)."""
    pairs = _neighbours(order, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))


def _covered(found: Column, window: int) -> Column:
    """Words under windows that begin at the given ascending starts."""
    gaps = _neighbours(found, lambda a, b: F.least(b - a, F.lit(window)))
    return F.aggregate(gaps, F.lit(window), lambda total, g: total + g)


def base_failed(quality: str = "quality") -> Column:
    q = F.col(quality)
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def references(measured: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Median histograms per language with enough documents."""
    q = F.col("quality")
    full = measured.where(F.col("lang").isNotNull() & ~base_failed() & (q["word_chars"] >= min_chars) & (q["n_words"] >= min_words))
    of = F.col("lang").alias("of")
    widths = {"classes": len(CLASSES) + 2, "commons": len(COMMON_WORDS) + 1}
    flat = full.select(of, *((F.round(q[h][i] * GRID) / GRID).alias(f"{h}{i}") for h, n in widths.items() for i in range(n)))
    medians = [F.percentile(f"{h}{i}", 0.5).alias(f"{h}{i}") for h, n in widths.items() for i in range(n)]
    middle = flat.groupBy("of").agg(F.count("*").alias("n"), *medians).where(F.col("n") >= min_docs)
    even = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda t, y: t + y))
    return middle.select("of", *(even(F.array(*(f"{h}{i}" for i in range(n)))).alias(f"ref_{h}") for h, n in widths.items()))


def distance(p: Column, r: Column) -> Column:
    """Jensen-Shannon distance: root of the divergence in bits, 0 to 1."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, r, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda t, x: t + x)))


def judge(measured: DataFrame, refs: DataFrame, far_classes: float = FAR_CLASSES, odd_classes: float = ODD_CLASSES, odd_words: float = ODD_WORDS) -> DataFrame:
    """Adds ``base_failed``, ``class_distance``, ``word_distance`` (null where guarded or without a reference) and ``kept``."""
    added = ("base_failed", "class_distance", "word_distance", "kept")
    names, q = inner_names(measured.columns, "lang", "quality"), F.col("quality")
    # As many rows as languages: broadcast by their size as written, not by a hint.
    joined = measured.toDF(*names).join(refs, F.col("lang") == F.col("of"), "left")
    judged = joined.select(
        *names,
        base_failed().alias("base_failed"),
        F.when(F.col("of").isNotNull() & (q["word_chars"] >= MIN_CHARS), distance(q["classes"], F.col("ref_classes"))).alias("class_distance"),
        F.when(F.col("of").isNotNull() & (q["n_words"] >= MIN_WORDS), distance(q["commons"], F.col("ref_commons"))).alias("word_distance"),
    )
    classes, commons = (F.coalesce(F.col(f"{c}_distance"), F.lit(0.0)) for c in ("class", "word"))
    far = (classes > far_classes) | ((classes > odd_classes) & (commons > odd_words))
    return finished(judged.withColumn("kept", ~F.col("base_failed") & ~far), measured.columns, names, {a: F.col(a) for a in added})


def verdicts(docs: DataFrame, texts: bool = False) -> DataFrame:
    """``docs`` (without ``text`` unless asked for) with ``quality`` and the verdict's parts.

    Features are written once; references and verdicts both read them."""
    names = inner_names(docs.columns, "doc_id", "lang", "text")
    measured = features(docs.toDF(*names))
    measured = cut(measured if texts else measured.drop("text"))
    judged = judge(measured, cut(references(measured)))
    added = [c for c in judged.columns if c not in names]
    shown = [(c, i) for c, i in zip(docs.columns, names, strict=True) if texts or i != "text"]
    return finished(judged, [c for c, _ in shown], [i for _, i in shown], {a: F.col(a) for a in added})


def quality_rules(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass. Texts are written beside their features, so that no
    text is shuffled or joined back, however many rows go."""
    names = inner_names(docs.columns, "doc_id", "lang", "text")
    return finished(verdicts(docs.toDF(*names), texts=True).where("kept"), docs.columns, names)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verdicts(docs.select("doc_id", "lang", "text")).select("doc_id", *(F.col(f"quality.{c}") for c in COUNTS), "base_failed", "kept",
        *(F.round(c, 6).alias(c) for c in ("class_distance", "word_distance")))


def _distance_sql(p: str, r: str) -> str:
    term = f"CASE WHEN {{0}} > 0 THEN {{0}} * log2({{0}} / (({p}[i] + {r}[i]) / 2)) ELSE 0 END"
    parts = f"({term.format(f'{p}[i]')} + {term.format(f'{r}[i]')}) / 2"
    return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {parts}))))"


_LIST = ", ".join(f"'{w}'" for w in COMMON_WORDS)
OP10_SQL = (
    r"""
WITH parsed AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + 4], ' ')) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM parsed WHERE len(w) >= 5)),
covered AS (
  SELECT doc_id, sum(least(5, following - i)) AS n
  FROM (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 5) AS following FROM windows WHERE n > 1) GROUP BY 1),
counted AS (
  SELECT p.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         [len(regexp_extract_all(t, '[a-z]')), len(regexp_extract_all(t, '[A-Z]')), len(regexp_extract_all(t, '[0-9]')),
          len(regexp_extract_all(t, '[.,;:!?''"()-]')), len(regexp_extract_all(t, '[#$%&*+/<=>@\[\]\\^_`{|}~]'))] AS five,
         list_transform([COMMON], lambda x: len(list_filter(w, lambda y: y = x))) AS common
  FROM parsed p LEFT JOIN covered c USING (doc_id)),
shares AS (
  SELECT * EXCLUDE (five, common), list_transform(list_append(five, word_chars - list_sum(five)), lambda x: x / greatest(word_chars, 1)) AS classes,
         list_transform(list_append(common, n_words - list_sum(common)), lambda x: x / greatest(n_words, 1)) AS commons,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM counted),
many AS (SELECT * FROM shares WHERE lang IS NOT NULL AND NOT base_failed AND word_chars >= 200 AND n_words >= 50),
enough AS (SELECT lang FROM many GROUP BY 1 HAVING count(*) >= 10),
middle AS (
  SELECT lang, kind, i, median(round(1000 * x) / 1000) AS m
  FROM (SELECT lang, 'classes' AS kind, unnest(classes) AS x, unnest(range(len(classes))) AS i FROM many
        UNION ALL SELECT lang, 'commons', unnest(commons), unnest(range(len(commons))) FROM many) JOIN enough USING (lang) GROUP BY 1, 2, 3),
refs AS (SELECT lang, kind, list(m / total ORDER BY i) AS r FROM (SELECT *, sum(m) OVER (PARTITION BY lang, kind) AS total FROM middle) GROUP BY 1, 2),
judged AS (
  SELECT s.*, CASE WHEN word_chars >= 200 AND a.r IS NOT NULL THEN CLASSES END AS class_distance, CASE WHEN n_words >= 50 AND b.r IS NOT NULL THEN WORDS END AS word_distance
  FROM shares s LEFT JOIN refs a ON a.lang = s.lang AND a.kind = 'classes' LEFT JOIN refs b ON b.lang = s.lang AND b.kind = 'commons')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (coalesce(class_distance, 0) > 0.35 OR (coalesce(class_distance, 0) > 0.2 AND coalesce(word_distance, 0) > 0.25)) AS kept,
       round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM judged
""".replace("COMMON]", f"{_LIST}]").replace("THEN CLASSES", f"THEN {_distance_sql('classes', 'a.r')}").replace("THEN WORDS",
    f"THEN {_distance_sql('commons', 'b.r')}")
)
