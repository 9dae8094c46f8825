"""Files to chunks: a finder per extension, and native forms for the line-based ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.chunkers import spans as S
from quarry.functions.text import lines_of

VERSION = 1
SCHEMA = "chunk_id string, file_path string, language string, start_line int, end_line int, symbol_name string, kind string, signature string, doc string, content string, hash string"

# Finder and language label of each extension.
FINDERS: dict[str, S.Finder] = {
    ".go": S.go, ".py": S.python, ".js": S.javascript, ".jsx": S.javascript, ".ts": S.javascript, ".tsx": S.javascript, ".vue": S.vue, ".qml": S.qml,
    ".json": S.json_keys, ".md": S.markdown, ".yaml": S.yaml, ".yml": S.yaml, ".toml": S.sections(S.TOML_SECTION), ".ini": S.sections(S.INI_SECTION), ".cfg": S.sections(S.INI_SECTION),
    ".css": S.css, ".scss": S.css, ".less": S.css, ".html": S.html, ".htm": S.html, ".sh": S.shell, ".bash": S.shell, ".zsh": S.shell,
}
LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".vue": "vue", ".qml": "qml",
    ".json": "json", ".md": "markdown", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini", ".cfg": "ini",
    ".css": "css", ".scss": "css", ".less": "css", ".html": "html", ".htm": "html", ".sh": "shell", ".bash": "shell", ".zsh": "shell",
}
JS_LABEL = "js"


def extension(path: str) -> str:
    base = path.rsplit("/", 1)[-1]
    return "." + base.rsplit(".", 1)[-1].lower() if "." in base else ""


def register(suffix: str, finder: S.Finder, language: str) -> None:
    """Adds a chunker for files of one's own."""
    FINDERS[suffix.lower()], LANGUAGES[suffix.lower()] = finder, language


def language_column(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), suffix), F.lit("text"))


def chunk_text(path: str, text: str, finders: dict[str, S.Finder] | None = None, languages: dict[str, str] | None = None) -> list[dict]:
    """All chunks of a file; if only windows are found, the whole file leads as one chunk."""
    finders, languages = finders or FINDERS, languages or LANGUAGES
    lines, suffix = S.split_lines(text), extension(path)
    language = languages.get(suffix, "text")
    label = JS_LABEL if finders.get(suffix) is S.javascript else language
    found = finders[suffix](path, lines) if suffix in finders else []
    digest = hashlib.sha256(text.encode()).hexdigest()
    rows = [(label, s) for s in (found or S.windows(path, lines))]
    if not found:
        name = S.stem_of(path)
        rows.insert(0, (language, S.Span(1, len(lines), name, "file", name)))
    return [
        {"chunk_id": f"{path}:{s.start}:{s.name}", "file_path": path, "language": lang, "start_line": s.start, "end_line": s.end, "symbol_name": s.name, "kind": s.kind, "signature": s.signature, "doc": s.doc, "content": "\n".join(lines[s.start - 1 : s.end]), "hash": digest}
        for lang, s in rows
    ]


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of ``files`` (file_path, content). Equal ids keep the last by position."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    # Chunkers that were registered here travel along; executors know only the package's own.
    finders, languages = dict(FINDERS), dict(LANGUAGES)

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, t in zip(batch["file_path"], batch["content"], strict=True) for r in {x["chunk_id"]: x for x in chunk_text(p, t or "", finders, languages)}.values()]
            yield pd.DataFrame(rows, columns=columns).astype({"start_line": "int32", "end_line": "int32"})

    return files.select("file_path", "content").mapInPandas(chunked, SCHEMA)


def window_chunks(files: DataFrame, size: int = S.WINDOW, overlap: int = S.OVERLAP) -> DataFrame:
    """Native sliding windows: ``file_path, start_line, end_line, content``."""
    step = size - overlap
    lines = files.select("file_path", lines_of(F.col("content")).alias("lines"))
    last = F.greatest(F.lit(1), F.ceil((F.size("lines") - size) / step).cast("int") * step + 1)
    starts = lines.select("file_path", "lines", F.explode(F.sequence(F.lit(1), last, F.lit(step))).alias("start_line"))
    end = F.least(F.size("lines"), F.col("start_line") + size - 1)
    return starts.select("file_path", "start_line", end.alias("end_line"), F.array_join(F.slice("lines", F.col("start_line"), end - F.col("start_line") + 1), "\n").alias("content"))


def boundary_chunks(files: DataFrame, pattern: str, name: Column, kind: Column) -> DataFrame:
    """Native next-boundary segments: each matching line to the one before the next match.

    The window is over one file's matches only."""
    lines = files.select("file_path", F.size(lines_of(F.col("content"))).alias("n"), F.posexplode(lines_of(F.col("content"))).alias("pos", "line"))
    starts = lines.where(F.col("line").rlike(pattern)).withColumn("start_line", F.col("pos") + 1)
    following = F.lead("start_line").over(W.partitionBy("file_path").orderBy("start_line"))
    return starts.select("file_path", "start_line", F.coalesce(following - 1, F.col("n")).alias("end_line"), name.alias("symbol_name"), kind.alias("kind"))


def markdown_chunks(files: DataFrame) -> DataFrame:
    pattern = r"^(#{1,6})[\t\n\f\r ]+(.+)$"
    return boundary_chunks(files, pattern, F.trim(F.regexp_extract("line", pattern, 2)), F.concat(F.lit("h"), F.length(F.regexp_extract("line", pattern, 1)).cast("string")))


def html_blocks(files: DataFrame) -> DataFrame:
    return boundary_chunks(files, r"(?i)<(?:h[1-6]|section|article|script|style|div)(?:[\t\n\f\r ]|>|/)", F.concat(F.lit("block@"), (F.col("pos") + 1).cast("string")), F.lit("block"))


def section_chunks(files: DataFrame, pattern: str = r"^\[\[*([^\]]+)\]\]?") -> DataFrame:
    return boundary_chunks(files, pattern, F.trim(F.regexp_extract("line", pattern, 1)), F.lit("section"))
