"""Chunkers over our own small files; native forms agree with the Python ones."""

import pytest

from quarry.chunkers import registry, spans
from quarry.plans import fixtures


def kinds(path, text=None):
    return [(r["symbol_name"], r["kind"], r["start_line"], r["end_line"]) for r in registry.chunk_text(path, fixtures.FILES[path] if text is None else text)]


def test_go():
    assert kinds("shop/basket.go") == [("ErrNoLines", "var", 5, 6), ("Basket", "type", 8, 11), ("Add", "method", 13, 18), ("New", "func", 20, 20)]


def test_vue_and_python():
    assert ("CartView", "component", 6, 12) in kinds("web/CartView.vue") and ("template", "template", 1, 3) in kinds("web/CartView.vue")
    assert [k[:2] for k in kinds("tax/rates.py")] == [("module", "module"), ("STANDARD", "var"), ("rate_for", "func"), ("Table", "class")]


def test_javascript():
    text = "const a = 1;\nconst b = {\n  c: {\n  },\n};\nfunction f()\n{\n  if (x) {\n  }\n}\nexport async function g(x) { return 1; }\nlet z =\n  5\n"
    assert kinds("x.ts", text) == [("a", "var", 1, 1), ("b", "var", 2, 5), ("f", "func", 6, 10), ("g", "func", 11, 11), ("z", "var", 12, 12)]


def test_qml():
    text = "// Panel of counts.\nPanel {\n  property int count: 0\n  function f() {\n  }\n}\nfunction g()\n// far\n{\n}\nsignal done(int x)\nproperty var p: {\n}\nproperty int q: 0; // {\n"
    assert kinds("x.qml", text) == [("Panel", "component", 2, 6), ("g", "function", 7, 7), ("done", "signal", 11, 13), ("q", "property", 14, 14)]
    assert registry.chunk_text("x.qml", text)[0]["doc"] == "Panel of counts."


def test_settings_and_styles():
    assert kinds("conf/app.json") == [("server", "key", 2, 4), ("tags", "key", 5, 7)]
    assert kinds("a.json", '{"b": 1, "c": [2]}') == [("b", "key", 1, 1), ("c", "key", 1, 1)]
    assert kinds("conf/app.yaml") == [("server", "key", 1, 2), ("client", "key", 3, 5)]
    assert kinds("conf/app.toml") == [("server", "section", 1, 2), ("routes", "section", 3, 5)] and kinds("conf/app.ini") == [("main", "section", 1, 2), ("other", "section", 3, 5)]
    assert kinds("css/site.css") == [("body", "rule", 1, 3), (".a, .b", "rule", 4, 4)]
    assert kinds("bin/run.sh") == [("start", "function", 1, 3), ("stop", "function", 4, 7)]


def test_html_blocks_want_whole_tags():
    text = "<divider>\n<styled-x>\n<p>x</p>\n<DIV class='a'>\n<section/>\n<h1\tid=x>\n<article>\n<scripts>\n"
    assert kinds("x.html", text) == [("block@4", "block", 4, 4), ("block@5", "block", 5, 5), ("block@6", "block", 6, 6), ("block@7", "block", 7, 9)]
    assert all(r["signature"] == "" for r in registry.chunk_text("x.html", text))


def test_whole_files_and_windows():
    assert [(s.start, s.end) for s in spans.windows("x", [""] * 201)] == [(1, 60), (51, 110), (101, 160), (151, 201)]
    rows = registry.chunk_text("notes.txt", fixtures.FILES["notes.txt"])
    assert [(r["kind"], r["start_line"], r["end_line"]) for r in rows] == [("file", 1, 131), ("window", 1, 60), ("window", 51, 110), ("window", 101, 131)]
    assert rows[1]["signature"] == "notes.txt lines 1-60" and kinds("broken.go", "not go at all\n")[0] == ("broken", "file", 1, 2)


@pytest.mark.parametrize("path, language", [("a/B.PY", "python"), ("x.tsx", "typescript"), ("y.htm", "html"), ("z.zsh", "shell"), ("w.less", "css"), ("v.unknown", "text"), ("Makefile", "text")])
def test_languages(spark, path, language):
    from pyspark.sql import functions as F

    assert spark.range(1).select(registry.language_column(F.lit(path))).first()[0] == language


def test_own_chunkers(spark):
    registry.register(".NOTE", lambda path, lines: [spans.Span(1, len(lines), "all", "note")], "note")
    try:
        files = spark.createDataFrame([("x.note", "a\nb"), ("a.py", "x = 1\nx = 1\n")], "file_path string, content string")
        got = {(r["chunk_id"], r["language"], r["kind"]) for r in registry.chunk_files(files).collect()}
        assert got == {("x.note:1:all", "note", "note"), ("a.py:1:x", "python", "var"), ("a.py:2:x", "python", "var")}
    finally:
        del registry.FINDERS[".note"], registry.LANGUAGES[".note"]


def test_native_forms_agree(spark):
    rows = [(p, t) for p, t in fixtures.FILES.items()] + [("one.txt", ""), ("sixty.txt", "x\n" * 59), ("b.html", "<divider>\n<Div\tx>\n<h7>\n<style>"), ("c.md", "#no\n#\tyes\n####### seven\n```\n# in code\n```")]
    files = spark.createDataFrame(rows, "file_path string, content string")
    native = {(r["file_path"], r["start_line"], r["end_line"]) for r in registry.window_chunks(files).collect()}
    assert native == {(p, s.start, s.end) for p, t in rows for s in spans.windows(p, spans.split_lines(t))}
    for frame, find in ((registry.markdown_chunks, spans.markdown), (registry.html_blocks, spans.html), (registry.section_chunks, spans.sections(spans.TOML_SECTION))):
        native = {(r["file_path"], r["start_line"], r["end_line"], r["symbol_name"], r["kind"]) for r in frame(files).collect()}
        assert native == {(p, s.start, s.end, s.name, s.kind) for p, t in rows for s in find(p, spans.split_lines(t))}
