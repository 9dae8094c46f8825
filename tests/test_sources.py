"""Source trees, ignore rules, logs, registries and index tables."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.chunkers import registry
from quarry.sources import config, store, tree
from quarry.streaming import calls


def write(root, **files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")


def paths(files):
    return [r["file_path"] for r in tree.listing(files).collect()]


def test_walk_skips_folders_suffixes_and_sizes(spark, tmp_path):
    write(tmp_path, **{"main.go": "package m\n", "b/x.PY": "x = 1\n", ".venv/y.py": "", "build/y.py": "", "web/node_modules/z.js": "", "a.txt": "no", "big.py": "x" * ((1 << 20) + 1), "edge.py": "x" * (1 << 20)})
    assert paths(tree.source_files(spark, str(tmp_path))) == ["b/x.PY", "edge.py", "main.go"]


def test_names_that_readers_pass_over(spark, tmp_path):
    write(tmp_path, **{"p/__init__.py": "a = 1", "__tests__/deep/b.js": "c", ".github/ci.yml": "on: x", ".git/config.py": "", "_notes.txt": "", "p/q.py": "", tree.IGNORE_FILE: "_skip.py\n", "_skip.py": "", "é/ü.py": "x = 'ö'"})
    files = tree.source_files(spark, str(tmp_path))
    assert paths(files) == [".github/ci.yml", "__tests__/deep/b.js", "p/__init__.py", "p/q.py", "é/ü.py"]
    assert {r["file_path"]: r["content"] for r in files.collect()}["p/__init__.py"] == "a = 1"


def test_paths_are_relative_to_the_root_alone(spark, tmp_path):
    root = tmp_path / "q"
    write(root, **{"y.py": "a = 1", "tmp/j/q/y.py": "b = 1"})
    assert paths(tree.source_files(spark, str(root))) == ["tmp/j/q/y.py", "y.py"]
    assert paths(tree.source_files(spark, str(root) + "/")) == ["tmp/j/q/y.py", "y.py"]


def test_ignore_file(spark, tmp_path):
    rules = "# comment\n\nsample/\ndocs/internal\n  fixtures  \n*.min.js\n/lib\nonly/\n[ab]x.py\n"
    files = ["main.go", "sample/x.go", "web/sample/x.go", "docs/internal/a.go", "docs/internal.go", "docs/other/internal/b.go", "p/fixtures/c.go", "fixtures/d.go", "web/a.min.js", "web/amin.js", "lib/x.go", "p/only/e.go", "p/ax.py", "p/cx.py"]
    write(tmp_path, **{tree.IGNORE_FILE: rules}, **dict.fromkeys(files, "x"))
    assert paths(tree.source_files(spark, str(tmp_path))) == sorted(["main.go", "docs/internal.go", "docs/other/internal/b.go", "web/amin.js", "lib/x.go", "p/cx.py"])
    assert len(paths(tree.source_files(spark, str(tmp_path), rules=[]))) == len(files)


def test_folders_logs_and_questions(spark, tmp_path):
    write(tmp_path, **{"b/x": "", ".h/x": "", "a/x": "", "f": ""})
    assert tree.sub_folders(str(tmp_path)) == ["a", "b"]
    good = {"ts": "2024-01-02T03:04:05Z", "tool": "search_code", "args": "{}", "latency_ms": 5, "response_bytes": 40, "scores": [0.5]}
    write(tmp_path, **{"log.jsonl": json.dumps(good) + "\n\n  \n{broken\n" + json.dumps({"tool": "ping"}) + "\n"})
    rows = tree.call_log(spark, str(tmp_path / "log.jsonl")).orderBy("tool").collect()
    assert [r["tool"] for r in rows] == ["ping", "search_code"] and rows[1]["latency_ms"] == 5 and rows[1]["ts"].year == 2024
    tree.append_calls(tree.call_log(spark, str(tmp_path / "log.jsonl")), str(tmp_path / "out"))
    assert tree.call_log(spark, str(tmp_path / "out")).count() == 2
    write(tmp_path, **{"golden.json": json.dumps({"questions": [{"id": "q1", "question": "where", "question_lang": "en", "type": "semantic", "language": "go", "expected_files": ["a.go"], "expected_symbols": []}]}, indent=1)})
    assert tree.golden_questions(spark, str(tmp_path / "golden.json")).first()["expected_files"] == ["a.go"]


def test_registry(tmp_path):
    path = str(tmp_path / "deep" / "projects.json")
    assert config.load_registry(path) == []
    some = [config.Project("Api", "/srv/api", "t"), config.Project("web", "/srv/web")]
    config.save_registry(path, some, "web")
    assert config.load_registry(path) == some and not [p for p in (tmp_path / "deep").iterdir() if p.suffix == ".tmp"]
    config.write_json(path, {"projects": [{"path": "C:\\Users\\me\\pnodes"}, {"path": "/srv/front/", "name": ""}, {"path": ""}]})
    assert [p.name for p in config.load_registry(path)] == ["pnodes", "front", "project"]
    (tmp_path / "bad.json").write_text("{no")
    with pytest.raises(ValueError, match="not JSON"):
        config.merge_entry(str(tmp_path / "bad.json"), "servers", "us", {})
    assert (tmp_path / "bad.json").read_text() == "{no"
    config.write_json(str(tmp_path / "theirs.json"), {"other": 1, "servers": {"them": {"a": 1}}})
    config.merge_entry(str(tmp_path / "theirs.json"), "servers", "us", {"url": "x"})
    assert config.read_json(str(tmp_path / "theirs.json")) == {"other": 1, "servers": {"them": {"a": 1}, "us": {"url": "x"}}}


@pytest.mark.parametrize("asked, default, found", [("Api", "", 0), ("aPI", "", 0), ("/srv/web/", "", 1), (" web ", "", 1), ("", "web", 1), ("", "", 0), ("", "ghost", 0), ("nobody", "web", None)])
def test_find_project(asked, default, found):
    some = [config.Project("Api", "/srv/api"), config.Project("web", "/srv/web")]
    assert config.find_project(some, asked, default) == (None if found is None else some[found])
    assert config.find_project([], asked, default) is None


def files_of(spark, **files):
    rows = spark.createDataFrame([(p.replace("__", "/"), t) for p, t in files.items()], "file_path string, content string")
    return rows.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))


def test_incremental_update(spark, tmp_path):
    at, seen = store.Store(spark, str(tmp_path)), []
    one, two = {"a.py": "def f():\n    pass\n", "b.py": "def g():\n    pass\n"}, {"a.py": "def f():\n    return 1\n", "c.py": "x = 1\n"}
    run = lambda files, **more: at.update("/srv/p", files_of(spark, **files), log=seen.append, **more)
    assert run(one) == store.Stats(2, 2, 2, 0, 0)
    assert run(one) == store.Stats(2, 2, 0, 2, 0)
    assert run(one | two) == store.Stats(3, 3, 2, 1, 0)
    assert run({"c.py": "x = 1\n"}) == store.Stats(1, 1, 0, 1, 2)
    chunks, files = at.read("/srv/p")
    assert [r["chunk_id"] for r in chunks.collect()] == ["c.py:1:x"] and files.count() == 1
    # Another version of the chunkers keeps nothing.
    assert run({"c.py": "x = 1\n"}, version=registry.VERSION + 1) == store.Stats(1, 1, 1, 0, 0)
    assert at.meta("/srv/p")["chunker_version"] == registry.VERSION + 1 and at.meta("/srv/none") == {} and at.read("/srv/none")[0].count() == 0
    assert len([p for p in (tmp_path / store.project_key("/srv/p")).iterdir() if p.is_dir()]) == 1


def test_update_goes_on_after_a_stop(spark, tmp_path):
    at, asked, seen = store.Store(spark, str(tmp_path)), [], []
    many = {f"f{k}.py": f"x{k} = 1\n" for k in range(12)}

    def stop():
        asked.append(1)
        return len(asked) > 2

    with pytest.raises(store.Aborted):
        at.update("/p", files_of(spark, **many), commit=3, abort=stop)
    assert at.read("/p")[0].count() == 0
    assert at.update("/p", files_of(spark, **many), commit=3, log=seen.append) == store.Stats(12, 12, 12, 0, 0)
    assert sum("written before" in line for line in seen) == 2


def test_projects_are_apart_and_old_tables_move(spark, tmp_path):
    at = store.Store(spark, str(tmp_path))
    row = lambda p, i, n: (p, i, "a.py", "python", n, n, "x", "var", "", "", "x = 1", "h")
    legacy = spark.createDataFrame([row("/one", "a.py:1:x", 1), row("/one", "a.py:1:x", 2), row("/two", "a.py:1:x", 1)], "project string, " + registry.SCHEMA)
    assert at.migrate(legacy) == ["/one", "/two"]
    assert [r["start_line"] for r in at.read("/one")[0].collect()] == [1] and at.read("/two")[0].count() == 1
    at.rewrite("/one", at.read("/two")[0].limit(0), at.read("/two")[1].limit(0))
    assert at.read("/one")[0].count() == 0 and at.read("/two")[0].count() == 1 and at.migrate(legacy) == ["/one", "/two"] and at.read("/one")[0].count() == 0
    assert spark.range(1).select(store.project_key_column(F.lit("/one"))).first()[0] == store.project_key("/one")


def test_other_formats(spark, tmp_path):
    whole = {"project_root": "/p", "chunker_version": 6, "manifest": {"a.go": "h"}, "chunks": [{"id": "a.go:1:F", "file_path": "a.go", "language": "go", "start_line": 1, "end_line": 2, "symbol_name": "F", "kind": "func", "content": "c", "hash": "h"}]}
    write(tmp_path, **{"index.json": json.dumps(whole, indent=1)})
    meta, chunks, files = store.read_json_index(spark, str(tmp_path / "index.json"))
    assert meta == {"project_root": "/p", "chunker_version": 6} and chunks.first()["doc"] == "" and chunks.first()["chunk_id"] == "a.go:1:F" and tuple(files.first()) == ("a.go", "h")


def test_relational_index(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url, project = "jdbc:derby:memory:quarry;create=true", "/srv/o'ne"
    put = lambda rows, schema, table, kinds: spark.createDataFrame(rows, schema).write.option("createTableColumnTypes", kinds).jdbc(url, table)
    put([(project, "project_root", project), (project, "chunker_version", "6"), ("/other", "chunker_version", "5")], "project string, key string, value string", "meta", "project VARCHAR(99), key VARCHAR(99), value VARCHAR(99)")
    put([("a.py:1:x", "a.py", 1)], "id string, file_path string, start_line int", f"chunks_{store.project_key(project)}", "id VARCHAR(99), file_path VARCHAR(99)")
    meta, chunks = store.read_jdbc_index(spark, url, project)
    assert meta == {"project_root": project, "chunker_version": "6"} and tuple(chunks.first()) == ("a.py:1:x", "a.py", 1)


def test_needed_passages(spark):
    chunks = spark.createDataFrame([("a", "h", "f", "", "doc", "body"), ("b", "h", "g", "sig", "", "x" * 50), ("c", "h2", "h", "", "", ""), ("d", "h", "i", "", "", "y")], "chunk_id string, hash string, symbol_name string, signature string, doc string, content string")
    old = spark.createDataFrame([("b", "h", False), ("c", "h", True), ("d", "h", True)], "chunk_id string, hash string, has_vector boolean")
    got = store.need_passages(chunks.coalesce(1), old).collect()
    assert {r["chunk_id"]: r["passage"] for r in got} == {"c": "h\n", "a": "f\ndoc\nbody\n", "b": "g\nsig\n" + "x" * 50 + "\n"}


def test_arrivals_replace(spark, tmp_path):
    at, incoming = store.Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    put = lambda **f: files_of(spark, **f).select("file_path", "content").coalesce(1).write.mode("append").parquet(incoming)
    put(**{"a.py": "x = 1\n", "b.py": "y = 1\n"})
    calls.index_arrivals(spark, incoming, at, "/p", str(tmp_path / "state"))
    put(**{"a.py": "x = 1\nz = 2\n"})
    calls.index_arrivals(spark, incoming, at, "/p", str(tmp_path / "state"))
    calls.index_arrivals(spark, incoming, at, "/p", str(tmp_path / "other"))
    assert sorted(r["chunk_id"] for r in at.read("/p")[0].collect()) == ["a.py:1:x", "a.py:2:z", "b.py:1:y"]


def test_no_local_folder_on_a_cluster():
    from quarry.session import shared_folder

    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({f"spark.{k}": v for k, v in values.items()})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session(master="yarn"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session(master="local-cluster[2,1,1024]"))
