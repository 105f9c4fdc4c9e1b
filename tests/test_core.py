"""Column functions, index operators and the engine, on small inputs with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from symbolith.engine import Engine, NotIndexed
from symbolith.functions import security, text
from symbolith.operators import hierarchy, index, outline, parse, retrieve, search, snapshots
from symbolith.sources import folder as folders
from symbolith.sources.store import checked_repo


def values(spark, column, rows, schema="a string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_languages(spark):
    paths = ["a.ts", "b.tsx", "c.js", "d.py", "e.go", "f.rs", "g.java", "h.cs", "i.c", "j.cpp", "k.dart", "l.swift", "m.md", "n.json", "o.txt", ".env", "x/A.TS", None]
    expected = ["typescript", "tsx", "javascript", "python", "go", "rust", "java", "csharp", "c", "cpp", "dart", "swift", None, None, None, None, "typescript", None]
    assert values(spark, text.language(F.col("a")), paths) == expected


def test_secret_and_binary_names(spark):
    secret = [".env", ".env.local", "id_rsa", "service-account.json", "secrets.json", "key.pem", "cert.key", "a/b/key.pem"]
    plain = ["index.ts", "main.go", "README.md", "config.json", "utils.py"]
    assert values(spark, security.secret_file(F.col("a")), secret + plain) == [True] * len(secret) + [False] * len(plain)
    binary = ["a.exe", "a.dll", "a.so", "a.png", "a.zip", "a.pyc", "a.wasm"]
    assert values(spark, security.binary_extension(F.col("a")), binary + ["a.ts", "a.json"]) == [True] * len(binary) + [False, False]


def test_exclude_reasons_in_order(spark):
    rows = [("../x.ts", False, 1, "a"), ("a.ts", True, 1, "a"), ("a.ts", False, 999, "a"), ("a.ts", False, 1, None), ("key.pem", False, 1, "a"), ("a.png", False, 1, "a"), ("a.ts", None, None, "a")]
    df = spark.createDataFrame(rows, "path string, link boolean, size long, content string")
    reason = security.exclude_reason(F.col("path"), F.col("link"), F.col("size"), F.col("content"), 100)
    assert [r[0] for r in df.select(reason).collect()] == ["path_traversal", "symlink_escape", "file_too_large", "unreadable", "secret_file", "binary_extension", None]


def test_ignore_patterns_last_match_decides(spark):
    patterns = ["*.log", "!keep.log", "build/", "/top.txt", "a/**/z.ts"]
    paths = ["x.log", "d/keep.log", "build/x.ts", "src/build/x.ts", "top.txt", "d/top.txt", "a/b/c/z.ts", "a/z.ts", "b/z.ts"]
    assert values(spark, security.ignored(F.col("a"), patterns), paths) == [True, False, True, True, True, False, True, True, False]


def test_globs():
    import re

    assert re.search(text.glob_to_regex("*.min.js", True), "a.min.js") and not re.search(text.glob_to_regex("*.min.js", True), "a.min.jsx")
    assert re.search(text.glob_to_regex("src/*.ts", False), "x/src/a/b.ts")


def test_numbered_answers_and_summaries(spark):
    assert values(spark, text.numbered_answers(F.col("a")), ["1. one\nnoise\n2.two\n 3. three", "", None]) == [["one", "two", "3. three"], [], None]
    docs = ["/** Adds two numbers. And more. */", "# short", "", None]
    assert values(spark, text.docstring_summary(F.col("a")), docs) == ["Adds two numbers.", None, None, None]
    assert values(spark, text.tokens_saved(F.lit(4000), F.lit(0)), ["x"]) == [1000]
    assert values(spark, text.tokens_saved(F.lit(100), F.lit(200)), ["x"]) == [0]


def test_repository_addresses(spark):
    urls = ["https://github.com/o/n", "https://github.com/o/n.git", "git@github.com:o/n.git", "github.com/o/n/", "o/n", "o", ""]
    assert values(spark, text.repository_of(F.col("a")), urls) == ["o/n"] * 5 + [None, None]


def test_byte_slices_of_wide_characters(spark):
    df = spark.createDataFrame([("é→x", 2, 3), ("é→x", 1, 2)], "c string, o long, n long")
    assert [r[0] for r in df.select(text.byte_text(F.col("c"), F.col("o"), F.col("n"))).collect()] == ["→", "\ufffd\ufffd"]


def test_detect_changes_and_merge(spark):
    schema = "repo string, path string, digest string"
    old = spark.createDataFrame([("r", "same.ts", "abc"), ("r", "changed.ts", "old"), ("r", "deleted.ts", "xyz")], schema)
    new = spark.createDataFrame([("r", "same.ts", "abc"), ("r", "changed.ts", "new"), ("r", "added.ts", "123")], schema)
    changes = index.detect_changes(old, new)
    assert {(r["path"], r["change"]) for r in changes.collect()} == {("changed.ts", "changed"), ("added.ts", "added"), ("deleted.ts", "deleted")}
    rows = "repo string, file string, id string"
    was = spark.createDataFrame([("r", f, "old " + f) for f in ("same.ts", "changed.ts", "deleted.ts")], rows)
    now = spark.createDataFrame([("r", f, "new " + f) for f in ("same.ts", "changed.ts", "added.ts")], rows)
    assert {r["id"] for r in index.merge_symbols(was, now, changes).collect()} == {"old same.ts", "new changed.ts", "new added.ts"}
    assert index.detect_changes(old.limit(0), new.limit(0)).count() == 0


def test_overloads_are_numbered_in_order(spark):
    rows = spark.createDataFrame([("r", "f", i, "A.m", "method", i) for i in range(3)] + [("r", "f", 9, "A.n", "method", 9)], "repo string, file string, id long, qualified_name string, kind string, symbol_seq long")
    found = {r["id"]: r["own_id"] for r in index.disambiguated(rows).collect()}
    assert found == {0: "f::A.m#method~1", 1: "f::A.m#method~2", 2: "f::A.m#method~3", 9: "f::A.n#method"}


def symbol_rows(spark):
    rows = [("r", "a", "load", "load", "def load()", None, None, None), ("r", "b", "loader", "X.loader", "x", None, None, ["k"]), ("r", "c", "preload", "p", "x", None, None, None), ("r", "d", "z", "z", "z", "loads it", None, None), ("r", "e", "q", "q", "q", None, "to load", None)]
    return spark.createDataFrame(rows, "repo string, id string, name string, qualified_name string, signature string, summary string, docstring string, keywords array<string>").withColumn("kind", F.lit("function")).withColumn("language", F.lit("go")).withColumn("file", F.lit("f.go"))


def test_search_ranks_by_place(spark):
    found = search.search_symbols(symbol_rows(spark), "LOAD").collect()
    assert [(r["id"], r["score"]) for r in found] == [("a", 20), ("b", 15), ("c", 10), ("d", 5), ("e", 1)]
    assert search.search_symbols(symbol_rows(spark), "", limit=3).count() == 3
    assert search.search_symbols(symbol_rows(spark), "load", kind="class").count() == 0
    with pytest.raises(ValueError):
        search.search_symbols(symbol_rows(spark), "x", limit=0)


def file_rows(spark, rows):
    df = spark.createDataFrame(rows, "repo string, path string, content string")
    return df.withColumn("language", text.language(F.col("path"))).withColumn("file_seq", F.xxhash64("path")).withColumn("size_bytes", F.octet_length("content").cast("long")).withColumn("content_hash", F.sha2("content", 256))


def test_text_search_and_context(spark):
    files = file_rows(spark, [("r", "a.go", "one\r\nTwo\nthree"), ("r", "b.go", ""), ("r", "c.go", None)])
    assert [(r["line"], r["text"]) for r in search.search_text(files, "two").collect()] == [(2, "Two")]
    assert search.search_text(files, "absent").count() == 0
    assert search.search_text(files, "t", "b.go").count() == 0
    symbols = spark.createDataFrame([("r", "s", "a.go", 2, 2)], "repo string, id string, file string, line int, end_line int")
    got = retrieve.with_context(symbols, files, 5).first()
    assert (got["context_before"], got["context_after"]) == ("one\r", "three")


def test_file_tree_prefix_is_by_parts(spark):
    files = file_rows(spark, [("r", "src/tools/a.go", "x"), ("r", "src/to.go", "x"), ("r", "b.md", "x")])
    symbols = spark.createDataFrame([("r", "src/tools/a.go")], "repo string, file string")
    tree = {r["path"]: r for r in outline.file_tree(files, symbols).collect()}
    assert set(tree) == {"src", "src/tools", "src/tools/a.go", "src/to.go", "b.md"}
    assert tree["src/tools/a.go"]["symbol_count"] == 1 and tree["src"]["type"] == "dir" and tree["src/tools"]["parent"] == "src"
    assert outline.file_tree(files, symbols, "src/to").count() == 0


SNIPPETS = {
    "m.ts": ("export function add(a: number): number { return a; }\nclass Calculator {\n  multiply(a: number): number {\n    return a;\n  }\n}\n", {("add", "function"), ("Calculator", "class"), ("Calculator.multiply", "method")}),
    "m.py": ("class A:\n    def f(self):\n        'doc'\n        return 1\n\n@dec\ndef g(): pass\n", {("A", "class"), ("A.f", "function"), ("g", "function")}),
    "m.go": ("package a\n\n// F does it.\nfunc F() {}\n\ntype S struct {\n}\n\nfunc (s *S) M() int {\n\treturn 1\n}\n", {("F", "function"), ("S", "class"), ("M", "method")}),
    "m.rs": ("pub struct P { x: u8 }\nimpl P {\n    /// x\n    fn get(&self) -> u8 { self.x }\n}\nfn free() {}\n", {("P", "type"), ("P", "class"), ("P::get", "function"), ("free", "function")}),
    "m.java": ("class J {\n  @Override\n  public int f(int a) {\n    return a;\n  }\n}\n", {("J", "class"), ("J.f", "method")}),
    "m.cs": ("public class K\n{\n  private int F(int a)\n  {\n    return a;\n  }\n}\n", {("K", "class"), ("K.F", "method")}),
    "m.c": ('struct s { int a; };\n/* doc */\nint main(int argc) {\n  char *x = "}";\n  return 0;\n}\n', {("s", "type"), ("main", "function")}),
    "m.js": ("// é→\nfunction f(a) { return a; }\nconst g = (x) => x;\n", {("f", "function"), ("g", "function")}),
    "m.php": ("<?php\nclass P { function m() { return 1; } }\n", {("P", "class"), ("P.m", "method")}),
    "m.dart": ("class D {\n}\nenum E { a }\nmixin M {\n}\nint f(int a) {\n  return a;\n}\n", {("D", "class"), ("E", "type"), ("M", "class"), ("f", "function")}),
    "m.swift": ("func f() -> Int { return 1 }\nclass A {\n}\nstruct S {\n}\nprotocol P {\n}\n", {("f", "function"), ("A", "class"), ("S", "class"), ("P", "interface")}),
}


def test_parsing_by_language(spark):
    files = file_rows(spark, [("r", p, t) for p, (t, _) in SNIPPETS.items()] + [("r", "bad.py", "def (:"), ("r", "empty.go", ""), ("r", "null.go", None)])
    rows = parse.parsed(files).collect()
    for path, (content, expected) in SNIPPETS.items():
        own = [r for r in rows if r["file"] == path]
        assert {(r["qualified_name"], r["kind"]) for r in own} == expected, path
        for r in own:
            piece = content.encode()[r["byte_offset"] : r["byte_offset"] + r["byte_length"]].decode()
            assert r["name"] in piece and piece.split("\n")[0] in content.split("\n")[r["line"] - 1]
    assert not [r for r in rows if r["file"] in ("bad.py", "empty.go", "null.go")]
    source = retrieve.with_source(parse.parsed(files), files)
    assert source.where("NOT content_verified").count() == 0


def test_engine_incremental_equals_full(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    for name, content in (("src/a.py", "def one():\n    return 1\n"), ("src/b.go", "package b\n\nfunc Two() {}\n"), ("node_modules/x.js", "function no() {}\n"), ("notes.txt", "x"), (".gitignore", "gen.py\n"), ("gen.py", "def gen(): pass\n")):
        (root / name).write_text(content)
    engine = Engine(spark, str(tmp_path / "store"))
    first = engine.index_folder(str(root))
    assert first["repo"] == "local/proj" and first["files"] == 2 and first["symbols"] == 2
    assert engine.index_folder(str(root))["changes"] == {}
    (root / "src/a.py").write_text("def one():\n    return 2\n\ndef three():\n    pass\n")
    (root / "src/c.py").write_text("class C:\n    def m(self):\n        pass\n")
    (root / "src/b.go").unlink()
    assert engine.index_folder(str(root))["changes"] == {"changed": 1, "added": 1, "deleted": 1}
    step = {(r["id"], r["content_hash"]) for r in engine.store.read("symbols", "local/proj").collect()}
    other = Engine(spark, str(tmp_path / "full"))
    other.index_folder(str(root))
    assert step == {(r["id"], r["content_hash"]) for r in other.store.read("symbols", "local/proj").collect()}
    assert {r["name"] for r in engine.search_symbols("proj", "").collect()} == {"one", "three", "C", "m"}
    one = engine.get_symbol("proj", "src/a.py::one#function", context_lines=2).first()
    assert one["source"] == "def one():\n    return 2" and one["content_verified"] and one["context_after"] == "\ndef three():"
    both = engine.get_symbols("proj", ["src/a.py::three#function", "nope", "src/a.py::three#function"]).collect()
    assert [r["id"] is not None for r in both] == [True, False, True]
    assert {(r["id"], r["depth"]) for r in engine.file_outline("proj", "src/c.py").collect()} == {("src/c.py::C#class", 0), ("src/c.py::C.m#function", 1)}
    assert engine.search_text("proj", "RETURN").first()["path"] == "src/a.py"
    assert engine.list_repos().first()["symbol_count"] == 4
    engine.record_savings("t", "local/proj", 4000, 0)
    engine.record_savings("t", "local/proj", 1, 2)
    assert engine.total_saved() == 1000
    engine.invalidate("proj")
    with pytest.raises(NotIndexed):
        engine.search_symbols("local/proj", "x")
    for bad in ("../x", "a/../b", "noslash"):
        with pytest.raises(ValueError):
            checked_repo(bad)


def test_summaries_by_tier(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), lambda prompts: [f"made {len(prompts)}" for _ in prompts])
    rows = spark.createDataFrame([("given", "", "function", "f", "f()"), ("", "Tells a long story. More", "function", "g", "g()"), ("", "", "class", "h", "h")], "summary string, docstring string, kind string, name string, signature string")
    assert {r["name"]: r["summary"] for r in engine.summarized(rows).collect()} == {"f": "given", "g": "Tells a long story.", "h": "made 1"}
    engine.summarizer = None
    assert {r["summary"] for r in engine.summarized(rows.where("name = 'h'")).collect()} == {"Class 'h': h"}


def test_fetched_bodies(spark):
    rows = spark.createDataFrame([("a", "aGVs\nbG8="), ("b", ""), ("c", None)], "path string, encoded string")
    assert {r["path"]: (r["content"], r["fetch_status"]) for r in folders.fetched(rows).collect()} == {"a": ("hello", "ok"), "b": ("", "empty"), "c": (None, "failed")}
    tree = spark.createDataFrame([("src/a.ts", "s", 1, "u", "blob"), ("dist/b.ts", "s", 1, "u", "blob"), (".env.ts", "s", 1, "u", "blob"), ("c.ts", "s", 10**9, "u", "blob"), ("d", "s", None, "u", "tree")], folders.TREE)
    assert [r["path"] for r in folders.listed_tree(tree).collect()] == ["src/a.ts"]


def test_streams(spark, tmp_path):
    from symbolith.streaming import watch

    source = tmp_path / "in"
    engine = Engine(spark, str(tmp_path / "store"))
    rows = "repo string, path string, content string"
    spark.createDataFrame([("o/n", "a.py", "def f(): pass\n")], rows).write.parquet(str(source / "1"))
    spark.createDataFrame([("o/n", "a.py", "def f(): pass\n"), ("o/n", "b.py", "def g(): pass\n")], rows).coalesce(1).write.mode("append").parquet(str(source))
    watch.watch_files(engine, "o/n", str(source), str(tmp_path / "check")).awaitTermination(120)
    assert {r["name"] for r in engine.search_symbols("o/n", "").collect()} >= {"f", "g"}
    when = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, when + dt.timedelta(milliseconds=ms), 1, "x", 1.0, "") for i, ms in enumerate((0, 300, 2000))], watch.EVENTS)
    assert sorted(r["events"] for r in watch.bursts(events).collect()) == [1, 2]


# -- hierarchies and snapshots against brute force


def brute_places(links):
    out = {}
    for node in links:
        seen, at = [], node
        while at in links and links[at] is not None and links[at] in links and at not in seen:
            seen.append(at)
            at = links[at]
        looped = at in seen
        out[node] = ("on" if at == node else "below") if looped else ("root" if not seen else "inner", len(seen), at)
    return out


@pytest.mark.parametrize("shape", ["mixed", "chain", "star", "loops", "empty"])
def test_hierarchy_matches_brute_force(spark, shape):
    import random

    rng = random.Random(7)
    links = {
        "mixed": {i: (rng.randrange(60) if rng.random() < 0.8 else None) for i in range(60)} | {60: 999, 61: 61},
        "chain": {i: i - 1 if i else None for i in range(70)},
        "star": {i: 0 if i else None for i in range(50)},
        "loops": {i: (i + 1) % 7 for i in range(7)} | {7: 3, 8: 7, 9: 9},
        "empty": {},
    }[shape]
    rows = spark.createDataFrame([("r", i, p, "x", "clash") for i, p in links.items()] + [(None, 1, None, "x", ""), ("r", None, 1, "x", "")], "repo string, id long, parent long, v string, path string")
    placed = hierarchy.hierarchy(rows, ["repo"], "id", "parent", count=True)
    got = {}
    for r in placed.collect():
        got[r["id"]] = r["place"] if r["place"] in ("on", "below") else (r["place"], r["depth"], int(r["root"]))
        if r["path"]:
            assert [int(x) for x in r["path"]][-1] == r["id"] and len(r["path"]) == r["depth"] + 1
    assert got == brute_places(links)
    counted = {r["id"]: r["descendants"] for r in placed.collect()}
    pairs = {(int(r["id"]), int(r["descendant"])) for r in hierarchy.descendants(placed, ["repo"], "id").collect()}
    expected = set()
    for node, place in brute_places(links).items():
        at = node
        while not isinstance(place, str) and links.get(at) in links and links[at] is not None:
            at = links[at]
            expected.add((at, node))
    assert pairs == expected
    ended = {i for i, place in brute_places(links).items() if not isinstance(place, str)}
    assert counted == {i: sum(a == i for a, _ in expected) if i in ended else None for i in links}


def test_snapshot_changes(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    a, b = "AB" * 32, "cd" * 32
    files = spark.createDataFrame(
        [
            (1, "r", 1, "x", True, t(1), {"./a": a, "b": b}), (2, "r", 1, "x", True, t(2), {"a": a, "b": b}), (3, "r", 4, "x", False, t(9), {}), (4, "r", 4, "x", True, t(3), {"a": "sha256:" + a.lower(), "c": b}),
            (5, "r", 5, "x", True, t(4), {"a": b, "c": b}), (6, "r", 5, "y", True, t(4), None), (7, None, 5, "y", True, t(4), {"q": a}),
        ],
        "delivery_id long, repo string, snapshot_no int, shard string, complete boolean, delivered_at timestamp_ntz, file_hashes map<string,string>",
    )
    symbols = spark.createDataFrame([("r", 1, "s", a, t(1)), ("r", 4, "s", b, t(1)), ("r", 4, "s", a, t(2)), ("r", 4, "s", a, t(2)), ("r", 6, "n", None, t(1)), ("r", 6, None, a, t(1))], "repo string, snapshot_no int, id string, content_hash string, delivered_at timestamp_ntz")
    got = {(r["snapshot_no"], r["record_type"], r["record_key"], r["change_type"]) for r in snapshots.change_events(snapshots.snapshot_intervals(files, symbols)).collect()}
    assert got == {
        (4, "file", "b", "removed"), (4, "file", "c", "added"), (5, "file", "a", "changed"), (6, "file", "a", "removed"), (6, "file", "c", "removed"), (5, "symbol", "s", "removed"), (6, "symbol", "n", "added"),
    }
    assert snapshots.change_events(snapshots.snapshot_intervals(files.limit(0), symbols.limit(0))).count() == 0


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list) else value


def test_registered_queries_equal_their_sql(spark, small):
    """Every query of the core on the smallest tables, against its SQL where there is one."""
    import duckdb

    import __spark_entry__ as entry
    from symbolith.plans import catalog

    assert set(entry.oracle_sql()) <= set(entry.queries())
    sql = catalog.oracles()
    base = duckdb.connect()
    base.execute("SET TimeZone='UTC'")
    from pathlib import Path

    for path in Path(small).glob("*.parquet"):
        base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    wrong = []
    for name, query in catalog.QUERIES.items():
        found = query(spark, small)
        columns = sorted(found.columns)
        rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
        if name not in sql:
            assert rows, name
            continue
        result = base.execute(sql[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns, name
        expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
        if rows != expected:
            wrong.append(name)
    assert not wrong


def test_python_definitions_in_functions_branches_and_broken_files(spark):
    nested = "try:\n    import q\nexcept ImportError:\n    def q(a):\n        return a\n\nclass A:\n    def m(self):\n        class Local:\n            def deep(self):\n                return 1\n        def inner():\n            return 2\n        return inner\n\n@dec\ndef g():\n    def hidden():\n        return 3\n    return hidden\n\nmatch x:\n    case 1:\n        def matched():\n            return 4\n"
    broken = 'class B:\n    def ok(self, a={1: 2}) -> int:\n        """Does it."""\n        return 1\n\ntext = "def no(): pass"\n# def neither(): pass\ndef bad(:\n    x = (\n'
    rows = parse.parsed(file_rows(spark, [("r", "n.py", nested), ("r", "b.py", broken)])).collect()
    got = {(r["file"], r["qualified_name"], r["kind"], r["line"], r["end_line"]) for r in rows}
    assert got == {
        ("n.py", "q", "function", 4, 5), ("n.py", "A", "class", 7, 14), ("n.py", "A.m", "function", 8, 14), ("n.py", "A.Local", "class", 9, 11), ("n.py", "A.Local.deep", "function", 10, 11), ("n.py", "A.inner", "function", 12, 13),
        ("n.py", "g", "function", 16, 20), ("n.py", "matched", "function", 24, 25), ("b.py", "B", "class", 1, 4), ("b.py", "B.ok", "function", 2, 4), ("b.py", "bad", "function", 8, 9),
    }
    by = {r["qualified_name"]: r for r in rows}
    assert by["B.ok"]["docstring"] == "Does it." and by["B.ok"]["signature"] == "def ok(self, a={1: 2}) -> int" and by["A.inner"]["parent"] == "n.py::A#class"


DECLARED = {
    "a.js": ("class A {\n  constructor(x) { this.x = x; }\n  run(x = g(2)) {\n    return { helper() { return 1; } };\n  }\n}\nexport const go = (cb = f(1)) => {\n  cb();\n};\nlet one = x => x + 1, two = 2;\nif (go(1)) { two(); }\nconst re = /[}\"]/;\n", {("A", "class"), ("A.constructor", "method"), ("A.run", "method"), ("A.helper", "method"), ("go", "function"), ("one", "function")}),
    "a.ts": ("@Injectable()\nexport class S<T> extends B<T> {\n  @Input() name = 1;\n  @traced({ a: [1] })\n  async get<K extends keyof T>(key: K, f: (a: T) => void): Promise<{ v: T }> {\n    return null;\n  }\n}\ninterface I { m(): void }\ntype U<T> = { a: T } | string;\nenum E { A = 1 }\nexport abstract class Q { abstract z(): void; w(): void {} }\n", {("S", "class"), ("S.get", "method"), ("I", "interface"), ("U", "type"), ("E", "class"), ("Q", "class"), ("Q.w", "method")}),
    "A.java": ("@Entity(name = \"a;{\")\npublic class A<T> {\n  A(int x) { this(x, 1); }\n  int f(@Named(\"x(\") int a, Map<String, List<T>> m) throws E { return g(a); }\n  <R> R h(R r) { Runnable q = new Runnable() { public void run() { f(1, null); } }; return r; }\n  abstract void k();\n  enum C { X(1), Y { int z() { return 2; } }; C(int i) {} }\n}\n", {("A", "class"), ("A.A", "function"), ("A.f", "method"), ("A.h", "method"), ("A.run", "method"), ("A.k", "method"), ("A.C", "class"), ("A.C.C", "function"), ("A.C.z", "method")}),
    "A.cs": ("namespace N {\n  [Serializable] public class A : B {\n    public A(int x) : base(x) { }\n    int F(int a) => a + 1;\n    [Obsolete(\"x\")] T G<T>(T t) where T : class { return t; }\n    void H();\n    public int P { get { return 1; } set { F(value); } }\n  }\n  delegate int D(int x);\n  struct V { int W() { return 1; } }\n}\n", {("A", "class"), ("A.A", "function"), ("A.F", "method"), ("A.G", "method"), ("A.H", "method"), ("D", "type"), ("V", "type"), ("V.W", "method")}),
    "a.c": ("#define F(x) { x\ntypedef struct s { int a; } s_t;\nstatic int apply(int (*f)(int), struct s *p)\n{\n  if (f(1)) { return 2; }\n  return 1;\n}\nint later(int);\nenum e { A, B };\n", {("s", "type"), ("s_t", "type"), ("apply", "function"), ("e", "type")}),
    "a.go": ("package a\n\ntype (\n\tA struct{ x int }\n\tB interface{ M() }\n\tC int\n)\nfunc G[T any](x T, f func(int) error) (struct{}, error) {\n\treturn struct{}{}, nil\n}\nfunc (a *A) M() {}\n", {("A", "class"), ("B", "interface"), ("C", "type"), ("G", "function"), ("M", "method")}),
    "a.rs": ("#[derive(Debug)]\npub struct P<'a> { x: &'a str }\nimpl<'a> Tr for P<'a> {\n    #[inline]\n    fn get(&self, c: char) -> bool { c == '{' }\n}\ntrait Tr { fn get(&self, c: char) -> bool; fn d(&self) {} }\n", {("P", "type"), ("P<'a>", "class"), ("P<'a>::get", "function"), ("Tr", "interface"), ("Tr::d", "function")}),
    "a.cpp": ("namespace n {\nclass A : public B {\n public:\n  A(int x) : x_(x) { }\n  int f() const override { return 1; }\n};\n}\nint n::A::g(int x) {\n  return x;\n}\n", {("n", "class"), ("n::A", "class"), ("n::A::A", "function"), ("n::A::f", "function"), ("n::A::g", "function")}),
}


@pytest.mark.parametrize("path", DECLARED)
def test_declarations(path):
    content, expected = DECLARED[path]
    rows, errors = parse.symbols_of(path, content, {"js": "javascript", "ts": "typescript", "java": "java", "cs": "csharp", "c": "c", "go": "go", "rs": "rust", "cpp": "cpp"}[path.split(".")[1]])
    assert {(r["qualified_name"], r["kind"]) for r in rows} == expected and errors == 0
    for r in rows:
        piece = content.encode()[r["byte_offset"] : r["byte_offset"] + r["byte_length"]].decode()
        assert r["name"].split("::")[-1] in piece and content.count("\n", 0, content.find(piece)) + 1 == r["line"]


def test_decorators_and_status(spark):
    rows = {r["name"]: r for r in parse.symbols_of("a.ts", DECLARED["a.ts"][0], "typescript")[0]}
    assert rows["S"]["decorators"] == ["@Injectable()"] and rows["get"]["decorators"] == ["@traced({ a: [1] })"]
    assert {r["name"]: r["decorators"] for r in parse.symbols_of("a.rs", DECLARED["a.rs"][0], "rust")[0]}["get"] == ["#[inline]"]
    assert parse.symbols_of("a.cs", DECLARED["A.cs"][0], "csharp")[0][0]["decorators"] == ["[Serializable]"]
    assert parse.symbols_of("m.py", "@dec(1)\ndef g():\n    pass\n", "python")[0][0]["decorators"] == ["@dec(1)"]
    files = file_rows(spark, [("r", "ok.go", "package a\n"), ("r", "bad.go", "package a\nfunc F() {\n<<<<<<< HEAD\n"), ("r", "none.md", "x"), ("r", "null.go", None)])
    assert {r["file"]: r["parse_status"] for r in parse.parse_status(files).collect()} == {"ok.go": "ok", "bad.go": "errors", "none.md": "unread", "null.go": "unread"}
    # a header that only reads well as C++
    assert {r["name"] for r in parse.symbols_of("a.h", "struct a { int x; };\n", "c")[0]} == {"a"}


@pytest.mark.parametrize("language", ["javascript", "typescript", "go", "rust", "java", "csharp", "c", "cpp", "php", "dart", "swift", "python"])
def test_no_text_takes_more_than_linear_time(language):
    import time

    texts = ["*" * 10_000 + "x", "1" * 10_000 + "n,", "(" * 10_000 + ")" * 10_000, "class " * 10_000, "struct a " * 10_000, "+".join(["f(1)"] * 10_000), '"\\' * 10_000, "const a = (" * 5000, "{" * 10_000, "public " * 20_000 + "f(", "fn f " * 5000, "`${" * 5000]
    began = time.perf_counter()
    for content in texts:
        parse.symbols_of("a.x", content, language)
    assert time.perf_counter() - began < 12


def test_store_keeps_the_old_index_when_a_commit_dies(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "store"))
    rows = lambda *x: spark.createDataFrame([("o/n", p, "python", c) for p, c in x], "repo string, path string, language string, content string")
    engine.index_files("o/n", rows(("a.py", "def f(): pass\n"), ("b.py", "def g(): pass\n")))
    before = {(r["id"], r["content_hash"]) for r in engine.store.read("symbols").collect()}
    monkeypatch.setattr(engine.store, "_mark", lambda commit: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        engine.index_files("o/n", rows(("a.py", "def h(): pass\n")))
    monkeypatch.undo()
    assert {(r["id"], r["content_hash"]) for r in engine.store.read("symbols").collect()} == before and engine.store.read("files").count() == 2
    done = engine.index_files("o/n", rows(("a.py", "def h(): pass\n")))
    assert done["changes"] == {"changed": 1, "deleted": 1} and done["languages"] == {"python": 1}
    assert {r["name"] for r in engine.store.read("symbols", "o/n").collect()} == {"h"}
    assert engine.store.vacuum() >= 2 and engine.store.read("symbols").count() == 1
    where = str(tmp_path / "snapshots")
    assert engine.store.persist("o/n", where).endswith("o-n")
    engine.store.delete("o/n")
    assert engine.store.read("symbols").count() == 0 and not engine.store.ready("o/n")
    engine.store.restore("o/n", where)
    assert {r["name"] for r in engine.store.read("symbols").collect()} == {"h"}


def test_stream_takes_the_later_row_and_deletes(spark, tmp_path):
    from symbolith.streaming import watch

    schema = "repo string, path string, content string, at timestamp, deleted boolean"
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    engine = Engine(spark, str(tmp_path / "store"))
    first = [("o/n", "a.py", "def zzz(): pass\n" * 3, t(1), False), ("o/n", "a.py", "def f(): pass\n", t(2), False), ("o/n", "b.py", "def g(): pass\n", t(1), None), ("o/m", "c.py", "def c(): pass\n", t(1), False), ("o/n", "node_modules/x.py", "def no(): pass\n", t(1), False), ("o/n", "n.md", "x", t(1), False), (None, "q.py", "x", t(1), False)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: watch.watch_files(engine, None, str(tmp_path / "in"), str(tmp_path / "check"), schema).awaitTermination(120)
    run()
    names = lambda: {(r["repo"], r["name"]) for r in engine.store.read("symbols").collect()}
    assert names() == {("o/n", "f"), ("o/n", "g"), ("o/m", "c")}
    spark.createDataFrame([("o/n", "b.py", None, t(3), True), ("o/n", "a.py", "def f(): return 1\n", t(3), False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert names() == {("o/n", "f"), ("o/m", "c")} and engine.store.read("files", "o/n").count() == 1
    run()
    assert names() == {("o/n", "f"), ("o/m", "c")}


def test_hosted_repository_and_tools(spark, tmp_path):
    import base64
    import json

    from symbolith.tools import Tools

    tree = [("src/a.py", "blob"), ("b.py", "blob"), ("vendor/c.py", "blob"), ("docs", "tree"), ("empty.py", "blob"), ("lost.py", "blob")]
    pages = spark.createDataFrame([("o/n", json.dumps({"truncated": False, "tree": [{"path": p, "sha": "s", "size": 10, "url": "u", "type": k} for p, k in tree]})), ("o/n", "no json"), ("x/y", None)], "repo string, value string")
    body = lambda text_: json.dumps({"path": "p", "encoding": "base64", "content": base64.encodebytes(text_.encode()).decode()})
    responses = spark.createDataFrame([("o/n", "src/a.py", body("class A:\n    def m(self):\n        return 1\n\n    def n(self):\n        return 2\n")), ("o/n", "b.py", body("def m(): pass\n")), ("o/n", "empty.py", body("")), ("o/n", "lost.py", '{"message": "gone"}')], "repo string, path string, value string")
    tools = Tools(Engine(spark, str(tmp_path / "store")))
    done = tools.index_repo("https://github.com/o/n.git", pages, responses)
    assert done["file_count"] == 2 and done["symbol_count"] == 4 and done["languages"] == {"python": 2} and done["repo"] == "o/n"
    found = tools.search_symbols("n", "m", limit=1)
    assert found["count"] == 1 and found["truncated"] and found["total_indexed"] == 4 and found["results"][0]["name"] == "m"
    nested = tools.get_file_outline("n", "src/a.py")
    assert nested["symbol_count"] == 3 and [(x["name"], [c["name"] for c in x["children"]]) for x in nested["symbols"]] == [("A", ["m", "n"])]
    text_ = tools.search_text("n", "return", limit=1)
    assert text_["truncated"] and text_["files_searched"] == 1 and list(text_["matches"]) == ["src/a.py"]
    assert tools.search_text("n", "return")["files_searched"] == 2
    batch = tools.get_symbols("n", ["b.py::m#function", "nope", "b.py::m#function"])
    assert batch["symbol_count"] == 2 and [e["id"] for e in batch["errors"]] == ["nope"] and batch["raw_bytes"] == len("def m(): pass\n")
    assert tools.get_symbol("n", "b.py::m#function", verify=True)["content_verified"]
    whole = tools.get_repo_outline("n")
    assert whole["languages"] == {"python": 4} and whole["top_directories"] == [{"dir": ".", "file_count": 1}, {"dir": "src", "file_count": 1}]
    assert [r["path"] for r in tools.get_file_tree("n")["tree"].collect()] == ["src", "src/a.py", "b.py"]
    assert tools.invalidate_cache("n")["success"] and tools.list_repos().count() == 0
    with pytest.raises(ValueError):
        tools.index_repo("nothing", pages, responses)


def test_links_limits_and_excludes(spark, tmp_path):
    root, out = tmp_path / "proj", tmp_path / "outside"
    root.mkdir()
    out.mkdir()
    (root / "a.py").write_text("def f(): pass\n")
    (out / "s.py").write_text("def secret(): pass\n")
    (root / "inside.py").symlink_to(root / "a.py")
    (root / "leak.py").symlink_to(out / "s.py")
    links = {r["path"]: r["is_symlink"] for r in folders.folder_files(spark, str(root), "o/n").collect()}
    assert links == {"a.py": False, "inside.py": True, "leak.py": True}
    followed = {r["path"]: r["is_symlink"] for r in folders.folder_files(spark, str(root), "o/n", True).collect()}
    assert followed == {"a.py": False, "inside.py": False, "leak.py": True}
    assert folders.limits(spark) == (500, 512_000)
    spark.conf.set("spark.symbolith.max.files", "many")
    with pytest.raises(ValueError):
        folders.limits(spark)
    spark.conf.unset("spark.symbolith.max.files")
    (tmp_path / "exclude").write_text("# mine\nscratch\n\n  old  # note\nscratch\n")
    assert {"scratch", "old", "node_modules"} <= set(folders.watch_excludes(spark, str(tmp_path / "exclude")))


def test_forest_by_contraction_beyond_the_bound(spark, monkeypatch):
    rows = spark.createDataFrame([("r", "f", str(i), str(i // 2) if i else None, i) for i in range(30)] + [("r", "g", "x", "y", 1), ("r", "g", "y", "x", 2), ("r", None, "q", None, 1)], "repo string, file string, id string, parent string, symbol_seq long")
    whole = {(r["id"], r["root"], r["depth"]) for r in outline.file_forest(rows).collect()}
    monkeypatch.setattr(outline, "TOGETHER", 5)
    assert {(r["id"], r["root"], r["depth"]) for r in outline.file_forest(rows).collect()} == whole and len(whole) == 30
