"""The operators of the subpackage on small inputs: known cases, brute force, nulls, empty and long texts, ties, repeats."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from symbolith.llm import answers, encoding, mixing, packing, pairs, provenance, tokens, validity

T0 = dt.datetime(2024, 1, 1)
SOURCE = "file_id long, repo string, rel_path string, fetched_at timestamp_ntz, content string"


def sources(spark, rows):
    """Source rows with columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, r, p, T0, c) for i, r, p, c in rows], SOURCE)
    clash = {c: F.lit("clash") for c in ("errors", "valid", "pairs", "t", "language", "path", "words", "leaf")}
    late = df.withColumn("fetched_at", F.col("fetched_at") + F.expr("interval 1 day"))
    return df.unionByName(late).unionByName(df).withColumns(clash)


FILES = [
    (1, "a/x", "ok.py", "def f():\n    '''Adds all the numbers up.'''\n"), (2, "a/x", "bad.py", "def f(:\n"), (3, "a/x", "empty.go", ""), (4, "b/y", "null.js", None), (5, "b/y", "notes.txt", "not code ("), (6, "b/y", ".\\src\\w.JS", "let = ("),
    (7, None, "x.c", "/* Reads the next byte from here. */\nint f(void) {\n}\n"), (None, "b/y", "z.py", "("), (8, "b/y", None, "x"), (9, "b/y", "long.js", "let a = [" + "1," * 50_000 + "];"),
]


def test_validity(spark):
    got = {r["file_id"]: (r["language"], r["valid"]) for r in validity.parsed(sources(spark, FILES)).collect()}
    assert got == {1: ("python", True), 2: ("python", False), 3: ("go", True), 4: ("javascript", None), 5: (None, None), 6: ("javascript", False), 7: ("c", True), 8: (None, None), 9: ("javascript", True)}
    rates = {(r["language"], r["repo"], r["level"]): (r["files"], r["invalid"]) for r in validity.rates(validity.parsed(sources(spark, FILES))).collect()}
    assert rates[("python", "a/x", 0)] == (2, 1) and rates[(None, None, 3)] == (6, 2)
    assert validity.parsed(sources(spark, FILES).limit(0)).count() == 0


def test_pairs(spark):
    got = {(r["file_id"], r["line"], r["name"]) for r in pairs.code_description_pairs(sources(spark, FILES)).collect()}
    assert got == {(1, 1, "f"), (7, 2, "f")}
    assert pairs.code_description_pairs(sources(spark, FILES).limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,name,expected",
    [
        ("True when the path outlives its owner.", "x", True), ("Liest alle Zeilen und gibt ihre Anzahl zurück.", "x", True), ("パスがフォルダ内にあるか確認する。", "x", True), ("TODO: make this faster.\nDrops every old row.", "x", True), ("mergeTree drops rows that are stale", "mergeTree", True),
        ("", "x", False), ("...", "x", False), ("TODO: document f", "f", False), ("The merge tree.", "mergeTree", False), ("Merges trees", "merge_tree", False), ("mergeTree()", "mergeTree", False), ("eslint-disable-next-line no-undef", "x", False), ("@param a\n@returns", "x", False),
        ("Args:\n    path:", "x", False), ("Copyright the authors.\nLicensed under terms found in the top folder.", "x", False), ("---- helpers below ----", "x", False), ("{@inheritDoc}", "x", False), ("Description goes here.", "x", False), ("x = foo(1);\nreturn x;", "y", False), ("#region a", "x", False),
    ],
)
def test_informative(text, name, expected):
    assert pairs.informative(text, name) is expected


def test_answers(spark):
    noun = ["tree", "path", "cache", "row", "file"]
    good = [f"Drops each stale {n} before the index closes." for n in noun] + [f"Holds one {n} for the given owner" for n in noun] + [f"Holds one {n} for the given owner." for n in noun]
    rows = [(f"g{i}", "function", f"f{i}", f"def f{i}(a)", s, None) for i, s in enumerate(good)]
    rows += [(f"r{i}", "function", f"q{i}", "x()", f"I'm sorry, but I cannot describe q{i} without its body.", "refusal") for i in range(4)]
    rows += [
        ("e1", "class", "A", "class A", " \t", "empty"), ("e2", "class", "A", "class A", "N/A", "empty"), ("e3", "class", "A", None, "…", "empty"), ("e4", "class", "A", "class A", "", "empty"),
        ("c1", "function", "go", "def go(a, b)", "def go(a, b)", "copy"), ("c2", "function", "go", "def go(a, b)", "Function 'go': def go(a, b)", "copy"), ("c3", "class", "Big", "class Big", "The signature is class Big.", "copy"),
        ("t1", "function", "h", "h()", "Holds one tree for the", "truncated"), ("t2", "function", "h", "h()", "Drops each stale pa", "truncated"), ("t3", "function", "h", "h()", "Drops each…", "truncated"),
        ("w1", "function", "h", "h()", "Prüft, ob der Pfad innerhalb des Ordners liegt.", "wrong_language"), ("w2", "function", "h", "h()", "从缓存中删除过期的行。", "wrong_language"), ("w3", "function", "h", "h()", "Guarda la lista sin bloquear la fuente.", "wrong_language"),
        ("d1", "function", "h", "h()", "Apologizes to the client and retries the file.", None), ("d2", "function", "h", "h()", "Looks up the 'Übersicht' sheet in the file.", None), ("n1", None, None, None, "Cannot be called twice; raises when the file is closed.", None),
    ]
    df = spark.createDataFrame([("o/r", *r[:2], r[2], r[2], *r[3:]) for r in rows], "repo string, id string, kind string, name string, qualified_name string, signature string, summary string, expected string").withColumn("defect", F.lit("clash")).withColumn("template", F.lit("clash"))
    silent = df.limit(1).withColumn("id", F.lit("none")).withColumn("summary", F.lit(None).cast("string"))
    text = {"en": "The file is closed when the index was read and all rows are dropped from the tree.", "de": "Der Pfad liegt innerhalb des Ordners und die Zeilen werden gelöscht.", "es": "La lista se guarda sin bloquear la fuente de datos."}
    documents = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(text.items())] + [(9, None, "en"), (10, "x", None)], "doc_id long, text string, lang string")
    got = {r["id"]: r["defect"] for r in answers.judged(df.unionByName(silent), documents).collect()}
    assert got == {r[0]: r[5] for r in rows}
    assert answers.judged(df.limit(0), documents).count() == 0
    assert answers.judged(df, documents.limit(0)).count() == len(rows)


def library_text(seed):
    rng = random.Random(seed)
    return "".join(f"function name{rng.randrange(999)}(a) {{ return a + {rng.randrange(999)} * value{rng.randrange(999)}; }}\n" for _ in range(30))


def test_provenance(spark):
    lib, own, shared = library_text(1), library_text(2), library_text(3)
    edited = lib.replace("return", "  return").replace("name", "name", 1) + "// changed\nlet extra = 1;\n"
    rows = [
        (1, "o/home", "src/core.js", lib), (2, "p/q", "src/core.js", edited), (3, "p/q", "src/mine.js", own), (4, "p/q", "third_party/z/a.js", "let a = 1;"), (5, "p/q", "src/a_pb.js", "let a = 1;"), (6, "p/q", "src/g.js", "// Code generated by x. DO NOT EDIT.\nlet a = 1;"),
        (7, "p/q", "src/not.js", "// this generator emits files that say do not edit; this one is kept by hand\nlet b = 'Code generated by x. DO NOT EDIT.';"), (8, "p/q", "src/m.js", "a=b+c;" * 300), (9, "p/q", "src/d.py", "X = [\n" + "  0x1f, 0x2e, 0x3d,\n" * 40 + "]\n"),
        (10, "p/q", "src/e.py", ""), (11, "p/q", "src/n.py", None), (12, "r/s", None, "let q = 1;"), (13, "s/t", "deep/a/b/u.js", shared), (14, "v/w", "other/u2.js", shared),
    ]
    libraries = spark.createDataFrame([(1, "lib", "1.0", "o/home", "core.js", "javascript", lib), (2, "none", "1", "x/y", "n.js", "javascript", None)], "lib_file_id int, project string, lib_version string, origin_repo string, file_name string, language string, content string")
    found = {r["file_id"]: r for r in provenance.origins(sources(spark, rows), libraries).collect()}
    reasons = {i: {k for k in ("generated", "minified", "copied", "data") if r[k]} for i, r in found.items()}
    assert {i for i, r in reasons.items() if r} == {2, 4, 5, 6, 8, 9, 14}, reasons
    assert found[2]["project"] == "lib" and reasons[2] == {"copied"} and reasons[9] == {"data"} and reasons[8] == {"minified"} and reasons[14] == {"copied"}
    # shared subtrees alone decide these; a folder's name alone decides the other
    assert {i for i, r in found.items() if r["by_tree"]} == {2, 14} and {i for i, r in found.items() if r["by_place"]} == {4}
    assert provenance.origins(sources(spark, rows).limit(0), libraries).count() == 0
    assert provenance.origins(sources(spark, rows[:3]), libraries.limit(0)).count() == 3
    grams = provenance.library_shingles(libraries)
    shares = {r["file_id"]: r["shares"] for r in provenance.shares_by_join(sources(spark, rows), grams).collect()}
    assert set(shares) == {1, 2} and shares[1]["lib"] == 1.0


def test_merkle_hashes_ignore_names_and_order(spark):
    rows = [("a/x", "v/one.c", 1, 50), ("a/x", "v/two.c", 2, 50), ("b/y", "deep/w/2.c", 2, 50), ("b/y", "deep/w/1.c", 1, 50), ("c/z", "only.c", 7, 50)]
    trees = provenance.merkle(spark.createDataFrame([(*r, T0) for r in rows], "repo string, path string, leaf long, words int, fetched_at timestamp_ntz"))
    hashes = {(r["repo"], r["path"]): r["hash"] for r in trees.collect()}
    assert hashes[("a/x", "v")] == hashes[("b/y", "deep/w")] != hashes[("b/y", "deep")]
    shared = {r["hash"] for r in provenance.shared_subtrees(trees).collect()}
    assert shared == {1, 2, hashes[("a/x", "v")]}


def test_token_counts_match_the_tokenizer(spark):
    texts = ["", "Hello, world", "é→日本 " * 50, None, "x" * 5000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.token_count("t")).collect()]
    encode = tokens.encoding(tokens.VOCABULARY).encode_ordinary
    assert got == [None if t is None else len(encode(t)) for t in texts]


WINDOWS = [("small", 8), ("medium", 32), ("large", 128)]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_item_once(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 2, 5, 8, 9, 31, 32, 33, 100, 128]) if seed < 2 else rng.randrange(1, 129) for _ in range(400)]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    rows = packing.plan(histogram, WINDOWS)
    load, seen = {}, {}
    for name, capacity, size, start, end, each, first, number, fill, _ in rows:
        assert end - start == each * number
        for rank in range(start, end):
            assert (size, rank) not in seen
            seen[size, rank] = 1
            key = (name, first + (rank - start) // each)
            load[key] = load.get(key, 0) + size
            assert load[key] <= capacity
    assert len(seen) == len(sizes)
    used = sum(dict(WINDOWS)[name] for name, _ in load)
    assert sum(sizes) > 0.93 * used
    assert packing.plan({}, WINDOWS) == []


def test_packing(spark):
    words = lambda n: "a" + " a" * (n - 1) if n else ""
    sizes = {1: 3, 2: 8, 3: 30, 4: 200, 5: 0, 6: 1, 7: 1, 8: 300}
    df = spark.createDataFrame([(i, words(n), "clash", 5) for i, n in sizes.items()] + [(9, None, "", 0), (None, "a", "", 0)], "doc_id long, text string, size string, rank int")
    placed = packing.packed(df, WINDOWS).collect()
    by_doc = {}
    for r in placed:
        by_doc.setdefault(r["doc_id"], []).append(r["tokens"])
    assert {i: sum(t) for i, t in by_doc.items()} == sizes
    assert sorted(by_doc[4]) == [72, 128] and sorted(by_doc[8]) == [44, 128, 128]
    assert all(len(t) == 1 for i, t in by_doc.items() if sizes[i] <= 128)
    for r in packing.containers(packing.packed(df, WINDOWS)).collect():
        assert r["tokens"] <= r["capacity"] and r["documents"] == len(r["contents"])
    assert packing.packed(df.limit(0), WINDOWS).count() == 0


def test_packing_ranks_large_groups_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 10)
    df = spark.createDataFrame([(i, "a b c") for i in range(200)], "doc_id long, text string")
    placed = packing.packed(df, [("w", 9)]).groupBy("container").agg(F.sum("tokens").alias("t"), F.count("doc_id").alias("n")).collect()
    assert sum(r["n"] for r in placed) == 200 and all(r["t"] <= 9 for r in placed) and len(placed) == 67


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOGETHER", 40)
    rng = random.Random(1)
    rows = [(i, " Big" if i % 3 else "small", "a" + " b" * rng.randrange(1, 30)) for i in range(600)] + [(1000, None, "a"), (1001, "big", None), (1002, "big", ""), (1003, "other", "a"), (None, "big", "a")]
    documents = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("block", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 4), ("absent", 0.2, 1)], "source string, target_share double, max_repeats int")
    drawn = mixing.mixed(documents, targets)
    rows = drawn.collect()
    assert len({(r["doc_id"], r["repeat"]) for r in rows}) == len(rows)
    limits = {"big": 1, "small": 4}
    assert all(1 <= r["repeat"] <= limits[r["source"]] for r in rows)
    shares = {r["source"]: r for r in mixing.shares(drawn, targets).collect()}
    assert abs(shares["big"]["actual_share"] - 0.5) < 0.02 and abs(shares["small"]["actual_share"] - 0.5) < 0.02 and shares["absent"]["tokens"] == 0
    half = [r for r in rows if r["slot"] < max(x["slot"] for x in rows) / 2]
    big = sum(r["tokens"] for r in half if r["source"] == "big") / sum(r["tokens"] for r in half)
    assert abs(big - 0.5) < 0.05
    assert mixing.mixed(documents.limit(0), targets).count() == 0
    assert mixing.mixed(documents, targets.limit(0)).count() == 0


def test_encoding(spark):
    clean = ["Der Schlüssel wurde gelöscht, weil die Prüfsumme größer war.", "La clé créée est à la dernière étape du résumé.", "The café’s naïve locale — that’s fine.", "Проверьте настройки и запустите сборку ещё раз.", "A função não é possível na árvore.", "plain words only in this text"]
    rows = [(i, t) for i, t in enumerate(clean * 30)]
    bad = {
        1000: clean[0].encode().decode("cp1252"), 1001: clean[1].encode().decode("latin-1"), 1002: clean[0].encode().decode("mac_roman"), 1003: "fine start. " + clean[1].encode().decode("cp850"), 1004: clean[3].encode("cp1251").decode("latin-1"),
        1005: clean[0].encode().decode("cp1252").encode().decode("cp1252"),
    }
    original = {1000: clean[0], 1001: clean[1], 1002: clean[0], 1003: "fine start. " + clean[1], 1004: clean[3], 1005: clean[0]}
    lost = {1010: "Der Schl�ssel wurde gel�scht."}
    right = {1020: "If you see “Ã©” where “é” should be, the page is wrong.", 1021: "The test feeds 'â€™' to it.", 1022: "Invalid bytes are stored as U+FFFD (�) by design.", 1023: "A AÇÃO NÃO", 1024: None, 1025: ""}
    documents = spark.createDataFrame(rows + list((bad | lost | right).items()) + [(1000, bad[1000])], "doc_id long, text string").withColumn("affected", F.lit("clash")).withColumn("gram", F.lit("clash"))
    got = {r["doc_id"]: r for r in encoding.examined(documents).collect()}
    assert {i for i, r in got.items() if r["affected"]} == set(bad) | set(lost)
    assert {i: got[i]["restored"] for i in original} == original
    assert got[1010]["restored"] is None and not got[1010]["complete"]
    assert encoding.examined(documents.limit(0)).count() == 0


def test_encoding_judges_single_accents_and_trail_bytes(spark):
    """Accents one by one, and two-byte characters with an ASCII trail byte, have no two neighbours beyond ASCII."""
    german = ["Der Prüfer gibt für jede Zeile die Prüfsumme zurück.", "Die Größe kann später geändert werden.", "Für jede Änderung wird ein Schlüssel gelöscht."]
    japanese = ["テストのリストをシステムで表示する。", "データのテストはシステムのリストにある。"]
    rows = list(enumerate((german + japanese + ["plain words only in this text", "The café is fine, naïve or not."]) * 400))
    text = "\n".join(german)
    bad = {9000: text.encode("cp1252").decode("mac_roman"), 9001: text.encode("cp1252").decode("cp437"), 9002: "a line before\n" + "テスト リスト".encode("cp932").decode("latin-1")}
    original = {9000: text, 9001: text, 9002: "a line before\nテスト リスト"}
    right = {9010: "Only one é here.", 9011: "A price of 5 € or ½ of it.", 9012: text}
    documents = spark.createDataFrame(rows + list((bad | right).items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in encoding.examined(documents).collect()}
    assert {i for i, r in got.items() if r["affected"]} == set(bad)
    assert {i: got[i]["restored"] for i in original} == original


def test_data_of_long_lines():
    row = '["' + "a b " * 800 + '", 1, 2],\n'
    numbers = "[" + ", ".join(["0.125"] * 5000) + "]"
    assert provenance.mostly_data(row * 9) and provenance.mostly_data(numbers) and provenance.mostly_data("X = " + numbers)
    assert not provenance.mostly_data(("1, " * 700 + "f(x) + g(y) * h;" * 50 + "\n") * 9)
    assert not provenance.mostly_data('NAME = "x"\nSIZES = [1, 2, 3]\n') and not provenance.mostly_data("") and not provenance.mostly_data('"never ends, ' * 40)
    # each of these took more than linear time in some form of the pattern
    for text in ("1234 " * 40 + "x", "1234" * 100_000 + "x", '"\\' * 100_000, '\\"' * 100_000, "''" * 50_000 + "z"):
        assert not provenance.mostly_data(text)


def test_refusals_without_a_declining_phrase(spark):
    """A response to unrelated prompts that says nothing of the corpus is a refusal; one about its things, or to one kind only, is none."""
    noun = ["tree", "path", "cache", "row", "file", "ledger"]
    kinds = ["function", "class", "method"]
    said = {"r": "That falls outside what may be answered here.", "d": "Skips unparsed entries of each ledger.", "w": "Guarda lista ordenada nueva"}
    rows = [(f"{k}{i}", kinds[i % 3], f"{k}_{n}", f"{k}_{n}(ledger)", s) for k, s in said.items() for i, n in enumerate(noun)]
    rows += [(f"o{i}", "function", f"o_{n}", f"o_{n}(ledger)", "Main entry point, started once.") for i, n in enumerate(noun)] + [(f"g{i}", "function", f"g_{n}", f"g_{n}(ledger)", f"Holds one {n} for the given owner.") for i, n in enumerate(noun)]
    df = spark.createDataFrame([("o/r", i, k, n, n, g, s) for i, k, n, g, s in rows], "repo string, id string, kind string, name string, qualified_name string, signature string, summary string")
    text = {"en": "The file is closed when the index was read and all rows are dropped from the tree.", "es": "La lista nueva se guarda ordenada sin bloquear la fuente de datos, y la lista ordenada se guarda."}
    documents = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(text.items())], "doc_id long, text string, lang string")
    got = {}
    for r in answers.judged(df, documents).collect():
        got.setdefault(r["id"][0], set()).add((r["defect"], r["prompts"] if r["defect"] == "refusal" else None))
    assert got == {"r": {("refusal", 6)}, "d": {(None, None)}, "w": {("wrong_language", None)}, "o": {(None, None)}, "g": {(None, None)}}


def nested(extension, n):
    o, c = "(" * n, ")" * n
    if extension == "py":
        return f'def f(a={o}1{c}):\n    """Adds all numbers up."""\n    return {o}1{c}\n'
    head = {"go": "func f(a int) int {", "rs": "fn f(a: u8) -> u8 {", "js": f"function f(a = {o}1{c}) {{ return", "ts": f"function f(a = {o}1{c}) {{ return"}.get(extension, "int f(int a) { return")
    if extension == "go":
        head += " return"
    body = f"/** Adds all the numbers up. */\n{head} {o}1{c}{'' if extension == 'rs' else ';'} }}\n"
    return {"go": f"package a\n\n{body}", "java": f"class A {{\n{body}}}\n", "cs": f"class A {{\n{body}}}\n"}.get(extension, body)


@pytest.mark.parametrize("extension", ["py", "js", "ts", "go", "java", "rs", "cs", "c"])
def test_deep_nesting_is_read_in_a_fresh_worker(extension):
    """10,000 nested brackets parse and keep their pair; beyond the limit a text is unknown, neither valid nor an error of the job."""
    import subprocess
    import sys
    import time

    code = "import sys; sys.path.insert(0, sys.argv[1]); from symbolith.llm import pairs, syntax; t = sys.stdin.read(); print(len(pairs.documented(t, sys.argv[2])), syntax.check(t, sys.argv[2]))"
    root = Path(__file__).resolve().parents[2]
    began = time.perf_counter()
    done = subprocess.run([sys.executable, "-c", code, str(root), extension], input=nested(extension, 10_000), capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "1 []", done.stderr[-300:]
    assert time.perf_counter() - began < 20
    done = subprocess.run([sys.executable, "-c", code, str(root), extension], input=nested(extension, 60_000), capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() in ("0 None", "1 None", "1 []"), (done.stdout[:100], done.stderr[-300:])


def test_refusals_come_from_recurrence_not_from_phrases(spark):
    """Wording that no list knows is found by recurrence; a declining phrase that one prompt got is none; variants of a template count."""
    noun = ["tree", "path", "cache", "row", "file", "ledger", "query", "token"]
    kinds = ["function", "class", "method"]
    tail = "for reasons that were explained at length during an earlier exchange between both parties on record"
    rows = [(f"u{i}", kinds[i % 3], f"u_{n}", f"u_{n}(x)", f"Nothing of substance is disclosed here {tail}.", "refusal") for i, n in enumerate(noun)]
    rows += [("v0", "class", "v_one", "v()", f"Little of substance is disclosed here {tail}.", "refusal"), ("o0", "class", "once", "once(x)", "I am sorry, but I cannot describe this class.", None)]
    rows += [(f"g{i}", kinds[i % 3], f"g_{n}", f"g_{n}(x)", f"Holds one {n} for the given owner.", None) for i, n in enumerate(noun)]
    df = spark.createDataFrame([("o/r", i, k, n, n, g, s) for i, k, n, g, s, _ in rows], "repo string, id string, kind string, name string, qualified_name string, signature string, summary string")
    documents = spark.createDataFrame([], "doc_id long, text string, lang string")
    got = {r["id"]: (r["defect"], r["template"]) for r in answers.judged(df, documents).collect()}
    assert {i: d for i, (d, _) in got.items()} == {r[0]: r[5] for r in rows}
    assert got["v0"][1] == got["u0"][1]


def test_variants_lose_no_link_that_exact_pairs_have(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(6, 24))] for _ in range(60)]
    rows = [(i, words, f"t{i}") for i, words in enumerate(base)]
    for i, words in enumerate(base):
        for k in range(12):
            other = list(words)
            if k % 3 == 0:
                other = other[: max(5, len(other) - rng.randrange(1, 4))]
            elif k % 3 == 1:
                other = (other + [rng.choice(vocabulary) for _ in range(rng.randrange(1, 3))])[:24]
            else:
                other[rng.choice([0, -1])] = rng.choice(vocabulary)
            rows.append((1000 + 100 * i + k, other, f"o{i}.{k}"))
    df = spark.createDataFrame([(i, w, o) for i, w, o in rows], "id long, _masked array<string>, opening string").withColumns(
        {"_simple": F.lit(None).cast("string"), "_mentions_any": F.lit(False), "_foreign": F.lit(None).cast("double")}
    )
    refusals = spark.createDataFrame([(f"t{i}",) for i in range(60)], "opening string")
    found = {tuple(r["_masked"]) for r in answers.variants(df, refusals).collect()}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    known = [grams(w) for w in base]
    wanted = {tuple(w) for i, w, _ in rows if i >= 1000 and tuple(w) not in {tuple(b) for b in base} and any(len(g & grams(w)) / len(g | grams(w)) >= 0.8 for g in known)}
    assert found <= wanted and len(wanted) > 100 and len(found) >= 0.9 * len(wanted), (len(found), len(wanted))


def test_single_byte_chains_are_found(spark):
    """Western texts damaged between single-byte tables, accents one by one, in texts that the model knows."""
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no test data")
    documents = spark.read.parquet(str(folder / "documents.parquet")).select("doc_id", "lang", "text")
    model = encoding.Model(encoding.train(documents))
    rows = documents.where(F.lower(F.trim("lang")).isin("de", "fr", "es", "pt")).select("text").orderBy("doc_id").collect()
    clean = list(dict.fromkeys(r["text"] for r in rows if r["text"] and encoding.is_clean(r["text"]) and not r["text"].isascii()))[:120]
    assert len(clean) > 60
    for right, read_as in (("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850")):
        bad = [b for b in (encoding.garbled(t, right, read_as) for t in clean) if b and sum(not c.isascii() for c in b) >= 3]
        found = sum(bool(encoding.restore(model, b, 20.0, 5.0)[1]) for b in bad)
        assert len(bad) > 20 and found >= 0.9 * len(bad), (right, read_as, found, len(bad))
    assert not [t for t in clean if encoding.restore(model, t, 20.0, 5.0)[1]]
