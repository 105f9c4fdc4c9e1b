"""Generated, minified or vendored source files (problem 5).

Merkle hashes go bottom-up over the directory trees of all repositories and of the known libraries; leaves hash the
words of a file without comments and layout, so that reformatting changes nothing, and an edited copy, known by its
five-word shingles, takes the leaf of the library's file. Subtrees shared across unrelated owners mark vendored code,
header and layout rules find what tools wrote.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolith.llm.validity import extension_of
from symbolith.functions.text import plain_path
from symbolith.sources.tables import materialise, table

#: Words in a shingle, and the share of a file's shingles that makes it a copy.
SHINGLE, COPIED_SHARE = 5, 0.8
#: Files and subtrees with fewer words say nothing about who copied whom: error pages, stubs and empty packages are alike everywhere.
LEAST_WORDS = 40
#: So many library shingles may be broadcast (about 100 MB in a Python worker); above that they are joined.
BROADCAST_SHINGLES = 500_000

#: Directories that hold other projects' code, and those that hold what tools wrote.
VENDORED_FOLDERS = "vendor vendored vendors third_party thirdparty third-party 3rdparty 3rd_party node_modules bower_components jspm_packages extern externs external externals deps _vendor _vendored godeps pods carthage site-packages contrib_vendor subprojects".split()
GENERATED_FOLDERS = "dist gen generated autogen auto_generated auto-generated __generated__ _generated generated_src generated-src generated-sources codegen_out".split()
GENERATED_NAME = (
    r"(?i)(?:^|/)[^/]*(?:\.(?:min|bundle|generated|gen|g|pb|designer|autogen)\.[a-z0-9]+|(?:_pb2?(?:_grpc)?|\.pb|_generated|_gen|\.pb\.[a-z]+|_pb\.d|-bundle|\.bundle|_autogen|\.designer|_rpc_gen|\.chunk)\.[a-z0-9]+|zz_generated[^/]*)$"
)
_SAID = re.compile(
    r"@generated\b|<auto-?generated|code generated by\b.*do not edit|\bgenerated by\b.*\b(?:do not|don't) (?:edit|modify)|auto-?generated (?:file|code|source|by|from|on)\b|\bautomatically (?:created|generated|produced|written)\b"
    r"|\b(?:this|the) (?:file|code|source|module) (?:is|was|has been) (?:auto-?|automatically |machine[- ])?(?:generated|created by|produced by|emitted by)|\bgenerated: *(?:true|yes|\w[\w.-]* v?\d)|^\W*generated (?:by|from|with|using) \S+|\bgenerated (?:file|code)\b.*\b(?:do not|don't|changes|edits)\b"
    r"|\bdo not (?:edit|modify)(?: (?:this file|by hand|manually|directly))|\b(?:manual )?(?:edits|changes) (?:will be|are|get) (?:overwritten|lost)|machine[- ]generated|sourceMappingURL=",
    re.I | re.M,
)
_COPIED = re.compile(r"^\W*(?:copied|vendored|taken|imported|forked|ported|adapted|borrowed|mirrored|lifted)(?: verbatim)? from\b.*(?:\d|project|upstream|https?:|licen[cs]e|terms)|\b(?:this (?:file|code) (?:is|was) (?:copied|vendored|taken)|vendored copy of|upstream (?:project|source):)", re.I | re.M)
_DENIED = re.compile(r"\b(?:kept|maintained|written|edited) by hand|\bnot (?:auto-?)?generated|hand-?written|edit\b[^.;\n]*\bfreely|\bgenerators? (?:emits?|writes?|produces?)", re.I)
_COMMENT = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`")
_HASH = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*")
_WORD = re.compile(r"\w+")
#: A literal; its quote is empty where a string never ends. Possessive, so that a line of any length is read once.
_LITERAL = re.compile(
    r"\"(?:[^\"\\\n]|\\.?)*+(?P<double>\"?)|'(?:[^'\\\n]|\\.?)*+(?P<single>'?)"
    r"|(?<![\w.])[-+]?(?:0[xX][\da-fA-F]++|\.?\d[\d_.]*+(?:[eE][-+]?\d++)?)[uUlLfFdD]{0,3}+(?!\w)|\b(?:true|false|null|None|True|False|nil)\b"
)
_SEPARATORS = re.compile(r"[\s\[\](){},:;=>]*")
_BEGINS = re.compile(r"[\s\[\](){},:;=>]*(?:[\"'\d.+-]|true\b|false\b|null\b|None\b|True\b|False\b|nil\b)")
_ASSIGNED = re.compile(r"[^=\"'\d]{0,200}\w[^=\"'\d]{0,200}=\s*(?=[\[({])")
#: So many characters of literals, or lines of them, make data; so many literals behind a name make a line of data.
LEAST_LITERAL, LEAST_ROWS, LEAST_VALUES = 200, 8, 8


def comments_and_code(text: str, extension: str) -> tuple[list[str], str]:
    """The comments of a text, and the text without them; strings count as code."""
    hashed = extension in ("py", "pyi")
    comments: list[str] = []

    def take(m: re.Match) -> str:
        found = m.group()
        if found.startswith(("/*", "//")) if not hashed else found.startswith("#"):
            comments.append(found)
            return " "
        return found

    return comments, (_HASH if hashed else _COMMENT).sub(take, text)


def shingles(words: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(" ".join(words[i : i + SHINGLE])) - (1 << 63) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


def says_generated(comments: list[str]) -> bool:
    """Whether a comment says of its own file that a tool wrote it, or that it was copied."""
    return any((_SAID.search(c) or _COPIED.search(re.sub(r"^[\s/*#!-]+", "", c))) and not _DENIED.search(c) for c in comments)


def minified(code: str) -> bool:
    """Hardly any lines or spaces for so much code."""
    lines = [x for x in code.splitlines() if x.strip()]
    if not lines:
        return False
    size = sum(map(len, lines))
    longest = max(map(len, lines))
    dense = sum(len(x) for x in lines if len(x) > 300 and x.count(" ") < 0.12 * len(x))
    return longest > 300 and dense > 0.5 * size


def literals_in(line: str) -> tuple[int, int]:
    """(number of literals, their characters) of a line of data, that is, one of literals and separators; (0, 0) for any other.

    A name may be assigned to before a bracket, if many literals follow.
    """
    count = size = 0

    def take(m: re.Match) -> str:
        nonlocal count, size
        if m.group()[0] in "\"'" and not (m.group("double") or m.group("single")):
            return "x"
        count += 1
        size += len(m.group())
        return " "

    head = _ASSIGNED.match(line)
    held = line[head.end() :] if head else line
    if not _BEGINS.match(held):
        return 0, 0
    rest = _LITERAL.sub(take, held)
    return (count, size) if count >= (LEAST_VALUES if head else 1) and _SEPARATORS.fullmatch(rest) else (0, 0)


def mostly_data(code: str) -> bool:
    """Most of the code's characters stand in lines of literals."""
    lines = [x for x in code.splitlines() if x.strip()]
    data = [(x, size) for x in lines for count, size in [literals_in(x)] if count]
    enough = sum(size for _, size in data) >= LEAST_LITERAL or len(data) >= LEAST_ROWS
    return enough and sum(len(x) for x, _ in data) > 0.6 * sum(map(len, lines))


TRAITS = T.StructType(
    [
        T.StructField("leaf", T.LongType()),
        T.StructField("words", T.IntegerType()),
        T.StructField("generated", T.BooleanType()),
        T.StructField("minified", T.BooleanType()),
        T.StructField("data", T.BooleanType()),
        T.StructField("shares", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("closest", T.LongType()),
    ]
)


def leaf_of(words: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x00".join(words)) - (1 << 63)


def traits_of(text: str, extension: str, known: dict[int, tuple[tuple[str, int], ...]]) -> tuple:
    comments, code = comments_and_code(text, extension)
    words = _WORD.findall(code)
    files: dict[tuple[str, int], int] = {}
    projects: dict[str, int] = {}
    own = set(shingles(words))
    for s in own:
        held = known.get(s, ())
        for file in held:
            files[file] = files.get(file, 0) + 1
        for project in {p for p, _ in held}:
            projects[project] = projects.get(project, 0) + 1
    shares = {p: n / len(own) for p, n in projects.items() if n >= 0.3 * len(own)}
    closest = max(((n, leaf) for (p, leaf), n in files.items() if shares.get(p, 0) >= COPIED_SHARE), default=(0, None))[1]
    return leaf_of(words), len(words), says_generated(comments), minified(code), mostly_data(code), shares, closest


@F.pandas_udf(T.StructType([T.StructField("leaf", T.LongType()), T.StructField("words", T.LongType())]))
def text_leaf(texts: pd.Series, extensions: pd.Series) -> pd.DataFrame:
    words = [_WORD.findall(comments_and_code(t or "", e or "")[1]) for t, e in zip(texts, extensions)]
    return pd.DataFrame({"leaf": [leaf_of(w) for w in words], "words": [len(w) for w in words]})


def library_leaves(libraries: DataFrame) -> DataFrame:
    """(project, home, file_name, lib_version, leaf, words) of every library file."""
    read = libraries.where("content IS NOT NULL AND project IS NOT NULL").select(
        "project", F.col("origin_repo").alias("home"), "file_name", "lib_version", text_leaf("content", extension_of(F.col("file_name"))).alias("t")
    )
    return read.select("project", "home", "file_name", "lib_version", "t.leaf", "t.words")


def library_shingles(libraries: DataFrame) -> DataFrame:
    """(shingle, project, leaf) of every library file."""
    extension = extension_of(F.col("file_name"))
    found = libraries.where("content IS NOT NULL").select("project", text_leaf("content", extension)["leaf"].alias("leaf"), F.explode(text_shingles("content", extension)).alias("shingle"))
    return found.distinct()


@F.pandas_udf(T.ArrayType(T.LongType()))
def text_shingles(texts: pd.Series, extensions: pd.Series) -> pd.Series:
    return pd.Series([sorted(set(shingles(_WORD.findall(comments_and_code(t or "", e or "")[1])))) for t, e in zip(texts, extensions)], dtype=object)


def shares_by_join(files: DataFrame, grams: DataFrame) -> DataFrame:
    """(file_id, shares, closest): the share of each file's shingles that each project has, and the leaf of the closest file of
    a project with enough of them, where the projects' are too many to broadcast."""
    own = files.groupBy("file_id").agg(F.max_by(F.struct("rel_path", "content"), F.struct("fetched_at", "rel_path")).alias("f"))
    held = own.select("file_id", text_shingles("f.content", extension_of(F.col("f.rel_path"))).alias("own")).select("file_id", F.size("own").alias("size"), F.explode("own").alias("shingle"))
    joined = held.join(grams, "shingle")
    by_file = joined.groupBy("file_id", "project", "leaf", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("file_id", "project", "size").agg(F.max(F.struct("n", "leaf")).alias("best"))
    whole = joined.select("file_id", "project", "size", "shingle").distinct().groupBy("file_id", "project", "size").count().where(F.col("count") >= 0.3 * F.col("size"))
    counted = whole.join(by_file, ["file_id", "project", "size"]).withColumn("share", F.col("count") / F.col("size"))
    return counted.groupBy("file_id").agg(
        F.map_from_entries(F.collect_list(F.struct("project", "share"))).alias("shares"), F.max(F.when(F.col("share") >= COPIED_SHARE, F.col("best")))["leaf"].alias("closest")
    )


def traits(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """Adds the traits of each file's text (see TRAITS); a null text has none."""
    spark = files.sparkSession
    grams = materialise(library_shingles(libraries), "library")
    known: dict[int, tuple[tuple[str, int], ...]] = {}
    few = grams.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES
    for row in grams.collect() if few else []:
        known[row["shingle"]] = (*known.get(row["shingle"], ()), (row["project"], row["leaf"]))
    shared = spark.sparkContext.broadcast(known)

    @F.pandas_udf(TRAITS)
    def judge(texts: pd.Series, extensions: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, False, False, False, {}, None) if t is None else traits_of(t, e or "", shared.value) for t, e in zip(texts, extensions)]
        # hashes need all their bits: columns with nulls would become floating point numbers
        return pd.DataFrame({f.name: pd.Series([r[i] for r in rows], dtype="Int64" if f.dataType == T.LongType() else object) for i, f in enumerate(TRAITS.fields)})

    judged = files.withColumn("t", judge.asNondeterministic()("content", extension_of(F.col("rel_path"))))
    if few:
        return judged
    joined = judged.join(shares_by_join(files, grams), "file_id", "left")
    full = F.col("t").withField("shares", F.coalesce("shares", F.create_map().cast("map<string,double>"))).withField("closest", F.col("closest"))
    return joined.withColumn("t", full).drop("shares", "closest")


def merkle(leaves: DataFrame) -> DataFrame:
    """(repo, path, kind, hash, words, fetched_at, owner, home) of all files and directories, bottom-up, one aggregation a level.

    ``leaves`` has (repo, path, leaf, words, fetched_at), and may have owner and home, the repository where the leaf is
    known to be maintained; a directory has a home if all its leaves have the same. A directory's hash is made of its
    children's hashes whatever their names and order, by sums that combine before the shuffle, so that a directory of any
    size is no hot group.
    """
    owner = F.col("owner") if "owner" in leaves.columns else F.split_part("repo", F.lit("/"), F.lit(1))
    home = F.col("home") if "home" in leaves.columns else F.lit(None).cast("string")
    level = leaves.select(
        "repo", "path", F.lit("file").alias("kind"), F.col("leaf").alias("hash"), F.col("words").cast("long").alias("words"), "fetched_at", F.size(F.split("path", "/")).alias("depth"),
        owner.alias("owner"), home.alias("home"),
    )
    level = materialise(level, "leaves")
    deepest = level.agg(F.max("depth").alias("d")).first()["d"] or 0
    done, rising = [level], level.where(F.col("depth") == deepest)
    for depth in range(deepest, 1, -1):
        parents = rising.groupBy("repo", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path")).agg(
            F.sum(F.xxhash64("hash", F.lit(1)).cast("decimal(38,0)")).alias("_a"), F.bit_xor(F.xxhash64("hash", F.lit(2))).alias("_b"), F.count(F.lit(1)).alias("_n"),
            F.sum("words").alias("words"), F.min("fetched_at").alias("fetched_at"), F.max("owner").alias("owner"), F.min("home").alias("_least"), F.max("home").alias("_most"), F.count("home").alias("_homes"),
        )
        one = (F.col("_homes") == F.col("_n")) & (F.col("_least") == F.col("_most"))
        folders = materialise(
            parents.select(
                "repo", "path", F.lit("folder").alias("kind"), F.xxhash64("_a", "_b", "_n").alias("hash"), "words", "fetched_at", F.lit(depth - 1).alias("depth"), "owner", F.when(one, F.col("_most")).alias("home"),
            ),
            "folders",
        )
        done.append(folders)
        rising = folders.unionByName(level.where(F.col("depth") == depth - 1))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def shared_subtrees(trees: DataFrame) -> DataFrame:
    """(hash, repos, kept_at) of files and subtrees that repositories of different owners hold.

    ``kept_at`` is where the subtree is maintained: the home of the library whose it is, else the repository it was
    fetched from first.
    """
    known = trees.where((F.col("words") >= LEAST_WORDS) & F.col("hash").isNotNull()).groupBy("hash", "repo", "owner").agg(F.min("fetched_at").alias("fetched_at"), F.max("home").alias("home"))
    first = F.min_by("repo", F.when(F.col("fetched_at").isNotNull(), F.struct("fetched_at", "repo")))
    spread = known.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.count(F.lit(1)).alias("repos"), F.coalesce(F.max("home"), first).alias("kept_at"))
    return spread.where("owners > 1").select("hash", "repos", "kept_at")


def in_folder(path: Column, names: list[str]) -> Column:
    parts = F.transform(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda x: F.lower(x))
    return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))


def origins(source_files: DataFrame, libraries: DataFrame) -> DataFrame:
    """(file_id, repo, rel_path, generated, minified, copied, data, by_tree, by_place, project) of every file.

    ``copied`` is ``by_tree``, in a subtree that is maintained in another repository, or ``by_place``, in a folder for
    other projects' code. Files fetched twice give one row; rows without file_id are left out; null texts are judged by
    their path alone. A library's files in its own repository aren't copies.
    """
    columns = ["file_id", "repo", "rel_path", "fetched_at", "content"]
    judged = traits(source_files.select(*columns).where("file_id IS NOT NULL"), libraries).drop("content")
    last = judged.groupBy("file_id").agg(F.max_by(F.struct("repo", "rel_path", "fetched_at", "t"), F.struct("fetched_at", "rel_path")).alias("f"))
    flat = last.select("file_id", "f.repo", "f.rel_path", "f.fetched_at", plain_path(F.coalesce("f.rel_path", F.lit(""))).alias("path"), "f.t.*")
    files = materialise(flat, "files")
    known = materialise(library_leaves(libraries), "libraries")
    # one row for each leaf of a library
    homes = known.groupBy(F.col("leaf").alias("closest")).agg(F.min("project").alias("project"), F.min_by("home", "project").alias("home"))
    homed = files.join(F.broadcast(homes) if homes.limit(100_001).count() <= 100_000 else homes, "closest", "left")
    leaves = homed.select("repo", "path", F.coalesce("closest", "leaf").alias("leaf"), "words", "fetched_at", F.split_part("repo", F.lit("/"), F.lit(1)).alias("owner"), "home")
    shelves = known.select(
        F.concat(F.lit("library:"), "project", F.lit("@"), F.coalesce("lib_version", F.lit(""))).alias("repo"), F.concat(F.lit("files/"), "file_name").alias("path"), "leaf", F.col("words").cast("int").alias("words"),
        F.lit(None).cast(dict(files.dtypes)["fetched_at"]).alias("fetched_at"), F.coalesce(F.split_part("home", F.lit("/"), F.lit(1)), F.concat(F.lit("library:"), "project")).alias("owner"), F.coalesce("home", F.concat(F.lit("library:"), "project")).alias("home"),
    )
    trees = merkle(leaves.unionByName(shelves))
    shared = materialise(shared_subtrees(trees), "shared")
    # every file below a shared subtree, and every shared file
    marked = trees.where("hash IS NOT NULL").join(shared, "hash").where("repo <> kept_at").select("repo", F.col("path").alias("marked")).distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split(F.col("path"), "/"), 1, i), "/"))
    below = files.select("file_id", "repo", F.explode(prefixes).alias("marked")).join(marked, ["repo", "marked"])
    named = homed.join(below.select("file_id", F.lit(True).alias("below")).distinct(), "file_id", "left")
    path = F.col("path")
    own = F.coalesce(F.col("home") == F.col("repo"), F.lit(False))
    by_tree = F.coalesce("below", F.lit(False)) & ~own
    by_place = in_folder(path, VENDORED_FOLDERS)
    return named.select(
        "file_id", "repo", "rel_path",
        (F.coalesce("generated", F.lit(False)) | path.rlike(GENERATED_NAME) | in_folder(path, GENERATED_FOLDERS)).alias("generated"),
        F.coalesce("minified", F.lit(False)).alias("minified"),
        (by_tree | by_place).alias("copied"),
        F.coalesce("data", F.lit(False)).alias("data"),
        by_tree.alias("by_tree"), by_place.alias("by_place"), "project",
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = origins(table(spark, folder, "source_files"), table(spark, folder, "library_files"))
    return found.where("generated OR minified OR copied OR data").select("file_id")


def p5_origins(spark: SparkSession, folder: str) -> DataFrame:
    """Every file that isn't hand-written, with why, and by which rule a copy was found."""
    return origins(table(spark, folder, "source_files"), table(spark, folder, "library_files")).where("generated OR minified OR copied OR data")
