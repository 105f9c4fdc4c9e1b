"""Broken prompt and response pairs (problem 2).

The prompt of a symbol is its kind, qualified name and signature, the response its summary. Openings of responses, with
what the prompt gives masked, recur as templates; those that recur across unrelated prompts and carry nothing of any of
them are refusals, whatever their words, and verified MinHash links the variants of their wording to them. Copy,
language and termination checks label the other defects. All but the language model's scoring are column expressions.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolith.sources.tables import current_symbols, materialise, small_enough, table

#: Words of a response that make up its opening, and of the passage that variants are linked by.
OPENING_WORDS, PASSAGE_WORDS = 8, 24
#: Words in a shingle, bands and rows of MinHash, and the similarity that links two passages.
SHINGLE, BANDS, ROWS, SIMILAR = 5, 8, 3, 0.8
#: A leading clause before others.
LEAD = r"^\s*(?:[^\s,;:—–]+\s+){0,3}[^\s,;:—–]+\s*(?:,|—|–)\s*(?=(?:\S+\s+){3}\S)"
#: Words of content that a template of refusals has at least.
LEAST_CONTENT = 2
#: Labelled documents per language that the language model is fitted on.
DOCUMENTS_PER_LANGUAGE = 300
#: So many full sentences must end alike, or texts hold a word, for it to be known.
KNOWN = 3

#: Answers that are none, without signs and spaces.
PLACEHOLDERS = (
    "na", "none", "null", "nil", "undefined", "empty", "nosummary", "nosummaryavailable", "nosummaryprovided", "noanswer", "noresponse", "nodescription",
    "nodescriptionavailable", "summary", "description", "todo", "tbd", "tba", "unknown", "notavailable", "notapplicable", "placeholder", "nan", "blank", "nothing", "missing", "pending", "wip", "emptysummary",
    "summaryhere", "yoursummaryhere", "insertsummaryhere", "error", "string", "answer", "response", "output", "text", "nocontent", "nooutput", "noneprovided",
)
#: Words of English sentences that carry no content.
FUNCTION_WORDS = (
    "a an the this that these those each every any all one no some and or nor but if when unless whether while before after until since because as than which who whose of to in into on onto "
    "from for with without within by at across over under between through during per via about against is are was were be been being has have had does do did can could may might must shall "
    "should will would not it its their so then where how what only also just"
).split()
#: Words of other languages that carry no content, without those that are English words too.
FOREIGN_WORDS = frozenset(
    "der die das den dem des ein eine einen einem einer und oder nicht ist sind wird werden mit von zu zum zur für auf aus bei nach vor über unter ohne im wenn ob noch alle jede jeder jedes seine ihre "
    "le la les un une du de et ou est sont dans par pour sur avec sans ce cette ces il elle ne pas que qui puis chaque tous avant après si son ses leur au aux "
    "el los las unos una y es en por para con sin del al se su sus cada todos antes después cuántas cuando "
    "o os um uma é são em com sem da dos das na nos nas seu sua depois mais "
    "w z od po bez przed przez dla jest są nie czy się oraz ich jego wszystkie według że "
    "lo gli di è per senza della dei che ogni prima dopo nel nella het een van voor zonder niet zijn naar elke och att som är inte på av".split()
)
#: Words of English sentences that another language has too.
SHARED_WORDS = frozenset("a an in on as no do was so is or at by of me also will war over under van den".split())
#: Words by which a speaker means themselves.
FIRST_PERSON = "i i'm i've i'd i'll me my myself we we're we've us our".split()


def squeezed(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def words_of(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[’ʼ]", "'"), r"(?:[^\p{L}\p{N}'_-]|(?<![\p{L}\p{N}])['-]|['-](?![\p{L}\p{N}]))+", " "))
    return F.split(clean, " ")


def prompt_words(frame: DataFrame) -> Column:
    """The words a prompt gives, from its kind, names and signature, camel case and underscores taken apart."""
    joined = F.concat_ws(" ", "kind", "qualified_name", "signature")
    apart = F.regexp_replace(F.regexp_replace(joined, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " "), "_", " ")
    return F.array_distinct(F.concat(words_of(apart), words_of(joined)))


def copied(frame: DataFrame) -> Column:
    """Whether nothing is left of the response when signature, names, kind and the words around them are taken out."""
    response, signature = squeezed(F.col("summary")), squeezed(F.coalesce("signature", F.lit("")))
    name, full = squeezed(F.coalesce("name", F.lit(""))), squeezed(F.coalesce("qualified_name", F.lit("")))
    rest = response
    for part in (signature, full, name):
        rest = F.when(part != "", F.replace(rest, part, F.lit(" "))).otherwise(rest)
    kind = squeezed(F.coalesce("kind", F.lit("")))
    rest = F.when(kind != "", F.replace(rest, kind, F.lit(" "))).otherwise(rest)
    rest = F.regexp_replace(rest, r"the|signature|is|this|of|function|method|class|interface|type|constant|named?|qualified|kind|symbol|prompt|definition|declaration|summari[sz]e|describe|summary|sentence|write|code|inone|one|\s", "")
    begun = (F.length(signature) > F.length(name)) & F.startswith(signature, response) & (F.length(response) > F.length(name)) & F.contains(response, name)
    return (response != "") & (name != "") & (((F.length(rest) <= 1) & (F.contains(response, name) | F.contains(response, signature))) | begun)


def near(words: Column) -> Column:
    """The words and their plurals."""
    return F.concat(words, F.transform(words, lambda w: F.concat(w, F.lit("s"))), F.transform(words, lambda w: F.concat(w, F.lit("es"))))


def name_words(frame: DataFrame) -> Column:
    """The words of a qualified name, whole and taken apart."""
    name = F.coalesce("qualified_name", F.lit(""))
    apart = F.regexp_replace(F.regexp_replace(name, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " "), r"[_.:]+", " ")
    return F.filter(F.array_distinct(F.concat(words_of(apart), words_of(name))), lambda w: w != "")


def masked(frame: DataFrame) -> DataFrame:
    """Adds ``_masked``, the first words of a response: ``#`` for the prompt's kind, ``@`` for its name whole, quoted or plainly an identifier, ``_`` for other words of the name.

    Words of English that carry no content stay. A leading clause of up to four words before a comma or dash is passed
    over, so that the same answer is one template whatever it begins with.
    """
    told = F.regexp_replace(F.lower("summary"), LEAD, "")
    for column in ("qualified_name", "name"):
        name = F.lower(F.coalesce(column, F.lit("")))
        for quote in ("`", "'", '"'):
            told = F.when(name != "", F.replace(told, F.concat(F.lit(quote), name, F.lit(quote)), F.lit(" 0name0 "))).otherwise(told)
    kind = F.lower(F.coalesce("kind", F.lit("")))
    words = F.slice(F.filter(words_of(told), lambda w: w != ""), 1, PASSAGE_WORDS)
    mark = lambda w: (
        F.when((w == "0name0") | (w == F.col("_identifier")), "@").when((kind != "") & w.isin(kind, F.concat(kind, F.lit("s")), F.concat(kind, F.lit("es"))), "#")
        .when(F.array_contains("_named", w) & ~w.isin(*FUNCTION_WORDS), "_").otherwise(w)
    )
    identifier = F.when(F.col("name").rlike(r"[\d_]|\p{Ll}\p{Lu}"), F.lower("name"))
    return frame.withColumn("_identifier", F.coalesce(identifier, F.lit(""))).withColumn("_masked", F.transform(words, mark)).drop("_identifier")


def templates(held: DataFrame) -> DataFrame:
    """(opening, prompts): the openings of refusals.

    They recur over prompts of different names, and of different kinds unless the speaker means themselves; no response
    mentions a part of its own prompt's name, and no word of theirs is one that several names of the corpus have, for a
    description speaks of what the corpus is about, though it be of another symbol. Only responses that end in a full
    stop make a template, as descriptions that break off soon are alike too. Counted in two steps, so that a template
    with a third of all responses stays small; only what recurs is looked up among the names.
    """
    apart = held.where("_simple IS NULL AND finish = 'full' AND NOT _mentions").where(~F.coalesce(F.col("_foreign") > foreign_margin(), F.lit(False)) & (F.size("_content") >= LEAST_CONTENT))
    counted = apart.groupBy("opening", "_content").agg(*[f(c).alias(f"{n}_{c}") for c in ("kind", "_asked") for n, f in (("least", F.min), ("most", F.max))])
    spread = (F.col("least__asked") != F.col("most__asked")) & ((F.col("least_kind") != F.col("most_kind")) | F.arrays_overlap(F.split("opening", " "), F.array(*[F.lit(w) for w in FIRST_PERSON])))
    recurring = materialise(counted.where(spread).select("opening", "_content"), "recurring")
    word = F.col("word")
    forms = F.array(word, F.regexp_replace(word, "s$", ""), F.regexp_replace(word, "es$", ""), F.regexp_replace(word, "ies$", "y"))
    said = recurring.select("opening", F.explode("_content").alias("word")).select("opening", F.explode(F.array_distinct(forms)).alias("word"))
    wanted = materialise(said.select("word").distinct(), "wanted")
    small = small_enough(wanted)
    named = held.select(F.explode("_own_words").alias("word")).join(small if small is not None else wanted, "word", "left_semi").groupBy("word").count().where(F.col("count") >= KNOWN)
    telling = said.join(named, "word", "left_semi").select("opening").distinct()
    kept = materialise(recurring.join(telling, "opening", "left_anti").select("opening"), "templates")
    few = small_enough(kept)
    return apart.join(few if few is not None else kept, "opening", "left_semi").groupBy("opening").agg(F.countDistinct("_asked").alias("prompts"))


def passages(frame: DataFrame) -> DataFrame:
    """(passage, shingles, bands): the distinct passages with their five-word shingles and MinHash bands."""
    count = F.size("_masked")
    shingles = F.when(
        count >= SHINGLE, F.array_distinct(F.transform(F.sequence(F.lit(1), count - SHINGLE + 1), lambda i: F.array_join(F.slice("_masked", i, SHINGLE), " ")))
    ).otherwise(F.array(F.array_join("_masked", " ")))
    minimum = lambda k: F.array_min(F.transform("shingles", lambda s: F.xxhash64(F.lit(k), s)))
    bands = F.array(*[F.xxhash64(F.lit(b), *[minimum(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])
    return frame.groupBy("_masked").agg(F.first("opening").alias("opening")).withColumn("shingles", shingles).withColumn("bands", bands)


def similar(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def variants(held: DataFrame, refusals: DataFrame) -> DataFrame:
    """(_masked, variant_of): passages without a template of their own at a similarity of 0.8 to a refusal's passage.

    Candidates share a band; each is compared with the shingles themselves. Equal passages are one row, and only
    passages that mention nothing of their own name take part.
    """
    open_ = held.where("_simple IS NULL AND NOT _mentions_any").where(~F.coalesce(F.col("_foreign") > foreign_margin(), F.lit(False)) & (F.size("_masked") > 0))
    all_ = materialise(passages(open_), "passages")
    known = materialise(all_.join(refusals.select("opening"), "opening", "left_semi").select("opening", F.col("shingles").alias("_theirs"), F.explode("bands").alias("band")), "known")
    small = small_enough(known)
    others = all_.join(refusals.select("opening"), "opening", "left_anti").select("_masked", "shingles", F.explode("bands").alias("band"))
    met = others.join(small if small is not None else known, "band").where(similar(F.col("shingles"), F.col("_theirs")) >= SIMILAR)
    return met.groupBy("_masked").agg(F.min("opening").alias("variant_of"))


# -- language


def _grams(text: str) -> list[str]:
    text = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    return [text[i : i + 3] for i in range(len(text) - 2)]


def language_model(documents: DataFrame) -> dict[str, tuple[float, ...]]:
    """Log probabilities of character trigrams per language, English first, from a bounded sample of labelled documents."""
    lang = F.lower(F.trim("lang"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = documents.where("lang IS NOT NULL AND text IS NOT NULL").select(lang.alias("lang"), "doc_id", "text")
    picked = sample.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= DOCUMENTS_PER_LANGUAGE).select("lang", "text")

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                prose = re.sub(r"```[\s\S]*?```|`[^`]*`|\S*[/_]\S*", " ", text)
                held.update((lang, g) for g in _grams(prose))
        yield pd.DataFrame([(a, b, n) for (a, b), n in held.items()], columns=["lang", "gram", "n"])

    counts = picked.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by: dict[str, Counter] = {}
    for row in counts.collect():
        by.setdefault(row["lang"], Counter())[row["gram"]] += row["n"]
    if "en" not in by or len(by) < 2:
        return {}
    order = ["en", *sorted(set(by) - {"en"})]
    kinds = len(set().union(*by.values())) + 1
    totals = [sum(by[x].values()) for x in order]
    grams = set().union(*by.values())
    unseen = tuple(math.log(0.5 / (t + 0.5 * kinds)) for t in totals)
    return {"": unseen} | {g: tuple(math.log((by[x].get(g, 0) + 0.5) / (t + 0.5 * kinds)) for x, t in zip(order, totals)) for g in grams}


def foreign(model):
    """A column function: how much likelier than English another language is, in nats; null where English is plain.

    Another script, or more function words of other languages than of English, decides at once; the trigrams judge
    texts that have neither.
    """

    english = frozenset(FUNCTION_WORDS) - SHARED_WORDS - FOREIGN_WORDS

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        grams = model.value
        unseen = grams.get("", (0.0,))
        out = []
        for text in texts:
            letters = [c for c in text or "" if c.isalpha()]
            if not letters or len(grams) < 2:
                out.append(None)
                continue
            wide = sum(c > "ʯ" for c in letters)
            if wide * 2 > len(letters):
                out.append(1000.0)
                continue
            prose = re.sub(r"[‘'\"“`][^'’\"”`\s]+['’\"”`]", " ", text)
            words = re.findall(r"[^\W\d_]+", prose.lower())
            ours, theirs = sum(w in english for w in words), sum(w in FOREIGN_WORDS for w in words)
            if theirs > ours:
                out.append(1000.0)
            elif ours or not words:
                out.append(None)
            else:
                sums = [0.0] * len(unseen)
                for gram in _grams(prose):
                    for i, p in enumerate(grams.get(gram, unseen)):
                        sums[i] += p
                out.append(max(sums[1:]) - sums[0])
        return pd.Series(out, dtype="float64")

    return score.asNondeterministic()


# -- termination


def termination(frame: DataFrame) -> DataFrame:
    """Adds ``finish`` (full, ellipsis, open, word), the last word and the frame of function words it stands in."""
    text = F.regexp_replace("summary", r"[\s\"'`”’)\]*]+$", "")
    code = F.array_join(F.transform("_words", lambda w: F.when(w.isin(*FUNCTION_WORDS), w).otherwise("x")), " ")
    finish = (
        F.when(text.rlike(r"(\.\.\.?|…)$"), "ellipsis")
        .when(text.rlike(r"[.!?。！？]$"), "full")
        .when(F.col("summary").rlike(r"[,;:(\[{/&+=<–—-]\s*$"), "open")
        .when(F.try_element_at("_words", F.lit(-1)).isin(*FUNCTION_WORDS), "open")
        .otherwise("word")
    )
    return frame.withColumn("finish", finish).withColumn("last_word", F.try_element_at("_words", F.lit(-1))).withColumn(
        "frame", F.regexp_extract(code, r"((?:(?!x(?: |$))\S+(?: x)* )?(?!x(?: |$))\S+(?: x)*)$", 1)
    )


def known_endings(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames that full sentences end in, and words that stand elsewhere than at an open end."""
    frames = frame.where("finish = 'full'").groupBy("frame").count().where(F.col("count") >= KNOWN).select("frame", F.lit(True).alias("known_frame"))
    inside = F.when(F.col("finish") == "full", F.col("_words")).otherwise(F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0))))
    words = frame.where("size(_words) > 0").select(F.explode(inside).alias("last_word")).groupBy("last_word").count().where(F.col("count") >= KNOWN)
    return frames, words.select("last_word", F.lit(True).alias("known_word"))


def join_small(frame: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a written table: broadcast if it is small, by shuffle with skew handling otherwise."""
    side = materialise(side, "side")
    small = small_enough(side)
    return frame.join(small if small is not None else side, on, "left")


def judged(symbols: DataFrame, documents: DataFrame) -> DataFrame:
    """(repo, id, defect, template) of every response; ``defect`` is null where there is none.

    ``symbols`` has one row per (repo, id) with kind, name, qualified_name, signature and summary; null summaries were
    never asked for and are left out. Null names and signatures can't be copied. One defect at most: empty, copy,
    wrong_language, refusal, truncated, in this order.
    """
    spark = symbols.sparkSession
    base = symbols.where("summary IS NOT NULL").select("repo", "id", "kind", "name", "qualified_name", "signature", "summary")
    model = spark.sparkContext.broadcast(language_model(documents))
    base = base.withColumn("_words", F.filter(words_of(F.col("summary")), lambda w: w != "")).withColumn("_given", prompt_words(base))
    bare = squeezed(F.col("summary"))
    simple = F.when((bare == "") | bare.isin(*PLACEHOLDERS) | bare.rlike(r"^\d{1,3}$"), "empty").when(copied(base), "copy")
    base = base.withColumn("_own_words", name_words(base)).withColumn("_named", near(F.col("_own_words")))
    scored = masked(base).withColumn("_simple", simple).withColumn("_foreign", foreign(model)("summary"))
    head = F.slice("_masked", 1, OPENING_WORDS)
    lean = termination(scored).select(
        "repo", "id", "kind", "_own_words", "_masked", "_simple", "_foreign", "finish", "last_word", "frame", "_words",
        F.xxhash64("qualified_name").alias("_asked"), F.array_join(head, " ").alias("opening"), F.array_contains(head, "_").alias("_mentions"), F.array_contains("_masked", "_").alias("_mentions_any"),
        F.filter(head, lambda w: ~w.isin("#", "@", "_", *FUNCTION_WORDS) & (F.length(w) > 1)).alias("_content"), F.array_contains("_given", F.col("last_word")).alias("_own"),
    )
    held = materialise(lean, "responses")
    refusals = materialise(templates(held), "refusals")
    frames, words = known_endings(held.where("_simple IS NULL"))
    joined = join_small(held, refusals, ["opening"])
    joined = join_small(join_small(joined, frames, ["frame"]), words, ["last_word"])
    joined = join_small(joined, variants(held, refusals), ["_masked"])
    joined = joined.withColumn("template", F.when(F.col("prompts").isNotNull(), F.col("opening")).otherwise(F.col("variant_of")))
    broken = (F.col("finish") == "ellipsis") | (F.col("finish") == "open") | (
        (F.col("finish") == "word") & (F.coalesce(~F.col("known_frame"), F.lit(True)) | (F.coalesce(~F.col("known_word"), F.lit(True)) & ~F.coalesce("_own", F.lit(False))))
    )
    defect = (
        F.when(F.col("_simple").isNotNull(), F.col("_simple"))
        .when(F.col("_foreign") > foreign_margin(), "wrong_language")
        .when(F.col("template").isNotNull(), "refusal")
        .when(broken, "truncated")
    )
    return joined.select("repo", "id", defect.alias("defect"), "template", "prompts")


def foreign_margin() -> Column:
    """Nats by which another language must be likelier than English."""
    return F.lit(3.0)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    symbols = current_symbols(spark, folder, ["kind", "name", "qualified_name", "signature", "summary"])
    return judged(symbols, table(spark, folder, "documents")).where("defect IS NOT NULL").select("repo", "id", "defect")


def p2_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The templates of refusals with the prompts that they met as they stand, and the responses, variants included."""
    symbols = current_symbols(spark, folder, ["kind", "name", "qualified_name", "signature", "summary"])
    found = judged(symbols, table(spark, folder, "documents")).where("defect = 'refusal'")
    return found.groupBy("template").agg(F.max("prompts").alias("prompts"), F.count(F.lit(1)).alias("responses"))
