"""Garbled text from wrong character encoding (problem 9).

Smoothed character n-gram models are trained on the clean records. Every candidate chain (text encoded again in a wrong
single-byte table, decoded in the right one) is scored on what it changes, up to three times in a row, and the
likeliest is accepted beyond a margin that was validated on held-out clean records and their garbled forms.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolith.sources.tables import table

#: Single-byte tables that UTF-8 text is wrongly read in.
UTF8_READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp1254", "cp1253", "iso8859-15", "cp1257", "cp852")
#: (right encoding, table it was wrongly read in) of texts that were no UTF-8.
OTHER_CHAINS = tuple((d, e) for d in ("cp932", "cp1251", "koi8-r", "cp866", "gb18030", "euc_jp", "cp949", "big5") for e in ("cp1252", "latin-1", "mac_roman", "cp437")) + (
    ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1250", "cp1252"), ("cp852", "cp1252"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"),
    ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp1250"),
)
#: Right encodings of one byte a character, whose words can be restored one by one.
SINGLE_BYTE = frozenset(d for d, _ in OTHER_CHAINS) - {"cp932", "gb18030", "euc_jp", "cp949", "big5"}
#: At most so many n-grams make up the model that tasks get; the commonest are kept.
MODEL_GRAMS = 200_000
#: One clean record in so many is held out to validate the margin.
HELD_OUT = 20
#: The margin lies between these, in nats.
MARGINS = (12, 40)
#: The margin of later rounds is no less than this, and changes at most this share of clean records.
LEAST_LATER, CLEAN_ERRORS = 3, 0.001
#: Chains of each class that a held-out record is damaged by.
CHAINS_A_RECORD = 3
#: Characters that only wrong decoding brings into texts.
C1 = frozenset(map(chr, range(0x80, 0xA0)))
#: Nats a character above which a passage is as likely as clean text.
LIKELY = -2.5
#: Judged words that a task remembers before it starts anew; no result depends on it.
REMEMBERED = 300_000
QUOTES = "\"'`“”‘’«»„‚()[]"

_SEQUENCE = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_PAIR = re.compile("[^\x00-\x7f]{2}")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
_WIDE = re.compile(r"[^\x00-\x7f]")
_WIDE_WORD = re.compile(r"\S*[^\x00-\x7f]\S*")
_TALKED_ABOUT = re.compile("[\"'`“‘«(\\[][^\\s\"'`“”‘’«»()]{1,9}[\"'`”’»)\\]]")
#: Letters as no language sets them: long runs of Latin letters with marks, Cyrillic words in inverted case.
_ODD = re.compile("[\xc0-\xff]{4,}|[а-яё][А-ЯЁ]{2,}")
_LOST = re.compile("�+")


@lru_cache(None)
def table_of(encoding: str) -> dict[int, int]:
    """Code point to byte for the upper half of a single-byte table; bytes without a character stand for themselves."""
    out = {}
    for byte in range(0x80, 0x100):
        try:
            char = bytes([byte]).decode(encoding)
        except UnicodeDecodeError:
            char = chr(byte)
        out[ord(char)] = byte
    return out


@lru_cache(None)
def as_bytes(encoding: str) -> dict[int, int]:
    """For ``str.translate``: each character to the byte it came from; what the table lacks becomes U+0100."""

    class Bytes(dict):
        def __missing__(self, key: int) -> int:
            value = key if key < 0x80 else 0x100
            self[key] = value
            return value

    return Bytes(table_of(encoding))


@lru_cache(None)
def opening(encoding: str) -> re.Pattern:
    """A character that stands for the first byte of a UTF-8 sequence before one that stands for a later byte."""
    back: dict[int, str] = {byte: chr(char) for char, byte in table_of(encoding).items()}
    first, later = ("".join(re.escape(back[b]) for b in r if b in back) for r in (range(0xC2, 0xF5), range(0x80, 0xC0)))
    return re.compile(f"[{first}][{later}]")


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a short passage stands alone between quotation marks, that is, is talked about."""
    while start > 0 and not text[start - 1].isascii() and text[start - 1] not in QUOTES:
        start -= 1
    while end < len(text) and not text[end].isascii() and text[end] not in QUOTES:
        end += 1
    return end - start <= 9 and start > 0 and end < len(text) and text[start - 1] in QUOTES and text[end] in QUOTES


@lru_cache(4096)
def mapped_to_bytes(text: str, read_as: str) -> str:
    """The text with a character per byte; kept, as many chains share a table."""
    return text.translate(as_bytes(read_as))


@lru_cache(100_000)
def word_changes(word: str, right: str, read_as: str) -> list[tuple[int, int, str]]:
    return changes(word, right, read_as)


def changes(text: str, right: str, read_as: str) -> list[tuple[int, int, str]]:
    """(start, end, restored) of the passages that the chain restores."""
    out: list[tuple[int, int, str]] = []
    if right == "utf-8" and not opening(read_as).search(text):
        return out
    mapped = mapped_to_bytes(text, read_as)
    if right == "utf-8":
        for m in _SEQUENCE.finditer(mapped):
            start, end = m.span()
            char = m.group().encode("latin-1").decode("utf-8")
            if out and out[-1][1] == start:
                out[-1] = (out[-1][0], end, out[-1][2] + char)
            else:
                out.append((start, end, char))
        return [c for c in out if not quoted(text, c[0], c[1])]
    for start, end, raw in passages(text, read_as):
        try:
            restored = raw.decode(right)
        except UnicodeDecodeError:
            continue
        if restored != text[start:end]:
            out.append((start, end, restored))
    return out


_PASSAGE = re.compile("[\x80-\xff](?:[\x00-\x09\x0b-\xff]*[\x80-\xff][\x40-\x7e]?)?")


@lru_cache(4096)
def passages(text: str, read_as: str) -> list[tuple[int, int, bytes]]:
    """(start, end, bytes) of the passages in a table's characters beyond ASCII that aren't talked about; kept, as many chains share a table."""
    out = []
    for m in _PASSAGE.finditer(mapped_to_bytes(text, read_as)):
        start, end = m.span()
        if not quoted(text, start, end) and not _TALKED_ABOUT.sub(" ", text[max(0, start - 1) : end + 1]).isascii():
            out.append((start, end, m.group().encode("latin-1")))
    return out


class Model:
    """Interpolated character trigrams."""

    def __init__(self, grams: dict[str, int]):
        self.three = grams
        self.two: Counter = Counter()
        self.one: Counter = Counter()
        self.context: Counter = Counter()
        for gram, n in grams.items():
            self.context[gram[:2]] += n
            self.two[gram[1:]] += n
            self.one[gram[2]] += n
        self.before: Counter = Counter()
        for gram, n in self.two.items():
            self.before[gram[0]] += n
        self.total = sum(self.one.values()) + 1
        self.kinds = len(self.one) + 2000
        self.seen: dict[str, float] = {}
        self.words: dict[tuple[int, str], bool] = {}

    def gram(self, gram: str) -> float:
        value = self.seen.get(gram)
        if value is None:
            one = (self.one[gram[2]] + 0.05) / (self.total + 0.05 * self.kinds)
            two = (self.two[gram[1:]] + 4 * one) / (self.before[gram[1]] + 4)
            three = (self.three.get(gram, 0) + 3 * two) / (self.context[gram[:2]] + 3)
            value = self.seen[gram] = math.log(three)
        return value

    def score(self, text: str, start: int, end: int, least: float = -math.inf) -> float:
        """Log likelihood of ``text[start:end]`` and the two characters behind it, given the two before.

        A likelihood only falls as characters are added: once it is not above ``least`` the sum so far is given.
        """
        padded, seen, total = "  " + text + "  ", self.seen, 0.0
        for i in range(start, min(end + 2, len(text))):
            gram = padded[i : i + 3]
            value = seen.get(gram)
            total += self.gram(gram) if value is None else value
            if total <= least:
                break
        return total


def gains_of(model: Model, text: str, found: list[tuple[int, int, str]], known: dict | None = None) -> list[float]:
    """How much likelier each restored passage is than what stands there; ``known`` keeps what was scored before.

    Of a passage that isn't likelier only that is told: its gain isn't above zero, but how far below is left open.
    """
    known = {} if known is None else known
    out = []
    for start, end, restored in found:
        left, right = text[max(0, start - 2) : start], text[end : end + 2]
        old = known.get((start, end))
        if old is None:
            old = known[start, end] = model.score(left + text[start:end] + right, len(left), len(left) + end - start)
        out.append(model.score(left + restored + right, len(left), len(left) + len(restored), old) - old)
    return out


def suspicious(text: str) -> bool:
    """Whether the text can be garbled: all tables keep ASCII as it is."""
    return not text.isascii()


def unlikely_word(model: Model, line: str, start: int, end: int) -> bool:
    """Whether the characters beyond ASCII of a word, and the two behind each, are less likely than in clean text."""
    before = min(2, start)
    word = line[start - before : end + 2]
    value = model.words.get((before, word))
    if value is None:
        if len(model.words) >= REMEMBERED:
            model.words.clear()
        last = before + end - start
        at = sorted({j for i in range(before, last) if not word[i].isascii() for j in (i, i + 1, i + 2) if j < len(word)})
        value = model.words[before, word] = sum(model.score(word, j, j - 1) for j in at) < LIKELY * len(at)
    return value


def unlikely_lines(model: Model, text: str) -> list[tuple[int, int]]:
    """Lines that are less likely a character than clean text is, or hold a word that is; lines of ASCII can't be garbled."""
    out, start = [], 0
    for line in text.split("\n"):
        end = start + len(line)
        if not line.isascii():
            if _CONTROL.search(line) or _ODD.search(line) or any(unlikely_word(model, line, *m.span()) for m in _WIDE_WORD.finditer(line)):
                out.append((start, end))
            elif model.score(text[max(0, start - 2) : end], min(2, start), min(2, start) + len(line)) < LIKELY * (len(line) + 2):
                out.append((start, end))
        start = end + 1
    return out


def by_words(model: Model, text: str, found: list[tuple[int, int, str]], gained: list[float], right: str, read_as: str, known: dict, unlikely: dict) -> tuple[list[tuple[int, int, str]], list[float]]:
    """Passages that a chain between single-byte tables makes less likely as a whole, taken apart into their unlikely words.

    ``unlikely`` keeps the words of passages that other chains change too.
    """
    out, gains = [], []
    for passage, gain in zip(found, gained):
        parts = [passage]
        if gain <= 0:
            start, end, _ = passage
            words = unlikely.get((start, end))
            if words is None:
                spans = [(start + m.start(), m.group()) for m in _WIDE_WORD.finditer(text[start:end])]
                words = unlikely[start, end] = [(at, w) for at, w in spans if unlikely_word(model, text, at, at + len(w))]
            parts = [(at + x, at + y, z) for at, w in words for x, y, z in word_changes(w, right, read_as) if not quoted(text, at + x, at + y)]
        out += parts
        gains += [gain] if gain > 0 else gains_of(model, text, parts, known)
    return out, gains


def best_chain(model: Model, text: str) -> tuple[float, str, list[tuple[int, int, str]]]:
    """The likeliest chain with its gain; passages that it would make less likely are left alone.

    Chains between single-byte tables apply to almost any text, so they are tried on lines that are unlikely as they
    stand or hold a word that is.
    """
    best: tuple[float, str, list[tuple[int, int, str]]] = (0.0, "", [])
    known: dict = {}
    unlikely: dict = {}
    tried = [(r"utf-8", e, changes(text, "utf-8", e)) for e in UTF8_READ_AS if opening(e).search(text)]
    lines = unlikely_lines(model, text)
    if lines:
        letters = {ord(c) for a, b in lines for c in _WIDE.findall(text[a:b])}
        for right, read_as in OTHER_CHAINS:
            if not letters.isdisjoint(table_of(read_as)):
                tried.append((right, read_as, [(a + x, a + y, z) for a, b in lines for x, y, z in changes(text[a:b], right, read_as)]))
    for right, read_as, found in tried:
        gained = gains_of(model, text, found, known)
        if right in SINGLE_BYTE:
            found, gained = by_words(model, text, found, gained, right, read_as, known, unlikely)
        total = sum(g for g in gained if g > 0)
        if total > best[0]:
            best = (total, f"{read_as}>{right}", [c for c, g in zip(found, gained) if g > 0])
    return best


def restore(model: Model, text: str, margin: float, later: float | None = None) -> tuple[str, list[str], float]:
    """The restored text, the chains applied, and their whole gain; ``later`` is the margin of all rounds but the first."""
    later = margin if later is None else later
    applied, total = [], 0.0
    for _ in range(6):
        won, chain, found = best_chain(model, text)
        if won < (later if applied else margin):
            break
        parts, last = [], 0
        for start, end, restored in found:
            parts += [text[last:start], restored]
            last = end
        text = "".join(parts) + text[last:]
        applied.append(chain)
        total += won
    return text, applied, total


def lost(text: str) -> bool:
    """Whether characters were lost: replacement or control characters outside quotation."""
    return any(not quoted(text, *m.span()) for m in _LOST.finditer(text)) or any(not quoted(text, *m.span()) for m in _CONTROL.finditer(text))


def is_clean(text: str) -> bool:
    """No lost characters, no letters set as in no language, and no table but the Cyrillic ones gives a valid UTF-8 sequence."""
    if text.isascii():
        return True
    if "�" in text or _CONTROL.search(text) or _ODD.search(text):
        return False
    if not _PAIR.search(text):
        return True
    return not any(opening(e).search(text) and _SEQUENCE.search(text.translate(as_bytes(e))) for e in UTF8_READ_AS if e not in ("koi8-r", "cp866", "cp1253"))


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts of the clean texts of a partition, a table per batch: three code points make one 63-bit number."""
    for batch in batches:
        keys = []
        for text in batch["text"]:
            if text and is_clean(text):
                points = np.frombuffer(("  " + text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
                keys.append(points[:-2] << 42 | points[1:-1] << 21 | points[2:])
        if keys:
            grams, counts = np.unique(np.concatenate(keys), return_counts=True)
            yield pd.DataFrame({"gram": grams, "n": counts})


def spelled(gram: int) -> str:
    return chr(gram >> 42) + chr(gram >> 21 & 0x1FFFFF) + chr(gram & 0x1FFFFF)


def train(documents: DataFrame) -> dict[str, int]:
    """Counts of the commonest trigrams over all clean records that aren't held out."""
    texts = documents.where("text IS NOT NULL").where(F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) != 0).select("text")
    counts = texts.mapInPandas(count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {spelled(r["gram"]): r["n"] for r in counts.orderBy(F.desc("n"), "gram").limit(MODEL_GRAMS).collect()}


def garbled(text: str, right: str, read_as: str) -> str | None:
    """The text as a chain would have damaged it; None if its characters, or bytes, have no place in the tables."""
    back = {byte: char for char, byte in table_of(read_as).items()}
    try:
        raw = text.encode(right)
    except UnicodeEncodeError:
        return None
    if any(b > 0x7F and b not in back for b in raw):
        return None
    made = "".join(chr(back[b]) if b > 0x7F else chr(b) for b in raw)
    return made if made != text else None


def validated_margin(documents: DataFrame, model) -> tuple[float, float]:
    """(margin, margin of later rounds), validated on held-out clean records.

    The first is the one with the fewest errors on the records as they are and as chains damage them: every record goes
    through some chains of each class, those between UTF-8 and tables and those between other encodings, in turn, so that
    all chains that can express a record are met. The later one decides whether a text that was restored once is changed
    again: the least at which the records themselves, as many times ``CLEAN_ERRORS`` as there are, stay as they are.
    """
    chains = [[("utf-8", e) for e in UTF8_READ_AS], list(OTHER_CHAINS)]
    held = documents.where("text IS NOT NULL").where(F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0).select("text")

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Model(model.value)
        rows: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                if not text or text.isascii() or not is_clean(text):
                    continue
                rows[(0, min(int(best_chain(scorer, text)[0]), 200))] += 1
                for group in chains:
                    turn = zlib.crc32(text.encode("utf-8", "ignore"))
                    made = ((right, read_as, garbled(text, right, read_as)) for right, read_as in group[turn % len(group) :] + group[: turn % len(group)])
                    for right, read_as, bad in islice((x for x in made if x[2] is not None), CHAINS_A_RECORD):
                        won = sum(g for g in gains_of(scorer, bad, changes(bad, right, read_as)) if g > 0)
                        rows[(1, min(int(won), 200))] += 1
        yield pd.DataFrame([(y, g, n) for (y, g), n in rows.items()], columns=["garbled", "gain", "n"]).astype({"garbled": "int32", "gain": "int32", "n": "int64"})

    table_ = held.mapInPandas(gains, "garbled int, gain int, n long").groupBy("garbled", "gain").agg(F.sum("n").alias("n")).collect()
    wrong = lambda m: sum(r["n"] * 20 for r in table_ if not r["garbled"] and r["gain"] >= m) + sum(r["n"] for r in table_ if r["garbled"] and r["gain"] < m)
    margin = min(range(*MARGINS), key=lambda m: (wrong(m), m))
    clean = sum(r["n"] for r in table_ if not r["garbled"])
    changed = lambda m: sum(r["n"] for r in table_ if not r["garbled"] and r["gain"] >= m)
    later = next((m for m in range(LEAST_LATER, margin) if changed(m) <= CLEAN_ERRORS * clean), margin)
    return float(margin), float(later)


RESULT = T.StructType(
    [
        T.StructField("affected", T.BooleanType()),
        T.StructField("restored", T.StringType()),
        T.StructField("chains", T.ArrayType(T.StringType())),
        T.StructField("gain", T.DoubleType()),
        T.StructField("complete", T.BooleanType()),
    ]
)


def examined(documents: DataFrame) -> DataFrame:
    """(doc_id, affected, restored, chains, gain, complete) per row of ``documents``.

    ``restored`` is null where nothing was restored; ``complete`` tells whether no lost character remains. Null, empty
    and plain ASCII texts are not affected. Extra columns are ignored; equal rows give equal results.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(train(documents))
    margin, later = validated_margin(documents, model)

    def judge(texts: pd.Series) -> pd.DataFrame:
        scorer = None
        rows = []
        for text in texts:
            if text is None or not suspicious(text):
                rows.append((False, None, [], 0.0, True))
                continue
            if scorer is None:
                scorer = _scorer(model)
            restored, chains, won = restore(scorer, text, margin, later)
            remains = lost(restored)
            rows.append((bool(chains) or lost(text), restored if chains else None, chains, won, not remains))
        return pd.DataFrame(rows, columns=[f.name for f in RESULT.fields])

    # non-deterministic: the judgement must not be made once more for a filter on it
    found = documents.select("doc_id", F.pandas_udf(judge, RESULT).asNondeterministic()("text").alias("r"))
    return found.select("doc_id", "r.*")


_SCORERS: dict[int, Model] = {}


def _scorer(model) -> Model:
    """One model per Python worker."""
    key = id(model.value)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Model(model.value)
    return _SCORERS[key]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return examined(table(spark, folder, "documents")).where("affected AND doc_id IS NOT NULL").select("doc_id").distinct()


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The affected documents with their restored text."""
    return examined(table(spark, folder, "documents")).where("affected")


