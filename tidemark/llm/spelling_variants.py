"""Spelling variants: words that differ by one code point, grouped under the commonest spelling.

One error leaves a word's first or second half as it was, at the start or at the end of the other word.  So the halves of all words
are the patterns of Aho-Corasick automata, dealt to shards by their hash; every word is scanned by the shards that can hold a half
of its neighbours, and a match counts if it lies where the half does in a word of a fitting length.  What is left of both words must then differ
by one code point, which is looked up, so that a half shared by many words isn't compared with all of them.
"""

from __future__ import annotations

import collections
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save
from .textcore import releasing

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Patterns that one shard's automaton holds, about, and words that share a half in one shard.
SHARD, CROWDED = 50_000, 20_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUN = re.compile("[a-zÀ-ÿ]+")


def typos(doc_id: str, text: str, every: int = 97) -> list[str]:
    """The runs of letters of a text, in lower case; one in `every`, by the hash of document and run, has lost a letter."""
    seed = zlib.crc32(f"{doc_id}:".encode())
    runs = _RUN.findall(text.encode().translate(_LOWER).decode())
    for k, run in enumerate(runs):
        h = zlib.crc32(run.encode(), seed)
        if h % every == 0:
            at = h % len(run)
            runs[k] = run[:at] + run[at + 1 :]
    return runs


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): all words of whole texts that are long and frequent enough; a null text has none, a null id counts as empty."""

    @releasing
    def count(batches):
        seen: collections.Counter = collections.Counter()

        def out():
            batch = pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update(typos(i, t))
                if len(seen) > COUNTED:
                    yield out()
        yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).where("t is not null")
    return rows.mapInArrow(count, "word string, n long").where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Half:
    """Words of one length that share a half, found by what the other half is."""

    def __init__(self):
        self.words: dict[str, tuple[int, str]] = {}
        self.holes: dict[tuple[int, str], list[str]] = {}
        self.shorter: dict[str, list[str]] = {}

    def add(self, rest: str, n: int, word: str) -> None:
        self.words[rest] = (n, word)

    def near(self, rest: str, longer: int):
        """(n, word) of those whose rest is that of a word shorter (-1), as long (0) or longer (1) by one and has one error against it.

        A word may come twice."""
        cut = [rest[:i] + rest[i + 1 :] for i in range(len(rest))]
        if longer < 0:
            yield from (self.words[c] for c in cut if c in self.words)
        elif longer == 0:
            if not self.holes:
                for r in self.words:
                    for i in range(len(r)):
                        self.holes.setdefault((i, r[:i] + r[i + 1 :]), []).append(r)
            for i, c in enumerate(cut):
                yield from (self.words[r] for r in self.holes.get((i, c), ()) if r != rest)
        else:
            if not self.shorter:
                for r in self.words:
                    for i in range(len(r)):
                        self.shorter.setdefault(r[:i] + r[i + 1 :], []).append(r)
            yield from (self.words[r] for r in self.shorter.get(rest, ()))


class Shard:
    """The automaton of some words' halves."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.halves: dict[tuple[bool, int, str], Half] = collections.defaultdict(Half)

    def add(self, word: str, n: int, second: bool) -> None:
        cut = len(word) // 2
        piece, rest = (word[cut:], word[:cut]) if second else (word[:cut], word[cut:])
        if piece not in self.automaton:
            self.automaton.add_word(piece, piece)
        self.halves[second, len(word), piece].add(rest, n, word)

    def near(self, word: str) -> dict[str, int]:
        """Words one error away, with their counts.  A pair whose first half matches counts there only."""
        found: dict[str, int] = {}
        size = len(word)
        for end, piece in self.automaton.iter(word):
            k = len(piece)
            for length in (size - 1, size, size + 1):
                if end == k - 1 and length // 2 == k and (h := self.halves.get((False, length, piece))):
                    found.update((w, n) for n, w in h.near(word[k:], length - size))
                if end == size - 1 and length - length // 2 == k and (h := self.halves.get((True, length, piece))):
                    found.update((w, n) for n, w in h.near(word[: size - k], length - size) if not word.startswith(w[: length // 2]))
        return found


def _halves(word: Column) -> Column:
    """Both halves of a word as (second, length, piece)."""
    length = F.char_length(word)
    cut = (length / 2).cast("int")
    return F.array(F.struct(F.lit(False).alias("second"), length.alias("length"), F.substring(word, F.lit(1), cut).alias("piece")), F.struct(F.lit(True).alias("second"), length.alias("length"), F.substring(word, cut + 1, length).alias("piece")))


def _places(word: Column) -> Column:
    """Halves that a word's neighbours can have: its starts and ends, for lengths that differ by one at most."""
    out = []
    for d in (-1, 0, 1):
        length = F.char_length(word) + d
        cut = (length / 2).cast("int")
        out.append(F.struct(F.lit(False).alias("second"), length.alias("length"), F.substring(word, F.lit(1), cut).alias("piece")))
        out.append(F.struct(F.lit(True).alias("second"), length.alias("length"), F.substring(word, F.char_length(word) - (length - cut) + 1, length).alias("piece")))
    return F.array(*out)


def neighbours(words: DataFrame, shard: int = SHARD, crowded: int = CROWDED) -> DataFrame:
    """(word, n_near, best): how many words are one error away, and the commonest of them as (-n, word), for words that have any.

    A half that more than `crowded` words share is spread over several shards, each of which scans all words with that
    half.  Tasks hold the automaton of one shard's halves and stream through the words; they hand on a row for each word."""
    spark = words.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * words.count() // shard))
    key = ["half.second", "half.length", "half.piece"]
    patterns = words.select("word", "n", F.explode(_halves(F.col("word"))).alias("half"))
    scans = words.select("word", "n", F.explode(_places(F.col("word"))).alias("half")).where(f"half.length >= {LEAST_LENGTH}")
    # at most 2 / crowded of the words: joined, or sent to all tasks if Spark finds it small
    spread = patterns.groupBy("half").agg(F.count("*").alias("_c")).where(F.col("_c") > crowded).select("half", F.ceil(F.col("_c") / crowded).cast("long").alias("_s"))

    def dealt(rows: DataFrame, salts: Column, scan: bool) -> DataFrame:
        salted = rows.join(spread, "half", "left").withColumn("_salt", F.explode(salts))
        return salted.select(F.pmod(F.xxhash64(*key, "_salt"), F.lit(parts)).cast("int").alias("shard"), F.lit(scan).alias("scan"), "word", "n", "half.second")

    n = F.coalesce("_s", F.lit(1).cast("long"))
    both = dealt(patterns, F.array(F.pmod(F.xxhash64("word"), n)), False).unionByName(dealt(scans, F.sequence(F.lit(0).cast("long"), n - 1), True))
    rows = both.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "scan", "word")

    @releasing
    def run(batches):
        at, shard_, ready, last = None, None, False, None
        for batch in batches:
            out = []
            for k, scan, word, n, second in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != at:
                    at, shard_, ready, last = k, Shard(), False, None
                if not scan:
                    shard_.add(word, n, second)
                    continue
                if not ready:
                    ready = True
                    shard_.automaton.make_automaton()
                if word == last or not shard_.halves:
                    continue
                last = word
                found = shard_.near(word)
                if found:
                    m, w = min((-m, w) for w, m in found.items())
                    out.append((word, len(found), m, w))
            yield pa.record_batch([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "m", "w"])

    found = rows.mapInArrow(run, "word string, n_near long, m long, w string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("m", "w")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form that is reached.  Each round follows twice as many steps; counts at
    least double with every step, so there are few rounds."""
    far = save(forms.select("word", F.col("form").alias("root")))
    while True:
        on = far.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = save(far.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if new.where("_moved").isEmpty():
            return new.select("word", "root")
        far = new.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the corpus (see `count_words`); `form` is the commonest word one error away,
    if it is twice as common (ties: the first in code-point order), and `root` the last form reached from a word.

    Documents without text or letters have no words; repeated rows count as often as they occur; texts of any length are taken
    whole; an empty table has no words; other columns are ignored."""
    words = save(count_words(docs))
    near = neighbours(words)
    commonest = F.when(-F.col("best.m") >= 2 * F.col("n"), F.col("best.w"))
    linked = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), commonest.alias("form"), F.when(commonest.isNotNull(), -F.col("best.m")).alias("form_n"))
    linked = save(linked)
    return linked.join(roots(linked.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
