"""Operator 11: spelling variants grouped by anagram hashing."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afterbell.llm.common import drop_scratch, materialize, partitions

LETTERS = "A-Za-zÀ-ÿ"
RUN = re.compile(f"[{LETTERS}]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Characters of a text that are looked at together, and distinct words that a task holds before it hands them on.
SLICE, HELD_WORDS = 1 << 20, 200_000
#: A letter's value is its code point to this power, so that sums of few letters seldom agree by chance.
POWER = 5


def letter_values(codes: np.ndarray) -> np.ndarray:
    """Values of code points, modulo 2^64."""
    return codes.astype(np.uint64) ** np.uint64(POWER)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def order_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place i of a word: a sum over the letters before i by place from the start, and over those from i on by place from the end."""
    places = np.arange(len(codes), dtype=np.uint64) << np.uint64(21)
    head = np.zeros(len(codes) + 1, np.uint64)
    tail = np.zeros(len(codes) + 1, np.uint64)
    codes = codes.astype(np.uint64) + np.uint64(1)
    np.cumsum(_mixed(places + codes), out=head[1:])
    tail[:-1] = np.cumsum(_mixed(~(places + codes[::-1])))[::-1]
    return head, tail


def _slices(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text that cut no run of letters."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        if end < len(text) and (rest := RUN.match(text, end)):
            end = rest.end()
        yield at, end
        at = end


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_count: int = 5, noise: int = 199) -> DataFrame:
    """Words and their numbers of occurrences n over all whole texts, with the seeded misspellings (see :func:`group_variants`)."""
    long_run = re.compile(f"[{LETTERS}]{{{least_chars},}}")  # shorter runs can't become words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc32, counts = zlib.crc32, Counter()

        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not data:
                    continue
                text, seed = data.translate(LOWER).decode(), crc32(f"{doc_id}:".encode())
                for at, end in _slices(text):
                    runs = long_run.findall(text, at, end)
                    counts.update(runs)
                    for word, h in zip(runs, [crc32(w.encode(), seed) for w in runs], strict=True):
                        if not h % noise:
                            counts[word] -= 1
                            k = h % len(word)
                            if len(word) > least_chars:
                                counts[word[:k] + word[k + 1 :]] += 1
                    if len(counts) > HELD_WORDS:
                        yield handed_on()
        if counts:
            yield handed_on()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _anagram_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, word, n): a row with the word's key itself (letter 0) and one with the key less each of its letters."""
    for batch in batches:
        ids, keys, rest, letters = [], [], [], []
        for i, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
            key, own = letter_values(codes).sum(dtype=np.uint64), np.unique(codes)
            ids.append(np.full(len(own) + 1, i))
            keys.append(np.full(len(own) + 1, key))
            rest.append(np.append(key, key - letter_values(own)))
            letters.append(np.append(0, own))
        if ids:
            columns = [np.concatenate(ids), np.concatenate(keys).view(np.int64), np.concatenate(rest).view(np.int64), np.concatenate(letters).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "key", "rest", "letter"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, word, n, letters): the holes that those letters leave in the word and, for letter 0, the gaps between its letters."""
    names = ["id", "n", "at", "head", "tail", "rest", "hole", "first"]
    for batch in batches:
        parts: list[list[np.ndarray]] = []
        held = 0

        def together(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)

        for i, word, n, letters in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
            head, tail = order_sums(codes)
            values = letter_values(codes)
            key = values.sum(dtype=np.uint64)
            at = np.flatnonzero(np.isin(codes, letters))
            first = np.ones(len(at), bool)
            first[at > 0] = codes[at[at > 0]] != codes[at[at > 0] - 1]
            sides = [(at, head[at], tail[at + 1], key - values[at], np.ones(len(at), bool), first)]
            if 0 in letters:
                gaps = np.arange(len(codes) + 1)
                sides.append((gaps, head, tail, np.full(len(gaps), key), np.zeros(len(gaps), bool), np.ones(len(gaps), bool)))
            for where, before, after, rest, hole, lead in sides:
                parts.append([np.full(len(where), i), np.full(len(where), n), where, before.view(np.int64), after.view(np.int64), rest.view(np.int64), hole, lead])
                held += len(where)
            if held > 500_000:
                yield together(parts)
                parts, held = [], 0
        if parts:
            yield together(parts)


def near_words(words: DataFrame) -> DataFrame:
    """Of words (id in code-point order, word, n): id, n_near, and best (least by falling n and id) of the words one edit away."""
    keyed = materialize(words.select("id", "word", "n").mapInArrow(_anagram_keys, "id long, key long, rest long, letter int"), "anagram-keys")
    # a key, or a key less a letter, that words of two keys have: these differ by the value of a letter added, removed or exchanged
    shared = keyed.groupBy("rest").agg(F.min("key").alias("_low"), F.max("key").alias("_high")).where("_low < _high").select("rest")
    letters = keyed.join(shared, "rest", "leftsemi").groupBy("id").agg(F.collect_set("letter").alias("letters"))
    places = words.select("id", "word", "n").join(letters, "id").mapInArrow(
        _places, "id long, n long, at long, head long, tail long, rest long, hole boolean, first boolean"
    )
    met = (
        places.groupBy("rest", "at", "head", "tail")
        .agg(F.collect_list(F.struct((-F.col("n")).alias("less"), "id", "hole", "first")).alias("m"))
        .where(F.size("m") > 1)
    )
    # holes meet holes (a letter exchanged), and the first hole of equal letters meets a gap (a letter added or removed)
    partners = "filter(m, y -> y.id <> x.id and (x.hole and y.hole or x.hole and x.first and not y.hole or y.hole and y.first and not x.hole))"
    links = met.select(F.explode(F.expr(f"transform(m, x -> struct(x.id as id, {partners} as p))")).alias("l")).select(
        "l.id", F.size("l.p").alias("k"), F.expr("array_min(transform(l.p, y -> struct(y.less as less, y.id as id)))").alias("best")
    )
    return links.where("k > 0").groupBy("id").agg(F.sum("k").cast("long").alias("n_near"), F.min("best").alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """The last id of each chain of (id, form), by pointer doubling: as many rounds as the logarithm of the longest chain."""
    at = materialize(forms.select("id", F.col("form").alias("root")), "variant-roots")
    while True:
        step = at.alias("a").join(at.select(F.col("id").alias("root"), F.col("root").alias("further")), "root", "left")
        after = materialize(step.select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        drop_scratch(at)
        at = after.select("id", "root")
        if not after.where("moved").limit(1).count():
            return at


def group_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_count: int = 5, noise: int = 199, factor: int = 5
) -> DataFrame:
    """Words of a corpus with the words one edit away, the form each is a variant of, and the root of its chain of forms.

    Words are maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z lower-cased; of each run whose
    CRC-32 of ``<id>:<run>`` is a multiple of ``noise`` one letter goes (a seeded misspelling). Kept are those of
    ``least_chars`` letters and ``least_count`` occurrences. A word's key is the sum of its letters' fifth powers: anagrams share
    it, and words one edit apart differ by one letter's value or the difference of two. So keys are joined by key and key less a
    letter; only words that meet there have the order of their letters verified: the letters around a hole or gap as sums that
    depend on place, 64 bits on each side beside the key. At most 91 words share a hole (one for each letter, and the word
    without it), so groups are small however many anagrams there are, and no pairs are listed.

    Texts are read once and never shuffled: tasks count words and hand on at most 200,000 at a time.

    Returns word, form (near word of largest n, the first in code-point order of equals, if its n is at least ``factor`` times
    the word's; else null), root, n, n_near, form_n. Defined cases: null or empty texts have no words; a null id counts as
    empty text; repeated rows count as often as they occur; a text or word of any length is taken whole; an empty table gives an
    empty result; further columns are ignored.
    """
    n_parts = partitions(docs.sparkSession)
    counted = materialize(count_words(docs, id_col, text_col, least_chars, least_count, noise), "variant-words")
    # ids in code-point order: ranges in order, rows in order inside them
    words = materialize(
        counted.repartitionByRange(n_parts, "word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "variant-ids"
    )
    near = materialize(near_words(words), "variant-near")
    found = words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "best")
    formed = found.withColumn("form_n", F.when(-F.col("best.less") >= factor * F.col("n"), -F.col("best.less"))).withColumn(
        "form", F.when(F.col("form_n").isNotNull(), F.col("best.id"))
    )
    roots = follow(formed.where("form is not null"))
    name = words.select("id", "word")
    chains = (
        formed.where("form is not null")
        .select("id", "form")
        .join(roots, "id")
        .join(name.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form")
        .join(name.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
        .select("id", "form_word", "root_word")
    )
    return formed.join(chains, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
