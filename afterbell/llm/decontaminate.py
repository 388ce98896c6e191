"""Operator 5: benchmark passages in documents, by pigeonhole pieces and Myers' bit-parallel distance."""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afterbell.llm.common import in_parts

#: A block of test items: at most so many items and characters are broadcast at once.
BLOCK_ITEMS, BLOCK_CHARS = 4_000, 4_000_000


def normalise(text: str) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join(text.lower().split())


def best_match(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to any part of ``text`` and the first end of such a part, or None above ``budget``.

    Myers' bit-vector recurrence: one machine step on whole columns of the distance table for each character.
    """
    m = len(pattern)
    if not m:
        return None
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0) if m <= budget else None
    for j, c in enumerate(text, 1):
        equal = at.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        more, less = down | (~(horizontal | up) & full), up & horizontal
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = more << 1, less << 1  # a part may start anywhere: no cost comes in from the left
        up = (less | ~(vertical | more)) & full
        down = more & vertical & full
        if score <= budget and (best is None or score < best[0]):
            best = (score, j)
            if not score:
                break
    return best


def best_matches(pattern: str, windows: list[tuple[int, int]], text: str, budget: int) -> tuple[int, int] | None:
    """Like :func:`best_match` over many parts of a text at once: least distance in any of them and its first end in the text.

    The same recurrence in words of 64 bits (a carry goes from word to word), a column of all parts a step.
    """
    m, alphabet = len(pattern), {c: i for i, c in enumerate(dict.fromkeys(pattern))}
    words = -(-m // 64)
    equal = np.zeros((len(alphabet) + 1, words), np.uint64)  # the last row: a letter that the pattern hasn't, and the end of a part
    for i, c in enumerate(pattern):
        equal[alphabet[c], i // 64] |= np.uint64(1 << i % 64)
    one, top, last = np.uint64(1), np.uint64(63), np.uint64((m - 1) % 64)
    best: tuple[int, int] | None = None
    for k in range(0, len(windows), 4096):
        some = windows[k : k + 4096]
        width = max(b - a for a, b in some)
        codes = np.full((len(some), width), len(alphabet))
        for i, (a, b) in enumerate(some):
            codes[i, : b - a] = [alphabet.get(c, len(alphabet)) for c in text[a:b]]
        up, down = np.full((words, len(some)), ~np.uint64(0)), np.zeros((words, len(some)), np.uint64)
        score = np.full(len(some), m)
        least, where = score.copy(), np.zeros(len(some), np.int64)
        for j in range(width):
            more_in = less_in = np.zeros(len(some), np.uint64)
            for w in range(words):
                e = equal[codes[:, j], w]
                vertical = e | down[w]
                e = e | less_in
                horizontal = (((e & up[w]) + up[w]) ^ up[w]) | e
                more, less = down[w] | ~(horizontal | up[w]), up[w] & horizontal
                bit = last if w == words - 1 else top
                more_out, less_out = more >> bit & one, less >> bit & one
                more, less = more << one | more_in, less << one | less_in
                up[w], down[w] = less | ~(vertical | more), more & vertical
                more_in, less_in = more_out, less_out
            score = score + more_in.astype(np.int64) - less_in.astype(np.int64)
            better = score < least
            least[better], where[better] = score[better], j + 1
        for i in np.flatnonzero(least == least.min())[:1] if least.min() <= budget else ():
            low = int(least[i])
            end = min(a + int(w) for (a, _), w, d in zip(some, where.tolist(), least.tolist(), strict=True) if d == low)
            if best is None or low < best[0]:
                best = (low, end)
            elif low == best[0]:
                best = (low, min(end, best[1]))
    return best


#: Characters of the parts that are counted to rule items out, and hits of an item that are verified one by one.
GRAM, FEW = 3, 4


class Shared:
    """Items with the same piece at the same place. Within k edits an item of n characters keeps n - q + 1 - k q of its parts of q characters."""

    def __init__(self, matcher: Matcher, at: int, members: list[int]):
        self.at, self.members = at, members
        self.chars = max(len(matcher.items[i][1]) for i in members)
        self.budget = max(matcher.items[i][2] for i in members)
        self.seen: dict[str, list[int]] = {}
        self.matcher = matcher
        self.built = False

    def build(self) -> None:
        """Counts of parts by item, and the most that any item has of each; only when the piece is met."""
        rows = [self.matcher.parts(i) for i in self.members]
        self.owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        self.part, self.count = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        self.needed = np.array([len(self.matcher.items[i][1]) - GRAM + 1 - GRAM * self.matcher.items[i][2] for i in self.members])
        order = np.lexsort((-self.count, self.part))
        firsts = np.unique(self.part[order], return_index=True)
        self.most = dict(zip(firsts[0].tolist(), self.count[order][firsts[1]].tolist(), strict=True))
        self.place = np.searchsorted(firsts[0], self.part)
        self.built = True

    def possible(self, window: str) -> list[int]:
        """The items that the window can hold: all it takes to rule all of them out is the most that any has of each part."""
        if window not in self.seen:
            if not self.built:
                self.build()
            if len(self.seen) > 10_000:
                self.seen.clear()
            get = self.matcher.known.get
            counts = Counter(get(window[i : i + GRAM], -1) for i in range(len(window) - GRAM + 1))
            out: list[int] = []
            if sum(min(n, self.most.get(g, 0)) for g, n in counts.items()) >= self.needed.min():
                held = np.array([counts.get(g, 0) for g in self.most])
                have = np.minimum(held[self.place], self.count)
                out = [self.members[i] for i in np.flatnonzero(np.bincount(self.owner, have, len(self.members)) >= self.needed).tolist()]
            self.seen[window] = out
        return self.seen[window]


class Matcher:
    """Test items as an automaton of their pieces.

    A piece of one item leads to it. A piece that many items have at one place (items made from a template) leads to them as a group, and only
    those are verified whose own parts the window can hold.
    """

    def __init__(self, items: list[tuple[object, str]], max_error: float):
        self.items = [(item, text, int(len(text) * max_error)) for item, text in items if text]
        pieces: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, (_, text, budget) in enumerate(self.items):
            cuts = [len(text) * j // (budget + 1) for j in range(budget + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces[text[a:b]][a].append(i)
        self.known: dict[str, int] = {}
        self.counted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            alone, groups = [], []
            for a, members in places.items():
                short = [i for i in members if not self.items[i][2] or len(self.items[i][1]) - GRAM + 1 <= GRAM * self.items[i][2]]
                long = [i for i in members if i not in set(short)] if short else members
                alone += [(i, a) for i in (short if len(long) > 1 else members)]
                if len(long) > 1:
                    groups.append(Shared(self, a, long))
            self.automaton.add_word(piece, (len(piece), alone, groups))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def parts(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of an item's parts of a few characters, and how often it has each."""
        if i not in self.counted:
            text, known = self.items[i][1], self.known
            own = Counter(known.setdefault(text[j : j + GRAM], len(known)) for j in range(len(text) - GRAM + 1))
            self.counted[i] = np.array(list(own)), np.array(list(own.values()))
        return self.counted[i]

    def match(self, text: str | None, first_only: bool = False) -> list[tuple[object, int, int, int, int]]:
        """(item, distance, budget, characters of the item, end in the normalised text) of each item in the text."""
        text = normalise(text or "")
        out: list[tuple[object, int, int, int, int]] = []
        if not self.any:
            return out
        starts, exact = defaultdict(set), {}
        for end, (size, alone, groups) in self.automaton.iter(text):
            for i, a in alone:
                start = end - size + 1 - a
                if self.items[i][2]:
                    starts[i].add(start)
                elif i not in exact and not (text[start - 1 : start].isalnum() and text[start].isalnum()) and not (text[end].isalnum() and text[end + 1 : end + 2].isalnum()):
                    exact[i] = end + 1
            for group in groups:
                start = end - size + 1 - group.at
                for i in group.possible(text[max(0, start - group.budget) : start + group.chars + group.budget]):
                    starts[i].add(start)
        out += [(self.items[i][0], 0, 0, len(self.items[i][1]), end) for i, end in exact.items()]
        for i, found in starts.items():
            if first_only and out:
                return out
            item, pattern, budget = self.items[i]
            at = text.find(pattern)
            best = (0, at + len(pattern)) if at >= 0 else self._best(text, pattern, budget, sorted(found), first_only)
            if best:
                out.append((item, best[0], budget, len(pattern), best[1]))
        return out

    @staticmethod
    def _best(text: str, pattern: str, budget: int, found: list[int], first_only: bool) -> tuple[int, int] | None:
        """Least distance around the starts, and its first end."""
        windows = [(max(0, s - budget), min(len(text), s + len(pattern) + budget)) for s in found]
        if len(windows) > FEW:
            return best_matches(pattern, windows, text, budget)
        best = None
        for low, high in windows:
            hit = best_match(pattern, text[low:high], budget if best is None else best[0] - 1)
            if hit:
                best = (hit[0], low + hit[1])
                if first_only:
                    break
        return best


_MATCHERS: dict[str, Matcher] = {}


def _matcher(block, max_error: float) -> Matcher:
    """The block's automaton, built once in a worker process."""
    if block.value[0] not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[block.value[0]] = Matcher(block.value[1], max_error)
    return _MATCHERS[block.value[0]]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator:
    """Broadcasts of bounded blocks of test items, with normalised texts."""
    context, block, chars = benchmark.sparkSession.sparkContext, [], 0
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    for row in rows.toLocalIterator():
        text = normalise(row.text)
        if block and (len(block) >= BLOCK_ITEMS or chars + len(text) > BLOCK_CHARS):
            yield context.broadcast((uuid.uuid4().hex, block))
            block, chars = [], 0
        block.append((row.item, text))
        chars += len(text)
    if block:
        yield context.broadcast((uuid.uuid4().hex, block))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_error: float = 0.08,
) -> DataFrame:
    """Every (document, test item) where the document holds the item within ``max_error`` edits per character.

    Texts are lower-cased and white space is collapsed. An item of n characters has a budget of
    k = floor(n * max_error) edits and is cut into k + 1 pieces; within k edits one piece stays
    whole, so exact piece hits find every match; the window around each hit is verified with Myers'
    bit-parallel distance. Items come in bounded blocks, each broadcast against all documents in
    one pass without a shuffle; whole texts are searched.

    Returns ``id_col``, ``item_col``, distance, budget, item_chars, norm_end. Defined cases: null or
    empty texts and items match nothing; an item so short that its budget is 0 is found as it stands,
    with no letter or digit going on at its borders; repeated rows give repeated results; an empty table gives an empty
    result; further columns are ignored.
    """
    spark = docs.sparkSession
    types = [docs.select(id_col).schema[0].dataType.simpleString(), benchmark.select(item_col).schema[0].dataType.simpleString()]
    schema = f"_doc {types[0]}, _item {types[1]}, distance int, budget int, item_chars int, norm_end int"
    pair = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(block, max_error)
            for batch in in_parts(batches):
                found = [(k, *hit) for k, text in enumerate(batch.column(1).to_pylist()) for hit in matcher.match(text)]
                columns = list(zip(*found, strict=True)) if found else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], out_item), *[pa.array(c, pa.int32()) for c in columns[2:]]],
                    names=["_doc", "_item", "distance", "budget", "item_chars", "norm_end"],
                )

        out_item = pa.int64() if types[1] == "bigint" else pa.int32() if types[1] == "int" else pa.string()
        out = out.unionAll(pair.mapInArrow(run, schema))
    return out.withColumnRenamed("_doc", id_col).withColumnRenamed("_item", item_col)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_error: float = 0.08
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item (see :func:`find_contamination`); one pass, no shuffle."""
    where = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(block, max_error)
            for batch in in_parts(batches):
                yield batch.filter(pa.array([not matcher.match(t, first_only=True) for t in batch.column(where).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
