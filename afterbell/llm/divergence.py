"""Operator 13: how the sources of a language diverge in their words, from a vocabulary automaton's counts."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from afterbell.llm.common import marks, materialize

#: ASCII that isn't a letter becomes a space, A-Z become lower case; bytes of other characters stay.
TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of text that share an automaton, and entries that a task holds before it hands them on.
ROUND_BYTES, HELD = 12_000_000, 300_000
#: Sources of a block, and postings that a task compares at a time on average.
BLOCK_SOURCES, SLICE_POSTINGS = 512, 200_000
UNIT = 1_000_000_000
#: Counts below it, times :data:`UNIT`, fit in a long.
FITS = 9_000_000_000


def _pieces(data: bytes) -> Iterator[bytes]:
    """Delimited text in parts of a few megabytes that cut no term."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + ROUND_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def document_frequencies(rows: DataFrame) -> DataFrame:
    """First pass over (lang, source, text): lang, term, df, the number of the language's rows that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        held = 0

        def handed_on() -> pa.RecordBatch:
            langs = [lang for lang, c in found.items() for _ in range(len(c))]
            terms = pa.array([t for c in found.values() for t in c], pa.binary()).cast(pa.string())
            out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), terms, pa.array([n for c in found.values() for n in c.values()], pa.int64())], names=["lang", "term", "df"])
            found.clear()
            return out

        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                terms: set[bytes] = set()
                for piece in _pieces(data.translate(TO_TERMS)):
                    terms.update(piece.split())
                found[lang].update(terms)
                held += len(terms)
                if held > HELD and (held := sum(map(len, found.values()))) > HELD // 2:
                    yield handed_on()
                    held = 0
        if found:
            yield handed_on()

    return rows.mapInArrow(run, "lang string, term string, df long").groupBy("lang", "term").agg(F.sum("df").alias("df"))


def recounted(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Second pass: lang, source, term, n, the occurrences of kept terms (lang, term) in each group, and lang_n, those in the language.

    A task builds an automaton of the kept terms that its own texts hold, delimiter-padded, for every twelve megabytes of text. Which
    they are a bitmap of kept terms tells (16 MB at most, so the vocabulary may be of any size); the few others it lets
    through are ruled out by a join. A term is handed on once with its sources, and all that follows has its rows together by (lang, term).
    """
    shared, bits = marks(kept.select(F.concat_ws(" ", "lang", "term").alias("_key")), "_key")

    def counted(lang: str, by_source: dict[str, list[bytes]]) -> pa.RecordBatch | None:
        texts = {source: b" ".join((b"", *parts, b"")) for source, parts in by_source.items()}
        by_source.clear()
        terms = list(dict.fromkeys(chain.from_iterable(t.split() for t in texts.values())))  # frequent ones first, so that the automaton finds them first
        prefix = lang.encode() + b" "
        cells = np.array([xxhash.xxh64_intdigest(prefix + t, 42) for t in terms], np.uint64).view(np.int64) % bits
        held = (shared.value[cells >> 3] >> (cells & 7).astype(np.uint8) & 1) == 1
        terms = [t.decode() for t, h in zip(terms, held.tolist(), strict=True) if h]
        if not terms:
            return None
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(terms):
            automaton.add_word(f" {term} ", i)
        automaton.make_automaton()
        found = []
        for k, text in enumerate(texts.values()):
            hits = Counter(map(itemgetter(1), automaton.iter(text.decode())))
            found.append((np.fromiter(hits.keys(), np.int64, len(hits)), np.full(len(hits), k), np.fromiter(hits.values(), np.int64, len(hits))))
        at, source, n = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=len(terms))).astype(np.int32)  # every term is in some text
        offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
        sources = pa.array(list(texts), pa.string()).take(pa.array(source[order]))
        columns = [pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, pa.array(n[order]))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "sources", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, dict[str, list[bytes]]] = defaultdict(lambda: defaultdict(list))
        size = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            while texts:
                out = counted(*texts.popitem())
                if out is not None:
                    yield out

        for batch in batches:
            for lang, source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                for piece in _pieces(data.translate(TO_TERMS)):
                    texts[lang][source].append(piece)
                    size += len(piece)
                    if size > ROUND_BYTES:
                        yield from handed_on()
                        size = 0
        yield from handed_on()

    found = rows.mapInArrow(run, "lang string, term string, sources array<string>, counts array<long>").repartition("lang", "term")
    each = found.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    counts = each.groupBy("lang", F.col("e.sources").alias("source"), "term").agg(F.sum("e.counts").alias("n"))
    counts = counts.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term")))
    return counts.join(kept.select("lang", "term"), ["lang", "term"], "leftsemi")  # the window has sorted them


def share(count: str, total: str, terms: str) -> F.Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), exactly: in longs where the product fits in one, else in decimals."""
    wide = f"cast(1 + ((cast({UNIT} as decimal(10,0)) * (cast({count} as decimal(20,0)) + 1)) div (cast({total} as decimal(20,0)) + {terms})) as long)"
    return F.expr(f"case when {count} < {FITS} then 1 + ({UNIT}L * ({count} + 1L)) div ({total} + {terms}) else {wide} end")


def excess(p: str, q: str) -> F.Column:
    """floor((p - q)^2 / q); both are at most 10^9 + 1, so that the square fits in a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _pair_sums(key: tuple, postings: pa.Table, sources: pa.Table) -> pa.Table:
    """Of one slice of terms and two blocks of sources: what terms with an occurrence add to the sums of ordered pairs, beside f(p0, q0) for each term.

    A term that only one of two sources has depends on the other's floor p0 alone, so these are summed by (source, p);
    terms of both are set right by what they share.
    """
    lang, low, high = (k.as_py() for k in key[:3])
    no, block, floor = (sources.column(c).to_numpy() for c in ("source_no", "source_block", "p0"))
    order = np.argsort(no)
    no, block, floor = no[order], block[order], floor[order]
    row_no, p0, column_no, q0 = no[block == low], floor[block == low], no[block == high], floor[block == high]
    base = _excess(p0[:, None], q0[None, :])
    out = np.zeros((len(row_no), len(column_no)), np.int64)
    term = postings.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    own_no, own_block, own_p = (postings.column(c).to_numpy() for c in ("no", "block", "p"))
    order = np.argsort(term, kind="stable")
    term, own_no, own_block, own_p = term[order], own_no[order], own_block[order], own_p[order]
    sides = []
    for of, numbers, by_row in ((low, row_no, True), (high, column_no, False)):
        here = own_block == of
        at, p = np.searchsorted(numbers, own_no[here]), own_p[here]
        sides.append((term[here], at, p))
        alike, k = np.unique(np.stack((at, p)), axis=1, return_counts=True)
        for a in range(0, len(k), 2048):
            i, v, many = alike[0, a : a + 2048], alike[1, a : a + 2048, None], k[a : a + 2048, None]
            if by_row:
                np.add.at(out, i, (_excess(v, q0[None, :]) - base[i]) * many)
            else:
                np.add.at(out.T, i, (_excess(p0[None, :], v) - base.T[i]) * many)
    (t, i, p), (u, j, q) = sides
    first, last = np.searchsorted(u, t, "left"), np.searchsorted(u, t, "right")
    upto = np.concatenate(([0], np.cumsum(last - first)))
    a = 0
    while a < len(t):  # a million pairs of postings of one term at a time
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + 1_000_000, "right")) - 1)
        size = last[a:b] - first[a:b]
        x = np.repeat(np.arange(a, b), size)
        y = np.arange(len(x)) - np.repeat(upto[a:b] - upto[a], size) + np.repeat(first[a:b], size)
        ix, jy, px, qy = i[x], j[y], p[x], q[y]
        np.add.at(out, (ix, jy), _excess(px, qy) - _excess(px, q0[jy]) - _excess(p0[ix], qy) + base[ix, jy])
        a = b
    i, j = np.nonzero(out)
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "no": row_no[i], "other": column_no[j], "more": out[i, j]})


def _pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of sources of a language; groups: lang, source, no, block, blocks, slices, p0, total, terms."""
    # a source's rows meet those of every block, in both orders; a pair of a block with itself needs them once
    meets = F.expr("array_distinct(flatten(transform(sequence(0, blocks - 1), b -> array(struct(block as low, b as high), struct(b as low, block as high)))))")
    met = groups.where("terms > 0").withColumn("m", F.explode(meets))
    sources = met.select("lang", "m.low", "m.high", F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"), F.col("no").alias("source_no"), F.col("block").alias("source_block"), "p0")
    # the few rows of a source are multiplied, not its many postings
    dealt = counts.join(met, ["lang", "source"]).select(
        "lang", "m.low", "m.high", F.expr("cast(pmod(xxhash64(term), slices) as int)").alias("slice"), "term", "no", "block", share("n", "total", "terms").alias("p")
    )
    keys = ["lang", "low", "high", "slice"]
    sums = (
        dealt.groupBy(*keys)
        .cogroup(sources.groupBy(*keys))
        .applyInArrow(_pair_sums, "lang string, no long, other long, more long")
        .groupBy("lang", "no", "other")
        .agg(F.sum(F.col("more").cast("decimal(30,0)")).alias("more"))
    )
    one, two = groups.alias("a"), groups.select("lang", F.col("source").alias("item"), F.col("no").alias("other"), F.col("p0").alias("q0")).alias("b")
    return (
        one.join(two, "lang")
        .where("no <> other")
        .join(sums, ["lang", "no", "other"], "left")
        .select("lang", "source", "item", F.when(F.col("terms") > 0, F.expr("cast(cast(terms as decimal(20,0)) * (((p0 - q0) * (p0 - q0)) div q0) + coalesce(more, 0) as long)")).otherwise(0).cast("long").alias("value"))
    )


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_df: int = 3, ranks: int = 200) -> DataFrame:
    """How far each source's words are from those of each other source of its language, and which words set it apart.

    Terms are runs of letters and of characters outside ASCII, A-Z lower-cased; a language keeps the V terms in at least
    ``least_df`` of its rows. Two passes over the texts, neither of which shuffles them: exact document frequencies, then occurrences of
    kept terms by an automaton (:func:`recounted`). With p = 1 + floor(10^9 (count + 1) / (N + V)) and f = floor((p - q)^2 / q)
    in whole numbers, part ``pair`` ranks the other sources of the language by f summed over all kept terms, and part ``term``
    the terms that a source has more of than its language, down to ``ranks``.

    Sums over pairs come from postings, the terms that a source has; blocks of 512 sources meet in slices of terms, so a task
    holds a matrix of 512 x 512 whatever the number of sources. Every pair of sources is a row of the result.

    Returns lang, source, part, item, value, rank. Defined cases: null text, lang and source are empty strings; a text without
    terms counts for its group only; a language with no kept terms has pairs of value 0 and no terms; a language of one source has no
    pairs; repeated rows count as often as they occur; ties go to the item first in UTF-8; an empty table gives an empty result;
    further columns are ignored.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for a, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    kept = materialize(document_frequencies(rows).where(F.col("df") >= least_df), "divergence-terms")
    counts = materialize(recounted(rows, kept), "divergence-postings")
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("postings"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    lang_sizes = sizes.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.expr(f"cast(1 + sum(postings) div {SLICE_POSTINGS} as int)").alias("slices"))
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = materialize(
        rows.select("lang", "source")
        .distinct()
        .join(sizes, ["lang", "source"], "left")
        .join(terms, "lang", "left")
        .join(lang_sizes, "lang", "left")
        .select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.coalesce("slices", F.lit(1)).alias("slices"))
        .withColumn("no", (F.row_number().over(by_source) - 1).cast("long"))
        .withColumn("block", F.expr(f"cast(no div {BLOCK_SOURCES} as int)"))
        .withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1)
        .withColumn("p0", F.when(F.col("terms") > 0, share("0", "total", "terms")).otherwise(1)),
        "divergence-groups",
    )
    postings = counts.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total", "terms"), "q": share("lang_n", "lang_total", "terms")})
    item = F.col("item")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), item)
    pairs = _pairs(groups, counts).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    marked = (
        postings.where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess("p", "q").alias("value"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= ranks)
    )
    return pairs.unionByName(marked)
