"""Operator 6: long byte strings that repeat anywhere in the corpus, by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afterbell.llm.common import hits, in_parts, mark_cell, marks, materialize, partitions

#: Bytes of an anchor (a power of two); bytes of text worked on at once; bytes of contexts for one transform.
ANCHOR, SLICE, TEXT = 64, 500_000, 2_000_000
#: Windows around an anchor are told apart by ranges of so many offsets.
RANGE = 16
#: Anchors with more different contexts than this don't go to one task as bytes; their windows are hashed and counted.
HOT = 20_000
#: Tasks over which the copies of a text are spread when they meet its ranges.
PLACES = 8

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _RANDOM.integers(2**40, 2**62, 8).astype(np.uint64) | np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)
#: An anchored context: anchor hash, hash of the context, text key, first byte, last byte + 1, occurrences, place of the anchor in it.
CONTEXT = np.dtype([("h", "<u8"), ("c", "<u8"), ("k1", "<u8"), ("k2", "<u4"), ("lo", "<u4"), ("hi", "<u4"), ("n", "<u4"), ("p", "<u2")])
#: Bytes of a text that go.
GONE = np.dtype([("k1", "<u8"), ("k2", "<u4"), ("lo", "<u4"), ("hi", "<u4")])


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (a power of two) from each place, by folding halves."""
    h, step = _BYTE[data], 1
    while step < size:
        h = h[:-step] * _FOLD[step.bit_length() - 1] + h[step:]
        step *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    least, step = values, 1
    while step * 2 <= width:
        least, step = np.minimum(least[:-step], least[step:]), step * 2
    return np.minimum(least[: len(least) - (width - step)], least[width - step :]) if step < width else least


def pieces(data: bytes, length: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of parts of at most ``size`` bytes that overlap by ``length`` - 1, so that each window lies in one of them."""
    for a in range(0, max(1, len(data) - length + 1), size - length + 1):
        yield a, data[a : a + size]


def anchored_contexts(
    texts: list[bytes], keys: list[bytes], counts: list[int], length: int, anchor: int, places: list[int] | None = None
) -> np.ndarray:
    """Contexts of all windows of ``length`` bytes of the texts, which may be parts that start at ``places``.

    The anchor of a window is its first least-hashed ``anchor``-gram, which the window's bytes alone
    decide; neighbouring windows with one anchor form a context. Equal windows have equal anchors at
    equal offsets, so they can only stand in contexts of one anchor hash.
    """
    sizes = np.array([len(t) for t in texts])
    joined = b"".join(texts)
    if len(joined) > int(_PLACE) + 1:
        raise ValueError(f"{len(joined)} bytes at once are more than places can count")
    n = len(joined) - length + 1
    if n <= 0:
        return np.zeros(0, CONTEXT)
    data = np.frombuffer(joined, np.uint8)
    h = gram_hashes(data, anchor)
    place = np.arange(len(h), dtype=np.uint64)
    at = (sliding_least((h & ~_PLACE) | place, length - anchor + 1)[:n] & _PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[:n]
    valid = np.arange(n) + length <= np.cumsum(sizes)[owner]
    first = valid & np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))
    lo = np.flatnonzero(first)
    stops = np.concatenate((np.flatnonzero(~valid), [n]))
    last = np.minimum(np.concatenate((lo[1:], [n])), stops[np.searchsorted(stops, lo)])[: len(lo)] - 1
    hi, offset, own = last + length, at[lo] - lo, owner[lo]
    out = np.zeros(len(lo), CONTEXT)
    digest = xxhash.xxh3_64_intdigest
    out["h"] = h[at[lo]]
    out["c"] = [digest(joined[a:b], s) for a, b, s in zip(lo.tolist(), hi.tolist(), offset.tolist(), strict=True)]
    packed = np.frombuffer(b"".join(keys), np.dtype([("k1", "<u8"), ("k2", "<u4")]))
    out["k1"], out["k2"] = packed["k1"][own], packed["k2"][own]
    begin = (np.cumsum(sizes) - sizes - np.array(places or [0] * len(texts)))[own]
    out["lo"], out["hi"], out["n"], out["p"] = lo - begin, hi - begin, np.array(counts)[own], offset
    return out


def window_classes(symbols: np.ndarray, length: int) -> np.ndarray:
    """The number of each place's class of equal ``length``-symbol strings, for a text of symbols >= 0 (strings may run over its end).

    The places are sorted by their first symbols, at least ``length``; the symbols before the places,
    in that order, are the Burrows-Wheeler transform. Breadth-first, intervals of places with a
    common prefix are extended by one symbol in front: an extension of level l that ends at a border
    without a value sets it to l, the common prefix of its two sides, and is extended in its turn.
    So common prefixes come out by increasing value; the expansion stops at ``length``, and borders
    that have no value by then lie inside classes.
    """
    symbols = np.append(symbols + 1, 0)  # an end below all symbols
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    depth = max(1, 63 // bits)
    padded = np.concatenate((symbols, np.zeros(depth, np.int64))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(depth):
        key = (key << np.uint64(bits)) | padded[j : j + n]
    while True:  # prefix doubling
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        if depth >= length:
            break
        after = np.zeros(n, np.int64)
        after[: max(0, n - depth)] = rank[depth:] + 1
        key = (rank.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        depth *= 2
    transform, head = symbols[order - 1], symbols[order]
    step = np.empty(n, np.int64)  # where the place before each place stands: equal symbols keep their order
    step[np.argsort(transform, kind="stable")] = np.arange(n)
    border = np.full(n + 1, -1, np.int32)
    border[[0, n]] = 0
    low, high = np.array([0]), np.array([n])
    for level in range(length):
        sizes = high - low
        total = int(sizes.sum())
        if not total:
            break
        target = step[np.repeat(low - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(total)]
        owner = np.repeat(np.arange(len(low)), sizes)
        if total * 8 > n:
            owners = np.full(n, -1)
            owners[target] = owner
            target = np.flatnonzero(owners >= 0)
            owner = owners[target]
        else:
            by = np.argsort(target)
            target, owner = target[by], owner[by]
        starts = np.concatenate(([True], (np.diff(target) != 1) | (np.diff(owner) != 0) | (np.diff(head[target]) != 0)))
        first, end = target[starts], target[np.concatenate((starts[1:], [True]))] + 1
        fresh = border[end] < 0
        border[end[fresh]] = level
        low, high = first[fresh], end[fresh]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(border[:n] >= 0)
    return out[:-1]


def repeated_windows(contexts: list[tuple[int, bytes, int, int]], length: int) -> list[np.ndarray]:
    """For each context (anchor hash, bytes, place of the anchor, occurrences) which of its windows repeat.

    Equal windows have their anchor at equal offsets. All windows with offsets of one range share a
    core; parts of contexts with equal anchor, range and core go into the transform, their core as
    one symbol of its own, so that windows become strings of ``RANGE`` symbols. Parts that share
    their core with no other part are left out, equal parts are put in once.
    """
    out = [np.full(len(data) - length + 1, n > 1) for _, data, _, n in contexts]
    units: dict[tuple[int, int, bytes], dict[tuple[bytes, bytes], list[tuple[int, int, int]]]] = {}
    for i, (h, data, p, _) in enumerate(contexts):
        windows = len(data) - length + 1
        for r in range(max(0, p - windows + 1) // RANGE, p // RANGE + 1):
            near, far = r * RANGE, r * RANGE + RANGE - 1  # offsets of the range
            first, last = max(0, p - far), min(windows - 1, p - near)
            core = data[p - near : p - far + length]
            part = data[first : p - near], data[p - far + length : last + length]
            units.setdefault((h, r, core), {}).setdefault(part, []).append((i, first, last))
    pieces, where, cores = [], [], []
    at = number = 0
    for unit in units.values():
        for places in unit.values():
            if len(places) > 1:
                for i, first, last in places:
                    out[i][first : last + 1] = True
        if len(unit) < 2:
            continue
        number += 1
        for (left, right), places in unit.items():
            pieces += [left, b"\0", right, b"\0"]
            cores.append((at + len(left), number))
            where.append((at, places))
            at += len(left) + len(right) + 2
    if not pieces:
        return out
    symbols = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
    spots, numbers = np.array(cores).T
    symbols[spots] = 256 + numbers
    symbols[np.concatenate((np.array([a for a, _ in where[1:]]) - 1, [at - 1])).astype(np.int64)] = 0
    classes = window_classes(symbols, RANGE)
    # only windows that stay inside their part count
    counts = [places[0][2] - places[0][1] + 1 for _, places in where]
    inside = np.repeat([a for a, _ in where], counts) + np.concatenate([np.arange(c) for c in counts])
    repeats = np.bincount(classes[inside], minlength=int(classes.max()) + 1)[classes] > 1
    for (a, places), c in zip(where, counts, strict=True):
        mask = repeats[a : a + c]
        for i, first, last in places:
            out[i][first : last + 1] |= mask
    return out


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _blob(bucket: int, rows: np.ndarray) -> tuple[int, bytes]:
    return bucket, rows.tobytes()


def _key_bytes(rows: np.ndarray) -> list[bytes]:
    packed = np.empty(len(rows), np.dtype([("k1", "<u8"), ("k2", "<u4")]))
    packed["k1"], packed["k2"] = rows["k1"], rows["k2"]
    data = packed.tobytes()
    return [data[a : a + 12] for a in range(0, len(data), 12)]


def _sorted_groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by anchor and context, the number of each row's group of equal contexts, and the groups' occurrences."""
    rows = rows[np.lexsort((rows["c"], rows["h"]))]
    new = np.concatenate(([True], (rows["h"][1:] != rows["h"][:-1]) | (rows["c"][1:] != rows["c"][:-1])))
    group = np.cumsum(new) - 1
    return rows, group, np.bincount(group, rows["n"]).astype(np.int64)


def _gone(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), GONE)
    for name in GONE.names:
        out[name] = rows[name]
    return out


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else in the corpus.

    1. Each text's windows are put into contexts around content-chosen anchors. Equal contexts of a
       task are counted once before the shuffle; contexts are dealt by anchor hash.
    2. A context that occurs again goes as a whole. Where different contexts share an anchor, one of
       each is kept for the next step; all others are unique.
    3. Their bytes are fetched and told apart by :func:`repeated_windows`, on a Burrows-Wheeler
       transform. An anchor of more than ``HOT`` different contexts would be too much for one task:
       the windows of its contexts are hashed and counted with map-side sums instead, to the same end.
    4. Each text's ranges are united and cut out.

    Returns ``id_col``, n_bytes, n_removed, n_spans, spans (array of start and end, bytes) and kept
    (the remaining bytes). Defined cases: null texts are empty; matches never cross texts; texts
    shorter than ``length`` bytes stay whole; repeated rows repeat each other; null ids are fine; an
    empty table gives an empty result; further columns are ignored.
    """
    if length < ANCHOR + RANGE:
        raise ValueError(f"length must be at least {ANCHOR + RANGE}")
    if length - ANCHOR >= 2**16:
        raise ValueError(f"length must be less than {2**16 + ANCHOR}")  # places of anchors have two bytes
    spark = docs.sparkSession
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    buckets = 4 * partitions(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_key", F.substring(F.unhex(F.md5("_text")), 1, 12))

    def deal(rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
        rows, group, times = _sorted_groups(rows)
        again = times[group] > 1
        gone = _gone(rows[again])
        first = np.concatenate(([True], group[1:] != group[:-1]))
        rows = rows[first]
        rows["n"] = np.minimum(times, 2**32 - 1)
        for chosen, number, base in ((rows, rows["h"] % np.uint64(buckets), 0), (gone, gone["k1"] % np.uint64(buckets), buckets)):
            by = np.argsort(number, kind="stable")
            chosen, number = chosen[by], number[by]
            cuts = np.searchsorted(number, np.arange(buckets + 1))
            yield from (_blob(base + b, chosen[cuts[b] : cuts[b + 1]]) for b in np.flatnonzero(np.diff(cuts)).tolist())

    def in_slice(held: list[tuple[bytes, bytes, int, int]]) -> np.ndarray:
        texts_, keys, counts, places = map(list, zip(*held, strict=True))
        return anchored_contexts(texts_, keys, counts, length, ANCHOR, places)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 4_000):
            counts: dict[tuple[bytes, bytes], int] = {}
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(data) >= length:
                    counts[key, data] = counts.get((key, data), 0) + 1
            held, size = [], 0
            contexts = []
            for (key, data), n in counts.items():
                for place, piece in pieces(data, length, SLICE):
                    held.append((piece, key, n, place))
                    size += len(piece)
                    if size > SLICE:  # no more than twice that
                        contexts.append(in_slice(held))
                        held, size = [], 0
            if held:
                contexts.append(in_slice(held))
            if contexts:
                numbers, blobs = zip(*deal(np.concatenate(contexts)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["_bucket", "_rows"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = -1

        def told(rows: np.ndarray, kind: int) -> pa.RecordBatch:
            whole = kind > 0
            empty = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * len(rows), pa.int8()),
                    pa.array(_key_bytes(rows), pa.binary()),
                    pa.array(rows["lo"].astype(np.int64)),
                    pa.array(rows["hi"].astype(np.int64)),
                    *[pa.array(rows[c].astype(np.uint64).view(np.int64)) if whole else empty for c in ("h", "c", "n", "p")],
                ],
                names=["_kind", "_key", "_lo", "_hi", "_h", "_c", "_n", "_p"],
            )

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows, group, times = _sorted_groups(np.frombuffer(b"".join(held), CONTEXT))
            held.clear()
            yield told(rows[(times[group] > 1) & (rows["n"] == 1)], 0)  # those with more went on before
            first = np.concatenate(([True], group[1:] != group[:-1]))
            one = rows[first]
            one["n"] = np.minimum(times, 2**32 - 1)
            anchor = np.cumsum(np.concatenate(([True], one["h"][1:] != one["h"][:-1]))) - 1
            shared = np.bincount(anchor)[anchor]
            yield told(one[(shared > 1) & (shared <= HOT)], 1)
            yield told(one[shared > HOT], 2)

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket >= buckets:
                    yield told(np.frombuffer(data, GONE), 0)
                    continue
                if bucket != now:
                    yield from flush()
                    now = bucket
                held.append(data)
        yield from flush()

    dealt = texts.select("_key", "_text").mapInArrow(find, "_bucket int, _rows binary").repartition(partitions(spark), "_bucket").sortWithinPartitions("_bucket")
    found = materialize(dealt.mapInArrow(meet, "_kind byte, _key binary, _lo long, _hi long, _h long, _c long, _n long, _p long"), "repeats")

    def asks(kind: int) -> DataFrame:
        """Texts whose bytes are asked for: others, and copies in one task, are left out before the shuffle."""
        rows = found.where(f"_kind = {kind}")
        wanted = rows.groupBy("_key").agg(F.collect_list(F.struct("_lo", "_hi", "_h", "_c", "_n", "_p")).alias("_asks"))
        shared, bits = marks(rows.select("_key").distinct(), "_key")

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for batch in batches:
                fresh = hits(shared, batch.column(0))
                for i in np.flatnonzero(fresh).tolist():
                    key = batch.column(1)[i].as_py()
                    fresh[i] = key not in seen
                    seen.add(key)
                yield batch.select([1, 2]).filter(pa.array(fresh))

        return texts.select(mark_cell("_key", bits), "_key", "_text").mapInArrow(once, "_key binary, _text binary").join(wanted, "_key")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = []
            for key, data, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:  # copies of a text come one after another
                    rows += [(a["_h"], a["_c"], a["_n"], a["_p"], key, a["_lo"], data[a["_lo"] : a["_hi"]]) for a in asks]
                last = key
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.binary()], strict=True)],
                names=["_h", "_c", "_n", "_p", "_key", "_lo", "_data"],
            )

    contexts = (
        asks(1)
        .mapInArrow(fetch, "_h long, _c long, _n long, _p long, _key binary, _lo long, _data binary")
        .repartition(partitions(spark), "_h")
        .sortWithinPartitions("_h", "_c")
    )

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            masks = repeated_windows([(h, data, p, n) for h, _, n, p, _, _, data in held], length)
            rows = [(key, lo + a, lo + b - 1 + length) for (_, _, n, _, key, lo, _), mask in zip(held, masks, strict=True) if n == 1 for a, b in _runs(mask)]
            held, size = [], 0
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["_key", "_lo", "_hi"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:2] == row[:2]:
                    continue  # the same context, from a copy of its text
                if size > TEXT and held[-1][0] != row[0]:
                    yield flush()
                held.append(row)
                size += len(row[-1])
        if held:
            yield flush()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(xxhash.xxh3_128_digest(data[i : i + length]), key, i, min(a["_n"], 2)) for a in wanted for i in range(a["_lo"], a["_hi"] - length + 1)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["_w", "_key", "_lo", "_n"]
                )

    ranges = found.where("_kind = 0").select("_key", "_lo", "_hi").unionAll(contexts.mapInArrow(expand, "_key binary, _lo long, _hi long"))
    if not found.where("_kind = 2").isEmpty():
        # copies of a text would count its windows again: one row per text and place
        hashed = asks(2).mapInArrow(windows, "_w binary, _key binary, _lo long, _n long").groupBy("_w", "_key", "_lo").agg(F.max("_n").alias("_n"))
        hashed = materialize(hashed, "hot-windows")
        again = hashed.groupBy("_w").agg(F.sum("_n").alias("_times")).where("_times > 1").select("_w")
        ranges = ranges.unionAll(hashed.where("_n = 1").join(again, "_w").select("_key", "_lo", (F.col("_lo") + length).alias("_hi")))
    by_text = materialize(ranges.groupBy("_key").agg(F.collect_set(F.struct("_lo", "_hi")).alias("_ranges")), "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows = []
            for data, ranges_ in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                spans: list[list[int]] = []
                for a, b in sorted((r["_lo"], r["_hi"]) for r in ranges_ or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(data), len(data) - len(kept), len(spans), [{"start": a, "end": b} for a, b in spans], kept))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [span, pa.binary()], strict=True)]],
                names=["_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    schema = f"_id {id_type}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
    # texts that lose nothing stay where they are; the copies of a text that does meet its ranges in several places
    shared, bits = marks(by_text, "_key")

    def losing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([1, 2, 3, 4]).filter(pa.array(hits(shared, batch.column(0))))

    def keeping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rest = batch.filter(pa.array(~hits(shared, batch.column(0))))
            rest = pa.RecordBatch.from_arrays([rest.column(1), rest.column(3), pa.nulls(rest.num_rows)], names=["_id", "_text", "_ranges"])
            yield from cut(iter([rest]))

    dealt = texts.select(mark_cell("_key", bits).alias("_cell"), "_id", "_key", "_text", F.pmod(F.spark_partition_id(), F.lit(PLACES)).alias("_place"))
    places = by_text.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
    lost = dealt.mapInArrow(losing, f"_id {id_type}, _key binary, _text binary, _place int").join(places, ["_key", "_place"], "left").select("_id", "_text", "_ranges")
    return lost.mapInArrow(cut, schema).unionByName(dealt.mapInArrow(keeping, schema)).withColumnRenamed("_id", id_col)
