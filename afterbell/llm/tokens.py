"""Operator 8: token ids in fixed-width packed files with random access."""

from __future__ import annotations

import gc
import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afterbell.llm.common import partitions, scratch_path

MAGIC = b"ABTK0001"
#: The end of a file: bits of an id, ids in a block, ids, documents, place of the index, magic.
TRAILER = struct.Struct("<IIQQQ8s")
BLOCK_IDS = 4096
#: Most words whose ids a worker keeps.
CACHE_WORDS = 1_200_000
#: The one letter outside ASCII that lower-cases into it.
KELVIN = "\u212a".encode()


def _plain(word: bytes) -> bool:
    """Whether a lower-cased word is only letters that normalisation and lower-casing leave as they are."""
    if word.isascii():
        return word.isalpha()
    text = word.decode()
    return text.isalpha() and text.lower() == text and unicodedata.is_normalized("NFC", text)


def bits_for(vocabulary: int) -> int:
    """Least bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, most significant bit first, ``bits`` each; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :].ravel()).tobytes()


def unpack(data: bytes, bits: int, count: int, skip: int = 0) -> np.ndarray:
    """``count`` ids after ``skip`` ids of packed ``data``."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count, skip * bits // 8).astype(np.uint32)
    first, last = skip * bits // 8, -(-(skip + count) * bits // 8)
    flat = np.unpackbits(np.frombuffer(data, np.uint8, last - first, first))[skip * bits - first * 8 :][: count * bits]
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = flat.reshape(count, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def words_are_independent(spec: dict) -> bool:
    """Whether a tokenizer treats the parts between white space one by one, so that their ids can be kept and joined.

    So it is when its first splitter keeps matches only of a pattern that matches no white space.
    """
    first = spec.get("pre_tokenizer") or {}
    first = first.get("pretokenizers", [first])[0]
    pattern = (first.get("pattern") or {}).get("Regex", " ")
    plain = pattern.replace("[^\\s", "[^")
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and "\\s" not in plain and " " not in plain


class Encoder:
    """Ids of texts, with the ids of frequent words kept."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        self.by_word = words_are_independent(parsed)
        self.special = [t["content"].lower().encode() for t in parsed.get("added_tokens", [])]
        self.known: dict[bytes, bytes] = {}
        # with a suffix that marks a word's last piece, many plain words can be told apart in one text
        suffix = parsed["model"].get("end_of_word_suffix")
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)] if suffix and self.by_word else []
        self.last_piece = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.last_piece[ends] = True
        self.any_last = bool(ends)

    def _plain_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of lower-case letters only, each of which ends with exactly one last piece."""
        out: list[bytes] = []
        for a in range(0, len(words), 20_000):
            some = words[a : a + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.last_piece[ids]) + 1) * 4).tolist()
            if len(ends) != len(some):  # a letter that this tokenizer takes apart
                out += self._ids([w.decode() for w in some])
                continue
            flat = ids.tobytes()
            out += [flat[x:y] for x, y in zip([0, *ends], ends, strict=False)]
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(lists), "<u4").tobytes()
        ends = list(accumulate(4 * len(ids) for ids in lists))
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, words: set[bytes]) -> None:
        known = self.known
        stems = {w: w[:-1] for w in words if w.endswith((b",", b".")) and w[-2:-1].isalpha()}
        new = {stems.get(w, w) for w in words} - known.keys() | ({b",", b"."} - known.keys())
        plain = [w for w in new if w.isalpha() or (not w.isascii() and _plain(w))] if self.any_last else []
        known.update(zip(plain, self._plain_ids(plain), strict=True))
        other = list(new.difference(plain))
        known.update(zip(other, self._ids([w.decode() for w in other]), strict=True))
        for w, stem in stems.items():
            known[w] = known[stem] + known[w[-1:]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each UTF-8 text."""
        collects = gc.isenabled()
        gc.disable()  # millions of words, no cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self._ids([t.decode() for t in texts])
        # the tokenizer looks for special tokens before it lower-cases, so a text that holds one in any case is encoded whole
        lower = [t.lower() for t in texts]
        odd = [KELVIN in t or any(s in t for s in self.special) for t in lower]
        split = [[] if o else t.split() for t, o in zip(lower, odd, strict=True)]
        words = set().union(*split)
        if len(self.known) > CACHE_WORDS:  # words of this batch stay, most frequent words are among them
            self.known = {w: self.known[w] for w in words & self.known.keys()}
        self._learn(words - self.known.keys())
        get = self.known.__getitem__
        return [self._ids([t.decode()])[0] if o else b"".join(map(get, s)) for t, s, o in zip(texts, split, odd, strict=True)]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """The worker process' encoder: tasks that follow one another share its words."""
    key = zlib.crc32(spec.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


class TokenFile:
    """Random access to one packed file."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        end = self.file.read_at(TRAILER.size, self.file.size() - TRAILER.size)
        self.bits, self.block, self.n_ids, self.n_docs, index, magic = TRAILER.unpack(end)
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        n_blocks = -(-self.n_ids // self.block)
        data = np.frombuffer(self.file.read_at((2 * self.n_docs + 1 + n_blocks + 1) * 8 + self.n_docs, index), np.uint8)
        words = data[: (2 * self.n_docs + 1 + n_blocks + 1) * 8].view("<i8")
        self.doc_ids, self.starts, self.offsets = np.split(words, [self.n_docs, 2 * self.n_docs + 1])
        self.has_id = data[len(words) * 8 :].astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at the places start to stop, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        return unpack(data, self.bits, stop - start, start - first * self.block)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _write_file(uri: str, bits: int, documents: Iterator[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Write documents (id, little-endian 32-bit ids) under a temporary name, then rename; returns documents and ids."""
    system, path = pafs.FileSystem.from_uri(uri)
    doc_ids, lengths, held, n_ids, held_ids, place = [], [], [], 0, 0, 0
    offsets = [place]

    with system.open_output_stream(path + ".part") as out:

        def flush(all_of_it: bool) -> None:
            nonlocal held, held_ids, place
            ids = np.frombuffer(b"".join(held), "<u4")
            full = len(ids) if all_of_it else len(ids) // BLOCK_IDS * BLOCK_IDS
            for a in range(0, full, BLOCK_IDS):
                data = pack(ids[a : min(full, a + BLOCK_IDS)], bits)
                out.write(data)
                place += len(data)
                offsets.append(place)
            held, held_ids = [ids[full:].tobytes()], len(ids) - full

        for doc_id, ids in documents:
            doc_ids.append(doc_id)
            lengths.append(len(ids) // 4)
            held.append(ids)
            held_ids += len(ids) // 4
            n_ids += len(ids) // 4
            if held_ids > 256 * BLOCK_IDS:
                flush(False)
        flush(True)
        out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
        out.write(np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype("<i8").tobytes())
        out.write(np.array(offsets, "<i8").tobytes())
        out.write(np.array([d is not None for d in doc_ids], np.uint8).tobytes())
        out.write(TRAILER.pack(bits, BLOCK_IDS, n_ids, len(doc_ids), place, MAGIC))
    system.move(path + ".part", path)
    return len(doc_ids), n_ids


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Tokenize whole texts and write packed files in ascending id order under ``folder`` (a URI all executors share).

    Rows are ranged and sorted by id; each task streams its range into one file, written under a
    temporary name with the attempt's own number and renamed, so repeated attempts do no harm.
    Returns the manifest, one entry per file in id order: uri, docs, ids, start (ids before it).

    Defined cases: a null or empty text has the end id only; null ids come first; rows of one id are
    ordered by the hash of their text, null texts first, and may be spread over files; an empty table
    writes no files; further columns are ignored.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())
    vocabulary = max(Encoder(spec.value).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    bits, end = bits_for(vocabulary), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(spec.value), TaskContext.get().partitionId()

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
                a = 0
                while a < len(ids):
                    b, size = a, 0
                    while b < len(ids) and (b == a or size + len(texts[b] or b"") < 4_000_000):
                        size += len(texts[b] or b"")
                        b += 1
                    for doc_id, tokens in zip(ids[a:b], encoder.encode([t or b"" for t in texts[a:b]]), strict=True):
                        yield doc_id, tokens + end
                    a = b

        first = next(rows := documents(), None)
        if first is None:
            return
        uri = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex[:8]}.bin"

        def all_rows() -> Iterator[tuple[int | None, bytes]]:
            yield first
            yield from rows

        n_docs, n_ids = _write_file(uri, bits, all_rows())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([n_docs]), pa.array([n_ids])], names=["part", "uri", "docs", "ids"])

    # the folder is made by Spark's file system, so that every executor finds it
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    order = [F.col("_id").asc_nulls_first(), F.col("_tie").asc_nulls_first()]
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.when(text.isNotNull(), F.xxhash64(text)).alias("_tie"))
    ranged = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("_id", "_text")
    manifest, start = [], 0
    for row in sorted(ranged.mapInArrow(run, "part int, uri string, docs long, ids long").collect()):  # one small row per file
        manifest.append({"uri": row.uri, "docs": row.docs, "ids": row.ids, "start": start})
        start += row.ids
    return manifest


def read_tokens(spark, manifest: list[dict], id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start (ids before it in the whole), n_tokens, ids_crc32 of its little-endian 32-bit ids."""
    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                file = TokenFile(entry["uri"])
                a = 0
                while a < file.n_docs:  # a few blocks at a time
                    b = max(a + 1, int(np.searchsorted(file.starts, file.starts[a] + 1_000_000, "right")) - 1)
                    begin = int(file.starts[a])
                    ids = file.ids(begin, int(file.starts[b])).astype("<u4")
                    cuts = file.starts[a : b + 1] - begin
                    crcs = [zlib.crc32(ids[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file.doc_ids[a:b], pa.int64(), mask=~file.has_id[a:b]),
                            pa.array(file.starts[a:b] + entry["start"]),
                            pa.array(np.diff(file.starts[a : b + 1])),
                            pa.array(crcs, pa.int64()),
                        ],
                        names=[id_col, "start", "n_tokens", "ids_crc32"],
                    )
                    a = b

    rows = [(i, m["uri"], m["start"]) for i, m in enumerate(manifest)]
    return spark.createDataFrame(rows, "part int, uri string, start long").repartition(len(rows), "part").mapInArrow(run, schema)


def tokens_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as packed files in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    return read_tokens(spark, write_tokens(docs, folder, tokenizer_path, end_id, id_col, text_col), id_col)
