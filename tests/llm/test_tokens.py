import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from afterbell.llm.tokens import Encoder, TokenFile, bits_for, pack, read_tokens, tokens_round_trip, unpack, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "",
    " ",
    "Hello, World. It's THE end... don't ,. x,. y.,",
    "ÀÉ é ́x a b c ẞ İ ǅ",
    "<|endoftext|> and <|STARTOFTEXT|> x<|startoftext|>y",
    "a <|ENDOFTEXT|> b",
    "a <|EndOfText|>, <|STARTOFTEXT|>b <|startof text|>",
    "\u212aelvin \u212a. <|ENDOFTEXT|",
    "tab\tline\nfeed\x0b\x0c\r end 123 4.5 ½ ٣",
    "日本語 テキスト 🎉🎉 a🎉b",
    "x" * 5000,
    "word, " * 3000,
]


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 20, 32])
def test_pack_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003, dtype=np.uint64).astype(np.uint32)
    data = pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8)
    for skip, count in ((0, 1003), (0, 0), (17, 400), (1002, 1)):
        assert (unpack(data, bits, count, skip) == ids[skip : skip + count]).all()


def test_bits():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_words_one_by_one_give_the_ids_of_whole_texts():
    encoder, whole = Encoder(open(PATH).read()), Tokenizer.from_file(PATH)
    assert encoder.by_word
    r = random.Random(2)
    alphabet = [*"abcXYZ.,;'-!19éßñ \n\t", "<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|", "|>", "\u212a"]
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(400)]
    texts += ["".join(r.choice(alphabet[:19]) for _ in range(r.randint(0, 200))) for _ in range(400)]
    for text, got in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_take_whole_texts():
    assert not Encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read()).by_word


def test_files_read_back(spark):
    whole = Tokenizer.from_file(PATH)
    rows = [(i * 3 % 101, t) for i, t in enumerate(ODD * 3)] + [(500, None), (None, "no id"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tokens_round_trip(df, PATH).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    at = 0
    want = {}
    for d, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    last = -1
    for r in got:
        assert r.start == at
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
        assert (r.doc_id if r.doc_id is not None else -1) >= last
        last = r.doc_id if r.doc_id is not None else -1


def test_random_access_to_a_file(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words " * (i * 37 % 900)) for i in range(40)], "doc_id long, text string").coalesce(1)
    manifest = write_tokens(df, f"file://{tmp_path}/out", PATH)
    whole = Tokenizer.from_file(PATH)
    seen = 0
    for m in manifest:
        f = TokenFile(m["uri"])
        for i in reversed(range(f.n_docs)):
            want = whole.encode("some words " * (int(f.doc_ids[i]) * 37 % 900), add_special_tokens=False).ids + [1]
            assert f.document(i).tolist() == want
            seen += 1
    assert seen == 40


def test_empty_table(spark):
    assert tokens_round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_rows_of_one_id_have_one_order(spark):
    rows = [(7, f"text {i}") for i in range(300)] + [(7, None), (None, "x"), (None, "y"), (9, "z")]
    one, other = (
        sorted((r.start, r.doc_id, r.ids_crc32) for r in tokens_round_trip(spark.createDataFrame(x, "doc_id long, text string").repartition(k), PATH).collect())
        for x, k in ((rows, 2), (rows[::-1], 5))
    )
    assert one == other and len(one) == len(rows)


def test_no_manifest(spark):
    assert read_tokens(spark, []).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
