import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import packing, rans
from lectern.llm.tokens import LONGEST_UNIT, Encoder, Units

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", "plain words, and Words.", "  two  spaces ", "\n\nx\n", "日本語 текст É é. ÉÉ,", "x" * 300, "\ttab nb", "😀 it's We're,. a.b,c.",
    "<|endoftext|> <|startoftext|>", "a<|endoftext|>. <|ENDOFTEXT|>b\n<|startoftext|>c, <|endoftext|>", "\u0130\u0e49 \u0130\u0345x", "ΑΣ. İstanbul ſ", "end.\nStart 12 3,4", "é é.", "a\x1cb c\x85d",
]


@lru_cache
def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path, cut", [(WORDS, "words"), (BYTES, "bytes")])
def test_ids_equal_the_library(path, cut):
    expected, encoder = library(path), Encoder(path, cut)
    for text, ids in zip(TEXTS, encoder.encode(TEXTS)):
        assert np.frombuffer(ids, "<u2").tolist() == expected(text), text


@lru_cache
def known(path, cut):
    return Encoder(path, cut)


PARTS = st.sampled_from([*"ab 'sR.,\n\tÉé1İΣ\u0301\u0e49!", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "don't", "日本", " the "])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.lists(PARTS, max_size=20).map("".join), st.text(max_size=20)), max_size=6))
def test_ids_of_odd_texts(texts):
    for path, cut in ((WORDS, "words"), (BYTES, "bytes")):
        expected = library(path)
        for text, ids in zip(texts, known(path, cut).encode(texts)):
            assert np.frombuffer(ids, "<u2").tolist() == expected(text)


def test_special_strings_as_ordinary_text():
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    text = "a <|endoftext|> b"
    ids = Encoder(BYTES, "bytes", plain_specials=True).encode([text])[0]
    assert np.frombuffer(ids, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_units_are_bounded():
    units = Units(lambda u: u.encode(), 10)
    assert units["x" * (LONGEST_UNIT + 1)] and not units
    for i in range(1000):
        assert units[str(i)] == str(i).encode()
        units.age()
        assert len(units) <= 20 and len(units.old) <= 20


@pytest.mark.parametrize("n, kinds", [(1, 1), (5, 3), (1000, 1), (40_000, 49_000), (70_000, 7)])
def test_block_round_trip_and_checkpoints(n, kinds):
    ids = (np.random.default_rng(n).zipf(1.3, n) % kinds).astype(np.uint16)
    table, dense = rans.Table.of(ids)
    data = memoryview(rans.encode_block(dense, table, 16))
    back, size = rans.decode_block(data, table, table.slots())
    assert (back == ids).all() and size == len(data)
    lanes, marks = rans.BLOCK.unpack_from(data)[1], rans.BLOCK.unpack_from(data)[3]
    for k in range(1, marks + 1):
        part, _ = rans.decode_block(data, table, table.slots(), k)
        assert (part == ids[16 * k * lanes :]).all()


def test_damage_is_found():
    ids = np.arange(2000, dtype=np.uint16) % 50
    record = bytearray(rans.encode_record([1, None], [500, 1500], ids, rans.TokenFiles()))
    keys, sizes, back = rans.decode_record(bytes(record))
    assert keys == [1, None] and sizes.tolist() == [500, 1500] and (back == ids).all()
    record[-9] ^= 1
    with pytest.raises(ValueError):
        rans.decode_record(bytes(record))


def corpus(spark):
    rows = [(7, "b words", 1), (3, None, 1), (5, "Some more text. " * 500, 1), (9, "", 1), (3, "again", 1), (None, "null key", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int")


def test_files(spark, tmp_path):
    path = str(tmp_path / "ids")
    rans.write(corpus(spark), path, rans.TokenFiles(path=WORDS, record_tokens=1000))
    got = rans.digests(spark, path).orderBy("start").collect()
    expected, at = library(WORDS), 0
    order = [(None, "null key"), (3, None), (3, "again"), (5, "Some more text. " * 500), (7, "b words"), (9, "")]
    for r, (key, text) in zip(got, order, strict=True):
        ids = [*expected(text or ""), 1]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (key, at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert rans.read(spark, path).count() == 6
    rans.write(corpus(spark).limit(0), path + "0", rans.TokenFiles(path=WORDS))
    assert rans.digests(spark, path + "0").count() == 0


def test_packing(spark):
    expected = library(BYTES)
    config = packing.Packing(path=BYTES, length=64, group_pieces=3, with_ids=True)
    rows = packing.pack(corpus(spark), config).toPandas()
    assert len(rows[rows.doc_id == 3]) == 2
    whole = rows[rows.doc_id == 5].sort_values("piece")
    ids = np.concatenate([np.frombuffer(x, "<u4") for x in whole.ids])
    assert ids.tolist() == [*expected("Some more text. " * 500), 2]
    assert whole.piece.tolist() == list(range(len(whole))) and (whole.length.iloc[1:] == 64).all()
    for _, sequence in rows.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *np.cumsum(sequence.length)[:-1]] and sequence.length.sum() <= 64
    assert packing.pack(corpus(spark).limit(0), config).count() == 0


def brute_squares(lengths, capacity):
    gaps, placed = [], []
    for size in lengths:
        best = None
        for at in sorted(range(len(gaps)), key=lambda i: gaps[i]):
            if gaps[at] >= size and gaps[at] > 0:
                new = [g - size * (i == at) for i, g in enumerate(gaps)]
                cost = sum(new.count(g) ** 2 for g in set(new) if g)
                best = min(best or (cost, at), (cost, at), key=lambda x: x[0])
        fresh = [*gaps, capacity - size]
        cost = sum(fresh.count(g) ** 2 for g in set(fresh) if g)
        if best is None or cost < best[0]:
            gaps = fresh
        else:
            gaps[best[1]] -= size
        placed.append(sorted(gaps))
    return placed[-1]


def test_sum_of_squares_rule():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = np.sort(rng.integers(1, 17, 30))[::-1]
        sequence, offset = packing.sum_of_squares(lengths, 16)
        fill = np.bincount(sequence, weights=lengths)
        assert fill.max() <= 16 and sorted(16 - fill) == brute_squares(lengths.tolist(), 16)
        again, _ = packing.pack_lengths(lengths, 16)
        assert again.max() <= sequence.max() and np.bincount(again, weights=lengths).max() <= 16


def test_documents_from_checkpoints():
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 3000, 40).tolist()
    ids = (rng.zipf(1.2, sum(sizes)) % 900).astype(np.uint16)
    record = rans.encode_record([*range(39), None], sizes, ids, rans.TokenFiles(block_tokens=7000, checkpoint=4))
    starts = np.cumsum([0, *sizes])
    for wanted in ({0}, {5, 17, 38}, set(range(39)), {99}):
        got = rans.decode_documents(record, frozenset(wanted))
        assert [k for k, _ in got] == sorted(wanted - {99})
        for k, x in got:
            assert (x == ids[starts[k] : starts[k + 1]]).all() and len(x) == sizes[k]


def test_lookup_in_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i + 1)) for i in range(60)], "doc_id long, text string")
    config = rans.TokenFiles(path=WORDS, record_tokens=400, block_tokens=128, checkpoint=8)
    rans.write(docs, str(tmp_path / "f"), config)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rans.lookup(spark, str(tmp_path / "f"), [3, 41, 777]).collect()}
    assert got == {i: [*library(WORDS)(f"text number {i} " * (i + 1)), 1] for i in (3, 41)}
