import random

import numpy as np
import public_tokenizers
import pytest

from lectern.llm import sentencepiece as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(5)
    fixed = ["", None, " lead", "trail ", "two  blanks", "\n\nx\n", "日本語 текст é", "x" * 300, "\t tab", "😀 emoji", "a\x00b"]
    return fixed + ["".join(rng.choice("abcdeftnirsou  .,\nABé1") for _ in range(rng.randint(1, 90))) for _ in range(300)]


def test_ids_equal_the_library(library):
    model = S.Model(PATH)
    for text, ids in zip(texts(), model.encode(texts())):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "")
        assert model.decode(np.frombuffer(ids, "<u4")) == (text or "")


@pytest.mark.parametrize("alphabet", ["thingraeos", "abetnirs éx日", "aaab "])
def test_scan_equals_one_walk(library, alphabet):
    model, rng = S.Model(PATH), random.Random(3)
    for chunk in (1, 7, 20, 64):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(100, 300)))
        s, near = S.normal(text), model.longest
        parts = []
        for a in range(0, len(s), chunk):
            b, low = min(len(s), a + chunk), max(0, a - near)
            parts.append((s[low : b + near], a - low, b - low))
        path = S.scan([model.matrix(t, a, b, i == 0) for i, (t, a, b) in enumerate(parts)])
        ids = [x for (t, a, b), (entry, to) in zip(parts, path) for x in model.part(t, a, b, entry, to)]
        assert ids == library.encode(text)


def test_products_in_any_grouping_give_the_same_path():
    model, rng = S.Model(PATH), random.Random(9)
    text = S.normal("".join(rng.choice("abetnirs éx日") for _ in range(400)))
    near, chunk = model.longest, 13
    matrices = []
    for a in range(0, len(text), chunk):
        b, low = min(len(text), a + chunk), max(0, a - near)
        matrices.append(model.matrix(text[low : b + near], a - low, b - low, a == 0))
    whole = S.scan(matrices)
    for _ in range(20):
        cuts = sorted({0, len(matrices), *rng.sample(range(len(matrices)), 6)})
        runs = [matrices[a:b] for a, b in zip(cuts, cuts[1:])]
        ends = S.scan([S.tree(r)[-1][0] for r in runs])
        assert [x for r, (entry, to) in zip(runs, ends) for x in S.scan(r, entry, to)] == whole
    assert S._unpack(S._pack(matrices[3])) == matrices[3]


def test_products_are_max_plus():
    a = {(0, 1): {(0, 2): 1.0, (0, 3): 5.0}}
    b = {(0, 2): {(0, 4): 7.0}, (0, 3): {(0, 4): 2.0, (0, 5): -1.0}}
    assert S.times(a, b) == {(0, 1): {(0, 4): 8.0, (0, 5): 4.0}} and S.times(b, a) == {}
    assert S.scan([a, b], (0, 1), (0, 4)) == [((0, 1), (0, 2)), ((0, 2), (0, 4))]


def test_documents(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts()[:40])] + [(900, "giant words of text\n" * 60, "x"), (900, "giant words of text\n" * 60, "x"), (None, "b" * 700, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = S.encode(docs, S.Pieces(path=PATH, giant=400, chunk=90, run=3))
    got = S.decode(encoded, PATH).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in got) == sorted((str(i), t or "") for i, t, _ in rows)
    for r in encoded.collect():
        text = dict((i, t) for i, t, _ in rows)[r["doc_id"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(text or "")
        assert (r["n_chunks"] > 1) == (len(text or "") > 400)
    assert S.encode(docs.limit(0), S.Pieces(path=PATH)).count() == 0
