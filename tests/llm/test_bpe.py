"""BPE against the tokenizers library and against naive merging."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crawlkit.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
MODEL = bpe.Bpe(PATH)
CASES = [
    "Hello  wORLD's <|endoftext|> fooé İ 123 don't ǅ ß \x00 á", "", "   ",
    "ΑΣ ΣΑΣ. Σ", "a b　c​d\x85e\x1cf", "!!! ... 's'S I'LL x'd",
    "日本語 テスト ½ ²", "\U0001f600\U0001f600 \U0001f468‍\U0001f469",
    "<|startoftext|><|endoftext|>abc<|endof", "a" * 3000, "ab" * 700 + " " + "!" * 500,
]


def expect(text):
    found = LIBRARY.encode(text, add_special_tokens=False)
    return found.ids, LIBRARY.decode(found.ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    ids = MODEL.encode(text)
    assert (ids.tolist(), MODEL.decode(ids)) == expect(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("aeinrst'<|>\n ́Σ"))))
def test_any_text(text):
    assert MODEL.encode(text).tolist() == expect(text)[0]


def naive(piece):
    ids = [MODEL.inner[b] for b in piece.encode()]
    ids[-1] = MODEL.last[piece.encode()[-1]]
    while True:
        ranks = [(MODEL.pairs[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in MODEL.pairs]
        if not ranks:
            return tuple(ids)
        i = min(ranks)[1]
        ids[i : i + 2] = [MODEL.pairs[ids[i], ids[i + 1]][1]]


@settings(max_examples=300, deadline=None)
@given(st.text("abeinorst", min_size=1, max_size=40))
def test_tree_equals_naive_merging(piece):
    assert MODEL.merge(piece) == naive(piece)


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op8_bpe(spark, sf).collect()}
    import hashlib

    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, decoded = expect(row["text"] or "")
        r = got[row["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "The end", 3), (1, "The end", 3)], "doc_id long, text string, t int")
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted((r["t"], r["ids"], r["decoded"]) for r in out.collect()) == [
        (1, [], ""), (2, [], ""), (3, [518, 806], "the</w> end</w>"), (3, [518, 806], "the</w> end</w>")]
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_generations_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "GENERATION", 10)
    model = bpe.Bpe(PATH)
    text = " ".join(f"w{i}x" for i in range(200))
    assert model.encode(text + " " + text).tolist() == expect(text + " " + text)[0]
    assert len(model.remembered) <= 10 and len(model.remembered.older) <= 10


def test_known_words_are_not_cut_again(monkeypatch):
    model = bpe.Bpe(PATH)
    text = "It's (the) don't x\x1cy naïve-Word 12, it's"
    ids = model.encode(text.replace("\x1c", "")).tolist()
    assert model.encode(text).tolist() == expect(text)[0]

    def cut(word):
        raise AssertionError(word)

    monkeypatch.setattr(bpe, "split", cut)
    assert model.encode(text.replace("\x1c", "")).tolist() == ids == expect(text.replace("\x1c", ""))[0]


def test_two_generations_are_remembered_at_most(monkeypatch):
    monkeypatch.setattr(bpe, "GENERATION", 4)
    remembered = bpe._Remembered(lambda word: (len(word),))
    older = remembered.older
    for n in [*range(1, 12), 3, 11]:
        assert remembered["a" * n] == np.int32(n).tobytes()
        assert len(remembered) <= 4 and len(older) <= 4 and remembered.older is older
