import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from chronofold.llm import bpe, queries

MODEL = bpe.BpeModel()
LIBRARY = Tokenizer.from_file(bpe.default_path())


def by_library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def own(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(MODEL).encode(texts)]


def test_query_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op11_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = by_library(d["text"])
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False))]
        assert [got[d["doc_id"]][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")] == [len(ids), *digest]


@pytest.mark.parametrize("letters", ["ab", "aAb", "aeinrst", "étßñü", "the ing's", "ΣİǅKſ", "1２½ab", "<|>startofxend", "aA\n\t\x85 \xa0　\x1c x", "日本語かな가각", "áë가"])
def test_random_texts_against_the_library(letters):
    rng = random.Random(letters)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    assert own(texts) == [by_library(t) for t in texts]


def test_odd_texts_against_the_library():
    texts = ["", " \n\t ", "a<|endoftext|>b<|startoftext|><|endoftext|> <|endof", "<|ENDOFTEXT|>", "a" * 5000, "ab" * 3000, "é" * 999, "thing" * 400, "x" * 255, "x" * 256, "x" * 257, "!" * 700, "\U0001f600" * 300]
    texts += ["a՘b", "Ᲊx", "Ꟛ" * 3, "x\U00010940y"]  # letters that this Python doesn't know
    assert own(texts) == [by_library(t) for t in texts]
    assert own([None, *texts])[0] == []


def test_every_pair_of_tokens_is_judged_as_merging_does():
    rng = np.random.default_rng(0)
    usable = np.flatnonzero(MODEL.merges.reachable())
    inner = np.array([i for i in usable if MODEL.merges.raw[i][-1] != bpe.END])
    a, b = rng.choice(inner, 4000), rng.choice(usable, 4000)
    b[:2000] = rng.permutation(a)[:2000]  # likely to merge
    b = np.where(np.isin(b, inner) & (rng.random(4000) < 0.1), a, b)
    fits = MODEL.merges.compatible(a, b)
    for x, y, fit in zip(a.tolist(), b.tolist(), fits.tolist(), strict=True):
        word = MODEL.merges.raw[x] + MODEL.merges.raw[y]
        if word[-1] != bpe.END:  # inside a word: with an end that can't merge with what stands before
            continue
        assert fit == (np.frombuffer(MODEL.merge(word[:-1]), "<u4").tolist() == [x, y])
    assert 0 < fits.sum() < len(fits)


def test_both_ways_of_merging_agree_and_some_proposals_hold():
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)]
    model = bpe.BpeModel()
    assert model.merge_together(words) == [model.merge(w) for w in words] == model.solve(words)
    assert 0 < model.failed < model.solved == 3000


def test_odd_rows(spark):
    rows = [(1, "Ein Wort", "x", 1), (None, "one", None, 2), (2, None, "x", 3), (3, "", "x", 4), (1, "Ein Wort", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, token int")
    coded = bpe.encode_documents(docs, MODEL)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in coded.collect()) == sorted((str(i), by_library(t)) for i, t, *_ in rows)
    back = {str(r["doc_id"]): r["text"] for r in bpe.decode_documents(coded, MODEL).collect()}
    assert back == {str(i): LIBRARY.decode(by_library(t), skip_special_tokens=False) for i, t, *_ in rows}
    assert bpe.round_trip(docs.limit(0), MODEL).count() == 0
    assert bpe.decode_documents(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).first()["text"] == ""


def test_unknown_ids_raise():
    for bad in (len(MODEL.merges.names), -1):
        with pytest.raises((ValueError, pa.ArrowIndexError)):
            bpe.decoded(pa.array([[1, bad]], pa.list_(pa.int32())), pa.array(MODEL.merges.names))


def test_few_words_are_remembered(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    encoder = bpe.Encoder(MODEL)
    texts = ["some words here", "and other ones there", "some words again", "x" * 60]
    assert [np.frombuffer(encoder.encode([t])[0], "<u4").tolist() for t in texts] == [by_library(t) for t in texts]
