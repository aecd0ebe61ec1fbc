import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold.llm import packing, shards, tokens

TEXTS = [None, "", " ", "a", "  two  spaces ", "line\nbreaks\n\n and\ttabs ", "don't we'll", "日本語 テキスト 🙂", "x" * 5000, "word " * 3000, "<|endoftext|> as text", "\u00a0nbsp \u2003wide", "1234 5678,9"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_paths()[0])
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@given(st.one_of(st.text(), st.lists(st.sampled_from(["a", "de", " ", "  ", "<|endoftext|>", "\n", "\t", "\x1c", "\u00a0", "'s", "9", "!", "é"]), max_size=20).map("".join)))
@settings(max_examples=200, deadline=None)
def test_segments_give_the_tokenizers_ids(text):
    from tokenizers import Tokenizer

    whole = _tokenizer(Tokenizer).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encoder(tokens.default_paths()).encode(text), "<u4").tolist() == whole


_KEPT = []


def _tokenizer(cls):
    if not _KEPT:
        _KEPT.append(cls.from_file(tokens.default_paths()[0]))
    return _KEPT[0]


def test_added_tokens_have_their_own_ids():
    ids = np.frombuffer(tokens.encoder(tokens.default_paths()).encode("x <|endoftext|> as text"), "<u4").tolist()
    assert ids == [87, 220, 50256, 355, 2420]


def docs(spark, texts=None, parts=2):
    texts = TEXTS if texts is None else texts
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, ids string").repartition(parts)


def test_pieces_cover_every_document_once(spark, plain):
    rows = packing.pack_documents(docs(spark, TEXTS * 40)).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    assert set(by_doc) == set(range(len(TEXTS) * 40))
    want = {t: [*plain(t), packing.END_OF_DOCUMENT] for t in TEXTS}
    for i, pieces in by_doc.items():
        ids, at = [], 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want[TEXTS[i % len(TEXTS)]])
            at += p["length"]
            ids += np.frombuffer(p["ids"], "<u4").tolist()
        assert ids == want[TEXTS[i % len(TEXTS)]]


def test_sequences_are_gapless_and_nearly_all_full(spark):
    rows = packing.pack_documents(docs(spark, TEXTS * 60, 3)).collect()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    short, groups = 0, {}
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        tier, = {p["tier"] for p in pieces}
        group, = {p["step_group"] for p in pieces}
        assert at <= tier and tier in packing.TIERS
        short += at < tier
        groups.setdefault(group, []).append(tier)
    assert short <= 3
    assert all(len(set(g)) == 1 and sum(g) <= packing.STEP_TOKENS for g in groups.values())
    assert {r["tier"] for r in rows} > {2048}


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (5, None), (5, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["length"]) for r in packing.pack_documents(df).collect())
    assert got == [(False, 1), (False, 1), (True, 3)]
    assert packing.pack_documents(df.limit(0)).count() == 0
    assert shards.write_shards(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = shards.feistel_slots(np.arange(n), n, key=5)
    assert sorted(slots.tolist()) == list(range(n))
    if n >= 64:
        assert slots.tolist() != list(range(n)) and slots.tolist() != shards.feistel_slots(np.arange(n), n, key=6).tolist()


def test_shards_hold_every_sequence_in_slot_order(spark, tmp_path, plain):
    out = str(tmp_path / "shards")
    rows = shards.write_shards(docs(spark, TEXTS * 30), out, key=3, length=128, records=100).orderBy("slot").collect()
    n = len(rows)
    assert [r["slot"] for r in rows] == list(range(n)) and sorted(r["sequence_id"] for r in rows) == list(range(n))
    assert [r["slot"] for r in sorted(rows, key=lambda r: r["sequence_id"])] == shards.feistel_slots(np.arange(n), n, 3).tolist()
    read = list(shards.read_slots(out, 0, n, 128, 100))
    for r, ids in zip(rows, read, strict=True):
        assert zlib.crc32(ids.tobytes()) == r["crc32"] and (ids[r["n_tokens"] :] == 0).all()
        assert r["shard"] == r["slot"] // 100 and r["byte_offset"] == r["slot"] % 100 * 256
    assert [x.tolist() for x in shards.read_slots(out, 150, 260, 128, 100)] == [x.tolist() for x in read[150:260]]
    total = sum(len(plain(t)) + 1 for t in TEXTS) * 30
    assert sum(r["n_tokens"] for r in rows) == total
    assert sorted({d for r in rows for d in r["doc_ids"]}) == list(range(len(TEXTS) * 30))
    assert not [p for p in (tmp_path / "shards").iterdir() if p.name.startswith("draft")]
    again = shards.write_shards(docs(spark, TEXTS * 30).withColumn("more", F.lit(1)), out, key=3, length=128, records=100)
    assert again.count() == n


def test_stable_shards_do_not_depend_on_the_partitioning(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS * 25)] + [(3, "a"), (3, "another text under the id"), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    for parts in (2, 3):
        out = str(tmp_path / f"shards-{parts}")
        found = shards.write_shards(df.repartition(parts), out, key=3, length=128, records=100, bucket_documents=64).orderBy("slot").collect()
        made.append((found, {p.name: p.read_bytes() for p in (tmp_path / f"shards-{parts}").iterdir()}))
    assert made[0] == made[1] and len(made[0][1]) > 1
    assert sum(r["n_tokens"] for r in made[0][0]) == sum(len(np.frombuffer(tokens.encoder(tokens.default_paths()).encode(t or ""), "<u4")) + 1 for _, t in rows)
    assert shards.write_shards(df.limit(0), bucket_documents=64).count() == 0
