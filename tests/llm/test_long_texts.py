"""Texts of megabytes among nulls and empty ones, through every operator."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumaflow.llm import lattice_lm, mixing, near_dedup, packing, quality, suffix_dedup, telephony, token_counts, toxicity
from tests.llm.test_operators import docs, prose

SIZE = 150_000  # words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    long = prose(rng, SIZE)
    words = long.split()
    near = " ".join("other" if i % 100 == 0 and i < SIZE // 2 else w for i, w in enumerate(words))  # five-word shingles: about 0.95
    out = [(1, long, "a"), (2, near, "a"), (3, "x" * 1_200_000, "b"), (4, long[700_000:700_600], "b"), (5, prose(rng, 30), "b"), (6, None, None), (7, "", "b")]
    assert len(long) > 1_000_000
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return docs(spark, rows).repartition(3).persist()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_suffix_dedup(table, rows):
    got = by_id(suffix_dedup.dedup_suffixes(table))
    assert {i: got[i]["n_bytes"] for i, *_ in rows} == {i: len((t or "").encode()) for i, t, _ in rows}
    assert got[3]["n_removed"] == 1_200_000 and got[3]["n_spans"] == 1  # it repeats itself
    assert got[4]["n_removed"] == 600 and got[5]["n_removed"] == got[6]["n_removed"] == 0
    half = len(rows[0][1]) // 2
    assert got[1]["n_removed"] > 0.45 * 2 * half and got[1]["kept_sha256"] != hashlib.sha256(rows[0][1].encode()).hexdigest()


def test_tokens_and_pieces(table, rows):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = by_id(token_counts.count_tokens(table, P.path("byte_bpe_50k.json")))
    assert {i: got[i]["n_tokens"] for i, t, _ in rows if i != 3} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows if i != 3}
    assert 0 < got[3]["n_tokens"] < 1_200_000
    library, total = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for r in packing.pack_documents(table.where("doc_id <> 3"), P.path("word_bpe_49k.json")).collect():
        total[r["doc_id"]] += r["length"]
        assert r["length"] <= 2048 and r["start"] == 2048 * r["piece"]
    assert total == Counter({i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _ in rows if i != 3})


def test_mixing_and_language_model(table, rows):
    words = {i: len((t or "").split()) for i, t, _ in rows}
    assert {i: r["size"] for i, r in by_id(mixing.mix_sources(table)).items()} == words
    got = by_id(lattice_lm.lattice_scores(table, P.path("piece_bpe_32k.model")))
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: n + 1 for i, n in words.items()}
    assert all(r["score"] < 0 for r in got.values()) and got[1]["score"] < -100_000


def test_classifiers(spark, table, rows):
    rng = random.Random(2)
    sample = [(i, prose(rng, 50) + (" vile" * 9 if i % 2 else ""), "a") for i in range(100, 300)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, *_ in sample] + [(1, 1, 1)], "doc_id long, quality int, toxic int")
    both = docs(spark, sample).unionByName(table)
    for run in (toxicity.toxicity, quality.quality):
        got = by_id(run(both, labels))
        assert len(got) == 207 and all(0 <= r["score"] <= 1 for r in got.values())
        assert got[6]["score"] == got[7]["score"]


def test_telephony(table, rows):
    got = by_id(telephony.media_digest(telephony.store_audio(table, telephony.MIXED)))
    for i, t, _ in rows:
        payload = telephony.padded((t or "").encode())
        assert (got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_near_duplicates(table):
    got = by_id(near_dedup.near_duplicates(table))
    assert [got[i]["class_size"] for i in range(1, 8)] == [2, 2, 1, 1, 1, 1, 1] and got[2]["class_id"] == 1
    assert near_dedup.keep_one(table).where(F.col("doc_id") == 2).count() == 0
