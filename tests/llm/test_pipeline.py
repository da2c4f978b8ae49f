import hashlib
import math
import random
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from lumaflow.llm import toxicity
from tests.llm.test_operators import shingle_set, targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def corpus():
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(n))
    rows, labels = [(1, None, "en", "a", 0, "x"), (2, "", "en", None, 0, "x"), (3, "é" * 900 + " ü", "fr", "b", 902, "x")], []
    shared = prose(70)
    for i in range(10, 400):
        text, bad = prose(rng.randint(30, 150)), i % 4 == 0
        if bad:
            text += " vile rotten nasty vile rotten"
        if i % 7 == 0 and not bad:
            text += " " + shared + " " + prose(20)
        if i % 11 == 0 and not bad:
            text += " naïve Ünïcode " + "ß" * (200 + i)
        rows.append((i, text, "en", rng.choice("abc"), len(text), "x"))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + r[0], r[1], *r[2:]) for r in rows[5:25]]
    near = [(2000 + r[0], " ".join(["other", *r[1].split()[1:]]), *r[2:]) for r in rows[30:50] if len(r[1].split()) > 40]
    rows += near + [rows[6]]
    return rows, labels, shared


def test_each_stage_against_brute_force(spark, tmp_path):
    rows, labels, shared = corpus()
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {"": [tuple(r)[:5] for r in docs.collect()]}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        seen[name] = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == list(pipeline.COLUMNS)

    # toxicity: rows stay unchanged, and those go that the model, run text by text here, scores 0.3 or more
    model = toxicity.train(toxicity.labelled_sample(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "toxic", 4, 2, toxicity.SAMPLE_ROWS))
    dense = np.zeros(1 << toxicity.BITS, np.float32)
    dense[model[0]] = model[1]
    clean = [r for r in seen[""] if toxicity.scores([(r[1] or "").encode()], dense)[0] < 0.3]
    assert Counter(seen["toxicity"]) == Counter(clean)
    assert {r[0] for r in clean} == {r[0] for r in rows} - {r[0] for r in rows if r[1] and "vile" in r[1]}

    # near-duplicates: one row, that of the least id, of every class of pairs at 0.8 or more
    sets = [shingle_set(r[1] or "") for r in clean]
    label = list(range(len(clean)))
    for i, j in combinations(range(len(clean)), 2):
        if label[i] != label[j] and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            label = [label[i] if x == label[j] else x for x in label]
    kept = [min((r for r, x in zip(clean, label, strict=True) if x == own), key=lambda r: r[0]) for own in set(label)]
    assert Counter(seen["near_dedup"]) == Counter(kept)

    # repeated strings: every byte under a 400-byte string that occurs twice; a character that lost a byte goes whole
    raw = [(r[1] or "").encode() for r in kept]
    windows = Counter(t[s : s + 400] for t in raw for s in range(len(t) - 399))
    want = []
    for r, t in zip(kept, raw, strict=True):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 399):
            if windows[t[s : s + 400]] > 1:
                gone[s : s + 400] = True
        text = "".join(c for c, a in zip(t.decode(), np.cumsum([0] + [len(c.encode()) for c in t.decode()]), strict=False) if not gone[a : a + len(c.encode())].any())
        want.append((r[0], text, r[2], r[3], len(text)))
    assert Counter(seen["suffix_dedup"]) == Counter(want)
    assert sum(shared in r[1] for r in kept if r[1]) > 10 and not any(shared in r[1] for r in want)

    # mixing: documents in order of their keys up to each source's budget, whole epochs first
    sizes, words = Counter(), {}
    for r in want:
        words[r[0]] = r[1].encode().split()
        sizes[r[3]] += len(words[r[0]])
    budget, expected = targets(sizes), Counter()
    for source in sizes:
        left = math.floor(budget[source] + 1e-9)
        epoch = sorted((hashlib.md5(f"mix:{r[0]}".encode()).hexdigest(), r) for r in want if r[3] == source)
        while left > 0 and sizes[source]:
            for _, r in epoch:
                take = min(left, len(words[r[0]]))
                if take:
                    text = r[1] if take == len(words[r[0]]) else b" ".join(words[r[0]][:take]).decode()
                    expected[r[0], text, r[2], r[3], len(text)] += 1
                left -= take
    assert Counter(seen["mixing"]) == expected

    # packing: the library's ids in pieces, sequences without gaps, at least as few as plain best fit
    library, pieces = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for (i, text, *_), n in expected.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        for a in range(0, len(ids), 2048):
            own = ids[a : a + 2048]
            pieces[i, a // 2048, a, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += n
    assert Counter(r[:5] for r in seen["packing"]) == pieces
    sequences = {}
    for r in seen["packing"]:
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    gaps = []
    for length in sorted((r[3] for r in seen["packing"]), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 2048) - length)
    assert len(sequences) <= len(gaps)

    assert Counter(tuple(r)[:5] for r in pipeline.run(spark, d).collect()) == pieces


def test_stages_on_nothing(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert pipeline.run(spark, d).count() == 0


def test_repeated_passages_of_few_bytes_are_cut(spark):
    """Passages of over 50 words that repeat in other documents go from the texts, those of under 400 bytes too."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("aeioubdg", k=rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (51, 52, 55, 60)]
    assert max(map(len, passages)) < 400
    rows = [(i, f"{text(60)} {passages[i % 4]} {text(40)}", "en", "a", 0, "x") for i in range(24)] + [(100 + i, text(150), "en", "a", 0, "x") for i in range(10)]
    cut = {r["doc_id"]: r["text"] for r in pipeline.cut_repeats(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert all(passages[i % 4] not in cut[i] and len(cut[i].split()) == 100 for i in range(24))
    assert all(cut[r[0]] == r[1] for r in rows[24:])
