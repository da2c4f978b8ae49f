import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumaflow.llm import lattice_lm, mixing, near_dedup, packing, quality, suffix_dedup, telephony, token_counts, top_k, toxicity
from lumaflow.llm.rolling import BLANK, hashed_words, spans_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, length string, size string"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", "y", "z") for i, t, s in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


ODD = [(1, None, "a"), (2, "", None), (None, "one two three", "b"), (3, "a" * 3000, "a"), (3, "a" * 3000, "a"), (4, "é" * 700 + " ☃", "é"), (5, " \n\t ", None), (6, "word " * 900, "b")]


# ---- 1 ----------------------------------------------------------------------------------------


def removed(texts, width=400):
    seen = Counter(hashlib.md5(t[s : s + width]).digest() for t in texts for s in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - width + 1):
            if seen[hashlib.md5(t[s : s + width]).digest()] > 1:
                gone[s : s + width] = True
        out.append((len(t), int(gone.sum()), len(spans_of(gone)[0]), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def suffix_rows(df):
    return sorted(tuple(r)[1:] for r in suffix_dedup.dedup_suffixes(df).collect())


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdefgh ", k=rng.randint(300, 2000))) for _ in range(8)]
    rows = list(ODD) + [(10, "ab" * 700, "s"), (11, "a" * 400, "s"), (12, "q" * 399, "s"), (13, "xyz" * 300, "s")]
    for i in range(60):
        t = ""
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            at = rng.randrange(len(b))
            t += b[at : at + rng.choice([399, 400, 401, 200, 700])] + "".join(rng.choices("xyz", k=rng.choice([0, 0, 1, 30])))
        rows.append((100 + i, t, "s"))
    assert suffix_rows(docs(spark, rows).repartition(3)) == removed([(t or "").encode() for _, t, _ in rows])


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_suffix_dedup_of_many_ranges_and_long_texts(spark, monkeypatch, crowd):
    """Small ranges, runs and text portions: seeds and windows are parted over many merges."""
    for name, value in (("CROWD", crowd), ("RANGE_BYTES", 20_000), ("RUN_BYTES", 30_000), ("TEXT_BYTES", 3000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared, long = letters(450), letters(30_000)
    rows = [(i, letters(rng.randint(0, 300)) + shared[rng.randint(0, 120) :] + letters(rng.randint(0, 300)), "s") for i in range(40)]
    rows += [(100, long, "s"), (101, long[:9000] + letters(5000) + long[20_000:], "s"), (102, long[3000:3399], "s"), (103, long[5000:5400], "s")]
    assert suffix_rows(docs(spark, rows).repartition(4)) == removed([t.encode() for _, t, _ in rows])


def without_passages(texts, n=50):
    """Removal of 400-byte strings and of runs of n words that also start anywhere else, with the blanks between words that go."""
    at = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    words = [[t[a:b] for a, b in own] for t, own in zip(texts, at, strict=True)]
    seen = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
    strings = Counter(hashlib.md5(t[s : s + 400]).digest() for t in texts for s in range(len(t) - 399))
    out = []
    for t, w, own in zip(texts, words, at, strict=True):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 399):
            if strings[hashlib.md5(t[s : s + 400]).digest()] > 1:
                gone[s : s + 400] = True
        cut = {k + j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for j in range(n)}
        for j in cut:
            gone[own[j][0] : own[j + 1][0] if j + 1 in cut else own[j][1]] = True
        out.append((len(t), int(gone.sum()), len(spans_of(gone)[0]), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd", [20_000, 2])
@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup_of_word_passages(spark, monkeypatch, crowd, small):
    """Repeated runs of 50 words of under 400 bytes go, also with other blanks, in one merge and in many."""
    for name, value in (("CROWD", crowd), *((("RANGE_BYTES", 9000), ("RUN_BYTES", 9000), ("TEXT_BYTES", 1500)) if small else ())):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(n)]
    base = [words(rng.randint(60, 90)) for _ in range(5)]
    rows = list(ODD) + [(10, "a " * 50, "s"), (11, "b " * 49, "s"), (12, "c " * 49 + "\t c", "s"), (13, "D d " * 30, "s")]
    for i in range(60):
        part = []
        for _ in range(rng.randint(0, 4)):
            b, k = rng.choice(base), rng.randrange(10)
            part += b[k : k + rng.choice([30, 49, 50, 51, 70])] + words(rng.choice([0, 1, 20]))
        rows.append((100 + i, rng.choice([" ", "  ", "\n"]).join(part), "s"))
    got = suffix_dedup.dedup_suffixes(docs(spark, rows).repartition(3), with_text=True, passages=True).collect()
    want = without_passages([(t or "").encode() for _, t, _ in rows])
    assert sorted(tuple(r)[1:5] for r in got) == want
    assert want != removed([(t or "").encode() for _, t, _ in rows])
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got if r["doc_id"] not in (3, 4))


def test_suffix_dedup_of_identical_rows(spark):
    """Rows that repeat an id and a text: as many results as rows, and marks of one text alone."""
    rng = random.Random(2)
    text = prose(rng, 200)
    rows = [(1, text, "s")] * 500 + [(2, text[:700], "s"), (3, prose(rng, 200), "s"), (None, None, "s"), (None, None, "s")]
    d = docs(spark, rows).repartition(3)
    assert suffix_rows(d) == removed([(t or "").encode() for _, t, _ in rows])
    marks = suffix_dedup.repeated_spans(d)[1].collect()
    assert sum(len(r["marks"]) for r in marks) < 40


def test_kept_text_has_no_new_characters():
    text = "Aé" + "x" * 10 + "āB"
    raw = text.encode()
    gone = np.zeros(len(raw), bool)
    gone[2 : len(raw) - 2] = True  # from inside one character into another
    assert np.frombuffer(raw, np.uint8)[~gone].tobytes().decode() == "AÁB"
    assert suffix_dedup.kept_text(raw, gone) == "AB"


def test_suffix_dedup_empty(spark):
    assert suffix_rows(docs(spark, [])) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=8), min_size=1, max_size=6))
def test_loser_tree(parts):
    runs = [sorted(p) for p in parts]
    tree = suffix_dedup.LoserTree([(r, suffix_dedup.prefix_lengths(r, 6).tolist()) for r in runs])
    got = [(runs[i][k], c) for i, k, c in tree.merge()]
    strings = [s for s, _ in got]
    assert strings == sorted(s for r in runs for s in r)
    for (a, _), (b, c) in zip(got[:-1], got[1:], strict=True):
        assert c == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@given(st.lists(st.binary(max_size=30), max_size=20))
def test_front_coding(rows):
    rows = sorted(rows)
    assert suffix_dedup.front_decode(*suffix_dedup.front_code(rows)) == rows


# ---- 2 ----------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\xa0", " ", "\x1c", "\x85", "a", "the", "aaaa", "'s", "'LL", "é", "٣", "12", "²", "!", "…", "<|endoftext|>", "<|endof", "日本", "\x00", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 20))) for _ in range(1500)] + ["a" * 20_000, "ab" * 5000]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.TokenCounter(P.path("byte_bpe_50k.json")).count([t.encode() for t in texts]) == want


def test_token_counts_rows(spark):
    rows = token_counts.count_tokens(docs(spark, ODD), P.path("byte_bpe_50k.json")).collect()
    assert len(rows) == len(ODD) and {(r["n_bytes"], r["n_tokens"]) for r in rows if r["doc_id"] in (1, 2)} == {(0, 0)}
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert token_counts.count_tokens(docs(spark, []), P.path("byte_bpe_50k.json")).count() == 0


# ---- 3 ----------------------------------------------------------------------------------------


def targets(sizes, weights=(5, 2, 1)):
    """Fill by weight, stop at twice the size, share the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, total = {}, set(names), 1.5 * sum(sizes.values())
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in left}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return out


def test_mixing(spark):
    rng = random.Random(5)
    rows = ODD + [(i, prose(rng, rng.randint(0, 60)), rng.choice(["a"] * 6 + ["b", "c", "é", None])) for i in range(100, 700)]
    got = mixing.mix_sources(docs(spark, rows), keep=("source", "length")).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert {s: taken[s] for s in sizes} == {s: math.floor(want[s] + 1e-9) for s in sizes}
    again = mixing.mix_sources(docs(spark, rows).repartition(5)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mixing_of_rows_that_share_an_id(spark):
    """The cut falls among rows of one id and size: they stand in line, whole ones first."""
    rows = [(None, f"w{i} x y z", "a") for i in range(100)] + [(i, "b c", "b") for i in range(40)] + [(7, "one two three", "c")] * 60
    got = mixing.mix_sources(docs(spark, rows), keep=("text",)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = targets(sizes), Counter()
    source = {400: "a", 80: "b", 180: "c"}
    for r in got:
        taken[source[r["source_size"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] == 2 * len(r["text"].split())
    assert {s: taken[s] for s in sizes} == {s: math.floor(want[s] + 1e-9) for s in sizes}
    assert sum(0 < r["taken"] % r["size"] for r in got) <= 3
    again = mixing.mix_sources(docs(spark, rows).repartition(3), keep=("text",)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mixing_nothing(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert mixing.mix_sources(docs(spark, [(1, None, None)])).first()["taken"] == 0


# ---- 4 ----------------------------------------------------------------------------------------


def test_lattice_against_all_segmentations():
    own = lattice_lm.pieces(P.path("piece_bpe_32k.model"))
    assert np.logaddexp.reduce(own.log) == pytest.approx(0, abs=1e-9)
    index = own.by_raw
    for word in (b"the", b"abc", "é".encode(), b"x", b"hello"):
        text = b" " + word
        total = -np.inf
        for cuts in range(1 << (len(text) - 1)):
            at = [0, *[i + 1 for i in range(len(text) - 1) if cuts >> i & 1], len(text)]
            rows = [index.get(text[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            if None not in rows:
                total = np.logaddexp(total, sum(own.log[r] for r in rows))
        assert own.words([word], own.log)[0][0] == pytest.approx(total)
        assert own.long_word(text, own.log) == pytest.approx(total)
    used = own.words([b"hello"], own.log, np.array([3.0]))[1]
    slow = np.zeros(len(own.log))
    own.long_word(b" hello", own.log, slow, 3.0)
    assert np.allclose(used, slow)


def test_lattice_scores(spark):
    rng = random.Random(2)
    rows = ODD + [(i, prose(rng, rng.randint(1, 40)), "a") for i in range(100, 200)]
    got = lattice_lm.lattice_scores(docs(spark, rows), P.path("piece_bpe_32k.model"))
    got = got.collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    count = Counter()
    for i, t, _ in rows:
        if not held(i):
            count.update([*(t or "").encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t, _ in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        want.append((held(i), len(tokens), sum(count[w] > 0 for w in tokens), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    have = sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert have == sorted((*w[:4], round(w[4], 6)) for w in want)
    # every document's score, from sums over all segmentations one word at a time
    words = spark.createDataFrame([(bytearray(w), c) for w, c in count.items() if w is not None], "word binary, count long")
    log = lattice_lm.fit_pieces(words, count[None], P.path("piece_bpe_32k.model"))
    own = lattice_lm.pieces(P.path("piece_bpe_32k.model"))
    weight = dict(zip(own.raw, np.exp(log).tolist(), strict=False))
    opening, stop = sum(x for p, x in weight.items() if p.startswith(b" ")), math.exp(log[-1])
    ones, twos = (sum(c == k for w, c in count.items() if w is not None) for k in (1, 2))
    d = ones / (ones + 2 * twos) if ones and twos else 0.5
    seen = {}

    def spelled(word):
        text, ways = b" " + word, [1.0]
        for j in range(1, len(text) + 1):
            ways.append(sum(ways[i] * weight.get(text[i:j], 0.0) for i in range(max(0, j - own.longest), j)))
        return ways[-1] * (opening + stop) / opening

    def chance(word):
        if word not in seen:
            seen[word] = max(count[word] - d, 0.0) / n + d * (v - 1) / n * spelled(word)
        return math.log10(seen[word])

    short = lambda t: max(map(len, (t or "").encode().split()), default=0) < 60  # noqa: E731 (longer products underflow here)
    want = sorted((i is not None, i or 0, round(sum(map(chance, (t or "").encode().lower().split())) + math.log10(count[None] / n), 6)) for i, t, _ in rows if short(t))
    ids = {i for i, t, _ in rows if short(t)}
    have = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["score"]) for r in got if r["doc_id"] in ids)
    assert [h[:2] for h in have] == [w[:2] for w in want] and [h[2] for h in have] == pytest.approx([w[2] for w in want], abs=1e-5)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_word_probabilities_sum_to_one():
    """Over all words of two letters, spelled by a vocabulary with pieces that open words and pieces that go on."""
    own = lattice_lm.Pieces.__new__(lattice_lm.Pieces)
    own.raw = sorted([b" ", b" a", b"a", b"b", b"ab", b" ba"])
    own.by_raw = {x: i for i, x in enumerate(own.raw)}
    own.longest, own.opens = 3, np.array([x.startswith(b" ") for x in own.raw] + [False])
    log = np.log(np.array([0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.4]))
    own._trie()
    total = 0.0
    for n in range(14):
        words = [bytes(97 + (k >> i & 1) for i in range(n)) for k in range(1 << n)]
        total += np.exp(own.words(words, log)[0] + lattice_lm.word_shift(own, log)).sum()
    assert total == pytest.approx(1, abs=1e-4)


@given(st.lists(st.integers(0, (1 << 31) - 1), max_size=20))
def test_packed_places(places):
    assert lattice_lm.unpack_places(lattice_lm.pack_places(np.array(places, np.int32))).tolist() == places


def test_long_texts_are_numbered_in_portions():
    text = b" ".join(b"w%d" % i for i in range(5000)) + b"  x" * 50
    assert [w for part in lattice_lm.split_words(text, 100) for w in part] == text.split()


def test_lattice_nothing(spark):
    assert lattice_lm.lattice_scores(docs(spark, []), P.path("piece_bpe_32k.model")).count() == 0


# ---- 5, 10 ------------------------------------------------------------------------------------


def labelled(spark, rng, n=700):
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = prose(rng, rng.randint(20, 200)).split()
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vile", "rotten"]))
        junk = rng.random() < 0.3
        rows.append((i, (" | ".join(words) if junk else " ".join(words)), "a"))
        labels.append((i, int(not junk), int(bad)))
    labels += [(0, None, None), (None, 1, 1)]
    return docs(spark, ODD[:0] + rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("run,label,held", [(toxicity.toxicity, "toxic", lambda c: c % 4 == 2), (quality.quality, "quality", lambda c: c % 5 == 0)])
def test_classifiers(spark, run, label, held):
    d, labels = labelled(spark, random.Random(8))
    got = run(d, labels).join(labels.where("doc_id is not null and toxic is not null"), "doc_id").collect()
    assert all(r["held_out"] == held(zlib.crc32(str(r["doc_id"]).encode())) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    test = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in test) / len(test) > 0.95
    odd = run(docs(spark, ODD), labels).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert run(docs(spark, []), labels).count() == 0
    assert all(0 <= r["score"] <= 1 for r in run(d, labels.limit(0)).collect())


def test_ftrl_against_plain_steps():
    """The published per-coordinate update, one number at a time."""
    rng, bits = random.Random(11), 6
    rows = [sorted(rng.sample(range(1, 64), rng.randint(0, 9))) for _ in range(80)]
    label = [float(bool(set(r) & {3, 17})) for r in rows]
    model = toxicity.Ftrl(bits)
    alpha, beta, l1, l2 = model.alpha, model.beta, model.l1, model.l2
    yes = sum(label)
    z, n = [0.0] * 64, [0.0] * 64
    z[0] = -math.log((yes + 0.5) / (len(label) - yes + 4.5)) * (beta / alpha + l2)

    def weight(i):
        edge = l1 if i else 0.0
        return 0.0 if abs(z[i]) <= edge else -(z[i] - math.copysign(edge, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for row, y in zip(rows, label, strict=True):
            own = [0, *row]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - step * w[i]
                n[i] += g * g
    index, weights = toxicity.fit(np.array([i for r in rows for i in r]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.array(label), 3, bits)
    want = {i: weight(i) for i in range(64) if weight(i)}
    assert dict(zip(index.tolist(), weights.tolist(), strict=True)) == pytest.approx(want)


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_classifiers_with_text_ids_and_repeated_rows(spark, run):
    rng = random.Random(9)
    d, labels = labelled(spark, rng, 200)
    d, labels = (x.withColumn("doc_id", F.concat(F.lit("id-"), F.col("doc_id").cast("string"))) for x in (d, labels))
    got = sorted(tuple(r) for r in run(d, labels).collect())
    assert len(got) == 200
    again = sorted(tuple(r) for r in run(d.union(d).union(d), labels).collect())
    assert again == sorted(got * 3)  # repeated rows neither change the model nor make more rows


def plain_passages(text):
    """The features of a text's passages, passage by passage and word by word."""
    words = [w for w in re.finditer(rb"[^ \t\n\v\f\r]+", text)]
    groups = [words[i : i + quality.PASSAGE_WORDS] for i in range(0, len(words), quality.PASSAGE_WORDS)] or [[]]
    out = []
    for k, group in enumerate(groups):
        begin = 0 if k == 0 else group[0].start()
        end = groups[k + 1][0].start() if k + 1 < len(groups) else len(text) + 1  # a blank closes the text
        own = (text + b" ")[begin:end]
        count = [0.0] * quality.CLASSES
        for byte in own:
            count[quality.CLASS[byte]] += 1
        tokens = [w.group() for w in group]
        n, some, sizes = len(tokens), max(len(tokens), 1), [len(t) for t in tokens]
        lower = [t.lower() for t in tokens]
        mean = sum(sizes) / some
        marked = [quality.CLASS[t[-1]] not in (32, 33, 34, 37) for t in tokens]
        other = [mean, math.sqrt(max(sum(x * x for x in sizes) / some - mean * mean, 0)), math.log1p(n), sum(a == b for a, b in zip(lower[1:], lower[:-1], strict=True)) / some, len(set(lower)) / some]
        other += [sum(marked) / some, sum(m and x == 1 for m, x in zip(marked, sizes, strict=True)) / some, sum(x > 25 for x in sizes) / some]
        hashed = [0.0] * quality.HASHED
        for t in tokens:
            hashed[(int(hashed_words([t], ~BLANK)[0][0]) >> 56) % quality.HASHED] += 1
        out.append([math.sqrt(c / max(sum(count), 1)) for c in count] + other + [math.sqrt(c / some) for c in hashed])
    return out


def plain_score(model, passages):
    """Gated attention over passages, one number at a time."""
    w = model.w
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    z, e = [], []
    for f in passages:
        x = [min(max((v - m) / s, -6), 6) for v, m, s in zip(f, model.mean, model.scale, strict=True)]
        z.append([math.tanh(sum(x[i] * w["W"][i][j] for i in range(len(x))) + w["b"][j]) for j in range(quality.HIDDEN)])
        gate = [math.tanh(sum(z[-1][i] * w["V"][i][j] for i in range(quality.HIDDEN))) * sigmoid(sum(z[-1][i] * w["U"][i][j] for i in range(quality.HIDDEN))) for j in range(quality.GATE)]
        e.append(math.exp(sum(g * a for g, a in zip(gate, w["a"], strict=True))))
    bag = [sum(x * row[j] for x, row in zip(e, z, strict=True)) / sum(e) for j in range(quality.HIDDEN)]
    return sigmoid(sum(b * c for b, c in zip(bag, w["c"], strict=True)) + w["d"][0])


def test_quality_against_plain_loops(spark):
    """Scores of the operator, from the features on, against loops over passages, words and weights."""
    d, labels = labelled(spark, random.Random(4), 120)
    both = d.unionByName(docs(spark, [(1000 + k, t, s) for k, (_, t, s) in enumerate(ODD) if t != ODD[3][1]]))
    weights = quality.train(toxicity.labelled_sample(both, labels, "quality", 5, 0, 6000))
    model = quality.AttentionModel.unpack(weights)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in both.collect()}
    for r in quality.score_quality(both, weights).collect():
        assert r["score"] == pytest.approx(plain_score(model, plain_passages(texts[r["doc_id"]])), abs=1e-4)


def test_quality_learns_words(spark):
    """Labels that only the words tell: the hashed words carry them."""
    rng = random.Random(6)
    rows = []
    for i in range(600):
        words = prose(rng, 80).split()
        for k in range(0, 80, 8):
            words[k] = ("alpha", "omega")[i % 2]
        rows.append((i, " ".join(words), "a"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = [r for r in quality.quality(docs(spark, rows), labels).collect() if r["held_out"]]
    assert sum((r["score"] >= 0.5) == r["doc_id"] % 2 for r in got) > 0.95 * len(got)


def test_attention_gradients():
    rng = np.random.default_rng(0)
    f, first, y = rng.normal(size=(9, quality.N_FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = quality.AttentionModel(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES))
    loss = lambda: -np.mean(y * np.log(model.forward(f, first)["p"]) + (1 - y) * np.log(1 - model.forward(f, first)["p"]))
    for key, g in model.gradients(f, first, y).items():
        at = tuple(0 for _ in g.shape)
        keep = model.w[key][at]
        model.w[key][at] = keep + 1e-6
        up = loss()
        model.w[key][at] = keep - 1e-6
        down = loss()
        model.w[key][at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


# ---- 6 ----------------------------------------------------------------------------------------


def slow_ima(block):
    value, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            move = (((code & 7) * 2 + 1) * step) >> 3
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(telephony.INDEX_STEP[code & 7])))
            out.append(value)
    return out


@given(st.binary(min_size=64, max_size=64))
@settings(max_examples=30, deadline=None)
def test_ima(block):
    assert telephony.decode_ima(np.frombuffer(block, np.uint8)[None])[0].tolist() == slow_ima(block)


def test_companding_tables():
    assert telephony.MULAW[[0xFF, 0x7F, 0x80, 0x00]].tolist() == [0, 0, 32124, -32124]
    assert telephony.ALAW[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    assert len(set(telephony.MULAW.tolist())) == 255 and len(set(telephony.ALAW.tolist())) == 256


@pytest.mark.parametrize("codec", list(telephony.TAGS))
def test_audio_round_trip(spark, codec):
    stored = telephony.store_audio(docs(spark, ODD), codec)
    for r in stored.collect():
        tag, coded = telephony.read_wave(bytes(r["media"]))
        assert tag == telephony.TAGS[codec] and len(coded) == r["payload_bytes"] and len(r["pcm16k"]) == 4 * len(telephony.expand(tag, coded))
    want = Counter()
    for i, t, _ in ODD:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    got = telephony.media_digest(stored).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (1, 2)}) == 1


# ---- 7 ----------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(4)
    rows = ODD + [(i, prose(rng, rng.choice([5, 50, 300, 900, 2500])), "a") for i in range(100, 160)]
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            own = ids[k : k + 2048]
            want[i, k // 2048, k, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
    got = packing.pack_documents(docs(spark, rows), P.path("word_bpe_49k.json")).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    gaps = []  # best fit, longest first, one by one
    for length in sorted((r["length"] for r in got), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 2048) - length)
    assert len(sequences) <= len(gaps)
    assert packing.pack_documents(docs(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_encoder_equals_the_library():
    rng = random.Random(1)
    parts = [" ", "\n", "\xa0", " ", "\x1c", "a", "The", "aaaa.", "'s", "'LL", "é", "é", "́", "٣", "12", "²", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "日本", "Σ", "İ", "ẞ", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 20))) for _ in range(1500)]
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(P.path("word_bpe_49k.json")).encode([t.encode() for t in texts])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_encoder_on_letters_and_marks():
    """Every letter that the fast path may take, alone and inside a word, with each mark; lower-casing may yield a mark."""
    letters = [chr(c) for c in range(0x41, 0x500) if chr(c).isalpha()]
    texts = ["İ,", "İ.", "DİYARBAKIRİ.", "x İ y"] + [a + c + b + mark for c in letters for mark in ("", ".", ",") for a, b in (("", ""), ("a", "b"), ("A", ""))]
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(P.path("word_bpe_49k.json")).encode([t.encode() for t in texts])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=13), st.lists(st.integers(1, 14), max_size=40))
def test_complement_index_over_falling_counts(free, gaps):
    """Whatever the index passed before, it finds a filling just if a search from the start does."""
    free = np.array(free)
    free[0] = 0
    index = packing.ComplementIndex(free)
    for gap in gaps:
        got = index.fill(gap)
        assert (got is None) == (packing.exact_fill(gap, free.copy()) is None)
        for x in got or np.flatnonzero(free)[:1].tolist():
            free[x] -= 1
        assert (free >= 0).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plan_uses_every_piece(counts):
    plan = packing.pack_plan(counts, 40)
    used = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 40
        for x in lengths:
            used[x] += n
    assert used == Counter(counts)
    p = packing.plan_places(plan)
    assert len(p["length"]) == sum(len(x) for x, _ in plan)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=13), st.integers(1, 12))
def test_exact_fill(free, gap):
    free[0] = 0
    items = [x for x, n in enumerate(free) for _ in range(n)]
    want = any(sum(c) == gap for k in (1, 2, 3) for c in combinations(items, k))
    got = packing.exact_fill(gap, np.array(free))
    assert (got is not None) == want
    if got:
        assert sum(got) == gap and not Counter(got) - Counter(items)


# ---- 8 ----------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(3)
    near = rng.normal(size=(20, 6))
    vectors = [(i, (near[i % 20] + 0.05 * rng.normal(size=6)).tolist()) for i in range(900)]
    vectors += [(2000, None), (2020, [1.0] * 5 + [None]), (2040, [math.nan] * 6), (2060, [math.inf] * 6), (2080, [1.0] * 5), (40, vectors[40][1]), (3, vectors[5][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("id", F.lit("x"))
    got = top_k.top_k(df.where("vec_id % 20 = 0"), df, 20, block_rows=200).collect()
    # a shorter vector counts as filled up with zeros: only null and non-finite components keep a row out
    sound = [(i, np.floor(64 * np.array([*v, 0.0][:6])).astype(int)) for i, v in vectors if v and None not in v and np.isfinite(np.array(v, float)).all()]
    want = set()
    for q, a in sound:
        if q % 20 == 0:
            best = sorted((-int(a @ b), i) for i, b in sound if i != q)[:20]
            want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)
    assert top_k.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [2.0**20, 2.0**27, 2.0**40, 1e30, 1e300])
def test_top_k_scores_are_exact(spark, size):
    """Products that doubles, 64-bit integers or neither hold; scores beyond 64 bits count as the nearest 64-bit integer."""
    rng = np.random.default_rng(7)
    vectors = [(i, (rng.normal(size=5) * size).tolist()) for i in range(120)]
    vectors += [(i, vectors[i - 120][1]) for i in range(120, 140)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k.top_k(df.where("vec_id % 20 = 0"), df, 7, block_rows=50).collect()}
    whole = {i: [math.floor(64 * x) for x in v] for i, v in vectors}
    want = set()
    for q, a in whole.items():
        if q % 20 == 0:
            score = {i: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=True)))) for i, b in whole.items() if i != q}
            want |= {(q, r, i, score[i]) for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:7], 1)}
    assert got == want


def test_top_k_of_many_equal_vectors(spark):
    vectors = [(i, [1.0, 0.5]) for i in range(2000)] + [(i, [math.cos(i), math.sin(i)]) for i in range(2000, 2300)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in top_k.top_k(df.where("vec_id % 500 = 0"), df, 5, block_rows=300).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got[500]) == [(r + 1, i) for r, i in enumerate(range(5))] and sorted(got[0]) == [(r, r) for r in range(1, 6)]


def test_block_pairs_are_pruned_on_clusters(spark):
    """Clustered vectors: most candidates are never compared, and what is left is few pairs."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 8))
    centres *= 50 / np.linalg.norm(centres, axis=1)[:, None]
    vectors = [(i, (centres[i % 16] + 0.05 * rng.normal(size=8)).tolist()) for i in range(3200)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = [top_k.whole_vectors(x, "vec_id", "embedding", 64.0) for x in (df.where("vec_id % 20 = 0"), df)]
    pairs = top_k.block_pairs(top_k.trees(*whole, 200)).collect()
    own = {r["q"]: r["bound"] for r in pairs if r["first"]}
    assert sum(r["bound"] >= 0.9 * own[r["q"]] for r in pairs) < 0.5 * len(pairs)


def test_dual_tree_prunes():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 100
    points = np.floor(np.repeat(centres, 100, 0) + rng.normal(size=(4000, 8)))
    s = top_k.DualTreeSearch(points[::100], np.arange(0, 4000, 100), points, np.arange(4000), 5)
    s.run()
    assert s.compared < 0.5 * 40 * 4000


# ---- 9 ----------------------------------------------------------------------------------------


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("chunk", [8 << 20, 4000])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK_BYTES", chunk)
    rng = random.Random(6)
    rows = list(ODD)
    for g in range(25):
        base = prose(rng, rng.choice([1, 3, 30, 120])).split()
        for k in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2]) if len(own) > 20 else 0):
                own[rng.randrange(len(own))] = "changed%d" % rng.randint(0, 99)
            rows.append((1000 + 100 * g + k, " ".join(own), "a"))
    shared = prose(rng, 20)
    rows += [(9000 + i, prose(rng, 60) + " " + shared + " " + prose(rng, 60), "a") for i in range(30)]
    sets = [shingle_set(t or "") for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    want = Counter()
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    for ids in members.values():
        known = [x for x in ids if x is not None]
        for x in ids:
            want[x, min(known) if known else None, len(ids)] += 1
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == want
    kept = near_dedup.keep_one(docs(spark, rows))
    assert kept.count() == len(members) and kept.columns == docs(spark, rows).columns
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_bucket_links_make_the_components_of_all_links():
    rng = np.random.default_rng(2)
    base = [rng.integers(1, 1 << 60, 60, dtype=np.uint64) for _ in range(4)]
    rows = []
    for k in range(60):
        own = base[k % 4].copy()
        own[rng.integers(0, 60, rng.integers(0, 9))] = rng.integers(1, 1 << 60, dtype=np.uint64)
        rows.append(np.unique(own)[:: 1 if k % 2 else -1].copy() if k % 3 == 0 else own)
    tids = [b"%02d" % i for i in range(60)]

    def classes(links):
        label = {t: t for t in tids}
        for a, b in links:
            x, y = label[a], label[b]
            label = {t: (x if v == y else v) for t, v in label.items()}
        return sorted(sorted(t for t in tids if label[t] == v) for v in set(label.values()))

    linked = lambda i, j: near_dedup.alignment_similarity(rows[i], rows[j]) >= 0.8
    got = near_dedup.bucket_links(tids, [r.tobytes() for r in rows])
    assert classes(got) == classes([(tids[i], tids[j]) for i, j in combinations(range(60), 2) if linked(i, j)])
    half = np.arange(60) % 5 < 2
    got = near_dedup.bucket_links(tids, [r.tobytes() for r in rows], half)
    assert all(half[int(a)] != half[int(b)] for a, b in got)
    assert classes(got) == classes([(tids[i], tids[j]) for i, j in combinations(range(60), 2) if half[i] != half[j] and linked(i, j)])


def test_near_duplicates_of_rows_without_ids(spark):
    """Null and repeated ids: rows are keyed by id and text, so they do not meet all of each other."""
    rng = random.Random(3)
    rows = [(None, prose(rng, 40), "a") for _ in range(150)] + [(7, prose(rng, 40), "a") for _ in range(150)]
    rows += [rows[0]] * 50
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows) and Counter(r["class_size"] for r in got) == {1: 299, 51: 51}


def test_alignment_follows_order():
    a = np.arange(1, 101, dtype=np.uint64)
    assert near_dedup.alignment_similarity(a, a) == 1
    assert near_dedup.alignment_similarity(a, np.concatenate([a[:50], a[55:]])) == pytest.approx(0.95)
    assert near_dedup.alignment_similarity(a, np.concatenate([a[50:], a[:50]])) == 0


@pytest.mark.parametrize(("n", "m", "same"), [(35, 28, 28), (31, 32, 28), (65, 52, 52)])
def test_alignment_at_exactly_the_threshold(n, m, same):
    a, new = np.arange(1, n + 1, dtype=np.uint64), np.arange(1000, 1000 + m, dtype=np.uint64)
    for kept in (slice(0, same), slice(n - same, n)):
        b = np.concatenate([a[kept], new[same:]]) if kept.start == 0 else np.concatenate([new[same:], a[kept]])
        assert near_dedup.alignment_similarity(a, b) == near_dedup.alignment_similarity(b, a) == 0.8
        assert near_dedup.alignment_similarity(a, np.where(b == a[n // 2], np.uint64(5000), b)) == 0
    packed = [a.tobytes(), b.tobytes()]
    assert near_dedup.bucket_links([b"a", b"b"], packed) == [(b"a", b"b")]


def test_every_pair_at_exactly_the_threshold():
    for unit in range(1, 120):  # 9 * unit shingles in two texts, 4 * unit of them matched: 4 / (9 - 4) = 0.8
        a = np.arange(1, 5 * unit + 1, dtype=np.uint64)
        for b in (a[: 4 * unit], a[unit:]):
            assert near_dedup.alignment_similarity(a, b) == near_dedup.alignment_similarity(b, a) == 0.8


def plain_feature(payload):
    """The digest's feature, one sample at a time."""
    codec = list(telephony.TAGS)[zlib.crc32(payload) % 3]
    if codec == "ima_adpcm":
        pcm = [x for a in range(0, len(payload), 64) for x in slow_ima(payload[a : a + 64])]
    else:
        pcm = [int((telephony.MULAW if codec == "mulaw" else telephony.ALAW)[b]) for b in payload]
    at = lambda i: pcm[min(max(i, 0), len(pcm) - 1)]
    doubled = []
    for i, x in enumerate(pcm):
        between = (-3 * at(i - 1) + 19 * at(i) + 19 * at(i + 1) - 3 * at(i + 2) + 16) >> 5
        doubled += [x, max(-32768, min(32767, between))]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm[1:], pcm[:-1], strict=True))
    return f"format={telephony.TAGS[codec]};n={len(pcm)};energy={sum(x * x for x in pcm)};peak={max(map(abs, pcm))};crossings={crossings};pcm16k={zlib.crc32(struct.pack(f'<{len(doubled)}h', *doubled))}"


def test_features_of_mixed_codecs(spark, monkeypatch):
    """All three codecs at once, against plain loops; signals longer than a portion."""
    rng = random.Random(4)
    rows = ODD + [(i, prose(rng, rng.randint(0, 400)), "a") for i in range(100, 130)]
    stored = telephony.store_audio(docs(spark, rows), telephony.MIXED)
    got = Counter((r["doc_id"], r["feature"]) for r in telephony.media_digest(stored).collect())
    assert got == Counter((i, plain_feature(telephony.padded((t or "").encode()))) for i, t, _ in rows)
    assert len({f.split(";")[0] for _, f in got}) == 3
    monkeypatch.setattr(telephony, "PORTION", 256)
    files = [(telephony.TAGS[telephony.codec_of(p, telephony.MIXED)], p) for p in (telephony.padded((t or "").encode()) for _, t, _ in rows)]
    assert [telephony.signal_feature(tag, pcm, None) for (tag, _), pcm in zip(files, telephony.expand_all(files), strict=True)] == [plain_feature(p) for _, p in files]


@pytest.mark.parametrize("codec", list(telephony.TAGS))
def test_digest_is_of_the_stored_pcm(spark, codec):
    feature = lambda df: {(r["doc_id"], r["payload_sha256"]): r["feature"] for r in telephony.media_digest(df).collect()}
    stored = telephony.store_audio(docs(spark, ODD), codec)
    plain = feature(stored)
    assert plain == feature(telephony.store_audio(docs(spark, ODD), codec, with_pcm=False))
    other = feature(stored.withColumn("pcm16k", F.expr("X'0102'")))
    assert {f.rsplit("=", 1)[1] for f in other.values()} == {str(zlib.crc32(b"\x01\x02"))}


def test_telephony_query_stores_pcm(spark, monkeypatch):
    from lumaflow.llm import queries

    monkeypatch.setattr(queries, "documents", lambda spark, d: docs(spark, ODD))
    monkeypatch.setattr(telephony, "media_digest", lambda media: media)
    assert queries.op6_telephony(spark, "").where("pcm16k is null or length(pcm16k) not in (4 * payload_bytes, payload_bytes div 64 * 121 * 4)").count() == 0


def test_telephony_digest_without_media_through_the_jvm(spark, tmp_path):
    """One pass over the texts, with the rows that a digest of the written media has."""
    stored = telephony.store_audio(docs(spark, ODD), telephony.MIXED)
    fused = telephony.media_digest(stored)
    assert fused._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    stored.write.parquet(f"{tmp_path}/media")
    assert Counter(fused.collect()) == Counter(telephony.media_digest(spark.read.parquet(f"{tmp_path}/media")).collect())
