"""Suffix-array removal of repeated byte strings by a common-prefix-aware distributed merge sort.

A byte goes if a string of `width` bytes that covers it also starts anywhere else. Every window of
that width has one anchor: the leftmost of its `seed`-byte strings with the least hash, a function of
the window's bytes alone, so equal windows have equal anchors at equal offsets, and about one byte in
a hundred is an anchor. Only the suffixes at anchors are sorted, and of those only the ones whose
seed occurs at least twice anywhere (an exact filter by counts).

Anchors with equal surroundings are pre-aggregated: two of their places travel, and the verdict of the two
holds for all. Each map task sorts its suffixes into a run, cuts it at splitters and sends front-coded
segments (shared prefix length, rest). Each range is merged by a loser tree whose players carry their
common prefix with the last winner: unequal prefixes decide a match without a look at the bytes, equal
ones are compared from there on. The merge also yields the common prefixes of neighbours in suffix order;
with the same for the bytes before the anchors, an offset's windows are equal just if both neighbourhoods
agree, which is decided for all suffixes of a range at once, offset by offset. Whatever is removed was
found equal byte by byte in a merge; hashes only leave out what cannot repeat.

The suffixes of one seed cannot be parted, because windows that start before it may be equal although
the bytes far behind it are not. A seed with more than CROWD different surroundings therefore sends its windows
themselves: those whose hash occurs twice (again an exact filter) are sorted and merged as strings of
`width` bytes, which may be parted anywhere.

Passages go by the same way: each word becomes a code of 8 bytes (its hash), so a string of `width` bytes is a run of
50 words, and the words under a run that also starts anywhere else go, however few bytes they have. Codes are made in the
tasks from the texts; they are neither written nor exchanged as a whole.

Defined results: null texts are empty; texts under `width` bytes lose nothing; matches never cross
documents; repeated rows and copies repeat each other; overlaps count; ids may be null or repeated
(rows are keyed by hashes of id and text); other columns may have any names; long texts are gone
through a megabyte at a time.
"""

from __future__ import annotations

import hashlib

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaflow.llm.common import discard, lean, lean_group, small_batches, stash, text_bytes
from lumaflow.llm.rolling import CODE, join_texts, mix, prefix_hash, span_hash, spans_of, window_hash, word_codes, words_gone
from lumaflow.llm.token_counts import text_groups

WIDTH, SEED = 400, 200
RANGE_BYTES, RUN_BYTES, TEXT_BYTES = 6 << 20, 12 << 20, 1 << 20
SAMPLE = 2000
HOT_SEEDS = 5000
CROWD = 20_000


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every `span` neighbours, by doubling."""
    out, have = x, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(buffer: np.ndarray, bounds: np.ndarray, width: int = WIDTH, seed: int = SEED) -> dict[str, np.ndarray]:
    """Anchors of all windows of the texts in a buffer (each text ends one byte before the next bound).

    at: place in the buffer; low, high: its windows start `low` to `high` bytes before it;
    seed_key: hash of the seed; around: hash of all bytes of its windows and of low and high."""
    span, n = width - seed + 1, len(buffer)
    none = np.zeros(0, np.int64)
    if n < width:
        return {"at": none, "low": none, "high": none, "seed_key": none.astype(np.uint64), "around": none.astype(np.uint64)}
    prefix = prefix_hash(buffer)
    x = mix(window_hash(prefix, seed))
    least = sliding_min(x, span)
    valid = np.zeros(len(least), np.int32)
    a, b = bounds[:-1], np.maximum(bounds[1:] - width, bounds[:-1])  # starts a <= s < b
    b = np.minimum(b, len(least))
    some = a < b
    np.add.at(valid, a[some], 1)
    np.add.at(valid, b[some][b[some] < len(valid)], -1)
    valid = np.cumsum(valid) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.append(~valid[1:] | new[1:], True))
    at = np.empty(len(first), np.int64)
    for k in range(0, len(first), 4096):
        own = first[k : k + 4096]
        at[k : k + 4096] = own + x[own[:, None] + np.arange(span)].argmin(1)
    out_at, out_first, out_stop = [at], [first], [np.minimum(stop, at)]
    for i in np.flatnonzero(at < stop).tolist():  # a seed that repeats within a window: the leftmost in reach takes over
        same = first[i] + np.flatnonzero(x[first[i] : stop[i] + span] == least[first[i]])
        begin = np.concatenate([[first[i]], same[:-1] + 1])
        keep = (begin <= stop[i]) & (begin > at[i])
        out_at.append(same[keep])
        out_first.append(begin[keep])
        out_stop.append(np.minimum(same[keep], stop[i]))
    at, first, stop = np.concatenate(out_at), np.concatenate(out_first), np.concatenate(out_stop)
    low, high = at - stop, at - first
    around = mix(span_hash(prefix, first, stop + width) ^ mix((high * 1024 + low + 1).astype(np.uint64)))
    return {"at": at, "low": low, "high": high, "seed_key": x[at], "around": around}


def prefix_lengths(rows: list[bytes], width: int) -> np.ndarray:
    """Common prefix of each string with the one before it (the first: 0)."""
    n = len(rows)
    out = np.zeros(n, np.int64)
    size = np.fromiter(map(len, rows), np.int64, n)
    for k in range(1, n, 8192):
        part = rows[k - 1 : k + 8192]
        block = np.frombuffer(b"".join(r[:width].ljust(width, b"\0") for r in part), np.uint8).reshape(len(part), width)
        differ = block[1:] != block[:-1]
        same = np.where(differ.any(1), differ.argmax(1), width)
        own = size[k - 1 : k - 1 + len(part)]
        out[k : k + len(part) - 1] = np.minimum(same, np.minimum(own[1:], own[:-1]))
    return out


def _agree(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, known to be at least `at`."""
    most = min(len(a), len(b))
    step = 64
    while at < most:
        if a[at : at + step] == b[at : at + step]:
            at += step
        elif step == 1:
            return at
        else:
            step //= 8 if step > 8 else step
            step = max(step, 1)
    return most


class LoserTree:
    """Merges front-coded runs. A run is (strings, common prefixes with the string before)."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs
        self.place = [0] * len(runs)
        self.common = [0] * len(runs)  # of each run's head with the last winner
        size = 1
        while size < len(runs):
            size *= 2
        self.size = size
        self.loser = [-1] * size
        self.looked = 0
        winners = [-1] * size + [i if i < len(runs) and runs[i][0] else -1 for i in range(size)]
        for node in range(size - 1, 0, -1):
            winners[node], self.loser[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.top = winners[1]

    def _play(self, i: int, j: int) -> tuple[int, int]:
        """Winner and loser of a match; ties go to the lower run."""
        if i < 0 or j < 0:
            return (i, j) if j < 0 else (j, i)
        common = self.common
        if common[i] != common[j]:
            return (i, j) if common[i] > common[j] else (j, i)
        a, b = self.runs[i][0][self.place[i]], self.runs[j][0][self.place[j]]
        at = _agree(a, b, common[i])
        self.looked += at - common[i]
        if a[at : at + 1] < b[at : at + 1] or (at == len(a) == len(b) and i < j) or (at == len(a) < len(b)):
            common[j] = at
            return i, j
        common[i] = at
        return j, i

    def merge(self):
        """(run, place in it, common prefix with the string before) in order."""
        while self.top >= 0:
            i = self.top
            yield i, self.place[i], self.common[i]
            self.place[i] += 1
            if self.place[i] < len(self.runs[i][0]):
                self.common[i] = self.runs[i][1][self.place[i]]
                up = i
            else:
                up = -1
            node = (self.size + i) // 2
            while node:
                up, self.loser[node] = self._play(up, self.loser[node])
                node //= 2
            self.top = up


def front_code(rows: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Common prefix lengths, the rests end to end, and full lengths of sorted strings."""
    common = prefix_lengths(rows, WIDTH)
    return common, b"".join(r[c:] for r, c in zip(rows, common.tolist(), strict=True)), np.fromiter(map(len, rows), np.int64, len(rows))


def front_decode(common: np.ndarray, rest: bytes, size: np.ndarray) -> list[bytes]:
    out, last, at = [], b"", 0
    for c, n in zip(common.tolist(), size.tolist(), strict=True):
        last = last[:c] + rest[at : at + n - c]
        at += n - c
        out.append(last)
    return out


RUN_SCHEMA = "range int, common binary, rest binary, size binary, before binary, before_size binary, low binary, high binary, seed_key binary, around binary"


def encode_segment(where: int, rows: list[tuple]) -> list:
    """One segment of a sorted run; rows: (range, suffix, bytes before reversed, low, high, seed_key, around)."""
    common, rest, size = front_code([r[1] for r in rows])
    pack = lambda k, kind: np.array([r[k] for r in rows], kind).tobytes()
    return [where, common.astype("<u2").tobytes(), rest, size.astype("<u2").tobytes(), b"".join(r[2] for r in rows), np.array([len(r[2]) for r in rows], "<u2").tobytes(), pack(3, "<u2"), pack(4, "<u2"), pack(5, "<i8"), pack(6, "<i8")]


def merge_range(table: pa.Table) -> pa.Table:
    """Merge a range's segments and decide the repeated windows: (seed_key, around, spans of offsets)."""
    width, seed = WIDTH, SEED
    runs, meta, backs = [], [], []
    for batch in table.to_batches(max_chunksize=64):
        for r in batch.to_pylist():
            common, size = np.frombuffer(r["common"], "<u2"), np.frombuffer(r["size"], "<u2")
            runs.append((front_decode(common, r["rest"], size), common.tolist()))
            length = np.frombuffer(r["before_size"], "<u2").astype(np.int64)
            end = np.cumsum(length)
            backs.append([r["before"][a:b] for a, b in zip((end - length).tolist(), end.tolist(), strict=True)])
            meta.append(np.stack([np.frombuffer(r["low"], "<u2").astype(np.int64), np.frombuffer(r["high"], "<u2").astype(np.int64), *[np.frombuffer(r[k], "<i8") for k in ("seed_key", "around")]]))
    run, place, common = [], [], []
    for i, k, c in LoserTree(runs).merge():
        run.append(i)
        place.append(k)
        common.append(c)
    n = len(run)
    begin = np.cumsum([0] + [m.shape[1] for m in meta])
    low, high, seed_key, around = np.concatenate(meta, 1)[:, begin[np.array(run, np.int64)] + np.array(place, np.int64)]
    back = [backs[i][k] for i, k in zip(run, place, strict=True)]
    common = np.array(common, np.int64)
    group = np.cumsum(np.concatenate([[True], common[1:] < seed]) if n else np.zeros(0, bool))
    groups = group.tolist()
    by_back = np.array(sorted(range(n), key=lambda i: (groups[i], back[i])), np.int64)
    common_back = prefix_lengths([back[i] for i in by_back], seed + 1) if n else np.zeros(0, np.int64)
    if n:
        common_back[np.concatenate([[True], group[by_back][1:] != group[by_back][:-1]])] = -1
    together = np.bincount(group, minlength=int(group[-1]) + 1)[group] > 1 if n else np.zeros(0, bool)
    repeated = np.zeros((n, width - seed + 1), bool)
    for d in range(width - seed + 1):
        rows = np.flatnonzero(together & (low <= d) & (d <= high))
        if len(rows) > 1:
            ahead = np.cumsum(common < width - d)
            behind = np.empty(n, np.int64)
            behind[by_back] = np.cumsum(common_back < d)
            key = ahead[rows] * (n + 1) + behind[rows]
            turn = np.argsort(key, kind="stable")
            same = key[turn][1:] == key[turn][:-1]
            hit = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            repeated[rows[turn[hit]], d] = True
    some = np.flatnonzero(repeated.any(1))
    if len(some):  # the places of one surrounding have one verdict
        some = some[np.unique(np.stack([seed_key[some], around[some]]), axis=1, return_index=True)[1]]
    spans = []
    for i in some.tolist():
        a, b = spans_of(repeated[i])
        spans.append(np.stack([a, b - 1], 1).ravel().astype(np.int32).tolist())
    return pa.table({"seed_key": seed_key[some], "around": around[some], "spans": pa.array(spans, pa.list_(pa.int32()))})


def removal_mask(size: int, at: np.ndarray, low: np.ndarray, high: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Bytes covered by the windows that start `low` to `high` bytes before the anchors."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at - high, 1)
    np.add.at(edge, at - low + width, -1)
    return np.cumsum(edge[:size]) > 0


MARK = ("at", "low", "high", "seed_key", "around", "parted")
Coding = Callable[[list[bytes]], list[bytes]]  # what the texts of a batch are compared as; list: as they are


def both_places(kinds: DataFrame, parted: bool) -> DataFrame:
    """Two places of every surrounding (seed_key, around): the first and the last; one place twice where rows repeat."""
    ends = F.when(F.col("number") > 1, F.array("first", "last")).otherwise(F.array("first"))
    return kinds.select("seed_key", "around", F.lit(parted).alias("parted"), F.explode(ends).alias("one")).select("seed_key", "around", "parted", "one.*")


def with_texts(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """text, its marked places, its key and the other columns; of rows that repeat one text stands for all.

    All columns of `keyed` are taken along, though few are needed: the exchange of the texts is then the same one as
    that of the last join, and Spark makes it once."""
    marks = F.collect_list(F.struct(*MARK)).alias("marks")  # the anchors of one text
    first = ["text", "marks", "k1", "k2"]
    return keyed.join(places.groupBy("k1", "k2").agg(marks), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select(*first, *[c for c in keyed.columns if c not in first])


def texts_and_marks(batch: pa.RecordBatch, coding: Coding):
    """(coded text, its marks by field) of every row."""
    marks = batch.column(1)
    flat, bound = [marks.values.field(n).to_numpy(zero_copy_only=False) for n in MARK], marks.offsets.to_numpy()
    for i, text in enumerate(coding(batch.column(0).to_pylist())):
        yield text, [x[bound[i] : bound[i + 1]] for x in flat]


def crowd_windows(keyed: DataFrame, places: DataFrame, coding: Coding) -> DataFrame:
    """w1, w2 (hashes of a window), its place (k1, k2, start), and the surrounding and offset it stands for."""

    def windows(batches):
        for batch in batches:
            k1, k2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for i, (text, marks) in enumerate(texts_and_marks(batch, coding)):
                prefix = prefix_hash(np.frombuffer(text, np.uint8))
                for a in range(0, len(marks[0]), 500):
                    at, low, high, seed_key, around = (x[a : a + 500].astype(np.int64) for x in marks[:5])
                    n = high - low + 1
                    d = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                    start = np.repeat(at, n) - d
                    whole, half = span_hash(prefix, start, start + WIDTH), span_hash(prefix, start, start + WIDTH // 2)
                    columns = [mix(whole).view(np.int64), mix(half * np.uint64(3) + whole).view(np.int64), start.astype(np.int32), d.astype(np.int32), np.repeat(seed_key, n), np.repeat(around, n), np.full(len(d), k1[i]), np.full(len(d), k2[i])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["w1", "w2", "start", "d", "seed_key", "around", "k1", "k2"])

    return with_texts(keyed, places).mapInArrow(lean(windows), "w1 long, w2 long, start int, d int, seed_key long, around long, k1 long, k2 long")


def anchors_of_text(text: bytes, most: int = TEXT_BYTES):
    """(shift, anchors) of a long text, `most` window starts at a time."""
    for a in range(0, max(1, len(text) - WIDTH + 1), most):
        part = text[a : a + most + WIDTH - 1]
        yield a, anchors(*join_texts([part]))


def drawn_strings(keyed: DataFrame, seeds: DataFrame, coding: Coding) -> list[bytes]:
    """The n bytes at `at` of the coded texts, for every row of seeds."""
    drawn = keyed.select("text", "k1", "k2").join(F.broadcast(seeds), ["k1", "k2"])
    if coding is list:
        drawn = drawn.select(F.substring("text", F.col("at") + 1, F.col("n")).alias("s"))
    else:

        def cut(batches):
            for batch in batches:
                rows = zip(coding(batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([t[at : at + n] for t, at, n in rows], pa.binary())], ["s"])

        drawn = drawn.select("text", "at", "n").mapInArrow(lean(cut), "s binary")
    return sorted(bytes(r["s"]) for r in drawn.distinct().collect())


def keyed_rows(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, text (bytes), the columns of `keep` as kept_0, kept_1 and so on, and the row's key (k1, k2)."""
    others = [f"kept_{i}" for i in range(len(keep))]
    bare = small_batches(docs).select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"), *[F.col(c).alias(o) for c, o in zip(keep, others, strict=True)])
    return bare.select("doc_id", "text", *others, F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("k2"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, anchors with repeated windows by document key)."""
    keyed = keyed_rows(docs, id_col, text_col, keep)
    return keyed, repeated_marks(keyed)


def repeated_marks(keyed: DataFrame, coding: Coding = list) -> DataFrame:
    """k1, k2, marks: the anchors with repeated windows, in places of the coded texts."""
    shortest = WIDTH if coding is list else 2 * (WIDTH // CODE) - 1  # words of a byte, a blank between

    def find(batches):
        for batch in batches:
            texts, k1, k2 = coding(batch.column(0).to_pylist()), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for part in text_groups(texts, TEXT_BYTES):
                own = texts[part]
                if len(own) == 1 and len(own[0]) > TEXT_BYTES:
                    found = ((np.zeros(len(got["at"]), np.int64), got["at"] + shift, got) for shift, got in anchors_of_text(own[0]))
                else:
                    buffer, bounds = join_texts(own)
                    got = anchors(buffer, bounds)
                    owner = np.searchsorted(bounds, got["at"], side="right") - 1
                    found = [(owner, got["at"] - bounds[owner], got)]
                for owner, at, got in found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[part][owner]), pa.array(k2[part][owner]), pa.array(at.astype(np.int32)), pa.array(got["low"].astype(np.int16)), pa.array(got["high"].astype(np.int16)), pa.array(got["seed_key"].view(np.int64)), pa.array(got["around"].view(np.int64))],
                        ["k1", "k2", "at", "low", "high", "seed_key", "around"],
                    )

    found = stash(keyed.where(F.length("text") >= shortest).select("text", "k1", "k2").mapInArrow(lean(find), "k1 long, k2 long, at int, low short, high short, seed_key long, around long"), "suffix-anchors")
    twice = stash(found.groupBy("seed_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-seeds", few=True)
    # seeds with a large share of all anchors are few by arithmetic (at most HOT_SEEDS) and are looked up
    # without an exchange, so no task gets all anchors of one seed
    often = max(1, found.count() // HOT_SEEDS)
    hot = twice.where(F.col("n") > often).select("seed_key")
    rare = found.join(F.broadcast(hot), "seed_key", "left_anti").join(twice.where(F.col("n") <= often).select("seed_key"), "seed_key", "left_semi")
    shared = stash(rare.unionByName(found.join(F.broadcast(hot), "seed_key", "left_semi")), "suffix-shared", few=True)
    discard(found, twice)
    place = F.struct("k1", "k2", "at", "low", "high")
    kinds = stash(shared.groupBy("seed_key", "around").agg(F.count(F.lit(1)).alias("number"), F.min(place).alias("first"), F.max(place).alias("last")), "suffix-kinds", few=True)
    crowds = kinds.groupBy("seed_key").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > CROWD).select("seed_key")
    crowded = not crowds.isEmpty()  # such seeds are at most (all kinds) / CROWD
    places, windows = both_places(kinds, False), None
    if crowded:
        windows = stash(crowd_windows(keyed, places.join(crowds, "seed_key", "left_semi"), coding), "suffix-windows")
        spot = F.struct("k1", "k2", F.col("start").alias("at"), F.lit(0).cast("short").alias("low"), F.lit(0).cast("short").alias("high"))
        again = windows.groupBy(F.col("w1").alias("seed_key"), F.col("w2").alias("around")).agg(F.count(F.lit(1)).alias("number"), F.min(spot).alias("first"), F.max(spot).alias("last")).where("number > 1")
        places = stash(places.join(crowds, "seed_key", "left_anti").unionByName(both_places(again, True)), "suffix-places", few=True)
    total = places.count()
    ranges = max(1, -(-total * (WIDTH + SEED) // RANGE_BYTES))
    # a bounded sample of seeds gives the splitters; a seed's suffixes never part, windows of crowded seeds do
    seeds = places.where(F.pmod("around", F.lit(max(1, total // SAMPLE))) == 0).select("k1", "k2", "at", F.when(F.col("parted"), WIDTH).otherwise(SEED).alias("n")).limit(2 * SAMPLE)
    drawn = drawn_strings(keyed, seeds, coding) if ranges > 1 else []
    splitters = sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []
    sent = keyed.sparkSession.sparkContext.broadcast(splitters)

    def sort_run(batches):
        from bisect import bisect_right
        from itertools import groupby

        names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]

        def flush(rows):
            rows.sort(key=lambda r: r[:2])
            out = [encode_segment(where, list(own)) for where, own in groupby(rows, key=lambda r: r[0])]
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *[pa.array([o[k] for o in out], pa.binary()) for k in range(1, len(names))]], names)

        rows, held = [], 0
        for batch in batches:
            for text, marks in texts_and_marks(batch, coding):
                for at, low, high, seed_key, around, parted in zip(*[x.tolist() for x in marks], strict=True):
                    suffix = text[at : at - low + WIDTH]
                    rows.append((bisect_right(sent.value, suffix if parted else suffix[:SEED]), suffix, text[at - high : at][::-1], low, high, seed_key, around))
                    held += len(suffix) + high
                    if held >= RUN_BYTES:
                        yield flush(rows)
                        rows, held = [], 0
        if rows:
            yield flush(rows)

    runs = with_texts(keyed, places).mapInArrow(lean(sort_run), RUN_SCHEMA)
    verdict = runs.groupBy("range").applyInArrow(lean_group(merge_range), "seed_key long, around long, spans array<int>")
    if crowded:
        verdict = stash(verdict, "suffix-verdict", few=True)
        hit = windows.join(verdict.select(F.col("seed_key").alias("w1"), F.col("around").alias("w2")), ["w1", "w2"], "left_semi").groupBy("seed_key", "around").agg(F.sort_array(F.collect_set("d")).alias("d"))  # at most the offsets of one anchor
        verdict = verdict.unionByName(hit.select("seed_key", "around", F.flatten(F.transform("d", lambda x: F.array(x, x))).alias("spans")))
    marked = shared.select("k1", "k2", "at", "seed_key", "around").join(verdict, ["seed_key", "around"]).select("k1", "k2", "at", "spans")
    return marked.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "spans")).alias("marks"))  # the anchors of one text, whatever rows repeat it


def kept_text(text: bytes, gone: np.ndarray) -> str:
    """What is left of a text; every kept run is decoded by itself, so a character that lost a byte goes whole."""
    a, b = spans_of(~gone)
    return "".join(text[x:y].decode("utf-8", "ignore") for x, y in zip(a.tolist(), b.tolist(), strict=True))


def mask_of_marks(size: int, marks: pa.ListScalar) -> np.ndarray:
    """Places of a coded text that go by its marks; none without marks."""
    if not marks.is_valid or not len(marks.values):
        return np.zeros(size, bool)
    at, spans = marks.values.field("at").to_numpy().astype(np.int64), marks.values.field("spans")
    own = spans.flatten().to_numpy().reshape(-1, 2).astype(np.int64)
    return removal_mask(size, np.repeat(at, spans.value_lengths().to_numpy() // 2), own[:, 0], own[:, 1])


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, keep: tuple[str, ...] = (), passages: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and the columns of `keep`.

    with_text adds kept: the remaining text, where a character that lost a byte goes whole.
    passages: runs of WIDTH / CODE words that also start anywhere else go too."""
    keyed = keyed_rows(docs, id_col, text_col, keep)
    others = [f"kept_{i}" for i in range(len(keep))]
    joined, found = keyed.join(repeated_marks(keyed), ["k1", "k2"], "left"), ["marks"]
    if passages:
        joined, found = joined.join(repeated_marks(keyed, word_codes).withColumnRenamed("marks", "word_marks"), ["k1", "k2"], "left"), ["marks", "word_marks"]
    joined = joined.select("doc_id", "text", *found, *others)

    def cut(batches):
        for batch in batches:
            texts, marks = batch.column(1).to_pylist(), [batch.column(2 + k) for k in range(len(found))]
            removed, runs = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            sha, kept = [], []
            for i, text in enumerate(texts):
                if not any(m[i].is_valid for m in marks):
                    sha.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        kept.append(text.decode("utf-8", "ignore"))
                    continue
                gone = mask_of_marks(len(text), marks[0][i])
                if passages and marks[1][i].is_valid:
                    gone |= words_gone(text, lambda size, own=marks[1][i]: mask_of_marks(size, own))
                removed[i], runs[i] = gone.sum(), len(spans_of(gone)[0])
                sha.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest())
                if with_text:
                    kept.append(kept_text(text, gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(removed), pa.array(runs), pa.array(sha, pa.string()), *([pa.array(kept, pa.string())] if with_text else []), *batch.columns[2 + len(found) :]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []), *others],
            )

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    kinds = {"doc_id": keyed.schema["doc_id"].dataType.simpleString(), "kept_sha256": "string", "kept": "string"} | {o: keyed.schema[o].dataType.simpleString() for o in others}
    out = joined.mapInArrow(lean(cut), ", ".join(f"{n} {kinds.get(n, 'long')}" for n in [*names, *others]))
    return out.select(*names, *[F.col(o).alias(c) for c, o in zip(keep, others, strict=True)])


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, s, md5(substr(h, 2 * s + 1, 800)) AS k FROM (SELECT r, h, unnest(range(length(h) // 2 - 399)) AS s FROM d WHERE length(h) >= 800)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
gone AS (SELECT r, s, CASE WHEN s > lag(s) OVER (PARTITION BY r ORDER BY s) + 400 THEN 1 ELSE 0 END AS opens FROM w SEMI JOIN twice USING (k)),
runs AS (SELECT r, run, min(s) AS a, max(s) + 400 AS b FROM (SELECT r, s, sum(opens) OVER (PARTITION BY r ORDER BY s) AS run FROM gone) GROUP BY r, run),
cuts AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS after FROM runs),
kept AS (
  SELECT d.r, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS head
  FROM cuts JOIN d ON d.r = cuts.r GROUP BY d.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""
