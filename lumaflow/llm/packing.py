"""Best-fit packing by exact-complement hashing over the histogram of piece lengths.

Only the counts by length (at most `capacity` entries, however large the corpus) reach the driver.
An index by sum leads to the lengths, pairs of lengths and triples of lengths that make it exactly;
counts only fall, so an entry that ran out is passed for good. The plan opens a sequence with the
longest length left and looks its gap up in the index; an exact filling is consumed as often as all
its counts allow, so the plan has few entries, each with a multiplicity. A gap without an exact filling
takes the longest length that fits (best fit) and is looked up again. The k-th piece of a length
goes to the k-th place of that length in the plan; ranks come from two levels of prefix sums over
buckets, so no task sorts more than a bucket or a thousand bucket totals.

Defined results: null and empty texts are the end id alone (one piece of length 1); texts of any
length are cut into full pieces and a rest; repeated rows are packed each (identical pieces are
interchangeable); an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumaflow.llm.common import lean, running_total, small_batches, stash, text_bytes, worker_cache
from lumaflow.llm.rolling import LOWER
from lumaflow.llm.token_counts import text_groups

CAPACITY = 2048
CACHE_ENTRIES = 400_000  # of words, and half as many of letters: about 120 MB in a worker at most
LETTERS_BELOW = "\u0500"  # letters under this code point are letters in every Unicode version in use
BUCKET_ROWS = 500


def _plain_letters() -> np.ndarray:
    """By code point: letters that are still letters, and nothing else, in lower case (\u0130 yields a letter and a mark)."""
    return np.array([chr(c).isalpha() and chr(c).lower().isalpha() for c in range(ord(LETTERS_BELOW))])


class WordEncoder:
    """Ids of whole texts as little-endian 32-bit bytes. The tokenizer drops white space and never joins
    words across it, so each distinct ASCII-blank-separated word is encoded once; a word that is letters
    and at most one mark after them is the ids of the lower-cased letters and those of the mark. Words of
    letters are given to the library many at a time: the last id of each is one that ends a word."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = worker_cache("packing")
        self.parts: dict[bytes, bytes] = worker_cache("packing")
        self.letter = _plain_letters()
        self.ascii = np.zeros(256, bool)
        self.ascii[:128] = self.letter[:128]
        self.marks = [self._one(mark) for mark in ("", ".", ",")]

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, words: list[bytes]) -> None:
        """Fill in words of letters."""
        for k in range(0, len(words), 400):
            own = words[k : k + 400]
            ids = np.array(self.tokenizer.encode(b" ".join(own).decode(), add_special_tokens=False).ids, "<u4")
            stop = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            if len(stop) == len(own):
                self.parts.update(zip(own, (raw[x:y] for x, y in zip([0, *stop[:-1]], stop, strict=True)), strict=True))
            else:
                self.parts.update((w, self._one(w.decode())) for w in own)

    def _split(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Which words are letters and at most one mark, those words' marks, and their letters in lower case (of ASCII
        letters; the library does the others). All words are looked at together, as one array of bytes."""
        byte = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        end = np.flatnonzero(byte == 32)
        start = np.concatenate([[0], end[:-1] + 1])
        good = self.ascii[byte]
        lead = np.flatnonzero((byte >= 0xC3) & (byte < (0xC0 | (len(self.letter) >> 6))))  # of two bytes
        pair = lead[((byte[lead + 1] & 0xC0) == 0x80) & self.letter[((byte[lead] & 31).astype(np.int64) << 6) | (byte[lead + 1] & 63)]]
        good[pair] = good[pair + 1] = True
        last = byte[end - 1]
        mark = np.where(last == ord("."), 1, np.where(last == ord(","), 2, 0))
        letters = np.add.reduceat(good, start, dtype=np.int64)
        plain = (letters == end - start - (mark > 0)) & (letters > 0)
        keep = np.repeat(plain, end - start + 1)
        keep[(end - 1)[mark > 0]] = False
        return plain, mark[plain], LOWER[byte[keep]].tobytes().split(b" ")[:-1]

    def _fill(self, missing: list[bytes]) -> None:
        plain, mark, letters = self._split(missing)
        self._letters(list(set(letters).difference(self.parts)))
        parts, marks = self.parts, self.marks
        self.cache.update(zip(compress(missing, plain), [parts[x] + marks[y] for x, y in zip(letters, mark.tolist(), strict=True)], strict=True))
        odd = list(compress(missing, ~plain))
        made = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False)
        self.cache.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(odd, made, strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        rows = [t.split() for t in texts]
        words = set()
        for row in rows:
            words.update(row)
        missing = list(words.difference(self.cache))
        if len(self.cache) + len(missing) > CACHE_ENTRIES:  # what these texts use stays, frequent words among it
            stay = {w: self.cache[w] for w in words.difference(missing)}
            self.cache.clear()
            self.cache.update(stay)
        if len(self.parts) > CACHE_ENTRIES // 2:
            self.parts.clear()
        for k in range(0, len(missing), 50_000):
            self._fill(missing[k : k + 50_000])
        get = self.cache.__getitem__
        return [b"".join(map(get, row)) for row in rows]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordEncoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as bytes) of every piece; no shuffle."""
    narrow = small_batches(docs).select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    tail, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches):
        own = encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in text_groups(texts, 4 << 20):
                at, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(own.encode(texts[part]), part.start):
                    raw += tail
                    for k in range(0, len(raw), width):
                        cut = raw[k : k + width]
                        at.append(i)
                        piece.append(k // width)
                        start.append(k // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(cut)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else [])],
                    ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])],
                )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(lean(run, "packing"), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class ComplementIndex:
    """Lengths, pairs and triples of lengths by their sum, over counts that only fall.

    A sum's entries are kept in one order (the longest length first) and entered at a mark; what is found
    to have run out lies before the mark and is never looked at again, so a sum's entries are gone
    through once, however many gaps are looked up."""

    def __init__(self, free: np.ndarray):
        self.free = free
        self.pair_mark: dict[int, int] = {}
        self.triple_mark: dict[int, int] = {}

    def _pair(self, total: int, beside: int = 0) -> tuple[int, int] | None:
        """The first pair of a sum that is available; `beside` is a length that is taken once already."""
        free = self.free
        x = self.pair_mark.get(total)
        if x is None:
            x = min(total - 1, len(free) - 1)
        passed = True  # so far all entries have run out for good
        while 2 * x >= total:
            y = total - x
            if free[x] and free[y] > (x == y):
                if free[x] >= 1 + (x == y) + (x == beside) and free[y] >= 1 + (x == y) + (y == beside):
                    break
                passed = False
            x -= 1
            if passed:
                self.pair_mark[total] = x
        return (x, total - x) if 2 * x >= total else None

    def fill(self, gap: int) -> list[int] | None:
        """One, two or three available lengths that sum to gap; None if there are none."""
        free = self.free
        if gap <= 0:
            return None
        if gap < len(free) and free[gap]:
            return [gap]
        pair = self._pair(gap)
        if pair:
            return list(pair)
        x = self.triple_mark.get(gap)
        if x is None:
            x = min(gap - 2, len(free) - 1)
        while 3 * x >= gap:
            if free[x]:
                pair = self._pair(gap - x, x)
                if pair:
                    break
            x -= 1
        self.triple_mark[gap] = x
        return [x, *pair] if 3 * x >= gap else None


def exact_fill(gap: int, free: np.ndarray) -> list[int] | None:
    """One, two or three available lengths that sum to gap; None if there are none."""
    return ComplementIndex(free).fill(gap)


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Sequences as (lengths, multiplicity), for counts by length."""
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] += n
    index, plan, top = ComplementIndex(free), [], capacity
    while True:
        while top > 0 and not free[top]:
            top -= 1
        if top == 0:
            return plan
        filled, gap = [top], capacity - top
        free[top] -= 1
        while gap:
            exact = index.fill(gap)
            if exact is None:
                fits = np.flatnonzero(free[: gap + 1])
                if not len(fits):
                    break
                exact = [int(fits[-1])]
            for x in exact:
                free[x] -= 1
            filled += exact
            gap -= sum(exact)
        lengths, need = np.unique(filled, return_counts=True)
        more = int((free[lengths] // need).min())
        free[lengths] -= more * need
        plan.append((filled, more + 1))


def plan_places(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Runs of places by length: the ranks [from, from + n) of a length go to sequences base + (rank - from) at an offset."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in plan:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), base, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "from", "base", "offset"), table.T, strict=True))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces."""
    spark = pieces.sparkSession
    total = pieces.count()
    buckets = max(1, total // BUCKET_ROWS)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counted = stash(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "pack-counts", few=True)
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = plan_places(pack_plan(histogram, capacity))
    sent = spark.sparkContext.broadcast(places)
    base = running_total(counted, ["length"], "bucket", "n", "base").select("length", "bucket", "base")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("inside", F.row_number().over(inside) - 1).join(base, ["length", "bucket"])
    names = [f.name for f in pieces.schema.fields]
    ready = ranked.select(*names, (F.col("base") + F.col("inside")).alias("rank_in_length"))

    def place(batches):
        p = sent.value
        key = p["length"] << 40 | p["from"]
        for batch in batches:
            length, rank = batch.column(names.index("length")).to_numpy(), batch.column(len(names)).to_numpy()
            at = np.searchsorted(key, length << 40 | rank, side="right") - 1
            sequence = p["base"][at] + rank - p["from"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(p["offset"][at])], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ready.mapInArrow(lean(place), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack_pieces(stash(token_pieces(docs, tokenizer_path, capacity, end_id), "pack-pieces", few=True), capacity)
