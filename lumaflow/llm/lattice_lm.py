"""Subword lattice likelihood: the marginal probability of a text over all its segmentations.

A text is lower-cased (A-Z) and split into words; a word is a blank and its UTF-8 bytes, and an end symbol closes
the text. The lattice of a word has two kinds of arcs: the pieces (and bytes) of an existing vocabulary, and, for a
word that training has seen, one arc over the whole word. Pieces never hold a blank but at their start, so a
text's lattice factors by words. A word's probability is summed over all its segmentations,
  P(w) = (c - d) / N + (d V / N) * S(w),
where c counts the word in training, N all training tokens, V the distinct words, d is the absolute discount
n1 / (n1 + 2 n2) from the words seen once and twice, and S sums over all segmentations into pieces, by a forward
recursion in log space over all words of one length at once. S is made to sum to 1 over all words, and so does
the model over all texts.

The vocabulary at hand is a byte-pair one: its scores are merge orders, not probabilities. Piece weights therefore
start from that order (the order's inverse) and are estimated on the training words by expectation steps
(forward-backward over the lattices of all distinct words).

Documents are gone through in blocks where they lie: a block's texts become numbers into its own word list. Word
counts are shuffled by word, each block's words get their counts and scores back, and meet the numbers by block. Texts
are never exchanged, nothing that grows with the corpus is broadcast; the piece table (32,000 rows) is.

Defined results: null and empty texts are the end symbol alone; words and texts of any length are scored
whole; repeated rows are counted and scored each; without training rows all counts are 0, and words have the
probability of their pieces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaflow.llm.common import crc_bucket, lean, regrouped, small_batches, stash, text_bytes

BLOCK_BYTES, PORTION = 24 << 20, 4 << 20
LONG_WORD = 64
WORDS_AT_ONCE = 50_000
ROUNDS = 2
BLANK_BYTE = re.compile(rb"[ \t\n\r\f\v]")


def log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(exp(a) + exp(b)) where b is finite."""
    return np.maximum(a, b) + np.log1p(np.exp(-np.abs(a - b)))


class Pieces:
    """Byte strings of a vocabulary with log weights, found by hash. The last row is the end symbol."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        found: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i):
                continue
            piece = model.id_to_piece(i)
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece) if model.is_byte(i) else None
            raw = bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode("utf-8")
            if raw and b" " not in raw[1:]:
                order = -model.get_score(i) if not byte else model.get_piece_size()
                found[raw] = max(found.get(raw, -1e9), -math.log(order + 3.0))
        found.setdefault(b" ", -math.log(model.get_piece_size()))
        self.raw = sorted(found)
        self.log = np.array([found[x] for x in self.raw] + [0.0])
        self.log -= np.logaddexp.reduce(self.log)
        self.longest = max(map(len, self.raw))
        self.by_raw = {x: i for i, x in enumerate(self.raw)}
        self.opens = np.array([x.startswith(b" ") for x in self.raw] + [False])
        self._trie()

    def _trie(self) -> None:
        """States are prefixes of pieces (0: the empty one); moves (state, byte) lie in an open hash table."""
        moves: dict[int, int] = {}
        row = [-1]
        for i, raw in enumerate(self.raw):
            state = 0
            for byte in raw:
                key = state << 8 | byte
                if key not in moves:
                    moves[key] = len(row)
                    row.append(-1)
                state = moves[key]
            row[state] = i
        self.piece_of = np.array(row, np.int64)
        self.bits = len(moves).bit_length() + 2
        size = 1 << self.bits
        self.slot_key, self.slot_state = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        keys, states = np.fromiter(moves, np.int64, len(moves)), np.fromiter(moves.values(), np.int64, len(moves))
        at = self._slot(keys)
        while len(keys):  # the first of the keys that want a slot gets it if it is free, the others go on
            free = self.slot_key[at] < 0
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(len(at), bool)
            wins[first] = True
            wins &= free
            self.slot_key[at[wins]], self.slot_state[at[wins]] = keys[wins], states[wins]
            keys, states, at = keys[~wins], states[~wins], (at[~wins] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states, -1 where no piece goes on."""
        key = state << 8 | byte
        at = self._slot(key)
        found = self.slot_key[at]
        out = np.where(found == key, self.slot_state[at], -1)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.slot_state[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def arcs(self, byte: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, pieces) for words of one width as rows of bytes, by start."""
        n, width = byte.shape
        column = [np.ascontiguousarray(byte[:, i]) for i in range(width)]
        out = []
        for j in range(width):
            words, state = np.arange(n), np.zeros(n, np.int64)
            for i in range(j, min(width, j + self.longest)):
                state = self.step(state, column[i][words])
                on = state >= 0
                if not on.all():
                    words, state = words[on], state[on]
                if not len(words):
                    break
                piece = self.piece_of[state]
                is_piece = piece >= 0
                if is_piece.any():
                    out.append((j, i + 1, words[is_piece], piece[is_piece]))
        return out

    def forward(self, arcs: list, n: int, width: int, log: np.ndarray) -> np.ndarray:
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0
        for j, i, words, piece in arcs:
            alpha[i, words] = log_add(alpha[i, words], alpha[j, words] + log[piece])
        return alpha

    def expected(self, arcs: list, alpha: np.ndarray, log: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in `count` copies of the words."""
        beta = np.full(alpha.shape, -np.inf)
        beta[-1] = np.log(count) - alpha[-1]
        used = np.zeros(len(log))
        for j, i, words, piece in reversed(arcs):
            after = beta[i, words] + log[piece]
            used += np.bincount(piece, np.exp(alpha[j, words] + after), len(log))
            beta[j, words] = log_add(beta[j, words], after)
        return used

    def long_word(self, word: bytes, log: np.ndarray, used: np.ndarray | None = None, count: float = 0.0) -> float:
        """The same for one word of any length, byte by byte."""
        most, n = self.longest, len(word)
        alpha, arcs = np.full(n + 1, -np.inf), []
        alpha[0] = 0
        for i in range(1, n + 1):
            own = [(k, r) for k in range(1, min(i, most) + 1) if (r := self.by_raw.get(word[i - k : i])) is not None]
            arcs.append(own)
            alpha[i] = np.logaddexp.reduce([alpha[i - k] + log[r] for k, r in own])
        if used is not None:
            beta = np.full(n + 1, -np.inf)
            beta[n] = 0
            for i in range(n, 0, -1):
                for k, r in arcs[i - 1]:
                    beta[i - k] = np.logaddexp(beta[i - k], beta[i] + log[r])
                    used[r] += math.exp(alpha[i - k] + log[r] + beta[i] - alpha[n]) * count
        return float(alpha[n])

    def words(self, words: list[bytes], log: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of words (a blank goes before each), and expected uses of pieces for `count`."""
        out, used = np.zeros(len(words)), np.zeros(len(log))
        size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = self.long_word(b" " + words[i], log, used if count is not None else None, 0.0 if count is None else float(count[i]))
        if not len(words):
            return out, used
        buffer = np.frombuffer(b" " + b" ".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(size) - size
        for width in np.unique(size[size <= LONG_WORD]).tolist():
            all_rows = np.flatnonzero(size == width)
            for rows in np.array_split(all_rows, -(-len(all_rows) // 4096)):  # stays in the processor's cache
                arcs = self.arcs(buffer[start[rows][:, None] + np.arange(width)])
                alpha = self.forward(arcs, len(rows), width, log)
                out[rows] = alpha[width]
                if count is not None:
                    used += self.expected(arcs, alpha, log, count[rows])
        return out, used


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def split_words(text: bytes, portion: int = PORTION) -> Iterator[list[bytes]]:
    """Runs of bytes but blank and 9 to 13, A-Z lower-cased; of long texts portion by portion, cut between words."""
    a = 0
    while a < len(text):
        b = a + portion
        if b < len(text):
            gap = BLANK_BYTE.search(text, b)
            b = gap.start() if gap else len(text)
        yield text[a:b].lower().split()
        a = b


def word_shift(own: Pieces, log: np.ndarray) -> float:
    """What makes piece products sum to 1 over all words: a word's first piece opens with a blank, and it ends where
    the next piece does so too or the text ends."""
    opening = np.logaddexp.reduce(log[own.opens])
    return float(np.logaddexp(opening, log[-1]) - opening)


def fit_pieces(counts: DataFrame, n_docs: int, model_path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights by piece after expectation steps over the distinct training words (word, count): pieces spell what
    was not seen, and new words are like the distinct ones, not like the frequent ones."""
    log = pieces(model_path).log
    spark = counts.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(log)

        def expect(batches):
            own = pieces(model_path)
            total = np.zeros(len(sent.value))
            for batch in regrouped(batches, WORDS_AT_ONCE):
                total += own.words(batch.column(0).to_pylist(), sent.value, np.ones(batch.num_rows))[1]
            row = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(total[row])], ["piece", "used"])

        used = np.full(len(log), 0.05)
        got = counts.where("count > 0").select("word", "count").mapInArrow(lean(expect), "piece long, used double").groupBy("piece").agg(F.sum("used").alias("used")).toArrow()
        used[got["piece"].to_numpy()] += got["used"].to_numpy()
        used[-1] += n_docs
        log = np.log(used) - np.log(used.sum())
    return log


def pack_places(places: np.ndarray) -> bytes:
    """Places by byte planes, lowest first: frequent words have low places, so the high planes compress well."""
    return places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_places(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def numbered(docs: DataFrame, held_out_modulus: int) -> DataFrame:
    """Blocks of documents as numbers: rows of words (block, place, word, count in training) and rows of documents
    (block, doc_id, held_out, packed places of its words)."""
    held = crc_bucket("doc_id", held_out_modulus) == 0
    narrow = small_batches(docs).select("doc_id", held.alias("held_out"), text_bytes("text").alias("text"))
    names = ["block", "doc_id", "held_out", "places", "place", "word", "count"]
    kind = narrow.schema["doc_id"].dataType

    def run(batches):
        block, place, counts, size = TaskContext.get().partitionId() << 32, {}, np.zeros(1 << 16, np.int64), 0

        def words():
            n = len(place)
            nothing = [pa.nulls(n, t) for t in types]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *nothing, pa.array(np.arange(n, dtype=np.int32)), pa.array(list(place), pa.binary()), pa.array(counts[:n])], names)

        for batch in batches:
            types = [batch.column(0).type, pa.bool_(), pa.binary()]
            out = []
            for held, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = []
                for own in split_words(text):
                    for word in set(own).difference(place):
                        place[word] = len(place)
                    parts.append(np.fromiter(map(place.__getitem__, own), np.int32, len(own)))
                    if not held:
                        if len(counts) < len(place):
                            counts = np.concatenate([counts, np.zeros(len(place), np.int64)])
                        np.add.at(counts, parts[-1], 1)
                out.append(pack_places(np.concatenate(parts) if parts else np.zeros(0, np.int32)))
                size += len(text)
            if len(counts) < len(place):
                counts = np.concatenate([counts, np.zeros(len(place), np.int64)])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names)
            if size >= BLOCK_BYTES:
                yield words()
                block, place, counts, size = block + 1, {}, np.zeros(1 << 16, np.int64), 0
        if place:
            yield words()

    return narrow.mapInArrow(lean(run), f"block long, doc_id {kind.simpleString()}, held_out boolean, places binary, place int, word binary, count long")


def lattice_scores(docs: DataFrame, model_path: str, held_out_modulus: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    blocks = stash(numbered(docs, held_out_modulus), "lm-blocks")
    local, rows = blocks.where("word is not null"), blocks.where("word is null")
    counts = stash(local.groupBy("word").agg(F.sum("count").alias("count")), "lm-words")
    n_docs = rows.where("not held_out").count()
    totals = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), *[F.count_if(F.col("count") >= k).alias(f"v{k}") for k in (1, 2, 3)]).first()
    n_tokens, distinct, once, two = totals["n"] + n_docs, totals["v1"], totals["v1"] - totals["v2"], totals["v2"] - totals["v3"]
    discount = once / (once + 2 * two) if once and two else 0.5
    fitted = fit_pieces(counts, n_docs, model_path, rounds)
    shift = word_shift(pieces(model_path), fitted)
    sent = spark.sparkContext.broadcast(fitted)
    unseen = math.log(discount * distinct / n_tokens) if distinct else math.log1p(-n_docs / (n_tokens + 1))

    def score_words(batches):
        for batch in regrouped(batches, WORDS_AT_ONCE):
            log = pieces(model_path).words(batch.column(0).to_pylist(), sent.value)[0] + shift + unseen
            count = batch.column(1).to_numpy()
            seen = count > 0
            log[seen] = np.logaddexp(log[seen], np.log((count[seen] - discount) / max(n_tokens, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log / math.log(10))], ["word", "count", "log10"])

    table = counts.select("word", "count").mapInArrow(lean(score_words), "word binary, count long, log10 double")
    known = local.select("block", "place", "word").join(table, "word").select(F.col("block").alias("block_of"), "place", F.col("count").alias("n"), "log10")
    floor = math.log10(n_tokens + 0.1 * (distinct + (n_docs > 0) + 1))
    end = math.log10((n_docs or 1) / (n_tokens or 1))

    def score(key, texts, words):
        order = np.argsort(words["place"].to_numpy())
        count = words["n"].to_numpy()[order]
        base, model = np.log10(count + 0.1) - floor, words["log10"].to_numpy()[order]
        out = [np.zeros(texts.num_rows, kind) for kind in (np.int64, np.int64, float, float)]
        for i, raw in enumerate(texts["places"]):
            own = unpack_places(raw.as_buffer())
            out[0][i], out[1][i] = len(own) + 1, np.count_nonzero(count[own]) + (n_docs > 0)
            out[2][i], out[3][i] = base[own].sum() + math.log10(n_docs + 0.1) - floor, model[own].sum() + end
        return pa.table({"doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": out[0], "n_known": out[1], "train_tokens": np.full(texts.num_rows, n_tokens, np.int64), "base_score": out[2], "score": out[3]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("block", "doc_id", "held_out", "places").groupBy("block").cogroup(known.groupBy("block_of")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
