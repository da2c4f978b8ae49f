"""Byte-level BPE token counts by rank-synchronous array merging.

Pre-tokens of a batch lie end to end in one flat id array. Every round finds each sequence's
lowest-rank adjacent pair (one segmented minimum), merges all its non-overlapping occurrences in
all sequences at once and looks up only the pairs next to a merge again. A sequence without a
mergeable pair leaves the arrays; its surviving symbols are its count.

Texts are cut before runs of ASCII white space (a sure pre-token boundary), so counts of repeated
chunks come from a bounded cache. A text with other white space is handled as one chunk.

Defined results: null and empty texts count 0; a text of any length is counted whole; repeated
rows are counted each; special strings inside a text are one token, as in the library's default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaflow.llm.common import lean, small_batches, text_bytes, worker_cache

# The pre-token pattern of byte-level BPE.
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CHUNK = re.compile(rb"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CACHE_ENTRIES = 400_000
NONE = np.int64(1) << 40


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary, by the published rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankMerger:
    """Merge table of a tokenizers BPE file, with symbols renumbered: bytes first, then merge results by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = dict(_byte_symbols())
        left, right, new = [], [], []
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = symbol.setdefault(a + b, len(symbol))
            left.append(symbol[a])
            right.append(symbol[b])
            new.append(made)
        self.new = np.array(new, np.int64)
        keys = (np.array(left, np.int64) << 20) | np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.first = np.full((256, 256), NONE, np.int64)
        small = (np.array(left) < 256) & (np.array(right) < 256)
        self.first[np.array(left)[small], np.array(right)[small]] = np.flatnonzero(small)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each byte sequence after all merges."""
        out = np.zeros(len(sequences), np.int64)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        ids = np.frombuffer(b"".join(sequences), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(sequences)), lengths)
        if not len(ids):
            return out
        ranks = np.full(len(ids), NONE, np.int64)
        ranks[:-1] = np.where(owner[1:] == owner[:-1], self.first[ids[:-1], ids[1:]], NONE)
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[starts, len(ids)])
            lowest = np.minimum.reduceat(ranks, starts)
            done = lowest == NONE
            out[owner[starts[done]]] = size[done]
            hit = (ranks == np.repeat(lowest, size)) & (ranks != NONE)
            where = np.flatnonzero(hit)
            if not len(where):
                break
            # of touching hits (one pair over and over) every other one merges, from the left
            new_run = np.r_[True, np.diff(where) > 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run_start) % 2 == 0]
            ids[where] = self.new[ranks[where]]
            stay = ~np.repeat(done, size)
            stay[where + 1] = False
            changed = np.zeros(len(ids), bool)
            changed[where] = True
            ids, owner, ranks, changed = ids[stay], owner[stay], ranks[stay], changed[stay]
            again = changed.copy()
            again[:-1] |= changed[1:]
            at = np.flatnonzero(again)
            last = at == len(ids) - 1
            ranks[at[last]] = NONE
            at = at[~last]
            same = owner[at] == owner[at + 1]
            ranks[at] = NONE
            at = at[same]
            ranks[at] = self.rank(ids[at], ids[at + 1])
        return out


class TokenCounter:
    """Counts whole texts; chunk counts are kept in a cache of bounded size."""

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.cache: dict[bytes, int] = worker_cache("token_counts")

    def _fill(self, chunks: list[bytes]) -> dict[bytes, int]:
        parts: list[bytes] = []
        owner: list[int] = []
        base = np.zeros(len(chunks), np.int64)
        split = self.merger.special_pattern
        for i, chunk in enumerate(chunks):
            text = chunk.decode("utf-8", "replace")
            pieces = split.split(text) if split and any(s in text for s in self.merger.special) else [text]
            for j, piece in enumerate(pieces):
                if j % 2:
                    base[i] += 1
                    continue
                for token in PRE_TOKEN.findall(piece):
                    parts.append(token.encode("utf-8"))
                    owner.append(i)
        if parts:
            base += np.bincount(np.array(owner), self.merger.counts(parts), len(chunks)).astype(np.int64)
        return dict(zip(chunks, base.tolist(), strict=True))

    def count(self, texts: list[bytes]) -> list[int]:
        rows = []
        for text in texts:
            plain = text.isascii() or not WIDE_SPACE.search(text.decode("utf-8", "replace"))
            rows.append(CHUNK.findall(text) if plain else [text])
        cache, chunks = self.cache, set()
        for row in rows:
            chunks.update(row)
        missing = list(chunks.difference(cache))
        if len(cache) + len(missing) > CACHE_ENTRIES:  # what these texts use stays, frequent chunks among it
            stay = {c: cache[c] for c in chunks.difference(missing)}
            cache.clear()
            cache |= stay
        extra: dict[bytes, int] = {}
        for k in range(0, len(missing), 50_000):
            extra |= self._fill(missing[k : k + 50_000])
        cache |= extra
        get = cache.__getitem__
        return [sum(map(get, row)) for row in rows]


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def text_groups(texts: list[bytes], most: int) -> Iterator[slice]:
    """Slices of a batch that hold about `most` bytes each (one text may hold more)."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). No shuffle."""
    narrow = small_batches(docs).select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))

    def run(batches):
        own = counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [c for part in text_groups(texts, 4 << 20) for c in own.count(texts[part])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([c > limit for c in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(lean(run, "token_counts"), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
