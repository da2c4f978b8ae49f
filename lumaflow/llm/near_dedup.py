"""Near-duplicate classes by Order MinHash over five-word shingles, verified by banded alignment.

Every distinct text's shingles are labelled with their occurrence number. Each of 20 sketches takes
the 3 labelled shingles of least hash and keeps them in text order, so equal sketches ask for equal
order as well as equal content. Texts that share a sketch meet in a bucket, and every two texts of a
bucket whose numbers of shingles allow 0.8 are compared in full, by one rule whatever the bucket's
size: labelled shingles are unique in a text, so the alignment is the longest increasing chain of matched
positions, kept inside the band that the threshold allows; similarity is matched / (n + m - matched),
and 0.8 or more is a link.

The shingles of all texts that met another are written once. Buckets of up to SMALL rows send their
pairs on, so a pair that meets in many buckets is compared once. A larger bucket is compared in place, by a
search over its links: a text that is reached looks for links to the texts not reached yet (postings of
shared shingles give exact overlaps, an upper bound of the alignment), so close copies cost a pass
each and not a pass for every two. Buckets over CHUNK_BYTES are cut into chunks, and every two chunks meet
in a task. Links connect into classes by distributed label propagation.

Defined results: exact copies (equal word sequences) are one text; texts of one to four words have
the whole word sequence as their one shingle; texts without words, null included, are each their
own class; repeated rows are copies; ids may be null or repeated (rows are keyed by hashes of id and
text); a null id may be a class's id only if all its ids are null.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaflow.llm.common import discard, lean, lean_group, small_batches, stash, text_bytes
from lumaflow.llm.rolling import BLANK, hashed_words, mix
from lumaflow.llm.token_counts import text_groups

WORDS, SIMILARITY = 5, 0.8
SKETCHES, ORDERED = 20, 3
SMALL, CHUNK_BYTES = 8, 8 << 20
_SEED = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def labelled_shingles(word: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hashes of a text's shingles, each with its occurrence number: unique within the text."""
    if not len(word):
        return word
    n = min(n, len(word))
    out = np.zeros(len(word) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + word[k : len(word) - n + 1 + k])
    order = np.argsort(out, kind="stable")
    same = np.concatenate([[False], out[order][1:] == out[order][:-1]])
    if same.any():
        at = np.arange(len(out))
        label = at - np.maximum.accumulate(np.where(same, 0, at))
        out[order] = np.where(label > 0, mix(out[order] + label.astype(np.uint64)), out[order])
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Order MinHash keys."""
    keys = np.zeros(SKETCHES, np.uint64)
    take, n = min(ORDERED, len(shingles)), len(shingles)
    together = SKETCHES if n < 50_000 else 1  # bounds the memory of very long texts
    for s in range(0, SKETCHES, together):
        h = mix(shingles[None] ^ _SEED[s : s + together, None])
        least = np.argpartition(h, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(h), 1))
        least.sort(axis=1)
        key = np.arange(s + 1, s + 1 + len(h), dtype=np.uint64)
        for x in shingles[least].T:
            key = key * np.uint64(0x9E3779B97F4A7C15) + x
        keys[s : s + together] = key
    return mix(keys)


@lru_cache
def _share(least: float) -> tuple[int, int]:
    """The threshold as it is written in decimals, as a whole numerator and denominator: no rounding at the threshold itself."""
    return Fraction(str(least)).as_integer_ratio()


def alignment_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Matched share of two labelled shingle sequences; 0 as soon as `least` is out of reach."""
    n, m = len(a), len(b)
    p, q = _share(least)
    if q * min(n, m) < p * max(n, m):
        return 0.0
    if n == m and (a == b).all():
        return 1.0
    need = -(-p * (n + m) // (p + q))  # the least whole number matched with matched / (n + m - matched) >= p / q
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), m - 1)
    position = order[at]
    i = np.flatnonzero(b[position] == a)
    if len(i) < need:
        return 0.0
    j = position[i]
    band = n + m - 2 * need  # more shingles unmatched on the way than this cannot reach `least`
    j = j[np.abs(i - j) <= band]
    tails: list[int] = []
    for x in j.tolist():
        if not tails or x > tails[-1]:
            tails.append(x)
        else:
            tails[bisect_left(tails, x)] = x
    matched = len(tails)
    return matched / (n + m - matched) if matched >= need else 0.0


def row_keys(docs: DataFrame) -> DataFrame:
    """Adds two hashes of id and text, which may be null or repeated on their own."""
    return docs.select("*", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("k2"))


def text_key(text: bytes) -> bytes:
    """One key for all texts of one word sequence."""
    return hashlib.md5(b" ".join(text.lower().split())).digest()


def each_shingled(texts: list[bytes]):
    """(place, labelled shingles) of every text."""
    for part in text_groups(texts, 1 << 20):
        word, owner = hashed_words(texts[part], BLANK_WORDS)
        cut = np.searchsorted(owner, np.arange(part.stop - part.start + 1))
        for i in range(part.stop - part.start):
            yield part.start + i, labelled_shingles(word[cut[i] : cut[i + 1]])


def sketches(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, row keys, text key, number of shingles and sketch keys."""
    narrow = row_keys(small_batches(docs).select("doc_id", text_bytes(text_col).alias("text")))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            count, keys = np.zeros(len(texts), np.int64), []
            for i, own in each_shingled(texts):
                count[i] = len(own)
                if len(own):
                    keys.append(sketch(own))
            bound = np.concatenate([[0], np.cumsum((count > 0) * SKETCHES)]).astype(np.int32)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (0, 2, 3)), pa.array([text_key(t) for t in texts], pa.binary()), pa.array(count), pa.ListArray.from_arrays(pa.array(bound), pa.array(flat))],
                ["doc_id", "k1", "k2", "tid", "shingles", "keys"],
            )

    return narrow.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, tid binary, shingles long, keys array<long>")


BLANK_WORDS = ~BLANK


def shingle_rows(docs: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """tid and packed shingles of the texts in `wanted` (k1, k2: the keys of a row that has the text)."""
    narrow = row_keys(small_batches(docs).select("doc_id", text_bytes(text_col).alias("text"))).join(wanted, ["k1", "k2"], "left_semi").select("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            bodies = [own.tobytes() for _, own in each_shingled(texts)]
            yield pa.RecordBatch.from_arrays([pa.array([text_key(t) for t in texts], pa.binary()), pa.array(bodies, pa.binary())], ["tid", "body"])

    return narrow.mapInArrow(lean(run), "tid binary, body binary").groupBy("tid").agg(F.first("body").alias("body"))


def _numbers(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.uint64)


class Postings:
    """Exact overlaps of one text with all texts of a set."""

    def __init__(self, shingle: list[np.ndarray], members: np.ndarray, kinds: int):
        size = np.fromiter((len(shingle[i]) for i in members), np.int64, len(members))
        flat = np.concatenate([shingle[i] for i in members])
        order = np.argsort(flat, kind="stable")
        self.members = members
        self.holder = np.repeat(np.arange(len(members)), size)[order]
        self.first = np.searchsorted(flat[order], np.arange(kinds + 1))

    def overlaps(self, own: np.ndarray) -> np.ndarray:
        """Shared shingles with every member."""
        begin, length = self.first[own], self.first[own + 1] - self.first[own]
        step = np.cumsum(length)
        at = np.repeat(begin - (step - length), length) + np.arange(step[-1])
        return np.bincount(self.holder[at], minlength=len(self.members))


def bucket_links(tids: list[bytes], bodies: list[bytes], half: np.ndarray | None = None) -> list[tuple[bytes, bytes]]:
    """A forest of verified links with the components of all links of a bucket (with `half`: of those between its two halves).

    A search over the links: what is reached compares itself with what is not reached yet."""
    n = len(tids)
    rows = [_numbers(b) for b in bodies]
    size = np.fromiter(map(len, rows), np.int64, n)
    kinds, flat = np.unique(np.concatenate(rows), return_inverse=True)
    shingle = np.split(flat, np.cumsum(size)[:-1])
    left = np.ones(n, bool)  # not reached yet
    postings = Postings(shingle, np.arange(n), len(kinds))
    p, q = _share(SIMILARITY)
    out = []
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue and left.any():
            i = queue.pop()
            if 2 * left.sum() < len(postings.members):
                postings = Postings(shingle, np.flatnonzero(left), len(kinds))
            shared = postings.overlaps(shingle[i])
            other = postings.members
            near = left[other] & (q * shared >= p * (size[i] + size[other] - shared))
            if half is not None:
                near &= half[other] != half[i]
            for j in other[near].tolist():
                if alignment_similarity(rows[i], rows[j]) >= SIMILARITY:
                    out.append((tids[i], tids[j]))
                    left[j] = False
                    queue.append(j)
    return out


def pairs_of_small(met: DataFrame) -> DataFrame:
    """a, b: the distinct pairs of buckets of up to SMALL rows whose sizes allow the threshold."""
    p, q = _share(SIMILARITY)
    grouped = met.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("tid", "shingles"))).alias("own"))  # at most SMALL
    first = grouped.select("own", F.posexplode("own").alias("at", "one"))
    both = first.select("one", F.explode(F.slice("own", F.col("at") + 2, F.lit(SMALL))).alias("other"))
    x, y = F.col("one.shingles"), F.col("other.shingles")
    return both.where(F.lit(q) * F.least(x, y) >= F.lit(p) * F.greatest(x, y)).select(F.col("one.tid").alias("a"), F.col("other.tid").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """tid, label (least tid of the component): label propagation with pointer jumping, to a fixed point."""
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    both = stash(links.select(ways).select("way.a", "way.b").distinct(), "dedup-links", few=True)  # `links` is made once
    labels = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("tid"), F.least("a", "m").alias("label")), "dedup-labels", few=True)
    while True:
        near = both.join(labels.withColumnRenamed("tid", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "tid"), "tid").select("tid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("tid").alias("label"), F.col("label").alias("far"))
        step = stash(step.join(jump, "label", "left").select("tid", "old", F.least("label", "far").alias("label")), "dedup-labels", few=True)
        discard(labels)
        labels = step
        if step.where("old <> label").isEmpty():
            discard(both)
            return step.select("tid", "label")


def classified(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2, tid and group (the class's key) of every row."""
    rows = stash(sketches(docs, text_col), "dedup-sketches", few=True)
    texts = rows.where("shingles > 0").groupBy("tid").agg(F.first("keys").alias("keys"), F.first("shingles").alias("shingles"))
    banded = texts.select("tid", "shingles", F.explode("keys").alias("key"))
    counts = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("all")).where("n > 1")
    met = stash(banded.join(counts, "key"), "dedup-buckets", few=True)
    pairs = stash(pairs_of_small(met), "dedup-pairs", few=True)
    needed = pairs.select(F.col("a").alias("tid")).union(pairs.select("b")).union(met.where(F.col("n") > SMALL).select("tid")).distinct()
    # copies combine before the exchange: one row of a text stands for all
    wanted = rows.where("shingles > 0").groupBy("tid").agg(F.min(F.struct("k1", "k2")).alias("row")).join(needed, "tid", "left_semi").select("row.*")
    bodies = stash(shingle_rows(docs, wanted, text_col), "dedup-bodies")
    # a bucket is cut into chunks of bounded bytes, and every two chunks (a chunk and itself too) meet in a task of their own
    chunks = F.ceil(F.col("all") * 8 / CHUNK_BYTES)
    dealt = met.where(F.col("n") > SMALL).select("key", "tid", chunks.alias("m"), F.pmod(F.xxhash64("tid"), chunks).alias("c"))
    dealt = dealt.select("key", "tid", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("x")).select("key", "tid", "c", F.least("c", "x").alias("p"), F.greatest("c", "x").alias("q"))
    large = dealt.join(bodies, "tid")

    def verify_large(table: pa.Table) -> pa.Table:
        chunk = table["c"].to_numpy()
        links = bucket_links(table["tid"].to_pylist(), table["body"].to_pylist(), chunk if chunk.min() < chunk.max() else None)
        return pa.table({"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())})

    in_place = large.groupBy("key", "p", "q").applyInArrow(lean_group(verify_large), "a binary, b binary")
    loaded = pairs.join(bodies.select(F.col("tid").alias("a"), F.col("body").alias("body_a")), "a").join(bodies.select(F.col("tid").alias("b"), F.col("body").alias("body_b")), "b")

    def verify(batches):
        for batch in batches:
            own = {n: batch.column(batch.schema.get_field_index(n)) for n in ("a", "b", "body_a", "body_b")}
            good = pa.array([alignment_similarity(_numbers(x.as_buffer()), _numbers(y.as_buffer())) >= SIMILARITY for x, y in zip(own["body_a"], own["body_b"], strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([own["a"].filter(good), own["b"].filter(good)], ["a", "b"])

    labels = components(loaded.mapInArrow(lean(verify), "a binary, b binary").union(in_place))
    discard(met, pairs, bodies)
    joined = rows.select("doc_id", "k1", "k2", "tid", "shingles").join(labels, "tid", "left")
    alone = F.unhex(F.md5(F.concat_ws(":", F.lit("empty"), "k1", "k2").cast("binary")))
    return joined.withColumn("group", F.coalesce("label", F.when(F.col("shingles") == 0, alone).otherwise(F.col("tid")))).drop("label", "shingles")


def near_duplicates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least id of the class), class_size, class_key, text_key, is_first (its id is the class id)."""
    rows = stash(classified(docs, text_col), "dedup-classes")
    # written first, so that the join below has plain exchanges on both sides and a large class can be split
    classes = stash(rows.groupBy("group").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "dedup-sizes", few=True)
    return rows.join(classes, "group").select(
        "doc_id", "class_id", F.col("class_size").cast("long").alias("class_size"), F.hex("group").alias("class_key"), F.hex("tid").alias("text_key"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_first")
    )


def keep_one(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of every class (the least id; of equal rows any one), with the columns of docs."""
    kept = classified(docs, text_col).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("one")).select("one.k1", "one.k2")
    names = docs.columns
    keyed = docs.select(*[F.col(c).alias(f"kept_{i}") for i, c in enumerate(names)], F.col("doc_id"), text_bytes(text_col).alias("text"))
    keyed = row_keys(keyed).drop("doc_id", "text")
    return keyed.join(kept, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)])


# Exact overlaps of all pairs, and classes by closure: the same links wherever matched shingles keep their order.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
d AS (SELECT r, doc_id, len(words) AS n, md5(array_to_string(words, ' ')) AS tid, words FROM w),
t AS (SELECT tid, any_value(words) AS words, any_value(n) AS n FROM d WHERE n > 0 GROUP BY tid),
s AS (SELECT tid, array_to_string(words[i : i + 4], ' ') AS shingle FROM (SELECT tid, words, unnest(range(1, greatest(n - 4, 1) + 1)) AS i FROM t)),
o AS (SELECT tid, hash(shingle, row_number() OVER (PARTITION BY tid, shingle)) AS k FROM s),
z AS (SELECT tid, count(*) AS size FROM o GROUP BY tid),
m AS (SELECT a.tid AS a, b.tid AS b, count(*) AS shared FROM o a JOIN o b ON a.k = b.k AND a.tid < b.tid GROUP BY 1, 2),
l AS (SELECT a, b FROM m JOIN z x ON x.tid = a JOIN z y ON y.tid = b WHERE 5 * shared >= 4 * (x.size + y.size - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT a AS tid, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.tid),
g AS (SELECT tid, min(root) AS label FROM c GROUP BY tid),
p AS (SELECT doc_id, CASE WHEN n = 0 THEN 'row ' || r ELSE coalesce(label, d.tid) END AS k FROM d LEFT JOIN g ON g.tid = d.tid),
q AS (SELECT k, min(doc_id) AS class_id, count(*) AS class_size FROM p GROUP BY k)
SELECT doc_id, class_id, class_size, doc_id IS NOT DISTINCT FROM class_id AS is_first FROM p JOIN q ON p.k = q.k
"""
