"""Self join of documents on the Jaccard similarity of their word n-grams, with Bayesian pruning of MinHash candidates.

1. Documents with the same n-gram set form one class; only one of each takes part from here on.
2. Classes that agree in a band of MinHash values are candidates. Their values are compared a few at a time; a pair is dropped
   when the posterior probability (uniform prior) that its similarity reaches the threshold falls below a tolerance.
3. Pairs left over tie classes into clusters. Inside a cluster every pair is verified on the n-gram sets themselves.

Buckets and clusters of any size are cut into blocks; a task holds two blocks at a time and gives back one row per class and
pair of blocks (its number of links, and the class it is tied to), so nothing grows with the square of a group but the
comparisons. Two classes whose similarity is 0.8 share one of 32 bands of 4 with a probability of 1 - 5e-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelake.llm.common import stored
from estatelake.llm.components import components

HASHES, ROWS_PER_BAND, STEP = 128, 4, 16
BLOCK_ROWS, BLOCK_NGRAMS = 512, 1 << 18
_WORD = re.compile(r"\w+")
_RANDOM = np.random.Generator(np.random.PCG64(7))
_TURN = _RANDOM.integers(0, 2**64, HASHES, np.uint64)[:, None]
_SCALE = (_RANDOM.integers(0, 2**64, HASHES, np.uint64) | np.uint64(1))[:, None]
_PLACES = _RANDOM.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def ngrams(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of lower-cased words. A text of fewer words, but not none, has one."""
    words = [xxhash.xxh3_64_intdigest(w) for w in _WORD.findall(text.lower())]
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array(words, np.uint64)
    n = min(n, len(hashes))
    places = _PLACES if n <= len(_PLACES) else np.resize(_PLACES, n)
    mixed = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        mixed = (mixed + hashes[i : len(hashes) - n + 1 + i]) * places[i]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed * places[0] ^ np.uint64(len(hashes) if len(hashes) < n else 0))


def minhash(grams: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest values under each hash."""
    low = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 2048):
        x = (grams[None, at : at + 2048] ^ _TURN) * _SCALE
        np.minimum(low, x.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each step, the fewest equal values among those compared so far that keep a pair.

    With a uniform prior, m equal of n leave P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    found = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        found.append(m)
    return tuple(found)


def _leaders(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item it is tied to."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of equal values in the first ``keys`` columns of sorted batches. A group may span batches."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            key = tuple(c[a] for c in columns)
            if kept and key != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
            last = key
    if kept:
        yield pa.Table.from_batches(kept)


def _pairs_of_blocks(members: DataFrame, key: str, blocks: str, node: str) -> DataFrame:
    """Each member once for every pair (p, q) of blocks that its own block is in, dealt out and sorted by key, p, q."""
    own = F.pmod(F.xxhash64(node), F.col(blocks)).cast("int")
    dealt = members.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    rows = dealt.withColumns({"p": F.least("own", "with"), "q": F.greatest("own", "with")}).drop("with", blocks)
    rows = rows.select(key, "p", "q", *[c for c in rows.columns if c not in (key, "p", "q")])
    return rows.repartition(key, "p", "q").sortWithinPartitions(key, "p", "q")


def _kept(a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks of signatures that no step dropped."""
    equal = np.zeros((len(a), len(b)), np.uint8)
    for h in range(STEP):
        equal += a[:, h, None] == b[None, :, h]
    left, right = np.nonzero(equal >= least[0])
    matches = equal[left, right].astype(np.int32)
    for step, fewest in enumerate(least[1:], 1):
        for at in range(0, len(left), 1 << 16):
            s = slice(at, at + (1 << 16))
            matches[s] += (a[left[s], step * STEP : (step + 1) * STEP] == b[right[s], step * STEP : (step + 1) * STEP]).sum(axis=1)
        keep = matches >= fewest
        left, right, matches = left[keep], right[keep], matches[keep]
    return left, right


def _ties(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for group in _groups(batches, 3):
            if group.num_rows < 2:
                continue
            p, q = group["p"][0].as_py(), group["q"][0].as_py()
            nodes, own = group["node"].to_numpy(), group["own"].to_numpy()
            order = np.argsort(nodes, kind="stable")
            nodes, own = nodes[order], own[order]
            values = np.frombuffer(b"".join(group["signature"].to_pylist()), np.int32).reshape(-1, HASHES)[order]
            first, second = np.flatnonzero(own == p), np.flatnonzero(own == q)
            left, right = _kept(values[first], values[second], least)
            label = _leaders(len(nodes), first[left], second[right])
            tied = label != np.arange(len(nodes))
            found.append(np.stack([nodes[tied], nodes[label[tied]]]))
            if sum(x.shape[1] for x in found) > 10_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return run


def _edges(found: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64())], ["a", "b"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of some sets, over those elements that more than one has."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    place, owner = place[shared], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    if len(place):
        column = np.cumsum(np.concatenate([[0], place[1:] != place[:-1]]))
        width = max(1, (1 << 22) // len(sets))
        for at in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [at, at + width])
            inside = np.zeros((len(sets), width), np.float32)
            inside[owner[a:b], column[a:b] - at] = 1
            common += inside @ inside.T
    return common.astype(np.int64)


def _verified(threshold: float, n: int):
    share = Fraction(str(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            p, q = group["p"][0].as_py(), group["q"][0].as_py()
            nodes, own, copies = (group[c].to_numpy() for c in ("node", "own", "copies"))
            order = np.argsort(nodes, kind="stable")
            nodes, own, copies = nodes[order], own[order], copies[order]
            texts = group["text"]
            sets = [ngrams(texts[int(i)].as_py() or "", n) for i in order]
            common, sizes = _overlaps(sets), np.array([len(s) for s in sets])
            linked = common * share.denominator >= share.numerator * (sizes[:, None] + sizes[None, :] - common)
            if p != q:
                linked &= own[:, None] != own[None, :]
            np.fill_diagonal(linked, False)
            label = _leaders(len(nodes), *np.nonzero(np.triu(linked)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.array(nodes[label]), pa.array(linked.sum(axis=1)), pa.array(linked @ copies)],
                ["node", "leader", "class_links", "links"],
            )

    return run


def signatures(docs: DataFrame, text: str, n: int) -> DataFrame:
    """Adds size (number of n-grams), same (digest of the n-gram set, null without words) and signature."""
    keep = docs.schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, same, values = [], [], []
            for t in batch.column(text):
                grams = ngrams(t.as_py() or "", n)
                sizes.append(len(grams))
                same.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                values.append(minhash(grams).tobytes() if len(grams) else None)
            added = [pa.array(sizes, pa.int32()), pa.array(same, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added], [*keep, "size", "same", "signature"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{types}, size int, same binary, signature binary")


def jaccard_join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: row (an id of its own), key, class_id (smallest key connected by links), copies (rows with
    the same n-grams, itself included), links (other rows with a similarity of at least ``threshold``, copies counted each)
    and keep (true for one row of each connected group: the one of the smallest key, null last, then the smallest row).

    Null, empty and wordless texts have no n-grams, hence no links and a group of their own; their class_id is their key.
    Repeated rows are copies of each other. Columns named in ``carry`` come out unchanged in a struct ``carried``.
    """
    carried = [F.struct(*carry).alias("carried")] if carry else []
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *carried)
    base = stored(signatures(base, "text", n))
    classes = base.where("size > 0").groupBy("same").agg(F.min("row").alias("node"), F.count("*").alias("copies"))
    members = stored(base.where("size > 0").select("row", "key", "same").join(classes, "same").select("row", "key", "node", "copies"))
    alone = members.where("row = node").select("node", "copies")

    values = base.join(alone, F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "signature")
    width = 4 * ROWS_PER_BAND
    band = F.transform(
        F.sequence(F.lit(0), F.lit(HASHES // ROWS_PER_BAND - 1)),
        lambda i: F.xxhash64(i, F.substring("signature", i * width + 1, F.lit(width))),
    )
    bands = values.select("node", F.explode(band).alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("long")
    buckets = bands.join(sizes, "bucket").select("bucket", "node", blocks.alias("blocks"))
    candidates = _pairs_of_blocks(buckets.join(values, "node"), "bucket", "blocks", "node")
    ties = candidates.mapInArrow(_ties(threshold, tolerance), "a long, b long").distinct()
    clusters = components(ties)

    sized = stored(clusters.join(base.select(F.col("row").alias("node"), "size", "text"), "node").join(alone, "node"))
    weights = sized.groupBy("component").agg(F.ceil(F.sum("size") / BLOCK_NGRAMS).cast("long").alias("blocks"))
    placed = _pairs_of_blocks(sized.join(weights, "component").drop("size"), "component", "blocks", "node")
    verified = stored(placed.mapInArrow(_verified(threshold, n), "node long, leader long, class_links long, links long"))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(verified.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")))

    placed = members.join(links, "node", "left").join(groups, "node", "left").select(
        "row", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"), "key",
    )
    first = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "row")).alias("first")
    chosen = placed.groupBy("component").agg(first)
    found = placed.drop("key").join(chosen, "component").select("row", "copies", "links", "first")
    one = F.lit(1).cast("long")
    return base.select("row", "key", *(["carried"] if carry else [])).join(found, "row", "left").select(
        *(["carried"] if carry else []),
        "row", F.col("key").alias(key), F.when(F.col("first").isNull(), F.col("key")).otherwise(F.col("first.key")).alias("class_id"),
        F.coalesce("copies", one).alias("copies"), F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        (F.col("first").isNull() | (F.col("first.row") == F.col("row"))).alias("keep"),
    )
