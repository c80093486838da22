"""Hard-negative mining by a secondary sort.

Every pair that may matter becomes a packed key (anchor, score from high to low, positive before negative, id). The keys are dealt by
anchor and sorted within partitions, so one pass over a partition meets the pairs of an anchor in order: a positive opens a window of
negative scores below its own, a negative goes to the windows that are open for it, and a window closes when it is full or its
lower end is passed. What is held at a time is the windows of one anchor, whatever number of rows it has.

Pairs come from vectors packed into blocks: blocks of rows meet blocks of anchors (a set the caller states), a block product gives the
scores, and a task keeps for an anchor only pairs that can still be among the asked ones: the best of its positives first, then,
with the windows known, the best negatives of each window. So the shuffle holds a few pairs per anchor and task and never all pairs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelake.llm.common import stored

ROWS, ANCHORS, SLAB = 1_024, 2_048, 512  # rows of a block, anchors of a block (about), rows that are scored at a time
HELD = 32  # anchor blocks whose best pairs a task holds before it passes them on
KEY = ">QQBQ"
SIGN = 1 << 63
FIELDS = ["n", "size", "kind", "row", "id", "label", "vector"]
BLOCK = "n int, size int, kind string, row binary, id binary, label binary, vector binary"
RESULT = "anchor long, anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
TOP = (1 << 63) - 1  # scores are held between -TOP and TOP
NEVER = -(1 << 63)
PAIRS = "key binary, anchor_id long, deal int"


def packed(anchor: int, score: int, negative: bool, id_: int) -> bytes:
    return struct.pack(KEY, anchor + SIGN, SIGN - 1 - score, negative, id_ + SIGN)


def unpacked(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, id_ = struct.unpack(KEY, key)
    return anchor - SIGN, SIGN - 1 - score, bool(negative), id_ - SIGN


def _block(rows: list[tuple], vectors: list[np.ndarray]) -> tuple:
    """One block: rows (row, id, label) in the order of their ids, vectors filled up with zeros to one size."""
    row, id_, label = np.array(rows, np.int64).T
    order = np.lexsort((row, id_))
    size = max(map(len, vectors))
    matrix = np.zeros((len(vectors), size), np.int64)
    for i, at in enumerate(order):
        matrix[i, : len(vectors[at])] = vectors[at]
    small = matrix.min(initial=0) > -(2**15) and matrix.max(initial=0) < 2**15
    kind = "int16" if small else "int64"
    return len(row), size, kind, row[order].tobytes(), id_[order].tobytes(), label[order].tobytes(), matrix.astype(kind).tobytes()


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ROWS rows and the rest of the partition."""
    rows, vectors = [], []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f], pa.int32() if isinstance(f, int) else None) for f in _block(rows, vectors)], FIELDS)

    for batch in batches:
        values, ends = batch["vector"].values.to_numpy(zero_copy_only=False), batch["vector"].offsets.to_numpy()
        for i, r in enumerate(zip(*(batch[c].to_pylist() for c in ("row", "id", "label")))):
            rows.append(r)
            vectors.append(values[ends[i] : ends[i + 1]])
            if len(rows) == ROWS:
                yield made()
                rows, vectors = [], []
    if rows:
        yield made()


def _one_block(group: pd.DataFrame) -> pd.DataFrame:
    fields = _block(list(zip(group["row"], group["id"], group["label"])), [np.asarray(v, np.int64) for v in group["vector"]])
    return pd.DataFrame([(group["deal"].iloc[0], *fields)], columns=["deal", *FIELDS])


class Block:
    def __init__(self, fields: dict):
        self.n, self.size = fields["n"], fields["size"]
        self.row, self.id, self.label = (np.frombuffer(fields[c], np.int64) for c in ("row", "id", "label"))
        self.vector = np.frombuffer(fields["vector"], fields["kind"]).reshape(self.n, self.size)
        self.big = int(np.abs(self.vector.astype(np.float64)).max(initial=0)) + 1


def scores(a: Block, b: Block, part: slice) -> np.ndarray:
    """Exact integer inner products of all of ``a`` with a part of ``b``. Vectors of different sizes meet in the smaller one, since
    missing components count as 0."""
    size = min(a.size, b.size)
    most = a.big * b.big * size
    x, y = a.vector[:, :size], b.vector[part, :size]
    if most < 2**53:
        kind = np.float32 if most < 2**24 else np.float64
        return (x.astype(kind) @ y.astype(kind).T).astype(np.int64)
    if most < 2**62:
        return x.astype(np.int64) @ y.astype(np.int64).T
    return np.clip(x.astype(object) @ y.astype(object).T, -TOP, TOP).astype(np.int64)


def _first(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (anchor, row) of the k largest scores of each anchor; ties go to the smaller index, NEVER is out."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k][:, None]
        over, even = score > least, score == least
        room = k - over.sum(axis=1)[:, None]
        score = np.where(over | (even & (np.cumsum(even, axis=1) <= room)), score, NEVER)
    return np.nonzero(score != NEVER)


class Best:
    """Pairs of one anchor block that a task has met: (anchor, window, score, id, row), cut down to k of each window now and then."""

    def __init__(self, k: int):
        self.k, self.parts, self.held, self.limit = k, [], 0, 200_000

    def add(self, anchor, window, score, id_, row):
        self.parts.append(np.stack([anchor, window, score, id_, row]))
        self.held += len(anchor)
        if self.held > self.limit:
            self.cut()
            self.limit = max(200_000, 2 * self.held)

    def cut(self) -> np.ndarray:
        all_ = np.concatenate(self.parts, axis=1) if self.parts else np.zeros((5, 0), np.int64)
        anchor, window, score, id_, row = all_ = all_[:, np.lexsort((all_[4], all_[3], -all_[2], all_[1], all_[0]))]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(anchor)), 0))
        all_ = all_[:, np.arange(len(anchor)) - start < self.k]
        self.parts, self.held = [all_], all_.shape[1]
        return all_


def bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest score between ``low`` and ``high`` percent of a score."""
    return -(-low * score // 100), high * score // 100


def _windows(keys: list[bytes], anchors: Block, positives: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each (anchor, window); windows that an anchor lacks are empty."""
    least, most = np.full((anchors.n, positives), TOP), np.full((anchors.n, positives), NEVER)
    at, filled = {r: i for i, r in enumerate(anchors.row.tolist())}, [0] * anchors.n
    for key in keys:
        anchor, score, _, _ = unpacked(key)
        i = at[anchor]
        one, other = bounds(score, low, high)
        least[i, filled[i]], most[i, filled[i]] = min(one, TOP), max(other, NEVER)
        filled[i] += 1
    return least, most


def _pairs_of(best: Best, anchors: Block, negative: bool) -> pa.RecordBatch:
    anchor, _, score, id_, row = best.cut()
    if negative:  # one pair may lie in several windows
        _, one = np.unique(np.stack([anchor, row]), axis=1, return_index=True)
        anchor, score, id_ = anchor[one], score[one], id_[one]
    names, at = dict(zip(anchors.row.tolist(), anchors.id.tolist())), anchor.tolist()
    made = [packed(a, s, negative, i) for a, s, i in zip(at, score.tolist(), id_.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array([names[a] for a in at], pa.int64())], ["key", "anchor_id"])


def _positive_pairs(k: int):
    """The k best rows of the anchor's own label that a task meets, as packed keys with the anchor's deal."""

    def asked(anchors: Block, _fields: dict) -> list:
        return [lambda score, rows, part: (anchors.label[:, None] == rows.label[None, part]) & (anchors.row[:, None] != rows.row[None, part])]

    return _scoring(k, asked, False)


def _negative_pairs(k: int, positives: int, low: int, high: int):
    """The k best rows of other labels that a task meets in each window, as packed keys."""

    def asked(anchors: Block, fields: dict) -> list:
        least, most = _windows(fields["keys"], anchors, positives, low, high)

        def within(w: int):
            return lambda score, rows, part: (anchors.label[:, None] != rows.label[None, part]) & (score >= least[:, w, None]) & (score <= most[:, w, None])

        return [within(w) for w in range(positives)]

    return _scoring(k, asked, True)


def _scoring(k: int, asked, negative: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for deal, (best, anchors, _) in held.items():
                pairs = _pairs_of(best, anchors, negative)
                yield pairs.append_column("deal", pa.array([deal] * pairs.num_rows, pa.int32()))
            held.clear()

        for batch in batches:
            for at in range(batch.num_rows):
                fields = batch.slice(at, 1).to_pylist()[0]
                rows, deal = Block(fields["b"]), fields["deal"]
                if deal not in held:
                    if len(held) == HELD:
                        yield from out()
                    anchors = Block(fields["a"])
                    held[deal] = Best(k), anchors, asked(anchors, fields["a"])
                best, anchors, conditions = held[deal]
                for begin in range(0, rows.n, SLAB):
                    part = slice(begin, begin + SLAB)
                    score = scores(anchors, rows, part)
                    for w, condition in enumerate(conditions):
                        a, r = _first(np.where(condition(score, rows, part), score, NEVER), k)
                        best.add(anchors.row[a], np.full(len(a), w), score[a, r], rows.id[begin + r], rows.row[begin + r])
        yield from out()

    return run


def _in_order(pairs: DataFrame, walk):
    """``walk`` over the pairs (key, anchor_id, deal), which come dealt by anchor and sorted by key."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.rdd.map(lambda r: (bytes(r[0]), (r[1], r[2])))
    return rows.repartitionAndSortWithinPartitions(n, lambda key: zlib.crc32(key[:8])).mapPartitions(walk)


def first_positives(k: int):
    """Keeps the first k pairs of each anchor."""

    def walk(pairs: Iterable[tuple[bytes, tuple]]) -> Iterator[tuple]:
        at, met = None, 0
        for key, value in pairs:
            at, met = (at, met + 1) if key[:8] == at else (key[:8], 1)
            if met <= k:
                yield key, *value

    return walk


def open_windows(k: int, low: int, high: int):
    """Rows of RESULT. A positive opens a window, which is left when it has k negatives or when the scores are below it."""

    def walk(pairs: Iterable[tuple[bytes, tuple]]) -> Iterator[tuple]:
        at, windows = None, []
        for key, (anchor_id, _) in pairs:
            anchor, score, negative, id_ = unpacked(key)
            if anchor != at:
                at, windows = anchor, []
            if not negative:
                windows.append([id_, score, *bounds(score, low, high), 0])
                continue
            windows = [w for w in windows if w[4] < k and score >= w[2]]
            for w in windows:
                if score <= w[3]:
                    w[4] += 1
                    yield anchor, anchor_id, w[0], w[4], id_, w[1], score

    return walk


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor, anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    ``positives`` other rows of the same label, the first ``negatives`` rows of other labels whose score lies between ``low`` and ``high``
    percent of the positive's. Scores are integer inner products with the anchor; higher ones come first, ties by smaller id.

    ``rows`` has ``row`` (a unique long), ``id`` (long), ``label`` (long) and ``vector`` (array of long), and ``is_anchor`` (a condition) tells the
    anchors. Rows with a null in one of these or in the vector take no part. Vectors may differ in size: missing components count as 0, so
    an empty vector scores 0 with all. Repeated rows (other values of ``row``) are rows of their own, as anchors, positives and
    negatives. No anchors, positives or negatives give no rows. Scores that do not fit into a long count as the last ones that do.
    Other columns take no part and may have any name.
    """
    spark = rows.sparkSession
    columns = [F.col(c).cast("long").alias(c) for c in ("row", "id", "label")]
    used = rows.select(*columns, F.col("vector").cast("array<long>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    used = stored(used.na.drop().where(~F.exists("vector", lambda x: x.isNull())))
    found = used.where("asked").count()
    if not found:
        return spark.createDataFrame([], RESULT)
    deals = -(-found // ANCHORS)
    blocks = stored(used.select("row", "id", "label", "vector").mapInArrow(_in_blocks, BLOCK))
    deal = F.pmod(F.xxhash64("row"), F.lit(deals)).cast("int").alias("deal")
    anchors = stored(used.where("asked").select(deal, "row", "id", "label", "vector").groupBy("deal").applyInPandas(_one_block, f"deal int, {BLOCK}"))
    # Blocks of rows are dealt to stripes, so that few anchors too make work for all cores; a row block meets each anchor block once.
    stripes = max(1, min(blocks.count(), -(-4 * spark.sparkContext.defaultParallelism // deals)))
    side = blocks.select(F.struct(*FIELDS).alias("b"), F.pmod(F.xxhash64("row"), F.lit(stripes)).alias("stripe"))
    side = side.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))

    def pairs(asked: DataFrame, scoring) -> DataFrame:
        own = asked.select("deal", F.struct(*[c for c in asked.columns if c != "deal"]).alias("a"))
        both = side.join(own.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long")))), ["deal", "stripe"])
        return stored(both.select("deal", "a", "b").mapInArrow(scoring, PAIRS))

    best = stored(spark.createDataFrame(_in_order(pairs(anchors, _positive_pairs(positives)), first_positives(positives)), PAIRS))
    windows = best.groupBy("deal").agg(F.collect_list("key").alias("keys"))  # a few keys for each anchor of a block
    every = best.unionByName(pairs(anchors.join(windows, "deal"), _negative_pairs(negatives, positives, low, high)))
    return spark.createDataFrame(_in_order(every, open_windows(negatives, low, high)), RESULT)
