"""Toxicity by compression distance: windows of a text are compressed with two zstandard dictionaries.

Both dictionaries are trained on labelled documents. The ordinary one holds the words that most ordinary documents use. The
toxic one puts in front of the same words those that toxic documents use significantly more often (a G-test on document
counts), for toxic text is ordinary text for the most part. A window without such words therefore comes out equally long,
one with them shorter under the toxic dictionary. What the windows of a document save is calibrated to a probability by a
logistic regression on labelled documents that the dictionaries have not seen.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType, arrow_udf

from estatelake.llm.common import stored

WINDOW = 160  # bytes of words in a window; the word that reaches it is the window's last
FEATURES = 5
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]  # the last one stands alone

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        rules = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        found = []
        for content in (self.ordinary, self.toxic):
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=rules)
            found.append(zstandard.ZstdCompressor(dict_data=words, compression_params=rules))
        return found[0], found[1]


def windows(text: str) -> Iterator[bytes]:
    """The words of a whole text in lower case, cut behind the word that fills a window."""
    data = " ".join(_WORD.findall(text.lower())).encode()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + WINDOW)
        end = len(data) if end < 0 else end
        yield b" " + data[at:end] + b" "
        at = end + 1


def _features(text: str | None, ordinary, toxic) -> list[float]:
    saved = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text or "")] or [0])
    top = np.sort(saved)[::-1][:3]
    return [
        min(float(top[0]), 12.0), min(float(top.sum()), 30.0) / 3, float(np.log1p((saved >= 3).sum())),
        float(np.maximum(saved - 2, 0).mean()), float((saved >= 4).mean()),
    ]


def _udf(model: Model, kind: str, result):
    sent = {}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not sent:
            sent["compressors"] = model.compressors()
        for batch in batches:
            yield result([_features(t, *sent["compressors"]) for t in batch.to_pylist()])

    return arrow_udf(run, kind, ArrowUDFType.SCALAR_ITER)


def _as_features(rows: list[list[float]]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.float64()))


def score(model: Model, text: str = "text") -> Column:
    """Probability that a whole text is toxic. A null text counts as empty; a text without words saves nothing."""
    weights = np.array(model.weights)

    def probability(rows: list[list[float]]) -> pa.Array:
        z = np.array(rows, np.float64).reshape(-1, FEATURES) @ weights[:-1] + weights[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return _udf(model, "double", probability)(F.col(text).cast("string"))


def _surprise(t: Column, o: Column, toxic: int, ordinary: int) -> Column:
    """G statistic of a term's document counts in the two classes."""
    share = (t + o) / (toxic + ordinary)
    part = lambda seen, n, p: F.when(seen > 0, seen * F.log(seen / (n * p))).otherwise(0.0)
    return 2 * (
        part(t, toxic, share) + part(toxic - t, toxic, 1 - share) + part(o, ordinary, share) + part(ordinary - o, ordinary, 1 - share)
    )


def _discoveries(g: list[float], tested: int, rate: float = 0.01) -> int:
    """How many of the largest G statistics are found at a false discovery rate (Benjamini-Hochberg over all tested terms). The
    level is absolute: how common the commonest term is doesn't matter, so a language with few toxic documents keeps its terms."""
    p = [math.erfc(math.sqrt(max(x, 0.0) / 2)) for x in g]
    return max((i for i, x in enumerate(p, 1) if x <= rate * i / tested), default=0)


def _dictionaries(examples: DataFrame, toxic: int, ordinary: int, terms: int, common: int) -> tuple[bytes, bytes]:
    words = examples.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("term"))
    counts = stored(words.groupBy("term").agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("o")))
    used = [r.term for r in counts.where("o > 0").orderBy(F.desc("o"), "term").select("term").limit(common).collect()]
    # Terms in fewer than three documents can't be significant, so what is tested are the terms that can.
    able = counts.where(F.col("t") + F.col("o") >= 3)
    tested = able.count()
    leaning = able.where(F.col("t") / toxic > 5 * (F.col("o") + 0.5) / ordinary).where("t >= 3") if toxic and ordinary else counts.limit(0)
    found = leaning.withColumn("g", _surprise(F.col("t"), F.col("o"), toxic, ordinary)).orderBy(F.desc("g"), "term").select("term", "g").limit(terms).collect()
    marked = [r.term for r in found[: _discoveries([r.g for r in found], tested)]]
    lean = set(marked)
    ordinary_words = (" " + " ".join(w for w in used if w not in lean) + " ").encode()
    return ordinary_words, (" " + " ".join(marked) + " ").encode() + ordinary_words


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights by Newton steps; all but the last are drawn to zero a little."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    most_documents: int = 20_000, terms: int = 2_000, common: int = 8_000,
) -> Model:
    """The model of the labelled documents: rows of ``docs`` whose key has a label of 0 or 1.

    At most about ``most_documents`` of them are used, taken by a hash of the key; copies of one text count once. Dictionaries
    (``terms`` and ``common`` bound their words) of one half are calibrated on the other half; then dictionaries of all take
    their place. Where the other half has fewer than five documents of a class, all calibrate; where a class is missing
    altogether, every text gets the same score.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    known = stored(known)
    share = min(1.0, most_documents / max(1, known.count()))
    taken = known.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    examples = texts.join(taken, key).select("toxic", "text", F.xxhash64("text").alias("same"))
    examples = stored(examples.dropDuplicates(["same"]).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "same"), F.lit(2)).cast("int")))
    count = {(r.half, r.toxic): r["count"] for r in examples.groupBy("half", "toxic").count().collect()}
    toxic, ordinary = (sum(count.get((half, c), 0) for half in (0, 1)) for c in (1, 0))
    final = _dictionaries(examples, toxic, ordinary, terms, common)
    if min(count.get((1, 0), 0), count.get((1, 1), 0)) >= 5:
        trial, calibrating = _dictionaries(examples.where("half = 0"), count.get((0, 1), 0), count.get((0, 0), 0), terms, common), examples.where("half = 1")
    else:
        trial, calibrating = final, examples
    unseen = _udf(Model(*trial, ()), "array<double>", _as_features)
    rows = calibrating.select("toxic", unseen(F.col("text")).alias("x")).collect()
    y = np.array([r.toxic for r in rows], np.float64)
    if not len(rows) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        return Model(*final, (0.0,) * FEATURES + (math.log(rate / (1 - rate)),))
    return Model(*final, _logistic(np.array([r.x for r in rows]), y))
