"""Quality selection by importance resampling.

Two generative models over hashed word uni- and bigrams: one of the target texts (labelled
good), one of all raw texts. A text's log weight is the log of the ratio of the two models, the sum of the log
ratios of its n-grams; adding Gumbel noise drawn from a hash of its id and taking the top k is
sampling without replacement in proportion to the weights. The k-th largest key is found exactly by narrowing
histograms, so no rows are sorted or gathered in one place.

Edge cases: a null or empty text has weight 0 (log), as do all texts when there is no target; very long texts
are weighed whole; repeated rows get equal weights; rows that tie with the k-th key are all selected; a null id draws its
noise as an id of its own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import chunks, map_arrow, staged

BUCKETS = 1 << 16
CHUNK_BYTES = 400_000


def _features(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks a:b of the texts: the bucket and the text (from a) of every n-gram."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for a, b in chunks(np.array([len(t) for t in coded], np.int64), CHUNK_BYTES):
        w = wordhash.words(coded[a:b], wordhash.word_classes())
        two, first = wordhash.ngrams(w, 2)
        bucket = np.concatenate([w.hash, two]) & np.uint64(BUCKETS - 1)
        yield a, b, bucket.astype(np.int64), np.concatenate([w.owner, w.owner[first]])


def log_ratios(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_target: int = 200_000, smoothing: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw of each bucket.

    The raw model counts every document. The target model learns from the documents named in
    `target_ids`; `max_target` bounds how many (about so many by a hash of the id), and with
    it the broadcast of their ids.
    """
    ids = target_ids.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct()
    n = ids.count()
    if n > max_target:
        ids = ids.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 52)) < F.lit(int((1 << 52) * max_target / n)))
    marked = docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(ids.withColumn("__target", F.lit(True))), id_col, "left").select("__text", F.coalesce("__target", F.lit(False)).alias("__target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            target = np.array(batch.column(1).to_pylist(), bool)
            for a, b, bucket, owner in _features(batch.column(0).to_pylist()):
                raw += np.bincount(bucket, minlength=BUCKETS)
                good += np.bincount(bucket[target[a:b][owner]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at], pa.int64()), pa.array(good[at], pa.int64())], ["bucket", "raw", "good"])

    rows = map_arrow(marked, count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.full(BUCKETS, smoothing), np.full(BUCKETS, smoothing)
    raw[rows.column("bucket").to_numpy()] += rows.column("raw").to_numpy()
    good[rows.column("bucket").to_numpy()] += rows.column("good").to_numpy()
    if good.sum() == BUCKETS * smoothing:
        return np.zeros(BUCKETS)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("n_features", "log_weight")) -> DataFrame:
    """The columns in `carry` and, under `names`, the number of n-grams and the log weight of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    carry = tuple(c for c in carry if c not in names)
    kept = docs.select(*(F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(carry)), F.col(f"`{text_col}`").alias("__text"))
    fields = [f"`{x.name}` {x.dataType.simpleString()}" for x in kept.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for a, b, bucket, owner in _features(batch.column(batch.num_columns - 1).to_pylist()):
                total[a:b] = np.bincount(owner, shared.value[bucket], b - a)
                size[a:b] = np.bincount(owner, minlength=b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size, pa.int64()), pa.array(total, pa.float64())], [*batch.schema.names[:-1], "__n", "__w"])

    return map_arrow(kept, run, ", ".join([*fields, "__n long", "__w double"])).toDF(*carry, *names)


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 2048) -> float | None:
    """The k-th largest value of a double column, exactly; None where there are fewer rows."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or n < k:
        return None
    while low < high:
        place = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)).alias("bin")
        found = rows.where(F.col(column).between(low, high)).groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for _, n, low, high in found:
            if k <= n:
                break
            k -= n
        if k == n:
            return low
        if k == 1:
            return high
    return low


def resample(docs: DataFrame, target_ids: DataFrame, fraction: float = 0.6, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", one_length: bool = False) -> DataFrame:
    """id, n_features, log_weight, sample_key and selected of every document; ceil(fraction * n) are selected.

    The sampling weight is the ratio of the models. With `one_length` weights are compared at one length instead:
    a text's log weight an n-gram, times the mean number of n-grams of all texts.
    """
    ratios = log_ratios(docs, target_ids, id_col, text_col)
    weighed = staged(weigh(docs, ratios, text_col, (id_col,)), "quality-weights")
    n, mean = weighed.agg(F.count(F.lit(1)), F.avg("n_features")).first()
    uniform = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    level = F.col("log_weight") / F.greatest("n_features", F.lit(1)) * F.lit(mean or 0.0) if one_length else F.col("log_weight")
    keyed = weighed.withColumn("sample_key", level - F.log(-F.log(uniform)))
    limit = kth_largest(keyed, "sample_key", -int(-n * fraction // 1))
    return keyed.withColumn("selected", F.lit(False) if limit is None else F.col("sample_key") >= F.lit(limit))
