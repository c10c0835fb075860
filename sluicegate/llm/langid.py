"""Language identification: multinomial naive Bayes over hashed character n-grams.

Words are runs of letters, lower-cased; each word with one boundary mark on either side gives
its n-grams of 2 to 4 characters. Counts of (language, bucket) come from labelled documents; the
matrix of log probabilities is broadcast (languages x buckets, both bounded parameters), and
batches are scored sparsely in numpy over their whole texts.

Edge cases: a text that is null or has no letter is `und` with score 0, as is every text when
there was nothing to learn from (an empty table); a null label is never learned from; very long texts are scored whole;
ties go to the language first in alphabetical order; repeated rows are each scored; a null id is learned from and kept;
extra columns are not read; a carried column named as a result gives way to it, unless `names` calls the results otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, staged

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
CHUNK_CHARS = 300_000
#: Languages in one broadcast matrix (64 MB); more are scored block by block.
BLOCK_LANGUAGES = 128


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text index of every n-gram of all texts."""
    parts = [t.lower() for t in texts]
    points = np.frombuffer("\0".join(["", *parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.r_[np.int32(0), np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) + 1 for p in parts])]
    letter = _letters()[points]
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1]
    points = np.where(letter, points, np.uint32(0))[keep]
    owner = owner[keep]
    again = (points[1:] == 0) & (points[:-1] == 0)  # one mark between two words
    stay = np.r_[True, ~again] if len(points) else np.zeros(0, bool)
    points, owner = points[stay], owner[stay]
    mixed = (points * np.uint32(2654435761)) ^ (points >> np.uint32(3))
    out, whose = [], []
    inner = points != 0
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        ok = np.ones(m, bool)
        for j in range(n):
            h = (h ^ mixed[j : j + m]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
            if 0 < j < n - 1:
                ok &= inner[j : j + m]
        if n == 2:
            ok &= inner[:m] | inner[1 : m + 1]
        at = np.flatnonzero(ok)
        out.append((h[at] & np.uint32(BUCKETS - 1)).astype(np.int64))
        whose.append(owner[np.where(inner[at], at, at + 1)])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(out), np.concatenate(whose)


def _text_chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    filled = [t or "" for t in texts]
    for a, b in chunks(np.array([len(t) for t in filled], np.int64), CHUNK_CHARS):
        yield a, filled[a:b]


@dataclass(frozen=True)
class LanguageModel:
    """Languages in alphabetical order, their log priors, and the matrix of log probabilities."""

    languages: list[str]
    log_prior: np.ndarray  # (languages,)
    log_prob: np.ndarray  # (languages, buckets)

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log joint probability of every text and language, and whether a text has any letter."""
        bucket, owner = ngram_buckets(texts)
        total = np.stack([np.bincount(owner, p[bucket], len(texts)).astype(float) for p in self.log_prob], axis=1)
        return total + self.log_prior, np.bincount(owner, minlength=len(texts)) > 0

    def blocks(self) -> Iterator[LanguageModel]:
        """The model in parts of at most BLOCK_LANGUAGES languages."""
        for k in range(0, len(self.languages), BLOCK_LANGUAGES):
            part = slice(k, k + BLOCK_LANGUAGES)
            yield LanguageModel(self.languages[part], self.log_prior[part], self.log_prob[part])


@dataclass
class Best:
    """The best language so far of each text: its name (null: none yet), its log joint probability, and the log of the sum over all."""

    name: list[str | None]
    top: np.ndarray
    mass: np.ndarray

    @staticmethod
    def none(n: int) -> Best:
        return Best([None] * n, np.full(n, -np.inf), np.full(n, -np.inf))

    def met(self, model: LanguageModel, texts: list[str | None]) -> Best:
        """The best of these and of the languages of `model`; earlier ones win ties."""
        names, top, mass = list(self.name), self.top.copy(), self.mass.copy()
        for a, part in _text_chunks(texts):
            total, seen = model.totals(part)
            best, at = total.argmax(axis=1), np.arange(len(part))
            high = total[at, best]
            span = slice(a, a + len(part))
            mass[span] = np.where(seen, np.logaddexp(mass[span], high + np.log(np.exp(total - high[:, None]).sum(axis=1))), -np.inf)
            better = seen & (high > top[span])
            top[span] = np.where(better, high, top[span])
            for k in np.flatnonzero(better).tolist():
                names[a + k] = model.languages[best[k]]
        return Best(names, top, mass)

    def result(self) -> tuple[list[str], np.ndarray]:
        """Name and posterior probability; `und` and 0 where there is none."""
        known = np.array([x is not None for x in self.name], bool)
        score = np.exp(np.where(known, self.top, 0.0) - np.where(known, self.mass, 0.0))
        return [x or "und" for x in self.name], np.where(known, np.minimum(score, 1.0), 0.0)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def even_bound(sizes: list[int], total: int) -> float:
    """The bound on each size at which all together are `total`, if they are more."""
    for k, n in enumerate(ordered := sorted(sizes)):
        if n * (len(ordered) - k) > total:
            return total / (len(ordered) - k)
        total -= n
    return float(max(sizes, default=0))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 100_000, smoothing: float = 0.5) -> LanguageModel:
    """Learn from labelled texts.

    `max_docs` bounds the labelled documents learned from (about so many, taken by a hash of
    the id, so the same ones at every run); below the bound all of them are used. Beyond it one
    bound holds for each language, so that a rare language is learned from in full.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    per_lang = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    total = sum(per_lang.values())
    if total > max_docs:
        most = even_bound(list(per_lang.values()), max_docs)
        share = F.create_map(*(F.lit(x) for name, n in per_lang.items() for x in (name, min(1.0, most / n))))
        draw = F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
        labelled = labelled.where(draw < F.try_element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, part in _text_chunks(texts):
                bucket, owner = ngram_buckets(part)
                own = sorted(set(langs[a : a + len(part)]))
                code = np.array([own.index(x) for x in langs[a : a + len(part)]])
                found = np.bincount(code[owner] * BUCKETS + bucket, minlength=len(own) * BUCKETS).reshape(len(own), BUCKETS)
                for k, name in enumerate(own):
                    sums[name] = sums.get(name, 0) + found[k]
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    rows = map_arrow(labelled.select("text", "lang"), count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(per_lang)
    prob = np.full((len(languages), BUCKETS), smoothing)
    if languages:
        place = {x: k for k, x in enumerate(languages)}
        lang = np.array([place[x] for x in rows.column("lang").to_pylist()], np.int64)
        prob[lang, rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    prob /= prob.sum(axis=1, keepdims=True)
    prior = np.array([per_lang[x] for x in languages], float)
    return LanguageModel(languages, np.log(prior / max(prior.sum(), 1.0)), np.log(prob, out=prob))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in `carry` and, under `names`, language and score; only the text is an input of the prediction.

    More languages than BLOCK_LANGUAGES are gone through in blocks, each with a pass of its own over staged
    rows, so that a worker holds one block of the matrix.
    """
    carry = tuple(c for c in carry if c not in names)
    kept = docs.select(*(F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(carry)), F.col(f"`{text_col}`").alias("__text"))
    inner = [f"__c{k} {x.dataType.simpleString()}" for k, x in enumerate(kept.schema.fields[:-1])]
    n, blocks = len(carry), list(model.blocks())

    def step(df: DataFrame, block: LanguageModel | None, first: bool, last: bool) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(n).to_pylist()
                best = Best.none(len(texts)) if first else Best(batch.column(n + 1).to_pylist(), *(batch.column(k).to_numpy() for k in (n + 2, n + 3)))
                if shared.value is not None:
                    best = best.met(shared.value, texts)
                if last:
                    name, score = best.result()
                    added = {"__name": pa.array(name, pa.string()), "__score": pa.array(score, pa.float64())}
                else:
                    added = {"__text": batch.column(n), "__name": pa.array(best.name, pa.string()), "__top": pa.array(best.top), "__mass": pa.array(best.mass)}
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *added.values()], [*batch.schema.names[:n], *added])

        return map_arrow(df, run, ", ".join([*inner, "__name string, __score double" if last else "__text string, __name string, __top double, __mass double"]))

    for k, block in enumerate(blocks[:-1]):
        kept = staged(step(kept, block, k == 0, False), "lang-block")
    found = step(kept, blocks[-1] if blocks else None, len(blocks) < 2, True)
    return found.toDF(*carry, *names)
