"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralign.llm.common import written
from terralign.llm.labelled import remainder, sample

BITS = 20
MASK = (1 << BITS) - 1
ALWAYS = 0
AROUND = " \t\r\n.,;:!?\"'`()[]{}<>|*&$%#@~^_=+-/\\"


class Words(dict):
    """Word -> row of hashes: of the word in lower case without what stands around it, and of its first 4 and 6 letters."""

    LIMIT = 300_000

    def __init__(self):
        super().__init__()
        self.used = 0
        self.rows = np.zeros((1024, 3), np.uint32)

    def __missing__(self, word: str) -> int:
        n = self.used
        if n >= self.LIMIT:
            raise OverflowError
        if n >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        core = (word.strip(AROUND) or word).lower().encode("utf-8", "surrogatepass")
        text = core.decode("utf-8", "surrogatepass")
        self.rows[n] = zlib.crc32(core), zlib.crc32(b"4" + text[:4].encode("utf-8", "surrogatepass")), zlib.crc32(b"6" + text[:6].encode("utf-8", "surrogatepass"))
        self.used += 1
        if len(word) <= 64:  # longer ones aren't remembered
            self[word] = n
        return n

    def of(self, words: list[str]) -> np.ndarray:
        """Hashes of words, one row each. The memory is emptied when full; more words than it holds are taken in parts."""
        try:
            at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        except OverflowError:
            self.clear()
            self.used = 0
            step = self.LIMIT // 2
            if len(words) > step:
                return np.concatenate([self.of(words[a : a + step]) for a in range(0, len(words), step)])
            at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.rows[at]


_words = Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(13))) & np.uint32(MASK)).astype(np.int64)


def features(text: str) -> list[np.ndarray]:
    """Hashed features of a whole text, with repeats: words, their beginnings, bigrams, and skip-grams over one and two words."""
    words = text.split()
    if not words:
        return []
    rows = _words.of(words)
    w, a = rows[:, 0], np.uint32(0x9E3779B1)
    out = [_mix(rows[:, k] + np.uint32(k)) for k in range(3)]
    for gap in (1, 2, 3):
        if len(w) > gap:
            out.append(_mix(w[:-gap] * a + (w[gap:] ^ np.uint32(gap * 0x2545F)) * np.uint32(0xC2B2AE35)))
    return out


@dataclass
class Ftrl:
    """FTRL-proximal (McMahan et al. 2013): per-coordinate rates, L1 and L2. Holds z and n for 2^BITS coordinates."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.0

    def __post_init__(self):
        self.z, self.n = np.zeros(MASK + 1), np.zeros(MASK + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


def fit(labelled: DataFrame, epochs: int = 5, shard_rows: int = 8000, shard_chars: int = 64_000_000) -> dict[int, float]:
    """Sparse weights from a bounded sample (y, _text).

    One shard, and task, for each shard_rows documents or shard_chars characters (whichever
    makes more shards) runs FTRL over its own; the shards' weights are averaged by
    coordinate. A task holds the distinct features of its texts as 32-bit numbers, a few
    for each word: so it is bounded by shard_chars, and a single longer text by 2^BITS. The L1 strength is a hundredth of a shard's
    positive documents, 1 to 5: a feature needs evidence of its own to have any
    weight, and small samples cannot give as much. What comes to the driver is at
    most one row for each of 2^BITS coordinates, and few are not 0.
    """
    n, positive, chars = labelled.agg(F.count("*"), F.sum("y"), F.sum(F.char_length("_text"))).first()
    if not n:
        return {}
    shards = max(-(-n // shard_rows), -(-(chars or 0) // shard_chars))
    l1 = min(5.0, max(1.0, (positive or 0) / shards / 100))
    dealt = labelled.select("y", "_text", F.xxhash64("_text").alias("_o"))
    dealt = dealt.withColumn("_s", F.pmod("_o", F.lit(shards)).cast("int")).repartitionById(shards, "_s")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict[int, list] = {}
        for batch in batches:
            for s, o, y, t in zip(*(batch.column(k).to_pylist() for k in ("_s", "_o", "y", "_text")), strict=True):
                at = np.unique(np.concatenate([np.zeros(1, np.int64), *features(t)])).astype(np.int32)
                shard.setdefault(s, []).append((o, y, at))
        for docs in shard.values():
            docs.sort(key=lambda d: d[:2])
            model = Ftrl(l1=l1)
            rng = np.random.default_rng(len(docs))
            for _ in range(epochs):
                for i in rng.permutation(len(docs)):
                    model.learn(docs[i][2], docs[i][1])
            w = model.weights()
            on = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(w[on])], names=["f", "w"])

    rows = dealt.mapInArrow(train, "f long, w double").groupBy("f").agg(F.sum("w").alias("w")).collect()
    return {r["f"]: r["w"] / shards for r in sorted(rows)}


def scored(docs: DataFrame, weights: dict[int, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of each row by its whole text; each feature counts once a text. Null and empty texts get the score of the constant."""
    table = np.zeros(MASK + 1, np.float32)
    table[list(weights)] = list(weights.values())
    on = np.flatnonzero(table)
    shared = docs.sparkSession.sparkContext.broadcast((on, table[on]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(MASK + 1, np.float32)
        table[shared.value[0]] = shared.value[1]
        for batch in batches:
            sums = np.full(batch.num_rows, float(table[ALWAYS]))
            for row, value in enumerate(batch.column(1)):
                hit = [f[table[f] != 0] for f in features(value.as_py() or "")]
                if hit and len(found := np.unique(np.concatenate(hit))):
                    sums[row] += float(table[found[found != ALWAYS]].sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))), pa.float64())], names=["_key", "score"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, score double").withColumnRenamed("_key", key)


def trained(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", limits: tuple[int, int] = (16384, 8192)) -> dict[int, float]:
    """Weights from at most limits[y] labelled documents of each class y, of those allowed. Without labels all weights are 0."""
    return fit(written(sample(docs, labels, key, text, label, allowed, dict(enumerate(limits)))))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document's toxicity, learnt where crc32(doc_id) mod 4 is not 2."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = remainder(F.col("doc_id"), 4) == 2
    out = scored(docs, trained(docs, labels, ~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
