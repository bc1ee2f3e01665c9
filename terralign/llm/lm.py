"""Hidden Markov language model: Baum-Welch over the corpus, exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralign.llm.common import written
from terralign.llm.labelled import remainder

CLASSES = 2048
STATES = 8
END = 0
#: Training goes through a longer document piece by piece, to the same counts.
PIECE = 1 << 16
#: Documents side by side in the recursions, and the words of these together, at most (but one document at least).
LANES = 512
CELLS = 1 << 19
#: Words that emissions and backward probabilities are held for at once, at most (but one step at least).
BLOCK = 1 << 15
#: Rows and bytes of a batch between Spark and Python, at most (but one row at least), and rows that Parquet is read in.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries run inside hold few rows, and few bytes of long ones, at once in an executor."""
    before = {name: spark.conf.get(name) for name in BATCH}
    try:
        for name, value in BATCH.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def tokens(text: str | None) -> list[bytes]:
    """Words of a whole text: runs without ASCII white space, A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Words(dict):
    """Word -> number of its row in hashes and classes; emptied when full.

    A word's class is the hash of the word itself if short, else of its last three bytes and its length, of
    CLASSES - 1; class END is the end of the text. So classes are bounded, whatever the vocabulary.
    """

    LIMIT = 250_000

    def __init__(self):
        super().__init__()
        self.used = 0
        self.hashes = np.zeros(1024, np.int64)
        self.classes = np.zeros(1024, np.int32)

    def __missing__(self, word: bytes) -> int:
        n = self.used
        if n >= self.LIMIT:
            raise OverflowError
        if n >= len(self.hashes):
            self.hashes, self.classes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.classes))
        h = xxhash.xxh64_intdigest(word)
        self.hashes[n] = h - (1 << 64) if h >> 63 else h
        group = word if len(word) <= 4 else b"~%d" % min(len(word) // 4, 4) + word[-3:]
        self.classes[n] = 1 + xxhash.xxh32_intdigest(group) % (CLASSES - 1)
        self.used += 1
        if len(word) <= 64:  # longer ones aren't remembered
            self[word] = n
        return n

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and classes of words, in order; emptied first if they don't all fit."""
        try:
            at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        except OverflowError:
            self.clear()
            self.used = 0
            if len(words) > self.LIMIT // 2:
                half = len(words) // 2
                parts = self.of(words[:half]), self.of(words[half:])
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[at], self.classes[at]


_words = Words()


@dataclass
class Hmm:
    """Start, transition and emission probabilities of STATES states over CLASSES classes of words."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray = field(repr=False)

    @classmethod
    def initial(cls, frequency: np.ndarray, seed: int = 11) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = (frequency + 1.0) * np.exp(rng.standard_normal((STATES, CLASSES)))
        move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Hmm:
        """From summed expected counts, each with a little added so that nothing is impossible."""
        start, move, emit = np.split(counts, [STATES, STATES + STATES**2])
        start, move, emit = start + 0.1, move.reshape(STATES, STATES) + 0.1, emit.reshape(STATES, CLASSES) + 0.01
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _laid_out(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of documents of like length, side by side: (their numbers, classes step by step without gaps, how many are left at each step, where each step begins)."""
    lengths = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-lengths, kind="stable")
    before, at = np.concatenate([[0], np.cumsum(lengths[order])]), 0
    while at < len(order):
        group = order[at : max(at + 1, min(at + LANES, np.searchsorted(before, before[at] + CELLS, side="right") - 1))]
        at += len(group)
        sizes = lengths[group]
        left = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        begins = np.concatenate([[0], np.cumsum(left)])
        classes = np.empty(begins[-1], np.uint16)
        for lane, i in enumerate(group.tolist()):
            classes[begins[: lengths[i]] + lane] = docs[i]
        yield group, classes, left, begins


def _blocks(begins: np.ndarray) -> list[tuple[int, int]]:
    """Steps in blocks of at most BLOCK places, one step at least: (first, end)."""
    out, t = [], 0
    while t < len(begins) - 1:
        end = max(t + 1, int(np.searchsorted(begins, begins[t] + BLOCK, side="right")) - 1)
        out.append((t, end))
        t = end
    return out


def _filtered(a: np.ndarray | None, start: np.ndarray, move: np.ndarray, seen: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scaled forward recursion over steps that follow a (None: from the start): states' probabilities (state by place) and the factors taken out.

    seen: emissions (state by place). Places are as in _laid_out, from the first of these steps on.
    """
    alpha, scale, turned, at = np.empty_like(seen), np.empty(seen.shape[1], seen.dtype), np.ascontiguousarray(move.T), 0
    for k in left.tolist():
        out, c, to = alpha[:, at : at + k], scale[at : at + k], at + k
        if a is None:
            np.multiply(start[:, None], seen[:, at:to], out=out)
        else:
            np.matmul(turned, a[:, :k], out=out)
            out *= seen[:, at:to]
        np.add.reduce(out, axis=0, out=c)
        out /= c
        a, at = out, to
    return alpha, scale


def forward(model: Hmm, docs: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence of classes, in double precision; a long one goes block by block."""
    out = np.zeros(len(docs))
    for group, classes, left, begins in _laid_out(docs):
        a = None
        for t, end in _blocks(begins):
            alpha, scale = _filtered(a, model.start, model.move, model.emit.take(classes[begins[t] : begins[end]], axis=1, mode="clip"), left[t:end])
            lane = np.arange(len(scale)) - np.repeat(begins[t:end] - begins[t], left[t:end])
            out[group] += np.bincount(lane, np.log10(scale), minlength=len(group))
            a = alpha[:, len(scale) - left[end - 1] :].copy()
    return out


def expected(model: Hmm, docs: list[np.ndarray]) -> np.ndarray:
    """Expected counts of starts, moves and emissions, in one array, by the scaled forward-backward recursion.

    Single precision within sequences, double for the sums. The states' forward
    probabilities are held for a group of documents, all else for a block of steps.
    """
    starts, moved, weights = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
    start, move, emit = (x.astype(np.float32) for x in (model.start, model.move, model.emit))
    for _, classes, left, begins in _laid_out(docs):
        alphas, scales, blocks, a = np.empty((STATES, begins[-1]), np.float32), np.empty(begins[-1], np.float32), _blocks(begins), None
        for t, end in blocks:
            here = slice(begins[t], begins[end])
            alphas[:, here], scales[here] = _filtered(a, start, move, emit.take(classes[here], axis=1, mode="clip"), left[t:end])
            a = alphas[:, begins[end - 1] : begins[end]]
        after = None  # what the block's last step moves to
        for t, end in reversed(blocks):
            here, sizes, places = slice(begins[t], begins[end]), left[t:end].tolist(), (begins[t : end + 1] - begins[t]).tolist()
            alpha, seen = alphas[:, here], emit.take(classes[here], axis=1, mode="clip")  # emissions of every place
            seen /= scales[here]
            beta = np.ones_like(seen)
            if after is not None:
                last = slice(places[-2], places[-2] + after.shape[1])
                np.matmul(move, after, out=beta[:, last])
                moved += alpha[:, last] @ after.T
            for u in range(end - t - 1, -1, -1):
                ahead = seen[:, places[u] : places[u + 1]]
                ahead *= beta[:, places[u] : places[u + 1]]
                if u:
                    np.matmul(move, ahead, out=beta[:, places[u - 1] : places[u - 1] + sizes[u]])
            after = seen[:, : sizes[0]].copy()
            # From each step to the next: together where equally many are left, some places at a time.
            for v, n in zip(*_runs(left[t:end]), strict=True):
                k, some = sizes[v], max(1, (1 << 14) // sizes[v])
                for u in range(v, v + n, some):
                    steps = min(some, v + n - u)
                    moved += alpha[:, places[u - 1] : places[u - 1] + steps * k] @ seen[:, places[u] : places[u] + steps * k].T
            beta *= alpha  # now the states' probabilities
            if not t:
                starts += beta[:, : sizes[0]].sum(axis=1, dtype=float)
            for s in range(STATES):
                weights[s] += np.bincount(classes[here], beta[s], minlength=CLASSES)
    return np.concatenate([starts, (moved * model.move).ravel(), weights.ravel()])


def _runs(left: np.ndarray) -> tuple[list[int], list[int]]:
    """Steps after the first, in runs at which as many documents are left as at the step before each: (first steps, lengths). A step at which some have ended is a run of its own."""
    same = left[1:] == left[:-1]
    first = np.flatnonzero(~(same & np.concatenate([[False], same[:-1]]))) + 1
    return first.tolist(), np.diff(np.append(first, len(left))).tolist()


def expected_long(model: Hmm, seq: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """The counts of expected() for one sequence of any length, with memory for one piece.

    Forward once, keeping the states before each piece; then, from the last piece to
    the first, forward again and backward from where the piece after it ended.
    """
    start, moved, weights = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
    emit, entry, a = np.ascontiguousarray(model.emit.T), [], model.start
    for at in range(0, len(seq), piece):
        entry.append(a)
        for c in seq[at : at + piece]:
            a = a * emit[c]
            a = (a / a.sum()) @ model.move
    ahead = None
    for k in reversed(range(len(entry))):
        part, a = seq[k * piece : (k + 1) * piece], entry[k]
        alpha, scale = np.empty((len(part), STATES)), np.empty(len(part))
        for t, c in enumerate(part):
            a = a * emit[c]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
            a = alpha[t] @ model.move
        for t in reversed(range(len(part))):
            beta = np.ones(STATES)
            if ahead is not None:
                moved += np.outer(alpha[t], ahead)
                beta = model.move @ ahead
            ahead = emit[part[t]] * beta / scale[t]
            weights[part[t]] += alpha[t] * beta
            if not k and not t:
                start += alpha[t] * beta
    return np.concatenate([start, (moved * model.move).ravel(), weights.T.ravel()])


def expected_counts(docs: DataFrame, model: Hmm) -> np.ndarray:
    """Expected counts over all sequences (seq): tasks sum their own, Spark adds them up by place, at most one row for each comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(STATES + STATES**2 + STATES * CLASSES), [], 0
        for batch in batches:
            for x in batch.column(0):
                seq = np.frombuffer(x.as_buffer(), "<u2")
                if len(seq) > PIECE:
                    total += expected_long(shared.value, seq)
                    continue
                held.append(seq)
                n += len(seq)
                if n >= 4 * CELLS:
                    total += expected(shared.value, held)
                    held, n = [], 0
        if held:
            total += expected(shared.value, held)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(total[on])], names=["place", "n"])

    total = np.zeros(STATES + STATES**2 + STATES * CLASSES)
    for r in docs.select("seq").mapInArrow(counted, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).collect():
        total[r["place"]] = r["n"]
    shared.unpersist()
    return total


def baum_welch(docs: DataFrame, model: Hmm) -> Hmm:
    """One round over all sequences (seq)."""
    return Hmm.of_counts(expected_counts(docs, model))


def trained(docs: DataFrame, model: Hmm, rounds: int, slices: int, tasks: int) -> Hmm:
    """Rounds of incremental Baum-Welch, each over all sequences (seq) of slices numbered from 0 (slice).

    After each slice its expected counts take the place of those that it had, and the
    model is made anew from the sum over slices. So every sequence counts once, as in
    a whole round, but the model improves as often as there are slices.
    """
    counts = np.zeros((slices, STATES + STATES**2 + STATES * CLASSES))
    for _ in range(rounds):
        for k in range(slices):
            counts[k] = expected_counts(docs.where(F.col("slice") == k).coalesce(tasks), model)
            if counts.any():
                model = Hmm.of_counts(counts.sum(axis=0))
    return model


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def read_texts(docs: DataFrame, key: str, text: str, training: Column) -> DataFrame:
    """Each document once, with nothing left to tokenize: row (a number), training, seq (its classes and the end, two bytes each), and its distinct words as h, class, tf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                seq, hashes, classes, times = [], [], [], []
                for value in part.column(2):
                    h, c = _words.of(tokens(value.as_py()))
                    seq.append(np.append(c, END).astype("<u2").tobytes())
                    h, first, tf = np.unique(h, return_index=True, return_counts=True)
                    hashes.append(h)
                    classes.append(c[first])
                    times.append(tf)
                rows = np.arange(row, row + part.num_rows)
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(rows), pa.array(seq, pa.binary()), _lists(hashes, pa.int64()), _lists(classes, pa.int16()), _lists(times, pa.int32())], names=["_key", "training", "row", "seq", "h", "class", "tf"])

    rows = docs.select(F.col(key).alias("_key"), F.coalesce(training, F.lit(False)).alias("training"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, training boolean, row long, seq binary, h array<long>, class array<smallint>, tf array<int>")


def vocabulary(read: DataFrame) -> DataFrame:
    """Every word of the training documents: h (its 64-bit hash), class, c (how often). Tasks count first, Spark adds up."""

    def summed(held: list) -> pa.RecordBatch:
        h, c, tf = (np.concatenate([x[k] for x in held]) for k in range(3))
        h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(inverse, tf, minlength=len(h)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c[first].astype(np.int32)), pa.array(n)], names=["h", "class", "c"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(k).flatten().to_numpy() for k in range(3)])
            n += len(held[-1][0])
            if n >= 1_000_000:
                yield summed(held)
                held, n = [], 0
        if held:
            yield summed(held)

    rows = read.where("training").select("h", "class", "tf").mapInArrow(counted, "h long, class int, c long")
    return rows.groupBy("h").agg(F.first("class").alias("class"), F.sum("c").alias("c"))


def _parts(read: DataFrame, model: Hmm, common: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> DataFrame:
    """For each document what its task can tell alone, and its words that are not among the common ones."""
    shared = read.sparkSession.sparkContext.broadcast((model, common, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, (known_h, known_c), log_weights = shared.value
        log_c = np.log10(known_c + 1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                seqs = [np.frombuffer(x.as_buffer(), "<u2") for x in part.column(2)]
                h, tf = (part.column(k).flatten().to_numpy() for k in (3, 4))
                sizes = np.diff(part.column(3).offsets.to_numpy())
                doc = np.repeat(np.arange(len(seqs)), sizes)
                i = np.minimum(np.searchsorted(known_h, h), max(len(known_h) - 1, 0))
                hit = known_h[i] == h if len(known_h) else np.zeros(len(h), bool)
                known = np.bincount(doc[hit], tf[hit], minlength=len(seqs)).astype(np.int64)
                lg = np.bincount(doc[hit], tf[hit] * log_c[i[hit]] if hit.any() else None, minlength=len(seqs)).astype(float)
                n = np.array([len(x) for x in seqs], np.int64)
                within = np.array([log_weights[x].sum() for x in seqs])
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=len(seqs)))]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit], kind)) for x, kind in ((h, pa.int64()), (tf, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(n), pa.array(known), pa.array(lg), pa.array(forward(hmm, seqs) + within), *lists], names=["_key", "row", "n", "known", "lg", "model", "h", "tf"])

    kind = read.schema["_key"].dataType.simpleString()
    return read.select("_key", "row", "seq", "h", "tf").mapInArrow(run, f"_key {kind}, row long, n long, known long, lg double, model double, h array<long>, tf array<int>")


def _frequent(words: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray], Column]:
    """At most that many of the most frequent words (hashes in order, counts), and the condition for all others.

    Cut at a step of a histogram of counts, so nothing is sorted as a whole.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    bins = sorted((r["b"], r["n"]) for r in words.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect())  # 16 rows a doubling of the count
    taken, cut = 0, (bins[-1][0] if bins else 0) + 1
    for b, n in reversed(bins):
        if (taken := taken + n) > most:
            break
        cut = b
    top = words.where(step >= cut).select("h", "c").toArrow()
    order = np.argsort(h := top["h"].to_numpy())
    return (h[order], top["c"].to_numpy()[order]), step < cut


def scored(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", rounds: int = 3, slices: int = 4, common_words: int = 1 << 19) -> DataFrame:
    """Log10 probabilities of every whole text, learnt from the rows where training holds.

    The model: hidden states emit classes of words; a class emits each of its words
    in proportion to its count plus 1, with one such share for all words not seen.
    Baum-Welch runs rounds over every training document, slice by slice (by hash of key
    and classes), and its last counts cover them all, as word counts do. At most common_words of the most
    frequent words are broadcast; the rest, which may be any number, meet the counts in a join.
    Words are told apart by 64-bit hashes.

    Returns key, n_tokens (words and one end), n_known (those seen in training),
    train_tokens, base_score (add-one unigrams) and score (the model). Null and empty
    texts are the end alone; very long texts are whole in training and scoring; repeated rows are scored each; null keys pass through;
    without training rows every word is unknown; an empty table gives no rows; other
    columns are ignored.
    """
    with small_batches(docs.sparkSession):
        read = written(read_texts(docs, key, text, training).withColumn("slice", F.pmod(F.xxhash64("_key", "seq"), F.lit(slices)).cast("int")), rows=512)
        words = written(vocabulary(read), rows=512)
        ends = read.where("training").count()
        by_class = words.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # at most CLASSES rows
        frequency, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in by_class:
            frequency[r["class"]], kinds[r["class"]] = r["c"], r["v"]
        total, distinct = int(frequency.sum()) + ends, int(kinds.sum()) + (ends > 0)
        weights = -np.log10(frequency + kinds + 1)
        weights[END] = 0.0  # a class of one
        common, others = _frequent(words, common_words)

        frequency[END] = ends
        model = Hmm.initial(frequency)
        if ends:
            # Long runs of sequences for each task: few of them side by side take longer.
            tasks = max(1, min(docs.sparkSession.sparkContext.defaultParallelism, total >> 23), total >> 27)
            model = trained(read.where("training").select("seq", "slice"), model, rounds, slices, tasks)

        parts = written(_parts(read, model, common, weights), rows=2048)

    rare = parts.select("row", F.explode(F.arrays_zip("h", "tf")).alias("w")).select("row", "w.h", "w.tf")
    seen = words.where(others).select("h", "c")
    told = rare.join(seen, "h").groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("lg2"), F.sum("tf").alias("known2"))
    lg = F.col("lg") + F.coalesce("lg2", F.lit(0.0)) + F.lit(float(np.log10(ends + 1)))
    return parts.drop("h", "tf").join(told, "row", "left").select(
        F.col("_key").alias(key),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("known2", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (lg - F.col("n") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        (F.col("model") + lg - F.lit(float(np.log10(ends + 1)))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents, learning where crc32(doc_id) mod 7 is not 2."""
    held = remainder(F.col("doc_id"), 7) == 2
    out = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
