"""Removal of words that stand in repeated substrings, found by recompression.

Every text becomes a sequence of names, one for each word. In each round runs of one
name, and then pairs of neighbouring names of which the first is of one half of all
names and the second of the other, are replaced by new names. A new name is computed
from the names that it replaces (64 bits), so that all tasks give equal strings equal
names without a table that would have to be joined. Spark counts the names over all
documents and brings together the places of those that occur again.

A name also knows its context: the words on which it depended that it was formed, as
it stands, at this place. Wherever the words of the context stand again, the name
stands again in the same place. So equal windows hold equal names (those whose context
is inside), and choosing the longest of them makes equal windows choose the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralign.llm.common import looked_up, spare, written

WORDS = 35
ROUNDS = 3
#: Names of fewer words are chosen only by windows that hold no longer one.
LEAST = 4
#: Words handled at a time; a longer text is taken in pieces that overlap by a window.
PIECE = 1 << 17
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, one to one, so that near ones are far apart."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Names(dict):
    """Word -> its 64-bit name; emptied when full, very long words are not remembered."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), U, len(words))


_names = Names()


def _beside(widest: np.ufunc, x: np.ndarray) -> np.ndarray:
    """The least or greatest of each value and the two beside it."""
    out = x.copy()
    out[1:] = widest(out[1:], x[:-1])
    out[:-1] = widest(out[:-1], x[1:])
    return out


def compressed(name: np.ndarray, live: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """All names formed of a sequence in the given rounds: name, start, end, and the context's left and right, each an array.

    Places that aren't live stand before, between and after texts: nothing is formed
    across them, and no context that reaches one lies in a window.
    """
    start = np.arange(len(name), dtype=np.int32)
    end, left, right = start + np.int32(1), start, start + np.int32(1)
    found = []
    for r in range(rounds):
        # Runs. Where a run begins and ends is seen by the names beside it.
        again = np.zeros(len(name), bool)
        again[1:] = (name[1:] == name[:-1]) & live[1:] & live[:-1]
        first = np.flatnonzero(~again)
        last = np.append(first[1:] - 1, len(name) - 1)
        size = last - first + 1
        name = np.where(size > 1, mixed(name[first] * U(3) + size.astype(U)), name[first])
        left, right = np.minimum.reduceat(_beside(np.minimum, left), first), np.maximum.reduceat(_beside(np.maximum, right), first)
        start, end, live = start[first], end[last], live[first]
        run = np.flatnonzero(size > 1)
        found.append((name[run], start[run], end[run], left[run], right[run]))
        # Pairs. A name of the first half depends on what follows, one of the second on what comes before.
        for half in (1, 2):
            one = (mixed(name + U(2 * r + half)) >> U(17) & U(1)).astype(bool) & live
            two = ~one & live
            new_left, new_right = left.copy(), right.copy()
            for new, old, widest in ((new_left, left, np.minimum), (new_right, right, np.maximum)):
                new[:-1] = np.where(one[:-1], widest(old[:-1], old[1:]), old[:-1])
                new[1:] = np.where(two[1:], widest(old[1:], old[:-1]), new[1:])
            head = np.flatnonzero(one[:-1] & two[1:])
            name, end = name.copy(), end.copy()
            name[head], end[head] = mixed(name[head] * U(5) + mixed(name[head + 1] + U(7))), end[head + 1]
            found.append((name[head], start[head], end[head], new_left[head], new_right[head]))
            kept = np.ones(len(name), bool)
            kept[head + 1] = False
            name, start, end, left, right, live = (x[kept] for x in (name, start, end, new_left, new_right, live))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _greatest(low: np.ndarray, high: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the greatest value of the ranges low to high that hold it, -1 if none does."""
    width = high - low + 1
    level = np.frexp(width.astype(float))[1] - 1  # of the largest power of two that isn't above the width
    over = np.full(n, -1, np.int64)
    for k in range(int(level.max(initial=0)), -1, -1):
        down = np.full(n, -1, np.int64)
        at = level == k
        np.maximum.at(down, low[at], value[at])
        np.maximum.at(down, high[at] + 1 - (1 << k), value[at])
        np.maximum(over, down, out=over)
        if k:
            half = 1 << (k - 1)
            shifted = over.copy()
            shifted[half:] = np.maximum(shifted[half:], over[:-half])
            over = shifted
    return over


def anchored(words: np.ndarray, live: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of size words within one text: where each starts, and the name, start and end of what it has chosen.

    Chosen is the longest name whose context the window holds, of equally long ones the
    one with the largest hash, of equal ones the first that was formed; in windows without
    a name of LEAST words, the word with the largest hash.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.concatenate([[0], np.cumsum(~live)])
    whole = np.flatnonzero(gaps[size:] == gaps[:-size])
    name, start, end, left, right = compressed(words, live)
    low, high = np.maximum(right - size, 0), np.minimum(left, n - 1)
    fits = np.flatnonzero((end - start >= LEAST) & (low <= high))
    rank = (np.minimum(end - start, 63).astype(np.int64)[fits] << 57) | ((mixed(name[fits]) >> U(33)).astype(np.int64) << 26) | (len(fits) - 1 - np.arange(len(fits)))
    best = _greatest(low[fits], high[fits], rank, n)[whole]
    none = best < 0
    if not none.any():
        chosen = fits[len(fits) - 1 - (best & ((1 << 26) - 1))]
        return whole, name[chosen], start[chosen].astype(np.int64), end[chosen].astype(np.int64)
    place = np.arange(len(words))
    rank = ((mixed(words) >> U(33)).astype(np.int64) << 26) | (len(words) - place)
    word = len(words) - (_greatest(np.maximum(place - size + 1, 0), np.minimum(place, n - 1), rank, n)[whole] & ((1 << 26) - 1))
    if none.all():
        return whole, words[word], word, word + 1
    chosen = fits[len(fits) - 1 - (np.where(none, 0, best) & ((1 << 26) - 1))]
    return whole, np.where(none, words[word], name[chosen]), np.where(none, word, start[chosen]), np.where(none, word + 1, end[chosen])


def rests(words: np.ndarray, window: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the words of each window to the left and to the right of what it has chosen, and of where that stands."""
    base = U(0x9E3779B97F4A7C15)
    power = np.cumprod(np.full(len(words), base))
    back = np.cumprod(np.full(len(words) + 1, U(pow(int(base), -1, 1 << 64)))) * base
    sums = np.concatenate([[U(0)], np.cumsum(mixed(words) * power)])
    before = (sums[start] - sums[window]) * back[window]
    after = (sums[window + size] - sums[end]) * back[end]
    return mixed(mixed(before + U(1)) * U(3) + mixed(after + U(2)) * U(5) + (start - window).astype(U))


def _flat(texts: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts side by side, with a gap before and after each, some words at a time: words, live, number of the text, place in it."""
    held: list[tuple[np.ndarray, int, int]] = []
    total = 0

    def flat():
        gap = np.zeros(1, U)
        words = np.concatenate([*(x for part, _, _ in held for x in (gap, part)), gap])
        sizes = np.array([len(part) + 1 for part, _, _ in held])
        begin = np.cumsum(sizes) - sizes
        live = np.ones(len(words), bool)
        live[begin] = live[-1] = False
        number = np.repeat(np.array([d for _, d, _ in held]), sizes)
        place = np.arange(len(words) - 1) - np.repeat(begin + 1 - np.array([lo for _, _, lo in held]), sizes)
        return words, live, number, place

    for d, text in enumerate(texts):
        for lo in range(0, len(text) - size + 1, PIECE):
            part = text[lo : lo + PIECE + size - 1]
            held.append((part, d, lo))
            total += len(part)
            if total >= PIECE:
                yield flat()
                held, total = [], 0
    if held:
        yield flat()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def names_of(docs: DataFrame, text: str, size: int) -> DataFrame:
    """docs without text, with row (a number), n_words, and the distinct names that its windows choose, with their number of places: names, places."""
    at = docs.columns.index(text)
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest, F.lit(0).cast("long").alias("_row"), F.lit(0).cast("long").alias("_n_words"), F.array().cast("array<long>").alias("_names"), F.array().cast("array<int>").alias("_places")).schema
    fields = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [_names.of(x or b"") for x in batch.column(at).cast(pa.binary()).to_pylist()]
            whose, chosen = [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for words, live, number, place in _flat(texts, size):
                window, name, start, _ = anchored(words, live, size)
                new = np.ones(len(window), bool)
                new[1:] = (start[1:] != start[:-1]) | (name[1:] != name[:-1])
                window, name, start = window[new], name[new], start[new]
                # of a place that is chosen again after another, and of a piece's last place, too
                _, once = np.unique(np.stack([start.astype(np.int64), name.view(np.int64)]), axis=1, return_index=True) if len(start) else (None, np.zeros(0, int))
                whose.append(number[window[once]])
                chosen.append(name[once])
                del words, live, place
            whose, chosen = np.concatenate(whose), np.concatenate(chosen)
            order = np.lexsort((chosen, whose))
            whose, chosen = whose[order], chosen[order]
            new = np.ones(len(whose), bool)
            new[1:] = (whose[1:] != whose[:-1]) | (chosen[1:] != chosen[:-1])
            first = np.flatnonzero(new)
            places = np.diff(np.append(first, len(whose))).astype(np.int32)
            offsets = pa.array(np.searchsorted(whose[first], np.arange(len(texts) + 1)).astype(np.int32))
            made = [pa.array(row + np.arange(len(texts))), pa.array([len(x) for x in texts], pa.int64()), pa.ListArray.from_arrays(offsets, _signed(chosen[first])), pa.ListArray.from_arrays(offsets, pa.array(places))]
            row += len(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], names=fields)

    return docs.mapInArrow(run, schema)


def spans_of(docs: DataFrame, size: int) -> DataFrame:
    """Where texts (_row, _text, _names: names that occur again) hold windows whose choice is one of these names: name, span, row, at, rests.

    Consecutive windows that have chosen the same name in the same place are a span. rests
    has the rest of each of them, span a hash of all of these; at is the first window's word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            texts = [_names.of(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
            again = [np.sort(np.asarray(x.values.to_numpy()).view(U)) for x in batch.column(2)]
            for words, live, number, place in _flat(texts, size):
                window, name, start, end = anchored(words, live, size)
                of = number[window]
                bounds = np.searchsorted(of, np.arange(len(texts) + 1))
                take = np.zeros(len(window), bool)
                for d in np.unique(of):
                    lo, hi = bounds[d], bounds[d + 1]
                    k = np.searchsorted(again[d], name[lo:hi])
                    take[lo:hi] = again[d][np.minimum(k, len(again[d]) - 1)] == name[lo:hi]
                window, name, start, end = (x[take] for x in (window, name, start, end))
                rest = rests(words, window, start, end, size)
                new = np.ones(len(window), bool)
                new[1:] = (window[1:] != window[:-1] + 1) | (start[1:] != start[:-1]) | (name[1:] != name[:-1])
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                inside = np.arange(len(window)) - np.repeat(first, np.diff(np.append(first, len(window))))
                span = np.add.reduceat(mixed(rest + inside.astype(U) * U(0x9E3779B97F4A7C15)), first)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(window)).astype(np.int32)), _signed(rest))
                at = window[first]
                made = [_signed(name[first]), _signed(span), pa.array(rows[number[at]]), pa.array(place[at].astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays(made, names=["name", "span", "row", "at", "rests"])

    return docs.select("_row", "_text", "_names").mapInArrow(run, "name long, span long, row long, at int, rests array<long>")


def _identity(key: str, text: str) -> list:
    """Columns that tell documents apart: two hashes of the text and one of the key."""
    value = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(value).alias("_t"), F.xxhash64(F.lit(1), value).alias("_u"), F.xxhash64(F.col(key).cast("string")).alias("_k")]


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """Where documents hold a window of size words that starts elsewhere too: _t, _u, _k (see _identity), _all, _at.

    _all: the whole text stands elsewhere too; else _at has the first word of each such
    window. Documents without any are left out.

    1. Rounds of recompression name runs and pairs; every window chooses a name.
    2. Spark counts the chosen names over all documents. Windows whose name stands in one
       place only repeat nothing and are done with.
    3. Windows that share a name are equal if the name stands at the same place in them
       and what is left and right of it is equal. Spark counts whole spans of windows
       around a name; those that occur again are repeated as they are. Of the others, where
       a name has several, single windows are counted.

    Texts that are equal as a whole are compared with others only once.
    """
    who = ["_t", "_u", "_k"]
    base = docs.select(*_identity(key, text), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    told = written(names_of(base, "_text", size).where(F.col("_n_words") >= size), 512)
    copies = written(told.groupBy("_t", "_u").agg(F.count("*").alias("_copies"), F.min("_row").alias("_first")).where("_copies > 1"))
    known = looked_up(told.select(*who, "_row"), copies, ["_t", "_u"], "_copies")
    known = known.select(*who, "_row", F.coalesce("_first", "_row").alias("_first"), F.col("_copies").isNotNull().alias("_all"))

    chosen = told.select("_row", F.explode(F.arrays_zip("_names", "_places")).alias("c")).select("_row", F.col("c._names").alias("name"), F.col("c._places").alias("places"))
    shared = written(chosen.groupBy("name").agg(F.sum("places").alias("_places"), F.count("*").alias("_rows")).where("_places > 1"))
    again = looked_up(chosen, shared, ["name"], "_rows").where("_places is not null")
    again = again.groupBy("_row").agg(F.collect_list("name").alias("_names"))
    again = again.join(known.where("_row = _first"), "_row")
    # Rows equal in key and text are joined each, and then counted as the repeats that they are.
    spans = written(spans_of(base.join(again, who), size), 256)
    kinds = written(spans.groupBy("name", "span").agg(F.count("*").alias("_n"), F.first("rests").alias("rests"), F.min(F.struct("row", "at")).alias("place")))
    repeats = kinds.where("_n > 1").select("name", "span", "_n")
    whole = looked_up(spans.select("name", "span", "row", "at", F.size("rests").alias("n")), repeats, ["name", "span"], "_n").where("_n is not null")
    several = written(kinds.groupBy("name").agg(F.count("*").alias("_kinds")).where("_kinds > 1"))
    mixed_ = looked_up(kinds.select("name", "_n", "rests", "place"), several, ["name"], "_kinds").where("_kinds is not null")
    windows = written(mixed_.select("name", "_n", "place", F.posexplode("rests").alias("i", "rest")).select("name", "rest", "_n", F.col("place.row").alias("row"), (F.col("place.at") + F.col("i")).alias("at")))
    equal = written(windows.groupBy("name", "rest").agg(F.count("*").alias("_m")).where("_m > 1"))
    single = looked_up(windows.where("_n = 1").select("name", "rest", "row", "at"), equal, ["name", "rest"], "_m").where("_m is not null")
    hits = whole.select("row", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at")).unionByName(single.select("row", "at"))
    at = hits.groupBy(F.col("row").alias("_row")).agg(F.sort_array(F.collect_set("at")).alias("_at"))
    some = known.where("not _all").join(at, "_row").select(*who, "_all", "_at")
    return known.where("_all").select(*who, "_all", F.lit(None).cast("array<int>").alias("_at")).unionByName(some).dropDuplicates(who)


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """docs with every word removed that a repeated window covers; text is what is left, one space between words; n_words, n_removed.

    Words are what stands between ASCII white space, as they are. A window is size
    consecutive words of one document; it is repeated if its words also start anywhere
    else, in the same document (overlapping or not) or another. All windows are judged on
    the texts as given. A null text has no words and stays null; an empty or blank one
    becomes empty; texts of any length are whole; rows equal in key and text repeat each
    other; an empty table gives no rows. Other columns pass through, those named n_words
    or n_removed as _own_n_words and _own_n_removed.
    """
    named = docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c.lower() in ("n_words", "n_removed")})
    who = [spare(named, f"_who{i}") for i in range(3)]
    whole, at = spare(named, "_all"), spare(named, "_at")
    found = repeated(docs, key, text, size).toDF(*who, whole, at)
    held = named.select("*", *(c.alias(w) for c, w in zip(_identity(key, text), who, strict=True)))
    held = held.join(found, who, "left").select(*named.columns, whole, at)
    place = named.columns.index(text)
    schema = named.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    fields = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, removed = [], [], []
            for value, gone, starts in zip(batch.column(place).cast(pa.binary()).to_pylist(), batch.column(len(fields) - 2).to_pylist(), batch.column(len(fields) - 1), strict=True):
                words = (value or b"").split()
                totals.append(len(words))
                if gone:
                    words = []
                elif starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    first = starts.values.to_numpy()
                    edge[first] += 1
                    edge[first + size] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                removed.append(totals[-1] - len(words))
                texts.append(None if value is None else b" ".join(words))
            columns = [batch.column(i) for i in range(len(fields) - 2)]
            columns[place] = pa.array(texts, pa.binary()).cast(columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=fields)

    return held.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: what is left of every document without the words of repeated windows of 35 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduped(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
