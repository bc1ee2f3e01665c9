"""Packing of tokenized documents into fixed-length sequences: dominance reduction, then best fit."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralign.llm.common import ranked, written

END = (0).to_bytes(4, "little")


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task one core
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


#: Latin-1 letters: they are NFC as they stand, and lowering maps each to one letter.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Longer strings aren't remembered.
KEPT = 64


class Memory:
    """A bounded memory of strings and their ids: two generations, of which the older is dropped."""

    def __init__(self, limit: int):
        self.limit = limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= KEPT:
            self.new[key] = value

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.new[key] = found
        return found


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes, by way of a bounded memory of words.

    The tokenizer never joins text across white space, so a text's ids are those of
    its words in turn; and a word's are those of its leading letters and of the
    rest, as a run of letters is always split off. Texts with the control characters
    0x1c-0x1f, which Python but not the tokenizer takes as white space, are encoded
    whole.
    """

    def __init__(self, name: str, words: int = 250_000, parts: int = 600_000):
        self.name = name
        self.words, self.parts = Memory(words), Memory(parts)
        self.bytes = _byte_letters()

    def _letters(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            tokens = _tokenizer(self.name).model.tokenize(part.encode().decode("latin-1").translate(self.bytes))
            found = np.array([t.id for t in tokens], "<u4").tobytes()
            self.parts.put(part, found)
        return found

    def _any(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = np.array(_tokenizer(self.name).encode(part, add_special_tokens=False).ids, "<u4").tobytes()
            self.parts.put(part, found)
        return found

    def _word(self, word: str) -> bytes:
        lead = LETTERS.match(word)
        if lead and word.isascii() or lead and max(word) < "\u0100":
            rest = word[lead.end() :]
            return self._letters(lead[0].lower()) + (self._any(rest) if rest else b"")
        return self._any(word)

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return np.asarray(_tokenizer(self.name).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.words.turn()
        self.parts.turn()
        words = text.split()
        new = self.words.new
        try:
            return b"".join(map(new.__getitem__, words))
        except KeyError:
            out = []
            for w in words:
                found = self.words.get(w)
                if found is None:
                    found = self._word(w)
                    if len(w) <= KEPT:
                        new[w] = found
                out.append(found)
            return b"".join(out)


@lru_cache(maxsize=1)
def _encoder(name: str, words: int) -> Encoder:
    return Encoder(name, words, words * 12 // 5)


def pieces(docs: DataFrame, key: str, text: str, tokenizer: str, capacity: int, remembered: int = 250_000, keep: bool = True) -> DataFrame:
    """The tokenized pieces of each document (key, piece, start, length, ids_crc32); a document of one id (0) if the text is null or empty."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, remembered)
        for batch in batches:
            at, number, start, length, crc = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = encode(value.as_py() or "") + END
                for n, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    at.append(row)
                    number.append(n)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["_key", "piece", "start", "length", "ids_crc32"])
        if not keep:
            _encoder.cache_clear()
            _tokenizer.cache_clear()

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(cut, f"_key {kind}, piece int, start long, length long, ids_crc32 long")


class Lengths:
    """A multiset of lengths: how many pieces there are of each. Its size is bounded by the capacity, not by the data."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.sorted = sorted(self.n)

    def take(self, length: int, n: int = 1) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            del self.sorted[bisect_left(self.sorted, length)]

    def put(self, length: int, n: int = 1) -> None:
        if length not in self.n:
            self.n[length] = 0
            insort(self.sorted, length)
        self.n[length] += n

    def at_most(self, room: int) -> int | None:
        i = bisect_left(self.sorted, room + 1)
        return self.sorted[i - 1] if i else None

    def smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for x in self.sorted:
            out += [x] * min(self.n[x], k - len(out))
            if len(out) == k:
                break
        return out


def reduce_by_dominance(left: Lengths, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello and Toth's reduction: take out sets of pieces that some optimal packing holds, as (lengths, how often).

    Longest piece first. A set that contains the piece dominates every other one
    that does if what the other holds beside it can be dealt to the places of what
    the set holds beside it, several to a place if they fit there together: then, in
    any packing with the other set, the two can change places, and no sequence more
    is needed. So these are fixed: a piece with which nothing fits, alone; a piece
    and one that fills the sequence (all else fits into its place); a piece with which
    at most one other fits, and the longest that does; and, where at most two others
    fit, the longest single piece if no fitting pair has more in total, or a pair that
    fills the sequence and dominates every single piece and every pair (see
    _dominating_pair). Stops at no piece: what no rule fixes is left for best fit.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(items: tuple[int, ...], n: int) -> None:
        fixed.append((items, n))
        for x in items:
            left.take(x, n)

    changed = True
    while changed:
        changed = False
        for a in reversed(list(left.sorted)):
            while n := left.n.get(a, 0):
                room = capacity - a
                left.take(a, 1)  # now left holds what may stand beside one a
                best, few = left.at_most(room), left.smallest(3)
                one = len(few) < 2 or sum(few[:2]) > room
                two = not one and (len(few) < 3 or sum(few) > room)
                pair = _best_pair(left, room) if best and two else None
                wide = _dominating_pair(left, room) if pair and sum(pair) == room else None
                left.put(a, 1)
                times = best and (n // 2 if best == a else min(n, left.n[best]))
                if best is None:
                    fix((a,), n)
                elif best == room or one or pair and best >= sum(pair):
                    fix((a, best), times)
                elif pair and sum(pair) == room and (pair := wide):
                    items = (a, *pair)
                    fix(items, min(left.n[x] // items.count(x) for x in set(items)))
                else:
                    break
                changed = True
    return fixed


def _dominating_pair(left: Lengths, room: int) -> tuple[int, int] | None:
    """Pieces p >= q that together fill room, and to whose places whatever one or two pieces fit into room can be dealt.

    A single piece must fit into p. A pair x >= y fits piece by piece if y <= q (its x is at
    most p then, as a single piece), and else must fit into p as a whole; for each y
    the longest x that fits beside it tells.
    """
    longest = left.at_most(room)
    for p in reversed(left.sorted[: bisect_left(left.sorted, room)]):
        q = room - p
        if p < q or p < longest:
            break
        if left.n.get(q, 0) < 1 + (p == q):
            continue
        for y in left.sorted[bisect_left(left.sorted, q + 1) :]:
            if 2 * y > room:
                return p, q
            x = left.at_most(room - y)
            if x > y or x == y and left.n[y] > 1:
                if x + y > p:
                    break
        else:
            return p, q
    return None


def _best_pair(left: Lengths, room: int) -> tuple[int, int] | None:
    """Two pieces that together fill most of room."""
    best = None
    for x in left.sorted:
        if 2 * x > room:
            break
        y = left.at_most(room - x)
        if y is not None and y == x and left.n[x] < 2:
            i = bisect_left(left.sorted, x)
            y = left.sorted[i - 1] if i else None
        if y is not None and (best is None or x + y > sum(best)):
            best = (y, x)
    return best


def best_fit(left: Lengths, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for equal lengths and equal sequences at once: (lengths, how often)."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []

    def put(room: int, items: tuple[int, ...], n: int) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append((items, n))

    for a in sorted(left.n, reverse=True):
        n = left.n[a]
        while n:
            i = bisect_left(order, a)
            if i == len(order):
                each = capacity // a
                if n // each:
                    put(capacity - each * a, (a,) * each, n // each)
                if n % each:
                    put(capacity - (n % each) * a, (a,) * (n % each), 1)
                break
            room = order[i]
            items, have = rooms[room].pop()
            each = min(room // a, n)
            used = min(have, n // each)
            if used < have:
                rooms[room].append((items, have - used))
            elif not rooms[room]:
                del rooms[room], order[i]
            put(room - each * a, items + (a,) * each, used)
            n -= used * each
    return [x for each in rooms.values() for x in each]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in place order, how often), for so many pieces of each length."""
    left = Lengths(counts)
    fixed = reduce_by_dominance(left, capacity)
    return fixed + best_fit(left, capacity)


def slots(plan_: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset): the k-th piece of that length goes to first sequence + k - first rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for items, n in plan_:
        offset = 0
        for x in items:
            out.setdefault(x, []).append((taken.get(x, 0), base, offset))
            taken[x] = taken.get(x, 0) + n
            offset += x
        base += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str = "word_bpe_49k.json", remembered: int = 250_000, keep: bool = True) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there, gapless from 0.

    Only the number of pieces of each length goes to the driver: at most capacity
    rows. The plan made from it is as bounded; pieces are matched to its places by
    their rank among those of equal length. Null and empty texts are documents of
    one id; repeated rows and null keys are packed like any others; an empty table
    gives no rows; very long texts are whole; other columns of docs are ignored.
    remembered: so many words' ids a worker holds (twice at most); fewer take less
    memory and more time. keep: whether it keeps them, and the tokenizer, for its
    next task.
    """
    table = written(pieces(docs, key, text, tokenizer, capacity, remembered, keep).withColumn("_p", F.spark_partition_id()))
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = slots(plan(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, k = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for x in np.unique(n):
            rows, of = np.flatnonzero(n == x), place[int(x)]
            i = np.searchsorted(of[:, 0], k[rows], side="right") - 1
            sequence[rows], offset[rows] = of[i, 1] + k[rows] - of[i, 0], of[i, 2]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    dealt = ranked(table, ["length"], ["_key", "piece", "ids_crc32", "_p"], "_rank")
    return dealt.withColumn("_to", placed("length", "_rank")).select(F.col("_key").alias(key), "piece", "start", "length", "ids_crc32", "_to.sequence_id", "_to.offset")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents into sequences of 2048 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
