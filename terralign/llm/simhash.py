"""SimHash near-duplicates found through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralign.llm.common import components, spare, written

BITS = 64
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash of the word shingles of a whole text, A-Z lowered; 0 without words."""
    if not text:
        return 0
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(tokens) >= words:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashed = np.array([digest(joined[a:b], 42) for a, b in pairs], dtype="<u8")
        ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprint_of(text: Column, words: int) -> Column:
    """Column form of fingerprint(), as a signed long."""

    @F.pandas_udf("long")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(np.array([fingerprint(t, words) for t in series], dtype=np.uint64).view(np.int64))

    return made(text)


def segments(distance: int) -> list[tuple[int, int]]:
    """(offset, width) of the fewest segments such that one differs by at most one bit where the whole differs by distance."""
    n = distance // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(fp: Column, distance: int) -> Column:
    """Index keys: each segment with each of its bits as a wildcard. Segments that differ by one bit or none share a key."""
    keys = []
    for number, (offset, width) in enumerate(segments(distance)):
        part = F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1))
        keys += [F.xxhash64(F.lit(number * BITS + bit), part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))) for bit in range(width)]
    return F.array(*keys)


def differing(a: np.ndarray, b) -> np.ndarray:
    """Bits that differ, counted unsigned (numpy counts those of a signed number's absolute value); over all words of a row."""
    bits = np.bitwise_count((a ^ b).view(np.uint64))
    return bits if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


def star(left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges, as fingerprints, that join what is linked between left and right (or within left, if right is left)."""
    every = left if right is left else np.concatenate([left, right])
    return [(int(every[a]), int(every[b])) for a, b in star_places(left, right, distance)]


def star_places(left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """The same as places in left followed by right: at most one edge for each entry.

    Grows one component after another; an entry already reached is not compared again.
    """
    same = right is left
    every = left if same else np.concatenate([left, right])
    side = np.zeros(len(every), bool) if same else np.arange(len(every)) >= len(left)
    free, edges = np.ones(len(every), bool), []
    for first in range(len(every)):
        if not free[first]:
            continue
        free[first] = False
        frontier = [first]
        while frontier:
            at = frontier.pop()
            rest = np.flatnonzero(free if same else free & (side != side[at]))
            near = rest[differing(every[rest], every[at]) <= distance]
            free[near] = False
            frontier += near.tolist()
            edges += [(at, int(x)) for x in near]
    return edges


def _bucketed(batches: Iterator[pa.RecordBatch], distance: int, block: int) -> Iterator[pa.RecordBatch]:
    """Edges within the buckets of rows (key, fp) sorted by key, as (null, a, b); what is in a bucket of more than block rows as (key, fp, null)."""

    def out(key, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, a, b)], names=["key", "a", "b"])

    def complete(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        sizes = np.diff(starts, append=len(key))
        two = starts[sizes == 2]
        near = two[differing(fp[two], fp[two + 1]) <= distance]
        groups = [fp[at : at + n] for at, n in zip(starts, sizes, strict=True) if 2 < n <= block]
        edges = [e for group in groups for e in star(group, group, distance)]
        a, b = np.concatenate([np.stack([fp[near], fp[near + 1]], axis=1), np.array(edges, np.int64).reshape(-1, 2)]).T
        yield out([None] * len(a), a, b)
        large = np.repeat(sizes > block, sizes)
        yield out(key[large], fp[large], [None] * int(large.sum()))

    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
    large = None
    for batch in batches:
        key, fp = (batch.column(k).to_numpy() for k in (0, 1))
        if large is not None:
            n = int(np.searchsorted(key, large, side="right"))
            yield out(key[:n], fp[:n], [None] * n)
            key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            large = None
        keys, prints = np.concatenate([keys, key]), np.concatenate([prints, fp])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1], side="left"))  # its bucket may go on
        yield from complete(keys[:last], prints[:last])
        keys, prints = keys[last:], prints[last:]
        if len(keys) > block:
            large = keys[0]
            yield out(keys, prints, [None] * len(keys))
            keys, prints = keys[:0], prints[:0]
    yield from complete(keys, prints)


def linked(fps: DataFrame, distance: int = 4, block: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) at most distance bits apart, enough to join every component.

    Fingerprints meet in the buckets of their variants: sorted by bucket, they are
    streamed through tasks that keep one bucket of at most block rows. Larger
    buckets are cut into blocks, and each pair of blocks is a bucket of its own, so
    that none is skipped and none grows with the data. Every edge is verified.
    """
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = fps.repartition(n).select(F.explode(variants(F.col("fp"), distance)).alias("key"), "fp")
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _bucketed(batches, distance, block), "key long, a long, b long")
    found = written(found)
    large = found.where("b is null").select("key", F.col("a").alias("fp"))
    sizes = large.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    cut = large.join(sizes, "key").withColumn("x", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    pairs = cut.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    buckets = pairs.groupBy("key", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.collect_list(F.when(F.col("x") <= F.col("y"), F.col("fp"))).alias("l"), F.collect_list(F.when(F.col("x") > F.col("y"), F.col("fp"))).alias("r"))

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            edges = []
            for lo, hi, l, r in frame.itertuples(index=False):
                left, right = np.asarray(l, np.int64), np.asarray(r, np.int64)
                edges += star(left, left if lo == hi else right, distance)
            yield pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    blocks = written(buckets.select("lo", "hi", "l", "r").mapInPandas(joined, "a long, b long"), rows=64)
    return found.where("b is not null").select("a", "b").unionAll(blocks).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, distance: int = 4) -> DataFrame:
    """One row per row of docs: key, fp (signed long), component (smallest key reachable through links, its own included).

    Rows whose fingerprints differ by at most distance bits link. Null and empty
    texts, and those without words, have fingerprint 0 and link like any others.
    Equal texts share a fingerprint and are compared once. An empty table gives no
    rows; a null key takes part but is never the smallest; other columns are ignored.
    """
    rows = _printed(docs, key, text, words)
    classes = _classes(rows, distance)
    least = classes.join(rows.groupBy("fp").agg(F.min("_id").alias("_least")), "fp").groupBy("root").agg(F.min("_least").alias("component"))
    return rows.join(classes.join(least, "root").drop("root"), "fp").select(F.col("_id").alias(key), "fp", "component")


def _printed(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    return written(docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_h"), fingerprint_of(F.col(text), words).alias("fp")))


def _classes(rows: DataFrame, distance: int) -> DataFrame:
    """Each fingerprint and the root of its component."""
    fps = rows.select("fp").distinct()
    found = components(linked(fps, distance)).withColumnRenamed("node", "fp")
    return fps.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


#: A text with so many candidates in one bucket is crowded there.
BUCKET = 8
#: Buckets up to so many rows are compared many at once, larger ones in strips of rows.
WIDE, STRIP = 48, 64
#: Comparisons that cost as much as one more row of the index.
ROW_COST = 400
#: Rows of an outsized bucket that all others are compared with first.
HUBS = 8
#: Hashes that are compared at a time, as columns of a matrix.
COLUMNS = 2048
CANDIDATE = ["key", "cls", "w0", "w1", "a", "b"]


def share_of(similarity: float) -> float:
    """Share of SimHash bits in which two sets of the similarity (Jaccard) differ at most: the angle of cosine 2 s / (1 + s), over pi."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def plan_segments(rows: int, similarity: float = 0.8, recall: float = 0.97) -> tuple[int, int]:
    """(bits of a segment, number of segments) for so many texts.

    There are so many segments that, at the similarity, one differs by at most one
    bit with the recall given; more similar texts are found more surely. Of the
    widths the cheapest is taken: narrow segments need fewer keys a text, wide ones
    fewer comparisons a key. Nothing bounds the width but the word.
    """
    share, best = share_of(similarity), None
    for width in range(6, 33):
        one = (1 - share) ** width + width * share * (1 - share) ** (width - 1)
        segments = int(np.ceil(np.log(1 - recall) / np.log(1 - one)))
        cost = segments * width * (ROW_COST + rows / 2**width)
        if best is None or cost < best[0]:
            best = cost, width, segments
    return best[1:]


def words_of(width: int, segments: int) -> int:
    """64-bit words that hold the segments; two at least, for the comparison of 128 bits."""
    return max(2, -(-segments // (64 // width)))


def wide_fingerprint(text: str | None, words: int, n: int) -> tuple[list[int], np.ndarray]:
    """n words of SimHash over the distinct word shingles of a whole text, A-Z lowered, and the shingles' 32-bit hashes in order."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return [0] * n, np.zeros(0, np.int32)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(tokens) >= words:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.empty(len(starts), "<u8")
    for at in range(0, len(starts), CHUNK):
        h[at : at + CHUNK] = [digest(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)]
    h = np.unique(h)
    shingles, out = np.unique(h.astype(np.uint32)).view(np.int32), []
    for k in range(n):
        ones = sum(np.unpackbits(h[a : a + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for a in range(0, len(h), CHUNK))
        out.append(int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little", signed=True))
        if k + 1 < n:  # the next word from hashes of the hashes
            mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h = mixed ^ (mixed >> np.uint64(29))
    return out, shingles


def _prints(docs: DataFrame, key: str, text: str, words: int, n: int) -> DataFrame:
    """_id, _h (hash of the text), cls (of texts with equal shingles), w (fingerprint), s (shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [wide_fingerprint(t.as_py(), words, n) for t in part.column(2)]
                cls = [xxhash.xxh64_intdigest(s.tobytes()) for _, s in made]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array([w for w, _ in made], pa.list_(pa.int64())), pa.array([s for _, s in made], pa.list_(pa.int32()))], names=["_id", "_h", "cls", "w", "s"])

    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, _h long, cls long, w array<long>, s array<int>")


def _twice(own: np.ndarray, near: int, distance: int) -> list[tuple[int, int]]:
    """Edges of star_places within near bits (what texts of the similarity differ in on average), and those within distance."""
    return star_places(own, own, near) + star_places(own, own, distance)


def _similar(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets of left and of right (hashes in order) have the similarity (Jaccard) or more, by products of their incidence matrices.

    Only hashes that both sides have are columns, so many at a time.
    """
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    columns = np.intersect1d(*flat)
    same = np.zeros((len(left), len(right)), np.float32)
    if len(columns):
        at = [np.searchsorted(columns, x) for x in flat]
        hit = [columns[np.minimum(i, len(columns) - 1)] == x for i, x in zip(at, flat, strict=True)]
        for lo in range(0, len(columns), COLUMNS):
            parts = []
            for n, i, row, ok in zip(sizes, at, rows, hit, strict=True):
                here = ok & (i >= lo) & (i < lo + COLUMNS)
                part = np.zeros((len(n), min(COLUMNS, len(columns) - lo)), np.float32)
                part[row[here], i[here] - lo] = 1
                parts.append(part)
            same += parts[0] @ parts[1].T
    return (same > 0) & (same >= similarity * (sizes[0][:, None] + sizes[1][None, :] - same))


def _forest(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges (row, column) of a matrix of links that join all that its links join, one at most for each end. same: rows and columns are the same ends."""
    n, m = linked.shape
    free_rows, free_columns, edges = np.ones(n, bool), np.ones(m, bool), []
    for first in range(n):
        if not free_rows[first]:
            continue
        free_rows[first] = False
        if same:
            free_columns[first] = False
        frontier = [(first, True)]
        while frontier:
            at, is_row = frontier.pop()
            if is_row:
                near = np.flatnonzero(linked[at] & free_columns)
                free_columns[near] = False
                edges += [(at, int(x)) for x in near]
            else:
                near = np.flatnonzero(linked[:, at] & free_rows)
                edges += [(int(x), at) for x in near]
            if same or not is_row:
                free_rows[near] = False
            frontier += [(int(x), same or not is_row) for x in near]
    return edges


def _close(w0: np.ndarray, w1: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within distance among rows of two words, the smaller first; compared in strips."""
    left, right = [], []
    for at in range(0, len(w0), STRIP):
        bits = np.bitwise_count(w0[at : at + STRIP, None] ^ w0[at:]) + np.bitwise_count(w1[at : at + STRIP, None] ^ w1[at:])
        x, y = np.nonzero(bits <= distance)
        later = x < y
        left.append(x[later] + at)
        right.append(y[later] + at)
    return np.concatenate(left), np.concatenate(right)


def _candidates(batches: Iterator[pa.RecordBatch], near: int, distance: int, block: int) -> Iterator[pa.RecordBatch]:
    """Pairs of classes within buckets of rows (key, cls, w0, w1) sorted by key, as (a, b).

    A bucket gives every pair within distance. If a text has BUCKET of them or more
    there, the bucket gives edges that join all that is linked, at most two for each
    row, with 1 as w0: what it joins is to be compared in full. In order of class,
    crowded buckets of one group give mostly the same edges. Of buckets of more than
    block rows all rows come out, as (key, cls), each with its nearest leader within
    distance as a (null if there is none). Up to HUBS rows that had none are leaders.
    """

    def rows(**given) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([pa.array(given[k], pa.int64()) if k in given else pa.nulls(n, pa.int64()) for k in CANDIDATE], names=CANDIDATE)

    def outsized(key: np.ndarray, cls: np.ndarray, w: np.ndarray, leaders: list[int], prints: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The rows of a part of one bucket with their leaders; leaders (classes) and prints grow."""
        least, nearest = np.full(len(cls), 129, np.int64), np.zeros(len(cls), np.int64)

        def compared(leader: int) -> None:
            bits = differing(w, prints[leader])
            closer = bits < least
            least[closer], nearest[closer] = bits[closer], leaders[leader]

        for n in range(len(leaders)):
            compared(n)
        while len(leaders) < HUBS and (far := np.flatnonzero(least > distance)).size:
            leaders.append(int(cls[far[0]]))
            prints.append(w[far[0]])
            compared(len(leaders) - 1)
        led = least <= distance
        if led.any():
            yield rows(key=key[led], cls=cls[led], a=nearest[led])
        if not led.all():
            yield rows(key=key[~led], cls=cls[~led])

    def complete(key: np.ndarray, cls: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        def given(left: np.ndarray, right: np.ndarray, bucket: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
            """The pairs left, right of places, each in one of n buckets."""
            ends, degree = np.unique(np.concatenate([left, right]), return_counts=True)
            crowded = np.zeros(n, bool)
            crowded[bucket[(degree[np.searchsorted(ends, left)] >= BUCKET) | (degree[np.searchsorted(ends, right)] >= BUCKET)]] = True
            apart = ~crowded[bucket]
            if apart.any():
                yield rows(a=cls[left[apart]], b=cls[right[apart]])
            for b in np.flatnonzero(crowded):
                own = np.unique(np.concatenate([left[bucket == b], right[bucket == b]]))
                prints = w[own]
                found = own[np.array(_twice(prints, near, distance), np.int64).reshape(-1, 2)]
                yield rows(a=cls[found[:, 0]], b=cls[found[:, 1]], w0=np.ones(len(found), np.int64))

        starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        sizes = np.diff(starts, append=len(key))
        for n in np.unique(sizes[(sizes > 1) & (sizes <= min(WIDE, block))]):
            first = starts[sizes == n]
            i, j = np.triu_indices(n, 1)
            step = max(1, 100_000 // len(i))
            for at in range(0, len(first), step):
                here = first[at : at + step, None] + np.arange(n)
                bits = np.zeros((len(here), len(i)), np.uint8)
                for k in range(2):
                    word = w[here, k]
                    bits += np.bitwise_count((word[:, i] ^ word[:, j]).view(np.uint64))
                bucket, pair = np.nonzero(bits <= distance)
                if len(bucket):
                    yield from given(here[bucket, i[pair]], here[bucket, j[pair]], bucket, len(here))
        for at, n in zip(starts[(sizes > WIDE) & (sizes <= block)], sizes[(sizes > WIDE) & (sizes <= block)], strict=True):
            left, right = _close(*np.ascontiguousarray(w[at : at + n].T).view(np.uint64), distance)
            if len(right):
                yield from given(at + left, at + right, np.zeros(len(right), np.int64), 1)
        for at, n in zip(starts[sizes > block], sizes[sizes > block], strict=True):
            yield from outsized(key[at : at + n], cls[at : at + n], w[at : at + n], [], [])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)]
    large, leaders, prints = None, [], []
    for batch in batches:
        key, cls, w0, w1 = (batch.column(k).to_numpy() for k in range(4))
        new = [key, cls, np.stack([w0, w1], axis=1)]
        if large is not None:
            n = int(np.searchsorted(key, large, side="right"))
            yield from outsized(*(x[:n] for x in new), leaders, prints)
            new = [x[n:] for x in new]
            if not len(new[0]):
                continue
            large = None
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        if not len(held[0]):
            continue
        last = int(np.searchsorted(held[0], held[0][-1], side="left"))  # its bucket may go on
        yield from complete(*(x[:last] for x in held))
        held = [x[last:] for x in held]
        if len(held[0]) > block:
            large, leaders, prints = held[0][0], [], []
            yield from outsized(*held, leaders, prints)
            held = [x[:0] for x in held]
    yield from complete(*held)


def similar_pairs(prints: DataFrame, width: int, segments: int, similarity: float = 0.8, block: int = 8192, weight: int = 1 << 18) -> DataFrame:
    """Pairs of classes (a, b) of rows of _prints whose shingle sets have the similarity (Jaccard) or more: enough to join all that such pairs join.

    Classes meet where a segment differs by at most one bit; those whose first two
    words differ by more bits than texts of the similarity should (three deviations
    above: one in 700 at exactly the similarity) are left out; the rest is verified
    on the whole sets. Crowded buckets give few edges at first. What their edges
    join is a cluster, and its classes are then compared in full, set by set, within
    blocks; so an edge that fails costs no text its other candidates, and no pairs
    are written out.

    Most classes of a large cluster are one component by then. Those outside it meet
    all others; those of it don't meet each other, so a group of near copies that
    holds a third of all rows costs a pass and not its square.
    """
    share = share_of(similarity)
    near, distance = round(128 * share), int(np.ceil(128 * share + 3 * np.sqrt(128 * share * (1 - share))))
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = prints.groupBy("cls").agg(F.first("w").alias("w"))
    per_word, made = 64 // width, []
    for segment in range(segments):
        part = F.shiftrightunsigned(F.col("w")[segment // per_word], segment % per_word * width).bitwiseAND(F.lit((1 << width) - 1))
        made += [F.lit((segment * width + bit) << 32) + part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit))) for bit in range(width)]
    keyed = classes.repartition(n).select(F.explode(F.array(*made)).alias("key"), "cls", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"))
    schema = ", ".join(f"{c} long" for c in CANDIDATE)
    met = written(keyed.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(lambda b: _candidates(b, near, distance, block), schema))

    def blocks(labelled: DataFrame) -> DataFrame:
        """Pairs of blocks of the units of rows (unit, cls, w0, w1, root, s) that hold several roots, each side as lists.

        A block has about weight hashes, a set counting as 256 at least.
        """
        size = F.greatest(F.size("s"), F.lit(256))
        by_root = labelled.groupBy("unit", "root").agg(F.sum(size).alias("c"))
        most = by_root.groupBy("unit").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("n"), F.count("*").alias("roots")).where("roots > 1")
        few, rare = F.col("n") <= weight, F.col("root") != F.col("top.root")
        cut = labelled.join(most, "unit").withColumn("k", F.ceil((F.col("n") - F.col("top.c")) / weight).cast("int")).withColumn("m", F.ceil(F.col("top.c") / weight).cast("int"))
        deal = lambda parts: F.pmod(F.xxhash64("cls"), F.col(parts)).cast("int")
        cut = cut.withColumn("x", F.when(few, 0).when(rare, deal("k")).otherwise(F.col("k") + deal("m")))
        meets = F.when(few, F.array(F.lit(0))).when(rare, F.sequence(F.lit(0), F.col("k") + F.col("m") - 1)).otherwise(F.sequence(F.lit(0), F.col("k") - 1))
        pairs = cut.withColumn("y", F.explode(meets))
        entry = F.struct("cls", "w0", "w1", "root", "s")
        both = pairs.groupBy("unit", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.collect_list(F.when(F.col("x") <= F.col("y"), entry)).alias("l"), F.collect_list(F.when(F.col("x") > F.col("y"), entry)).alias("r"))
        return both.select("lo", "hi", "l", "r")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                within = batch.column(0)[row] == batch.column(1)[row]
                sides = []
                for k in (2, 2 if within else 3):
                    held = batch.column(k)[row].values
                    sets = held.field("s")
                    sides.append([*(held.field(c).to_numpy() for c in ("cls", "w0", "w1", "root")), [sets[i].values.to_numpy() for i in range(len(sets))]])
                (lc, l0, l1, lr, ls), (rc, r0, r1, rr, rs) = sides
                if not len(lc) or not len(rc):
                    continue
                bits = np.bitwise_count((l0[:, None] ^ r0).view(np.uint64)) + np.bitwise_count((l1[:, None] ^ r1).view(np.uint64))
                open_ = (bits <= distance) & (lr[:, None] != rr)
                if open_.any():
                    on, to = open_.any(axis=1), open_.any(axis=0)
                    if within:
                        on = to = on | to
                    on, to = np.flatnonzero(on), np.flatnonzero(to)
                    linked_ = _similar([ls[i] for i in on], [rs[i] for i in to], similarity) & open_[np.ix_(on, to)]
                    edges = np.array(_forest(linked_, within), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(lc[on[edges[:, 0]]]), pa.array(rc[to[edges[:, 1]]])], names=["a", "b"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same >= similarity * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in (0, 1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def checked(edges: DataFrame) -> DataFrame:
        wanted = edges.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        sets = prints.select("cls", "s").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("s").alias("s"))
        both = edges.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(verified, "a long, b long")

    def ordered(edges: DataFrame) -> DataFrame:
        return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    crowded = met.where("w0 = 1").select("a", "b")
    found = written(checked(ordered(met.where("a is not null").select("a", F.coalesce("b", "cls").alias("b")))), rows=200)
    if met.where("w0 = 1 or key is not null").isEmpty():
        return found
    roots = components(found).withColumnRenamed("node", "cls")
    units = components(crowded).select(F.col("root").alias("unit"), F.col("node").alias("cls")).unionAll(met.where("key is not null").select(F.xxhash64(F.lit("key"), "key").alias("unit"), "cls"))
    sets = prints.join(units.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("w").alias("w"), F.first("s").alias("s"))
    labelled = units.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")).join(sets, "cls").select("unit", "cls", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"), "root", "s")
    return found.unionAll(written(blocks(labelled).mapInArrow(joined, "a long, b long"), rows=4))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one of smallest key (null first), whole and once.

    Near-duplicates share similarity or more of their word shingles (Jaccard), in
    one or more steps. 64 bits tell such texts apart too poorly: at 0.8 they differ
    in about ten of them. So fingerprints have more words here and are cut into
    segments of which one differs by at most one bit with 97 percent recall at 0.8,
    and what meets is verified on the whole shingle sets. Null and empty texts and
    those without words are one group; of rows equal in key and text one stays; an
    empty table stays empty; other columns pass through, whatever their names.
    """
    width, segments = plan_segments(docs.count(), similarity)
    rows = written(_prints(docs, key, text, words, words_of(width, segments)), rows=1000)
    found = components(similar_pairs(rows, width, segments, similarity)).withColumnRenamed("node", "cls")
    first = rows.select("_id", "_h", "cls").join(found, "cls", "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min(F.struct("_id", "_h")).alias("f"))
    kept = first.select(F.col("f._id").alias("_id"), F.col("f._h").alias("_kept"))
    print_ = spare(docs, "_h")
    named = docs.withColumn(print_, F.xxhash64(text))
    return named.join(kept, named[key].eqNullSafe(kept["_id"]) & (named[print_] == kept["_kept"]), "left_semi").dropDuplicates([key, print_]).drop(print_)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: documents by 4-word shingles, linked at 4 bits or fewer."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, distance=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
