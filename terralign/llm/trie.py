"""Prefix trie of conversations, built in sorted shards around a skeleton of splitter paths.

Conversations are sorted by their path, the digests of their turns one after the other,
and cut into shards at splitters. A node, which is a prefix of paths, has members in
more than one shard only if it is a prefix of a splitter; these nodes are the skeleton.
All other nodes are finished by the shard that holds them, in one pass over its sorted
paths with the open nodes on a stack. Of skeleton nodes a shard gives what it has seen,
and Spark adds that up.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralign.llm.common import written

#: Bytes of a path for each turn.
STEP = 16
#: Conversations of the sample for each shard. Any splitters give the same trie.
SAMPLE = 40
#: Ids joined to one row, of those that end in a skeleton node.
CHUNK = 4096
#: Skeleton nodes that are broadcast at most.
BROADCAST = 500_000


def paths(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id: path (a digest of role and text for each turn, in order), words (of each text).

    Turns are in order of turn, null first; equal numbers in order of role, then digest.
    Null roles and texts count as empty; rows without conv_id are left out. The texts
    themselves stay where they are: what is gathered of a turn is some 40 bytes.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.struct("turn", role.alias("role"), digest.alias("d"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("w"))
    told = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    told = told.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return told.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["d"]), "")).alias("path"), F.transform("t", lambda x: x["w"]).alias("words"))


def rebuilt(paths: DataFrame) -> DataFrame:
    """Every conversation c with its first turns taken from conversation c - c % 20: as many as the CRC-32 of c as text, modulo 4."""
    own = paths.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % 20, "_h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")})
    heads = paths.where("conv_id % 20 = 0").select(F.col("conv_id").alias("_base"), F.expr(f"substring(path, 1, {3 * STEP})").alias("_path"), F.slice("words", 1, 3).alias("_words"))
    both = own.join(heads, "_base", "left")
    path = F.expr(f"concat(coalesce(substring(_path, 1, {STEP} * _h), x''), substring(path, {STEP} * _h + 1))")
    words = F.expr("concat(coalesce(slice(_words, 1, _h), array()), slice(words, _h + 1, greatest(size(words) - _h, 0)))")
    return both.select("conv_id", path.alias("path"), words.alias("words"))


def splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most shards - 1 places between conversations, as (path, conv_id), from a sample of about SAMPLE conversations a shard."""
    share = min(1.0, SAMPLE * shards / max(paths.count(), 1))
    seen = sorted((bytes(r["path"]), r["conv_id"]) for r in paths.select("path", "conv_id").sample(share, 7).collect())
    return sorted({seen[len(seen) * k // shards] for k in range(1, shards)}) if seen else []


def keys(path: bytes) -> list[bytes]:
    """A key for each prefix of path, from the root on, each made from the one before."""
    out = [b"\0" * STEP]
    for at in range(0, len(path), STEP):
        out.append(hashlib.blake2b(out[-1] + path[at : at + STEP], digest_size=STEP).digest())
    return out


def common(a: bytes, b: bytes) -> int:
    """The number of turns that two paths begin with alike, by bisection."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * STEP : mid * STEP] == b[low * STEP : mid * STEP]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    """An open node of the path at hand. key is set for nodes of the skeleton. waiting: finished children, which still lack their parent's conv_id."""

    __slots__ = ("depth", "key", "words", "n", "least", "children", "leaves", "saved", "ends", "digest", "chunk", "waiting")

    def __init__(self, depth: int, words: int, key: bytes | None):
        self.depth, self.words, self.key = depth, words, key
        self.n = self.children = self.leaves = self.saved = self.ends = 0
        self.least: int | None = None
        self.digest = hashlib.sha256() if key is None else None
        self.chunk: list[int] = []
        self.waiting: list[tuple] = []

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


#: Of a shard's rows: finished nodes (parent_conv_id known, or parent the key of a skeleton node), parts of skeleton nodes (key set), and ids that end in one (ids set).
FIELDS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent binary, words long, shard int, part int, ids string"


class Shard:
    """One pass over the sorted paths of a shard; rows collects what is done, as FIELDS."""

    def __init__(self, number: int, bounds: list[tuple[bytes, int]], rows: list[tuple]):
        self.number, self.rows, self.path, self.stack = number, rows, b"", []
        near = [bounds[k][0] for k in (number - 1, number) if 0 <= k < len(bounds)]
        self.near = [(path, keys(path)) for path in near]

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        same = common(self.path, path) if self.stack else -1
        while len(self.stack) > same + 1:
            self.close()
        if len(self.stack) <= len(path) // STEP:
            shared = [(common(splitter, path), known) for splitter, known in self.near]  # prefixes of a splitter are in the skeleton
            for depth in range(len(self.stack), len(path) // STEP + 1):
                key = next((known[depth] for turns, known in shared if depth <= turns), None)
                self.stack.append(Node(depth, words[depth - 1] if depth else 0, key))
        self.path, top = path, self.stack[-1]
        top.add(1, conv)
        if top.digest is not None:
            top.digest.update(b",%d" % conv if top.ends else b"%d" % conv)
        else:
            top.chunk.append(conv)
            if len(top.chunk) == CHUNK:
                self.flush(top)
        top.ends += 1

    def flush(self, node: Node) -> None:
        self.rows.append((None,) * 8 + (node.key, None, None, self.number, node.ends // CHUNK, ",".join(map(str, node.chunk))))
        node.chunk = []

    def close(self) -> None:
        node = self.stack.pop()
        up = self.stack[-1] if self.stack else None
        self.rows += [(*row[:2], node.least, *row[3:]) for row in node.waiting]
        if node.key is not None:
            if node.chunk:
                self.flush(node)
            self.rows.append((node.least, node.depth, None, node.n, node.children, node.leaves, node.saved, None, node.key, up.key if up else None, node.words, self.number, None, None))
            return
        leaves = node.leaves or 1
        saved = node.saved + (node.n - 1) * node.words
        row = (node.least, node.depth, None, node.n, node.children, leaves, saved, node.digest.hexdigest(), None, up.key if up else None, None, None, None, None)
        if up is None or up.key is not None:
            self.rows.append(row)
        else:
            up.waiting.append(row)
        if up is not None:
            up.add(node.n, node.least)
            up.children += 1
            up.leaves += leaves
            up.saved += saved

    def end(self) -> None:
        while self.stack:
            self.close()


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _rolled_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summed parts of all skeleton nodes (at most shards times depth rows), deepest first, each added to its parent; NODE and key."""
    schema = _arrow(f"{NODE}, key binary")
    nodes = {r["key"]: r for batch in batches for r in batch.to_pylist()}
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        r["n_leaves"] = r["n_leaves"] or 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
        up = nodes.get(r["parent"])
        if up:
            up["n_convs"] += r["n_convs"]
            up["conv_id"] = min(x for x in (up["conv_id"], r["conv_id"]) if x is not None)
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
    rows = []
    for r in nodes.values():
        up = nodes.get(r["parent"])
        rows.append((r["conv_id"], r["depth"], up["conv_id"] if up else None, *(r[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key"))))
    if rows:
        yield _batches(rows, schema)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and ids, sorted by key and place: the SHA-256 of each key's ids joined by commas, with memory for one row."""
    schema, now, digest = _arrow("key binary, ends_sha256 string"), None, None
    done: list[tuple] = []
    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if now is not None:
        yield _batches([*done, (now, digest.hexdigest())], schema)


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the prefix trie of conversations (conv_id long, not null and unique; path; words), one row each.

    conv_id is the smallest member, the conversations that begin with the node's turns;
    depth their number; parent_conv_id the parent's conv_id (null for the root); n_convs
    the members; n_children; n_leaves the childless nodes of the subtree, the node
    included; saved_tokens the sum over the subtree of (n_convs - 1) times the words of
    the last text; ends_sha256 the SHA-256 of the ids of members of just depth turns,
    ascending, joined by commas. A conversation without turns is a member of the root
    alone; no conversations make no node.

    A shard keeps the open nodes of one path, and finished children until their parent is
    finished: no more than its own nodes. Equal conversations are cut apart by conv_id, so a
    hot path is spread over shards. The skeleton has at most as many nodes as splitters
    have turns, whatever the number of conversations.
    """
    spark = paths.sparkSession
    paths = written(paths)
    bounds = splitters(paths, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared, schema = spark.sparkContext.broadcast(bounds), _arrow(FIELDS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(shared.value, x) for x in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=["conv_id", "path", "words", "shard"])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        shard = None
        for batch in batches:
            for conv, path, words, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard is None or shard.number != number:
                    if shard:
                        shard.end()
                    shard = Shard(number, shared.value, rows)
                shard.add(conv, path, words)
            if len(rows) > 10_000:
                yield _batches(rows, schema)
                rows.clear()
        if shard:
            shard.end()
        if rows:
            yield _batches(rows, schema)

    in_shards = paths.select("conv_id", "path", "words").mapInArrow(dealt, "conv_id long, path binary, words array<int>, shard int")
    sorted_ = in_shards.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    made = written(sorted_.mapInArrow(passed, FIELDS))

    ids = made.where("ids is not null").select("key", "shard", "part", "ids").repartition("key").sortWithinPartitions("key", "shard", "part")
    ends = ids.select("key", "ids").mapInArrow(_digested, "key binary, ends_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = made.where("key is not null and ids is null").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("parent").alias("parent"), F.first("words").alias("words"), *sums)
    empty = hashlib.sha256().hexdigest()
    parts = parts.join(ends, "key", "left").fillna(empty, ["ends_sha256"])
    skeleton = written(parts.coalesce(1).mapInArrow(_rolled_up, f"{NODE}, key binary"))

    columns = [f.split()[0] for f in NODE.split(", ")]
    known = skeleton.select(F.col("key").alias("parent"), F.col("conv_id").alias("_up"))
    known = F.broadcast(known) if known.count() <= BROADCAST else known
    own = made.where("key is null").join(known, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    return own.select(*columns).unionByName(skeleton.select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the prefix trie of all rebuilt conversations."""
    return trie(rebuilt(paths(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: The same rows in DuckDB's SQL, with whole lists of turns as nodes, and CRC-32 byte by byte with a table made from its rule.
ORACLE = """WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
turns AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
asked AS (SELECT c, s, c - c % 20 AS b, CAST(xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1]), 4294967295), 4294967295) % 4 AS INTEGER) AS h FROM turns, crc),
built AS (SELECT asked.c, list_concat(coalesce(base.s[1:h], []), asked.s[h + 1:]) AS p FROM asked LEFT JOIN turns base ON base.c = asked.b),
steps AS (SELECT c, p, unnest(range(len(p) + 1)) AS d FROM built),
nodes AS (SELECT p[1:d] AS k, d, min(c) AS c, count(*) AS n, max(CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].t, '[^\\x20\\x09-\\x0D]+')) END) AS w,
coalesce(sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(p) = d)), sha256('')) AS e FROM steps GROUP BY p[1:d], d),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS m FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(m, 0) AS m FROM nodes LEFT JOIN kids ON nodes.k = kids.k AND nodes.d = kids.d),
above AS (SELECT *, unnest(range(d + 1)) AS u FROM full_),
sums AS (SELECT k[1:u] AS k, u AS d, count(*) FILTER (m = 0) AS leaves, sum((n - 1) * w) AS saved FROM above GROUP BY ALL)
SELECT f.c AS conv_id, f.d AS depth, up.c AS parent_conv_id, f.n AS n_convs, CAST(f.m AS BIGINT) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.e AS ends_sha256
FROM full_ f JOIN sums ON f.k = sums.k AND f.d = sums.d LEFT JOIN nodes up ON f.d > 0 AND up.d = f.d - 1 AND up.k = f.k[1:f.d - 1]"""
