"""Removal of repeated runs of lines by winnowing over line hashes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terralign.llm.common import looked_up, spare, written


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _measured(text: Column) -> Column:
    """The lines with words, as (i: number in the text, h: hash of the trimmed line, w: words)."""
    every = F.transform(_lines(text), lambda line, i: F.struct(i.alias("i"), F.xxhash64(F.trim(line)).alias("h"), F.regexp_count(line, F.lit(r"\S+")).alias("w")))
    return F.filter(every, lambda x: x["w"] > 0)


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """The fingerprints of documents (_key, _h, lines, n: words): _key, _h, fp, at, windows.

    A window is the fewest lines that hold min_words from a line on, or up to a line.
    Every line of a run of min_words lies in such a window inside the run, whatever
    stands around it: the one from the line on, the one up to it, or the one from the
    run's first line on. So a line is in a run that stands elsewhere just when one of
    its windows does. Winnowing: each window selects its least line hash (the first of
    equal ones), and the selected lines alone are fingerprints: fp, the hash, and at,
    the line's number. windows has those that selected it: x and y (hashes of how many
    lines stand before the fingerprint, of these, and of those after it), first and
    last (line numbers of the text), and prev (of the line with words before first).
    """
    doc = W.partitionBy("_key", "_h")
    one = lines.select("_key", "_h", "n", F.posexplode("lines").alias("p", "l")).select("_key", "_h", "n", "p", F.col("l.i").alias("i"), F.col("l.h").alias("h"), F.col("l.w").cast("long").alias("w"))
    by_place = doc.orderBy("p")
    at = one.withColumn("e", F.sum("w").over(by_place.rowsBetween(W.unboundedPreceding, 0))).withColumn("c", F.col("e") - F.col("w")).withColumn("prev", F.lag("i").over(by_place))
    onward, back = doc.orderBy("c").rangeBetween(0, min_words - 1), doc.orderBy("e").rangeBetween(1 - min_words, 0)
    told = at.withColumns({"ahead": F.collect_list("h").over(onward), "last": F.last("i").over(onward)})
    told = told.withColumns({"behind": F.collect_list("h").over(back), "first": F.first("i").over(back), "prev0": F.first("prev").over(back)})

    def window(number: int, held: str, start: Column, prev: str, first: str, last: str) -> Column:
        least = F.array_min(held)
        place = F.array_position(held, least)
        sides = F.lit(number), place, F.slice(held, F.lit(1), place - 1), F.slice(held, place + 1, F.size(held))
        return F.struct(least.alias("fp"), (start + place - 1).alias("at"), F.struct(F.xxhash64(*sides).alias("x"), F.hash(*sides).alias("y"), F.col(prev).alias("prev"), F.col(first).alias("first"), F.col(last).alias("last")).alias("window"))

    onward, back = window(0, "ahead", F.col("p"), "prev", "i", "last"), window(1, "behind", F.col("p") + 1 - F.size("behind"), "prev0", "first", "i")
    both = F.array(F.when(F.col("n") - F.col("c") >= min_words, onward), F.when(F.col("e") >= min_words, back))
    told = told.select("_key", "_h", F.explode(both).alias("m")).where("m is not null").select("_key", "_h", "m.*")
    # One row for each line that was selected: of the same document, so without a shuffle.
    return told.groupBy("_key", "_h", "at").agg(F.first("fp").alias("fp"), F.collect_list("window").alias("windows"))


def repeats(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """Runs of lines to delete: _key, _h (hash of the text), runs. Documents without any are left out.

    Fingerprints that stand in one place only are done with. Where a fingerprint
    stands again, its places are joined on it; they match as far as the lines before and
    after it are the same, which the windows around them tell: those equal in fingerprint
    and in both sides. Windows that stand earlier, merged where they touch, are
    the maximal runs that go. Fingerprints and windows that hold many rows are not
    brought together (see looked_up).
    """
    lines = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_h"), _measured(F.col(text)).alias("lines"))
    lines = lines.withColumn("n", F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["w"])).where(F.col("n") >= min_words).dropDuplicates(["_key", "_h"])
    marks = written(fingerprints(lines, min_words))
    shared = written(marks.groupBy("fp").agg(F.count("*").alias("_n")).where("_n > 1"))
    met = looked_up(marks, shared, ["fp"], "_n").where("_n is not null")
    met = written(met.select("_key", "_h", "fp", F.explode("windows").alias("m")).select("_key", "_h", "fp", "m.*"))
    same = ["fp", "x", "y"]
    first = written(met.groupBy(*same).agg(F.min(F.struct("_key", "_h", "first")).alias("f"), F.count("*").alias("_n")).where("_n > 1"))
    later = looked_up(met, first, same, "_n").where(F.col("_n").isNotNull() & ~F.struct("_key", "_h", "first").eqNullSafe(F.col("f")))
    later = later.select("_key", "_h", "prev", "first", "last").distinct()
    doc = W.partitionBy("_key", "_h").orderBy("first", "last")
    reached = F.max("last").over(doc.rowsBetween(W.unboundedPreceding, -1))
    goes_on = F.coalesce(F.col("prev") <= reached, F.lit(False)) | F.coalesce(F.col("first") <= reached, F.lit(False))
    runs = later.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(doc.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("_key", "_h", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("_key", "_h").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """docs with repeated runs of lines cut out of text, and n_lines, n_removed.

    A run of whole lines with min_words words or more (lines compared without blanks at
    their ends, but with tabs and the like; blank ones skipped) goes where the same run
    stands earlier, by key and then by place; its first place keeps it. Runs are found
    exactly: no repeated run is without a fingerprint, and each window around it stands
    at its first place or goes. Blank lines inside what goes, go. Shorter repeats stay. Null keys come first; a null text has no lines and stays null; an
    empty text stays; very long texts are whole; rows equal in key and text are one document, with one result
    for each; an empty table gives no rows; other columns pass through,
    those named n_lines or n_removed as _own_n_lines and _own_n_removed.
    """
    id_, hash_, runs, left = (spare(docs, c) for c in ("_k", "_x", "_runs", "_left"))
    cut = repeats(docs, key, text, min_words).toDF(id_, hash_, runs)
    named = docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c.lower() in ("n_lines", "n_removed")})
    held = named.join(cut, named[key].eqNullSafe(cut[id_]) & (F.xxhash64(named[text]) == cut[hash_]), "left")
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda _, i: ~F.exists(runs, lambda r: (r["first"] <= i) & (i <= r["last"])))
    out = held.withColumn(left, F.when(F.col(runs).isNotNull(), kept))
    counts = {"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)), "n_removed": F.when(F.col(runs).isNull(), 0).otherwise(F.size(lines) - F.size(left))}
    out = out.withColumns(counts).withColumn(text, F.coalesce(F.array_join(left, "\n"), F.col(text)))
    return out.drop(id_, hash_, runs, left)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document with its repeated passages of 50 words or more cut."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduped(docs.select("doc_id", "text"))


#: The same rows in DuckDB's SQL, on whole lines instead of hashes.
ORACLE = r"""WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
m AS (SELECT doc_id, i, trim(line) AS x, len(regexp_extract_all(line, '[^\x09-\x0d ]+')) AS w FROM l),
s AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS e, sum(w) OVER (PARTITION BY doc_id) AS n, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM m WHERE w > 0),
k AS (SELECT *, e - w AS c FROM s),
a AS (SELECT *, list(x) OVER ahead AS on_x, last(i) OVER ahead AS on_last, list(x) OVER behind AS up_x, first(i) OVER behind AS up_first, first(prev) OVER behind AS up_prev FROM k
WINDOW ahead AS (PARTITION BY doc_id ORDER BY c RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING), behind AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
v AS (SELECT doc_id, 0 AS kind, on_x AS x, prev, i AS f, on_last AS t FROM a WHERE n - c >= 50 UNION ALL SELECT doc_id, 1, up_x, up_prev, up_first, i FROM a WHERE e >= 50),
later AS (SELECT DISTINCT doc_id, prev, f, t FROM (SELECT *, row_number() OVER (PARTITION BY kind, x ORDER BY doc_id, f) AS r FROM v) WHERE r > 1),
g AS (SELECT *, max(t) OVER (PARTITION BY doc_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM later),
o AS (SELECT *, sum(CASE WHEN prev <= reached OR f <= reached THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS run FROM g),
runs AS (SELECT doc_id, min(f) AS f, max(t) AS t FROM o GROUP BY doc_id, run),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN runs ON l.doc_id = runs.doc_id AND l.i BETWEEN runs.f AND runs.t),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS text, count(gone.i) AS n FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(ls) END AS INTEGER) AS n_lines, CAST(n AS INTEGER) AS n_removed
FROM d JOIN kept ON d.doc_id = kept.doc_id"""
