"""Benchmark decontamination by winnowing. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import bounded, text_key
from .scratch import Scratch

#: After A-Z became a-z, everything between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5


def words_of(text: str) -> Column:
    """The words of a text, A-Z in lower case; none for null. Only texts that are not ASCII take the slow way."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, GAP), "")


def _gram_hashes(hashes: str, n: int) -> Column:
    """A hash of every n words that follow each other; null where there are fewer."""
    size = F.size(hashes)
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)])))


def winnowed(texts: DataFrame, keep: list[str], window: int, gram: int) -> DataFrame:
    """keep, words, hashes, least: the smallest hash of a gram in every window of so many words, by window start."""
    per = window - gram + 1
    size = F.size("grams")
    least = F.when(size >= per, F.transform(F.sequence(F.lit(0), size - per), lambda i: F.least(*[F.get("grams", i + j) for j in range(per)])))
    hashed = texts.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("grams", _gram_hashes("hashes", gram))
    return hashed.select(*keep, "words", "hashes", least.alias("least") if per > 1 else F.col("grams").alias("least"))


def fingerprints(found: DataFrame, keep: list[str], window: int, shorter: list[int]) -> DataFrame:
    """keep and a row (n, at, stop, mark) for all windows that start from at to before stop: winnowing keeps a mark once
    for neighbouring windows that share it. For each n of shorter, also the hash of every n words."""
    least, size = F.col("least"), F.size("least")
    begins = F.when(size > 0, F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1))))
    some = found.withColumn("begins", begins)
    begins = F.col("begins")
    row = lambda n, at, stop, mark: F.struct(F.lit(n).alias("n"), at.alias("at"), stop.cast("int").alias("stop"), mark.alias("mark"))
    rows = [F.transform(begins, lambda i, k: row(window, i, F.when(k + 1 < F.size(begins), F.get(begins, k + 1)).otherwise(size), F.get(least, i)))]
    rows += [F.transform(_gram_hashes("hashes", n), (lambda n: lambda h, i: row(n, i, i + 1, h))(n)) for n in shorter]
    none = F.array().cast("array<struct<n:int,at:int,stop:int,mark:bigint>>")
    return some.select(*keep, F.explode_outer(F.concat(*[F.coalesce(r, none) for r in rows])).alias("mark")).select(*keep, "mark.*")


# Generators below are the outer kind and joins drop their nulls: for the inner kind Catalyst adds a filter on the array
# and pushes it below the projections, which then nests their lambdas into one expression of cubic cost.


def _joined(words: str, start: Column, n: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, start + j) for j in range(n)])


def benchmark_windows(benchmark: DataFrame, window: int, gram: int, scratch: Scratch) -> DataFrame:
    """mark, n, window, items: each different window of the benchmark, its winnowed mark, and the items that hold it.

    An item of fewer words than a window is one window, marked by the hash of all its words.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of("text").alias("words"))
    long = winnowed(items.where(F.size("words") >= window), ["item"], window, gram)
    long = long.select("item", "words", F.posexplode_outer("least").alias("at", "mark")).select("item", "mark", F.lit(window).alias("n"), _joined("words", F.col("at"), window).alias("window"))
    short = items.where((F.size("words") > 0) & (F.size("words") < window)).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    shorts = [
        short.where(F.size("words") == n).select("item", F.get(_gram_hashes("hashes", n), F.lit(0)).alias("mark"), F.lit(n).alias("n"), F.array_join("words", " ").alias("window"))
        for n in range(1, window)
    ]
    out = long
    for s in shorts:
        out = out.unionByName(s)
    return scratch.save(out.groupBy("mark", "n", "window").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, gram: int = GRAM, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, items, contaminated, text_key.

    A window is `window` consecutive words of a benchmark item, or all words of an item that has fewer, but not none.
    Winnowing: in either text the smallest hash of the grams in a window is the window's mark, so equal windows have
    equal marks; neighbouring windows that share a mark keep it once. Marks that the benchmark has are hits, and a hit
    is extended from its gram to every window that it stands for and compared word by word. n_hit counts the words of the document inside a window that the benchmark
    has; items are the item ids, as sorted strings, of which a window occurs. No shared window is missed.

    Null texts have no words, and empty ones neither: zero counts, no items. Rows of documents that repeat give rows
    that repeat; a null doc_id is kept. Items that repeat count once; an item's null id is an empty string. With an
    empty benchmark nothing is hit; empty docs give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontamination")
    marks = benchmark_windows(benchmark, window, gram, scratch)
    width = F.octet_length("window") + F.octet_length(F.array_join("items", ",")) + 64
    sizes = {r["n"]: (r["count"], r["bytes"]) for r in marks.groupBy("n").agg(F.count("*").alias("count"), F.sum(width).alias("bytes")).collect()}  # a row for each window length
    texts = docs.select("doc_id", "text", text_key().alias("text_key"))

    found = winnowed(texts.withColumn("words", words_of("text")), ["doc_id", "text_key"], window, gram)
    known = bounded(marks.select("n", "mark").distinct(), sum(n for n, _ in sizes.values()))
    hits = fingerprints(found, ["doc_id", "text_key"], window, sorted(set(sizes) - {window})).join(known, ["n", "mark"], "left_semi")
    hits = scratch.save(hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "stop", "n")).alias("hits")), "hits")
    in_all = hits.agg(F.coalesce(F.sum(F.size("hits") + 2), F.lit(0))).first()[0]

    known = bounded(hits.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), in_all, 12)
    marked = texts.join(known, texts["doc_id"].eqNullSafe(known["_id"]) & (texts["text_key"] == known["_key"]), "left")
    spell = lambda at, n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.get("words", at + j)), " ")
    windows = lambda h: F.transform(
        F.sequence(h["at"], h["stop"] - 1), lambda i: F.struct(i.alias("at"), h["n"].alias("n"), spell(i, h["n"]).alias("window"))
    )
    marked = marked.select("doc_id", "text_key", words_of("text").alias("words"), "hits").select(
        "doc_id", "text_key", F.size("words").alias("n_words"), F.flatten(F.transform("hits", windows)).alias("hits"), F.monotonically_increasing_id().alias("row")
    )
    marked = scratch.save(marked, "marked")
    seen = marked.where("hits IS NOT NULL").select("row", F.explode_outer("hits").alias("hit")).select("row", "hit.*")
    exact = scratch.save(seen.join(bounded(marks.drop("mark"), sum(size for _, size in sizes.values()), 1), ["n", "window"]).select("row", "at", "n", "items"), "exact")
    # Words in a union of spans: those of each, in order of start, beyond the furthest end so far.
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    step = lambda a, x: F.struct(
        F.greatest(a["end"], x["at"] + x["n"]).alias("end"), (a["total"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(a["end"], x["at"]))).alias("total")
    )
    spans = exact.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("spans")).select("row", F.aggregate("spans", start, step, lambda a: a["total"]).alias("n_hit"))
    of = exact.select("row", "items").distinct().select("row", F.explode_outer("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    verdicts = spans.join(of, "row")
    return (
        marked.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), "row")
        .join(verdicts, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            "text_key",
        )
    )


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark occurs in every document."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contamination(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_SQL_WORDS = (
    f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS t FROM
  (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS t FROM
  (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM grams JOIN win USING (n, t)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""
