"""Problem 8: mixing sources to target weights.

Sizes are tokens of a public tokenizer. Each listed source has a budget, its share of the
total; a source is repeated whole as often as the budget and its cap allow, and the rest of
the budget is filled with a subset of its documents chosen by subset-sum fitting:

1. documents are counted by exact token length (a histogram, made in Spark with a map-side
   combine),
2. a bounded-knapsack dynamic programme over the histogram picks how many documents of
   each length go in, the bulk in proportion to the histogram and the last stretch exactly,
3. the documents themselves are taken per (source, length) in the order of a seeded hash.

Step 3 never ranks a whole group in one task: ranks come from counts of hash ranges, and
only the one range in which the quota runs out is ordered.

Defined results
---------------
* Documents with a null or blank source, or one that is not listed, do not count at all.
* Null or empty text has zero tokens; such documents are never needed and never chosen.
* Sources compare trimmed and in lower case; duplicate target rows of one source raise.
* A listed source without documents has size 0 and misses any positive share.
* Empty ``documents`` give a total of 0, so no source misses its share.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.runtime import table, written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SEED = 20240607
#: Width of the exact dynamic programme, in tokens, and of the hash ranges of step 3.
EXACT_TOKENS, HASH_RANGES = 1 << 15, 1024


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(spark: SparkSession, column, path: str = TOKENIZER):
    """Tokens of whole texts; 0 for null. The vocabulary file is sent along: only the driver needs it at its path."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(SparkFiles.get(name))
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(column)


def _key(column):
    return F.lower(F.trim(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")))


def sized(documents: DataFrame, targets: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, tokens)`` of the documents of listed sources.

    The list of targets is small by nature (one row a source); the join is left to the
    planner, which broadcasts it only under its size threshold.
    """
    listed = targets.select(_key("source").alias("source")).where("source <> ''").distinct()
    docs = documents.select("doc_id", _key("source").alias("source"), F.col("text").alias("_text"))
    return docs.join(listed, "source", "left_semi").select("doc_id", "source", token_count(documents.sparkSession, "_text", tokenizer).alias("tokens"))


def shares(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: size, budget, size at the cap, and whether it can reach its share."""
    per = sizes.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("docs"))
    want = _wanted(targets)
    joined = want.join(per, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("docs", F.lit(0)).alias("docs"))
    total = F.coalesce(sizes.agg(F.sum("tokens")).scalar(), F.lit(0))
    return joined.withColumn("total", total).select(
        "*", (F.col("target_share") * F.col("total")).alias("budget"), (F.col("max_repeats") * F.col("size")).alias("reach"),
    ).withColumn("misses", F.col("reach") < F.col("budget"))


def _wanted(targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats)``; a source listed twice is an error."""
    rows = targets.select(_key("source").alias("source"), "target_share", F.coalesce(F.col("max_repeats"), F.lit(1)).alias("max_repeats")).where("source <> ''")
    once = rows.groupBy("source").agg(F.count("*").alias("_n"), F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats"))
    twice = F.raise_error(F.concat(F.lit("source listed twice: "), F.col("source")))
    return once.select("source", F.when(F.col("_n") == 1, F.col("target_share")).otherwise(twice.cast("double")).alias("target_share"), "max_repeats")


def fit(lengths: list[int], counts: list[int], budget: int, exact: int = EXACT_TOKENS) -> list[int]:
    """How many documents of each length to take so that the total comes nearest to ``budget`` from below.

    Proportional bulk first, then exact bounded knapsack over the remainder: reachable
    sums are bits of an integer, each length split into powers of two of its copies.
    """
    size = sum(n * c for n, c in zip(lengths, counts))
    budget = min(budget, size)
    if budget == size:
        return list(counts)
    bulk = max(0, budget - exact // 2)
    take = [c * bulk // size if size else 0 for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):  # down to the exact stretch
        if rest <= exact:
            break
        more = min(counts[i] - take[i], max(0, (rest - exact // 2)) // lengths[i]) if lengths[i] else 0
        take[i] += more
        rest -= more * lengths[i]
    sums, mask, steps = 1, (1 << (rest + 1)) - 1, []
    for i, n in enumerate(lengths):
        left = min(counts[i] - take[i], rest // n) if n else 0
        k = 1
        while left > 0:
            k = min(k, left)
            steps.append((i, k, sums))
            sums |= (sums << (k * n)) & mask
            left -= k
            k *= 2
        if sums >> rest & 1:
            break
    at = sums.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    return take


def quotas(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, tokens, repeats, quota)``: full passes over a source, and documents of one length taken once more."""
    hist = sizes.where("tokens > 0").groupBy("source", "tokens").agg(F.count("*").alias("n"))
    plan = hist.join(shares(sizes, targets).select("source", "budget", "size", "max_repeats"), "source")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        # one row a distinct token length: bounded by the longest document, not by the rows
        pdf = pdf.sort_values("tokens")
        size, budget = int(pdf["size"].iloc[0]), float(pdf["budget"].iloc[0])
        cap = int(pdf["max_repeats"].iloc[0])
        whole = min(cap, int(budget // size))
        rest = 0 if whole >= cap else round(budget - whole * size)
        pdf["repeats"] = whole
        pdf["quota"] = fit(pdf["tokens"].astype(int).tolist(), pdf["n"].astype(int).tolist(), rest)
        return pdf[["source", "tokens", "n", "repeats", "quota"]]

    return plan.groupBy("source").applyInPandas(choose, "source string, tokens long, n long, repeats long, quota long")


def mix(documents: DataFrame, targets: DataFrame, *, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, tokens, times)`` of the mixture; documents used zero times are left out."""
    sizes = written(sized(documents, targets, tokenizer=tokenizer).where("tokens > 0"))
    quota = written(quotas(sizes, targets))
    # one length of one source may hold a third of all documents: its quota is sent to eight salts
    salted = quota.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(7))))
    keyed = sizes.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("int")).join(salted, ["source", "tokens", "_s"]).drop("_s").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")).withColumn(
        "_range", F.pmod("_h", F.lit(HASH_RANGES)).cast("int"))
    # cumulative counts of hash ranges: only the range where the quota runs out is ordered
    ranges = keyed.where("quota > 0 and quota < n").groupBy("source", "tokens", "quota", "_range").agg(F.count("*").alias("_c"))
    before = ranges.selectExpr("*", "sum(_c) over (partition by source, tokens order by _range) - _c as _before")
    cut = before.where("_before < quota").selectExpr("source", "tokens", "_range", "quota - _before as _room", "quota - _before < _c as _partly")
    split = keyed.where("quota > 0 and quota < n").join(cut, ["source", "tokens", "_range"], "left")
    inside = split.where("not coalesce(_partly, true)").select("doc_id", "source", "tokens", (F.col("repeats") + 1).alias("times"))
    ranked = split.where("_partly").selectExpr("*", "row_number() over (partition by source, tokens order by _h, doc_id) as _rn")
    edge = ranked.selectExpr("doc_id", "source", "tokens", "repeats + cast(_rn <= _room as bigint) as times")
    outside = split.where("_room is null").select("doc_id", "source", "tokens", F.col("repeats").alias("times"))
    rest = keyed.where("quota = 0 or quota >= n").selectExpr("doc_id", "source", "tokens", "repeats + cast(quota >= n as bigint) as times")
    return inside.unionByName(edge).unionByName(outside).unionByName(rest).where("times > 0")


def fitted(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """What the mixture holds of each listed source, ``(source, budget, used, short)``.

    ``short`` is a source that stays below its budget though every one of its documents is used as often as allowed.
    """
    used = quotas(sizes, targets).groupBy("source").agg(F.sum(F.expr("tokens * (n * repeats + quota)")).alias("used"))
    rows = shares(sizes, targets).join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return rows.select("source", "budget", "used", F.expr("used < budget and used = reach").alias("short"))


def found(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    sizes = written(sized(table(spark, d, "documents"), targets).select("source", "tokens"))
    return fitted(sizes, targets).where("short").select("source")


def report(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by the mixture, beside those wanted."""
    targets = table(spark, d, "mix_targets")
    used = mix(table(spark, d, "documents"), targets).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("times")).alias("used_tokens"), F.sum("times").alias("used_docs"), F.max("times").alias("most_times"))
    used = written(used)
    rows = _wanted(targets).join(used, "source", "left").fillna(0, ["used_tokens", "used_docs", "most_times"])
    return rows.withColumn("_total", used.agg(F.sum("used_tokens")).scalar()).select("source", "target_share", "max_repeats", "used_tokens", "used_docs", "most_times",
                                        F.round(F.expr("try_divide(used_tokens, _total)"), 6).alias("share"))


QUERIES = {"p8_found": found, "p8_shares": report}
