"""Text functions as Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python and Unicode understand it, for Java's regular expressions.
SPACE = r"(?U)[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, rf"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def squashed(c: Column) -> Column:
    """Lower case, inner white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(folded(c), SPACE + "+", " "))


def folded(c: Column) -> Column:
    """Case-folded: as lower case, but letters that have several small forms come out as one."""
    return F.translate(F.regexp_replace(F.lower(F.upper(c)), "ß", "ss"), "ςſ", "σs")


def preview(c: Column, limit: int = 2000) -> Column:
    """The value itself, or its head with a note of what is missing."""
    cut = F.concat(F.substring(c, 1, limit), F.lit("… [truncated "), (F.length(c) - limit).cast("string"), F.lit(" of "),
                   F.length(c).cast("string"), F.lit(" chars]"))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def token_estimate(c: Column, chars_per_token: float = 3.5) -> Column:
    return F.floor(F.length(c) / chars_per_token).cast("int")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def analysed(c: Column) -> Column:
    """Lower-case letter and digit runs: the standard analyser of the sparse index."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def similarity(a: Column, b: Column) -> Column:
    """Edit similarity of two values in squashed form; 1 if both are empty."""
    x, y = squashed(a), squashed(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(x, y) / longest)


#: What counts as yes and as no.
TRUE_TOKENS, FALSE_TOKENS = ("true", "tak", "yes", "1"), ("false", "nie", "no", "0")


def to_bool(c: Column) -> Column:
    """Yes or no from a text token in Polish or English; null for anything else."""
    t = F.lower(strip(c))
    return F.when(t.isin(*TRUE_TOKENS), F.lit(True)).when(t.isin(*FALSE_TOKENS), F.lit(False))


def without_markdown(c: Column) -> Column:
    """Plain text: emphasis, code, heading and quote marks removed, list hyphens kept."""
    # fixed values: the marks of Markdown and the order in which they are taken off, which results depend on
    steps = [
        (r"```[a-zA-Z0-9_-]*\n?", ""), (r"`", ""),
        (r"(?s)\*\*(.+?)\*\*", "$1"), (r"(?s)__(.+?)__", "$1"), (r"(?s)\*(.+?)\*", "$1"),
        (r"(?sU)(?<!\w)_(.+?)_(?!\w)", "$1"),
        (r"(?mdU)^[\s\x1c-\x1f]{0,3}#{1,6}[\s\x1c-\x1f]*", ""), (r"(?mdU)^[\s\x1c-\x1f]{0,3}>[\s\x1c-\x1f]?", ""),
        (r"\*\*", ""),
    ]
    out = F.coalesce(c, F.lit(""))
    for pattern, put in steps:
        out = F.regexp_replace(out, pattern, put)
    return strip(out)


def coerced(value: Column, vocabulary: Column, *, threshold: float = 0.80, tie: float = 0.02) -> Column:
    """The one vocabulary entry within ``tie`` of the best similarity, if that reaches ``threshold``.

    ``vocabulary`` is an array: a request's short list travels in the row, so no join and
    no pair outside the row arises. Null value or empty vocabulary give null.
    """
    scored = F.transform(vocabulary, lambda v: F.struct(similarity(value, v).alias("s"), v.alias("v")))
    best = F.array_max(F.transform(scored, lambda x: x["s"]))
    winners = F.filter(scored, lambda x: x["s"] >= best - tie)
    return F.when(value.isNotNull() & (best >= threshold) & (F.size(winners) == 1), F.try_element_at(winners, F.lit(1))["v"])


def with_coerced(df: DataFrame, out: str, value: str, vocabulary: str, *, threshold: float = 0.80, tie: float = 0.02) -> DataFrame:
    """``coerced`` as a column, computed in steps so that no similarity is worked out twice."""
    scores = F.transform(vocabulary, lambda v: F.struct(similarity(F.col(value), v).alias("s"), v.alias("v")))
    df = df.withColumn("_scores", scores).withColumn("_best", F.array_max(F.transform("_scores", lambda x: x["s"])))
    df = df.withColumn("_won", F.filter("_scores", lambda x: x["s"] >= F.col("_best") - tie))
    one = F.when(F.col(value).isNotNull() & (F.col("_best") >= threshold) & (F.size("_won") == 1), F.try_element_at("_won", F.lit(1))["v"])
    return df.withColumn(out, one).drop("_scores", "_best", "_won")
