"""Relational operators: filters, fills, joins, aggregates, windows and sets.

S, P, J, A, W and U of the inventory that are more than one built-in call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from careerloom.functions.draws import draw
from careerloom.operators.ordered import beside


def within(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value is there and in [low, high]."""
    return df.where(F.col(column).between(low, high))


def exact_length(df: DataFrame, column: str, size: int) -> DataFrame:
    """P2"""
    return df.where(F.length(column) == size)


#: Cells that stand for nothing.
JUNK = ("", "nan", "none")


def without_junk(df: DataFrame, column: str) -> DataFrame:
    """P3"""
    return df.where(F.col(column).isNotNull() & ~F.lower(F.trim(column)).isin(*JUNK))


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become their column's exact median; a one-row aggregate is joined in."""
    medians = df.agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    return df.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def member(df: DataFrame, keys: DataFrame, on: Sequence[str], *, inside: bool = True) -> DataFrame:
    """Semi or anti join by key."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi" if inside else "left_anti")


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], value: str, default: Column | None = None) -> DataFrame:
    """A left join that adds ``value``, with a default where there is no match."""
    out = df.join(dim.select(*on, value), list(on), "left")
    return out if default is None else out.withColumn(value, F.coalesce(F.col(value), default))


def mean_lookup(train: DataFrame, test: DataFrame, on: Sequence[str], target: str, name: str = "pred") -> DataFrame:
    """Group mean of the training rows, else their global mean."""
    means = train.where(F.col(target).isNotNull()).groupBy(*on).agg(F.avg(target).alias(name))
    overall = train.agg(F.avg(target).alias("_overall"))
    return test.join(means, list(on), "left").crossJoin(F.broadcast(overall)).withColumn(name, F.coalesce(name, "_overall")).drop("_overall")


#: Phrases up to this number are broadcast and tested against every text.
FEW_PHRASES = 1000


def contains_join(texts: DataFrame, phrases: DataFrame, text: str, phrase: str, *, least_chars: int = 4) -> DataFrame:
    """(text row, phrase) where the text holds the phrase as a raw substring.

    Few phrases, which is checked, are broadcast to the texts.  Beyond that both sides
    are joined on g-grams first, since a phrase of at least g characters holds its own
    first g-gram; only hashes are exploded, the text joins back for the pairs that
    share one, and the substring test decides.
    """
    g = least_chars
    left, right = texts.where(F.length(text) >= g), phrases.where(F.length(phrase) >= g)
    held = F.col(text).contains(F.col(phrase))
    if phrases.limit(FEW_PHRASES + 1).count() <= FEW_PHRASES:
        return left.join(F.broadcast(right), held)
    key = [F.xxhash64(text).alias("_k"), F.md5(F.col(text).cast("binary")).alias("_k2")]
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - g + 1), lambda i: F.xxhash64(F.substring(F.col(text), i, F.lit(g)))))
    hashed = left.select(*key, F.explode(grams).alias("_g")).distinct()
    pairs = hashed.join(right.withColumn("_g", F.xxhash64(F.substring(phrase, 1, g))), "_g").drop("_g")
    return left.withColumns({"_k": key[0], "_k2": key[1]}).join(pairs, ["_k", "_k2"]).where(held).drop("_k", "_k2")


def grid(*dims: DataFrame) -> DataFrame:
    """Every combination of small dimension values."""
    out = dims[0].distinct()
    for d in dims[1:]:
        out = out.crossJoin(beside(d.distinct()))
    return out


def candidates(entities: DataFrame, items: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every item that an entity does not have yet; the item dimension is the small side."""
    return entities.crossJoin(beside(items)).join(known.select(*on), list(on), "left_anti")


def counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """A1, A10: rows a key, null keys left out."""
    some = df
    for k in keys:
        some = some.where(F.col(k).isNotNull())
    return some.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def frequency_encoding(train: DataFrame, test: DataFrame, key: str, name: str) -> DataFrame:
    """A key's frequency in the training rows, 0 for an unseen one."""
    return lookup(test, counts(train, key, name=name), [key], name, F.lit(0))


def lowest_mode(df: DataFrame, by: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value, the lowest among ties."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.mode(F.col(value), True).alias(name))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str, value: str) -> DataFrame:
    """A14"""
    return df.unpivot(list(ids), list(values), variable, value)


def pivot_mean(df: DataFrame, key: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    """A15"""
    return df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(key).pivot(column, list(values)).agg(F.avg(value))


def pivot_count(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Counts by column value, 0 where there is none."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0, list(values))


def row_mean(columns: Sequence[str]) -> Column:
    """Mean over the columns that are not null."""
    there = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of their key."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def prevalence(links: DataFrame, tags: DataFrame, group: str, link: str, tag: str, *, least: float = 0.0) -> DataFrame:
    """Share of a group's links that carry the tag."""
    sizes = links.select(group, link).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n_links"))
    pairs = links.select(group, link).distinct().join(tags.select(link, tag).distinct(), link).groupBy(group, tag).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(sizes, group).withColumn("prevalence", F.col("n") / F.col("n_links")).where(F.col("prevalence") > least)


def leverage(core: DataFrame, item: str) -> DataFrame:
    """Number of entities with the item, and its share of the largest such number."""
    n = core.groupBy(item).agg(F.count(F.lit(1)).alias("n_core"))
    top = n.agg(F.max("n_core").alias("_top"))
    return n.crossJoin(F.broadcast(top)).withColumn("leverage", F.col("n_core") / F.col("_top")).drop("_top")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each identity along a total order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """W6"""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def top_with_ties(df: DataFrame, by: Sequence[str], score: str, k: int) -> DataFrame:
    """Rows at or above a group's k-th largest score."""
    w = W.partitionBy(*by).orderBy(F.col(score).desc())
    return df.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= k).drop("_r")


def best_and_worst(df: DataFrame, label: str, metric: str) -> DataFrame:
    """The labels of the largest and smallest metric, ties to the smallest label."""
    return df.agg(
        F.min_by(label, F.struct((-F.col(metric)).alias("a"), F.col(label).alias("b"))).alias("best"), F.min_by(label, F.struct(F.col(metric).alias("a"), F.col(label).alias("b"))).alias("worst")
    )


def n_lower(df: DataFrame, group: str, rating: str, name: str = "n_lower") -> DataFrame:
    """Rows of the group with a strictly lower rating."""
    return df.withColumn(name, F.rank().over(W.partitionBy(group).orderBy(rating)) - 1)


def sample_profile(df: DataFrame, by: str, item: str, rating: str, n: int, strategy: str, salt: str = "42") -> DataFrame:
    """``n`` rows of each profile, core first or uniform."""
    order = [F.col(rating).desc(), F.col(item)] if strategy == "core_first" else [draw(by, item, salt=salt), F.col(item)]
    return top_per_group(df, [by], order, n).drop("rank")


def sample_rows(df: DataFrame, key: str, n: int, salt: str = "42") -> DataFrame:
    """``n`` rows by hash order."""
    return df.withColumn("_d", draw(key, salt=salt)).orderBy("_d", key).limit(n).drop("_d")
