"""Quality rules with Spark expressions only.

Base rules look at one text; the method looks across documents: lines are
normalised (lower case, white space collapsed) and hashed, and for every host
the number of distinct documents that hold the line is counted.  Lines above the
limit are boilerplate: they are removed, and a document that keeps too small a
share of its words is depleted and rejected.

Copies of one document must not make its own lines look like boilerplate, so a
document is known, for the count of a line, by the hash of its text: exact copies
count once, any other documents that hold the line count each, whatever else they
share.

Defined results: null text has no words (it fails the base rules); a null host
is a host of its own; repeated rows get equal verdicts; words are runs of
characters other than the six ASCII white space characters; an empty table gives
an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.llm.shared import hidden, let, shared_table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line in more distinct documents of one host than this is boilerplate.
MAX_LINE_DOCS = 10
#: A document must keep this percentage of its words once boilerplate is gone.
MIN_KEPT_PERCENT = 30
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def line_hash(line: Column) -> Column:
    """60 bits of the MD5 digest of a normalised line; lines equal in them count as equal."""
    return F.conv(F.substring(F.md5(normal_line(line).cast("binary")), 1, 15), 16, 10).cast("long")


def _has_word(line: Column) -> Column:
    return F.translate(line, _SPACES, "") != ""


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more; sorts, so n log n in the words.

    Window hashes are sorted with their places in the low 31 bits; places whose upper
    bits meet a neighbour's are then sorted by the whole hash, which decides.
    """
    place = (1 << 31) - 1

    def meeting(ordered: Column, value) -> Column:
        """Places of the elements that share ``value`` with a neighbour."""
        same = lambda x, i: F.coalesce(value(F.get(ordered, i - 1)) == value(x), F.lit(False)) | F.coalesce(value(F.get(ordered, i + 1)) == value(x), F.lit(False))
        return F.filter(ordered, same)

    def spread(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(F.lit(3), b - a))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda total, gap: total + gap))

    def covered(windows: Column) -> Column:
        near = let(F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long")))), lambda o: meeting(o, lambda x: F.shiftright(x, 31)))
        # F.get is null outside the array, so the ends have one neighbour
        whole = lambda c: F.sort_array(F.transform(c, lambda x: F.struct(F.get(windows, x.bitwiseAND(F.lit(place)).cast("int")).alias("h"), x.bitwiseAND(F.lit(place)).cast("int").alias("i"))))
        twice = lambda c: let(whole(c), lambda o: F.sort_array(F.transform(meeting(o, lambda x: x["h"]), lambda x: x["i"])))
        return let(near, lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(let(twice(c), spread)))

    def count(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, covered))

    return let(words, count)


def measures(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text that is not null."""
    lines = F.filter(F.split(text, "\n", -1), _has_word)
    return [
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("_w"),
        F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]


def _row_key(doc: Column, text: Column) -> list[Column]:
    """96 bits that stand for a row's document in the joins below."""
    return [F.xxhash64(doc, text).alias("_k"), F.hash(text, doc).alias("_k2")]


def _lines(text: Column) -> Column:
    """struct(h, words) of each distinct normalised line; words counts every occurrence in the text."""
    each = F.transform(F.filter(F.split(text, "\n", -1), _has_word), lambda x: F.struct(line_hash(x).alias("h"), F.size(words_of(x)).cast("long").alias("words")))

    def summed(x: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i - 1)["h"] != F.get(x, i)["h"]))
        run = lambda s: F.transform(s, lambda at, i: F.struct(F.get(x, at)["h"].alias("h"), (F.get(x, at)["words"] * (F.coalesce(F.get(s, i + 1), F.size(x)) - at)).alias("words")))
        return F.when(F.size(x) < 2, x).otherwise(let(first, run))

    return let(F.sort_array(each), summed)


def _among(found: Column, h: Column) -> Column:
    """Whether the sorted array ``found`` holds ``h``: steps of halving size, so that long lists cost a logarithm."""
    step = lambda at, p: F.when(F.get(found, at + p - 1) <= h, at + p).otherwise(at)
    at = F.aggregate(F.array(*[F.lit(1 << b) for b in range(30, -1, -1)]), F.lit(0), step)
    long = F.coalesce(F.get(found, at - 1) == h, F.lit(False))
    return F.when(F.size(found) <= 64, F.array_contains(found, h)).otherwise(long)


def judge(df: DataFrame, *, doc: str = "doc_id", text: str = "text", host: str = "source", max_line_docs: int = MAX_LINE_DOCS, min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """A row per row of ``df``: id, measures, base_failed, kept, frequent line hashes (sorted) and the join key."""
    body = F.coalesce(F.col(text), F.lit(""))
    measured = df.select(
        F.col(doc).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("\x00")).alias("_host"), *_row_key(F.col(doc), F.col(text)), F.xxhash64(body).alias("_by"), *measures(body), _lines(body).alias("_lines")
    ).select("doc_id", "_host", "_k", "_k2", "_by", "_w.n_words", "word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words", "_lines")
    rows = shared_table(measured, "quality")
    held = rows.select("_host", "_k", "_k2", "_by", F.explode("_lines").alias("x")).select("_host", "_k", "_k2", "_by", "x.h", "x.words")
    frequent = held.select("_host", "h", "_by").distinct().groupBy("_host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_line_docs).select("_host", "h")
    # repeated rows have equal keys and equal lines: the set holds each line once
    found = held.join(frequent, ["_host", "h"]).groupBy("_k", "_k2").agg(F.collect_set(F.struct("h", "words")).alias("_lost"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        rows.drop("_lines", "_host", "_by")
        .join(found, ["_k", "_k2"], "left")
        .withColumn("frequent", F.sort_array(F.transform("_lost", lambda x: x["h"])))
        .withColumn("lost_words", F.coalesce(F.aggregate("_lost", F.lit(0).cast("long"), lambda n, x: n + x["words"]), F.lit(0).cast("long")))
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & (100 * (F.col("n_words") - F.col("lost_words")) >= min_kept_percent * F.col("n_words")))
        .drop("_lost")
    )


def clean(df: DataFrame, *, doc: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The rows of ``df`` that are kept, their texts without boilerplate lines; same columns."""
    a, b, lines = hidden(df, "_k"), hidden(df, "_k2"), hidden(df, "_frequent")
    verdict = judge(df, doc=doc, text=text, host=host, **limits).where("kept").dropDuplicates(["_k", "_k2"]).select(F.col("_k").alias(a), F.col("_k2").alias(b), F.col("frequent").alias(lines))
    k, k2 = _row_key(F.col(doc), F.col(text))
    trimmed = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x: ~(_has_word(x) & _among(F.col(lines), line_hash(x)))), "\n")
    out = df.withColumns({a: k, b: k2}).join(verdict, [a, b]).withColumn(text, F.when(F.col(lines).isNull(), F.col(text)).otherwise(trimmed))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length(text).cast(df.schema["n_chars"].dataType))
    return out.select(*df.columns)
