"""Licence scans with Spark expressions only.

Each line, each blank-line separated paragraph, the whole text and every run of
consecutive lines of at most RUN times a template's words are units.  A
unit's normalised text (lower case, every run of other characters a space) is
compared with licence templates by the Dice coefficient over distinct word
bigrams, 2 |A n B| / (|A| + |B|).  A coefficient of at least t needs sizes with
t / (2 - t) <= |A| / |B| <= (2 - t) / t, so templates outside these bounds are
pruned before any intersection, and a unit too short for all of them is never cut
into bigrams.  It also needs t / (2 - t) of a template's bigrams, so a text that
has fewer of every template's is not cut into units at all.  Runs are folded from
each line start; a bigram counts where its last place before is ahead of the start.
Templates are literals of the plan; nothing is shuffled.

Defined results: null text and texts without a match have a null licence, dice 0
and an empty list; ties go to the first licence by name; repeated rows get equal
results; an empty table gives an empty result; other columns pass through; a column named
like a result is replaced.
"""

from __future__ import annotations

import json
import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.llm.license_texts import TEMPLATES
from careerloom.llm.shared import extended, let

THRESHOLD = 0.8
#: A run of lines has at most this many times the words of the template it is compared with.
RUN = 2
_NOT_WORD = r"[^a-z0-9]+"
_TEMPLATE_TYPE = "array<struct<name:string,n:int,words:int,grams:array<bigint>>>"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_NOT_WORD, text.lower()) if w]


def bigrams(text: str) -> set[tuple[str, str]]:
    words = _words(text)
    return set(zip(words, words[1:]))


def gram_hash(pair: tuple[str, str]) -> int:
    """The value of Spark's xxhash64(first, second)."""
    h = 42
    for word in pair:
        h = xxhash.xxh64_intdigest(word.encode(), seed=h)
    return h - 2**64 if h >= 2**63 else h


def _literal(templates: list[tuple[str, str]]) -> Column:
    rows = [{"name": name, "n": len(g), "words": len(_words(text)), "grams": sorted(map(gram_hash, g))} for name, text in templates if (g := bigrams(text))]
    return F.from_json(F.lit(json.dumps(rows)), _TEMPLATE_TYPE)


def units(text: Column) -> Column:
    lines, paragraphs = F.split(text, "\n", -1), F.split(text, r"\n[\x20\x09\r]*\n", -1)
    return F.array_distinct(F.concat(F.array(text), paragraphs, lines))


def _unit_words(unit: Column) -> Column:
    return F.filter(F.split(F.lower(unit), _NOT_WORD, -1), lambda w: w != "")


def _grams(w: Column) -> Column:
    """The bigram hash at each place; empty below two words."""
    each = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1)))
    return F.when(F.size(w) > 1, each).otherwise(F.array().cast("array<bigint>"))


def _runs(text: Column, near: Column, threshold: float) -> Column:
    """array of struct(dice, name): the best run of lines for each template of ``near``."""
    low = threshold / (2 - threshold)
    # an upper-case E, which lower-case text has not, marks the last word of a line
    marked = F.filter(F.split(F.regexp_replace(F.concat(F.lower(text), F.lit("\n")), r"([a-z0-9])[^a-z0-9\n]*\n", "$1E "), "[^a-z0-9E]+", -1), lambda w: w != "")

    def of_grams(w: Column, grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("at"))))
        linked = lambda o: F.transform(
            o, lambda x, i: F.struct(x["at"].alias("at"), x["h"].alias("h"), F.coalesce(F.when(F.get(o, i - 1)["h"] == x["h"], F.get(o, i - 1)["at"]), F.lit(0)).alias("before"), F.element_at(w, x["at"] + 1).endswith("E").alias("end"))
        )
        starts = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda s: (s == 1) | F.get(w, s - 2).endswith("E"))

        def best(cells: Column, first: Column, t: Column) -> Column:
            def after(a: Column, c: Column) -> Column:
                new = c["before"] < first
                size, both = a["size"] + new.cast("int"), a["both"] + (new & c["hit"]).cast("int")
                return F.struct(size.alias("size"), both.alias("both"), F.when(c["end"], F.greatest(a["best"], 2.0 * both / (size + t["n"]))).otherwise(a["best"]).alias("best"))

            zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("both"), F.lit(0.0).alias("best"))
            run = F.slice(cells, first, RUN * t["words"] - 1)
            enough = F.size(F.filter(run, lambda c: c["hit"])) >= low * t["n"] - 1e-9
            return F.when(enough, F.aggregate(run, zero, after, lambda a: a["best"])).otherwise(0.0)

        def of_template(places: Column, lines: Column, t: Column) -> Column:
            cells = F.transform(places, lambda c: F.struct(F.array_contains(t["grams"], c["h"]).alias("hit"), c["before"].alias("before"), c["end"].alias("end")))
            dice = let(cells, lambda x: F.array_max(F.transform(lines, lambda s: best(x, s, t))))
            return F.struct(dice.alias("dice"), t["name"].alias("name"))

        of_places = lambda p: let(starts, lambda lines: F.transform(near, lambda t: of_template(p, lines, t)))
        return let(ordered, lambda o: let(F.sort_array(linked(o)), of_places))

    bare = lambda w: F.transform(w, lambda x: F.translate(x, "E", ""))
    found = let(marked, lambda w: let(let(bare(w), _grams), lambda g: of_grams(w, g)))
    return F.filter(found, lambda s: s["dice"] >= threshold)


def matches(text: Column, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """array of struct(dice, name): every (unit, template) at or above the threshold."""
    sizes = [len(bigrams(t)) for _, t in templates]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    table = _literal(templates)

    def against(grams: Column) -> Column:
        n = F.size(grams)
        near = F.filter(table, lambda t: (n >= low * t["n"]) & (n <= high * t["n"]))
        scored = F.transform(near, lambda t: F.struct((2.0 * F.size(F.array_intersect(grams, t["grams"])) / (n + t["n"])).alias("dice"), t["name"].alias("name")))
        fits = F.filter(scored, lambda s: s["dice"] >= threshold)
        return F.when((n >= low * min(sizes)) & (n <= high * max(sizes)), fits)

    def of_words(w: Column) -> Column:
        return F.when(F.size(w) - 1 >= max(1.0, low * min(sizes)), let(F.array_distinct(_grams(w)), against))

    every = F.array(*[F.lit(h) for h in sorted({gram_hash(g) for _, t in templates for g in bigrams(t)})]).cast("array<bigint>")

    def reachable(hits: Column) -> Column:
        return F.filter(table, lambda t: F.size(F.array_intersect(hits, t["grams"])) >= low * t["n"] - 1e-9)

    def found(near: Column) -> Column:
        alone = F.flatten(F.array_compact(F.transform(units(text), lambda u: let(_unit_words(u), of_words))))
        return F.when(F.size(near) > 0, F.concat(alone, _runs(text, near, threshold))).otherwise(F.array().cast("array<struct<dice:double,name:string>>"))

    hits = F.array_intersect(let(_unit_words(text), _grams), every)
    return let(let(hits, reachable), found)


def scan(df: DataFrame, *, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with license (the best), dice and licenses (all, sorted)."""
    body = F.coalesce(F.col(text), F.lit(""))

    def summary(found: Column) -> Column:
        best = F.element_at(F.array_sort(F.transform(found, lambda m: F.struct((-m["dice"]).alias("cost"), m["name"].alias("name")))), 1)
        some = F.size(found) > 0
        return F.struct(
            F.when(some, best["name"]).alias("license"),
            F.when(some, -best["cost"]).otherwise(0.0).alias("dice"),
            F.array_sort(F.array_distinct(F.transform(found, lambda m: m["name"]))).alias("licenses"),
        )

    return extended(df, let(matches(body, templates, threshold), summary), ["license", "dice", "licenses"])
