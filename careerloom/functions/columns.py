"""Column functions: codes, lookups, text and vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from careerloom.schemas import CODE_WIDTH, CORE_AT_LEAST, IRRELEVANT_AT_MOST


def pad_code(code: Column, width: int = CODE_WIDTH) -> Column:
    """left-pad with zeros; longer codes stay whole."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def first_token(text: Column, sep: str) -> Column:
    """F2"""
    return F.substring_index(text, sep, 1)


def code_group(code: Column, digits: int) -> Column:
    """the level of a code hierarchy."""
    return F.substring(code, 1, digits)


def tier(code: Column) -> Column:
    """the education tier is the second digit of the padded code."""
    return F.substring(pad_code(code), 2, 1)


def recode(value: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """Recode through a dictionary; unknown values become ``default`` (null)."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(pairs, value)
    return found if default is None else F.coalesce(found, default)


def tier_label(code: Column, labels: Mapping[str, str]) -> Column:
    """a tier's label, or TEER and the digit where it has none."""
    return recode(tier(code), labels, F.concat(F.lit("TEER "), tier(code)))


def is_core(rating: Column, at_least: float = CORE_AT_LEAST) -> Column:
    return rating >= at_least


def band(rating: Column) -> Column:
    """Core, irrelevant or ambiguous."""
    return F.when(rating >= CORE_AT_LEAST, "core").when(rating <= IRRELEVANT_AT_MOST, "irrelevant").otherwise("ambiguous")


def clip(x: Column, low: float = 0.0, high: float = 5.0) -> Column:
    """P11"""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def direction(first: Column, last: Column) -> Column:
    """P14"""
    return F.when(last > first, "up").when(last < first, "down").otherwise("flat")


def verdict(confidence: Column, threshold: Column) -> Column:
    """Abstain without a rule or below it, else confident."""
    return F.when(threshold.isNull(), "never reliable").when(confidence < threshold, "abstain").otherwise("confident")


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def slug(text: Column, prefix: str = "") -> Column:
    """F6"""
    return F.concat(F.lit(prefix), F.regexp_replace(F.lower(text), " ", "_"))


def strip_boilerplate(text: Column) -> Column:
    """drop an expander's trailing label and collapse blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)\s*show more\s*show less\s*$", ""), r"[ \t]+", " "))


def tokens(text: Column, pattern: str = r"[a-z0-9+#]+") -> Column:
    """F8"""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def singular(word: Column) -> Column:
    """drop one trailing s of words longer than three."""
    return F.when((F.length(word) > 3) & word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def singular_phrase(text: Column) -> Column:
    """F9 over a phrase's words."""
    return F.array_join(F.transform(tokens(text, "[a-z0-9]+"), singular), " ")


def leading_phrase(name: Column, separators: str = r",|\(|/| and ") -> Column:
    """the phrase before the first separator."""
    return F.trim(F.split(name, separators, 2)[0])


#: Function words that tell the languages of postings apart.
LANGUAGE_WORDS = {"en": ("the", "and", "of", "to", "in", "for", "with"), "fr": ("le", "la", "les", "et", "des", "pour", "une")}


def detect_language(text: Column, words: Mapping[str, Sequence[str]] = LANGUAGE_WORDS, head: int = 4000) -> Column:
    """the language with most function words in the text's head; ties go to the first, none is other."""
    seen = F.split(F.lower(F.substring(text, 1, head)), r"[^a-z]+")
    among = lambda v: lambda w: w.isin(*v)
    hits = {k: F.size(F.filter(seen, among(v))) for k, v in words.items()}
    best = F.greatest(*hits.values())
    out = F.lit("other")
    for k in reversed(list(hits)):
        out = F.when((hits[k] == best) & (best > 0), k).otherwise(out)
    return out


def sentences(text: Column, low: int = 8, high: int = 300, cap: int = 60) -> Column:
    """sentences of ``low`` characters or more, cut to ``high``, the first ``cap``."""
    parts = F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.substring(F.trim(s), 1, high))
    return F.slice(F.filter(parts, lambda s: F.length(s) >= low), 1, cap)


def token_set(text: Column) -> Column:
    """distinct tokens without their trailing s characters, longer than two."""
    bare = F.transform(F.split(F.lower(text), r"[^a-z0-9+#]+"), lambda w: F.regexp_replace(w, "s+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: F.length(w) > 2))


def overlap(a: Column, b: Column) -> Column:
    """shared share of the smaller set; 0 for an empty one."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / smaller)


def canonical_key(text: Column) -> Column:
    """F15"""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9+#]", "")


def described(name: Column, text: Column) -> Column:
    """Name and description as one lower-case text."""
    return F.lower(F.concat_ws(". ", name, F.coalesce(text, F.lit(""))))


def parse_rated(items: Column) -> Column:
    """``name:rating, name`` as structs; a missing or bad rating is 4, ratings are clipped to 0..5."""
    part = lambda s: F.split(s, ":", 2)
    return F.transform(
        F.filter(F.transform(F.split(items, ","), F.trim), lambda s: s != ""),
        lambda s: F.struct(F.lower(F.trim(part(s)[0])).alias("name"), clip(F.coalesce(F.try_to_number(F.trim(F.get(part(s), F.lit(1))), F.lit("9.9")).cast("double"), F.lit(4.0))).alias("rating")),
    )


def dot(a: Column, b: Column) -> Column:
    """F24"""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    """F24"""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where a norm vanishes."""
    length = norm(a) * norm(b)
    return F.when(length <= 1e-12, 0.0).otherwise(dot(a, b) / length)


def one_hot(index: Column, size: int) -> Column:
    """F27"""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("double"))
