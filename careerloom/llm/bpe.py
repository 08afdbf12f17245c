"""Byte-level BPE encoding and decoding.

The rank file becomes a literal of the plan: an array of buckets by hash, each a
small map from a token's bytes (hexadecimal) to its rank.  A word's bytes are
folded: each step of ``aggregate`` merges the leftmost pair of smallest rank and
renews the two ranks beside it, as the tiktoken library does.  Decoding
concatenates the binary pieces of the ids.

``encode`` runs the same fold over distinct words in Arrow batches; ``encode_native``
runs it in Spark expressions only and is exact too, but about a hundred times as
slow on words that are not frequent (README, figures), so the query uses ``encode``.

In ``encode_native`` words that are frequent in a bounded sample of documents (CACHE_DOCS) are folded
once, as distinct words, and their ids become a second literal of at most
CACHE_WORDS words; every other word is folded where it stands.  The sample only
decides where a word is folded, never its ids, and no occurrence is shuffled.

Defined results: null text counts as empty and has no ids; repeated rows get equal
results; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careerloom.llm.shared import let

#: Buckets of the literal rank map: about six tokens each, since a map literal is searched in order.
BUCKETS = 8192
_NONE = 2**31 - 1
#: \\s of the pattern for an engine whose \\s is ASCII only.
_WHITE = r"\t-\r\x20\x85\xA0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def java_pattern(pattern: str) -> str:
    """The split pattern with explicit white space classes."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_WHITE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)", rf"[{_WHITE}]+(?![^{_WHITE}])").replace(r"\s+", rf"[{_WHITE}]+")


def rank_literal(ranks: dict[bytes, int], buckets: int = BUCKETS) -> Column:
    table: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in ranks.items():
        key = token.hex()
        h = xxhash.xxh64_intdigest(key.encode(), seed=42)
        table[(h - 2**64 if h >= 2**63 else h) % buckets][key] = rank
    return F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<map<string,int>>")


def rank_of(table: Column, token: Column, buckets: int = BUCKETS) -> Column:
    return F.coalesce(F.try_element_at(F.get(table, F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")), token), F.lit(_NONE))


def split_words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def encode_word(word: Column, table: Column, buckets: int = BUCKETS) -> Column:
    """Ids of one match of the pattern."""
    rank = lambda t: rank_of(table, t, buckets)
    state_type = "struct<p:array<string>,r:array<int>>"

    def step(state: Column, _: Column) -> Column:
        def merged(x: Column) -> Column:
            p, r, i = x["p"], x["r"], x["i"]
            one = F.concat(F.element_at(p, i), F.element_at(p, i + 1))
            before = F.when(i > 1, F.array(rank(F.concat(F.element_at(p, i - 1), one)))).otherwise(F.array().cast("array<int>"))
            after = F.when(i + 2 <= F.size(p), F.array(rank(F.concat(one, F.element_at(p, i + 2))))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(p, 1, i - 1), F.array(one), F.slice(p, i + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, 1, F.greatest(i - 2, F.lit(0))), before, after, F.slice(r, i + 2, F.size(p))).alias("r"),
            ).cast(state_type)

        least = F.array_min(state["r"])
        at = F.struct(state["p"].alias("p"), state["r"].alias("r"), F.array_position(state["r"], least).cast("int").alias("i"))
        return F.when(F.coalesce(least, F.lit(_NONE)) == _NONE, state).otherwise(let(at, merged))

    def fold(p: Column) -> Column:
        first = F.struct(p.alias("p"), F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: rank(F.concat(a, b))).alias("r")).cast(state_type)
        pieces = F.aggregate(F.sequence(F.lit(2), F.size(p)), first, step)["p"]
        return F.transform(F.when(F.size(p) < 2, p).otherwise(pieces), rank)

    text = F.lower(F.hex(word.cast("binary")))
    whole = lambda h: F.when(rank(h) != _NONE, F.array(rank(h))).otherwise(let(F.regexp_extract_all(h, F.lit(".."), F.lit(0)), fold))
    return let(text, whole)


CACHE_DOCS, CACHE_WORDS, CACHE_WORD_BYTES = 4000, 50_000, 32


def frequent_words(df: DataFrame, text: str, pattern: str, table: Column) -> dict[str, list[int]]:
    """Ids of the words that are most frequent in a sample of at most about CACHE_DOCS documents."""
    share = int(min(1.0, CACHE_DOCS / max(1, df.count())) * (1 << 30))
    sample = df.where(F.pmod(F.xxhash64(F.lit(13), text), F.lit(1 << 30)) < share)
    words = sample.select(F.explode(split_words(F.coalesce(F.col(text), F.lit("")), pattern)).alias("w"))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where((F.octet_length("w") <= CACHE_WORD_BYTES) & (F.col("n") > 1))
    top = counts.orderBy(F.desc("n"), "w").limit(CACHE_WORDS).select("w", encode_word(F.col("w"), table).alias("ids"))
    return {r.w: list(r.ids) for r in top.collect()}


def _cache_literal(known: dict[str, list[int]]) -> Column:
    rows: list[dict[str, list[int]]] = [{} for _ in range(BUCKETS)]
    for word, ids in known.items():
        h = xxhash.xxh64_intdigest(word.encode(), seed=42)
        rows[(h - 2**64 if h >= 2**63 else h) % BUCKETS][word] = ids
    return F.from_json(F.lit(json.dumps(rows, separators=(",", ":"))), "array<map<string,array<int>>>")


def encode_native(df: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text") -> DataFrame:
    """``df`` with ids (array<int>), by Spark expressions only."""
    table = rank_literal(ranks)
    cache = _cache_literal(frequent_words(df, text, pattern, table))
    known = lambda w: F.try_element_at(F.get(cache, F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")), w)
    words = split_words(F.coalesce(F.col(text), F.lit("")), pattern)
    return df.withColumn("ids", F.flatten(F.transform(words, lambda w: F.coalesce(known(w), encode_word(w, table)))))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of ids: their binary pieces one after another."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


#: Words kept with their ids by one worker, and the longest of them; a memory bound, not a limit on words.
KEPT_WORDS, KEPT_CHARS = 400_000, 64
#: Words of more bytes are folded with a heap of pairs.
LONG_WORD = 200


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the leftmost pair of smallest rank merges until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    costs = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while costs:
        least = min(costs)
        if least == _NONE:
            break
        i = costs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n steps: pairs wait in a heap by (rank, place); outdated ones are skipped."""
    n = len(word)
    stop = list(range(1, n + 1))  # end of the part that starts here; 0 once it has been merged away
    before = list(range(-1, n - 1))
    heap = []

    def push(i: int) -> None:
        j = stop[i]
        if j < n:
            rank = ranks.get(word[i : stop[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, j, stop[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if stop[i] != j or stop[j] != end:
            continue
        stop[i], stop[j] = end, 0
        if end < n:
            before[end] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : stop[i]]])
        i = stop[i]
    return out


class _Known(dict):
    """Ids of the words a worker has met, as little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        ids = np.array(fold(word.encode("utf-8", "surrogatepass"), self.ranks), "<i4").tobytes()
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


@functools.cache
def _known(rank_path: str) -> _Known:
    return _Known(read_ranks(rank_path))


def encode(df: DataFrame, rank_path: str, pattern: str, *, text: str = "text") -> DataFrame:
    """``df`` with ids (array<int>); a column of that name is replaced."""
    columns = [c for c in df.columns if c.lower() != "ids"]
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    at = [c.lower() for c in columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(java_pattern(pattern)).findall
        ids_of = _known(rank_path).__getitem__
        for batch in batches:
            sizes, parts = [0], []
            for value in batch.column(at):
                body = value.as_py()
                ids = b"".join(map(ids_of, find(body))) if body else b""
                parts.append(ids)
                sizes.append(sizes[-1] + len(ids) // 4)
            flat = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], names=[*columns, "ids"])

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
