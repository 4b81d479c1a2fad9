"""Benchmark decontamination by spaced seeds.

A seed is a span of words of which a fixed mask reads five and ignores the rest, so that replaced
words under ignored positions do not spoil it. Seeds of benchmark items and of training texts are
hashed and joined. Every hit names an item and a diagonal, the shift between item and text; along it
the words are compared one by one, and a window of ``window`` item words (the whole item if it is
shorter) of which at least ``similarity`` are the same makes the text contaminated.

Seven item words or more always keep a seed whole under the replacements that ``similarity`` allows.
Shorter items have masks of their own: all of their words, and for five or six words, of which one
may be replaced, every choice that leaves one out.

Words are runs of letters and digits, A-Z lower-cased: ASCII punctuation and white space separate.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.columns import aside
from noticelake.llm.common import in_slices, mix, prepare, rolling, slices, utf8, word_hashes, words

#: Positions that a mask reads. All read five words; all but the first skip some.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 1, 4, 6, 7))
#: Items of fewer words than this have masks of their own length.
SHORT = 7
#: Benchmark words, and bytes of its texts, up to which the benchmark is sent to every task: a word is
#: 24 bytes and a few seeds, an item's text never leaves the driver.
BROADCAST_WORDS, BROADCAST_BYTES = 1_000_000, 64 << 20


def masks_of(length: int, similarity: float) -> list[tuple[int, ...]]:
    """The positions read of a short item so that no replacements that ``similarity`` allows spoil all."""
    free = length - math.ceil(similarity * length - 1e-9)
    return [tuple(i for i in range(length) if i not in out) for out in itertools.combinations(range(length), free)]

_SEPARATOR = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows of an Arrow array, and the first word's index of every row."""
    data, offsets = utf8(column)
    data = _LOWER[data]
    starts, ends, first = words(data, offsets, _SEPARATOR)
    return word_hashes(data, starts, ends), first


def seeds(h: np.ndarray, first: np.ndarray, short: tuple[int, ...], similarity: float, items: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and position of every seed of every row.

    ``short`` are the lengths of short items there are. Texts have seeds for them at every place,
    ``items`` of such a length none but these.
    """
    length = np.diff(first)
    row = np.repeat(np.arange(len(first) - 1), length)
    keys, rows, at = [], [], []

    def add(mask: tuple[int, ...], span: int, name: int, of: np.ndarray | None) -> None:
        n = max(0, len(h) - span + 1)
        k = rolling(h, mask)[:n]
        inside = row[:n] == row[span - 1 : span - 1 + n]
        if of is not None:
            inside &= of[row[:n]]
        keys.append(k[inside] + mix(np.array([name], np.uint64))[0])
        rows.append(row[:n][inside])
        at.append(np.flatnonzero(inside) - first[row[:n][inside]])

    for number, mask in enumerate(MASKS):
        add(mask, mask[-1] + 1, number + 1, length >= SHORT if items else None)
    for size in short:
        for number, mask in enumerate(masks_of(size, similarity)):
            add(mask, size, 1000 * size + number, length == size if items else None)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(at)


def _short_lengths(first: np.ndarray) -> tuple[int, ...]:
    return tuple(sorted(n for n in set(np.diff(first).tolist()) if 0 < n < SHORT))


def overlap(item: np.ndarray, text: np.ndarray, shift: int, window: int) -> tuple[int, int]:
    """The most equal words in a window of the item laid over the text at ``shift``; the window's length."""
    size = min(window, len(item))
    same = np.zeros(len(item) + 1, np.int64)
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    same[lo + 1 : hi + 1] = item[lo:hi] == text[lo + shift : hi + shift]
    total = np.cumsum(same)
    return int((total[size:] - total[: len(total) - size]).max()), size


class _Index:
    """The benchmark's seeds in a sorted array, with the items' words."""

    def __init__(self, ids: list[int], h: np.ndarray, first: np.ndarray, similarity: float):
        self.ids, self.h, self.first, self.similarity = ids, h, first, similarity
        self.short = _short_lengths(first)
        key, row, at = seeds(h, first, self.short, similarity, items=True)
        order = np.argsort(key, kind="stable")
        self.key, self.row, self.at = key[order], row[order], at[order]
        self.maybe = np.zeros(1 << 22, bool)  # a first look that most seeds of a text do not survive
        self.maybe[(key >> np.uint64(42)).astype(np.int64)] = True

    def matches(self, column: pa.Array, window: int) -> list[list[tuple[int, float]]]:
        h, first = hashed_words(column)
        key, row, at = seeds(h, first, self.short, self.similarity)
        some = self.maybe[(key >> np.uint64(42)).astype(np.int64)]
        key, row, at = key[some], row[some], at[some]
        lo, hi = np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")
        n = hi - lo
        hit = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        found = np.unique(np.stack((np.repeat(row, n), self.row[hit], np.repeat(at, n) - self.at[hit]), 1), axis=0)
        out: list[dict[int, float]] = [{} for _ in range(len(column))]
        for r, item, shift in found.tolist():
            words_of = self.h[self.first[item] : self.first[item + 1]]
            same, size = overlap(words_of, h[first[r] : first[r + 1]], shift, window)
            if same >= math.ceil(self.similarity * size - 1e-9):
                name = self.ids[item]
                out[r][name] = max(out[r].get(name, 0.0), same / size)
        return [sorted(x.items()) for x in out]


_MATCHES = "array<struct<item_id:bigint,overlap:double>>"


def _matched(lists: list[list[tuple[int, float]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("overlap", pa.float64())]))
    return pa.array([[{"item_id": i, "overlap": o} for i, o in x] for x in lists], kind)


def with_matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "matches", window: int = 13, similarity: float = 0.8,
    broadcast_words: int = BROADCAST_WORDS, broadcast_bytes: int = BROADCAST_BYTES, key: str = "doc_id",
) -> DataFrame:
    """Adds ``out``: the benchmark items found in every text with their best overlap, by item.

    Null and empty texts match nothing. Items with a null id or without a word are never found. Items
    with equal ids count as one. A column named ``out`` is replaced. A benchmark of up to
    ``broadcast_words`` words and ``broadcast_bytes`` bytes is sent to all tasks and the texts stay
    where they are; beyond, seeds are joined by a shuffle, which needs ``key`` to tell rows apart
    (rows with equal key and text share their matches).
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{item_text}`").cast("string").alias("words")).where("item is not null and words is not null")
    count = F.size(F.split("words", "[^A-Za-z0-9\\x{80}-\\x{10FFFF}]+"))
    size = items.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("b")).first()
    if size["n"] > broadcast_words or size["b"] > broadcast_bytes:
        return _joined(docs, items, text, key, out, window, similarity)
    rows = items.distinct().orderBy("item", "words").toArrow()
    h, first = hashed_words(rows["words"])
    index = spark.sparkContext.broadcast(_Index(rows["item"].to_pylist(), h, first, similarity))

    @F.arrow_udf(_MATCHES)
    def matches(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda part: _matched(index.value.matches(part, window)))

    return docs.withColumn(out, matches(F.col(f"`{text}`").cast("string")))


def _exploded(short: tuple[int, ...], similarity: float, items: bool):
    def explode(batches):
        for batch in batches:
            for a, b in slices(batch["words"]):
                part = batch.slice(a, b - a)
                h, first = hashed_words(part["words"])
                key, row, at = seeds(h, first, short, similarity, items)
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(row)), pa.array(key.view(np.int64)), pa.array(at)], ["id", "seed", "at"])

    return explode


def _lengths(batches):
    for batch in batches:
        short = _short_lengths(hashed_words(batch["words"])[1])
        yield pa.RecordBatch.from_arrays([pa.array(short, pa.int64())], ["n"])


def _joined(docs: DataFrame, items: DataFrame, text: str, key: str, out: str, window: int, similarity: float) -> DataFrame:
    named = lambda *columns: F.unhex(F.md5(F.concat_ws("\1", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in columns])))
    kept = [c for c in docs.columns if c != out]
    inner = aside(docs.select(*[F.col(f"`{c}`") for c in kept]), key, text)
    rows = inner.withColumn("__id", named(key, text))
    texts = rows.select(F.col("__id").alias("id"), F.col(f"`{text}`").cast("string").alias("words"))
    of_items = items.select(named("item", "words").alias("id"), "item", "words").dropDuplicates(["id"])
    short = tuple(sorted(r["n"] for r in items.select("words").mapInArrow(_lengths, "n long").distinct().collect()))
    schema = "id binary, seed long, at long"
    left = of_items.select("id", "words").mapInArrow(_exploded(short, similarity, True), schema).select(F.col("id").alias("item_at"), "seed", F.col("at").alias("from"))
    hits = texts.mapInArrow(_exploded(short, similarity, False), schema).join(left, "seed").select("id", "item_at", (F.col("at") - F.col("from")).alias("shift")).distinct()
    near = hits.join(of_items.select(F.col("id").alias("item_at"), "item", F.col("words").alias("item_words")), "item_at").join(texts.dropDuplicates(["id"]), "id")

    @F.arrow_udf("double")
    def score(item_words: pa.Array, doc_words: pa.Array, shift: pa.Array) -> pa.Array:
        done = []
        for lo, hi in slices(doc_words):
            a, fa = hashed_words(item_words.slice(lo, hi - lo))
            b, fb = hashed_words(doc_words.slice(lo, hi - lo))
            got = [overlap(a[fa[i] : fa[i + 1]], b[fb[i] : fb[i + 1]], s, window) for i, s in enumerate(shift.slice(lo, hi - lo).to_pylist())]
            done += [same / size if same >= math.ceil(similarity * size - 1e-9) else None for same, size in got]
        return pa.array(done, pa.float64())

    scored = near.select("id", "item", score("item_words", "words", "shift").alias("overlap")).where("overlap is not null")
    best = scored.groupBy("id", "item").agg(F.max("overlap").alias("overlap"))
    lists = best.groupBy(F.col("id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct(F.col("item").alias("item_id"), "overlap"))).alias("__matches"))
    joined = rows.join(lists, "__id", "left")
    return joined.select(*[F.col(f"`{c}`") for c in inner.columns], F.coalesce("__matches", F.array().cast(_MATCHES))).toDF(*kept, out)
