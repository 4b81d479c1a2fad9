"""Substring dedup: words covered by a window that also starts in a smaller document go.

Rows are dealt into groups by a hash of the whole row. A group hashes every window of ``size`` words
(Rabin-Karp over word hashes). Two rounds of counting in Spark find the windows that other groups
have too:

* every window is stood for by the least hash of the ``GRAM``-word stretches in it, which equal
  windows share and a quarter of all stretches are at most. A group sends each once; Spark counts in
  how many groups a stretch is. Windows whose stretch no other group has cannot occur elsewhere.
* of the rest a group sends every distinct window once with its smallest key. Spark finds the
  smallest key of all groups, and windows with a larger one go back to their group.

The group hashes its windows once more, marks those that came back and what its own order says, and
merges marked windows into maximal intervals.

Scale: a passage that a third of all rows share is one entry per group, not per row. Entries are
counted in sorted runs that spill; no task holds a bucket or the entries of one hash in memory, and a
group holds about ``group_bytes`` of text whatever the input, repeated keys and repeated rows
included. The text is shuffled once: all uses of the dealt rows share one exchange. A window is told
by 80 bits, 64 of its hash and 16 of another: of 10^13 windows about 40 pairs would be taken for
equal wrongly, of 10^9 none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticelake.llm.common import mix, prepare, release, rolling, utf8, word_hashes, words

#: Words of a stretch, and bits of a window's second hash.
GRAM, _CHECK = 7, 16


class _Windows:
    """The windows of a group's rows, which are sorted by key."""

    def __init__(self, table: pa.Table, size: int):
        self.size = size
        self.keys = table["key"].fill_null(np.iinfo(np.int64).max).to_numpy()
        self.data, self.offsets = utf8(table["text"])
        self.starts, self.ends, self.first = words(self.data, self.offsets)
        self.of_words = word_hashes(self.data, self.starts, self.ends)
        row = np.repeat(np.arange(len(table)), np.diff(self.first))
        n = max(0, len(row) - size + 1)
        self.at = np.flatnonzero(row[:n] == row[size - 1 : size - 1 + n])
        self.row = row[self.at]

    def stretches(self) -> np.ndarray:
        """Of every window, the least hash of the stretches in it."""
        gram = min(GRAM, self.size)
        h = rolling(self.of_words, tuple(range(gram)))
        n = len(h) - (self.size - gram)
        least = np.minimum.reduce([h[i : i + n] for i in range(self.size - gram + 1)]) if n > 0 else h[:0]
        return least[self.at].view(np.int64)

    def tell(self, some: np.ndarray | slice = slice(None)) -> None:
        """Tells windows, all or some, apart: equal ones have the same ``entry``, ``firsts`` is the first of each.

        Windows come in order of the row, so that the first of equal ones has the smallest key.
        """
        self.at, self.row = self.at[some], self.row[some]
        # the second hash runs over words mixed once more
        second = rolling(mix(self.of_words + np.uint64(1)), tuple(range(self.size)))
        self.hash = rolling(self.of_words, tuple(range(self.size)))[self.at].view(np.int64)
        self.check = (second[self.at] & np.uint64((1 << _CHECK) - 1)).astype(np.int64)
        order = np.argsort(self.hash, kind="stable")
        sorted_h = self.hash[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_h[1:] != sorted_h[:-1]
        if np.any(~new & (self.check[order] != self.check[np.roll(order, 1)])):  # equal hashes of different windows
            order = np.lexsort((np.arange(len(order)), self.check, self.hash))
            new[1:] = (np.diff(self.hash[order]) != 0) | (np.diff(self.check[order]) != 0)
        self.firsts = order[new]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1


def _ordered(table: pa.Table) -> pa.Table:
    """Sorted by key, null last, then by what the rows hold, so that any order of arrival gives the same."""
    return table.sort_by([("key", "ascending"), ("text", "ascending")])


_ENTRY = pa.schema([("hash", pa.int64()), ("key", pa.int64()), ("part", pa.int64()), ("mark", pa.int64())])


def _first_places(values: np.ndarray) -> np.ndarray:
    """Where every distinct value stands first, in order of the places."""
    return np.sort(np.unique(values, return_index=True)[1])


def _stretches(size: int):
    def stretches(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        found = _Windows(_ordered(table), size).stretches()
        found = found[_first_places(found)]
        release()
        return pa.table({"stretch": pa.array(found), "part": pa.array(np.full(len(found), part, np.int64))})

    return stretches


def _entries(size: int):
    def entries(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows or not shared.num_rows:
            return _ENTRY.empty_table()
        part = table["part"][0].as_py()
        w = _Windows(_ordered(table), size)
        w.tell(np.isin(w.stretches(), shared["stretch"].to_numpy()))
        at = np.sort(w.firsts)  # neighbours in a text stay neighbours, which compresses their keys
        out = pa.Table.from_arrays([pa.array(w.hash[at]), pa.array(w.keys[w.row[at]]), pa.array(np.full(len(at), part, np.int64)), pa.array(w.check[at])], schema=_ENTRY)
        release()
        return out

    return entries


def _remove(size: int):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _ordered(table)
        w = _Windows(table, size)
        w.tell()
        seen = np.zeros(len(w.firsts), bool)
        told, check = answers["hash"].to_numpy(), answers["mark"].to_numpy()
        own = w.hash[w.firsts]
        lo, hi = np.searchsorted(own, told), np.searchsorted(own, told, "right")
        while len(lo):  # equal hashes with another check follow each other
            same = w.check[w.firsts[lo]] == check
            seen[lo[same]] = True
            go = ~same & (lo + 1 < hi)
            lo, hi, check = lo[go] + 1, hi[go], check[go]
        hit = seen[w.entry] | (w.keys[w.row] > w.keys[w.row[w.firsts[w.entry]]])
        # +1 where a repeated window starts, -1 after its last word: covered where the sum is positive
        n_words = len(w.starts)
        edge = np.zeros(n_words + 1, np.int64)
        np.add.at(edge, w.at[hit], 1)
        np.add.at(edge, w.at[hit] + size, -1)
        gone = np.cumsum(edge)[:-1] > 0
        run = np.diff(gone.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(run[:-1] == 1), np.flatnonzero(run == -1)
        # no run spans two rows unless both are covered at their meeting point: cut there
        row_of = np.repeat(np.arange(len(table)), np.diff(w.first))
        cuts = w.first[1:-1][(w.first[1:-1] > 0) & (w.first[1:-1] < n_words)]
        inner = cuts[gone[cuts] & gone[cuts - 1]] if len(cuts) else cuts
        begin, end = np.unique(np.concatenate((begin, inner))), np.unique(np.concatenate((end, inner)))
        count = np.bincount(row_of[begin], minlength=len(table)) if len(begin) else np.zeros(len(table), np.int64)
        shift = w.first[row_of[begin]] if len(begin) else begin
        spans = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()),
            pa.StructArray.from_arrays([pa.array(begin - shift, pa.int64()), pa.array(end - shift, pa.int64())], ["start", "end"]),
        )
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.first[:-1]) if len(table) else np.zeros(0, np.int64)
        removed[np.diff(w.first) == 0] = 0
        kept = [_join(w, gone, i) for i in range(len(table))]
        return pa.table({"key": table["key"], "n_words": pa.array(np.diff(w.first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed": spans, "kept": pa.array(kept, pa.string())})

    return remove


def _join(w: _Windows, gone: np.ndarray, i: int) -> str:
    """The words of a row that stay, joined by one space."""
    a, b = w.first[i], w.first[i + 1]
    if a == b:
        return ""
    lo = w.starts[a]
    raw = w.data[lo : w.ends[b - 1]]
    # a byte stays if its word does, and so does one space after every word
    length = np.where(gone[a:b], 0, w.ends[a:b] - w.starts[a:b] + 1)
    total = int(length.sum())
    if not total:
        return ""
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    at = np.arange(total) - np.repeat(begin, length) + np.repeat(w.starts[a:b] - lo, length)
    last = np.cumsum(length)[length > 0] - 1
    at[last] = 0
    out = raw[at]
    out[last] = 0x20
    return out[:-1].tobytes().decode("utf-8")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 13, group_bytes: int = 1 << 21) -> DataFrame:
    """Per row: ``key``, ``n_words``, ``n_removed``, ``removed`` (word intervals, end exclusive), ``kept``.

    A word goes if a window of ``size`` words that covers it also starts in a row with a smaller key;
    windows are judged on the input. Null or empty text: no words. Fewer than ``size`` words: nothing
    goes. Repeated rows with one key do not count against each other. A null key is larger than any.
    Other columns are ignored whatever their names.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    size_of = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    parts = max(256, -(-size_of // group_bytes))
    # rows are told apart by all they hold, equal rows by where they are read
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key", "text", F.spark_partition_id()), F.lit(parts)))
    # in how many groups a stretch is, and the smallest key of a window, in sorted runs
    stretches = dealt.groupBy("part").applyInArrow(_stretches(size), "stretch long, part long")
    shared = stretches.withColumn("n", F.count("*").over(W.partitionBy("stretch"))).where("n > 1").select("part", "stretch")
    entries = dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_entries(size), "hash long, key long, part long, mark long")
    later = entries.withColumn("least", F.min("key").over(W.partitionBy("hash", "mark"))).where("key > least").select("part", "hash", "mark")
    done = dealt.groupBy("part").cogroup(later.groupBy("part")).applyInArrow(_remove(size), "key long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string")
    return done.select(F.col("key").alias(key), "n_words", "n_removed", "removed", "kept")
