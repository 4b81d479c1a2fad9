"""Runs of repeated words: online dyadic square catching.

Every completed block of 2^k words sets a catcher, which waits while the next 2 * 2^k words are appended. Each
appended word ends a suffix of 2^k words; where the suffix equals the block, the words between their starts
are a period of 2^k to 2^(k+1) - 1, and the catcher reports a square. A stretch of three periods or
more holds such a block whole, wherever the grid of blocks lies, so none is missed. Squares of one
period in blocks that follow each other merge; what they leave open at both ends, less than a block,
is found by comparing suffixes of halving length. Equal stretches keep their smallest period.

All words of a slice are appended at once, each level in one numpy pass; rows are parted by words that
equal none. Words are numbered exactly; suffixes are compared by 64-bit names, and every run is held
against its words in the end. A text of n words takes O(n log n) steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import BLANK, mix, prepare, release, slices, utf8, words

#: Least number of periods in a run; a catcher's block lies whole in any stretch of three.
EXPONENT = 3
#: Beyond so many words only every third level is kept for the comparisons at the ends.
_DENSE = 1 << 22


def _names(ids: np.ndarray, seed: int) -> np.ndarray:
    return mix(ids.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64))


def _ahead(levels: list[tuple[int, int, np.ndarray]], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words after ``a`` and ``b`` (before them, if ``step`` is -1) are equal: less than the blocks compared last."""
    done = np.zeros(len(a), np.int64)
    for size, times, name in reversed(levels):
        for _ in range(times):
            x = a + done if step > 0 else a - done - size
            y = b + done if step > 0 else b - done - size
            inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(name))
            same = inside.copy()
            same[inside] = name[x[inside]] == name[y[inside]]
            if not same.any():
                break
            done += size * same
    return done


def catch(ids: np.ndarray, longest: int, shortest: int, seed: int = 0) -> np.ndarray:
    """All runs in ``ids`` as rows of start, end and smallest period, by start, end.

    ``longest`` bounds the length of a run; ``shortest`` is the least length of one.
    """
    name, size, levels, found = _names(ids, seed), 1, [], [np.zeros((0, 3), np.int64)]
    stride = 1 if len(ids) < _DENSE else 3
    while EXPONENT * size <= longest:
        # the suffix that starts at i waits for the catcher of the block before the block of i
        at = np.flatnonzero(name[size:] == np.repeat(name[::size], size)[: max(len(name) - size, 0)]) + size
        block = (at // size - 1) * size
        period = at - block
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        fresh = np.ones(len(block), bool)
        fresh[1:] = (np.diff(period) != 0) | (np.diff(block) != size)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(block))[: len(first)] - 1
        a, z, p = block[first], block[last], period[first]
        may = z - a + size + p + 2 * (size - 1) >= np.maximum(shortest, EXPONENT * p)
        a, z, p = a[may], z[may] + size, p[may]
        start = a - _ahead(levels, a, a + p, -1)
        end = z + p + _ahead(levels, z, z + p, 1)
        run = end - start >= np.maximum(shortest, EXPONENT * p)
        found.append(np.stack((start, end, p), 1)[run])
        k = size.bit_length() - 1
        if k % stride == 0:
            levels.append((size, 1, name))
        else:  # the level below is used again in this one's place
            low, times, kept = levels[-1]
            levels[-1] = (low, 2 * times + 1, kept)
        if len(name) <= size:
            break
        name = mix(name[:-size] * np.uint64(0xD6E8FEB86659FD93) + name[size:])
        size *= 2
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[new]
    if any(not np.array_equal(ids[s : e - p], ids[s + p : e]) for s, e, p in runs.tolist()):
        return catch(ids, longest, shortest, seed + 1)  # two stretches had one name
    return runs


_RESULT = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,text:string>"


def _of(texts: pa.Array, shortest: int) -> pa.Array:
    data, offsets = utf8(texts)
    s, e, first = words(data, offsets)
    n, rows, count = len(s), len(texts), np.diff(first)
    stops = np.concatenate(([0], np.cumsum(e - s)))
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(stops), pa.py_buffer(np.ascontiguousarray(data[~BLANK[data]]))])
    row = np.repeat(np.arange(rows), count)
    ids = np.empty(n + rows, np.int64)
    ids[np.arange(n) + row] = packed.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ids[first[1:] + np.arange(rows)] = n + np.arange(rows)  # a word of its own after every row
    runs = catch(ids, int(count.max(initial=0)), shortest)
    base = first[:-1] + np.arange(rows)
    owner = np.searchsorted(base, runs[:, 0], "right") - 1
    per = np.bincount(owner, minlength=rows)
    # words after a run's first period go
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.cumsum(change)[np.arange(n) + row] == 0
    ks, ke, kr = s[kept], e[kept], row[kept]
    closing = np.ones(len(ks), bool)
    closing[:-1] = kr[1:] != kr[:-1]
    mark = np.zeros(len(data) + 2, np.int8)
    np.add.at(mark, ks, 1)
    np.add.at(mark, np.where(closing, ke, ke + 1), -1)  # with one blank after it, but for a row's last
    raw = data[np.cumsum(mark[:-2], dtype=np.int8) > 0]
    raw[BLANK[raw]] = 0x20
    size = np.bincount(kr, ke - ks + ~closing, minlength=rows).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(raw)).cast(pa.string())
    each = pa.StructArray.from_arrays([pa.array(c) for c in (runs[:, 0] - base[owner], runs[:, 1] - runs[:, 0], runs[:, 2])], ["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), each.take(pa.array(np.lexsort((runs[:, 2], runs[:, 0])))))
    return pa.StructArray.from_arrays([pa.array(count, pa.int64()), listed, text], ["n_words", "runs", "text"])


def with_runs(docs: DataFrame, text: str = "text", out: str = "periodic", shortest: int = 24) -> DataFrame:
    """Adds to every row a struct ``out``: ``n_words``, ``runs`` and ``text``, what is left without repetitions.

    A run is a longest stretch of at least ``shortest`` words and three of its smallest period; runs have
    ``start`` (word number), ``length`` and ``period``, by start, then period. A word goes if any run
    has it after the run's first period; the words left are joined by one space. Null, empty and blank texts
    have no words, no runs and an empty text. Repeated rows and all other columns stay; one named ``out`` is replaced.
    """
    prepare(docs.sparkSession)

    @F.arrow_udf(_RESULT)
    def found(texts: pa.Array) -> pa.Array:
        parts = []
        for a, b in slices(texts):
            parts.append(_of(texts.slice(a, b - a), shortest))
            release()
        return pa.concat_arrays(parts) if parts else _of(texts, shortest)

    return docs.withColumn(out, found(F.col(f"`{text}`").cast("string")))
