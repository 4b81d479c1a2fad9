"""SimHash near-dedup with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments A and B of 23 bits and C of 18. The binary Golay code
[23,12,7] has one codeword within distance 3 of any word; a word at distance 3 has five more within
distance 4. Two words at most two bits apart always share one of these codewords: the codeword
nearest to a word between them is within distance 4 of both. So a segment is keyed by the indices of
its codewords within distance 4, and two errors are put into their place by the pigeonhole principle:

* A exact: any errors in B leave a shared codeword, key (A, codeword of B);
* B exact: key (B, codeword of A);
* neither exact: one error in each and C exact, key (C, codeword of A).

Distinct fingerprints are joined by key and verified. A key that many fingerprints share is not
expanded into pairs: its members are hung on their one-bit variants instead, since two words are at
most two bits apart exactly when their balls of radius one meet. That is exact and linear.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.columns import aside
from noticelake.llm.common import in_slices, prepare, release, utf8
from noticelake.operators.components import components
from noticelake.storage import cut

_LANES = np.uint64(0x0101010101010101)


def majority(h: np.ndarray) -> np.uint64:
    """The bits that more than half of some hashes have set."""
    out = np.uint64(0)
    # bit counts in byte lanes, 255 hashes at a time so that no lane runs over
    block = np.arange(0, len(h), 255)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, block).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        for byte in np.flatnonzero(2 * lanes > len(h)):
            out |= np.uint64(1) << np.uint64(8 * int(byte) + bit)
    return out


def fingerprints_of(column: pa.Array, size: int) -> np.ndarray:
    """The fingerprint of every text of an Arrow array as unsigned 64-bit integers."""
    data, offsets = utf8(column)
    out = np.zeros(len(column), np.uint64)
    digest = xxhash.xxh64_intdigest
    raw = data.tobytes()
    for i in range(len(column)):
        parts = raw[offsets[i] : offsets[i + 1]].lower().split()  # of bytes: A-Z only, and the six blanks
        n = len(parts)
        if not n:
            continue
        line = b" ".join(parts)
        if n <= size:
            out[i] = digest(line, 42)
            continue
        stop = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20), len(line))
        begins = [0, *(stop[: n - size] + 1).tolist()]
        h = np.array([digest(line[a:b], 42) for a, b in zip(begins, stop[size - 1 :].tolist(), strict=True)], np.uint64)
        out[i] = majority(h)
    return out


def with_fingerprint(docs: DataFrame, text: str, out: str, size: int = 3) -> DataFrame:
    """Adds the fingerprint of ``text`` as a signed 64-bit column; null and empty texts have zero."""
    prepare(docs.sparkSession)

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda part: pa.array(fingerprints_of(part, size).view(np.int64)))

    return docs.withColumn(out, fingerprint(F.col(f"`{text}`").cast("string")))


_GENERATOR = 0b101011100011  # the code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the leader's index change; and up to six codeword changes within distance 4.

    A word is split into its 12 message bits and the syndrome of its 11 check bits. For every
    syndrome the table lists the error patterns of weight 4 at most, least first.
    """
    def syndrome(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for bit in range(22, 10, -1):
            v ^= np.where(v >> bit & 1, _GENERATOR << (bit - 11), 0)
        return v

    bits = np.int64(1) << np.arange(23, dtype=np.int64)
    patterns = [np.zeros(1, np.int64)]
    idx = np.zeros((1, 0), np.int64)
    for weight in range(1, 5):
        idx = np.array([(*r, c) for r in idx for c in range(r[-1] + 1 if len(r) else 0, 23)], np.int64)
        patterns.append(bits[idx].sum(1))
    p = np.concatenate(patterns)
    s = syndrome(p)
    order = np.argsort(s, kind="stable")
    start = np.searchsorted(s[order], np.arange(2048))
    count = np.bincount(s, minlength=2048)
    table = np.full((2048, int(count.max())), -1, np.int64)
    for k in range(2048):
        table[k, : count[k]] = p[order[start[k] : start[k] + count[k]]]
    return table, count, syndrome(np.arange(1 << 12, dtype=np.int64) << 11)


def codewords(segment: np.ndarray) -> np.ndarray:
    """The 12-bit indices of all codewords within distance 4 of 23-bit words; -1 fills up a row."""
    table, _, checks = _golay()
    v = segment.astype(np.int64)
    errors = table[checks[v >> 11] ^ (v & 0x7FF)]
    return np.where(errors < 0, -1, (v[:, None] ^ errors) >> 11)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprints: any two at most two bits apart share a key."""
    a = (fp & np.uint64(0x7FFFFF)).astype(np.int64)
    b = (fp >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (fp >> np.uint64(46)).astype(np.int64)
    ca, cb = codewords(a), codewords(b)
    rows, keys = [], []
    for kind, exact, fuzzy in ((0, a, cb), (1, b, ca), (2, c, ca)):
        row, col = np.nonzero(fuzzy >= 0)
        rows.append(row)
        keys.append(np.int64(kind) << 40 | exact[row] << 12 | fuzzy[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches):
    for batch in batches:
        fp = batch["fp"].to_numpy()
        row, key = fuzzy_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])
    release()


def _variants(batches):
    flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
    for batch in batches:
        fp = batch["fp"].to_numpy()
        key = (fp.view(np.uint64)[:, None] ^ flips).view(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(fp, 65))], ["key", "fp"])


def links(distinct: DataFrame, bits: int = 2, full: int = 64) -> DataFrame:
    """Pairs ``src``, ``dst`` that connect exactly what fingerprints ``fp`` at most ``bits`` apart connect.

    Keys of up to ``full`` fingerprints are joined and verified; beyond, their members are linked over
    one-bit variants, which needs no pairs. ``bits`` is 2 at most, what the keys guarantee.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the Golay keys guarantee two bits at most")
    keys = cut(distinct.mapInArrow(_keys, "key long, fp long"), "fuzzy-keys")
    sizes = keys.groupBy("key").count().where("count > 1")
    sized = keys.join(sizes, "key")
    some = sized.where(f"count <= {full}").select("key", "fp")
    pairs = (
        some.alias("x").join(some.alias("y"), "key").where("x.fp < y.fp")
        .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits)
        .select(F.col("x.fp").alias("src"), F.col("y.fp").alias("dst"))
    )
    crowded = sized.where(f"count > {full}").select("fp").distinct()
    if bits == 2:
        near = crowded.mapInArrow(_variants, "key long, fp long")
        hub = near.groupBy("key").agg(F.min("fp").alias("src"), F.count("*").alias("n")).where("n > 1").select("key", "src")
        hung = near.join(hub, "key").where("fp <> src").select("src", F.col("fp").alias("dst"))
    else:  # at one bit or none a variant that both reach must be one of the two
        near = crowded.mapInArrow(_variants, "key long, fp long")
        hung = near.join(crowded.select(F.col("fp").alias("key")), "key").where("key < fp").select(F.col("key").alias("src"), F.col("fp").alias("dst"))
        if bits == 0:
            hung = hung.limit(0)
    return pairs.unionByName(hung).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, bits: int = 2) -> DataFrame:
    """Per row: ``key``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key reachable.

    Null, empty and blank texts have fingerprint zero and link like any other. Rows with a null key
    take part and have their group's id, which is null where no row of the group has a key. Repeated
    rows return as often as they came. Other columns are ignored.
    """
    rows = cut(with_fingerprint(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", "fp", size).select("key", "fp"), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("key").alias("least"))
    groups = components(links(distinct.select("fp"), bits))
    member = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = member.join(least, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less those whose group has a smaller key.

    Rows with a null key stay only if nothing in their group has a key.
    """
    found = near_duplicates(docs, key, text)
    stay = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__kept")).distinct()
    return aside(docs, key).join(stay, F.col(f"`{key}`").eqNullSafe(F.col("__kept")), "left_semi").toDF(*docs.columns)
