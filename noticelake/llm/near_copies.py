"""Near copies by five-word Jaccard: SimHash fingerprints and MinHash bands propose pairs, the whole texts decide.

A text is the set of its hashed five-word shingles; a shorter one is a single shingle. Sets whose SimHash
fingerprints differ in two bits at most come first, by the Golay keys of ``simhash``. At a Jaccard similarity of
0.8 fingerprints differ in 9.7 bits on average, beyond what fuzzy keys reach, so sets that are apart then go on to
20 bands of 5 MinHashes: two sets at 0.8 share one with probability 0.9996. Every proposed pair is verified on the whole
texts. Only what connects is of interest, and closest copies connect first: sets with three bands in a row in common,
then with two, are compared with two drawn ones of those that have them, which is linear, so that a large group of near
copies is mostly one before anything is paired. Then the sets of a band value that are still apart are compared in pairs. Where more than
``full`` sets have the value, they are proposed by their rarest shingles: sets at 0.8 must share one among their first ninth and fifth, in one
order of all shingles, and must have room for as many more as they need after it. That is exact, so no set is left out, and sets
that share their common text only are never paired, however many they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noticelake.llm.columns import aside
from noticelake.llm.common import in_slices, mix, prepare, release, rolling, slices, utf8, word_hashes, words
from noticelake.llm.simhash import links as fingerprint_links
from noticelake.llm.simhash import majority
from noticelake.operators.components import components
from noticelake.storage import cut, drop

SIZE = 5
#: Number and width of the bands: they find a pair at 0.8 with probability 0.9996.
BANDS, WIDTH = 20, 5
#: Seats in comparisons, some 40 bytes each, up to which they are sent to every task to fetch their texts.
BROADCAST_SEATS = 500_000
#: Seats that a task is given, and the most tasks that they are dealt to.
SEATS, MOST_TASKS = 2_000, 20_000
#: Comparisons with one set that are made in a row; further ones are made elsewhere.
ROW = 512
_SEEDS = mix(np.arange(1, BANDS * WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS = mix(np.arange(1001, 1001 + WIDTH, dtype=np.uint64)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; none of a text without words."""
    data, offsets = utf8(column)
    data = _LOWER[data]
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    rolled = rolling(h, tuple(range(size)))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = int(b - a)
        some = rolled[a : b - size + 1] if n >= size else rolling(h[a:b], tuple(range(n))) if n else h[:0]
        out.append(np.unique(some))
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band, of 32-bit MinHashes; a piece of the set at a time, so that long texts need no more memory."""
    turn, factor = (_SEEDS >> np.uint64(32)).astype(np.uint32), _SEEDS.astype(np.uint32) | np.uint32(1)
    x, step = (shingles >> np.uint64(32)).astype(np.uint32), 204_800 // (BANDS * WIDTH)
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), step):
        y = x[at : at + step, None] ^ turn
        y *= factor
        np.minimum(least, y.min(0), out=least)
    return mix((least.astype(np.uint64).reshape(BANDS, WIDTH) * _POWERS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _of_sets(of):
    """A function from texts to lists: what ``of`` makes of every text's set, after its name; a zero where the set is empty."""

    @F.arrow_udf("array<long>")
    def told(texts: pa.Array) -> pa.Array:
        def lists(part: pa.Array) -> pa.Array:
            return _lists([np.concatenate(([_name(s)], of(s))).view(np.int64) if len(s) else np.zeros(1, np.int64) for s in shingle_sets(part)])

        return in_slices(texts, lists, 1 << 19)

    return told


def _name(shingles: np.ndarray) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 42)) if len(shingles) else np.uint64(0)


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more, in whole numbers."""
    if 4 * max(len(x), len(y)) > 5 * min(len(x), len(y)):
        return False
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def _compare(batches):
    """Compares every set with the one that leads its row; rows come in order, leaders have no ``dst``."""
    leader, held = None, None
    for batch in batches:
        src, part, dst = (batch.column(name).to_pylist() for name in ("src", "part", "dst"))
        texts, found = batch.column("text"), []
        for a, b in slices(texts, 1 << 19):
            for i, s in enumerate(shingle_sets(texts.slice(a, b - a)), a):
                if int(_name(s).view(np.int64)) != (src[i] if dst[i] is None else dst[i]):
                    continue
                if dst[i] is None:
                    leader, held = (src[i], part[i]), s
                elif leader == (src[i], part[i]) and _alike(held, s):
                    found.append((src[i], dst[i]))
            release()
        yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["src", "dst"])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _near_marks(distinct: DataFrame) -> DataFrame:
    """Pairs that connect all sets whose fingerprints differ in two bits at most, as ``simhash`` links these: a set with the least of its fingerprint, and those."""
    heads = cut(distinct.where("mark is not null").groupBy("mark").agg(F.min("fp").alias("head")), "marks")
    near = fingerprint_links(heads.select(F.col("mark").alias("fp")))
    side = lambda n: heads.select(F.col("mark").alias(n), F.col("head").alias(f"{n}_head"))
    apart = near.join(side("src"), "src").join(side("dst"), "dst").select(F.col("src_head").alias("src"), F.col("dst_head").alias("dst"))
    same = distinct.join(heads, "mark").where("fp <> head").select(F.col("head").alias("src"), F.col("fp").alias("dst"))
    return apart.unionByName(same)


def _apart(keys: DataFrame, linked: DataFrame) -> DataFrame:
    """``key``, ``fp``, ``c``, its component, and ``n``, the sets of the key, for keys whose sets are not all connected."""
    placed = keys.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("c"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key", "n")
    return placed.join(sizes, "key")


def _in_common(distinct: DataFrame, width: int) -> DataFrame:
    """``key``, ``fp``: a key for every ``width`` bands in a row, the first after the last. Sets without words have no bands."""
    row = lambda i: F.xxhash64(*[F.get("bands", F.lit((i + j) % BANDS)) for j in range(width)])
    keys = F.array(*map(row, range(BANDS))) if width > 1 else F.col("bands")
    return distinct.where("size(bands) > 0").select(F.explode(keys).alias("key"), "fp")


def _first(apart: DataFrame) -> DataFrame:
    """Every set with two drawn ones of every key it has, where these are of another component."""
    drawn = [F.min(F.struct(F.xxhash64("key", "fp", F.lit(salt)).alias("h"), "fp", "c")) for salt in (1, 2)]
    hubs = apart.groupBy("key").agg(F.array(*drawn).alias("hubs"))
    hung = apart.join(hubs, "key").select("fp", "c", F.explode("hubs").alias("hub")).where("c <> hub.c")
    return hung.select(F.least("fp", "hub.fp").alias("src"), F.greatest("fp", "hub.fp").alias("dst")).distinct()


def _paired(some: DataFrame) -> DataFrame:
    """All pairs of a key that are not connected."""
    return some.alias("x").join(some.alias("y"), "key").where("x.fp < y.fp and x.c <> y.c").select(F.col("x.fp").alias("src"), F.col("y.fp").alias("dst"))


def _by_rarest(sets: DataFrame, named: DataFrame, distinct: DataFrame) -> DataFrame:
    """Pairs of ``sets`` (``fp``, ``c``), not connected, that have to be compared: all that may be alike are among them.

    Shingles are ordered by the number of sets that have them. Sets of m and n alike have o in common, 9 o >= 4 (m + n). The
    first one in common is at some place i of one set and j of the other, and all others come after: so 9 (m - i + 1) and
    9 (n - j + 1) are no less than 4 (m + n), which leaves the first ninth of the smaller set and the first fifth of the larger.
    Of a shingle's sets those of the component that has most of them are not held against each other.
    """
    held = _with_texts(sets.select("fp").distinct(), named, distinct).select("fp", _of_sets(lambda s: s)(F.col("text")).alias("s")).where("fp = get(s, 0)")
    each = cut(held.select("fp", (F.size("s") - 1).alias("n"), F.explode(F.slice("s", F.lit(2), F.size("s") - 1)).alias("shingle")), "shingles")
    rarity = each.groupBy("shingle").agg(F.count("*").alias("among"))
    order = W.partitionBy("fp").orderBy("among", "shingle")
    first = each.join(rarity, "shingle").withColumn("at", F.row_number().over(order)).where("among > 1 and 5 * (at - 1) <= n")
    first = cut(first.select("shingle", "fp", "n", "at").join(sets, "fp"), "rarest")
    mains = first.groupBy("shingle", "c").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("kinds"))
    told = first.join(mains.where("kinds > 1").select("shingle", F.col("m.c").alias("main")), "shingle").withColumn("main", F.col("c") == F.col("main"))
    x, y = told.where("9 * (at - 1) <= n").alias("x"), told.alias("y")
    room = "4 * (x.n + y.n)"
    met = F.expr(f"x.shingle = y.shingle and x.c <> y.c and struct(x.n, x.fp) < struct(y.n, y.fp) and 4 * y.n <= 5 * x.n and 9 * (x.n - x.at + 1) >= {room} and 9 * (y.n - y.at + 1) >= {room}")
    found = [a.join(b, met).select(F.col("x.fp").alias("src"), F.col("y.fp").alias("dst")) for a, b in ((x.where("not x.main"), y), (x.where("x.main"), y.where("not y.main")))]
    out = cut(found[0].unionByName(found[1]).distinct(), "rare-pairs")
    drop(each, first)
    return out


def _with_texts(seats: DataFrame, named: DataFrame, distinct: DataFrame) -> DataFrame:
    """``seats`` with ``text``, found by the key and hash of a row that has the set ``fp``.

    Hashes of unlike texts may be equal: who needs to be sure compares the name of the text's set.
    """
    places = seats.join(distinct.select("fp", F.col("place.key").alias("at"), F.col("place.h").alias("at_h")), "fp")
    if seats.count() <= BROADCAST_SEATS:
        places = F.broadcast(places)
    return named.join(places, F.col("key").eqNullSafe(F.col("at")) & (F.col("h") == F.col("at_h"))).select(*seats.columns, "text")


def _verified(pairs: DataFrame, named: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs whose texts are alike. Texts move once, to the rows of comparisons they have a seat in."""
    rows = pairs.groupBy("src").agg(F.ceil(F.count("*") / ROW).alias("rows"))
    placed = pairs.join(rows, "src").select("src", F.expr("pmod(xxhash64(dst), rows)").alias("part"), "dst")
    leaders = rows.select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("part"), F.lit(None).cast("long").alias("dst"))
    seats = cut(placed.unionByName(leaders).withColumn("fp", F.coalesce("dst", "src")), "seats")
    held = _with_texts(seats, named, distinct).select("src", "part", "dst", "text")
    # comparisons are costly for their bytes: left to adaptive execution, one task would do them all
    tasks = min(seats.count() // SEATS + 1, MOST_TASKS)
    ordered = held.repartition(tasks, "src", "part").sortWithinPartitions("src", "part", F.col("dst").asc_nulls_first())
    found = cut(ordered.mapInArrow(_compare, "src long, dst long").distinct(), "alike-pairs")
    drop(seats)
    return found


def _links(distinct: DataFrame, named: DataFrame, full: int) -> DataFrame:
    """Verified pairs that connect the sets as all alike pairs with a common band or a near fingerprint do."""

    def more(links: DataFrame, pairs: DataFrame) -> DataFrame:
        rest = cut(pairs, "pairs")
        alike = _verified(rest, named, distinct)
        out = cut(links.unionByName(alike), "links")
        drop(links, rest, alike)
        return out

    marked = cut(_near_marks(distinct).distinct(), "pairs")
    links = _verified(marked, named, distinct)
    drop(marked)
    for width in (3, 2):
        apart = cut(_apart(_in_common(distinct, width), components(links)), "apart")
        links = more(links, _first(apart))
        drop(apart)
    apart = cut(_apart(_in_common(distinct, 1), components(links)), "apart")
    pairs = _paired(apart.where(f"n <= {full}"))
    crowded = cut(apart.where(f"n > {full}").select("fp", "c").distinct(), "crowded-sets")
    if not crowded.isEmpty():
        pairs = pairs.unionByName(_by_rarest(crowded, named, distinct))
    links = more(links, pairs.distinct())
    drop(apart, crowded)
    return links


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", full: int = 16) -> DataFrame:
    """Per row: ``key`` and ``component_id``, the smallest key that links of 0.8 or more reach.

    Texts without words link with each other only. Rows with a null key take part and have their
    group's id, which is null where no row of the group has a key.
    """
    prepare(docs.sparkSession)
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    sketch = _of_sets(lambda s: np.concatenate((majority(s)[None], band_keys(s))))(F.col("text"))
    sketched = named.withColumn("sketch", sketch).select("key", "h", F.get("sketch", F.lit(0)).alias("fp"), F.get("sketch", F.lit(1)).alias("mark"), F.slice("sketch", 3, BANDS).alias("bands"))
    rows = cut(sketched, "sketches")
    distinct = cut(rows.groupBy("fp").agg(F.min("key").alias("least"), F.min(F.struct(F.isnull("key").alias("without"), "key", "h")).alias("place"), F.any_value("mark").alias("mark"), F.any_value("bands").alias("bands")), "distinct-sets")
    linked = components(_links(distinct, named, full))
    member = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = member.join(least, "root").select("fp", "component_id")
    return rows.select("key", "fp").join(ids, "fp").select(F.col("key").alias(key), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", full: int = 16) -> DataFrame:
    """The rows of ``docs``, all columns, less those whose group has a smaller key.

    Rows with a null key stay only if nothing in their group has a key.
    """
    found = groups(docs, key, text, full)
    stay = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__kept")).distinct()
    return aside(docs, key).join(stay, F.col(f"`{key}`").eqNullSafe(F.col("__kept")), "left_semi").toDF(*docs.columns)
