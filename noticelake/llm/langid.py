"""Language identification by interpolated Kneser-Ney models over characters.

The alphabet is learned: Spark counts the letters of the training texts, and every one gets a number, any run of
non-letters is one more symbol. Numbers have 16 bits, so that an n-gram of four symbols is one 64-bit word; of more
than 65,000 different letters the rarest share a number. Spark then counts the n-grams of every language over all
training texts but a sixteenth, told by a hash of the text. From the counts every language gets an interpolated
Kneser-Ney model, kept as sorted arrays of n-grams with their log-probabilities, and of contexts
with their back-off weights, an array per order. A model knows its own language's letters only: any other costs it
what a letter never seen does.

A text gets the language of lowest cross-entropy per symbol. The sixteenth that no model has counted
calibrates rejection: it gives every model the mean and deviation of its own language's texts, and
what texts of the other languages cost it. A text goes if it has no letter, or if it costs more than
the mean, ``z`` deviations of a mean over as many symbols, and ``share`` of the way to what the other
languages cost. At the default a text that is half in another learned language stays.

Models keep every n-gram of their language. They are sent to every task and grow with the different n-grams of a
language, which alphabets of a few hundred letters bound, not with its texts. ``MOST_GRAMS``, unset, cuts them to the most
frequent over all languages together. ``max_langs`` languages are accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import in_slices, prepare, release, slices, utf8
from noticelake.storage import cut, drop

ORDER = 4
#: Bits of a symbol. Symbol 0 is the break between words, the last any letter that training has not seen.
BITS = 16
OTHER = (1 << BITS) - 1
#: N-grams of all models together, some 20 bytes each with those of lower orders, if they are to be cut; None keeps all.
MOST_GRAMS: int | None = None
UNKNOWN = "und"
#: Letters scored, and counts held, at a time: bounds the arrays of a batch however long a text is.
PIECE = 1 << 18

_LOWER: list[np.ndarray] = []


def _lower() -> np.ndarray:
    """By code point, the lower-case letter; 0 for what is no letter."""
    if not _LOWER:
        _LOWER.append(np.fromiter((ord(chr(p).lower()[0]) if chr(p).isalpha() else 0 for p in range(0x110000)), np.int32, 0x110000))
    return _LOWER[0]


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters, 0 between them, and where the rows start."""
    data, offsets = utf8(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return _lower()[points], np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]


def symbol_table(alphabet: list[str]) -> np.ndarray:
    """By lower-case letter, its symbol."""
    table = np.full(0x110000, OTHER, np.uint16)
    table[0] = 0
    known = [ord(c) for c in alphabet[: OTHER - 1]]
    table[known] = np.arange(1, 1 + len(known))
    return table


def symbols(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols, the first of every text, and the number of letters of every text.

    Every text starts with ``ORDER - 1`` breaks and ends with one; runs of non-letters are one break.
    """
    points, count = _points(column)
    sym = table[points]
    letters = np.diff(np.concatenate(([0], np.cumsum(sym > 0)))[count])
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0)
    at = np.concatenate(([0], np.cumsum(keep)))[count]
    sym = sym[keep]
    n = len(column)
    out = np.zeros(len(sym) + n * ORDER, np.uint16)
    first = at + np.arange(n + 1) * ORDER
    out[np.arange(len(sym)) + np.repeat(np.arange(n) * ORDER + ORDER - 1, np.diff(at))] = sym
    return out, first, letters


def ngrams(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at every symbol after a text's opening breaks, and the text it is in."""
    code = np.zeros(max(0, len(sym) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        code = code << np.uint64(BITS) | sym[k : len(sym) - ORDER + 1 + k]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[: len(code)] == text[ORDER - 1 :]
    return code[inside], text[: len(code)][inside]


def _context(code: np.ndarray) -> np.ndarray:
    return code >> np.uint64(BITS)


def _shorter(code: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols of n-grams."""
    return code & np.uint64((1 << BITS * order) - 1)


def _counted(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """Sums of what ``of`` finds in the texts of every language: codes, each with the text it is in."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}

    def add() -> None:
        for lang, parts in waiting.items():
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in held:
                old, before = held[lang]
                both, inverse = np.unique(np.concatenate((old, code)), return_inverse=True)
                code, n = both, np.bincount(inverse, np.concatenate((before, n))).astype(np.int64)
            held[lang] = code, n
        waiting.clear()

    def emit() -> Iterator[pa.RecordBatch]:
        add()
        for lang, (code, n) in held.items():
            for a in range(0, len(code), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code[part]), pa.string()), pa.array(code[part].view(np.int64)), pa.array(n[part].astype(np.int64))], ["lang", "code", "n"])
        held.clear()

    size = 0
    for batch in batches:
        for a, b in slices(batch["text"], 1 << 19):
            langs = batch["lang"].slice(a, b - a).to_numpy(zero_copy_only=False)
            code, text = of(batch["text"].slice(a, b - a))
            bounds = np.searchsorted(text, np.arange(len(langs) + 1))
            for lang in sorted(set(langs)):
                waiting.setdefault(lang, []).extend(code[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(langs == lang))
            size += len(code)
            if size > 4 * PIECE:
                add()
                size = 0
                if sum(len(code) for code, _ in held.values()) > 8 * PIECE:  # bounds what a task holds
                    yield from emit()
        release()
    yield from emit()


@dataclass
class LanguageModel:
    """Per order 1 to ``ORDER``: sorted n-grams with log-probabilities, sorted contexts with back-off weights."""

    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)

    size: int = 2  # symbols that the alphabet has, with the break and the unseen letter

    def score(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """The log-probability of every n-gram's last symbol."""
        if order == 0:
            return np.full(len(code), -np.log(self.size))
        grams = self.grams[order - 1]
        where = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
        out = self.logp[order - 1][where].astype(np.float64)
        missing = np.flatnonzero(grams[where] != code)
        if len(missing):
            rest = code[missing]
            keys = self.contexts[order - 1]
            at = np.minimum(np.searchsorted(keys, _context(rest)), len(keys) - 1)
            weight = np.where(keys[at] == _context(rest), self.backoff[order - 1][at], 0.0)
            out[missing] = weight + self.score(_shorter(rest, order - 1), order - 1)
        return out


def kneser_ney(gram: np.ndarray, n: np.ndarray, size: int) -> LanguageModel:
    """The interpolated Kneser-Ney model of one language from its distinct n-grams of full order, over ``size`` symbols."""
    order = np.argsort(gram)
    g, c = gram[order].astype(np.uint64), n[order].astype(np.float64)
    levels = []
    for level in range(ORDER, 0, -1):
        levels.append((g, c))
        # below the highest order a gram counts once for every symbol it is seen after
        g, c = np.unique(_shorter(g, level - 1), return_counts=True)
        c = c.astype(np.float64)
    model = LanguageModel(size=size)
    for level, (g, c) in enumerate(reversed(levels), 1):
        once, twice = np.sum(c == 1), np.sum(c == 2)
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context, where = np.unique(_context(g), return_inverse=True)
        total, kinds = np.bincount(where, c), np.bincount(where)
        left = discount * kinds / total
        p = (c - discount) / total[where] + left[where] * np.exp(model.score(_shorter(g, level - 1), level - 1))
        model.grams.append(g)
        model.logp.append(np.log(p).astype(np.float32))
        model.contexts.append(context)
        model.backoff.append(np.log(left).astype(np.float32))
    return model


@dataclass
class Model:
    """The languages' models and what calibration found: the limit is ``base + spread / sqrt(symbols)``."""

    table: np.ndarray
    langs: list[str]
    models: list[LanguageModel]
    base: np.ndarray
    spread: np.ndarray

    def totals(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood per text and language, symbols and letters per text."""
        sym, first, letters = symbols(column, self.table)
        code, text = ngrams(sym, first)
        total, n = np.zeros((len(column), len(self.langs))), np.bincount(text, minlength=len(column))
        for a in range(0, len(code), PIECE):
            # every distinct n-gram is looked up once per language
            distinct, inverse = np.unique(code[a : a + PIECE], return_inverse=True)
            of = text[a : a + PIECE]
            for i, model in enumerate(self.models):
                total[:, i] += np.bincount(of, model.score(distinct)[inverse], minlength=len(column))
        return total, n, letters


def _calibration(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), text), F.lit(16)) == 0


def _alphabet(rows: DataFrame) -> list[str]:
    """All letters, the one with the largest share in any language first; so many at most as there are in Unicode come to the driver."""
    def letters(batches):
        def of(column):
            points, count = _points(column)
            text = np.repeat(np.arange(len(column)), np.diff(count))
            return points[points > 0].astype(np.uint64), text[points > 0]

        return _counted(batches, of)

    counts = rows.mapInArrow(letters, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    best = counts.join(totals, "lang").groupBy("code").agg(F.max(F.col("n") / F.col("total")).alias("share"))
    return [chr(r["code"]) for r in best.orderBy(F.desc("share"), "code").limit(OTHER - 1).collect()]


def _frequent(counts: DataFrame, langs: list[str]) -> dict[str, int]:
    """By language, the least count with which an n-gram is kept: 1 unless ``MOST_GRAMS`` is set and there are more than its share."""
    if MOST_GRAMS is None:
        return dict.fromkeys(langs, 1)
    most = MOST_GRAMS // len(langs)
    rows = counts.groupBy("lang", F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("grams")).orderBy("lang", F.desc("n")).collect()
    least, held = dict.fromkeys(langs, 1 << 17), dict.fromkeys(langs, 0)
    for r in rows:
        held[r["lang"]] += r["grams"]
        if held[r["lang"]] <= most:
            least[r["lang"]] = r["n"]
    return least


def train(docs: DataFrame, text: str = "text", lang: str = "lang", z: float = 8.0, share: float = 0.5, max_langs: int = 64) -> Model | None:
    """The models of all languages of ``docs``; rows with null text or language teach nothing.

    What comes to the driver is the letters, and one language's counts of different n-grams at a time. None if
    no row teaches anything. A language without text to calibrate on rejects nothing but texts
    without a letter. More than ``max_langs`` languages are an error: models are sent to every task.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang is not null and text is not null")
    alphabet = _alphabet(rows)
    table = symbol_table(alphabet)

    def count(batches):
        return _counted(batches, lambda column: ngrams(*symbols(column, table)[:2]))

    taught = rows.where(~_calibration(F.col("text")))
    counts = cut(taught.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "ngrams")
    langs = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").limit(max_langs + 1).collect()]
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not langs:
        return None
    models, least = [], _frequent(counts, langs)
    for name in langs:
        mine = counts.where((F.col("lang") == name) & (F.col("n") >= least[name])).select("code", "n").toArrow()
        models.append(kneser_ney(mine["code"].to_numpy().view(np.uint64), mine["n"].to_numpy(), len(alphabet) + 2))
    drop(counts)
    k = len(langs)
    model = Model(table, langs, models, np.full(k, np.inf), np.zeros(k))
    own, other, deviation = _losses(rows.where(_calibration(F.col("text"))), model)
    for i in range(k):
        if np.isfinite(own[i]):
            foreign = np.delete(other[:, i], i)
            foreign = foreign[np.isfinite(foreign)]
            far = float(foreign.mean()) if len(foreign) else np.log(len(alphabet) + 2)
            model.base[i] = own[i] + share * max(0.0, far - own[i])
            model.spread[i] = z * deviation[i]
    return model


def _losses(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean loss a symbol of every model on its own language; on each (row: language of the text); own deviation."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for batch in batches:
            for a, b in slices(batch["text"], 1 << 19):
                total, n, _ = m.totals(batch["text"].slice(a, b - a))
                keep = n > 0
                lang = batch["lang"].slice(a, b - a).to_numpy(zero_copy_only=False)[keep]
                for i, name in enumerate(m.langs):
                    loss, size = -total[keep, i], n[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(lang.tolist(), pa.string()), pa.array([name] * len(lang), pa.string()), pa.array(size), pa.array(loss), pa.array(loss**2 / size)], ["lang", "model", "n", "loss", "square"])
                release()

    sums = rows.mapInArrow(score, "lang string, model string, n long, loss double, square double").groupBy("lang", "model").agg(F.count("*").alias("texts"), *[F.sum(c).alias(c) for c in ("n", "loss", "square")])
    k, index = len(model.langs), {name: i for i, name in enumerate(model.langs)}
    mean, deviation = np.full((k, k), np.nan), np.zeros(k)
    for r in sums.where(F.col("lang").isin(model.langs)).collect():
        i, j = index[r["lang"]], index[r["model"]]
        mean[i, j] = r["loss"] / r["n"]
        if i == j:  # of the mean of one text of n symbols, times the root of n
            deviation[i] = np.sqrt(max(r["square"] - r["loss"] ** 2 / r["n"], 0.0) / r["texts"])
    return mean.diagonal().copy(), mean, deviation


_RESULT = "struct<lang:string,score:double,cross_entropy:double,rejected:boolean>"


def predictor(docs: DataFrame, model: Model | None, temperature: float = 4.0):
    """A function from a text column to struct ``lang``, ``score``, ``cross_entropy``, ``rejected``.

    ``lang`` is the language of lowest cross-entropy, ``und`` for null texts and texts without a
    letter, or without a model. ``score`` is its posterior under equal priors, log-likelihoods divided
    by ``temperature``, against the other languages and against none, whose cost is the limit: rejected
    texts score under a half, undecided ones 0. Ties go to the first language in order.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: pa.Array) -> pa.Array:
        m = shared.value
        rows = len(texts)
        if m is None:
            total, n, letters = np.zeros((rows, 1)), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        else:
            total, n, letters = m.totals(texts)
        best = total.argmax(1)
        size = np.maximum(n, 1)
        entropy = -total[np.arange(rows), best] / size
        limit = m.base[best] + m.spread[best] / np.sqrt(size) if m else np.zeros(rows)
        top = total.max(1, keepdims=True)
        none = np.exp(np.minimum((entropy - limit) * size / temperature, 700.0))
        score = 1 / (np.exp((total - top) / temperature).sum(1) + none)
        known = (letters > 0) & (m is not None)
        names = np.where(known, np.array(m.langs)[best] if m else UNKNOWN, UNKNOWN)
        columns = [pa.array(names.tolist(), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(entropy, mask=~known), pa.array(~known | (entropy > limit))]
        return pa.StructArray.from_arrays(columns, ["lang", "score", "cross_entropy", "rejected"])

    @F.arrow_udf(_RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        return in_slices(texts, of, 1 << 19)

    return predict


def held_out(key: Column) -> Column:
    """True for the quarter of keys that no model learns from."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, out: str = "language", key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Trains on the rows that are not held out and adds the prediction for every row.

    A null key counts as not held out. A column named ``out`` is replaced.
    """
    taught = docs.where(~F.coalesce(held_out(F.col(f"`{key}`")), F.lit(False)))
    predict = predictor(docs, train(taught, text, lang))
    return docs.withColumn(out, predict(F.col(f"`{text}`").cast("string")))
