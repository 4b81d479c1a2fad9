"""Sampled segmentations without replacement over a piece lattice, and their decoding.

A text is a lattice of vocabulary pieces, each with a probability: a piece's rank in the vocabulary
gives it by Zipf's law, characters without a piece are spelt in bytes. The lattice falls apart at
word starts, since no piece runs across one, so its forward sums are computed per distinct word and
a segmentation is drawn word by word, from each word's end to its start.

The k samples of a text are the k best under Gumbel noise on the log-probabilities of whole
segmentations. They are searched best first, top down: the best below a node passes on to the child
that is drawn by its mass, and what stays behind at every decision, all other children together, goes
on the agenda with its own maximum, a Gumbel variable truncated at the node's. The k-th sample leaves
its parent's path at the agenda's best decision and is drawn on from there. The next maximum on the
agenda is the threshold of the inclusion scores: log(1 - exp(-exp(log p - threshold))).

All random numbers are hashes of the row key, the sample, the word's place and the step.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import mix, prepare, release, slices, utf8

#: A file that the driver has; ``with_samples`` sends it to the workers.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = 0x2581
_CLASSES = 160
#: Characters of texts taken together: bounds the lattice of a batch, but for one longer text.
GROUP = 3 << 17
#: Decisions of a path looked at in the first block, which is mostly enough, and in those after it.
_FIRST, _BLOCK = 128, 512
_WORD = 2**64 - 1
_STRIDES = np.arange(_BLOCK, dtype=np.uint64) * np.uint64(0x10001)
#: Characters from which a unit is cut where no piece runs across, and from which it is swept alone.
LONG, ALONE = 64, 2048


class Vocabulary:
    """Pieces as a trie in arrays, and their log-probabilities."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        texts = {model.id_to_piece(i): i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        if max(map(len, texts)) > 16:
            raise ValueError("a piece is longer than 16 characters")
        if any("▁" in p.lstrip("▁") or "\n" in p for p in texts):
            raise ValueError("a piece runs across a word start")
        self.first_byte = next(i for i in range(self.size) if model.is_byte(i))
        rank = np.arange(1, self.size + 1, dtype=np.float64)
        logp = -np.log(rank) - math.log((1 / rank).sum())
        # after the pieces, every character spelt in bytes, as rare as the rarest; index -1 is no piece
        self.logp = np.concatenate((logp, np.full(0x110000, logp[-1]), [-np.inf])).astype(np.float32)
        self.logp[self.first_byte : self.first_byte + 256] = logp[-1]
        counts: dict[str, int] = {}
        for p in texts:
            for c in p[1:]:
                counts[c] = counts.get(c, 0) + 1
        common = sorted(counts, key=lambda c: (-counts[c], c))[: _CLASSES - 1]
        self.klass = np.zeros(0x110000, np.uint8)
        for n, c in enumerate(common, 1):
            self.klass[ord(c)] = n
        nodes: list[dict[str, int]] = [{}]
        piece = [-1]
        for p, i in texts.items():
            at = 0
            for c in p:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                    piece.append(-1)
                at = nodes[at][c]
            piece[at] = i
        # nodes with others below come first: all the rest share one row of the table, the last; workers live long, so it is kept small
        leaf = np.array([not below for below in nodes])
        order = np.argsort(leaf, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        kind = np.uint16 if len(nodes) < 1 << 16 else np.uint32
        self.inner = int((~leaf).sum())
        self.piece = np.array(piece, np.int32)[order]
        self.root = np.zeros(0x110000, kind)
        for c, n in nodes[0].items():
            self.root[ord(c)] = number[n]
        self.next = np.zeros((self.inner + 1, _CLASSES), kind)
        rare = []
        for at, below in enumerate(nodes):
            for c, n in below.items():
                if k := self.klass[ord(c)]:
                    self.next[number[at], k] = number[n]
                elif at:
                    rare.append((int(number[at]) << 21 | ord(c), number[n]))
        rare.sort()
        self.rare = np.array([r[0] for r in rare] or [-1], np.int64)
        self.rare_to = np.array([r[1] for r in rare] or [0], kind)
        self.size_of = np.ones(len(self.logp), np.int8)
        for p, i in texts.items():
            self.size_of[i] = len(p)
        self.bytes_of = [b""] * self.size
        for p, i in texts.items():
            self.bytes_of[i] = p.replace("▁", " ").encode("utf-8")
        for b in range(256):
            self.bytes_of[self.first_byte + b] = bytes([b])
        self.bytes_size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.bytes_at = np.cumsum(self.bytes_size) - self.bytes_size
        self.bytes_all = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def step(self, state: np.ndarray, point: np.ndarray) -> np.ndarray:
        k = self.klass[point]
        out = self.next[np.minimum(state, self.inner), k]
        odd = np.flatnonzero(k == 0)
        if len(odd):
            key = state[odd].astype(np.int64) << 21 | point[odd]
            at = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
            out[odd] = np.where(self.rare[at] == key, self.rare_to[at], 0)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: one leading space, put there by encoding, goes."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace")[1:]


def _local(path: str) -> str:
    """Where this process has the vocabulary file: at its own path, or where Spark has put it."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    built = Vocabulary(path)
    release()
    return built


class _Lattice:
    """Forward sums of all distinct units; a unit is a word with the spaces before it, or a line end.

    Units are ordered from the longest on and nodes by their place in the unit, so that all nodes of a place are one slice:
    that of unit ``u`` after ``p`` characters is ``at[p] + u``.
    """

    def __init__(self, v: Vocabulary, points: np.ndarray, start: np.ndarray, length: np.ndarray):
        order = np.argsort(-length, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        start, length = start[order], length[order]
        n, units, width = int(length.sum()), len(length), 16
        # a unit has one node more than characters
        many = np.searchsorted(-length, -np.arange(int(length[0]) + 1), "right")
        self.at = np.cumsum(many) - many
        self.length = length
        place = np.repeat(np.arange(len(many) - 1), many[1:])  # of every character in its unit
        unit = np.arange(units, units + n) - self.at[place + 1]
        cps = points[start[unit] + place].astype(np.int64)
        # bisection reads 16 sums a node; the longest piece of the vocabulary bounds them
        self.ids = np.full((width, n + units), -1, np.int32)
        state = v.root[cps]
        bare = state == 0
        bare |= v.piece[state] < 0
        # one byte piece for ASCII, else a stand-in that is spelt in the end
        self.ids[0, units:][bare] = np.where(cps[bare] < 0x80, v.first_byte, v.size) + cps[bare]
        for size in range(1, width + 1):
            if size > 1:
                go = length[unit] - place >= size
                place, unit, state = place[go], unit[go], state[go]
                node = self.at[place + size] + unit
                state = v.step(state, cps[node - units])
            else:
                node = np.arange(units, units + n)
            some = state > 0
            place, unit, state, node = place[some], unit[some], state[some], node[some]
            if not len(node):
                break
            piece = v.piece[state]
            full = piece >= 0
            self.ids[size - 1, node[full]] = piece[full]
        del place, unit, state, node, cps
        self.logp, self.size_of = v.logp, v.size_of
        self.alpha = np.zeros(n + units)
        self.cdf = np.zeros((n + units, width), np.float32)
        # a unit that is far longer than others would keep a vector of one busy: it is swept by itself
        alone = int(np.searchsorted(-length, -ALONE, "right"))
        for one in range(alone):
            self._sweep(one, int(length[one]))
        for p in range(1, int(length[alone]) + 1 if units > alone else 1):
            more, w = int(many[p]), min(p, width)
            here = slice(self.at[p] + alone, self.at[p] + more)
            term = self.logp[self.ids[:w, here]].astype(np.float64)
            for j in range(w):
                before = self.at[p - 1 - j]
                term[j] += self.alpha[before + alone : before + more]
            top = term.max(0)
            term -= top
            mass = np.exp(term.astype(np.float32))
            for j in range(1, w):
                mass[j] += mass[j - 1]
            self.alpha[here] = top + np.log(mass[-1])
            mass /= mass[-1].copy()
            self.cdf[here, :w] = mass.T
            self.cdf[here, w:] = 1

    def _sweep(self, unit: int, length: int) -> None:
        """Forward sums of one unit, in blocks of plain numbers."""
        width, exp = len(self.ids), math.exp
        alpha = [-math.inf] * (width - 1) + [0.0]  # of the last nodes
        for lo in range(1, length + 1, 1 << 14):
            here = self.at[lo : min(length + 1, lo + (1 << 14))] + unit
            ids = self.ids[:, here].T
            logs = np.where(ids >= 0, self.logp[ids], -np.inf).tolist()
            rows, sums = [], []
            for row in logs:
                term = [x + alpha[-1 - j] for j, x in enumerate(row)]
                top, total, cdf = max(term), 0.0, []
                for x in term:
                    if x > top - 80:
                        total += exp(x - top)
                    cdf.append(total)
                rows.append([x / total for x in cdf])
                sums.append(top + math.log(total))
                alpha = [*alpha[1:], sums[-1]]
            self.alpha[here] = sums
            self.cdf[here] = rows

    def _back(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The length of the piece that ``u`` picks at every node, by bisection of the node's sums."""
        row = at * self.cdf.shape[1]
        flat, back = self.cdf.ravel(), np.zeros(len(at), np.int64)
        for half in (8, 4, 2, 1):
            back += half * (flat[row + back + (half - 1)] < u)
        return back + 1

    def draw_on(self, unit: int, place: int, seed: int) -> tuple[list[int], list[float]]:
        """Pieces and log-probabilities of one unit from the node after ``place`` characters on."""
        piece, chance = [], []
        for step in range(place):
            at = self.at[place] + unit
            back = int(np.searchsorted(self.cdf[at], _one_uniform((seed + step) & _WORD))) + 1
            place -= back
            piece.append(int(self.ids[back - 1, at]))
            chance.append(float(self.logp[piece[-1]] + self.alpha[self.at[place] + unit] - self.alpha[at]))
            if not place:
                break
        return piece, chance

    def draw(self, unit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Draws a segmentation of every unit from its end: the units' numbers of decisions, then piece
        and log-probability of every decision."""
        place = self.length[unit]
        live = np.flatnonzero(place)
        which, place, own = unit[live], place[live], seed[live]
        at = self.at[place] + which
        steps = []
        count = np.zeros(len(unit), np.int64)
        step = 0
        while len(live):
            back = self._back(at, _uniform(own + np.uint64(step)))
            place = place - back
            to = self.at[place] + which
            piece = self.ids[back - 1, at]
            steps.append((live, piece, self.logp[piece] + self.alpha[to] - self.alpha[at]))
            count[live] += 1
            go = np.flatnonzero(place)
            live, at, which, place, own = live[go], to[go], which[go], place[go], own[go]
            step += 1
        offset = np.concatenate(([0], np.cumsum(count)))
        piece, chance = np.empty(offset[-1], np.int32), np.empty(offset[-1])
        for step, (who, p, c) in enumerate(steps):
            to = offset[who] + step
            piece[to], chance[to] = p, c
        return count, piece, chance


def _uniform(seed: np.ndarray) -> np.ndarray:
    """Uniform numbers strictly between 0 and 1 from hashed seeds."""
    h = mix(seed * np.uint64(0x9E3779B97F4A7C15))
    h >>= np.uint64(11)
    u = h.astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def _one_uniform(seed: int) -> float:
    """The same of a single seed."""
    h = (seed * 0x9E3779B97F4A7C15) & _WORD
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & _WORD
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & _WORD
    return (((h ^ (h >> 31)) >> 11) + 0.5) * 2.0**-53


def _one_gumbel(place: float, u: float) -> float:
    return place - math.log(-math.log(u))


def _rest(chance: np.ndarray) -> np.ndarray:
    """The log-probability of everything but what was drawn."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(np.minimum(chance, 0.0)))


def _gumbel(place: np.ndarray, u: np.ndarray) -> np.ndarray:
    return place - np.log(-np.log(u))


def _below(value: float, limit: float) -> float:
    """A Gumbel variable made one that does not exceed ``limit``. Keeps order."""
    return min(value, limit) - math.log1p(math.exp(-abs(value - limit)))


class _Path:
    """One sample of a text: decisions in order, a unit's decisions from its end."""

    def __init__(self, counts: np.ndarray, piece: np.ndarray, chance: np.ndarray):
        self.counts, self.piece, self.chance = counts, piece, chance
        self.end = np.cumsum(counts)
        self.before = np.concatenate(([0.0], np.cumsum(chance)))
        self.phi = float(self.before[-1])

    def ids(self) -> np.ndarray:
        """The pieces from left to right."""
        turn = np.repeat(2 * self.end - self.counts - 1, self.counts)
        turn -= np.arange(len(turn))
        return self.piece[turn]


def _blocks(lo: int, end: int) -> Iterator[tuple[int, int]]:
    size = _FIRST
    while lo < end:
        yield lo, min(end, lo + size)
        lo, size = lo + size, _BLOCK


def _search(k: int, seed: int, lattice: _Lattice, units: np.ndarray, fresh: list[_Path]) -> tuple[list[_Path], float]:
    """The k best paths and the threshold. ``fresh`` has an unconditional draw per sample."""
    chosen = [fresh[0]]
    root = _one_gumbel(0.0, _one_uniform(seed ^ 0xA5A5))
    agenda: list[tuple] = []

    def leave(path: _Path, number: int, since: int, gumbel: float) -> None:
        """Puts a path's decisions from ``since`` on the agenda: the best k + 1, no more can be taken.

        Decisions are looked at in blocks. No Gumbel variable of a 53-bit uniform lies 38 above its
        place, and places only fall: once that is under the k + 1 best, nothing further can matter.
        """
        best: list[tuple[float, int]] = []
        stream = seed + 0x1000003 * (number + 1)
        for lo, hi in _blocks(since, len(path.chance)):
            if len(best) > k and path.before[lo] + 38 < best[k][0]:
                break
            part = path.chance[lo:hi]
            free = _gumbel(path.before[lo : lo + len(part)] + _rest(part), _uniform(np.uint64((stream + lo * 0x10001) & _WORD) + _STRIDES[: len(part)]))
            top = np.argpartition(-free, k)[: k + 1] if len(free) > k + 1 else np.arange(len(free))
            best = sorted([*best, *zip(free[top].tolist(), (top + lo).tolist(), strict=True)], reverse=True)[: k + 1]
        for value, at in best:
            if value > -math.inf:
                heapq.heappush(agenda, (-_below(value, gumbel), number, at, frozenset((int(path.piece[at]),))))

    leave(chosen[0], 0, 0, root)
    while len(chosen) < k and agenda:
        negative, parent, at, barred = heapq.heappop(agenda)
        path, number = chosen[parent], len(chosen)
        unit = int(np.searchsorted(path.end, at, "right"))
        begin, which = int(path.end[unit] - path.counts[unit]), units[unit]
        # the node: the unit's end less the characters of the pieces taken before
        place = int(lattice.length[which] - lattice.size_of[path.piece[begin:at]].sum())
        node = int(lattice.at[place] + which)
        # a sibling of the barred pieces, by its mass
        ids, total = lattice.ids[:, node].tolist(), float(lattice.alpha[node])
        open_ = [j for j, piece in enumerate(ids) if piece >= 0 and piece not in barred]
        chance = [float(lattice.logp[ids[j]]) + float(lattice.alpha[lattice.at[place - j - 1] + which]) - total for j in open_]
        most = max(chance)
        mass = list(itertools.accumulate(math.exp(c - most) for c in chance))
        draw = _one_uniform((seed + 0x51ED2701 * (number + 1)) & _WORD) * mass[-1]
        pick = min(bisect.bisect_left(mass, draw), len(open_) - 1)
        j = open_[pick]
        taken = ids[j]
        piece, more = lattice.draw_on(int(which), place - j - 1, (seed + 0x2545F491 * (number + 1)) & _WORD)
        tail = fresh[number]
        rest = int(tail.end[unit])
        counts = np.concatenate((path.counts[:unit], [at - begin + 1 + len(piece)], tail.counts[unit + 1 :]))
        new = _Path(
            counts,
            np.concatenate((path.piece[:at], np.array([taken, *piece], np.int32), tail.piece[rest:])),
            np.concatenate((path.chance[:at], [chance[pick], *more], tail.chance[rest:])),
        )
        chosen.append(new)
        # what is still left at this decision, and everything after it on the new path
        left = chance[:pick] + chance[pick + 1 :]
        if left:
            most = max(left)
            place = float(path.before[at]) + most + math.log(sum(math.exp(c - most) for c in left))
            g = _below(_one_gumbel(place, _one_uniform((seed + 0x3C6EF372 * (number + 1)) & _WORD)), -negative)
            heapq.heappush(agenda, (-g, parent, at, barred | {taken}))
        leave(new, number, at + 1, -negative)
    return chosen, -agenda[0][0] if agenda else -math.inf


def _spelt(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Characters without a piece as byte pieces."""
    odd = np.flatnonzero(ids >= v.size)
    if not len(odd):
        return ids
    size = np.ones(len(ids), np.int64)
    spelt = [chr(int(i) - v.size).encode("utf-8") for i in ids[odd]]
    size[odd] = [len(b) for b in spelt]
    out = np.repeat(ids, size)
    out[np.repeat(ids >= v.size, size)] = np.frombuffer(b"".join(spelt), np.uint8).astype(np.int32) + v.first_byte
    return out


def _seams(v: Vocabulary, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Where in the given units no piece runs across: every segmentation parts there."""
    seam = np.zeros(len(text), bool)
    step = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    for lo in range(0, int(step[-1]), 1 << 20):
        flat = np.arange(lo, min(int(step[-1]), lo + (1 << 20)))
        unit = np.searchsorted(step, flat, "right") - 1
        at = flat - step[unit] + start[unit]
        # starts a little before the stretch have pieces that reach into it
        first = max(0, lo - 16)
        before = np.arange(first, lo)
        whole = np.concatenate((before, flat))
        owner = np.searchsorted(step, whole, "right") - 1
        place = whole - step[owner] + start[owner]
        left = step[owner + 1] - whole
        over = np.zeros(len(whole) + 18, np.int32)
        index, state = np.arange(len(whole)), v.root[text[place]]
        for size in range(2, 17):
            some = state > 0
            index, state = index[some], state[some]
            go = left[index] >= size
            index, state = index[go], state[go]
            if not len(index):
                break
            state = v.step(state, text[place[index] + size - 1].astype(np.int64))
            full = index[(state > 0) & (v.piece[state] >= 0)]
            np.add.at(over, full + 1, 1)
            np.add.at(over, full + size, -1)
        inside = np.cumsum(over)[len(before) : len(whole)]
        seam[at[(inside == 0) & (flat > step[unit])]] = True
    return seam


def sample_texts(v: Vocabulary, column: pa.Array, seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """Per text its samples, best first: ids, log-probability, log inclusion score."""
    data, offsets = utf8(column)
    raw = data.tobytes()
    out: list[list] = []
    size = np.diff(offsets)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(np.cumsum(size[a:]), GROUP, "right")) + a)
        out += _sample_group(v, raw[offsets[a] : offsets[b]], (offsets[a : b + 1] - offsets[a]), seeds[a:b], k)
        release()
        a = b
    return out


def _sample_group(v: Vocabulary, raw: bytes, offsets: np.ndarray, seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    bytes_ = np.frombuffer(raw, np.uint8)
    count = np.concatenate(([0], np.cumsum((bytes_ & 0xC0) != 0x80)))[offsets]
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(offsets) - 1
    # a space before every text that is not empty
    full = np.diff(count) > 0
    add = np.concatenate(([0], np.cumsum(full)))
    text = np.empty(len(points) + int(full.sum()), np.uint32)
    head = (count[:-1] + add[:-1])[full]
    is_head = np.zeros(len(text), bool)
    is_head[head] = True
    text[is_head] = _SPACE
    text[~is_head] = np.where(points == 0x20, _SPACE, points)
    space = text == _SPACE
    cut = is_head.copy()
    cut[1:] |= (space[1:] & ~space[:-1]) | (text[1:] == 10) | (text[:-1] == 10)
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, len(text)))
    if len(start) and length.max() > LONG:
        cut |= _seams(v, text, start[length > LONG], length[length > LONG])
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(text)))
    if not len(start):
        return [[(np.zeros(0, np.int32), 0.0, 0.0)] for _ in range(n)]
    inner = np.arange(len(text)) - np.repeat(start, length)
    power = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64))
    name = mix(np.add.reduceat((text.astype(np.uint64) + np.uint64(1)) * power[inner], start) + length.astype(np.uint64))
    _, pick, inverse = np.unique(name, return_index=True, return_inverse=True)
    lattice = _Lattice(v, text, start[pick], length[pick])
    unit = lattice.rank[inverse]
    first = np.searchsorted(start, np.append(count[:-1] + add[:-1], len(text)))
    place = np.arange(len(unit)) - np.repeat(first[:-1], np.diff(first))
    row_seed = np.repeat(seeds, np.diff(first))
    drawn = []
    for number in range(k):  # a stream of its own for every sample
        seed = mix(row_seed + np.uint64(0x632BE59BD9B4E019 * (number + 1) % 2**64)) + place.astype(np.uint64) * np.uint64(1 << 20)
        counts, *rest = lattice.draw(unit, seed)
        drawn.append((counts, np.concatenate(([0], np.cumsum(counts))), rest))
    out = []
    for i in range(n):
        lo, hi = first[i], first[i + 1]
        if lo == hi:
            out.append([(np.zeros(0, np.int32), 0.0, 0.0)])
            continue
        fresh = [_Path(c[lo:hi], *[r[o[lo] : o[hi]] for r in rest]) for c, o, rest in drawn]
        chosen, threshold = _search(k, int(seeds[i]), lattice, unit[lo:hi], fresh)
        rows = []
        for path in chosen:
            x = path.phi - threshold
            inclusion = 0.0 if x > 40 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))
            rows.append((_spelt(v, path.ids()), path.phi, inclusion))
        out.append(rows)
    return out


_SAMPLES = "array<struct<ids:array<int>,log_prob:double,log_inclusion:double>>"


def with_samples(docs: DataFrame, out: str = "samples", k: int = 2, key: str = "doc_id", text: str = "text", seed: int = 0, model: str = MODEL) -> DataFrame:
    """Adds up to ``k`` distinct segmentations of every text, best perturbed score first.

    Null and empty texts have one segmentation without pieces and score 0; texts with fewer than k
    segmentations get them all, with inclusion scores of 0, the logarithm of 1. The same key, text and
    ``seed`` give the same samples; a null key counts as one key.
    """
    prepare(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(model)  # workers may have no such file of their own

    def of(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        found = sample_texts(vocabulary(_local(model)), texts, mix(seeds.to_numpy(zero_copy_only=False).view(np.uint64)), k)
        flat = [s for rows in found for s in rows]
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s[0]) for s in flat]))), pa.int32()), pa.array(np.concatenate([s[0] for s in flat]) if flat else np.zeros(0, np.int32), pa.int32()))
        rows = pa.StructArray.from_arrays([ids, pa.array([s[1] for s in flat], pa.float64()), pa.array([s[2] for s in flat], pa.float64())], ["ids", "log_prob", "log_inclusion"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in found]))), pa.int32()), rows)

    @F.arrow_udf(_SAMPLES)
    def samples(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        out = [of(texts.slice(a, b - a), seeds.slice(a, b - a)) for a, b in slices(texts, GROUP, 256)]
        return pa.concat_arrays(out) if out else of(texts, seeds)

    return docs.withColumn(out, samples(F.col(f"`{text}`").cast("string"), F.xxhash64(F.col(f"`{key}`"), F.lit(seed))))


def decoder(model: str = MODEL):
    """A function from a column of ids to text."""

    def of(ids: pa.Array) -> pa.Array:
        v = vocabulary(_local(model))
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.where(ids.is_valid(), ids.value_lengths().fill_null(0), 0))
        size = v.bytes_size[flat]
        at = np.concatenate(([0], np.cumsum(size)))
        raw = v.bytes_all[np.arange(at[-1]) + np.repeat(v.bytes_at[flat] - at[:-1], size)].tobytes()
        stops = at[ends].tolist()
        texts = [raw[a:b].decode("utf-8", "replace")[1:] for a, b in zip([0, *stops], stops, strict=False)]
        return pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        out = [of(ids.slice(a, 512)) for a in range(0, len(ids), 512)]
        return pa.concat_arrays(out) if out else of(ids)

    return decode


def spaced(text: Column) -> Column:
    """What decoding gives back for a text: the text itself, but that the space sign is a space."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("▁"), F.lit(" "))
