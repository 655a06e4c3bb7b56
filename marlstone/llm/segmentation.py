"""SentencePiece encoding with distinct sampled segmentations, and decoding.

The lattice of a text has a node before every character and an edge for every piece of a public
vocabulary that fits there; a character that no piece covers has one edge, its UTF-8 bytes. Edges weigh
`smoothing` times the log of a Zipf probability of the piece's rank, and the segmentations of a text
are drawn without replacement in the order of their perturbed log-probabilities.

No piece spans the start of a run of spaces, so all paths pass there and a text is a chain of units
(a run of spaces and the word after it). The forward sums of a unit are computed once for each
distinct unit. The search is A*: a node of the tree stands for all segmentations that begin in one way,
and carries the exact maximum of their Gumbel-perturbed log-probabilities, which is its bound. Expanding
the best node splits it, unit by unit, into the one alternative that holds the maximum and all others,
whose maximum is a Gumbel of their mass, truncated at the parent's. Each time the search reaches the end
it has the next best segmentation, so the k results are distinct, and the bound that is then
best is the threshold from which inclusion scores follow. Randomness depends on the seed and the row's
key alone, so rows give the same result wherever they run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, repeat
from math import exp, inf, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.memory import given_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SMOOTHING = 0.5
SEED = 11
#: Alternatives that begin with a stretch of e to minus this have a mass that no double tells from none.
NOTHING = 80.0
SPACE, LITERAL = "▁", "\udfff"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
LONGEST_DENSE = 24
#: Beyond so many bytes or units the tables are trimmed to half of that, to the units met most.
TABLE_BYTES, MOST_TYPES = 180_000_000, 400_000
#: Characters that are searched at once.
BATCH = 1_000_000
#: Units that are drawn at once; what a step works on then stays in the processor's cache.
DRAWN = 16_384
SCHEMA = "doc_id long, sample int, pieces array<int>, log_prob double, log_inclusion double"


def _roll(h: np.ndarray, char: np.ndarray) -> np.ndarray:
    """Hashes of strings with one more character."""
    h = (h ^ char) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Vocabulary:
    """Pieces, their ids and log-probabilities, from the bytes of a model file."""

    def __init__(self, data: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(data)
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        rank = {i: r for r, i in enumerate(sorted(self.ids.values()))}
        total = log(sum(1 / (r + 2.7) for r in range(len(rank))))
        self.log_prob = {i: -log(r + 2.7) - total for i, r in rank.items()}
        self.least = min(self.log_prob.values()) - 10
        self.starts = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.ids))
        #: For each length the hashes of all beginnings of pieces, sorted, and the piece that is one, or -1;
        #: then by the leading bits of a hash the first of them, how many bits are left, and the most that share those.
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64, int]] = []
        by_size: list[list[str]] = [[] for _ in range(self.longest + 1)]
        for p in self.starts:
            by_size[len(p)].append(p)
        for n, these in enumerate(by_size[1:], 1):
            chars = np.frombuffer("".join(these).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, n)
            h = np.zeros(len(these), np.uint64)
            for k in range(n):
                h = _roll(h, chars[:, k])
            order = np.argsort(h)
            # as many entries without a piece follow as any lookup goes beyond the last
            bits = len(these).bit_length() + 2
            shift = np.uint64(64 - bits)
            held = np.bincount((h >> shift).astype(np.int64), minlength=1 << bits)
            most = int(held.max())
            hashes = np.concatenate((h[order], np.repeat(h[order][-1:], most)))
            pieces = np.array([self.ids.get(p, -1) for p in these], np.int32)[order]
            self.tables.append((hashes, np.concatenate((pieces, np.repeat(pieces[-1:], most))), np.cumsum(held) - held, shift, most))
        self.weight = np.zeros(len(self.pieces))
        for i, w in self.log_prob.items():
            self.weight[i] = w

    def look_up(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of hashes of strings of that length: which begin a piece, and the piece that is the string, or -1."""
        table, piece, first, shift, most = self.tables[size - 1]
        spot = first.take((h >> shift).view(np.int64))
        live = table.take(spot) == h
        rest = np.flatnonzero(~live)
        for k in range(1, most):
            there = table.take(spot.take(rest) + k)
            sought = h.take(rest)
            hit = rest[there == sought]
            live[hit] = True
            spot[hit] += k
            rest = rest[there < sought]
            if not len(rest):
                break
        return live, np.where(live, piece.take(spot), -1)

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte[b] for b in (SPACE if char == LITERAL else char).encode()]

    def decode(self, ids) -> str:
        """The text that any segmentation of it stands for."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.of_byte:
                raw.append(self.of_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)[1:]


def units(text: str) -> list[str]:
    """The chain of units of a text, which starts with one added space."""
    if not text:
        return []
    return UNIT.findall(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE))


def tails(text: str) -> list[str]:
    """The units of a text without the space that each begins with."""
    if not text:
        return []
    if text[0] == " " or "  " in text:
        return [u[1:] for u in units(text)]
    return text.replace(SPACE, LITERAL).split(" ")


class Lattice:
    """Forward sums of units, and sampling from them.

    Units up to LONGEST_DENSE characters are rows of dense tables by length and longest edge: cum[class][row, end - 1, l - 1] is the
    probability that the piece which ends there has at most l characters. Longer units are lists of edges.
    Edges that stand for a character's bytes have ids from `virtual` on.
    """

    def __init__(self, vocabulary: Vocabulary, smoothing: float) -> None:
        self.vocabulary, self.smoothing = vocabulary, smoothing
        self.virtual = len(vocabulary.pieces)
        self.chars: list[str] = []
        self.char_bytes: list[np.ndarray] = []
        self.char_id: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.type: dict[str, int] = {}
        self.length, self.row, self.kind = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.cum: dict[int, np.ndarray] = {}
        self.ids: dict[int, np.ndarray] = {}
        self.used: dict[int, int] = {}
        self.long: dict[int, list[list[tuple[int, int, float]]]] = {}
        self.bytes = 0
        #: How often each type was met.
        self.met = np.zeros(0, np.int64)

    def trim(self, most_bytes: int, most: int) -> None:
        """Forgets long units, those met once and then those met least, until the rest takes no more than that. A unit's sums don't depend on the others."""
        often = np.flatnonzero((self.length <= LONGEST_DENSE) & (self.met > 1))
        often = often[np.argsort(-self.met[often], kind="stable")][:most]
        takes = 12 * self.length[often].astype(np.int64) * (self.kind[often] % 32)
        keep = np.zeros(len(self.length), bool)
        keep[often[np.cumsum(takes) <= most_bytes]] = True
        self.long = {}
        number = np.cumsum(keep) - 1
        flags, numbers = keep.tolist(), number.tolist()
        self.type = {w: numbers[t] for w, t in self.type.items() if flags[t]}
        self.length, self.row, self.kind, self.met = self.length[keep], self.row[keep], self.kind[keep], self.met[keep]
        cum, ids, self.cum, self.ids, self.used, self.bytes = self.cum, self.ids, {}, {}, {}, 0
        for kind in np.unique(self.kind).tolist():
            which = np.flatnonzero(self.kind == kind)
            rows = self.row[which]
            self.cum[kind], self.ids[kind] = cum.pop(kind)[rows], ids.pop(kind)[rows]
            self.row[which] = np.arange(len(which))
            self.used[kind] = len(which)
            self.bytes += self.cum[kind].nbytes + self.ids[kind].nbytes

    def size_of(self, piece: int) -> int:
        return 1 if piece >= self.virtual else len(self.vocabulary.pieces[piece])

    def _edges(self, unit: str) -> Iterator[tuple[int, int, int, float]]:
        v, n = self.vocabulary, len(unit)
        starts, ids, log_prob, smooth = v.starts, v.ids, v.log_prob, self.smoothing
        for s in range(n):
            if unit[s] not in ids:
                yield s, s + 1, self._virtual(unit[s]), smooth * v.least * len(v.bytes_of(unit[s]))
            for e in range(s + 1, n + 1):
                sub = unit[s:e]
                if sub not in starts:
                    break
                i = ids.get(sub)
                if i is not None:
                    yield s, e, i, smooth * log_prob[i]

    def types(self, words: list[str]) -> np.ndarray:
        """Type numbers of units, given by their tails; new ones get their sums."""
        known, base = self.type, len(self.type)
        found = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            these = [words[k] for k in missing]
            new = list(dict.fromkeys(these))
            known.update(zip(new, range(base, base + len(new)), strict=True))
            self._add([SPACE + w for w in new], base)
            found[missing] = np.fromiter(map(known.__getitem__, these), np.int64, len(these))
        met = np.bincount(found, minlength=len(known))
        met[: len(self.met)] += self.met
        self.met = met
        return found

    def _room(self, table: dict[int, np.ndarray], n: int, used: int, more: np.ndarray) -> None:
        old = table.get(n)
        if old is None or used + len(more) > len(old):
            grown = np.empty((max(3 * (used + len(more)) // 2, 64), *more.shape[1:]), more.dtype)
            if old is not None:
                grown[:used] = old[:used]
                self.bytes -= old.nbytes
            table[n] = grown
            self.bytes += grown.nbytes
        table[n][used : used + len(more)] = more

    def _edges_of(self, units: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All edges of units of n characters: unit, end, length, piece and weight. Places stay in play while they begin some piece."""
        v = self.vocabulary
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        at = np.arange(len(chars))
        left = n - at % n
        h = np.zeros(len(chars), np.uint64)
        parts, bare = [], np.zeros(0, np.int64)
        for size in range(1, v.longest + 1):
            h = _roll(h, chars[at + size - 1])
            live, found = v.look_up(h, size)
            if size == 1:
                bare = at[found < 0]
            whole = np.flatnonzero(found >= 0)
            pieces = found.take(whole)
            parts.append((at.take(whole), np.full(len(whole), size), pieces, self.smoothing * v.weight.take(pieces)))
            on = np.flatnonzero(live & (left > size))
            at, left, h = at.take(on), left.take(on), h.take(on)
            if not len(at):
                break
        if len(bare):
            lone = [units[k // n][k % n] for k in bare.tolist()]
            parts.append((bare, np.ones(len(bare), int), np.array([self._virtual(c) for c in lone]), np.array([self.smoothing * v.least * len(v.bytes_of(c)) for c in lone])))
        start, size, piece, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        return start // n, start % n + size, size, piece, weight

    def _virtual(self, char: str) -> int:
        if char not in self.char_id:
            self.char_id[char] = self.virtual + len(self.chars)
            self.chars.append(char)
            self.char_bytes.append(np.array(self.vocabulary.bytes_of(char), np.int32))
        return self.char_id[char]

    def _add(self, new: list[str], base: int) -> None:
        lengths = np.fromiter(map(len, new), np.int32, len(new))
        rows, kinds = np.zeros(len(new), np.int64), np.full(len(new), LONGEST_DENSE * 32 + 32, np.int32)
        for n in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == n)
            if n > LONGEST_DENSE:
                for k in which:
                    self.long[base + int(k)] = self._sums(new[k])
                continue
            unit, end, size, piece, weight = self._edges_of([new[k] for k in which], n)
            reach = np.zeros(len(which), int)
            np.maximum.at(reach, unit, size)
            for low, high in ((0, 4), (4, 8), (8, 32)):
                chosen = (reach > low) & (reach <= high)
                part = np.flatnonzero(chosen)
                if not len(part):
                    continue
                w = min(n, self.vocabulary.longest, high)
                score, ids = np.full((n, w, len(part)), -inf), np.zeros((len(part), n, w), np.int32)
                of = np.flatnonzero(chosen.take(unit))
                own, step, found = (np.cumsum(chosen) - 1).take(unit.take(of)), (end.take(of) - 1) * w + size.take(of) - 1, piece.take(of)
                score.reshape(-1)[step * len(part) + own] = weight.take(of)
                ids.reshape(-1)[own * (n * w) + step] = found
                self._fill(n, w, score, ids, which[part], rows, kinds)
        self.length = np.concatenate((self.length, lengths))
        self.row = np.concatenate((self.row, rows))
        self.kind = np.concatenate((self.kind, kinds))

    def _fill(self, n: int, wide: int, score: np.ndarray, ids: np.ndarray, which: np.ndarray, rows: np.ndarray, kinds: np.ndarray) -> None:
        """Dense tables of units of n characters whose longest edge has at most `wide`: the class n * 32 + wide. score: by end, length and unit."""
        kind = n * 32 + wide
        alpha = np.full((n + 1, len(which)), -inf)
        alpha[0] = 0
        table = np.ones((n, wide, len(which)))
        for e in range(1, n + 1):
            m = min(e, wide)
            p = score[e - 1, :m] + alpha[e - m : e][::-1]
            top = p.max(0)
            p -= top
            np.exp(p, out=p)
            c = np.cumsum(p, 0, out=table[e - 1, :m])
            total = c[-1].copy()
            alpha[e] = top + np.log(total)
            c /= total
            behind = np.ones(len(which), bool)  # no edge comes after
            for k in range(m - 1, -1, -1):
                np.copyto(c[k], 1.0, where=behind)
                behind &= p[k] == 0
                if not behind.any():
                    break
        cum = np.ascontiguousarray(table.transpose(2, 0, 1))
        used = self.used.get(kind, 0)
        rows[which] = np.arange(len(which)) + used
        kinds[which] = kind
        self._room(self.cum, kind, used, cum)
        self._room(self.ids, kind, used, ids)
        self.used[kind] = used + len(which)

    def _sums(self, unit: str) -> list[list[tuple[int, int, float]]]:
        alpha, into = [0.0] + [-inf] * len(unit), [[] for _ in range(len(unit) + 1)]
        for s, e, i, w in self._edges(unit):
            into[e].append((e - s, i, w))
        out: list[list[tuple[int, int, float]]] = [[]]
        for e in range(1, len(unit) + 1):
            w = [alpha[e - size] + weight for size, _, weight in into[e]]
            top = max(w)
            alpha[e] = top + log(sum(exp(x - top) for x in w))
            out.append([(size, i, exp(x - alpha[e])) for (size, i, _), x in zip(into[e], w, strict=True)])
        return out

    def edges(self, t: int, end: int) -> list[tuple[int, int, float]]:
        """(characters, piece, probability) of the edges of a unit that end there."""
        if t in self.long:
            return self.long[t][end]
        n, r = int(self.kind[t]), self.row[t]
        out, below = [], 0.0
        for k, (c, i) in enumerate(zip(self.cum[n][r, end - 1].tolist(), self.ids[n][r, end - 1].tolist(), strict=True)):
            if c > below:
                out.append((k + 1, i, c - below))
                below = c
        return out

    def one(self, t: int, rng: np.random.Generator, without: list[tuple[int, ...]] = []) -> tuple[tuple[int, ...], float]:  # noqa: B006
        """A segmentation of a unit and its log-probability, other than those of `without`; pieces are listed from the end."""
        end, path, total = int(self.length[t]), [], 0.0
        barred = list(without)
        while end:
            found = self.edges(t, end)
            weights = [p for _, _, p in found]
            for x in barred:
                rest, at = 1.0, end
                for piece in x[len(path) :]:
                    rest *= next(p for _, i, p in self.edges(t, at) if i == piece)
                    at -= self.size_of(piece)
                k = next(k for k, (_, i, _) in enumerate(found) if i == x[len(path)])
                weights[k] = max(weights[k] - rest, 0.0)
            cut, k = rng.random() * sum(weights), 0
            while k < len(weights) - 1 and cut >= weights[k]:
                cut -= weights[k]
                k += 1
            while not weights[k] and k:
                k -= 1
            size, piece, p = found[k]
            barred = [x for x in barred if x[len(path)] == piece]
            path.append(piece)
            total += log(p)
            end -= size
        return tuple(path), total

    def probability(self, t: int, path: tuple[int, ...]) -> float:
        end, p = int(self.length[t]), 1.0
        for piece in path:
            p *= next(q for _, i, q in self.edges(t, end) if i == piece)
            end -= self.size_of(piece)
        return p

    def draw(self, types: np.ndarray, u: np.ndarray, rngs: list, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Independent samples of units from uniform numbers: pieces in order, how many each unit has, log-probabilities.

        Long units draw from the generator of their row, rngs[owner].
        """
        count, lp = np.zeros(len(types), np.int64), np.zeros(len(types))
        steps: list[tuple[np.ndarray, np.ndarray, int]] = []
        kind = self.kind[types]
        slow: dict[int, tuple[int, ...]] = {}
        order = np.argsort(kind, kind="stable")
        cuts = np.flatnonzero(np.diff(kind[order])) + 1
        for which in np.split(order, cuts) if len(order) else []:
            n, wide = divmod(int(kind[which[0]]), 32)
            if n > LONGEST_DENSE:
                for k in which:
                    slow[int(k)], lp[k] = self.one(int(types[k]), rngs[owner[k]])
                    count[k] = len(slow[int(k)])
                continue
            cum, ids = self.cum[n * 32 + wide].reshape(-1, wide), self.ids[n * 32 + wide].reshape(-1)
            for at in range(0, len(which), DRAWN):
                self._walk(n, wide, cum, ids, which[at : at + DRAWN], types, u, count, lp, steps)
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for which, found, step in steps:
            out[ends[which] - 1 - step] = found
        for k, path in slow.items():
            out[ends[k] - len(path) : ends[k]] = path[::-1]
        return out, count, lp

    def _walk(self, n: int, wide: int, cum: np.ndarray, ids: np.ndarray, which: np.ndarray, types: np.ndarray, u: np.ndarray, count: np.ndarray, lp: np.ndarray, steps: list) -> None:
        """Paths of units of one class, from their ends; adds what each step took to steps."""
        at, pos, x = self.row.take(types.take(which)) * n + (n - 1), np.full(len(which), n), u.take(which)
        gain = np.ones(len(which))
        step = 0
        while len(which):
            c = cum.take(at, axis=0)
            if wide <= 8:  # sums grow along a row, so the first above x comes behind all that aren't
                k = np.zeros(len(x), np.int64)
                for col in range(wide - 1):
                    k += c[:, col] <= x
            else:
                k = (c > x[:, None]).argmax(1)
            flat, spot = c.reshape(-1), np.arange(0, c.size, wide) + k
            high = flat.take(spot)
            low = np.where(k > 0, flat.take(spot - 1, mode="clip"), 0.0)
            share = high - low
            x = np.clip((x - low) / share, 0.0, 1 - 1e-16)
            gain *= share
            steps.append((which, ids.take(at * wide + k), step))
            k += 1
            at -= k
            pos -= k
            step += 1
            going = np.flatnonzero(pos)
            if len(going) < len(pos):
                done = np.flatnonzero(pos == 0)
                ended = which.take(done)
                lp[ended] = np.log(gain.take(done))
                count[ended] = step
                which, at, pos, x, gain = (a.take(going) for a in (which, at, pos, x, gain))

    def real(self, pieces: np.ndarray) -> np.ndarray:
        """Pieces with the bytes of uncovered characters written out."""
        odd = np.flatnonzero(pieces >= self.virtual)
        if not len(odd):
            return pieces
        parts, last = [], 0
        for k, char in zip(odd.tolist(), (pieces[odd] - self.virtual).tolist(), strict=True):
            parts += [pieces[last:k], self.char_bytes[char]]
            last = k + 1
        parts.append(pieces[last:])
        return np.concatenate(parts)


def _below(mean: np.ndarray, bound, e: np.ndarray) -> np.ndarray:
    """Gumbel variables of these means (log masses), truncated at the bound, from exponential variables."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        out = mean - np.log(np.exp(mean - bound) + e)
    return np.where(np.isneginf(mean), -inf, out)


class _Row:
    """The search of one text."""

    def __init__(self, types: np.ndarray, rng: np.random.Generator) -> None:
        self.types, self.rng, self.heap, self.paths, self.serial = types, rng, [], [], 0

    def push(self, value: float, path: int, unit: int, before: float, without: list) -> None:
        if value > -inf:
            self.serial += 1
            heappush(self.heap, (-value, self.serial, path, unit, before, without))

    def add(self, head: np.ndarray, head_count: np.ndarray, start: float, first: int, pieces: np.ndarray, count: np.ndarray, lp: np.ndarray, bound: float, most: int) -> None:
        """A finished path: the head as given, then units from `first` on as drawn. Its alternatives after the head join the heap."""
        number = len(self.paths)
        counts = np.concatenate((head_count, count))
        self.paths.append((np.concatenate((head, pieces)), counts, start + float(lp.sum())))
        if not len(lp) or start < -NOTHING:
            return
        before = start + np.concatenate(([0.0], np.cumsum(lp)[:-1]))
        n = int(np.searchsorted(-before, NOTHING)) + 1
        before, lp, count = before[:n], lp[:n], count[:n]
        with np.errstate(divide="ignore"):
            mass = np.log1p(-np.minimum(np.exp(lp), 1.0))
        mass[lp > -1e-12] = -inf
        values = _below(before + mass, bound, self.rng.standard_exponential(len(lp)))
        best = np.argpartition(-values, most)[:most] if len(values) > most else np.arange(len(values))
        ends = np.cumsum(count)
        for k in best:
            if values[k] > -inf:
                own = tuple(int(x) for x in pieces[ends[k] - count[k] : ends[k]][::-1])
                self.push(float(values[k]), number, first + int(k), float(before[k]), [own])


def search(lattice: Lattice, texts: list[list[str]], keys: list[str], samples: int, seed: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text (its units): up to `samples` of (pieces, log-probability, log of the inclusion probability), best first."""
    return search_tails(lattice, [[u[1:] for u in t] for t in texts], keys, samples, seed)


def search_tails(lattice: Lattice, texts: list[list[str]], keys: list[str], samples: int, seed: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """search() of units given by their tails."""
    flat = list(chain.from_iterable(texts))
    types = lattice.types(flat)
    rows, at = [], 0
    for words, key in zip(texts, keys, strict=True):
        rng = np.random.Generator(np.random.Philox(key=xxhash.xxh128_intdigest(f"{seed}:{key}".encode())))
        rows.append(_Row(types[at : at + len(words)], rng))
        at += len(words)

    def drawn(parts: list[tuple[_Row, int]]):
        """Pieces, counts and log-probabilities of units from `first` on, for each part."""
        sizes = [len(r.types) - first for r, first in parts]
        if not parts:
            return []
        u = np.concatenate([r.rng.random(n) for (r, _), n in zip(parts, sizes, strict=True)])
        owner = np.repeat(np.arange(len(parts)), sizes)
        pieces, count, lp = lattice.draw(np.concatenate([r.types[first:] for r, first in parts]), u, [r.rng for r, _ in parts], owner)
        cuts = np.cumsum(sizes)[:-1]
        counts = np.split(count, cuts)
        ends = np.cumsum([c.sum() for c in counts])[:-1]
        return list(zip(np.split(pieces, ends), counts, np.split(lp, cuts), strict=True))

    none, zero = np.zeros(0, np.int32), np.zeros(0, np.int64)
    full = [r for r in rows if len(r.types)]
    for r, (pieces, count, lp) in zip(full, drawn([(r, 0) for r in full]), strict=True):
        top = float(-np.log(r.rng.standard_exponential()))
        r.add(none, zero, 0.0, 0, pieces, count, lp, top, samples + 1)
    for _ in range(samples - 1):
        parts, heads = [], []
        for r in full:
            if not r.heap:
                continue
            value, _, path, unit, before, without = heappop(r.heap)
            t = int(r.types[unit])
            other, p = lattice.one(t, r.rng, without)
            pieces, counts, _ = r.paths[path]
            barred = [*without, other]
            left = 1 - sum(lattice.probability(t, x) for x in barred)
            if left > 1e-12:
                r.push(float(_below(np.array([before + log(left)]), -value, r.rng.standard_exponential(1))[0]), path, unit, before, barred)
            kept = int(counts[:unit].sum())
            parts.append((r, unit + 1))
            heads.append((np.concatenate((pieces[:kept], np.array(other[::-1], np.int32))), np.concatenate((counts[:unit], [len(other)])), before + p, unit + 1, -value))
        for (r, _), head, (pieces, count, lp) in zip(parts, heads, drawn(parts), strict=True):
            ids, counts, start, first, bound = head
            r.add(ids, counts, start, first, pieces, count, lp, bound, samples + 1)
    out = []
    for r in rows:
        bound = -r.heap[0][0] if r.heap else -inf
        found = []
        for pieces, _, lp in r.paths:
            x = lp - bound
            included = 0.0 if bound == -inf or x > 3.5 else x if x < -30 else float(np.log(-np.expm1(-exp(x))))
            found.append((lattice.real(pieces), lp, included))
        out.append(found or [(none, 0.0, 0.0)])
    return out



def encode(docs: DataFrame, model: str = MODEL, samples: int = SAMPLES, smoothing: float = SMOOTHING, seed: int = SEED) -> DataFrame:
    """Up to `samples` rows (doc_id, sample, pieces, log_prob, log_inclusion) for each row of docs, sample counting from 1.

    log_prob is the log-probability of the segmentation among all of its text, log_inclusion the log
    of the probability that it lies above the threshold, the perturbed value that is next; 0 where all
    segmentations are listed. A text with fewer segmentations has fewer rows.

    Null text: one row with null pieces. Empty text: one row without pieces, its only segmentation. Very long texts, and
    long runs without a space, are encoded whole. Null ids share the key "null". Rows with the same id and text give the same
    rows; the id, not the row, is the key. U+2581 in a text is encoded as its bytes, so decoding is exact. Other columns are ignored.
    """
    with open(model, "rb") as f:
        data = f.read()

    @given_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(Vocabulary(data), smoothing)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            a = 0
            while a < len(ids):
                b, n = a, 0
                while b < len(ids) and n < BATCH:
                    n += len(texts[b] or "")
                    b += 1
                found = search_tails(lattice, [tails(t or "") for t in texts[a:b]], [str(i) if i is not None else "null" for i in ids[a:b]], samples, seed)
                yield _batch(ids[a:b], texts[a:b], found)
                a = b
                if lattice.bytes > TABLE_BYTES or len(lattice.type) > MOST_TYPES:
                    lattice.trim(TABLE_BYTES // 2, MOST_TYPES // 2)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(work, SCHEMA)


def _batch(ids: list, texts: list, found: list) -> pa.RecordBatch:
    key, number, sizes, parts, lp, inc, valid = [], [], [0], [], [], [], []
    for i, text, rows in zip(ids, texts, found, strict=True):
        for k, (pieces, log_prob, included) in enumerate(rows):
            key.append(i)
            number.append(k + 1)
            valid.append(text is not None)
            parts.append(pieces)
            sizes.append(len(pieces))
            lp.append(log_prob if text is not None else None)
            inc.append(included if text is not None else None)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(values, pa.int32()), mask=pa.array([not v for v in valid], pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(number, pa.int32()), lists, pa.array(lp, pa.float64()), pa.array(inc, pa.float64())], ["doc_id", "sample", "pieces", "log_prob", "log_inclusion"])


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, sample, text) of rows with pieces; null pieces give a null text."""
    with open(model, "rb") as f:
        data = f.read()

    @given_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(data)
        for batch in batches:
            text = pa.array([None if p is None else vocabulary.decode(p) for p in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], ["doc_id", "sample", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("sample").cast("int"), "pieces").mapInArrow(work, "doc_id long, sample int, text string")
