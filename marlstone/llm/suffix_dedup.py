"""Passages that repeat across documents, by a run-length index.

Texts are sequences of words. A passage of `least` words or more that two documents share is
found in three steps, none of which forms pairs of documents.

1. Anchors: of every window of `least` words, the run of GRAM words with the smallest hash. Two equal
   windows choose the same run, so documents that share a passage share an anchor in it. An anchor of one document only is dropped.
2. Contexts: the words around an anchor that a passage of `least` words through it can reach. A context that occurs whole in
   two documents is marked at once; of those, one stands for all from here on.
3. Index: the contexts of an anchor meet in one task. There the words of many contexts are indexed by the runs of their
   Burrows-Wheeler transform, with the suffix array sampled at both ends of each run and a threshold between neighbouring runs
   of a word. Other contexts are streamed through it from right to left, which yields the matching statistics: for every
   place the length of the longest match in the indexed contexts. Where it is `least` or more, the match is marked.

A context must not match itself, nor its own document. So documents are numbered within an anchor, and for each bit of
the number the contexts with that bit clear are indexed and those with it set are streamed, and the other way round: any
two documents differ in some bit.

That takes a pass for each bit, and one task holds all contexts of an anchor. So an anchor of more than HOT contexts takes another
way, as exact: each of its contexts sends a hash of every window of `least` words, all of which contain the anchor, and a window that another
document has too is marked. The windows go by their distance from the anchor to several tasks, which sort them once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.session import materialize

LEAST, GRAM = 50, 8
#: Words of contexts that are indexed together; an anchor's own contexts always are.
BLOCK = 200_000
#: Contexts of an anchor that are indexed at most; windows, by their distance from the anchor, that go to one task.
HOT, SLICE = 64, 11
_BASE = 0x9E3779B97F4A7C15


def _hashed(docs: DataFrame, least: int) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(words, lambda w: F.xxhash64(w)).alias("h"))
    return rows


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _anchors(h: np.ndarray, bounds: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of flat word hashes: row, place in the row, hash, hash of the context."""
    n, window = len(h), least - gram + 1
    if n < least:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    g = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        g = (g ^ h[k : n - gram + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
    low = np.uint64((1 << 24) - 1)
    packed = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low)
    least_of, size = packed, 1
    while size * 2 <= window:
        least_of = np.minimum(least_of[:-size], least_of[size:])
        size *= 2
    if window > size:
        least_of = np.minimum(least_of[: len(packed) - window + 1], least_of[window - size : window - size + len(packed) - window + 1])
    starts = np.arange(len(least_of))
    row = np.searchsorted(bounds, starts, side="right") - 1
    inside = starts + least <= bounds[row + 1]
    best = least_of[inside] & low
    at = starts[inside].astype(np.uint64)
    at = ((at & ~low) | best).astype(np.int64)
    at = np.where(at < starts[inside], at + (1 << 24), at)
    at = np.unique(at)
    row = np.searchsorted(bounds, at, side="right") - 1
    a, b = np.maximum(bounds[row], at - (least - gram)), np.minimum(bounds[row + 1], at + least)
    powers = _powers(_BASE, n)
    inverse = _powers(pow(_BASE, -1, 1 << 64), n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers[:n], dtype=np.uint64)))
    context = (sums[b] - sums[a]) * inverse[a] + (at - a).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (b - a).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    return row, at - bounds[row], g[at].view(np.int64), context.view(np.int64)


def anchors(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(anchor, doc_id, place, context) of all anchors."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                at = batch.column(1).offsets.to_numpy().astype(np.int64)
                h = batch.column(1).values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].view(np.uint64)
                row, place, anchor, context = _anchors(h, at - at[0], least, gram)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), batch.column(0).take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(context)], ["anchor", "doc_id", "place", "context"])

    return _hashed(docs, least).mapInArrow(find, "anchor long, doc_id long, place int, context long")


class RunLengthIndex:
    """A text of ranked words 0.. as the runs of its Burrows-Wheeler transform, for matching statistics.

    Kept of the suffix array are only its values at the first and the last row of each run; kept of the longest
    common prefixes only where, between two runs of a word, the shortest one lies.
    """

    def __init__(self, text: np.ndarray) -> None:
        text = np.concatenate((text.astype(np.int64) + 1, [0]))
        n = len(text)
        self.text = text
        ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
        size = 1
        while True:
            r = ranks[-1]
            if r.max() == n - 1:
                break
            ahead = np.full(n, 0, np.int64)
            ahead[: n - size] = r[size:] + 1 if size < n else 0
            key = r * (n + 1) + ahead
            order = np.argsort(key)
            sorted_ = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
            ranks.append(new)
            size *= 2
        array = np.empty(n, np.int64)
        array[ranks[-1]] = np.arange(n)
        bwt = text[array - 1]
        common = np.zeros(n, np.int64)
        a, b = array[:-1].copy(), array[1:].copy()
        for level in range(len(ranks) - 1, -1, -1):
            r = ranks[level]
            fits = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[fits] = r[a[fits]] == r[b[fits]]
            step = np.where(same, 1 << level, 0)
            common[1:] += step
            a += step
            b += step
        first = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        last = np.concatenate((first[1:], [n])) - 1
        self.first, self.word = first, bwt[first]
        self.at_first, self.at_last, self.last = array[first], array[last], last
        before = np.zeros(n, np.int64)
        order = np.argsort(bwt * n + np.arange(n))
        before[order] = np.arange(n)
        self.leads = before[first]
        runs = len(first)
        self.runs = runs
        by_word = np.argsort(self.word, kind="stable")
        self.by_word, self.key = by_word, self.word[by_word] * runs + by_word
        tables, k = [common], 1
        while 2 * k <= n:
            t = tables[-1]
            tables.append(np.minimum(t[:-k], t[k:]))
            k *= 2
        low, high = last[by_word[:-1]] + 1, first[by_word[1:]] + 1
        self.threshold = np.zeros(max(runs, 1), np.int64)
        same = (self.word[by_word[:-1]] == self.word[by_word[1:]]) & (high > low)
        which = np.flatnonzero(same)
        if len(which):
            lo, hi = low[which].copy(), high[which].copy()

            def least(x, y):
                level = np.floor(np.log2(y - x)).astype(int)
                out = np.empty(len(x), np.int64)
                for g in np.unique(level):
                    m = level == g
                    out[m] = np.minimum(tables[g][x[m]], tables[g][y[m] - (1 << g)])
                return out

            target = least(lo, hi)
            while (hi - lo > 1).any():  # the first row with the least common prefix, by halving
                wide = hi - lo > 1
                mid = (lo + hi) // 2
                left = wide.copy()
                left[wide] = least(lo[wide], mid[wide]) == target[wide]
                hi = np.where(wide & left, mid, hi)
                lo = np.where(wide & ~left, mid, lo)
            self.threshold[which + 1] = lo

    def statistics(self, patterns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Lengths of the longest matches from each place of patterns (rows, filled up with -1 after their length; words not in the text are -1 too)."""
        count, width = patterns.shape
        out = np.zeros((count, width), np.int64)
        row, at, got = np.zeros(count, np.int64), np.full(count, -1, np.int64), np.zeros(count, np.int64)
        text = np.concatenate((self.text, np.full(width + 1, -2)))
        ahead = np.arange(width)
        for i in range(width - 1, -1, -1):
            c = patterns[:, i] + 1
            live = i < lengths
            run = np.searchsorted(self.first, row, side="right") - 1
            same = live & (c > 0) & (self.word[run] == c) & (at >= 0)
            jump = np.flatnonzero(live & ~same)
            here, place, length = row, at - 1, got + 1
            if len(jump):
                word, spot = c[jump], np.searchsorted(self.key, c[jump] * self.runs + run[jump])
                high = np.minimum(spot, self.runs - 1)
                succ, pred = self.by_word[high], self.by_word[np.maximum(spot - 1, 0)]
                succ_ok, pred_ok = (spot < self.runs) & (self.word[succ] == word), (spot > 0) & (self.word[pred] == word)
                back = pred_ok & (~succ_ok | (row[jump] < self.threshold[high]))
                ok = (succ_ok | pred_ok) & (word > 0)
                to = np.where(back, pred, succ)
                run[jump] = to
                here = here.copy()
                here[jump] = np.where(back, self.last[to], self.first[to])
                place[jump] = np.where(ok, np.where(back, self.at_last[to], self.at_first[to]) - 1, -1)
                # the match goes on behind the word as far as it did from there, at most
                far = jump[ok & (got[jump] > 0)]
                length[jump] = ok
                if len(far):
                    most = int(got[far].max())
                    equal = patterns[far, i + 1 : i + 1 + most] + 1 == text[place[far][:, None] + 1 + ahead[None, :most]][:, : max(width - i - 1, 0)]
                    equal &= patterns[far, i + 1 : i + 1 + most] >= 0
                    whole = equal.all(1)
                    length[far] = 1 + np.where(whole, equal.shape[1], (~equal).argmax(1) if equal.shape[1] else 0)
                known = live.copy()
                known[jump[~ok]] = False
            else:
                known = live
            row = np.where(known, self.leads[run] + here - self.first[run], row)
            at = np.where(known, place, np.where(live, -1, at))
            got = np.where(known, length, np.where(live, 0, got))
            out[:, i] = np.where(live, got, 0)
        return out


def block_marks(anchor: np.ndarray, doc: np.ndarray, whole: np.ndarray, start: np.ndarray, words: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks (doc, from, to) of contexts: words that match a context of the same anchor and another document in a run of `least` or more.

    Contexts with `whole` set stand for several documents: they are matched against, and not marked.
    """
    own = np.where(whole, -1 - np.arange(len(doc)), np.unique(doc, return_inverse=True)[1])
    order = np.lexsort((own, anchor))
    a, o = anchor[order], own[order]
    fresh_anchor = np.concatenate(([True], a[1:] != a[:-1]))
    fresh = fresh_anchor | np.concatenate(([True], o[1:] != o[:-1]))
    serial = np.cumsum(fresh) - 1
    number = np.empty(len(doc), np.int64)
    number[order] = serial - np.maximum.accumulate(np.where(fresh_anchor, serial, 0))
    _, group = np.unique(anchor, return_inverse=True)
    most = np.zeros(group.max() + 1, np.int64)
    np.maximum.at(most, group, number)
    lengths = np.array([len(w) for w in words])
    ends = np.cumsum(lengths)
    begins = ends - lengths
    _, plain = np.unique(np.concatenate(words), return_inverse=True)
    # a word of one anchor is another word than the same of another anchor, so anchors don't match each other
    _, ranked = np.unique(np.repeat(group, lengths) * (plain.max() + 1) + plain, return_inverse=True)
    kinds = int(ranked.max()) + 1
    cover = np.zeros(int(ends[-1]) + len(words), np.int64)
    slot = begins + np.arange(len(words))
    bit = 0
    while (1 << bit) <= most.max():
        takes = most[group] >= (1 << bit)
        for side in (0, 1):
            indexed = np.flatnonzero(takes & (number >> bit & 1 == side))
            streamed = np.flatnonzero(takes & (number >> bit & 1 != side) & ~whole)
            if not len(indexed) or not len(streamed):
                continue
            pieces = []
            for k, c in enumerate(indexed):
                pieces += [ranked[begins[c] : ends[c]], [kinds + k]]
            index = RunLengthIndex(np.concatenate(pieces))
            width = int(lengths[streamed].max())
            inside = np.arange(width)[None, :] < lengths[streamed][:, None]
            patterns = np.full((len(streamed), width), -1, np.int64)
            patterns[inside] = ranked[(begins[streamed][:, None] + np.arange(width)[None, :])[inside]]
            found = index.statistics(patterns, lengths[streamed])
            r, i = np.nonzero(found >= least)
            np.add.at(cover, slot[streamed[r]] + i, 1)
            np.add.at(cover, slot[streamed[r]] + i + found[r, i], -1)
        bit += 1
    on = np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8)))
    low, high = np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1)
    which = np.searchsorted(slot, low, side="right") - 1
    return doc[which], start[which] + low - slot[which], start[which] + high - slot[which]


def window_marks(anchor: np.ndarray, doc: np.ndarray, whole: np.ndarray, start: np.ndarray, offsets: np.ndarray, windows: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks (doc, from, to) of rows that list hashes of consecutive windows, the first of which begins at `start`: windows that a row of the same anchor and another document lists too.

    Rows with `whole` set stand for several documents: they are matched against, and not marked.
    """
    row = np.repeat(np.arange(len(doc)), np.diff(offsets))
    key = windows.view(np.uint64) ^ (anchor.view(np.uint64) * np.uint64(_BASE))[row]
    order = np.argsort(key)
    sorted_ = key[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    owner = row[order]
    docs = doc[owner]
    shared = (np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)) | np.logical_or.reduceat(whole[owner], first)
    on = np.empty(len(key), bool)
    on[order] = np.repeat(shared, np.diff(np.concatenate((first, [len(key)]))))
    on &= ~whole[row]
    edge = np.concatenate(([True], row[1:] != row[:-1], [True]))
    low = np.flatnonzero(on & (edge[:-1] | ~np.concatenate(([False], on[:-1]))))
    high = np.flatnonzero(on & (edge[1:] | ~np.concatenate((on[1:], [False]))))
    which = row[low]
    return doc[which], start[which] + low - offsets[which], start[which] + high - offsets[which] + least


def _mark(batches: Iterator[pa.RecordBatch], least: int, block: int) -> Iterator[pa.RecordBatch]:
    """Marks of rows (anchor, slice, doc_id, whole, start, words) that are sorted by anchor and slice; the rows of a pair may go on in the next batch.

    Rows with slice -1 hold the words of a context, others the hashes of windows, two numbers each.
    """
    kept: list[pa.RecordBatch] = []
    size = 0

    def key(batch: pa.RecordBatch, k: int) -> tuple[int, int]:
        return batch.column(0)[k].as_py(), batch.column(1)[k].as_py()

    def marks(rows: pa.Table, indexed: bool) -> pa.RecordBatch:
        lists = rows.column(5).combine_chunks()
        at = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        anchor, doc, whole, start = (rows.column(k).to_numpy() for k in (0, 2, 3, 4))
        start = start.astype(np.int64)
        if indexed:
            doc, low, high = block_marks(anchor, doc, whole, start, [flat[at[k] : at[k + 1]] for k in range(len(at) - 1)], least)
        else:
            doc, low, high = window_marks(anchor, doc, whole, start, (at - at[0]).astype(np.int64) // 2, np.ascontiguousarray(flat[at[0] : at[-1]]).view(np.int64), least)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["doc_id", "a", "b"])

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        index = rows.column(1).to_numpy() < 0
        for indexed in (True, False):
            if (index == indexed).any():
                yield marks(rows.filter(pa.array(index == indexed)), indexed)

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            kept.append(part)
            size += part.num_rows * 2 * least
            if size < block or (last := key(part, part.num_rows - 1)) == key(kept[0], 0):
                continue
            table = pa.Table.from_batches(kept)
            keys, slices = table.column(0).to_numpy(), table.column(1).to_numpy()
            cut = int(np.searchsorted(keys, last[0], side="left"))
            cut += int(np.searchsorted(slices[cut:], last[1], side="left"))
            yield from run(table.slice(0, cut))
            kept = table.slice(cut).to_batches()
            size = (table.num_rows - cut) * 2 * least
    if kept:
        yield from run(pa.Table.from_batches(kept))


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_id, spans) of the documents that share a passage of `least` words or more with another document.

    Words are what white space separates, compared as they are and numbered from 0; spans are the ranges [start, end) of all words in
    such passages, merged and in order. Every copy is listed, the first one too.

    Rows with a null id or text, and texts of fewer words, share none. Rows with the same id are one document, so passages
    that only they, or one text by itself, repeat aren't listed. Very long texts are read whole; an empty
    table gives an empty result; other columns are ignored.
    """
    found = anchors(docs, least, gram)
    met = W.partitionBy("anchor")
    shared = found.withColumn("low", F.min("doc_id").over(met)).withColumn("high", F.max("doc_id").over(met)).where("low <> high").drop("low", "high")
    whole = W.partitionBy("anchor", "context")
    shared = shared.withColumn("first", F.min("doc_id").over(whole)).withColumn("whole", F.col("first") != F.max("doc_id").over(whole))
    shared = materialize(shared, "anchors")
    # one of those that repeat whole stands for all; alone under its anchor it has nothing to match
    stands = ~F.col("whole") | (F.row_number().over(whole.orderBy("doc_id", "place")) == 1)
    chosen = shared.withColumn("stands", stands).where("stands").withColumn("n", F.count(F.lit(1)).over(met)).where("n > 1")
    reach = least - gram
    wanted = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place", "whole", (F.col("n") > hot).alias("hot"))).alias("wanted"))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    hashed = texts.select("doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("h"), "wanted")

    def spread(begins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of lists of n members, and the places of all members."""
        offsets = np.concatenate(([0], np.cumsum(n)))
        return offsets, np.repeat(begins - offsets[:-1], n) + np.arange(offsets[-1])

    def rows(anchor, slice_, ids, all_, start, offsets, words) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words))
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(slice_.astype(np.int32)), pa.array(ids), pa.array(all_.astype(bool)), pa.array(start.astype(np.int32)), lists], ["anchor", "slice", "doc_id", "whole", "start", "words"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 200):
                batch = whole_batch.slice(start, 200)
                ids = np.asarray(batch.column(0))
                at = batch.column(1).offsets.to_numpy().astype(np.int64)
                h = batch.column(1).values.to_numpy(zero_copy_only=False)
                per = batch.column(2).offsets.to_numpy().astype(np.int64)
                items = batch.column(2).values
                row = np.repeat(np.arange(len(ids)), np.diff(per))
                part = slice(per[0], per[-1])
                anchor, place, all_, many = (np.asarray(items.field(k).to_numpy(zero_copy_only=False))[part] for k in range(4))
                base, size = at[row], at[row + 1] - at[row]
                a, b = np.maximum(place - reach, 0), np.minimum(place + least, size)
                few = np.flatnonzero(~many)
                if len(few):
                    offsets, take = spread((base + a)[few], (b - a)[few])
                    yield rows(anchor[few], np.full(len(few), -1), ids[row[few]], all_[few], a[few], offsets, (h[take] ^ (h[take] >> 32)).astype(np.int32))
                if len(few) == len(many):
                    continue
                words = h[at[0] : at[-1]].view(np.uint64)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, len(words))[:-1], dtype=np.uint64)))
                inverse = _powers(pow(_BASE, -1, 1 << 64), len(words))
                for k in range(reach // SLICE + 1):
                    low, high = np.maximum(a, place - (k + 1) * SLICE + 1), np.minimum(b - least, place - k * SLICE)
                    which = np.flatnonzero(many & (low <= high))
                    offsets, take = spread((base - at[0] + low)[which], (high - low + 1)[which])
                    windows = ((sums[take + least] - sums[take]) * inverse[take]).view(np.int32)
                    yield rows(anchor[which], np.full(len(which), k), ids[row[which]], all_[which], low[which], 2 * offsets, windows)

    contexts = hashed.mapInArrow(cut, "anchor long, slice int, doc_id long, whole boolean, start int, words array<int>")
    marks = contexts.repartition("anchor", "slice").sortWithinPartitions("anchor", "slice").mapInArrow(lambda batches: _mark(batches, least, block), "doc_id long, a int, b int")
    long_words = _word_counts(docs)
    direct = shared.where("whole").join(long_words, "doc_id").select("doc_id", F.greatest(F.col("place") - reach, F.lit(0)).alias("a"), F.least(F.col("place") + least, F.col("n_words")).alias("b"))
    return _merged(direct.unionByName(marks))


def _word_counts(docs: DataFrame) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.size(words).alias("n_words"))
    return rows.groupBy("doc_id").agg(F.max("n_words").alias("n_words"))


def _merged(marks: DataFrame) -> DataFrame:
    """(doc_id, spans) of ranges (doc_id, a, b), those that touch or overlap made one."""
    order = W.partitionBy("doc_id").orderBy("a", "b")
    seen = marks.distinct().withColumn("upto", F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1)))
    parts = seen.withColumn("part", F.sum(F.when(F.col("upto").isNull() | (F.col("a") > F.col("upto")), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = parts.groupBy("doc_id", "part").agg(F.min("a").alias("start"), F.max("b").alias("end"))
    return spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
