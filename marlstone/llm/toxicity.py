"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A text is cut into overlapping windows of
running text, 32 characters every 16; each is compressed with either dictionary, and the bytes that the toxic one saves beyond
a slack are its evidence. The evidence of a passage, of at most 128 windows, over their number is compared with a threshold that is
calibrated on labelled documents held out of the training; a text is as toxic as its worst passage. All windows have the same length (the last one ends with the text, a text under 32 characters
is filled up with spaces), so one threshold holds for every text.

Compressed lengths are whole bytes, too coarse for windows of this size. So the text is written out first: every character becomes
four bytes that depend on it and its neighbours. A match then costs what it did, but literals cost four times as much.

Labels cover whole documents, of which toxic passages are a small part: the trainer of zstandard, which takes what is
frequent, would fill the toxic dictionary with ordinary words. Its segments are therefore chosen by contrast: stretches of running text whose
strings of 6 and 9 characters occur in many toxic documents and in few ordinary ones, up to 64 characters, those
in most documents nearest to the end. Passages of 32 characters or more that several documents of the sample share count once, so that
copies don't pose as vocabulary. The ordinary dictionary comes from the trainer; it also follows the toxic segments in the toxic
dictionary, so that ordinary text is compressed alike with both and only toxic segments make a difference.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.memory import given_back

#: Bounds of the labelled sample that the classifier is fitted on: documents of each class, and the characters of one.
MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 2000, 4000, 100_000
TOXIC_BYTES, ORDINARY_BYTES = 16384, 131072
WINDOW, STRIDE = 32, 16
#: Saved bytes of a window that chance matches explain.
SLACK = 3
#: The evidence of a text is averaged over its windows and so many empty ones.
PRIOR = 30
PASSAGE = 128
STRINGS, LONGEST, SHARED = (6, 9), 64, 32
#: In calibration a share of ordinary documents flagged weighs as much as ten times that share of toxic ones missed.
FALSE_ALARM_COST = 10
#: Characters that are compressed at once.
BLOCK = 1 << 20
GONE = "\0"
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _written_out(text: str) -> np.ndarray:
    """Four bytes for each character of a text but the first and last, by itself and its neighbours."""
    x = _codes(text)
    h = (x[:-2] * np.uint64(0x1F123BB5) + x[1:-1] * np.uint64(0xD6E8FEB86659) + x[2:] * np.uint64(0x7FB5D329728EA185)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h.astype(np.uint32)


def blocks(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(written-out text, (offset, length) of each window in it, the text each window is of), a bounded number of characters at a time."""
    parts, spots, owner, size = [], [], [], 0

    def ready():
        return np.concatenate(parts).tobytes(), np.concatenate(spots).astype(np.uint64), np.concatenate(owner)

    for k, text in enumerate(texts):
        if not text:
            continue
        low = text.lower().ljust(WINDOW)
        n, framed = len(low), f" {low} "
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK + WINDOW - STRIDE)
            if b - a < WINDOW:
                a = n - WINDOW
            at = np.arange(0, b - a - WINDOW + 1, STRIDE)
            if b == n and at[-1] + WINDOW < b - a:
                at = np.append(at, b - a - WINDOW)
            parts.append(_written_out(framed[a : b + 2]))
            spots.append(np.stack([(size + at) * 4, np.full(len(at), WINDOW * 4)], 1))
            owner.append(np.full(len(at), k))
            size += b - a
            if size >= BLOCK:
                yield ready()
                parts, spots, owner, size = [], [], [], 0
            if b == n:
                break
    if parts:
        yield ready()


def _compressor(data: bytes) -> zs.ZstdCompressor:
    params = zs.ZstdCompressionParameters(
        window_log=20, chain_log=16, hash_log=17, search_log=4, min_match=7, strategy=zs.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    kept = zs.ZstdCompressionDict(data, dict_type=zs.DICT_TYPE_RAWCONTENT)
    kept.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=kept, compression_params=params)


class Saved:
    """Bytes that the toxic dictionary saves on windows."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)

    def __call__(self, data: bytes, spots: np.ndarray) -> np.ndarray:
        given = zs.BufferWithSegments(data, spots.tobytes())
        sizes = [np.fromiter(map(len, c.multi_compress_to_buffer(given, threads=0)), np.int64, len(spots)) for c in (self.ordinary, self.toxic)]
        return sizes[0] - sizes[1]


def evidence(saved: Saved, texts: list[str]) -> np.ndarray:
    """The evidence of texts: saved bytes beyond the slack over the number of windows and PRIOR, in the passage of PASSAGE windows where that is most.

    Passages begin at every half passage; a text of fewer windows is one passage.
    """
    parts = [(owner, np.maximum(saved(data, spots) - SLACK, 0)) for data, spots, owner in blocks(texts)]
    if not parts:
        return np.zeros(len(texts))
    owner, excess = (np.concatenate(x) for x in zip(*parts, strict=True))
    windows = np.bincount(owner, minlength=len(texts))
    halves = (windows + PASSAGE // 2 - 1) // (PASSAGE // 2)
    first = np.cumsum(halves) - halves
    at = first[owner] + (np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]) // (PASSAGE // 2)
    total, n = np.bincount(at, excess, halves.sum()), np.bincount(at, minlength=halves.sum())
    of = np.repeat(np.arange(len(texts)), halves)
    both = np.flatnonzero(of[:-1] == of[1:])
    found = np.zeros(len(texts))
    lone = halves == 1
    found[lone] = total[first[lone]] / (n[first[lone]] + PRIOR)
    np.maximum.at(found, of[both], (total[both] + total[both + 1]) / (n[both] + n[both + 1] + PRIOR))
    return found


def _strings(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all strings of n characters."""
    h = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
    for k in range(n):
        h = (h ^ codes[k : len(h) + k]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _without_shared(texts: list[str]) -> list[str]:
    """Lower-cased texts, passages of SHARED characters that an earlier one holds replaced by GONE (found by every eighth hash)."""
    seen: set[int] = set()
    out = []
    for text in texts:
        low = text.lower().replace(GONE, " ")
        codes = _codes(low)
        h = _strings(codes, SHARED)
        at = np.flatnonzero(h % np.uint64(8) == 0)
        keys = h[at].tolist()
        old = at[np.fromiter((x in seen for x in keys), bool, len(keys))]
        if len(old):
            depth = np.zeros(len(codes) + 1, np.int64)
            np.add.at(depth, old, 1)
            np.add.at(depth, old + SHARED, -1)
            kept = codes.astype(np.uint32)
            kept[np.cumsum(depth)[:-1] > 0] = 0
            low = kept.tobytes().decode("utf-32-le", "surrogatepass")
        seen.update(keys)
        out.append(f" {low} ")
    return out


def _contrast(toxic: list[str], ordinary: list[str], size: int) -> bytes:
    """The toxic segments, written out, at most `size` bytes; those of most documents come last."""
    marks = [np.zeros(len(t), bool) for t in toxic]
    for n in STRINGS:
        each = [np.unique(_strings(_codes(t), n)) for t in toxic]
        keys, a = np.unique(np.concatenate(each), return_counts=True)
        b = np.zeros(len(keys), np.int64)
        for t in ordinary:
            h = np.unique(_strings(_codes(t), n))
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            b[at[keys[at] == h]] += 1
        whole = (a + b) / (len(toxic) + len(ordinary))
        gain = a * np.log(a / len(toxic) / whole) + b * np.log(np.maximum(b, 1) / len(ordinary) / whole)
        telling = keys[(a >= 3) & (gain > 8) & (a / len(toxic) > 8 * (b + 0.5) / len(ordinary))]
        if not len(telling):
            continue
        for t, mark in zip(toxic, marks, strict=True):
            h = _strings(_codes(t), n)
            found = np.flatnonzero(telling[np.minimum(np.searchsorted(telling, h), len(telling) - 1)] == h)
            for k in range(n):
                mark[found + k] = True
    counts: Counter[str] = Counter()
    for t, mark in zip(toxic, marks, strict=True):
        edge = np.diff(np.concatenate(([0], mark.astype(np.int8), [0])))
        runs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
        counts.update({t[max(i - 1, 0) : j + 1] for i, j in runs if j - i <= LONGEST and GONE not in t[i:j]})
    out = b""
    for segment, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        data = _written_out(segment).tobytes()
        if data in out:
            continue
        if len(out) + len(data) > size:
            break
        out = data + out
    return out


def fit(sample: list[tuple[str, int]], toxic_bytes: int = TOXIC_BYTES, ordinary_bytes: int = ORDINARY_BYTES) -> dict | None:
    """A model of labelled texts (text, 1 toxic or 0): both dictionaries and the threshold.

    Every third document of each class is held out for calibration. None where a class has no document, or where nothing is more
    frequent in the toxic ones.
    """
    kinds = [[t for t, y in sample if y == k and t] for k in (0, 1)]
    (ordinary, plain), (toxic, held) = (([t for i, t in enumerate(x) if i % 3], [t for i, t in enumerate(x) if not i % 3]) for x in kinds)
    if not ordinary or not toxic:
        return None
    once = _without_shared(toxic + ordinary)
    segments = _contrast(once[: len(toxic)], once[len(toxic) :], toxic_bytes)
    if not segments:
        return None
    chosen = [data[a : a + n] for data, spots, _ in blocks(once[len(toxic) :]) for a, n in spots[:: max(1, sum(map(len, ordinary)) // 960_000)].tolist()]
    try:
        base = zs.train_dictionary(ordinary_bytes, chosen).as_bytes()
    except zs.ZstdError:  # too few samples for the trainer: their text itself is the dictionary
        base = b"".join(chosen)[-ordinary_bytes:]
    model = {"toxic": segments + base, "ordinary": base, "threshold": 0.0}
    saved = Saved(model["toxic"], model["ordinary"])
    hits, alarms = np.sort(evidence(saved, held)), np.sort(evidence(saved, plain))
    best, least = -np.inf, 0.0
    for t in np.unique(hits[hits > 0]).tolist():
        gain = (hits >= t).mean() - FALSE_ALARM_COST * (alarms >= t).mean()
        if gain > best:
            best, least = gain, t
    if best <= 0:
        return None
    under = np.concatenate((alarms[alarms < least], [0.0])).max()
    model["threshold"] = float(least + min(under, least)) / 2
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, max_chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """A bounded sample of labelled documents, whole texts of at most max_chars characters, in the order of the MD5 of their ids.

    A document with labels of both kinds counts as toxic; of rows with the same id the least text is taken; null ids, labels and texts are left out.
    """
    each = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    keyed = each.withColumn("k", F.md5(F.col("doc_id").cast("string")))
    chosen = keyed.where("toxic = 1").orderBy("k").limit(max_toxic).union(keyed.where("toxic = 0").orderBy("k").limit(max_ordinary))
    texts = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(chosen), "doc_id")  # at most max_toxic + max_ordinary ids
    texts = texts.groupBy("k", "toxic").agg(F.min("text").alias("text"))
    return [(r.text, r.toxic) for r in sorted(texts.collect(), key=lambda r: (r.k, r.text))]


def judge(model: dict | None, texts: list[str | None], saved: Saved | None = None) -> tuple[list[float | None], list[bool]]:
    """Scores and decisions of texts: the score is between 0 and 1, toxic from 0.5 on; none without a model or text."""
    texts = list(texts)
    if model is None:
        return [None] * len(texts), [False] * len(texts)
    found = evidence(saved or Saved(model["toxic"], model["ordinary"]), [t or "" for t in texts])
    scores = found / (found + model["threshold"])
    return [float(s) if t else None for s, t in zip(scores, texts, strict=True)], [bool(t) and bool(f >= model["threshold"]) for f, t in zip(found, texts, strict=True)]


def classify(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score, toxic) for every row of docs; doc_id keeps its type.

    Every window of the whole text is compared, however long it is. Null and empty texts have no score (null) and
    aren't toxic, nor is anything if there was nothing to fit a model on. A text exactly at the threshold is toxic. Repeated rows and null ids
    give a row each; an empty table gives an empty result; other columns are ignored.
    """

    @given_back
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        saved = Saved(model["toxic"], model["ordinary"]) if model else None
        for batch in batches:
            scores, toxic = judge(model, batch.column(1).to_pylist(), saved)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(toxic, pa.bool_())], ["doc_id", "score", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, toxic boolean")


def find_toxic(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> DataFrame:
    """classify() with a model fitted on a bounded labelled sample of docs."""
    return classify(docs, fit(labelled_sample(docs, labels, max_toxic, max_ordinary)))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't judged toxic, with all their columns as they are.

    Rows with a null or empty text, or a null id, are judged like any other and so kept if they hold no evidence; repeated rows
    share their fate; without usable labels, or in an empty table, nothing is dropped.
    """
    model = fit(labelled_sample(docs, labels))

    @given_back
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        saved = Saved(model["toxic"], model["ordinary"]) if model else None
        for batch in batches:
            _, toxic = judge(model, batch.column(batch.schema.get_field_index("text")).to_pylist(), saved)
            yield batch.filter(pa.array([not t for t in toxic], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
