"""Line deduplication by a deletion-neighbourhood join.

Lines are sequences of words. Equal lines are found by a 128-bit hash. Of those, the lines of at least `min_words` words are also
compared within an edit bound that grows with the shorter line (`bound`): one word inserted, removed or replaced up to 19
words, one more for each doubling from there.

One edit: a line emits the hash of itself and of
every variant with one word deleted. Two lines within the bound share a key: one that replaces a word
shares the variant without it, at the same place; one that has a word more has a variant that is the
other. Within a key the earliest line of each side is all that the others need, so no key forms all its
pairs, and a template that millions of lines share costs them one row each.

A line without a partner has nothing to emit. With one edit, either the first or the last half of
the shorter line is the same in both, so only lines that share such a half with another one emit
variants, and only their texts are fetched. Candidate pairs are verified by their edit distance.

More edits, at 20 words or more: of k + 1 stretches of the shorter line one is the same in the longer, at a place that the edits
before and after it allow. Lines emit their stretches, and those where one of a shorter or equally long partner may lie. A line that
meets others is compared with the earliest of each key first; only where that isn't a partner, with those members of the key that come before the
earliest partner found. Stretches have 6 words or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from marlstone.llm.memory import given_back
from marlstone.session import materialize

MIN_WORDS = 4
#: From so many words on the bound is two edits or more.
LONG_WORDS = 20


def bound(n: int) -> int:
    """Edits allowed between lines of which the shorter has n words: 1 under 20, 2 under 40, 3 under 80 and so on."""
    return max(1, (n // 10).bit_length())


def edits(a: list[str], b: list[str], most: int) -> int | None:
    """The edit distance of two word sequences, None if it is over most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most or len(set(a) ^ set(b)) > 2 * most:  # an edit takes one word away and adds another at most
        return None
    n = len(a)
    k = next((i for i in range(n) if a[i] != b[i]), n)
    a, b = a[k:], b[k:]
    k = next((i for i in range(len(a)) if a[-1 - i] != b[-1 - i]), len(a))
    a, b = a[: len(a) - k], b[: len(b) - k]
    far = most + 1
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, word in enumerate(a, 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if j == 0 else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (word != b[j - 1]))
        row = new
        if min(row.values()) > most:
            return None
    found = row.get(len(b), far)
    return found if found <= most else None


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether the edit distance of two word sequences is at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    k = next((i for i in range(n) if a[i] != b[i]), n)
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k:])


def _lines(docs: DataFrame) -> DataFrame:
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(F.trim("line") != "")


def _halves(w: Column) -> list[Column]:
    """Hashes of the first and last words that a partner may share, as it may be one word shorter; null where twice the same."""
    n = F.size(w)
    a, b = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    odd = a == b
    return [
        F.xxhash64(F.lit("first"), F.slice(w, F.lit(1), a)),
        F.xxhash64(F.lit("last"), F.slice(w, n - a + 1, a)),
        F.when(~odd, F.xxhash64(F.lit("first"), F.slice(w, F.lit(1), b))),
        F.when(~odd, F.xxhash64(F.lit("last"), F.slice(w, n - b + 1, b))),
    ]


def _keyed(docs: DataFrame, min_words: int) -> DataFrame:
    words = _lines(docs).withColumn("w", F.split("line", " "))
    long_ = F.size("w") >= min_words
    return words.select(
        "doc_id",
        "line_no",
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(7), "line").alias("h2"),
        *[F.when(long_, half).alias(f"k{i}") for i, half in enumerate(_halves(F.col("w")))],
    )


@given_back
def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, v, n, place) of rows (h1, word hashes): the line itself at place -1, each deletion at its place, n words left."""
    base = 0x9E3779B97F4A7C15
    powers = np.ones(1, np.uint64)
    inverse = np.uint64(pow(base, -1, 1 << 64))
    for batch in batches:
        ids = np.asarray(batch.column(0))
        at = batch.column(1).offsets.to_numpy()
        values = batch.column(1).values.to_numpy(zero_copy_only=False).view(np.uint64)
        out: list[tuple[np.ndarray, ...]] = []
        size = 0

        def ready(out):
            h, v, n, p = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(v.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(p.astype(np.int32))], ["h1", "v", "n", "place"])

        for r in range(len(ids)):
            w = values[at[r] : at[r + 1]]
            n = len(w)
            while len(powers) < n + 1:
                powers = np.concatenate((powers, powers * (np.uint64(pow(base, len(powers), 1 << 64)))))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * powers[:n], dtype=np.uint64)))
            gone = sums[:-1] + (sums[-1] - sums[1:]) * inverse
            out.append((np.full(n + 1, ids[r]), np.concatenate((sums[-1:], gone)), np.concatenate(([n], np.full(n, n - 1))), np.arange(-1, n)))
            size += n + 1
            if size > 200_000:
                yield ready(out)
                out, size = [], 0
        if out:
            yield ready(out)


def _cuts(n: int) -> tuple[list[int], int]:
    """Where the stretches of a line of n words start, bound(n) + 1 of them without overlap, and their length: the last one ends the line.

    Lengths go in steps, so that lines of almost the same length have stretches of the same.
    """
    k = bound(n)
    size = n // (k + 1)
    size -= size % (2 if size < 12 else 4)
    return [size * i for i in range(k)] + [n - size], size


def _places(m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, asks) of what a line of m words emits: its own stretches, and those that may be one of a partner of n <= m words."""
    own = {(at, _cuts(m)[1]) for at in _cuts(m)[0]}
    asked = set()
    for n in range(m, LONG_WORDS - 1, -1):
        k, d = bound(n), m - n
        if d > bound(m):
            break
        if d <= k:
            starts, size = _cuts(n)
            for i, at in enumerate(starts):
                for shift in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1):
                    if 0 <= at + shift <= m - size:
                        asked.add((at + shift, size))
    out = [(*x, False) for x in sorted(own)] + [(*x, True) for x in sorted(asked - own)]
    start, size, asks = zip(*out, strict=True)
    return np.array(start), np.array(size), np.array(asks)


@given_back
def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, asks, h1) of rows (h1, word hashes), for lines of LONG_WORDS words or more.

    A line that the task met not long ago emits nothing, so a line that millions of documents repeat doesn't reach the shuffle as often.
    """
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    powers, back = np.ones(1, np.uint64), np.ones(1, np.uint64)
    known: dict[int, tuple[np.ndarray, ...]] = {}
    seen: set[int] = set()
    out: list[tuple[np.ndarray, ...]] = []
    size = 0

    def ready() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["key", "asks", "h1"])

    for batch in batches:
        ids = batch.column(0).to_numpy()
        at = batch.column(1).offsets.to_numpy()
        values = batch.column(1).values.to_numpy(zero_copy_only=False).view(np.uint64)
        fresh = []
        for r, h in enumerate(ids.tolist()):
            if h not in seen:
                seen.add(h)
                fresh.append(r)
        if len(seen) > 300_000:
            seen.clear()
        rows = np.array(fresh, np.int64)
        sizes = np.diff(at)[rows]
        for n in np.unique(sizes).tolist():
            while len(powers) < n + 1:
                powers, back = (np.concatenate((x, x * np.uint64(pow(b, len(x), 1 << 64)))) for x, b in ((powers, base), (back, inverse)))
            if n not in known:
                if len(known) > 2000:
                    known.clear()
                known[n] = _places(n)
            start, length, asks = known[n]
            alike = rows[sizes == n]
            step = max(1, 200_000 // max(n, len(start)))
            for a in range(0, len(alike), step):
                some = alike[a : a + step]
                sums = np.zeros((len(some), n + 1), np.uint64)
                np.cumsum(values[at[some][:, None] + np.arange(n)] * powers[:n], axis=1, dtype=np.uint64, out=sums[:, 1:])
                key = (sums[:, start + length] - sums[:, start]) * back[start]
                out.append((key.reshape(-1).view(np.int64), np.tile(asks, len(some)), np.repeat(ids[some], len(start))))
                size += len(out[-1][0])
                if size > 200_000:
                    yield ready()
                    out, size = [], 0
    if out:
        yield ready()


@given_back
def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, asks, h1) in the order of key and asks those of keys that an own stretch and another line have.

    A key's rows pass one by one; only its first one, an own stretch if there is any, is kept until another line turns up. The rows that equal the first one
    are left out.
    """
    head: tuple[int, bool, int] | None = None
    told = False
    for batch in batches:
        key, asks, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if head is not None:
            key, asks, h = (np.concatenate((np.array([x], y.dtype), y)) for x, y in zip(head, (key, asks, h), strict=True))
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        run = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(key)]))))
        keep = ~asks[starts][run] & (h != h[starts][run])
        heads = np.zeros(len(starts), bool)
        heads[run[keep]] = True
        again = head is not None and told  # the head that was carried on is out already
        last = bool(heads[-1]) or (again and len(starts) == 1)
        keep[starts[heads]] = True
        if again:
            keep[0] = False
        head, told = (key[starts[-1]], asks[starts[-1]], h[starts[-1]]), last
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(asks[keep]), pa.array(h[keep])], ["key", "asks", "h1"])


def _size(line: str = "line") -> Column:
    """The number of words, single spaces between them, without splitting the line."""
    return F.octet_length(line) - F.octet_length(F.replace(F.col(line), F.lit(" "), F.lit(""))) + 1


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, h2, first, line, one) of the lines at `first` in wanted (first, one), each text once."""
    at = wanted.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_set("first.line_no").alias("wanted"), F.collect_set(F.when(F.col("one"), F.col("first.line_no"))).alias("ones"))
    found = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(at, "doc_id")
    texts = found.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"), "wanted", "ones").where(F.array_contains("wanted", F.col("line_no")))
    texts = texts.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.struct("doc_id", "line_no").alias("first"), "line", F.array_contains("ones", F.col("line_no")).alias("one"))
    return texts.dropDuplicates(["h1", "h2"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (first, before, …) of lines with `edits`, the distance, null beyond the bound."""
    names = pairs.columns

    @given_back
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column("line").to_pylist(), batch.column("earlier").to_pylist(), strict=True):
                if y is None:
                    found.append(None)
                    continue
                a, b = x.split(" "), y.split(" ")
                found.append(edits(a, b, bound(min(len(a), len(b)))))
            yield batch.select(names).append_column("edits", pa.array(found, pa.int32()))

    both = pairs.join(texts.select("first", "line", _size().alias("n")), "first").join(texts.select(F.col("first").alias("before"), F.col("line").alias("earlier"), _size().alias("b_n")), "before")
    most = F.floor(F.log2(F.least("n", "b_n") / 10)) + 1  # bound() from LONG_WORDS words on
    return both.select(*names, "line", F.when(F.abs(F.col("n") - F.col("b_n")) <= most, F.col("earlier")).alias("earlier")).mapInArrow(verify, StructType([*pairs.schema.fields, StructField("edits", IntegerType())]))


def _long_members(docs: DataFrame, types: DataFrame, min_words: int) -> DataFrame:
    """(key, own, h1, h2, first) of the distinct lines that share a stretch, where the bound is two edits or more."""
    words = _lines(docs).where(_size() >= max(LONG_WORDS, min_words))
    rows = words.select(F.xxhash64("line").alias("h1"), F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("w")).mapInArrow(segments, "key long, asks boolean, h1 long")
    met = rows.repartition("key").sortWithinPartitions("key", "asks").mapInArrow(meeting, "key long, asks boolean, h1 long")
    members = met.groupBy("key", "h1").agg(F.max(~F.col("asks")).alias("own")).join(types.select("h1", "h2", "first"), "h1")
    return materialize(members.select("key", "own", "h1", "h2", "first"), "long-members")


def _long_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(h1, h2, b_doc, b_line, edits) of members and earlier ones within their bound, the earliest among them."""
    # every member meets the earliest one that it may be a partner of; where that is one, no other of the key can be earlier
    heads = members.groupBy("key").agg(F.min("first").alias("any"), F.min(F.when(F.col("own"), F.col("first"))).alias("head"))
    asked = members.join(heads, "key").withColumn("before", F.when(F.col("own"), F.col("any")).otherwise(F.col("head"))).where(F.col("before") < F.col("first"))
    asked = asked.select("key", "own", "h1", "h2", "first", "before")
    checked = materialize(_verified(asked.select("h1", "h2", "first", "before").distinct(), texts), "long-heads")
    # what is left meets all earlier members of the key that could be better than what was found
    best = checked.where("edits IS NOT NULL").groupBy("h1", "h2").agg(F.min("before").alias("best"))
    open_ = asked.join(checked.where("edits IS NULL").select("h1", "h2", "before"), ["h1", "h2", "before"]).join(best, ["h1", "h2"], "left")
    others = members.select("key", F.col("own").alias("b_own"), F.col("first").alias("b"))
    more = open_.join(others, "key").where((F.col("b") < F.least("first", "best")) & (F.col("b") != F.col("before")) & (F.col("own") | F.col("b_own")))
    more = more.select("h1", "h2", "first", F.col("b").alias("before")).distinct().join(checked.select("h1", "h2", "before"), ["h1", "h2", "before"], "left_anti")
    found = checked.unionByName(_verified(more.select("h1", "h2", "first", "before"), texts)).where("edits IS NOT NULL")
    return found.select("h1", "h2", F.col("before.doc_id").alias("b_doc"), F.col("before.line_no").alias("b_line"), "edits")


def duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no, edits) of every line that repeats an earlier one.

    Lines are split at \\n and numbered from 0; their order is (doc_id, line_no). A line is listed if an earlier one equals it
    (edits 0), or, where both have at least min_words words (split at single spaces), lies within bound() words
    inserted, removed or replaced (edits: how many); kept_* is the earliest such line, an equal one first. An
    earlier line counts even if it is listed itself.

    Rows with a null id or text take no part. Blank lines are layout and never listed. Rows with the same id count
    as one document: a repeated row is no duplicate of itself, as its lines have the same place. Very long lines are compared
    whole. An empty table gives an empty result; other columns are ignored.
    """
    place = F.struct("doc_id", "line_no")
    types = _keyed(docs, min_words).groupBy("h1", "h2").agg(F.min(place).alias("first"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)])
    types = materialize(types, "line-types")
    lines = _lines(docs).select("doc_id", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    equal = lines.join(types.select("h1", "h2", "first"), ["h1", "h2"]).where(place != F.col("first"))
    equal = equal.select("doc_id", "line_no", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.line_no").alias("kept_line_no"), F.lit(0).alias("edits"), "h1", "h2")

    keys = types.select("h1", "first", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k")).where("k IS NOT NULL")
    shared = keys.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("k"))).where("n > 1").select("h1", "first").distinct()
    members = _long_members(docs, types, min_words)
    wanted = shared.select("first", F.lit(True).alias("one")).unionByName(members.select("first", F.lit(False).alias("one")).distinct())
    texts = materialize(_fetched(docs, wanted), "line-texts")

    hashed = texts.where(F.col("one") & (_size() >= min_words)).select("h1", F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("w"))
    rows = hashed.mapInArrow(variants, "h1 long, v long, n int, place int").withColumn("met", F.count(F.lit(1)).over(W.partitionBy("v", "n"))).where("met > 1")
    rows = materialize(rows.select("h1", "v", "n", "place").join(texts.select("h1", "h2", "first"), "h1"), "line-variants")
    replaced = rows.where("place >= 0").groupBy("v", "n", "place").agg(F.min("first").alias("before"), F.count(F.lit(1)).alias("met")).where("met > 1")
    pairs = rows.join(replaced, ["v", "n", "place"]).select("h1", "h2", "first", "before")
    sides = rows.groupBy("v", "n").agg(F.min(F.when(F.col("place") < 0, F.col("first"))).alias("whole"), F.min(F.when(F.col("place") >= 0, F.col("first"))).alias("cut")).where("whole IS NOT NULL AND cut IS NOT NULL")
    other = F.when(F.col("place") < 0, F.col("cut")).otherwise(F.col("whole"))
    pairs = pairs.unionByName(rows.join(sides, ["v", "n"]).select("h1", "h2", "first", other.alias("before")))
    pairs = pairs.where(F.col("before") < F.col("first")).distinct()

    @given_back
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within_one(a.split(" "), b.split(" ")) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1, 4, 5]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(texts.select("h1", "h2", "line"), ["h1", "h2"]).join(texts.select(F.col("first").alias("before"), F.col("line").alias("earlier")), "before")
    checked = both.select("h1", "h2", "line", "earlier", F.col("before.doc_id").alias("b_doc"), F.col("before.line_no").alias("b_line")).mapInArrow(verify, "h1 long, h2 long, b_doc long, b_line int")
    checked = checked.withColumn("edits", F.lit(1)).unionByName(_long_pairs(members, texts))
    near = checked.groupBy("h1", "h2").agg(F.min(F.struct("b_doc", "b_line", "edits")).alias("b")).select("h1", "h2", "b")
    heads = near.join(types.select("h1", "h2", "first"), ["h1", "h2"]).select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), F.col("b.b_doc").alias("kept_doc_id"), F.col("b.b_line").alias("kept_line_no"), F.col("b.edits").alias("edits")
    )
    return equal.drop("h1", "h2").unionByName(heads)


def drop_duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the lines that duplicate_lines() lists, and without documents that have lost every line that wasn't blank.

    All columns are kept; a column n_chars, if there is one, is set to the length of the new text. Rows that lose no line are unchanged, null texts among them.
    """
    gone = duplicate_lines(docs, min_words).groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_set("line_no")).alias("__gone"))
    joined = docs.join(gone, docs["doc_id"] == gone["__id"], "left").drop("__id")
    names, at = docs.columns, docs.columns.index("text")

    @given_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = batch.column(batch.num_columns - 1).to_pylist()
            texts, keep = batch.column(at).to_pylist(), []
            for k, numbers in enumerate(lost):
                keep.append(True)
                if numbers and texts[k] is not None:
                    barred = set(numbers)
                    texts[k] = "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in barred)
                    keep[-1] = bool(texts[k].strip())
            columns = [pa.array(texts, pa.string()) if c == at else batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    out = joined.mapInArrow(cut, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
