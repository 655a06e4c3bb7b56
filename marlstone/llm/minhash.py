"""MinHash near-deduplication by a multi-index Hamming join.

A signature is `perms` minima of permuted shingle hashes, b bits of each. The distance of two
signatures is the number of places where they differ; a place agrees with probability about
the Jaccard similarity of the documents. Signatures are cut into chunks. By pigeonhole, two
signatures at distance r or less agree in some chunk up to that chunk's allowed errors; each
signature emits one key for every chunk and every choice of the places that may err, made of the
other places, so such a pair shares a key. Every pair within r thus meets; none is missed.

A set of documents with one signature is one node. The members of a key's bucket are linked
through pivots: those within r of a pivot are its star, and every member outside the largest star is compared with all. What
is left out are only pairs whose two ends are linked already, so components are those of all
pairs, at a cost linear in the bucket for each member outside the largest star.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.memory import given_back
from marlstone.session import materialize

PERMS, RADIUS, CHUNKS = 64, 24, 13
SEED = 20240229


def _rows(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and row bounds of a list array without null rows."""
    bounds = array.offsets.to_numpy()
    return array.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0]


def minima(hashes: np.ndarray, bounds: np.ndarray, perms: int) -> np.ndarray:
    """Signatures (rows x perms, uint16) of documents given as flat word hashes; each must have a word."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 31, perms, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, perms, dtype=np.uint32)
    h = hashes.view(np.uint64)
    pair = h * np.uint64(0x9E3779B97F4A7C15)
    pair[:-1] += h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pair ^= pair >> np.uint64(31)
    pair *= np.uint64(0xBF58476D1CE4E5B9)
    shingle = (pair >> np.uint64(32)).astype(np.uint32)
    last = bounds[1:] - 1
    lone = np.diff(bounds) == 1
    keep = np.ones(len(h), bool)
    keep[last[~lone]] = False
    alone = h[last[lone]] * np.uint64(0x9E3779B97F4A7C15)
    shingle[last[lone]] = ((alone ^ (alone >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
    shingle = shingle[keep]
    starts = np.concatenate(([0], np.cumsum(np.where(lone, 1, np.diff(bounds) - 1))[:-1]))
    out = np.empty((len(last), perms), np.uint16)
    for k in range(perms):
        low = np.minimum.reduceat(shingle * a[k] + b[k], starts).astype(np.uint64)
        low = (low ^ (low >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = (low >> np.uint64(48)).astype(np.uint16)
    return out


def signatures(docs: DataFrame, perms: int = PERMS) -> DataFrame:
    """(doc_id, sig): sig is 2 * perms bytes. Shingles are pairs of lower-cased words of letters and digits; a lone word is its own."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    hashed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.transform(words, lambda w: F.xxhash64(w)).alias("h"))

    @given_back
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = np.asarray(batch.column(1).value_lengths()) > 0
            if not full.any():
                continue
            batch = batch.filter(pa.array(full))
            values, bounds = _rows(batch.column(1))
            sig = minima(np.array(values), bounds, perms)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "sig"])

    return hashed.mapInArrow(sign, "doc_id long, sig binary")


def chunk_plan(perms: int, radius: int, chunks: int) -> list[list[int]]:
    """The places of each key: for every chunk and every choice of places that may err, the others."""
    bounds = np.linspace(0, perms, chunks + 1).round().astype(int)
    errors, more = divmod(radius, chunks)
    keys = []
    for c in range(chunks):
        allowed = errors if c <= more else errors - 1
        places = list(range(bounds[c], bounds[c + 1]))
        if allowed < 0:
            continue
        if allowed >= len(places):
            raise ValueError("a chunk may not err in all of its places; use fewer chunks or a smaller radius")
        keys += [[p for p in places if p not in gone] for gone in combinations(places, allowed)]
    return keys


def chunk_keys(nodes: DataFrame, perms: int = PERMS, radius: int = RADIUS, chunks: int = CHUNKS) -> DataFrame:
    """(key, node) of nodes (node, sig)."""
    plan = chunk_plan(perms, radius, chunks)

    @given_back
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, perms).astype(np.uint64)
                node = np.asarray(batch.column(0))
                keys = np.empty((len(plan), len(node)), np.uint64)
                for k, places in enumerate(plan):
                    h = np.full(len(node), (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
                    for p in places:
                        h = (h ^ sig[:, p]) * np.uint64(0xD6E8FEB86659FD93)
                        h ^= h >> np.uint64(32)
                    keys[k] = h
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(node, len(plan)))], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(emit, "key long, node long")


def link(sig: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (i, j) of rows within the radius that connect what all such pairs connect."""
    n, links = len(sig), []
    star = np.full(n, -1)
    for p in range(n):
        if star[p] < 0:
            near = np.flatnonzero((sig != sig[p]).sum(1) <= radius)
            links += [(p, int(i)) for i in near if i != p]
            star[near[star[near] < 0]] = p
    # two stars may be linked through rows of which neither is a pivot; one of the two is outside the largest star
    sizes = np.bincount(star, minlength=n)
    for z in np.flatnonzero(star != sizes.argmax()):
        if star[z] != z:
            links += [(int(z), int(i)) for i in np.flatnonzero((sig != sig[z]).sum(1) <= radius) if star[i] != star[z]]
    return links


def _pairs(batches: Iterator[pa.RecordBatch], perms: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, node, sig) sorted by key; a key's rows may go on in the next batch."""
    key, node, sig = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, perms), np.uint16)

    def flush(key, node, sig):
        if len(key) < 2:
            return None
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        u, v = [], []
        two = starts[sizes == 2]
        near = two[(sig[two] != sig[two + 1]).sum(1) <= radius]
        u.append(node[near])
        v.append(node[near + 1])
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            found = link(sig[s : s + n], radius)
            if found:
                i, j = np.array(found).T
                u.append(node[s + i])
                v.append(node[s + j])
        u, v = np.concatenate(u), np.concatenate(v)
        pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate((key, np.asarray(batch.column(0))))
        node = np.concatenate((node, np.asarray(batch.column(1))))
        sig = np.concatenate((sig, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, perms)))
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if cut:
            if (out := flush(key[:cut], node[:cut], sig[:cut])) is not None:
                yield out
            key, node, sig = key[cut:], node[cut:], sig[cut:]
    if (out := flush(key, node, sig)) is not None:
        yield out


def near_edges(nodes: DataFrame, perms: int = PERMS, radius: int = RADIUS, chunks: int = CHUNKS) -> DataFrame:
    """Edges (u, v) between nodes (node, sig) within the radius, enough to connect all such pairs."""
    keys = chunk_keys(nodes, perms, radius, chunks)
    met = keys.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key"))).where("n > 1").select("key", "node")
    rows = met.join(nodes.select("node", "sig"), "node").select("key", "node", "sig")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(given_back(lambda batches: _pairs(batches, perms, radius)), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, perms: int = PERMS, radius: int = RADIUS, chunks: int = CHUNKS) -> DataFrame:
    """(doc_id, keep_id) of every document that has a near copy with a smaller id.

    Groups are the connected components of all pairs of signatures at most `radius` places apart;
    keep_id is the smallest id of the group, which stays.

    Rows with a null id or text, and texts without letters or digits, are in no group. Rows with one id count as one
    document: two texts under one id join their groups. Equal texts have equal signatures
    and are in one group, however many. Texts of one word have that word as their shingle; very long
    texts are read whole. An empty table gives an empty result. Other columns are ignored.
    """
    signed = materialize(signatures(docs, perms), "signatures")
    nodes = signed.groupBy("sig").agg(F.min("doc_id").alias("node"))
    same = signed.join(nodes, "sig").where("doc_id <> node").select(F.col("node").alias("u"), F.col("doc_id").alias("v"))
    edges = near_edges(materialize(nodes, "nodes"), perms, radius, chunks)
    between = materialize(components(edges), "components")
    alone = same.select(F.col("v").alias("doc_id"), F.col("u").alias("node"))
    copies = alone.join(between, "node", "left").select("doc_id", F.coalesce("label", "node").alias("keep_id"))
    heads = between.select(F.col("node").alias("doc_id"), F.col("label").alias("keep_id"))
    return copies.union(heads).where("doc_id <> keep_id").groupBy("doc_id").agg(F.min("keep_id").alias("keep_id"))


def drop_near_duplicates(docs: DataFrame, perms: int = PERMS, radius: int = RADIUS, chunks: int = CHUNKS) -> DataFrame:
    """The rows of docs without those that near_duplicates() lists; all columns as they are."""
    gone = near_duplicates(docs, perms, radius, chunks).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


