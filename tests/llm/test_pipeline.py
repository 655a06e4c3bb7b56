"""The corpus pipeline against a brute-force version in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict
from math import ceil, floor, sqrt

import numpy as np
import pytest
from test_operators_llm import brute_groups, brute_lines, toxic_rows

import corpus_pipeline
from marlstone.llm import minhash, mixing, segmentation, toxicity


def brute_mix(rows):
    """(position, id, epoch) of rows (id, source, text), sorted."""
    tokens = {i: ceil(len(t.encode()) / 4) for i, _, t in rows}
    held = defaultdict(int)
    for i, s, _ in rows:
        held[s] += tokens[i]
    total = sum(held.values())
    shares = []
    for _, power in mixing.CURRICULUM:
        whole = sum(h**power for h in held.values())
        shares.append({s: h**power / whole for s, h in held.items()})
    knots, out = [t for t, _ in mixing.CURRICULUM], []
    for s in held:
        p, c = [x[s] for x in shares], [0.0]
        for k in range(1, len(knots)):
            c.append(c[-1] + (p[k - 1] + p[k]) * (knots[k] - knots[k - 1]) / 2)
        upto = 0
        for _, i in sorted((hashlib.md5(f"17:{i}".encode()).hexdigest(), i) for i, x, _ in rows if x == s):
            mid = upto + tokens[i] / 2
            upto += tokens[i]
            for epoch in range(floor((total * c[-1] - mid) / held[s]) + 1 if mid <= total * c[-1] else 0):
                due = (mid + epoch * held[s]) / total
                k = next((k for k in range(len(knots) - 1) if due < c[k + 1]), len(knots) - 2)
                slope, rest = (p[k + 1] - p[k]) / (knots[k + 1] - knots[k]), max(due - c[k], 0)
                under = p[k] + sqrt(max(p[k] ** 2 + 2 * slope * rest, 0))
                out.append((round(knots[k] + min(2 * rest / under, knots[k + 1] - knots[k]), 6), i, epoch))
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(4), tmp_path_factory.mktemp("sf")
    made = toxic_rows(240, 9)
    texts = {i: "\n".join([" ".join(t.split()[:60]), "the footer of each page, which repeats word by word here", " ".join(t.split()[60:])]) for i, t, _ in made}
    for i in range(200, 240):  # near copies
        words = texts[rng.randrange(1, 200)].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts[i] = " ".join(words)
    rows = [(i, t, "en", f"s{i % 3 if i % 2 else 0}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in made if i < 200], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}", rows, {i: y for i, _, y in made if i < 200}


def test_pipeline(spark, corpus):
    folder, rows, labels = corpus
    md5 = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    texts = {i: t for i, t, *_ in rows}
    model = toxicity.fit([(texts[i], labels[i]) for i in sorted(labels, key=md5)])
    kept = {i: t for i, t in texts.items() if not toxicity.judge(model, [t])[1][0]}
    assert 0 < len(kept) < len(texts)

    gone = defaultdict(set)
    for i, k in brute_lines(list(kept.items())):
        gone[i].add(k)
    cut = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in kept.items()}
    cut = {i: t for i, t in cut.items() if not gone[i] or t.strip()}
    assert sum(map(len, gone.values())) >= len(kept) - 1

    signed = minhash.signatures(spark.createDataFrame(list(cut.items()), "doc_id long, text string")).collect()
    near = brute_groups([r.doc_id for r in signed], [np.frombuffer(r.sig, np.uint16) for r in signed], minhash.RADIUS)
    left = {i: t for i, t in cut.items() if i not in near}

    source = {i: s for i, _, _, s, _ in rows}
    order = [i for _, i, _ in brute_mix([(i, source[i], t) for i, t in left.items()])]

    with open(segmentation.MODEL, "rb") as f:
        lattice = segmentation.Lattice(segmentation.Vocabulary(f.read()), segmentation.SMOOTHING)
    want = Counter()
    for i in order:
        for k, (pieces, _, _) in enumerate(segmentation.search(lattice, [segmentation.units(left[i])], [str(i)], segmentation.SAMPLES, segmentation.SEED)[0]):
            want[i, k + 1, tuple(pieces.tolist())] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.sample, tuple(r.pieces)) for r in got) == want


def test_stages_keep_the_columns(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
