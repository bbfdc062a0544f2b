"""The registered queries op1, op2 and op5 on the whole smallest table, against brute force."""

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from hostwatch.llm import common, line_dedup, quality, repetition
from tests.llm.test_operators import SMALL


def table(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select(*columns).collect()]


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def exact_lines(rows):
    """The places that go, by counts of shared shingles over all lines' full sets."""
    n, sets, holders, comp = line_dedup.SHINGLE, {}, {}, {}
    lines = sorted((d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip(line_dedup.BLANK))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for x in sorted({x for _, _, x in lines}):
        u = x.encode("utf-16-be")
        mine = {u[2 * i : 2 * (i + n)] for i in range(len(u) // 2 - n + 1)}
        sets[x], comp[x] = len(mine), x
        for y, k in Counter(y for s in mine for y in holders.setdefault(s, [])).items():
            if 100 * k >= 80 * (len(mine) + sets[y] - k):
                a, b = sorted((find(x), find(y)))
                comp[b] = a
        for s in mine:
            holders[s].append(x)
    seen, gone = set(), set()
    for d, i, x in lines:
        if find(x) in seen:
            gone.add((d, i))
        seen.add(find(x))
    return gone


def test_op1_query(spark):
    rows = table(spark, "documents", "doc_id", "text")
    gone = exact_lines(rows)
    want = []
    for d, t in rows:
        lines = t.split("\n") if t else []
        kept = "\n".join(x for i, x in enumerate(lines) if (d, i) not in gone)
        want.append((d, len(lines), sum((d, i) in gone for i in range(len(lines))), sha(kept)))
    got = line_dedup.op1_line_dedup(spark, SMALL)
    assert got.columns == ["doc_id", "n_lines", "n_removed", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and gone


def test_line_dedup_leaves_nothing_but_its_result(spark):
    root = common.shared_dir(spark).removeprefix("file://")
    os.makedirs(root, exist_ok=True)
    stood = set(os.listdir(root))
    docs = spark.createDataFrame([(i, f"one line that is long enough, {'a' * (i % 3)}\nand line {i} of its own") for i in range(60)], "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    out = line_dedup.dedup_lines(docs)
    assert out.where("n_removed > 0").count() > 50
    left = {f.rsplit("-", 1)[0] for f in set(os.listdir(root)) - stood}
    assert "line-gone" in left and not left & {"line-minima", "line-buckets", "line-scores", "line-links", "line-rest", "line-places", "line-firsts", "line-elements", "line-mixed", "prefixes"}
    assert {t.name for t in spark.catalog.listTables()} == before


def brute_rules(text):
    w = (text or "").encode().split()
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    # Repeats by their places: word i goes on a repeat of k words if its k words stand elsewhere too.
    k, covered, longest = repetition.MIN_WORDS, set(), 0
    while True:
        seen = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        at = [i for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1]
        if not at:
            break
        covered |= {j for i in at for j in range(i, i + k)}
        longest, k = k, k + 1
    chars = sum(len(x.decode()) for x in w)
    share = sum(len(w[j].decode()) for j in covered) / max(chars, 1)
    kept = not failed and share <= repetition.MAX_COVERED and longest <= repetition.MAX_LONGEST
    return len(w), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed, kept, pytest.approx(share), longest


def test_op5_query(spark):
    texts = dict(table(spark, "documents", "doc_id", "text"))
    got = repetition.op5_quality_rules(spark, SMALL)
    assert got.columns == ["doc_id", *repetition.COLUMNS]
    out = got.collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        assert tuple(r)[1:10] == brute_rules(texts[r.doc_id]), r.doc_id


def test_op2_query(spark):
    texts = dict(table(spark, "documents", "doc_id", "text"))
    labels = [(d, y) for d, y in table(spark, "labels", "doc_id", "quality") if d in texts and y is not None]
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in texts}
    learned = sorted((tuple(quality.statistics(texts[d])), y) for d, y in labels if not held[d])
    trees = quality.fit(np.array([x for x, _ in learned]), np.array([y > 0.5 for _, y in learned], float))
    out = quality.op2_quality(spark, SMALL).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        (score,) = trees.score(np.array([quality.statistics(texts[r.doc_id])]))
        assert (r.held_out, r.predicted) == (held[r.doc_id], int(r.score >= 0.5)) and r.score == pytest.approx(score)


def test_labels_repeated_often_stay_bounded(spark):
    # A labelled id with many rows of documents: at most `sample` of them reach the driver.
    docs = spark.range(3000).selectExpr("id % 2 AS doc_id", "concat('text of row ', id) AS text")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    sizes = []

    def fit(x, y):
        sizes.append(len(x))
        return quality_fit(x, y)

    quality_fit, quality.fit = quality.fit, fit
    try:
        quality.train(docs, labels, sample=50)
    finally:
        quality.fit = quality_fit
    assert sizes == [50]
