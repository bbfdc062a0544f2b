"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts, in Arrow batches.  The trees are fitted in numpy
on a bounded sample of labelled rows (``SAMPLE`` rows, the least hashes of doc_id, so any
run takes the same rows), flattened into arrays of one complete tree each, and traversed by
all rows of a batch at once.  Labels, language, source and doc_id are never features.

Null and empty texts have statistics of zero and a score like any other.  Repeated rows
are scored as rows; repeated labels count as often as they occur; null labels are left
out.  With no usable label, or only one class, every score is the share of label 1 (0.5
without any).  Extra columns are carried by ``classify``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.llm.common import small_batches, table

SAMPLE, TREES, DEPTH, BINS, RATE, LEAST = 20_000, 120, 4, 64, 0.12, 15.0
GROUPS = ["!?", "|", "#*$%&<>@", ".", ",;:", "0123456789", "\"'()[]{}", "/\\_=+-~^`"]
FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "non_ascii", "space", *(f"group_{i}" for i in range(len(GROUPS))),
    "distinct_words", "top_word", "short_words", "words_ending_odd", "words_no_letter", "distinct_lines", "line_words", "sentence_words", "distinct_pairs", "title_words", "upper_words",
]
_CLASS = np.full(256, -1)
for _i, _g in enumerate(GROUPS):
    _CLASS[list(_g.encode())] = _i
_ODD, _STOP = frozenset("#*$%&<>!|"), frozenset(".!?")


def statistics(text: str | None) -> list[float]:
    """The features of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    w = max(len(words), 1)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    groups = [count[_CLASS == i].sum() / n for i in range(len(GROUPS))]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), (n - count[[9, 10, 13, 32]].sum()) / w, count[65:91].sum() / n, count[97:123].sum() / n, count[128:].sum() / n, count[[9, 10, 13, 32]].sum() / n, *groups,
        len(seen) / w, max(seen.values(), default=0) / w, sum(k for x, k in seen.items() if len(x) <= 3) / w, sum(k for x, k in seen.items() if x[-1] in _ODD) / w,
        sum(k for x, k in seen.items() if not any(map(str.isalpha, x))) / w, len(set(lines)) / max(len(lines), 1), w / max(len(lines), 1), w / (1 + sum(k for x, k in seen.items() if x[-1] in _STOP)),
        len(set(zip(words, words[1:]))) / max(w - 1, 1), sum(k for x, k in seen.items() if x[0].isupper()) / w, sum(k for x, k in seen.items() if len(x) > 1 and x.isupper()) / w,
    ]


class Trees:
    """Complete trees of one depth, flattened: feature and threshold by inner node, value by leaf."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost the logistic loss; every split is the best over per-feature histograms."""
    share = y.mean() if len(y) else 0.5
    empty = Trees(float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))), np.zeros((0, 2**DEPTH - 1), int), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)))
    if not len(y) or not 0 < share < 1:
        return empty
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], 1)
    flat = binned + np.arange(m) * BINS
    raw, feature, threshold, value = np.full(n, empty.base), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        f, t = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, k = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (m * BINS) + flat).ravel()
            gs = np.bincount(at, np.repeat(g, m), k * m * BINS).reshape(k, m, BINS).cumsum(2)
            hs = np.bincount(at, np.repeat(h, m), k * m * BINS).reshape(k, m, BINS).cumsum(2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
            gain[(hs < LEAST / 4) | (ha - hs < LEAST / 4)] = 0
            best = gain.reshape(k, -1).argmax(1)
            for i, b in enumerate(best):
                j, c = divmod(int(b), BINS)
                if gain[i].ravel()[b] > 1e-9 and c < len(edges[j]):
                    f[first + i], t[first + i] = j, edges[j][c]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        leaf = node - (2**DEPTH - 1)
        v = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        raw += v[leaf]
        feature.append(f), threshold.append(t), value.append(v)
    return Trees(empty.base, np.array(feature), np.array(threshold), np.array(value))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(x.as_py()) for x in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled documents; that many ids are broadcast, that many
    rows of statistics at most, however often an id occurs, come to the driver."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("y").cast("double"))
    got = rows.select("y", "text").mapInArrow(_features, "y double, x array<double>")
    got = got.orderBy(F.xxhash64("x", "y"), "x", "y").limit(sample).toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    got["key"] = got["x"].map(tuple)
    got = got.sort_values(["key", "y"], kind="stable")  # whatever order the tasks ended in
    return fit(np.array(got["x"].tolist()), (got["y"].to_numpy() > 0.5).astype(float))


def classify(docs: DataFrame, trees: Trees, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as ``column``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trees)  # TREES * 2**DEPTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column("text")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(x), pa.float64())], [*b.schema.names, column])

    names = [c for c in docs.columns if c != column]
    schema = docs.select(*names).schema.add(column, "double")
    return docs.select(*names).mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    trees = train(docs, table(spark, sf_dir, "labels").where(part != 1))
    # Only the columns of the result leave the Python workers with the texts.
    out = classify(docs, trees)
    return out.select("doc_id", (part == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
