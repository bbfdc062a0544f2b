"""Quality rules: repetition inside a document by suffix array, beside plain counts.

The suffix array is over words, built for a batch of documents at once by prefix doubling:
the first key is (document, word), so suffixes of two documents are never equal, and each
doubling sorts only suffixes not yet told apart.  Longest common prefixes of neighbours in
the suffix order come from the ranks of the doublings.  An interval of suffixes whose
common prefix can be extended neither to the right (all of the interval) nor to the left
(all have one word before) is a maximal repeated substring.  The union of their spans is
read off the neighbours: a suffix's longer neighbour prefix is the length of the longest
repeat that starts there.

The base rule counts words in repeated 8-word windows.  The method's verdict looks further:
rejected if maximal repeats of ``MIN_WORDS`` words or more cover more than ``MAX_COVERED`` of
the words' characters (which also catches texts of many short repeats), or the longest
repeat has more than ``MAX_LONGEST`` words (one long passage twice in a long text).

Null text: no words, symbols or lines.  Empty texts fail the base rules.  Repeated rows
are judged as rows.  Texts of any length are judged whole: a document is never split, and
one longer than a batch is a batch of its own.  Extra columns are carried by ``judge``;
those of the result's names are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.llm.common import fresh, small_batches, table

WINDOW, MIN_WORDS, MAX_COVERED, MAX_LONGEST, LEAST_WORDS = 8, 4, 0.3, 60, 20
SYMBOLS = b"#*$%&<>|"
BATCH_WORDS = 400_000
_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))


def suffix_order(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of concatenated documents in order, and the number of words that each
    has in common with the next (0 across documents)."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranks, step = [], 1
    order = np.lexsort((words, docs))
    new = np.ones(n, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (docs[order][1:] != docs[order][:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # where a suffix's group begins
    rank = np.empty(n, np.int64)
    rank[order] = start
    while True:
        ranks.append(rank)
        same = ~new
        same[:-1] |= ~new[1:]
        at = np.flatnonzero(same)  # places in the order that are not yet told apart
        if not len(at):
            break
        suffix = order[at]
        after = suffix + step
        there = after < n
        there[there] = docs[after[there]] == docs[suffix[there]]
        second = np.where(there, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.lexsort((suffix, second, start[at]))
        suffix, second, group = suffix[by], second[by], start[at]
        order[at] = suffix
        split = np.ones(len(at), bool)
        split[1:] = (second[1:] != second[:-1]) | (group[1:] != group[:-1])
        new, start = new.copy(), start.copy()
        new[at] = split
        start[at] = np.maximum.accumulate(np.where(split, at, 0))
        rank = rank.copy()
        rank[suffix] = start[at]
        step *= 2
        if step > n:
            break
    # Longest common prefixes of neighbours, by binary lifting over the ranks.
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    ends = np.searchsorted(docs, docs, side="right")
    near = np.flatnonzero(ranks[0][a] == ranks[0][b])
    a, b, da, db = a[near], b[near], ends[a[near]], ends[b[near]]
    got = np.zeros(len(near), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        w = 1 << k
        ok = (a + w <= da) & (b + w <= db)
        ok[ok] = ranks[k][a[ok]] == ranks[k][b[ok]]
        a, b, got = a + w * ok, b + w * ok, got + w * ok
    lcp[near] = got
    return order, lcp


def repeats(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each word the number of words of the longest substring that starts there and
    occurs elsewhere in its document (overlaps count)."""
    out = np.zeros(len(order), np.int64)
    if len(order):
        out[order[:-1]] = lcp
        out[order[1:]] = np.maximum(out[order[1:]], lcp)
    return out


def maximal_repeats(words: np.ndarray, docs: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """``(document, words, occurrences)`` of each maximal repeated substring of ``least``
    words or more: intervals of the longest common prefixes, by a stack."""
    before = np.where((order > 0) & (docs[order] == docs[order - 1]), words[order - 1], -1) if len(order) else order
    changes = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))])
    deep = np.flatnonzero(lcp >= least)
    for run in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1) if len(deep) else ():
        stack: list[tuple[int, int]] = []  # (common prefix, first suffix)
        lo, hi = int(run[0]), int(run[-1]) + 1
        for i, h in enumerate([*lcp[lo:hi].tolist(), 0], lo):
            first = i
            while stack and stack[-1][0] > h:
                size, first = stack.pop()
                if changes[i] > changes[first]:  # suffixes first..i: different words before them, or none
                    yield int(docs[order[first]]), size, i - first + 1
            if h and (not stack or stack[-1][0] < h):
                stack.append((h, first))


def _covered(length: np.ndarray) -> np.ndarray:
    """Which words the spans ``[i, i + length[i])`` cover."""
    n = len(length)
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(length)
    np.add.at(step, at, 1)
    np.add.at(step, at + length[at], -1)
    return step.cumsum()[:n] > 0


def _judged(texts: list[bytes | None]) -> list[tuple]:
    split = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    words = [x for w in split for x in w]
    ids = pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0, np.int64)
    docs = np.repeat(np.arange(len(texts)), sizes)
    chars = np.fromiter((len(x) if x.isascii() else len(x.translate(None, _CONTINUED)) for x in words), np.int64, len(words))
    order, lcp = suffix_order(ids, docs)
    length = repeats(order, lcp)
    window = _covered(np.where(length >= WINDOW, WINDOW, 0))
    span = _covered(np.where(length >= MIN_WORDS, length, 0))
    per = lambda x: np.bincount(docs, x, len(texts)).astype(np.int64)
    n_chars, n_window, n_span = per(chars), per(window), per(chars * span)
    longest, maximal = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for d, size, _ in maximal_repeats(ids, docs, order, lcp, MIN_WORDS):
        longest[d] = max(longest[d], size)
        maximal[d] += 1
    out = []
    for i, t in enumerate(texts):
        n, t = int(sizes[i]), t or b""
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        failed = n < LEAST_WORDS or 100 * n_window[i] > 30 * n
        share = n_span[i] / max(int(n_chars[i]), 1)
        kept = not failed and share <= MAX_COVERED and longest[i] <= MAX_LONGEST
        out.append((n, int(n_chars[i]), len(t.translate(None, _NOT_SYMBOL)), len(lines) - len(set(lines)), int(n_window[i]), bool(failed), bool(kept), float(share), int(longest[i]), int(maximal[i])))
    return out


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "repeat_share": "double", "longest_repeat": "long", "maximal_repeats": "long"}


def _judge(column: str):
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, part, size = [], [], 0
            for t in b.column(column).to_pylist():
                part.append(t)
                size += len(t or b"") // 5
                if size > BATCH_WORDS:
                    rows += _judged(part)
                    part, size = [], 0
            rows += _judged(part)
            rest = [(c, n) for c, n in zip(b.columns, b.schema.names) if n != column]
            made = [pa.array([r[i] for r in rows], kinds[k]) for i, k in enumerate(COLUMNS.values())]
            yield pa.RecordBatch.from_arrays([c for c, _ in rest] + made, [n for _, n in rest] + list(COLUMNS))

    return run


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of COLUMNS (columns of these names are replaced)."""
    small_batches(docs.sparkSession)
    rest = docs.drop(*COLUMNS)
    schema = rest.schema
    for name, kind in COLUMNS.items():
        schema = schema.add(name, kind)
    (raw,) = fresh(docs, "raw")
    return rest.withColumn(raw, F.col("text").cast("binary")).mapInArrow(_judge(raw), schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    small_batches(spark)
    return docs.mapInArrow(_judge("raw"), "doc_id long, " + ", ".join(f"{n} {k}" for n, k in COLUMNS.items()))


SQL: dict[str, str] = {}
