"""Language-model scoring by a gated recurrent network with class-factored output.

Tokens: words of the A-Z-lower-cased text, then one end.  Counts are over all training
documents.  The network's vocabulary is the ``VOCABULARY - 2`` commonest words, the end and
"other"; an other word costs its class and then its add-one share among other words, so
every text has a proper probability.  Output: the word's class, then the word in its class,
two softmaxes of about the root of the vocabulary.

Training is truncated backpropagation in numpy (windows of ``WINDOW`` steps, state carried
across windows and reset at document starts) with Adam, in data-parallel rounds.  Round i
learns from the training documents whose hash falls in the i-th of ``ROUNDS`` slices, so that
each training document is seen once.  A round's documents are dealt by a second hash to
shards, one for about ``SHARD_TOKENS`` of all training tokens; each shard trains a copy, its
documents in the order of their ids, and the copies are averaged by tokens, as whole
numbers of 2**-SCALE, whose sum has no order.  So the model depends on the documents only,
not on their partitions or the number of executors.  Equal rows share a shard; a shard of
any size is read in chunks of ``CHUNK_TOKENS``.  Before training the output biases are the
counts' own shares.

Scoring runs whole documents through the network, many side by side in lanes, state
carried across windows.  Counts of the commonest words, about ``HOT``, are broadcast; the
counts of all other words are joined.

Null and empty texts are one end.  Repeated rows count and are scored as rows.  An empty
training set: N and V are 0 and the network keeps its first weights.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.llm.common import discard, small_batches, table, written

CLASSES, WIDTH, HIDDEN, WINDOW, LANES = 32, 32, 16, 32, 512
VOCABULARY = CLASSES * WIDTH
HOT, ROUNDS, RATE, CLIP = 65_536, 4, 0.01, 1.0
OTHER, END = 0, 1
CHUNK_TOKENS, FLUSH_WORDS = 3_000_000, 400_000
SHARD_TOKENS, SCALE = 1 << 21, 24
SHAPES = {"x": (VOCABULARY, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "w": (CLASSES, HIDDEN, WIDTH), "wb": (CLASSES, WIDTH)}
Model = dict[str, np.ndarray]


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()  # bytes: A-Z and ASCII white space only


def first_model(share: np.ndarray) -> Model:
    """Random recurrent weights, and output biases of the given shares of the vocabulary."""
    rng = np.random.default_rng(11)
    m = {k: (rng.standard_normal(s) * (0.3 if k in "xu" else 0.02)).astype(np.float32) for k, s in SHAPES.items()}
    p = share.reshape(CLASSES, WIDTH) + 1e-9
    m["cb"], m["wb"] = np.log(p.sum(1) / p.sum()).astype(np.float32), np.log(p / p.sum(1, keepdims=True)).astype(np.float32)
    return m


def _steps(m: Model, xs: np.ndarray, reset: np.ndarray, h: np.ndarray, keep: bool):
    """The states after each step of a window (time, lane), and what going back needs."""
    shape = (len(xs), xs.shape[1], HIDDEN)
    states, saved = np.empty(shape, np.float32), np.empty((5, *shape), np.float32) if keep else None
    for t, (ids, new) in enumerate(zip(xs, reset)):
        h = h * new[:, None]
        a, b = m["x"][ids], h @ m["u"]
        gates = a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN]
        np.negative(gates, gates)
        np.exp(gates, gates)
        gates += 1
        np.reciprocal(gates, gates)
        z, r, b = gates[:, :HIDDEN], gates[:, HIDDEN:], b[:, 2 * HIDDEN :]
        n = r * b
        n += a[:, 2 * HIDDEN :]
        np.tanh(n, n)
        if keep:
            for place, x in zip(saved, (h, z, r, n, b)):
                place[t] = x
        h = h - n
        h *= z
        h += n
        states[t] = h
    return states, h, saved


def _exp(s: np.ndarray) -> np.ndarray:
    """``exp`` of each row of scores up to one factor a row, which ``s`` loses too."""
    if s.max(initial=0) > 60:
        s -= s.max(1, keepdims=True)
    return np.exp(s)


def _output(m: Model, h: np.ndarray, y: np.ndarray, grads: Model | None):
    """Log probability of each target under its state; with grads, their gradients too."""
    cls = (y // WIDTH).astype(np.uint8)
    order = np.argsort(cls, kind="stable")  # a class's targets side by side
    cls, word, h = cls[order], (y % WIDTH)[order], h[order]
    at = np.arange(len(y))
    s = h @ m["c"]
    s += m["cb"]
    e = _exp(s)
    total = e.sum(1)
    logp = s[at, cls] - np.log(total)
    back = None
    if grads is not None:
        e /= total[:, None]
        e[at, cls] -= 1
        grads["c"], grads["cb"], back = h.T @ e, e.sum(0), e @ m["c"].T
    ends = np.cumsum(np.bincount(cls, minlength=CLASSES))
    for i, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        if lo == hi:
            continue
        own = at[: hi - lo], word[lo:hi]
        s = h[lo:hi] @ m["w"][i]
        s += m["wb"][i]
        e = _exp(s)
        total = e.sum(1)
        logp[lo:hi] += s[own] - np.log(total)
        if grads is not None:
            e /= total[:, None]
            e[own] -= 1
            grads["w"][i], grads["wb"][i] = h[lo:hi].T @ e, e.sum(0)
            back[lo:hi] += e @ m["w"][i].T
    out = np.empty_like(logp)
    out[order] = logp
    if back is not None:
        given = np.empty_like(back)
        given[order] = back
        back = given
    return out, back


def _backward(m: Model, xs, saved, back, reset, grads: Model) -> None:
    h, z, r, n, b = saved
    gates, inner = np.empty((*xs.shape, 3 * HIDDEN), np.float32), np.empty((*xs.shape, 3 * HIDDEN), np.float32)
    # What a step's gradient is multiplied by, for the whole window.
    into_n = (1 - z) * (1 - n * n)
    into_z, into_r = (h - n) * z * (1 - z), into_n * b * r * (1 - r)
    turned, carry = np.ascontiguousarray(m["u"].T), np.zeros_like(back[0])
    for t in range(len(xs) - 1, -1, -1):
        d = back[t]
        d += carry
        g, gu = gates[t], inner[t]
        np.multiply(d, into_z[t], g[:, :HIDDEN])
        np.multiply(d, into_r[t], g[:, HIDDEN : 2 * HIDDEN])
        np.multiply(d, into_n[t], g[:, 2 * HIDDEN :])
        gu[:, : 2 * HIDDEN] = g[:, : 2 * HIDDEN]
        np.multiply(g[:, 2 * HIDDEN :], r[t], gu[:, 2 * HIDDEN :])
        carry = gu @ turned
        d *= z[t]
        carry += d
        carry *= reset[t][:, None]
    grads["u"] += h.reshape(-1, HIDDEN).T @ inner.reshape(-1, 3 * HIDDEN)
    flat, ids = gates.reshape(-1, 3 * HIDDEN), xs.ravel().astype(np.int16)
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
    grads["x"][ids[order[first]]] = np.add.reduceat(flat[order], first, 0)


def lanes(docs: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents' tokens side by side, (time, lane), and whose they are; -1 where none.
    Longest documents first, each to the shortest lane; lanes in order of falling length."""
    k = max(1, min(most, len(docs)))
    heap = [(0, i) for i in range(k)]
    own: list[list[int]] = [[] for _ in range(k)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        n, i = heapq.heappop(heap)
        own[i].append(d)
        heapq.heappush(heap, (n + len(docs[d]), i))
    own = [own[i] for n, i in sorted(heap, reverse=True)]
    height = max(sum(len(docs[d]) for d in x) for x in own)
    y, whose = np.full((height, k), -1, np.int16), np.full((height, k), -1, np.int32)
    for i, x in enumerate(own):
        got = np.concatenate([docs[d] for d in x])
        y[: len(got), i] = got
        whose[: len(got), i] = np.repeat(x, [len(docs[d]) for d in x])
    return y, whose


def _windows(y: np.ndarray):
    """Per window: targets, inputs (the token before; END at the start), and 0 at starts."""
    live = (y >= 0).sum(0)
    for t in range(0, len(y), WINDOW):
        n = int((live > t).sum())
        part = y[t : t + WINDOW, :n]
        before = np.concatenate([y[t - 1 : t, :n] if t else np.full((1, n), END, y.dtype), part[:-1]])
        yield t, n, part, np.where(before < 0, END, before).astype(np.int64), (before != END).astype(np.float32)


def score_documents(m: Model, docs: list[np.ndarray], most: int = LANES) -> np.ndarray:
    """Natural-log probability of each whole document's tokens."""
    y, whose = lanes(docs, most)
    out, h = np.zeros(len(docs)), np.zeros((y.shape[1], HIDDEN), np.float32)
    for t, n, part, before, reset in _windows(y):
        states, h, _ = _steps(m, before, reset, h[:n], False)
        ok = part >= 0
        logp, _ = _output(m, states[ok], part[ok].astype(np.int64), None)
        out += np.bincount(whose[t : t + WINDOW, :n][ok], logp, len(docs))
    return out


def train_documents(m: Model, docs: list[np.ndarray]) -> tuple[Model, int]:
    """One pass of truncated backpropagation over documents; the model and its tokens."""
    tokens = sum(map(len, docs))
    m = {k: v.copy() for k, v in m.items()}
    if not tokens:
        return m, 0
    y, _ = lanes(docs, int(np.clip(tokens // (WINDOW * 64), 8, 256)))
    h = np.zeros((y.shape[1], HIDDEN), np.float32)
    first, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for _, n, part, before, reset in _windows(y):
        states, h, saved = _steps(m, before, reset, h[:n], True)
        ok = part >= 0
        grads = {k: np.zeros_like(v) for k, v in m.items()}
        _, d = _output(m, states[ok], part[ok].astype(np.int64), grads)
        back = np.zeros_like(states)
        back[ok] = d
        _backward(m, before, saved, back, reset, grads)
        step += 1
        count = ok.sum()
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / count
        scale = float(min(1.0, CLIP / max(norm, 1e-9)) / count)
        for k, g in grads.items():
            g = g * scale
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            m[k] -= (RATE / (1 + step / 400)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)
    return m, tokens


def _vector(m: Model) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in SHAPES])


def _model(v: np.ndarray) -> Model:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _ids(vocabulary: dict[bytes, int], w: list[bytes]) -> np.ndarray:
    out = np.empty(len(w) + 1, np.int16)
    out[:-1] = np.fromiter(map(vocabulary.get, w, repeat(OTHER)), np.int16, len(w))
    out[-1] = END
    return out


def count_words(raw: DataFrame) -> DataFrame:
    """``(word, c)`` over all rows; the end is the empty word.  Counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for x in b.column("raw").to_pylist():
                seen.update(words_of(x))
            seen[b""] += b.num_rows
            if len(seen) > FLUSH_WORDS:
                yield out()
                seen = Counter()
        if seen:
            yield out()

    return raw.select("raw").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> list:
    """The rows of about the ``most`` commonest words, by falling count, then by the word.

    A histogram of 8 steps an octave, at most 512 numbers, gives the steps that are taken
    whole.  Of the first that doesn't fit, a hash of the word takes as many as are wanted,
    give or take their root, so that a step of any number of words fills the rest.
    """
    step, total = F.floor(F.log2("c") * 8), 0
    sizes = dict(counts.groupBy(step.alias("s")).agg(F.count("*")).collect())
    for s in sorted(sizes, reverse=True):
        share = min(1.0, (most - total) / sizes[s])
        if (total := total + sizes[s]) >= most:
            break
    if not sizes:
        return []
    # One comparison with the count's own bound for nearly all rows; s and share are the last step's.
    below, above = (ceil(2 ** (x / 8) * (1 - 1e-9)) for x in (s, s + 1))
    part = F.shiftrightunsigned(F.xxhash64("word"), 2) <= F.lit(int(share * (1 << 62)))
    wanted = (F.col("c") >= below) & ((F.col("c") >= above) | part)
    return sorted(counts.where(wanted).collect(), key=lambda r: (-r.c, bytes(r.word)))


def train(raw: DataFrame, vocabulary: dict[bytes, int], share: np.ndarray, tokens: int) -> Model:
    """Rounds of data-parallel passes over ``raw(doc_id, raw)`` of so many tokens, averaged by tokens."""
    spark, model = raw.sparkSession, first_model(share)
    words = spark.sparkContext.broadcast(vocabulary)  # VOCABULARY words
    shards = max(1, ceil(tokens / ROUNDS / SHARD_TOKENS))

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [_ids(words.value, words_of(x)).tobytes() for x in b.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.binary())], [*b.schema.names[:-1], "ids"])

    dealt = F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "raw"), F.lit(shards)).cast("int")
    keyed = raw.select(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).alias("round"), dealt.alias("shard"), "doc_id", "raw")
    # Two bytes a token from here on: no text is shuffled, and none is read again for each round.
    ids = written(keyed.mapInArrow(tokens_of, "round long, shard int, doc_id long, ids binary"), "lm-ids")
    for i in range(ROUNDS):
        start = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            m, total, docs, size = start.value, 0, [], 0
            for b in batches:
                for x in b.column("ids").to_pylist():
                    docs.append(np.frombuffer(x, np.int16))
                    size += len(docs[-1])
                    if size > CHUNK_TOKENS:
                        m, n = train_documents(m, docs)
                        total, docs, size = total + n, [], 0
            m, n = train_documents(m, docs)
            if total := total + n:
                whole = np.rint(_vector(m).astype(np.float64) * (1 << SCALE)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([whole], pa.list_(pa.int64())), pa.array([total], pa.int64())], ["v", "n"])

        part = ids.where(F.col("round") == i).repartitionById(shards, "shard").sortWithinPartitions("doc_id", F.xxhash64("ids")).select("ids")
        sums = part.mapInArrow(run, "v array<long>, n long")
        exact = F.sum(F.col("v").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).cast("double")
        got = sums.select("n", F.posexplode("v").alias("i", "v")).groupBy("i").agg((exact / F.sum("n")).alias("v")).toPandas()
        if len(got):  # as many numbers as the model has
            model = _model(got.sort_values("i")["v"].to_numpy() / (1 << SCALE))
    discard(ids)
    return model


def score(docs: DataFrame, training: Column) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("raw"), training.alias("training"))
    counts = written(count_words(raw.where("training")), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = commonest(counts, HOT)
    vocabulary, share = {}, np.zeros(VOCABULARY)
    for w, c in ((bytes(r.word), r.c) for r in hot):
        if w == b"":
            share[END] = c
        elif len(vocabulary) < VOCABULARY - 2:
            share[len(vocabulary) + 2] = c
            vocabulary[w] = len(vocabulary) + 2
    end = counts.where(F.octet_length("word") == 0).select("c").first()
    share[END] = end.c if end else 0
    n_other = n - share.sum()
    share[OTHER] = n_other
    v_other = v - len(vocabulary) - 1
    model = train(raw.where("training"), vocabulary, share + 0.5, int(n))
    floor, other_floor = np.log10(n + v + 1), np.log10(max(n_other, 0) + max(v_other, 0) + 1)
    end_base = np.log10(share[END] + 1)
    sent = spark.sparkContext.broadcast((model, vocabulary, {bytes(r.word): r.c for r in hot}))
    end_known = int(share[END] > 0)
    names = ["uid", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "times"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, vocabulary, hot = sent.value
        logs = {w: float(np.log10(c + 1)) for w, c in hot.items()}
        uid = TaskContext.get().partitionId() << 40
        ids, rows, size = [], [], 0

        def out():
            nonlocal uid
            got = score_documents(m, ids) / np.log(10)
            for i, (r, s) in enumerate(zip(rows, got.tolist())):
                rows[i] = (uid + i, *r[:4], r[4] + s, *r[5:])
            uid += len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("raw").to_pylist()):
                words = words_of(x)
                seen = Counter(words)
                known, base, other, others, rare = end_known, end_base, 0.0, 0, {}
                for w, k in seen.items():
                    if (g := logs.get(w)) is None:
                        rare[w] = k
                        others += k
                    else:
                        known += k
                        base += k * g
                        if w not in vocabulary:
                            other += k * g
                            others += k
                ids.append(_ids(vocabulary, words))
                t = len(ids[-1])
                rows.append((d, t, known, base - t * floor, other - others * other_floor, list(rare), list(rare.values())))
                size += t
                if size > CHUNK_TOKENS:
                    yield out()
                    ids, rows, size = [], [], 0
        if rows:
            yield out()

    made = raw.select("doc_id", "raw").mapInArrow(run, "uid long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<binary>, times array<int>")
    made = written(made, "lm-scored")
    rare = made.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word").groupBy("uid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("add")).withColumnRenamed("uid", "of")
    both = made.drop("rare", "times").join(found, F.col("uid") == F.col("of"), "left")
    add = F.coalesce("add", F.lit(0.0))
    return both.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("score") + add).alias("score"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), part != 2)
    return out.select("doc_id", (part == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


SQL: dict[str, str] = {}
