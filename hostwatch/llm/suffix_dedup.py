"""Suffix-array dedup: remove repeated byte strings of ``length`` bytes or more.

A longest-previous-factor array says for each position how long a string starting there
also starts at an earlier one; it is read off the neighbours with smaller position in
suffix order.  Here only "at least ``length``" matters, so the suffix order is built to
that depth, and positions that are already unique leave it at each doubling.  In a class of
equal prefixes the previous smaller position of a suffix is its predecessor, the next one
its successor: with ``keep="first"`` those with a predecessor go (the first copy stays),
with ``keep="none"`` all that have either.

Over the corpus, positions are dealt out by content.  Among the 48-byte grams of the
``length`` bytes from a position, the one of least hash is its anchor: equal strings have
equal anchors.  A run of neighbouring positions with one anchor is a context, and each
position is in one context only.  Contexts equal as a whole are counted, not sorted;
different ones with one anchor are sorted together by suffix.  An anchor shared by more
than ``HOT`` different contexts is dealt further: into blocks of positions by what all of
a block's strings share, and those that share it with another, into single positions.

Null and empty texts, and those shorter than ``length``, lose nothing.  Repeated rows are
documents of their own, and repeat each other.  Extra columns are carried by ``dedup``.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.llm.common import fresh, small_batches, table, written

LENGTH, GRAM, SEGMENT, HOT, BLOCK, CHUNK = 400, 48, 200_000, 2000, 32, 2 << 20
_U = np.uint64
_MIX, _POS = _U(0xFF51AFD7ED558CCD), _U((1 << 20) - 1)
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if 0 not in _powers or len(_powers[0][0]) < n:
        n = max(n, 1 << 14)
        up, down = np.full(n, _U(_BASE)), np.full(n, _U(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[0]


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w: of a block's suffix and the next block's prefix."""
    n = len(x)
    m = -(-n // w) * w
    y = np.full(m, ~_U(0))
    y[:n] = x
    y = y.reshape(-1, w)
    before = np.minimum.accumulate(y, 1).ravel()
    after = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchors(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Per start of ``length`` bytes: its anchor's place and hash."""
    n, g = len(text), min(GRAM, length)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _power(n)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[text] * up[:n])])
    h = (sums[g:] - sums[:-g]) * down[: n - g + 1]
    h = (h ^ (h >> _U(32))) * _MIX
    h ^= h >> _U(29)
    at = _window_min((h & ~_POS) | np.arange(len(h), dtype=_U), length - g + 1) & _POS
    return at.astype(np.int64), h[at.astype(np.int64)]


def contexts(raw: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """``(key, print, lo, hi, places)``: starts lo..hi have anchors of hash key, at so many
    places; print is of the bytes that strings from these starts take."""
    import xxhash

    text = np.frombuffer(raw, np.uint8)
    for first in range(0, max(len(raw) - length + 1, 0), SEGMENT):
        at, key = anchors(text[first : first + SEGMENT + length - 1], length)
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]]) - 1
        moves = np.concatenate([[0], np.cumsum(at[1:] != at[:-1])])
        places = moves[hi] - moves[lo] + 1
        for k, a, b, p in zip(key[lo].view(np.int64).tolist(), (lo + first).tolist(), (hi + first).tolist(), places.tolist()):
            x = xxhash.xxh3_64_intdigest(raw[a : b + length])
            yield k, x - (1 << 64) if x >> 63 else x, a, b, p


def repeated_prefixes(text: np.ndarray, end: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of the positions whose next ``length`` bytes (up to ``end``) occur at another, in
    suffix order, ties by position: positions, and their class."""
    n = len(text)
    step = min(8, length)
    pos = np.flatnonzero(np.arange(n) + step <= end)
    if step == 8:
        key = np.zeros(len(pos), _U)
        for i in range(8):
            key = (key << _U(8)) | text[pos + i].astype(_U)
    else:
        key = sum(text[pos + i].astype(_U) << _U(8 * (step - 1 - i)) for i in range(step))
    rank = np.full(n, -1, np.int64)

    def ranked(pos, key):
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        rank[:] = -1
        live = count[inverse] > 1
        rank[pos[live]] = inverse[live]
        return pos[live]

    pos = ranked(pos, key)
    while step < length and len(pos):
        jump = min(step, length - step)
        pos = pos[pos + step + jump <= end[pos]]
        pos = pos[rank[pos + jump] >= 0]
        if not len(pos):
            break
        pos = ranked(pos, rank[pos].astype(_U) * _U(n + 1) + rank[pos + jump].astype(_U))
        step += jump
    cls = rank[pos]
    order = np.lexsort((pos, cls))
    return pos[order], cls[order]


def previous_and_next(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In suffix order: has the suffix an earlier, a later position with its prefix."""
    same = cls[1:] == cls[:-1]
    no = np.zeros(min(1, len(cls)), bool)
    return np.concatenate([no, same]), np.concatenate([same, no])


def _ranges(starts: np.ndarray) -> tuple[list[int], list[int]]:
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()


_IDS = [("key", pa.int64()), ("print", pa.int64())]
_LISTS = [("los", pa.list_(pa.int32())), ("his", pa.list_(pa.int32()))]


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds)], [n for n, _ in kinds])


def _scan(length: int):
    kinds = [("doc_id", pa.int64()), ("u", pa.int64()), *_IDS, ("lo", pa.int32()), ("hi", pa.int32()), ("places", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, u, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "u", "raw"))):
                out += [(d, u, *x) for x in contexts(raw or b"", length)]
                if len(out) > 20_000:
                    yield _batch(out, kinds)
                    out = []
            yield _batch(out, kinds)

    return run


def _sorted_together(length: int, first: bool):
    """Contexts sorted by key, whole keys gathered up to CHUNK bytes, to their repeated starts."""

    def judged(part: list[dict]) -> pa.RecordBatch:
        part.sort(key=lambda r: (r["key"], r["doc_id"] is not None, r["doc_id"] or 0, r["u"], r["lo"]))
        text = np.frombuffer(b"".join(r["raw"] for r in part), np.uint8)
        sizes = np.array([len(r["raw"]) for r in part])
        ends = sizes.cumsum()
        pos, cls = repeated_prefixes(text, np.repeat(ends, sizes), length)
        before, after = previous_and_next(cls)
        hit = np.sort(pos[before if first else before | after])
        owner = np.searchsorted(ends, hit, side="right")
        out = []
        for i, starts in zip(np.unique(owner), np.split(hit, np.flatnonzero(np.diff(owner)) + 1)):
            out.append((part[i]["key"], part[i]["print"], *_ranges(starts - (ends[i] - sizes[i]))))
        return _batch(out, _IDS + _LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, key = [], 0, None
        for b in batches:
            for r in b.to_pylist():
                if size > CHUNK and r["key"] != key:
                    yield judged(part)
                    part, size = [], 0
                part.append(r)
                size, key = size + len(r["raw"]), r["key"]
        if part:
            yield judged(part)

    return run


def _blocks(length: int):
    """A context to its blocks: starts whose distance to their anchor differs by less than
    BLOCK.  share: hash of what all strings of a whole block have in common."""
    import xxhash

    kinds = [*_IDS, ("n", pa.int64()), ("share", pa.int64()), ("p", pa.int32()), ("raw", pa.binary()), ("doc_id", pa.int64()), ("lo", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 100):
                out = []
                for r in b.slice(i, 100).to_pylist():
                    raw = r["raw"]
                    at, _ = anchors(np.frombuffer(raw, np.uint8), length)
                    back = (at - np.arange(len(at))) // BLOCK
                    cut = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0) | (np.diff(back) != 0)) + 1, [len(at)]])
                    for p, q in zip(cut[:-1].tolist(), cut[1:].tolist()):
                        last = int(at[p] - back[p] * BLOCK)  # the start nearest to the anchor that a whole block has
                        share = xxhash.xxh3_64_intdigest(raw[last : last - BLOCK + 1 + length], seed=int(back[p]))
                        out.append((r["key"], r["print"], r["n"], share - (1 << 64) if share >> 63 else share, p, raw[p : q - 1 + length], r["doc_id"], r["lo"]))
                yield _batch(out, kinds)

    return run, "key long, print long, n long, share long, p int, raw binary, doc_id long, lo int"


def _singles(length: int):
    """A block to its strings, by 128-bit hash."""
    import xxhash

    kinds = [*_IDS, ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("p", pa.int32()), ("doc_id", pa.int64()), ("lo", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                out = []
                for r in b.slice(i, 500).to_pylist():
                    for j in range(len(r["raw"]) - length + 1):
                        h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(r["raw"][j : j + length]), np.int64).tolist()
                        out.append((r["key"], r["print"], r["n"], h1, h2, r["p"] + j, r["doc_id"], r["lo"]))
                yield _batch(out, kinds)

    return run, "key long, print long, n long, h1 long, h2 long, p int, doc_id long, lo int"


def _hot(found: DataFrame, length: int, first: bool) -> DataFrame:
    """Repeated starts of contexts whose anchor too many others have."""
    run, schema = _blocks(length)
    blocks = written(found.mapInArrow(run, schema), "suffix-blocks")
    shared = blocks.groupBy("share").agg(F.count("*").alias("m")).where("m > 1")
    run, schema = _singles(length)
    singles = written(blocks.join(shared.select("share"), "share").select(*blocks.columns).mapInArrow(run, schema), "suffix-singles")
    group = singles.groupBy("h1", "h2").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "lo", "p")).alias("least")).where("m > 1")
    hit = singles.join(group, ["h1", "h2"])
    if first:
        hit = hit.where(~F.struct("doc_id", "lo", "p").eqNullSafe(F.col("least")))
    starts = F.array_sort(F.collect_set("p"))
    return hit.groupBy("key", "print").agg(starts.alias("los"), starts.alias("his"))


def repeated_starts(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """``(doc_id, u, los, his)``: per document the ranges of starts whose strings go.

    docs: ``(doc_id, u, raw)``, u a hash of the row's text.
    """
    first = keep == "first"
    made = written(docs.mapInArrow(_scan(length), "doc_id long, u long, key long, print long, lo int, hi int, places int"), "suffix-contexts")
    keys = made.groupBy("key").agg(F.sum("places").alias("total")).where("total > 1")
    made = written(made.join(keys.select("key"), "key"), "suffix-shared")
    one = F.struct(F.col("doc_id").alias("d"), F.col("lo").alias("l"), F.col("u").alias("w"), F.col("hi").alias("h"))
    groups = made.groupBy("key", "print").agg(F.count("*").alias("n"), F.max("places").alias("places"), F.min(one).alias("x"))
    groups = written(groups.select("key", "print", "n", "places", "x.d", "x.l", "x.w", "x.h"), "suffix-groups")
    kinds = groups.groupBy("key").agg(F.count("*").alias("kinds"))
    # What has to be sorted: a key's different contexts, and contexts that may repeat inside.
    unlike = groups.join(kinds, "key").where("kinds > 1 OR places > 1")
    at = unlike.groupBy("d", "w").agg(F.collect_list(F.struct("key", "print", "n", "kinds", "l", "h")).alias("xs"))
    texts = docs.select("doc_id", "u", "raw").join(at, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("u") == F.col("w"))).select("doc_id", "u", "raw", F.explode("xs").alias("x"))
    found = texts.select("doc_id", "u", "x.key", "x.print", "x.n", "x.kinds", F.col("x.l").alias("lo"), F.substring("raw", F.col("x.l") + 1, F.col("x.h") - F.col("x.l") + length).alias("raw"))
    found = written(found.dropDuplicates(["key", "print"]), "suffix-unlike")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = found.where(F.col("kinds") <= HOT).repartition(n, "key").sortWithinPartitions("key")
    sure = cold.mapInArrow(_sorted_together(length, first), "key long, print long, los array<int>, his array<int>")
    if not found.where(F.col("kinds") > HOT).isEmpty():
        sure = sure.unionByName(_hot(found.where(F.col("kinds") > HOT), length, first))
    sure = written(sure, "suffix-repeated")
    whole = groups.where("n > 1").select("key", "print", F.col("d").alias("rd"), F.col("l").alias("rl"), F.col("w").alias("rw"))
    rows = made.join(sure, ["key", "print"], "left").join(whole, ["key", "print"], "left")
    # Of equal contexts all go; with keep="first" the first one has only what its own order says.
    spared = F.lit(first) & F.col("rd").eqNullSafe(F.col("doc_id")) & (F.col("rl") == F.col("lo")) & (F.col("rw") == F.col("u"))
    all_of = F.col("rw").isNotNull() & ~F.coalesce(spared, F.lit(False))
    shift = lambda c: F.transform(c, lambda p: p + F.col("lo"))
    rows = rows.select("doc_id", "u", F.when(all_of, F.array("lo")).otherwise(shift("los")).alias("los"), F.when(all_of, F.array("hi")).otherwise(shift("his")).alias("his")).where("los IS NOT NULL")
    return rows.groupBy(F.col("doc_id").alias("d"), F.col("u").alias("w")).agg(F.flatten(F.collect_list("los")).alias("los"), F.flatten(F.collect_list("his")).alias("his"))


def kept_parts(raw: bytes, los, his, length: int) -> tuple[bytes, int, int]:
    """What is left, the number of bytes removed, and of maximal removed runs."""
    if los is None or not len(los):
        return raw, 0, 0
    lo, hi = np.asarray(los, np.int64), np.asarray(his, np.int64)
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, hi + length, -1)
    gone = step.cumsum()[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _starts(docs: DataFrame, length: int, keep: str) -> DataFrame:
    """``docs(doc_id, raw)`` with los and his."""
    small_batches(docs.sparkSession, 500)
    keyed = docs.select("doc_id", F.xxhash64("raw").alias("u"), "raw")
    at = repeated_starts(keyed, length, keep)
    return keyed.join(at, keyed["doc_id"].eqNullSafe(at["d"]) & (keyed["u"] == at["w"]), "left").select("doc_id", "raw", "los", "his")


def dedup(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``.  What a cut leaves of a character
    at its borders is dropped.  A string may overlap its earlier copy: of a long run of one
    character the first is left."""
    small_batches(docs.sparkSession, 500)
    raw, u, d, w, los, his = fresh(docs, "raw", "u", "d", "w", "los", "his")
    named = docs.withColumn(raw, F.col("text").cast("binary")).withColumn(u, F.xxhash64(raw))
    at = repeated_starts(named.select("doc_id", F.col(u).alias("u"), F.col(raw).alias("raw")), length, keep).toDF(d, w, los, his)
    both = named.join(at, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(u) == F.col(w)), "left")
    rest = docs.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if r is None else kept_parts(r, lo, hi, length)[0].decode("utf-8", "ignore") for r, lo, hi in zip(*(b.column(c).to_pylist() for c in (raw, los, his)))]
            cols = {n: c for n, c in zip(b.schema.names, b.columns) if n not in (raw, los, his)} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    out = both.select(*rest.columns, raw, los, his).mapInArrow(run, rest.schema.add("text", "string"))
    return out.select(*docs.columns)


def _digest(length: int):
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, raw, lo, hi in zip(*(b.column(c).to_pylist() for c in ("doc_id", "raw", "los", "his"))):
                raw = raw or b""
                left, n, runs = kept_parts(raw, lo, hi, length)
                out.append((d, len(raw), n, runs, hashlib.sha256(left).hexdigest()))
            yield _batch(out, kinds)

    return run


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    return _starts(docs, LENGTH, "none").mapInArrow(_digest(LENGTH), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SQL = {
    "op9_suffix_dedup": """
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS raw FROM documents
), sized AS (
    SELECT *, octet_length(raw) AS n FROM docs
), starts AS (
    SELECT r, i, md5(raw[i:i + 399]) AS h FROM (SELECT r, raw, n, unnest(range(1, n - 398)) AS i FROM sized WHERE n >= 400)
), twice AS (
    SELECT r, i FROM starts SEMI JOIN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1) USING (h)
), runs AS (
    SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run
    FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM twice)
), spans AS (
    SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM runs GROUP BY r, run
), kept AS (
    SELECT r, lag(hi, 1, 1) OVER (PARTITION BY r ORDER BY lo) AS a, lo AS b FROM spans
    UNION ALL
    SELECT s.r, coalesce(x.hi, 1), s.n + 1 FROM sized s LEFT JOIN (SELECT r, max(hi) AS hi FROM spans GROUP BY r) x USING (r)
), texts AS (
    SELECT k.r, string_agg(CASE WHEN k.b > k.a THEN hex(s.raw[k.a:k.b - 1]) ELSE '' END, '' ORDER BY k.a) AS left_over
    FROM kept k JOIN sized s USING (r) GROUP BY k.r
)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_bytes, CAST(coalesce(x.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(x.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(t.left_over)) AS kept_sha256
FROM sized s JOIN texts t USING (r) LEFT JOIN (SELECT r, sum(hi - lo) AS gone, count(*) AS spans FROM spans GROUP BY r) x USING (r)
""",
}
