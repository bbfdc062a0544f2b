"""MinHash near-dedup with b-bit signatures, confirmed on full sets.

A document's set is its distinct shingles of ``words`` words (query: 2; pipeline: 5), of
the A-Z-lower-cased text; with fewer words, the whole sequence is its one shingle.  Sets
are compared by 64-bit shingle hashes.  Equal sets fall together first, so thousands of
copies are one node.  Per node: ``BANDS`` bands of ``ROWS`` minima give bucket hashes (two
sets of similarity 0.8 miss each other with probability 1.5e-4), and the ``BITS`` low bits
of all minima, packed, give a collision-corrected estimate of similarity by bit counts.

Copies of one text, each edited elsewhere, are all near that text and less near one
another, so a bucket's leader is its hub: the document whose buckets hold the most members.
First each document is a candidate with the best of its buckets' hubs, which joins a group
of n near copies by n rows.  Estimates under ``FLOOR`` are dropped (4.7 standard deviations
under 0.8) and the rest verified on the full sets, by intersection size.  After union-find,
members of buckets of several components are compared across components: directly in small
buckets, by an exact prefix filter (``components.prefix_pairs``) in large ones, where only
those that share one of the elements that are rare in their group become pairs.  These
pass the same estimate and verification.

Null and empty texts, and those without words, have empty sets and are linked with
nothing.  Rows of equal doc_id and different texts are documents of their own.  A row with
null doc_id gets the component of its set, but doesn't link others, leads none and isn't
removed by ``near_dedup``, where repeated rows with a doc_id become one.  Extra columns are
carried by ``near_dedup``.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.llm.common import by_key, discard, fresh, mixed, small_batches, table, written
from hostwatch.llm.components import PERCENT, connected_components, hubs_of, prefix_pairs, unsettled

BANDS, ROWS, BITS, FLOOR = 48, 8, 4, 0.70
K = BANDS * ROWS
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 32, K, dtype=np.uint32) | 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, K, dtype=np.uint32)
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(32)


def _word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    import xxhash

    split = [(t or b"").lower().split() for t in texts]  # bytes: A-Z only, ASCII white space only
    words = [x for w in split for x in w]
    if not words:
        return [np.zeros(0, np.uint64) for _ in texts]
    ids, distinct = pd.factorize(np.array(words, dtype=object))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[ids]
    return np.split(hashes, np.cumsum([len(w) for w in split])[:-1])


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for h in _word_hashes(texts):
        n = min(words, len(h))
        if not n:
            out.append(h)
            continue
        s = np.full(len(h) - n + 1, np.uint64(n))
        for i in range(n):
            s = mixed(s * _ONE + h[i : len(h) - n + 1 + i] * _TWO)
        out.append(np.unique(s))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """The K minima; long sets by pieces, so that memory stays bounded."""
    low = (s >> _S).astype(np.uint32)
    m = np.full(K, np.uint32(0xFFFFFFFF))
    for i in range(0, len(low), 2048):
        m = np.minimum(m, (low[i : i + 2048, None] * _A + _B).min(0))
    return m


_LONGS = K * BITS // 64


def _packed(minima: np.ndarray) -> np.ndarray:
    """Low bits of the minima, 16 minima a long."""
    low = (minima & np.uint32(15)).astype(np.uint64).reshape(-1, _LONGS, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64).view(np.int64)


def _bands(minima: np.ndarray) -> np.ndarray:
    m = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _TWO + np.zeros((len(m), 1), np.uint64)
    for r in range(ROWS):
        h = mixed(h * _ONE + m[:, :, r] * _TWO)
    return h.view(np.int64)


def similarity(a, b):
    """Estimate from two packed signatures (arrays of longs): the share of equal BITS-bit
    values, corrected for the share that collides by chance."""
    lowest = F.lit(0x1111111111111111)
    differ = None
    for i in range(_LONGS):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(lowest))
        differ = n if differ is None else differ + n
    chance = 1 / 2**BITS
    return (1 - differ / F.lit(float(K)) - chance) / (1 - chance)


def _features(words: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                sets = shingle_sets(part.column("raw").to_pylist(), words)
                minima = np.stack([signature(s) for s in sets])
                prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                halves = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
                n, longs = len(sets), pa.list_(pa.int64())
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())).cast(longs)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("u"), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), lists(_bands(minima)), lists(_packed(minima))],
                    ["doc_id", "u", "n_shingles", "f1", "f2", "bands", "bits"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                # The upper 48 bits of each hash: between two sets a collision has odds of n * n / 2**48.
                made = [s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for s in shingle_sets(part.column("raw").to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made, pa.binary())], ["id", "s"])

    return run


def _unpacked(s: bytes) -> np.ndarray:
    out = np.zeros((len(s) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(s, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in batches:
        ok = []
        for x, y in zip(p.column("s"), p.column("t")):
            x, y = _unpacked(x.as_py()), _unpacked(y.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([p.column("a").filter(keep), p.column("b").filter(keep)], ["a", "b"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sets to a row an element, a few sets at a time."""
    names = ["id", "c", "g"]
    for b in batches:
        for i in range(0, b.num_rows, 20):
            part = b.slice(i, 20)
            sets = [_unpacked(x.as_py()).view(np.int64) for x in part.column("s")]
            sizes = [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(part.column(c).to_numpy(), sizes)) for c in names), pa.array(np.concatenate(sets))], [*names, "s"])


def _full_sets(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(id, s)``: the packed full set of each of ``nodes(id, one)``, bucketed by id."""
    at = nodes.select("id", "one.doc_id", "one.u")
    raw = texts.join(at, ["doc_id", "u"]).select("id", F.col("text").cast("binary").alias("raw"))
    return by_key(raw.mapInArrow(_sets(words), "id long, s binary"), "id", "near-sets", distinct=True)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` those whose full sets are similar enough."""
    both = pairs.join(sets.withColumnRenamed("id", "a"), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("t")), "b")
    return written(both.select("a", "b", "s", "t").mapInArrow(_confirm, "a long, b long"), "near-links")


def _likely(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs whose estimated similarity reaches FLOOR."""
    one, two = bits.select(F.col("id").alias("a"), F.col("bits").alias("p")), bits.select(F.col("id").alias("b"), F.col("bits").alias("q"))
    return pairs.join(one, "a").join(two, "b").where(similarity(F.col("p"), F.col("q")) >= FLOOR).select("a", "b").distinct()


def _components(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``(id, component)`` of ``nodes(id, one, bands, bits)`` that are linked with another."""
    rows = nodes.where("one.doc_id IS NOT NULL").select("id", F.explode("bands").alias("h")).distinct()
    held = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    held = written(rows.join(held, "h").select("h", "id", "n"), "near-buckets")
    shared = written(held.select("h", "id").join(held.groupBy("id").agg(F.sum("n").alias("score")), "id"), "near-scores")
    discard(held)
    score = shared.select("id", "score").distinct()
    ids = shared.select("id").distinct()
    held = written(nodes.join(ids, "id").select("id", "one", "bits"), "near-held")
    bits, sets = held.select("id", "bits"), _full_sets(texts, held, words)
    # First one candidate a document: the best hub of its buckets.
    led = shared.join(hubs_of(shared), "h").where("id <> hub").join(score.select(F.col("id").alias("hub"), F.col("score").alias("best")), "hub")
    best = led.groupBy("id").agg(F.max(F.struct("best", "hub")).alias("x")).select("id", F.col("x.hub").alias("hub"))
    links = _confirmed(_likely(best.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), bits), sets)
    found = connected_components(links)
    # Then what is left in buckets of several components.
    pairs, rest = unsettled(shared, found, "near")
    elements = written(rest.join(sets, "id").select("id", "c", "g", "s").mapInArrow(_elements, "id long, c long, g long, s long"), "near-elements")
    pairs = pairs.unionByName(prefix_pairs(elements).select("a", "b"))
    discard(elements)
    more = _confirmed(_likely(pairs, bits), sets)
    return connected_components(links.unionByName(more))


def _labelled(docs: DataFrame, words: int) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, u, n_shingles, component_id and whether the
    row's text leads its component."""
    small_batches(docs.sparkSession, 500)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("u"), "text")
    features = texts.select("doc_id", "u", F.col("text").cast("binary").alias("raw")).mapInArrow(_features(words), "doc_id long, u long, n_shingles long, f1 long, f2 long, bands array<long>, bits array<long>")
    features = written(features, "near-features")
    # A node is a distinct set, named by half of its print; of two sets with one name the lesser is compared.
    full = features.where("n_shingles > 0")
    nodes = full.groupBy("f1").agg(F.min("f2").alias("f2"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "u"))).alias("one"), F.min_by("bands", "f2").alias("bands"), F.min_by("bits", "f2").alias("bits"))
    nodes = written(nodes.withColumnRenamed("f1", "id"), "near-nodes")
    found = _components(nodes, texts, words).withColumnsRenamed({"id": "f1", "component": "c"})
    rows = features.select("doc_id", "u", "n_shingles", "f1", "f2").join(nodes.select(F.col("id").alias("f1"), F.col("f2").alias("first"), F.col("one")), "f1", "left").join(found, "f1", "left")
    alone = (F.col("n_shingles") == 0) | (F.col("f2") != F.col("first"))
    rows = rows.withColumn("c", F.when(~alone, F.coalesce("c", "f1")))
    leads = rows.where("c IS NOT NULL").select("c", "one").distinct().groupBy("c").agg(F.min("one").alias("lead"))
    both = rows.join(leads, "c", "left")
    lead = F.coalesce("lead.doc_id", "doc_id")
    return both.select("doc_id", "u", "n_shingles", lead.alias("component_id"), (F.col("lead").isNull() | (F.struct("doc_id", "u") == F.col("lead"))).alias("leads"))


def near_components(docs: DataFrame, words: int = 5) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id."""
    return _labelled(docs, words).select("doc_id", "n_shingles", "component_id")


def near_dedup(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one document of each component, that of the least doc_id, and those without doc_id."""
    (u,) = fresh(docs, "u")
    kept = _labelled(docs, words).where("leads AND doc_id IS NOT NULL").select("doc_id", F.col("u").alias(u)).distinct()
    named = docs.where("doc_id IS NOT NULL").withColumn(u, F.xxhash64("text")).join(kept, ["doc_id", u], "left_semi")
    return named.dropDuplicates(["doc_id", u]).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(table(spark, sf_dir, "documents"), 2)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = {
    "op10_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
