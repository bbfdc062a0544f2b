"""Fill-in-middle transformation over whole texts, cut at units (lines).

A text is cut as UTF-8 bytes; what is asked and given back are code points.  Between the two
stands a sparse index of exceptions: the byte positions of the multibyte characters only, and
the bytes that each has beyond its first.  Both ways are one ``searchsorted`` in it, and
between two exceptions a position is plain arithmetic, so that an ASCII text has an empty
index and no array of its length is ever made for it.

The cuts and the form depend on the id and the seed only, so each run and each split of the
table gives the same output.  Null texts are empty; an empty text, or one that holds a marker
itself, stays as it is (form plain), so that `restore` always finds the text again.  Null ids
count as an empty id.  Repeated rows are transformed alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.llm.common import fresh, small_batches, table

SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What `fill_in_middle` adds.
COLUMNS = {"output": "string", "form": "string", "n": "long", "prefix_chars": "long", "middle_chars": "long"}


class Exceptions:
    """The multibyte characters of a UTF-8 text: where each begins and the excess bytes up to it."""

    def __init__(self, data: bytes):
        if data.isascii():
            self.at = self.excess = np.zeros(0, np.int64)
        else:
            raw = np.frombuffer(data, np.uint8)
            self.at = np.flatnonzero(raw >= 0xC0)
            lead = raw[self.at]
            self.excess = np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
        #: The same places counted in code points.
        self.points = self.at - np.concatenate([[0], self.excess[:-1]]) if len(self.at) else self.at

    def to_points(self, byte: int) -> int:
        k = int(np.searchsorted(self.at, byte))
        return byte - (int(self.excess[k - 1]) if k else 0)

    def to_bytes(self, point: int) -> int:
        k = int(np.searchsorted(self.points, point))
        return point + (int(self.excess[k - 1]) if k else 0)


def line_ends(data: bytes) -> np.ndarray:
    """The bytes before each line's end, its line break included."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if not data or data.endswith(b"\n") else np.append(ends, len(data))


def draws(seed: int, ids: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from a seed and an id."""
    h = hashlib.sha256(f"{seed}:{ids}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(data: bytes, ids: str, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> tuple[bytes, str, int, int | None, int | None]:
    """``(output, form, units, prefix_chars, middle_chars)`` of one text."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    h1, h2, h3, h4 = draws(seed, ids)
    ends = line_ends(data)
    n = len(ends)
    if not data or p in data or s in data or m in data or h3 % 100 >= fim:
        return data, "plain", n, None, None
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (lo, hi))
    index = Exceptions(data)
    chars = index.to_points(a), index.to_points(b) - index.to_points(a)
    if h4 % 100 < spm:
        return b"".join((s, data[b:], p, data[:a], m, data[a:b])), "spm", n, *chars
    return b"".join((p, data[:a], s, data[b:], m, data[a:b])), "psm", n, *chars


def fill_in_middle(docs: DataFrame, key: str = "doc_id", seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with the columns of COLUMNS (columns of these names are replaced).

    ``fim`` percent of the texts are transformed, ``spm`` percent of those with the suffix
    first.  A row is transformed alone in its task: nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop(*COLUMNS)
    raw, ids = fresh(docs, "raw", "ids")
    schema = rest.schema
    for name, kind in COLUMNS.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [transform(t or b"", i, seed, fim, spm) for t, i in zip(b.column(raw).to_pylist(), b.column(ids).to_pylist())]
            made = list(zip(*rows)) or [[]] * len(COLUMNS)
            text = pa.array(made[0], pa.binary()).cast(pa.string())
            parts = [text, pa.array(made[1], pa.string()), *(pa.array(c, pa.int64()) for c in made[2:])]
            keep = [i for i, c in enumerate(b.schema.names) if c not in (raw, ids)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *parts], [*(b.schema.names[i] for i in keep), *COLUMNS])

    return rest.withColumns({raw: F.col("text").cast("binary"), ids: F.coalesce(F.col(key).cast("string"), F.lit(""))}).mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text again, from an output and its form alone: no text holds a marker, so the
    first of each is the one that was put in."""
    after = lambda c, mark: F.substr(c, F.locate(mark, c) + F.lit(len(mark)))
    before = lambda c, mark: F.substr(c, F.lit(1), F.locate(mark, c) - F.lit(1))
    body, spm = F.substr(output, F.lit(len(SUFFIX) + 1)), form == "spm"
    head = F.when(spm, before(body, PREFIX)).otherwise(before(body, SUFFIX))
    rest = F.when(spm, after(body, PREFIX)).otherwise(after(body, SUFFIX))
    inner, middle = before(rest, MIDDLE), after(rest, MIDDLE)
    return F.when(form == "plain", output).when(spm, F.concat(inner, middle, head)).otherwise(F.concat(head, middle, inner))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


_H = "CAST('0x' || substr(sha256('7:' || doc_id), {0}, 8) AS BIGINT)"
SQL = {
    "op12_fill_in_middle": rf"""WITH a AS (SELECT doc_id, coalesce("text", '') t, {_H.format(1)} h1, {_H.format(9)} h2, {_H.format(17)} h3, {_H.format(25)} h4 FROM documents),
 b AS (SELECT *, CAST(length(t) - length(replace(t, chr(10), '')) AS BIGINT) + CASE WHEN t <> '' AND right(t, 1) <> chr(10) THEN 1 ELSE 0 END n FROM a),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) lo, greatest(h1 % (n + 1), h2 % (n + 1)) hi, regexp_extract_all(t, '[^\n]*\n|[^\n]+') ls, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END form FROM b),
 d AS (SELECT *, coalesce(array_to_string(ls[1:lo], ''), '') p, coalesce(array_to_string(ls[lo + 1:hi], ''), '') m, coalesce(array_to_string(ls[hi + 1:], ''), '') s FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) output_sha256, sha256(t) restored_sha256 FROM d"""
}
