"""Token counts by a two-tier look-up inside the tasks, with no shuffle of pre-tokens.

A text is cut into pre-tokens, at places that no piece of the vocabulary spans, so that a
text's tokens are those of its pre-tokens put together; `_Cutter` proves that from the
vocabulary, and a model for which it doesn't hold encodes whole texts.

* Tier 1 is a table of the frequent pre-tokens and their numbers of tokens, broadcast.  All
  texts are counted for it: each task keeps a summary of bounded size and gives at most
  ``PER_TASK`` rows, and only these summaries are added up.  At most ``FREQUENT`` keys of at
  most ``KEY_CHARS`` characters are kept, so the table has under 10 MB whatever the corpus.
* Tier 2 is a cache in each worker, of at most ``CACHED`` keys.  What isn't in it either is
  encoded by the library; keys of over ``KEY_CHARS`` characters always are.

The tiers change the time only: every count is the library's.  Null texts are empty and
have no tokens; repeated rows and ids stay; other columns stay as they are, and a column of
the name of the result is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.llm.common import fresh, small_batches, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
FREQUENT, PER_TASK, KEY_CHARS = 32_768, 2_048, 64
#: Keys that a worker's cache and a task's summary hold at most.
CACHED = 200_000

_SPACE = "▁"  # what sentencepiece puts for a space


class _Cutter:
    """Texts to pre-tokens and their numbers of tokens, by one sentencepiece model.

    A key is a pre-token without the space before it; a key that begins with a line break
    had none.  ``cut`` gives the keys of a text, ``lengths`` their numbers of tokens.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.encode = SentencePieceProcessor(model_file=path).encode
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap and not model.trainer_spec.treat_whitespace_as_suffix
        # No piece goes on after a space or a line break that follows another character.
        self.cuts = plain and not any(re.search(f"(?s).[\n]|\n.|[^{_SPACE}]{_SPACE}", p.piece) for p in model.pieces if p.type == p.NORMAL or p.type == p.USER_DEFINED)
        self.parts = re.compile(f"[ {_SPACE}]+[^ {_SPACE}\n]*|\n[^ {_SPACE}\n]*").findall
        self.lone = len(self.encode("\n ")) - len(self.encode("\n"))

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.cuts:
            return [text]
        if text[0] == " " or "  " in text or _SPACE in text:
            # Before the text goes a space; each part but one of a line break begins with one.
            return [p if p[0] == "\n" else p[1:] for p in self.parts(" " + text)]
        return text.replace("\n", " \n").split(" ")

    def lengths(self, keys: list[str]) -> list[int]:
        """An empty key is a space alone; before a line break the library puts one too many."""
        return [len(e) - self.lone * k.startswith("\n") if k else self.lone for k, e in zip(keys, self.encode(keys, num_threads=1) if keys else ())] if self.cuts else [len(e) for e in self.encode(keys, num_threads=1)]


_cutters: dict[str, _Cutter] = {}
_tiers: dict[str, tuple[dict[str, int], dict[str, int]]] = {}


def _cutter(model: str) -> _Cutter:
    """One a worker process and model; ``model`` is a file's name among the public tokenizers, or its path."""
    if model not in _cutters:
        if "/" in model:
            path = model
        else:
            import public_tokenizers

            path = str(public_tokenizers.path(model))
        _cutters[model] = _Cutter(path)
    return _cutters[model]


def _summaries(model: str, column: str):
    """The most frequent keys of a task's texts.  Where a summary grows over its bound, the
    rarer half goes: that may misjudge which keys are frequent, never a length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, seen = _cutter(model).cut, Counter()
        for b in batches:
            for text in b[column]:
                seen.update([k for k in cut(text or "") if len(k) <= KEY_CHARS])
                if len(seen) > CACHED:
                    seen = Counter(dict(seen.most_common(CACHED // 2)))
        top = [(k, n) for k, n in seen.most_common(PER_TASK) if n > 1]
        yield pd.DataFrame(top, columns=["key", "n"]).astype({"key": object, "n": "int64"})

    return run


def frequent_lengths(docs: DataFrame, model: str = MODEL) -> dict[str, int]:
    """The frequent pre-tokens of all texts and their numbers of tokens, on the driver:
    at most FREQUENT keys of at most KEY_CHARS characters."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(_summaries(model, "text"), "key string, n long")
    top = rows.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT)
    keys = [r.key for r in top.select("key").collect()]
    return dict(zip(keys, _cutter(model).lengths(keys)))


def count_tokens(docs: DataFrame, column: str = "n_tokens", model: str = MODEL, frequent: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with the number of tokens of each ``text``."""
    spark = docs.sparkSession
    small_batches(spark)
    known = frequent_lengths(docs, model) if frequent is None else frequent
    shared = spark.sparkContext.broadcast(("".join(known), [len(k) for k in known], list(known.values())))
    tag = uuid.uuid4().hex

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cutter = _cutter(model)
        if tag not in _tiers:
            keys, sizes, values = shared.value
            first, at = {}, 0
            for size, n in zip(sizes, values):
                first[keys[at : at + size]] = n
                at += size
            _tiers.clear()
            _tiers[tag] = first, {}
        first, cache = _tiers[tag]
        for part in texts:
            out = []
            for text in part:
                seen = Counter(cutter.cut(text or ""))
                total, misses = 0, []
                for key, n in seen.items():
                    size = first.get(key)
                    if size is None:
                        size = cache.get(key)
                    if size is None:
                        misses.append(key)
                    else:
                        total += n * size
                for key, size in zip(misses, cutter.lengths(misses)):
                    total += seen[key] * size
                    if len(key) <= KEY_CHARS:
                        cache[key] = size
                if len(cache) > CACHED:
                    cache.clear()
                out.append(total)
            yield pd.Series(out, dtype="int64")

    return docs.withColumn(column, counted(F.col("text").cast("string")))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    (n,) = fresh(docs, "n_tokens")
    n_bytes = F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return count_tokens(docs, n).select("doc_id", n_bytes.alias("n_bytes"), n, (F.col(n) > LIMIT).alias("over_limit"))


SQL: dict[str, str] = {}
