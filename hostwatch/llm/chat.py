"""Chat formatting with an offset-aligned loss mask.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans
of its assistant texts are intersected with the token spans by binary search.

Template, a turn: ``<s>ROLE<|>[INST]TEXT[/INST]</s>``, for the assistant
``<s>ROLE<|>TEXT</s>``.  These six control strings can't occur in ROLE or TEXT: a backslash
is doubled, and a control string gets one after its first character; reading back, a
doubled backslash is one and a single one is none.

Turns are in order of (turn, role, text).  Null role and text: empty.  Null conv_id is a
conversation of its own.  A conversation of empty texts has an empty mask.  Repeated rows
are repeated turns.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.llm.common import small_batches, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
OPEN, CLOSE, ROLE_END, IN, OUT = "<s>", "</s>", "<|>", "[INST]", "[/INST]"
_CONTROL = re.compile("|".join(map(re.escape, (OPEN, CLOSE, ROLE_END, IN, OUT))))
_TURN = re.compile(r"<s>(.*?)<\|>(.*?)</s>", re.S)
_BACK = re.compile(r"\\(\\?)")
SCHEMA = "conv_id long, text string, token_ids array<int>, starts array<int>, ends array<int>, loss array<boolean>, loss_starts array<int>, loss_ends array<int>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The conversation's text, and the (start, end) of its assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{ROLE_END}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
            turn = f"{head}{body}{CLOSE}"
        else:
            turn = f"{head}{IN}{body}{OUT}{CLOSE}"
        parts.append(turn)
        at += len(turn)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out = []
    for role, body in _TURN.findall(text):
        if body.startswith(IN) and body.endswith(OUT):
            body = body[len(IN) : -len(OUT)]
        out.append((unescape(role), unescape(body)))
    return out


def mask(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that meet a span, and the characters of each that are under the mask.

    Token spans are sorted (several tokens of one character share its span), turn spans
    are sorted and disjoint: the tokens of a span are found by binary search at its ends.
    A token across a border is masked for its part inside.
    """
    lo, hi = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    first = np.searchsorted(ends, spans[:, 0], side="right")
    last = np.searchsorted(starts, spans[:, 1], side="left")
    for (a, b), i, j in zip(spans, first, last):
        lo[i:j], hi[i:j] = np.maximum(starts[i:j], a), np.minimum(ends[i:j], b)
    return hi > lo, lo, hi


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Spark runs a task a core; more threads in each would only hold more conversations at once.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                made = [render([(x["role"] or "", x["text"] or "") for x in turns]) for turns in part.column("turns").to_pylist()]
                rows = []
                for (text, spans), e in zip(made, t.encode_batch([x for x, _ in made], add_special_tokens=False)):
                    o = np.array(e.offsets, np.int64).reshape(-1, 2)
                    loss, lo, hi = mask(spans, o[:, 0], o[:, 1])
                    rows.append((text, e.ids, o[:, 0], o[:, 1], loss, lo[loss], hi[loss]))
                ints, columns = pa.list_(pa.int32()), list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array(columns[0], pa.string()), pa.array(columns[1], ints), pa.array(columns[2], ints), pa.array(columns[3], ints), pa.array(columns[4], pa.list_(pa.bool_())), pa.array(columns[5], ints), pa.array(columns[6], ints)],
                    ["conv_id", "text", "token_ids", "starts", "ends", "loss", "loss_starts", "loss_ends"],
                )

    return run


def format_chats(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per conversation: text, tokens with their character spans, and the loss mask.

    ``loss`` by token; ``loss_starts`` and ``loss_ends``: of the masked tokens, in order,
    the characters under the mask.
    """
    small_batches(conversations.sparkSession, 200)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.mapInArrow(_encode(tokenizer), SCHEMA)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.select(["conv_id", "text", "loss_starts", "loss_ends"]).to_pylist():
            turns = parse(r["text"])
            pieces, at = [], 0
            for lo, hi in zip(r["loss_starts"], r["loss_ends"]):
                lo = max(lo, at)  # tokens of one character have one span
                if lo < hi:
                    pieces.append(r["text"][lo:hi])
                    at = hi
            said = unescape("".join(pieces))
            joined = "".join(f"{role}\n{text}\n" for role, text in turns)
            sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((r["conv_id"], len(turns), sha(joined), len(said), sha(said), len(r["text"])))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return format_chats(rows).mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_ESC = "replace(replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '<|>', '<\\|>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"
SQL = {
    "op3_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN t ELSE '' END, '' ORDER BY turn, r, t), '')) AS loss_sha256,
  CAST(sum(10 + length({_ESC.format("r")}) + length({_ESC.format("t")}) + CASE WHEN r = 'assistant' THEN 0 ELSE 13 END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
}
