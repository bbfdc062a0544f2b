"""Spelling variants: words one edit apart, grouped under the commoner form.

Words of up to ``DEPTH`` code points meet in a relational trie.  Its nodes are prefixes, a
distributed table written once; a frontier of states (word, position, node) with one edit
spent goes down it level by level, each level one join on the node that comes next, and a
state whose word and path end together at a word's node is a pair.

* Two tries: words forwards for edits in their second half, and backwards for those in the
  first.  An edit is then only tried below the half of a word, where few branches are left,
  so no level holds all words times an alphabet and no state sits at the root.
* Before an edit is taken, the row of the node, which holds its branches (no more than the
  letters there are) and theirs, tells whether the word can go on behind it.

Longer words, which may have any length, meet by hashes of themselves with one code point
left out: words that share one with the same place differ there only, and a word that is
itself another's remainder is one code point shorter.  Both joins give true pairs and no
others but for collisions, which an exact comparison removes; a word costs its length.

Null texts have no words and null ids count as empty; the empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.llm.common import ascii_lower, discard, table, written

LEAST_CHARS, LEAST_COUNT, RATIO, SLIP = 6, 5, 5, 199
DEPTH = 24
#: Code points of a long word whose hashes go to one row batch.
CHUNK = 50_000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def slipped(run: Column, ids: Column, slip: int = SLIP) -> Column:
    """``run`` without one code point where the hash of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(ids.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % slip == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def count_words(docs: DataFrame, key: str = "doc_id", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of all texts, slips made.  Counted in the tasks before anything moves;
    shorter runs never leave the pattern."""
    runs = docs.select(F.col(key).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{least_chars},}}"), 0)).alias("run"))
    words = runs.select(slipped(ascii_lower(F.col("run")), F.col("id")).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _sides(words: DataFrame) -> DataFrame:
    """Each word forwards and backwards, its trie's letter first; ``lo``: from where edits are tried."""
    n = F.length("word")
    half = F.floor(n / 2).cast("int")
    both = F.array(F.struct(F.concat(F.lit("f"), "word").alias("s"), half.alias("lo")), F.struct(F.concat(F.lit("b"), F.reverse("word")).alias("s"), (n - half).alias("lo")))
    return words.select(F.explode(both).alias("x")).select("x.s", "x.lo")


def _char(s: Column, i: Column) -> Column:
    """The code point of ``s`` after ``i`` of its own (its trie's letter not counted); '' behind the end."""
    return F.substr(s, i + 2, F.lit(1))


def _tries(sides: DataFrame) -> DataFrame:
    """``(node, term, branches)``: a row a prefix; branches: its next letters, whether they
    end a word, and the letters that follow them.  Both lists are as long as the alphabet at most."""
    size = F.length("s") - 1
    nodes = sides.select("s", F.explode(F.sequence(F.lit(1), size)).alias("i")).select(F.substr("s", F.lit(1), F.col("i") + 1).alias("node"), (F.col("i") == F.length("s") - 1).alias("term"))
    nodes = written(nodes.groupBy("node").agg(F.max("term").alias("term")), "trie-nodes")
    parent = F.substr("node", F.lit(1), F.length("node") - 1)
    own = nodes.groupBy(parent.alias("p")).agg(F.array_join(F.array_sort(F.collect_list(F.right("node", F.lit(1)))), "").alias("kids"))
    rows = written(nodes.join(own, nodes["node"] == own["p"], "left").select("node", "term", F.coalesce("kids", F.lit("")).alias("kids")), "trie-kids")
    branches = rows.groupBy(parent.alias("p")).agg(F.collect_list(F.struct(F.right("node", F.lit(1)).alias("c"), "term", "kids")).alias("branches"))
    out = written(rows.join(branches, rows["node"] == branches["p"], "left").select("node", "term", F.coalesce("branches", F.array().cast("array<struct<c:string,term:boolean,kids:string>>")).alias("branches")), "trie")
    discard(nodes)
    discard(rows)
    return out


def _first_states(sides: DataFrame, trie: DataFrame) -> DataFrame:
    """All states right after an edit that can go on: ``(s, pos, node, done)``."""
    size = F.length("s") - 1
    whole = sides.select("s", F.explode(F.sequence("lo", size)).alias("pos")).select("s", "pos", F.substr("s", F.lit(1), F.col("pos") + 1).alias("node"))
    rows = whole.join(trie, "node")
    left = size - F.col("pos")
    here, then = _char(F.col("s"), F.col("pos")), _char(F.col("s"), F.col("pos") + 1)
    state = lambda node, pos, done: F.struct(node.alias("node"), pos.alias("pos"), done.alias("done"))
    under = lambda x: F.concat(F.col("node"), x["c"])
    goes_on = lambda x, c, last: F.when(last, x["term"]).otherwise(F.contains(x["kids"], c))
    replaced = F.transform(F.filter("branches", lambda x: (left > 0) & (x["c"] != here) & goes_on(x, then, left == 1)), lambda x: state(under(x), F.col("pos") + 1, left == 1))
    inserted = F.transform(F.filter("branches", lambda x: goes_on(x, here, left == 0)), lambda x: state(under(x), F.col("pos"), left == 0))
    can = (left > 0) & F.when(left == 1, F.col("term")).otherwise(F.exists("branches", lambda x: x["c"] == then))
    deleted = F.when(can, F.array(state(F.col("node"), F.col("pos") + 1, left == 1))).otherwise(F.array().cast("array<struct<node:string,pos:int,done:boolean>>"))
    return rows.select("s", F.explode(F.concat(replaced, inserted, deleted)).alias("x")).select("s", "x.pos", "x.node", "x.done")


def _trie_pairs(words: DataFrame) -> DataFrame:
    """``(word, near)`` of words of up to DEPTH code points; may repeat pairs."""
    sides = _sides(words)
    trie = _tries(sides)
    frontier, found = written(_first_states(sides, trie), "trie-frontier"), []
    ends = trie.select(F.col("node").alias("child"), "term")
    while True:
        found.append(frontier.where("done").select("s", "node"))
        going = frontier.where("NOT done")
        if going.isEmpty():
            break
        # One level: the only way on is the word's next letter.
        step = going.select("s", "pos", F.concat("node", _char(F.col("s"), F.col("pos"))).alias("child")).join(ends, "child")
        last = F.col("pos") + 1 == F.length("s") - 1
        frontier = written(step.where(~last | F.col("term")).select("s", (F.col("pos") + 1).alias("pos"), F.col("child").alias("node"), last.alias("done")), "trie-frontier")
    ended = found[0]
    for part in found[1:]:
        ended = ended.unionByName(part)
    text = lambda c: F.when(F.startswith(c, F.lit("f")), F.substr(c, F.lit(2))).otherwise(F.reverse(F.substr(c, F.lit(2))))
    pairs = written(ended.select(text(F.col("s")).alias("word"), text(F.col("node")).alias("near")), "trie-pairs")
    for part in (*found, trie):
        discard(part)
    return pairs


def _polynomial(word: str) -> np.ndarray:
    """Hashes of the word's beginnings, the empty one and the whole word too."""
    points = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    powers = np.full(len(points), _BASE, np.uint64)
    powers[0] = 1
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * np.cumprod(powers))])


def _own_hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"id": np.array([_polynomial(w)[-1] for w in b["word"]], np.uint64).view(np.int64), "word": b["word"]})


def _omissions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per word the hash of itself (at -1), and of itself without the code point at each
    place: from the beginnings' hashes, in one pass over the word."""
    for b in batches:
        for word in b["word"]:
            ahead = _polynomial(word)
            keys = np.concatenate([ahead[-1:], ahead[:-1] + (ahead[-1] - ahead[1:]) * np.uint64(_BACK)]).view(np.int64)
            for i in range(0, len(keys), CHUNK):
                part = keys[i : i + CHUNK]
                yield pd.DataFrame({"id": np.full(len(part), keys[0]), "at": np.arange(i - 1, i - 1 + len(part), dtype=np.int64), "k": part})


def _long_pairs(words: DataFrame) -> DataFrame:
    """``(word, near)`` of words of any length, by hashes with one code point left out."""
    hashes = written(words.select("word").mapInPandas(_omissions, "id long, at long, k long"), "long-words")
    own, cut = hashes.where("at = -1").select("id", "k"), hashes.where("at >= 0")
    a, b = cut.alias("a"), cut.alias("b")
    changed = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.id") != F.col("b.id"))).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), F.col("a.at").alias("at"))
    shorter = cut.join(own.select(F.col("id").alias("y"), "k"), "k").select(F.col("id").alias("x"), "y", "at")
    # A pair has one such place, or a row of equal letters any of which may go.
    links = changed.withColumn("both", F.lit(True)).unionByName(shorter.withColumn("both", F.lit(False))).groupBy("x", "y", "both").agg(F.min("at").cast("int").alias("at"))
    # The words of the ids again, and the exact comparison: one pass over the two.
    texts = written(words.select("word").mapInPandas(_own_hash, "id long, word string"), "long-texts")
    x, y = texts.select(F.col("id").alias("x"), "word"), texts.select(F.col("id").alias("y"), F.col("word").alias("near"))
    without = lambda c: F.concat(F.substr(c, F.lit(1), F.col("at")), F.substr(c, F.col("at") + 2))
    pairs = links.join(x, "x").join(y, "y").where((F.col("word") != F.col("near")) & (without(F.col("word")) == F.when(F.col("both"), without(F.col("near"))).otherwise(F.col("near"))))
    pairs = pairs.select("word", "near").unionByName(pairs.where("NOT both").select(F.col("near").alias("word"), F.col("word").alias("near")))
    out = written(pairs.select("word", "near"), "long-pairs")
    discard(hashes)
    discard(texts)
    return out


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near)``: all ordered pairs of ``word``s (distinct, not empty) one edit apart."""
    n = F.length("word")
    pairs = _trie_pairs(words.where(n <= DEPTH + 1).select("word"))
    far = words.where(n > DEPTH).select("word")
    return pairs.unionByName(_long_pairs(far)).distinct() if not far.isEmpty() else pairs.distinct()


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words(word, n)`` with form, root, n_near and form_n.

    A form has at least ``ratio`` times its word's n, so forms never go round, and the way to
    a root is halved by each round of joins.
    """
    words = written(words.select("word", "n"), "words")
    pairs = near_words(words)
    near = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    fits = F.col("best.near_n") >= ratio * F.col("n")
    rows = words.join(best, "word", "left").select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near_n")).alias("form_n"))
    rows = written(rows, "word-forms")
    discard(pairs)
    discard(words)
    ways = written(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "word-roots")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if ways.join(on, "root", "left_semi").isEmpty():
            break
        longer = written(ways.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "word-roots")
        discard(ways)
        ways = longer
    return rows.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(s))), lambda i: CAST('0x' || substr(hex(encode(s)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS BIGINT) + 1]))"
SQL = {
    "op13_spelling_variants": rf"""WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda x: CAST(x AS BIGINT))), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) tab FROM range(256) t(i)),
 runs AS (SELECT doc_id, translate(unnest(regexp_extract_all("text", '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') r FROM documents),
 grp AS (SELECT doc_id, r, count(*) c, doc_id || ':' || r s FROM runs WHERE length(r) >= 6 GROUP BY 1, 2), hashed AS (SELECT r, c, xor({_CRC}, 4294967295) h FROM grp, tab),
 cut AS (SELECT CASE WHEN h % 199 = 0 THEN r[:CAST(h % length(r) AS BIGINT)] || r[CAST(h % length(r) AS BIGINT) + 2:] ELSE r END w, c FROM hashed),
 words AS (SELECT w, CAST(sum(c) AS BIGINT) n FROM cut WHERE length(w) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
 less AS (SELECT w, n, i, w[:i] || w[i + 2:] v FROM words, range(0, 100) t(i) WHERE i < length(w)),
 pairs AS (SELECT a.w, b.w x, b.n m FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.w <> b.w UNION SELECT a.w, b.w, b.n FROM less a JOIN words b ON a.v = b.w UNION SELECT b.w, a.w, a.n FROM less a JOIN words b ON a.v = b.w),
 best AS (SELECT w, count(*) n_near, arg_min(struct_pack(x := x, m := m), struct_pack(a := -m, b := encode(x))) p FROM pairs GROUP BY 1),
 forms AS (SELECT w, n, coalesce(n_near, 0) n_near, CASE WHEN p.m >= 5 * n THEN p.x END form, CASE WHEN p.m >= 5 * n THEN p.m END form_n FROM words LEFT JOIN best USING (w)),
 walk AS (SELECT w, form AS root FROM forms WHERE form IS NOT NULL UNION ALL SELECT k.w, f.form FROM walk k JOIN forms f ON f.w = k.root WHERE f.form IS NOT NULL),
 ends AS (SELECT k.w, k.root FROM walk k JOIN forms f ON f.w = k.root WHERE f.form IS NULL)
 SELECT w word, form, coalesce(root, w) root, n, n_near, form_n FROM forms LEFT JOIN ends USING (w)"""
}
