"""Token counts, fill-in-middle and spelling variants, and their queries, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hostwatch.llm import fim, token_counts, variants
from tests.llm.test_operators import DOCS, awkward

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns of clashing names."""
    rng = random.Random(5)
    mix = ["a", " ", "\n", "▁", "é", "the", "  ", "\0", "<s>", "</s>", "<unk>", "日本", "😀", "\t", "<P", "<S>", "<M", ">", "Straße", "\r\n"]
    rows = [(1000 + i, "".join(rng.choice(mix) for _ in range(rng.randrange(14))), "en", None, 0) for i in range(400)]
    rows += [(5, "y" * 200_000, None, None, None), (6, "ab\n" * 60_000, None, None, None), (7, "é\n😀" * 30_000, None, None, None), (8, "\n", "", "", 1), (9, "x\n\n\ny", "", "", 1)]
    out = spark.createDataFrame(awkward() + rows, DOCS)
    for c in ("n", "n_tokens", "output", "form", "raw", "ids", "word", "key", "id"):
        out = out.withColumn(c, F.lit("clash"))
    return out.repartition(5)


def test_token_counts(spark, odd):
    from sentencepiece import SentencePieceProcessor
    import public_tokenizers

    library = SentencePieceProcessor(model_file=str(public_tokenizers.path(token_counts.MODEL)))
    want = Counter((r.doc_id, r.text, len(library.encode(r.text or ""))) for r in odd.collect())
    for frequent in (None, {}):  # both tiers, and the caches alone
        made = token_counts.count_tokens(odd, frequent=frequent)
        assert Counter((r.doc_id, r.text, r.n_tokens) for r in made.collect()) == want
        assert made.columns == odd.columns
    few = token_counts.frequent_lengths(odd)
    assert few and len(few) <= token_counts.FREQUENT and all(len(k) <= token_counts.KEY_CHARS for k in few)
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def test_token_summaries_are_bounded(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(token_counts, "CACHED", 50)
    texts = [f"often w{i} also v{i}" for i in range(1000)] + ["z" * 1000]
    (top,) = token_counts._summaries(token_counts.MODEL, "t")(iter([pd.DataFrame({"t": texts})]))
    assert {"often", "also"} <= set(top["key"]) and len(top) <= 50


def test_op11_query(spark, texts):
    from sentencepiece import SentencePieceProcessor
    import public_tokenizers

    library = SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = []
    for d, t in texts:
        n = len(library.encode(t or ""))
        want.append((d, len((t or "").encode()), n, n > 4096))
    got = token_counts.op11_token_counts(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def brute_fim(doc_id, text, fim_percent=100):
    """Cuts by code points, as the rule says, without bytes or an index."""
    t, ids = text or "", "" if doc_id is None else str(doc_id)
    h = hashlib.sha256(f"7:{ids}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_percent:
        return t, "plain", n, None, None
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    return (f"<S>{s}<P>{p}<M>{m}", "spm", n, len(p), len(m)) if h4 % 100 < 50 else (f"<P>{p}<S>{s}<M>{m}", "psm", n, len(p), len(m))


def test_exceptions_both_ways():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a", "é", "日", "😀", "\n", "xyz" * 5]) for _ in range(rng.randrange(30)))
        data = text.encode()
        index = fim.Exceptions(data)
        assert len(index.at) == sum(ord(c) > 127 for c in text)
        at = [len(text[:i].encode()) for i in range(len(text) + 1)]
        assert [index.to_points(b) for b in at] == list(range(len(text) + 1))
        assert [index.to_bytes(i) for i in range(len(text) + 1)] == at


@pytest.mark.parametrize("percent", [100, 40, 0])
def test_fill_in_middle(odd, percent):
    made = fim.fill_in_middle(odd, fim=percent)
    made = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.text, r.output, r.form, r.n, r.prefix_chars, r.middle_chars) for r in made) == Counter((r.doc_id, r.text, *brute_fim(r.doc_id, r.text, percent)) for r in odd.collect())
    assert all(r.back == (r.text or "") for r in made)
    assert {r.form for r in made} == ({"plain"} if not percent else {"plain", "psm", "spm"})
    assert fim.fill_in_middle(odd.limit(0)).count() == 0


def test_op12_query(spark, texts):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for d, t in texts:
        out, form, n, p, m = brute_fim(d, t)
        want.append((d, n, form, p, m, sha(out), sha(t or "")))
    assert sorted(map(str, map(tuple, fim.op12_fill_in_middle(spark, SF).collect()))) == sorted(map(str, want))


def brute_words(rows):
    seen = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            seen[low if h % 199 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def brute_groups(words):
    """By every word's remainders without one code point, all of them in one dict."""
    by, near = defaultdict(set), defaultdict(set)
    for w in words:
        by[w].add((w, -1))
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add((w, i))
    for group in by.values():
        for a, i in group:
            for b, j in group:
                if a != b and (i == j or i < 0 or j < 0):
                    near[a].add(b)
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * n:
            forms[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(near[w]), words[forms[w]] if w in forms else None))
    return sorted(out, key=str)


def test_group_variants(spark):
    rng = random.Random(3)
    words = {}
    for _ in range(400):
        w = "".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 7, 8, 12, 23, 24, 25, 26, 27, 60])))
        words[w] = rng.choice([5, 6, 30, 40, 200, 1000])
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé÷") + w[i + 1 :], w[:i] + rng.choice("abz") + w[i:], w[:i] + w[i:][1:2] + w[i : i + 1] + w[i + 2 :]])
            words.setdefault(v, rng.choice([5, 5, 8, 50, 5000]))
    long = "".join(rng.choice("xyz") for _ in range(120_000))
    words |= {long: 50, long[:70_000] + "q" + long[70_001:]: 5, long[:-1]: 7, long[5:]: 9}
    words = {w: n for w, n in words.items() if len(w) >= 6}
    rows = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("form", F.lit("clash"))
    got = variants.group_variants(rows)
    short = {w: n for w, n in words.items() if len(w) < 1000}
    want = [*brute_groups(short), (long, None, long, 50, 2, None), (long[:70_000] + "q" + long[70_001:], long, long, 5, 1, 50), (long[:-1], long, long, 7, 1, 50), (long[5:], None, long[5:], 9, 0, None)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert len({r[1] for r in want}) > 20 and any(r[1] != r[2] for r in want if r[1])
    assert variants.group_variants(rows.limit(0)).count() == 0


def test_op13_query(spark, texts, odd):
    got = variants.op13_spelling_variants(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups(brute_words(texts))
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert {r.word: r.n for r in variants.count_words(odd).collect()} == brute_words(rows)
