"""The training-data operators against brute force, on small awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import ceil, log10

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hostwatch.llm import chat, common, components, decontaminate, line_dedup, lm_score, mixing, near_dedup, quality, repetition, suffix_dedup, warc
from hostwatch.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefgh"):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(k)) for k in ([n] if isinstance(n, int) else n)]


def awkward(seed=0):
    """Copies, near copies, shared passages, nulls, empty, repeated rows, a long text."""
    rng = random.Random(seed)
    base = words(rng, [60] * 12)
    texts = list(base)
    for t in base[:6]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [t, " ".join(w), t.upper(), "start here " + t]
    passage = words(rng, 90)[0]
    texts += [f"{x}\n{passage}\n{y}" for x, y in zip(words(rng, [20] * 5), words(rng, [10] * 5))]
    texts += [None, "", "   ", "\n\n", "one", "one", "Two words", "two WORDS", "x" * 5000, "ab" * 1500, "Größe é café\n" * 40, passage * 30]
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[40], (None, base[0], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).withColumn("key", F.lit("clash")).withColumn("u", F.lit(1)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def brute_near(rows, n, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()

    sets = [(d, shingles(t)) for d, t, *_ in rows]
    comp = {d: d for d, _ in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if d is not None and e is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(d), find(e)))
                comp[b] = a
    return sorted((d, len(s), find(d)) for d, s in sets if d is not None)


@pytest.mark.parametrize("n", [2, 5])
def test_near_dedup(docs, n):
    rows = near_dedup.near_components(docs, n).collect()
    assert sorted(tuple(r) for r in rows if r.doc_id is not None) == brute_near(awkward(), n)
    kept = near_dedup.near_dedup(docs, n)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(x for x in ids if x is not None) == sorted({d for d, _, c in brute_near(awkward(), n) if d == c}) and None in ids


def test_near_dedup_across_components(spark):
    # A chain of edits: neighbours are near, ends aren't, and no document is near all others.
    rng = random.Random(5)
    w = words(rng, 100)[0].split()
    rows = []
    for i in range(40):
        rows.append((i * 7 % 40, " ".join(w), "en", "s", 0))
        w = w[3:] + words(rng, 3)[0].split()
    got = near_dedup.near_components(spark.createDataFrame(rows, DOCS), 2).collect()
    assert sorted(map(tuple, got)) == brute_near(rows, 2)


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    b = np.concatenate([a[:1600], rng.integers(0, 1 << 63, 400).astype(np.uint64)])
    sig = [near_dedup._packed(near_dedup.signature(np.unique(x))[None])[0].tolist() for x in (a, b)]
    got = spark.createDataFrame([tuple(sig)], "p array<long>, q array<long>").select(near_dedup.similarity(F.col("p"), F.col("q")).alias("s")).first().s
    assert abs(got - 1600 / 2400) < 0.1


def brute_lines(rows):
    lines = sorted({(d, i, x) for d, t, *_ in rows if d is not None for i, x in enumerate((t or "").split("\n")) if x.strip(line_dedup.BLANK)})
    n = line_dedup.SHINGLE

    def shingles(x):
        u = x.encode("utf-16-be")
        return {u[2 * i : 2 * i + 2 * n] for i in range(max(len(u) // 2 - n, 0) + 1)}

    texts = sorted({x for _, _, x in lines})
    sets, comp = {x: shingles(x) for x in texts}, {x: x for x in texts}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, x in enumerate(texts):
        for y in texts[:i]:
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                comp[b] = a
    seen, gone = set(), set()
    for d, i, x in lines:
        if find(x) in seen:
            gone.add((d, i))
        seen.add(find(x))
    return gone


def test_line_dedup_across_components(spark):
    # A line edited in 12 places, one a copy, whose first ids are the copies; and two lines
    # near one copy each, but not near the line itself.
    rng = random.Random(3)
    base = words(rng, 60)[0]
    edits = [base[:i] + "#" + base[i + 1 :] for i in range(10, len(base) - 10, len(base) // 12)]
    far = [x[:20] + "@@@@" + x[24:150] + "%%%%" + x[154:] for x in edits[:2]]
    rows = [(i, x, "en", "s", 0) for i, x in enumerate([*edits, *far, base, *words(rng, [20] * 5)])]
    got = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).where("n_removed = 1").collect()}
    assert got == {d for d, _ in brute_lines(rows)} and len(got) >= len(edits)


def test_line_dedup_verifies_few_of_a_large_group(spark, monkeypatch):
    """Lines that are all somewhat alike: the pairs verified grow with their number, not with its square."""
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3])):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "s", 0))
    met, own = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, texts: (met.append(pairs.count()), own(pairs, texts))[1])
    got = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).where("n_removed = 1").collect()}
    assert got == {d for d, _ in brute_lines(rows)}
    assert sum(met) < 20 * len(rows), met


def test_line_dedup_runs_no_python(spark, monkeypatch):
    """No plan of line dedup, of its steps and its result, has a Python or Arrow node."""
    plans, own, keyed = [], line_dedup.written, line_dedup.by_key
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(line_dedup, "written", lambda df, name: (plan(df), own(df, name))[1])
    monkeypatch.setattr(line_dedup, "by_key", lambda df, *args, **kw: (plan(df), keyed(df, *args, **kw))[1])
    rows = [(i, "one two three four five six seven eight" + " nine" * (i % 3), "en", "s", 0) for i in range(30)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).coalesce(1))
    plan(out)
    assert len(plans) > 10 and not [p for p in plans if re.search("Python|Pandas|Arrow", p)]
    assert out.where("n_removed = 0").count() == len({d for d, *_ in rows}) - len(brute_lines(rows))


def test_rehubbed(spark):
    members = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 20), (2, 21)], "h long, id long")
    found = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, component long")
    got = [(r.a, r.b) for r in components.rehubbed(members, found, 0).collect()]
    hub = set.intersection(*map(set, got))
    assert len(got) == 5 and len(hub) == 1 and all((a + b) % 2 for a, b in got)
    turns = {tuple(sorted((r.a, r.b) for r in components.rehubbed(members, found, i).collect())) for i in range(6)}
    assert len(turns) > 1  # another hub
    assert components.rehubbed(members, found.withColumn("component", F.lit(0)), 0).count() == 0


def test_likeliest_and_across(spark):
    pairs = spark.createDataFrame([(1, 2, 5), (1, 3, 9), (2, 3, 1), (4, 5, 0)], "a long, b long, n long")
    got = {(r.a, r.b) for r in components.likeliest(pairs).collect()}
    assert {(1, 3), (1, 2), (4, 5)} <= got <= {(1, 2), (1, 3), (2, 3), (4, 5)}
    found = spark.createDataFrame([(1, 1), (3, 1), (5, 2), (2, 2)], "id long, component long")
    assert {(r.a, r.b) for r in components.across(pairs, found).collect()} == {(1, 2), (2, 3), (4, 5)}


def test_line_dedup(spark, docs, empty):
    # Similarities well away from the threshold's edge, where banding may miss.
    want = brute_lines(awkward())
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns + ["n_removed"]
    texts = {r.doc_id: r.text for r in got.collect()}
    for d, t, *_ in awkward():
        if d is not None:
            assert texts[d] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in want)), d
    assert texts[None] == awkward()[-1][1] and got.count() == docs.count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_short_lines(spark):
    texts = ["Read more\n}\n\t\n一行字", "Subscribe now!\nRead more\n\t\r\n", "一行字\n}\n \nSubscribe now!\nAnd.", "Read more!\n\r"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.text, r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {0: (texts[0], 0), 1: ("Subscribe now!\n\t\r\n", 1), 2: (" \nAnd.", 3), 3: (texts[3], 0)}


def test_line_dedup_recall(spark):
    # Pairs of similarity 0.80 to 0.82: one edit in lines of 90 to 97 characters.
    rng = random.Random(8)
    lines = []
    for i in range(2000):
        x = "".join(rng.choice("abcdefghijklmnop ") for _ in range(90 + i % 8))
        lines += [x, x[:45] + "#" + x[46:]]
    rows = [(i, x, "en", "s", 0) for i, x in enumerate(lines)]
    got = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).where("n_removed = 1").collect()}
    print("missed", 2000 - len(got))
    assert got <= set(range(1, 4000, 2)) and len(got) >= 1998


def brute_spans(texts, n):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        out.append(gone)
    return out


@pytest.mark.parametrize("n", [12, 60, 400])
@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(spark, docs, n, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3000)
    rows = awkward()
    texts = [(t or "").encode() for _, t, *_ in rows]
    raw = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    got = sorted((r.doc_id is not None, r.doc_id or 0, *suffix_dedup.kept_parts(bytes(r.raw), r.los, r.his, n)) for r in suffix_dedup._starts(raw, n, "none").collect())
    want = []
    for (d, *_), t, gone in zip(rows, texts, brute_spans(texts, n)):
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((d is not None, d or 0, bytes(c for c, g in zip(t, gone) if not g), sum(gone), runs))
    assert got == sorted(want)


def test_op9_query(spark):
    # The registered query on a whole given table: brute force, and the SQL beside it.
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.text or "").encode() for r in rows]
    want = []
    for r, t, gone in zip(rows, texts, brute_spans(texts, 400)):
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((r.doc_id, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    assert sorted(map(tuple, suffix_dedup.op9_suffix_dedup(spark, SMALL).collect())) == sorted(want)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert sorted(db.sql(suffix_dedup.SQL["op9_suffix_dedup"]).fetchall()) == sorted(want)


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup_keeps_first(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(3)
    shared = words(rng, 100)[0]
    rows = [(i, f"{a} {shared} {b}", "en", "s", 0) for i, (a, b) in enumerate(zip(words(rng, [30] * 6), words(rng, [30] * 6)))] + [(9, shared, "", "", 0), (10, "z" * 900, "", "", 0)]
    got = {r.doc_id: r.text for r in suffix_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0] == rows[0][1] and got[9] == "" and len(got[10]) == 1
    for i in range(1, 6):
        assert shared[10:-10] not in got[i] and len(got[i]) <= len(rows[i][1]) - len(shared)


def test_suffix_tools():
    rng = random.Random(2)
    raw = "".join(rng.choice("ab") for _ in range(400)).encode()
    for n in (3, 8, 11, 20):
        pos, cls = suffix_dedup.repeated_prefixes(np.frombuffer(raw, np.uint8), np.full(400, 400), n)
        seen = Counter(raw[i : i + n] for i in range(400 - n + 1))
        assert sorted(pos) == [i for i in range(400 - n + 1) if seen[raw[i : i + n]] > 1]
        assert [(raw[p : p + n], p) for p in pos] == sorted((raw[p : p + n], p) for p in pos)
        before, after = suffix_dedup.previous_and_next(cls)
        for p, x, y in zip(pos, before, after):
            assert x == (raw.find(raw[p : p + n]) < p) and y == (raw.rfind(raw[p : p + n]) > p)


def test_repetition():
    rng = random.Random(4)
    texts = [t.encode() if t is not None else None for _, t, *_ in awkward()] + [b"a b c d e f g h " * 9, b"a " * 50, (words(rng, 40)[0] + " " + words(rng, 12, "ab")[0] * 3).encode()]
    for t, got in zip(texts, repetition._judged(texts)):
        w = (t or b"").split()
        n = len(w)
        seen = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
        hit = {j for i in range(n - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (t or b"").split(b"\n") if x.strip()]
        failed = n < 20 or 100 * len(hit) > 30 * n
        assert got[:6] == (n, sum(len(x.decode()) for x in w), sum(c in b"#*$%&<>|" for c in t or b""), len(lines) - len(set(lines)), len(hit), failed)
        best = 0
        for i in range(n):
            for j in range(i):
                k = 0
                while i + k < n and w[i + k] == w[j + k]:
                    k += 1
                best = max(best, k)
            if n > 300:
                break
        if n <= 300:
            assert got[8] == (best if best >= repetition.MIN_WORDS else 0)
            found = Counter(tuple(w[i : i + k]) for k in range(repetition.MIN_WORDS, n) for i in range(n - k + 1))
            at = {x: [i for i in range(n - len(x) + 1) if tuple(w[i : i + len(x)]) == x] for x, m in found.items() if m > 1}
            wide = lambda x, d: {w[i + d(x)] if 0 <= i + d(x) < n else (i, d(x)) for i in at[x]}  # noqa: E731, B023
            maximal = [x for x in at if len(wide(x, len)) > 1 and len(wide(x, lambda _: -1)) > 1]
            assert got[9] == len(maximal)
            span = {j for x in maximal for i in at[x] for j in range(i, i + len(x))}
            share = sum(len(w[j].decode()) for j in span) / max(got[1], 1)
            assert got[7] == pytest.approx(share) and got[6] == (not failed and share <= repetition.MAX_COVERED and best <= repetition.MAX_LONGEST)
        assert not (failed and got[6])


def test_repetition_verdict_beyond_the_base_rule():
    # Short repeats all over, and one long passage twice in a long text: no 30 % in 8-word windows.
    rng = random.Random(7)
    short, tail = words(rng, [5] * 12), words(rng, [2] * 96, "klmnop")
    many = " ".join(f"{short[i % 12]} {x}" for i, x in enumerate(tail))
    long = words(rng, 70)[0]
    twice = " ".join([words(rng, 250)[0], long, words(rng, 250)[0], long, words(rng, 250)[0]])
    plain = words(rng, 300)[0]
    for text, kept in ((many, False), (twice, False), (plain, True)):
        (got,) = repetition._judged([text.encode()])
        assert not got[5] and got[6] == kept


def test_repetition_rows(docs, empty):
    out = repetition.judge(docs)
    assert out.count() == docs.count() and set(docs.columns) < set(out.columns)
    assert repetition.judge(empty).count() == 0


def test_quality(spark, docs, empty):
    rng = random.Random(6)
    good = [(i, ". ".join(words(rng, [12] * 6)), "en", "s", 0) for i in range(300)]
    bad = [(i + 1000, " ".join(x + "$$$" for x in words(rng, 60)[0].split()), "en", "s", 0) for i in range(300)]
    table = spark.createDataFrame(good + bad, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in good + bad if r[0] % 2] + [(None, 1), (5, None), (99999, 1)], "doc_id long, quality int")
    trees = quality.train(table, labels)
    rows = quality.classify(table, trees).collect()
    held = [r for r in rows if r.doc_id % 2 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id < 1000) for r in held) > 0.98 * len(held)
    again = {r.doc_id: r.score for r in quality.classify(table, quality.train(table, labels)).collect()}
    assert again == {r.doc_id: r.score for r in rows}
    odd = quality.classify(docs, trees)
    assert odd.columns == docs.columns + ["score"] and all(0 <= r.score <= 1 for r in odd.collect()) and odd.count() == docs.count()
    assert quality.classify(empty, quality.train(empty, labels.limit(0))).count() == 0
    assert quality.classify(docs, quality.train(docs, labels.limit(0))).agg(F.min("score")).first()[0] == pytest.approx(0.5)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "\\\\</s>", "<s><|>[INST", "é漢字🙂 ok", "", None, "<<s>>[[INST]]", "a\\"]
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate(zip(random.Random(c).choices(["user", "assistant", "system", "<|>\\", None], k=6), random.Random(c + 99).choices(nasty, k=6)))]
    rows += [rows[0], (None, None, "assistant", "null conversation"), (77, 0, "assistant", None)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert len(out) == len(by)
    for r in out:
        want = [(a, b) for _, _, a, b in sorted(by[r.conv_id])]
        assert chat.parse(r.text) == want
        under = set()
        for lo, hi in zip(r.loss_starts, r.loss_ends):
            under |= set(range(lo, hi))
        assert chat.unescape("".join(r.text[i] for i in sorted(under))) == "".join(b for a, b in want if a == "assistant")
        assert len(r.token_ids) == len(r.loss) == len(r.starts) and sum(r.loss) == len(r.loss_starts)


def test_decontaminate(spark, docs, empty):
    rows = awkward()
    items = [(1, " ".join((rows[0][1] or "").split()[5:25])), (2, "two words"), (3, None), (4, "..."), (5, "one"), (6, " ".join(rows[2][1].upper().split()[:12])), (7, "größe É"), (2, "two words"), (8, "no such text at all in any of these documents, sir")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    import re

    def toks(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    want = []
    for d, t, *_ in rows:
        w, hit, found = toks(t), set(), set()
        for item, text in items:
            b = toks(text)
            k = min(10, len(b))
            wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted((tuple(r) for r in decontaminate.contamination(docs, bench).collect()), key=key)
    assert got == sorted(want, key=key) and sum(r[5] for r in got) > 5
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r[5] for r in want)
    cut = decontaminate.decontaminate(docs, bench, "spans")
    assert cut.count() == docs.count()
    for r in cut.collect():
        n, k = next((w[1], w[2]) for w in want if w[0] == r.doc_id)
        assert len(toks(r.text)) == n - k
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def test_decontaminate_lowers_only_ascii(spark):
    # Final sigma, dotted I, Kelvin: equal words are hits whatever stands around them, others aren't.
    items = spark.createDataFrame([(1, "ΟΔΟΣ"), (2, "İzmir KELVIN"), (3, "οδος"), (4, "\u212aelvin")], "item_id long, text string")
    rows = [(1, "ΟΔΟΣ.Α x"), (2, "ΟΔΟΣ x"), (3, "ΟΔΟΣΑ"), (4, "οδος-β"), (5, "οδοσ"), (6, "İZMIR kelvin"), (7, "i̇zmir kelvin"), (8, "izmir kelvin"), (9, "\u212aELVIN"), (10, "kelvin")]
    got = decontaminate.contamination(spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], DOCS), items)
    assert {r.doc_id for r in got.where("contaminated").collect()} == {1, 2, 4, 6, 9}


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 2000
    pages = [(1, "http://a/", big), (2, None, big), (3, "http://b/\n", "small"), (4, "u", "small"), (5, "u", None), (6, "é", "ü" * 800), (7, "u", ""), (None, "u", big), (9, "u", big + "y"), (9, "u", big + "y")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_bundles(warc.payloads(table), folder)
    got = warc.read_bundles(manifest, folder).collect()
    assert len(got) == len(pages) == manifest.count()
    for r in got:
        html = next(h for p, _, h in pages if p == r.page_id) or ""
        assert r.payload_digest == hashlib.sha1(html.encode()).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 2) if r.page_id == 1 else ("response", None))
        assert bytes(r.payload) == (b"" if r.page_id == 1 else html.encode())
    assert manifest.select("bundle", "frame").distinct().count() < len(pages)  # records are grouped
    row = manifest.where("page_id = 6").first()  # one record by its offset inside its frame
    import pyarrow as pa
    import zstandard

    raw = open(f"{tmp_path}/warc/{row.bundle}", "rb").read()
    where, c, d = warc.read_seek_table(pa.BufferReader(raw))[row.frame]
    frame = zstandard.decompress(raw[where : where + c])
    fields, payload = warc.read_record(frame[row.offset : row.offset + row.length])
    assert len(frame) == d and payload == ("ü" * 800).encode() and fields["WARC-Date"].endswith("Z")
    assert b"WARC-Type: warcinfo" in zstandard.decompress(raw[: warc.read_seek_table(pa.BufferReader(raw))[0][1]])
    assert warc.read_bundles(warc.write_bundles(warc.payloads(table.limit(0)), folder), folder).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 997, "b": 1, "c": 1, "d": 1}, {f"s{i}": i + 1.0 for i in range(30)}])
def test_pfair_period(weights):
    parts = mixing.whole_parts(weights)
    assert sum(parts.values()) == mixing.PARTS and all(parts.values())
    made = mixing.period(parts)
    assert sorted(t for _, _, t in made) == list(range(mixing.PARTS))
    took = Counter()
    for s, k, slot in sorted(made, key=lambda x: x[2]):
        assert k == took[s]
        took[s] += 1
        for x in parts:  # less than one block from the share, at every slot
            assert abs(took[x] - (slot + 1) * parts[x] / mixing.PARTS) < 1
    assert took == parts


def test_mixing(spark, docs, empty):
    rows = [(i, "t", "en", None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}", 0) for i in range(3000)] + [(None, "t", "en", "hot", 0), (7, "t", "en", "hot", 0)]
    table = spark.createDataFrame(rows, DOCS).withColumn("first", F.lit("clash"))
    got = mixing.mix(table, block=4)
    assert got.columns == table.columns + ["phase", "slot", "place"]
    got = got.collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[3]) for r in rows)
    assert len({(r.slot, r.place) for r in got}) == len(rows)
    sizes = Counter(r[3] or "" for r in rows)
    for s, n in sizes.items():  # a source's blocks in order, full but the last
        own = sorted((r.slot, r.place) for r in got if (r.source or "") == s)
        assert [p for _, p in own] == [i % 4 for i in range(n)]
    first = [r for r in got if r.phase == 0]
    slots, took = {r.slot: r.source or "" for r in first}, Counter()
    total = sum(n**0.5 for n in sizes.values())
    for t in range(max(slots) + 1):  # against the target weights themselves, as the method promises
        took[slots[t]] += 1
        for s, n in sizes.items():
            assert abs(took[s] - (t + 1) * n**0.5 / total) < 1 + 1e-9
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("weights", [{"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 0.9} | {f"s{i}": 0.001 + i / 1e6 for i in range(99)}, {"hot": 1e6**0.5} | {f"s{i}": (1e5 + 7 * i) ** 0.5 for i in range(19)}])
def test_mixing_follows_target_weights(weights):
    # Against the weights themselves, in the first phase of 12,000 slots or so.
    total, blocks = sum(weights.values()), {s: ceil(12_000 * w / sum(weights.values())) for s, w in weights.items()}
    took = Counter()
    made = list(mixing.schedule(blocks, mixing.exact_parts(weights)))
    assert [slot for *_, slot in made] == list(range(sum(blocks.values())))
    first = [x for x in made if x[2] == 0]
    assert len(first) > 10_000
    for s, k, _, slot in first:
        assert k == took[s]
        took[s] += 1
        assert all(abs(took[x] - (slot + 1) * w / total) < 1 + 1e-6 for x, w in weights.items())
    assert Counter(s for s, *_ in made) == blocks


def test_mixing_has_no_limit_of_sources(spark):
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1200).alias("source"))
    got = mixing.mix(table, block=2).collect()
    assert len(got) == 3000 and len({(r.slot, r.place) for r in got}) == 3000
    assert {r.slot for r in got} == set(range(600 * 2 + 600))


def test_discard_takes_written_tables_only(spark, tmp_path):
    rows = spark.range(5)
    mine = common.written(rows, "mine")
    rows.write.parquet(f"{tmp_path}/other")
    other = spark.read.parquet(f"{tmp_path}/other")
    for df in (other, mine.unionByName(other)):
        with pytest.raises(ValueError):
            common.discard(df)
    assert mine.count() == other.count() == 5
    common.discard(mine)
    with pytest.raises(Exception, match="(?i)not.?exist"):
        mine.count()


def test_ranks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    table = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(500)], "doc_id long, source string")
    for s, n in (("a", 333), ("b", 167)):
        assert sorted(r.rank for r in mixing.ranked(table, mixing.source_sizes(table), "of", "rank").where(F.col("source") == s).collect()) == list(range(n))


def test_lm_scores(spark, docs):
    rows = awkward()
    out = lm_score.score(docs.select("doc_id", "text"), F.coalesce(F.col("doc_id") % 5 != 2, F.lit(True))).collect()
    toks = lambda t: (t or "").encode().lower().split() + [b""]
    count = Counter(x for d, t, *_ in rows if d is None or d % 5 != 2 for x in toks(t))
    n, v = sum(count.values()), len(count)
    assert len(out) == len(rows)
    for r in out:
        t = next(t for d, t, *_ in rows if d == r.doc_id)
        assert r.n_tokens == len(toks(t)) and r.n_known == sum(count[x] > 0 for x in toks(t)) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(log10((count[x] + 1) / (n + v + 1)) for x in toks(t)))
        assert r.score < 0
    assert lm_score.score(docs.select("doc_id", "text").limit(0), F.lit(True)).count() == 0


def test_op8_query(spark):
    rows = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in rows}
    count = Counter(x for d, w in rows.items() if not held[d] for x in w)
    n, v = sum(count.values()), len(count)
    out = lm_score.op8_lm_score(spark, SMALL).collect()
    assert len(out) == len(rows)
    for r in out:
        w = rows[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(log10((count[x] + 1) / (n + v + 1)) for x in w))
    # Better than the unigram base on documents it hasn't seen.
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)


def test_op7_query(spark):
    # Every document once; a slot is one source's; counts stay within a block of the weights.
    docs = {r.doc_id: r.source or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = mixing.op7_mixing(spark, SMALL).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    of = {}
    for r in out:
        assert of.setdefault(r.slot, (r.phase, docs[r.doc_id])) == (r.phase, docs[r.doc_id])
    assert sorted(of) == list(range(len(of)))
    sizes, start = Counter(docs.values()), 0
    left = {s: ceil(n / mixing.BLOCK) for s, n in sizes.items()}
    for phase in sorted({p for p, _ in of.values()}):
        slots = [of[i][1] for i in sorted(of) if of[i][0] == phase]
        live = {s: sizes[s] ** 0.5 for s, k in left.items() if k}
        assert [of[i][0] for i in range(start, start + len(slots))] == [phase] * len(slots)
        done = Counter()
        for t, s in enumerate(slots, 1):
            done[s] += 1
            assert all(abs(done[x] - t * w / sum(live.values())) < 1 + 1e-9 for x, w in live.items())
        left = {s: k - done[s] for s, k in left.items()}
        start += len(slots)
    assert not any(left.values())


def test_lm_learns_from_every_slice(spark):
    # Each eighth of the hash has a word of its own; each word's weights must have moved.
    at = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    text = F.repeat(F.concat(F.lit("w"), at.cast("string"), F.lit(" ")), 20)
    raw = spark.range(200).select(F.col("id").alias("doc_id")).select("doc_id", text.cast("binary").alias("raw"))
    share = np.ones(lm_score.VOCABULARY)
    model, first = lm_score.train(raw, {b"w%d" % i: 2 + i for i in range(8)}, share, 4200), lm_score.first_model(share)
    assert [i for i in range(8) if np.array_equal(model["x"][2 + i], first["x"][2 + i])] == []


def test_lm_depends_on_the_documents_only(spark, monkeypatch):
    # The same rows in other partitions and another order: the same copies, the same sums.
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 300)
    rows = [(d, t) for d, t, *_ in awkward()]
    found = []
    for n in (1, 6, 41):
        table = spark.createDataFrame(random.Random(n).sample(rows, len(rows)), "doc_id long, text string").repartition(n)
        out = lm_score.score(table, F.lit(True)).collect()
        found.append(sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.score) for r in out))
    for other in found[1:]:
        assert [x[:4] for x in other] == [x[:4] for x in found[0]]
        assert [x[4] for x in other] == pytest.approx([x[4] for x in found[0]], rel=1e-5)


def test_commonest_words_when_all_are_alike(spark):
    counts = spark.range(20_000).select(F.col("id").cast("string").cast("binary").alias("word"), F.when(F.col("id") < 50, 900 - F.col("id")).otherwise(3).alias("c"))
    got = lm_score.commonest(counts, 1000)
    assert [r.c for r in got[:50]] == list(range(900, 850, -1)) and abs(len(got) - 1000) < 150
    assert lm_score.commonest(counts.where("id >= 50"), 1000)
    assert [r.c for r in lm_score.commonest(counts.where("id < 50"), 1000)] == list(range(900, 850, -1))
    assert lm_score.commonest(counts.where("id < 0"), 1000) == []


def test_lm_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    share = np.ones(lm_score.VOCABULARY)
    m = lm_score.first_model(share)
    h = rng.standard_normal((3, lm_score.HIDDEN)).astype(np.float32)
    total = sum(np.exp(lm_score._output(m, h, np.full(3, y), None)[0]) for y in range(lm_score.VOCABULARY))
    assert np.allclose(total, 1, atol=1e-3)
    seq = [np.array([2 + (a + i) % 9 for i in range(60)] + [1], np.int16) for a in rng.integers(0, 9, 400)]
    after, n = lm_score.train_documents(m, seq)
    assert n == 400 * 61
    held = [np.array([2 + i % 9 for i in range(200)] + [1], np.int16)]
    assert lm_score.score_documents(after, held)[0] > 0.5 * lm_score.score_documents(m, held)[0]
    one = lm_score.score_documents(after, seq[:7])
    assert np.allclose(one, [lm_score.score_documents(after, [s])[0] for s in seq[:7]], rtol=1e-4)


def test_lm_gradient():
    rng = np.random.default_rng(1)
    m = {k: v.astype(np.float64) for k, v in lm_score.first_model(np.ones(lm_score.VOCABULARY)).items()}
    xs, y = rng.integers(0, 50, (4, 3)), rng.integers(0, 50, (4, 3))
    reset, h0 = np.ones((4, 3)), rng.standard_normal((3, lm_score.HIDDEN)) * 0.3

    def loss():
        s, _, _ = lm_score._steps(m, xs, reset, h0, False)
        return -lm_score._output(m, s.reshape(-1, lm_score.HIDDEN).astype(np.float64), y.ravel(), None)[0].sum()

    grads = {k: np.zeros_like(v) for k, v in m.items()}
    s, _, saved = lm_score._steps(m, xs, reset, h0, True)
    _, d = lm_score._output(m, s.reshape(-1, lm_score.HIDDEN).astype(np.float64), y.ravel(), grads)
    lm_score._backward(m, xs, saved, d.reshape(s.shape), reset, grads)
    for k, i in (("x", (int(xs[0, 0]), 3)), ("u", (2, 40)), ("u", (5, 20)), ("c", (1, 0)), ("x", (int(xs[2, 1]), 20))):
        m[k][i] += 1e-3
        up = loss()
        m[k][i] -= 2e-3
        down = loss()
        m[k][i] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(grads[k][i], rel=0.05, abs=2e-2)


def test_crc_is_what_spark_computes(spark):
    got = spark.range(50).select("id", F.crc32(F.col("id").cast("string").cast("binary")).alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in got)


def hash_of(x):
    return zlib.crc32(str(x).encode())


def test_prefix_pairs_lose_nothing(spark):
    # Sets of one group, each a component of its own: every pair of similarity 0.8 is among the candidates.
    rng = random.Random(12)
    sets = {}
    for i in range(60):
        base = set(range(1000 * (i // 12), 1000 * (i // 12) + 60 + 3 * (i % 4)))
        gone = rng.sample(sorted(base), rng.randrange(0, 12))
        sets[i] = (base - set(gone)) | {rng.randrange(10**6) for _ in range(rng.randrange(0, 8))} | ({7, 8} if i % 3 else set())
    rows = [(i, i, 0, s) for i, x in sets.items() for s in x]
    got = {(r.a, r.b) for r in components.prefix_pairs(spark.createDataFrame(rows, "id long, c long, g long, s long")).collect()}
    near = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert near and near <= got and len(got) < 60 * 59 / 2


def test_prefix_pairs_meet_once(spark, monkeypatch):
    """Sets that share many elements of their prefixes: the join has hardly more rows than pairs, and loses none."""
    rng = random.Random(4)
    kinds = [[f"{k}.{i}" for i in range(14)] for k in range(8)]
    sets = {i: {*range(100), *(x for k in rng.sample(kinds, 3) for x in k if rng.random() > 0.1)} for i in range(60)}
    rows = [(i, i, 0, hash_of(x)) for i, s in sets.items() for x in s]
    members = spark.createDataFrame(rows, "id long, c long, g long, s long").coalesce(4)
    met = [(r.a, r.b) for r in components.prefix_meetings(members).collect()]
    monkeypatch.setattr(components, "BACK", 0)
    before = [(r.a, r.b) for r in components.prefix_meetings(members).collect()]
    near = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert near and near <= set(met) == set(before) and len(met) < 1.5 * len(set(met)) and 2 * len(met) < len(before)


CLASH = ["u", "d", "w", "los", "his", "raw", "s", "b", "n", "at", "key", "mine", "theirs", "covered", "of", "rank", "order", "range", "count", "before", "x", "k", "h", "c"]
ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "a"), (4, "a"), (4, "one other text of the same id\nwith a line that stands here and in another document"), (None, None), (None, "no id"), (5, "w" * 30_000), (6, " ".join(f"w{i}" for i in range(4000))), (7, "with a line that stands here and in another document\nand one more")]
OPERATORS = {
    "lines": line_dedup.dedup_lines, "near": near_dedup.near_dedup, "rules": repetition.judge, "suffix": suffix_dedup.dedup, "mix": mixing.mix,
    "clean": lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([(1, "one other text of"), (2, None)], "item_id long, text string")),
    "quality": lambda d: quality.classify(d, quality.train(d, d.sparkSession.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    # Nulls, empty and very long texts, repeated rows and ids, clashing names, no rows.
    table = spark.createDataFrame([(d, t, "en", None if d == 3 else "s", 0) for d, t in ODD], DOCS).withColumns({c: F.lit("mine") for c in CLASH})
    out = OPERATORS[name](table)
    assert set(table.columns) <= set(out.columns)
    rows = out.collect()
    assert all(r[c] == "mine" for r in rows for c in CLASH)
    want = {"near": len(ODD) - 1, "clean": len(ODD) - 1}.get(name, len(ODD))  # a repeated row; a contaminated row
    assert len(rows) == want
    assert OPERATORS[name](table.limit(0)).count() == 0
    if name == "lines":
        texts = Counter((r.doc_id, r.text) for r in rows)
        assert texts[(4, "a")] == 2 and texts[(7, "and one more")] == 1 and texts[(4, ODD[5][1])] == 1


def test_line_dedup_of_repeated_ids(spark):
    # Of rows (1, A) and (1, B) only A is known from an earlier document: B stays.
    rows = [(0, "a line of a text", "", "", 0), (1, "a line of a text", "", "", 0), (1, "something else here", "", "", 0)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(0, rows[0][1]), (1, ""), (1, rows[2][1])]


def test_trees_follow_a_plain_walk():
    rng = np.random.default_rng(3)
    x = rng.random((600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = quality.fit(x, y)

    def walk(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - (2**quality.DEPTH - 1)]
        return 1 / (1 + np.exp(-total))

    got = trees.score(x)
    assert np.allclose(got, [walk(r) for r in x]) and ((got > 0.5) == y).mean() > 0.9


def test_lm_score_is_the_sum_of_its_steps():
    # One document, a step at a time, in plain loops.
    m, doc = lm_score.first_model(np.ones(lm_score.VOCABULARY)), [5, 900, 40, 0, 5, 1]
    h, before, total = np.zeros(lm_score.HIDDEN), lm_score.END, 0.0
    n = lm_score.HIDDEN
    for i, y in enumerate(doc):
        h = h * (i > 0)
        a, b = m["x"][before], h @ m["u"]
        z, r = 1 / (1 + np.exp(-(a[:n] + b[:n]))), 1 / (1 + np.exp(-(a[n : 2 * n] + b[n : 2 * n])))
        h = (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :]) + z * h
        for s, j in ((h @ m["c"] + m["cb"], y // lm_score.WIDTH), (h @ m["w"][y // lm_score.WIDTH] + m["wb"][y // lm_score.WIDTH], y % lm_score.WIDTH)):
            total += s[j] - np.log(np.exp(s).sum())
        before = y
    assert lm_score.score_documents(m, [np.array(doc, np.int16)])[0] == pytest.approx(total, rel=1e-4)
