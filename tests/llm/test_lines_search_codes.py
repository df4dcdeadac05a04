"""Line dedup, ranked search and vector codes against plain versions, on small tables with awkward rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from terrasphere.llm import lexical_search, line_dedup, vector_codes
from terrasphere.llm.queries import queries
from tests.llm import brute

Q = queries()
BLANKS = " \t\n\x0b\x0c\r"


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def plain_lines(docs, least=10, documents=2):
    key = lambda line: line.strip(BLANKS).translate(brute.LOW)
    split = [(d, (t or "").split("\n")) for d, t in docs]
    holders = defaultdict(list)
    for d, lines in split:
        for k in {key(x) for x in lines}:
            holders[k].append(d)
    out = Counter()
    for d, lines in split:
        kept = []
        for x in lines:
            k = key(x)
            ids = [i for i in holders[k] if i is not None]
            gone = len(k) >= least and len(holders[k]) >= documents and ids and (d is None or d > min(ids))
            if not gone:
                kept.append(x)
        out[(d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def line_documents():
    rng = random.Random(11)
    bank = ["the same line in many places", "  The SAME line in many places \t", "short", "ÉCOLE de la Côte", "école de la côte", "École de la Côte ", "Ünïcode ABC line", "ünïcode abc line", "", "\r", "x" * 4000,
            "exactly10c", "only nine", "tab\tinside the line", "\x0b\x0ca line with odd blanks\r", " not a blank at the end "]
    out = [(k, "\n".join(rng.choice([*bank, f"own line of document {k} number {j}"]) for j in range(rng.randint(0, 12)))) for k in range(60)]
    out += [(None, "the same line in many places\nown"), (None, None), (60, None), (61, ""), (62, "\n"), (63, "\n\nthe same line in many places\n"), (7, "the same line in many places\nother"), out[9], out[9]]
    out += [(64, "\n".join(["the same line in many places", f"filler {rng.random()}"][j % 2] for j in range(6000)))]
    out += [(65, "one line only here\none line only here"), (66, "the same line in many places")]
    return out


def test_line_dedup(spark, tables, tmp_path):
    folder, docs, _ = tables
    got = Q["op11_line_dedup"](spark, folder).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert counted(got) == plain_lines([(d, t) for d, t, _, _ in docs])
    rows = line_documents()
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, h1 int, lines string, first int").repartition(5)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = Q["op11_line_dedup"](spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert counted(got) == plain_lines(rows)


@pytest.mark.parametrize("documents", [2, 5])
def test_line_dedup_with_hot_keys_and_threshold(spark, monkeypatch, documents):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 20)
    rows = line_documents()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    got = line_dedup.without_repeated_lines(frame, documents=documents).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256))
    assert counted(got) == plain_lines(rows, documents=documents)


def test_line_dedup_is_native(spark, tables):
    plan = Q["op11_line_dedup"](spark, tables[0])._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def plain_search(docs, items, best=10):
    words = lambda t: brute.ALNUM_WORDS.findall((t or "").translate(brute.LOW))
    tfs = [Counter(words(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in tfs]
    n_docs, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for c in tfs for w in c)
    asked = defaultdict(Counter)
    for item, text in {(i, t) for i, t in items if i is not None}:
        asked[item] += Counter(words(text))
    out = Counter()
    for item, terms in asked.items():
        scores = []
        for (d, _), c, n in zip(docs, tfs, sizes):
            s = 0
            for w, q in terms.items():
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    s += q * weight * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * (25 + (75 * n * n_docs) // length)))
            if s > 0:
                scores.append((-s, d is None, d or 0))
        for rank, (s, none, d) in enumerate(sorted(scores)[:best], 1):
            out[(item, rank, None if none else d, -s)] += 1
    return out


def search_tables():
    rng = random.Random(12)
    bank = ["".join(rng.choice("abcdeino") for _ in range(rng.randint(1, 3))) for _ in range(120)] + ["Émile", "über", "42"]
    weights = [1 / (k + 1) for k in range(len(bank))]
    text = lambda n: " ".join(rng.choices(bank, weights, k=n)).upper() if n % 3 else " ".join(rng.choices(bank, weights, k=n))
    docs = [(k, text(rng.randint(0, 60))) for k in range(200)]
    docs += [(k, docs[3][1]) for k in range(200, 290)] + [(300, None), (301, "..."), (302, ""), (None, docs[3][1]), (None, None), docs[5], docs[5], (6, text(20)), (303, text(30_000))]
    rng.shuffle(docs)
    items = [(k, text(rng.randint(1, 12))) for k in range(30)] + [(3, text(4)), (31, docs[3][1]), (31, docs[3][1]), (32, None), (33, "zzzz qqqq"), (None, "a b"), (34, "...")]
    return docs, items


def test_lexical_search(spark, tables, tmp_path, monkeypatch):
    folder, docs, items = tables
    got = Q["op12_lexical_search"](spark, folder).select("item_id", "rank", "doc_id", "score")
    assert counted(got) == plain_search([(d, t) for d, t, _, _ in docs], items)
    docs, items = search_tables()
    want = plain_search(docs, items)
    spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, block int, term long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, score string").repartition(2).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert counted(Q["op12_lexical_search"](spark, str(tmp_path))) == want
    # small blocks and bundles: accumulators are cut down early and items are dealt to several bundles
    monkeypatch.setattr(lexical_search, "BLOCK", 16)
    monkeypatch.setattr(lexical_search, "BUNDLE", 7)
    assert counted(Q["op12_lexical_search"](spark, str(tmp_path))) == want


def test_lexical_search_of_texts_as_ids(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "cat")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "RED")], "item_id string, text string")
    got = lexical_search.search(docs, items, best=1).collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in got] == [("q", 1, 2)]


def plain_codes(rows, rounds=4, entries=256):
    """rows: (vec_id, embedding, label)"""
    usable = lambda e: e is not None and len(e) and len(e) % 4 == 0 and all(x is not None and np.isfinite(x) for x in e)
    kept = sorted([(i is None, i or 0, [float(x) for x in e], lab) for i, e, lab in rows if usable(e)], key=lambda r: r[:3])
    if not kept:
        return Counter(), ""
    dim = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == dim]
    v = np.array([[math.floor(1024 * x) for x in r[2]] for r in kept])
    books, own = np.split(v[:entries].copy(), 4, axis=1), []
    parts = np.split(v, 4, axis=1)
    for k in range(rounds + 1):
        own = [((x[:, None] - b[None]) ** 2).sum(axis=2).argmin(axis=1) for x, b in zip(parts, books)]
        if k < rounds:
            for x, b, o in zip(parts, books, own):
                for e in range(len(b)):
                    if (o == e).any():
                        b[e] = x[o == e].sum(axis=0) // (o == e).sum()
    error = sum(((x - b[o]) ** 2).sum(axis=1) for x, b, o in zip(parts, books, own))
    labels = Counter()
    for r, e in zip(kept, error):
        labels[r[3]] += int(e)
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    return Counter((None if r[0] else r[1], "".join(f"{o[k]:02x}" for o in own), int(error[k]), labels[r[3]], sha) for k, r in enumerate(kept))


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    out = [(int(k), [float(x) for x in (centres[k % 9] * 0.4 + rng.normal(size=dim) * 0.05).astype(np.float32)], int(k % 4) if k % 5 else None) for k in range(n)]
    out += [(n + k, out[7][1], 3) for k in range(n // 3)]  # a third are copies of one vector
    out += [(2 * n, None, 1), (2 * n + 1, [], 1), (2 * n + 2, [None] * dim, 1), (2 * n + 3, [float("nan")] * dim, 1), (2 * n + 4, [float("inf")] * dim, 1),
            (None, out[5][1], None), (5, out[6][1], 2), (2 * n + 5, [0.0] * dim, 9), (2 * n + 6, [-0.0] * dim, 9), (2 * n + 7, [0.5] * (dim + 4), 1), (2 * n + 8, [0.5] * (dim + 1), 1)]
    rng.shuffle(out)
    return [(None if i is None else int(i), e, lab) for i, e, lab in out]


@pytest.mark.parametrize("n,dim", [(20, 4), (700, 16), (900, 8)])
def test_vector_codes(spark, tmp_path, n, dim):
    rows = vectors(n, dim, n)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, code int, error string")
    frame.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q["op13_vector_codes"](spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert counted(got) == plain_codes(rows)


def test_balls_hold_their_points_and_agree_with_all_distances():
    rng = np.random.default_rng(8)
    x = np.r_[rng.integers(-900, 900, (1500, 8)), np.repeat(rng.integers(-900, 900, (3, 8)), 200, axis=0)]
    tree = vector_codes.Tree(x)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for a, b, left, right, centre, radius, sums in zip(tree.first, tree.until, tree.left, tree.right, tree.centre, tree.radius, tree.sums):
        points = tree.values[a:b]
        assert (points.sum(axis=0) == sums).all()
        assert np.sqrt(((points - centre) ** 2).sum(axis=1)).max() <= radius + 1e-9
        if left >= 0:
            assert tree.first[left] == a and tree.until[left] == tree.first[right] and tree.until[right] == b
    lists = {c: np.asarray(getattr(tree, c)) for c in ("values", "order", "first", "until", "left", "right", "centre", "radius", "sums")}
    balls = vector_codes.Balls(lists, 8)
    for book in (x[:256], np.r_[x[:5], x[:5], x[-1:], x[-1:]], x[:1]):
        want = ((tree.values[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        ball, entry, point, chosen = balls.owners(book)
        got = np.full(len(x), -1)
        for k, e in zip(ball, entry):
            assert (got[balls.first[k] : balls.until[k]] == -1).all()
            got[balls.first[k] : balls.until[k]] = e
        got[point] = chosen
        assert (got == want).all()
    assert len(ball) == 1  # one entry owns the root


def test_components_too_large_are_refused():
    with pytest.raises(ValueError, match="too large"):
        vector_codes._whole(np.array([[1e9, 0.0, 0.0, 0.0]]))
