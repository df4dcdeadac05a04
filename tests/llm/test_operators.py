"""Every operator's query against a plain version, on small tables with awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from terrasphere.llm import contamination, main_text, packing, personal_data, quality, repeated_spans, suffixes, tokens
from terrasphere.llm.queries import queries
from tests.llm import brute

Q = queries()


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def pairs(docs):
    return [(d, t) for d, t, _, _ in docs]


@pytest.mark.parametrize("name", sorted([*Q, "pipeline"]))
def test_empty_tables(spark, empty_tables, name):
    fn = Q.get(name) or corpus_pipeline.run
    assert fn(spark, empty_tables).collect() == []


def test_near_copies(spark, tables):
    folder, docs, _ = tables
    got = Q["op2_near_copies"](spark, folder).select("doc_id", "n_shingles", "component_id", "kept")
    assert counted(got) == brute.near_copies(pairs(docs))


def test_contamination(spark, tables):
    folder, docs, items = tables
    got = Q["op3_contamination"](spark, folder).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert counted(got) == brute.contamination(pairs(docs), items)


def test_token_files_round_trip(spark, tables):
    folder, docs, _ = tables
    got = Q["op4_token_files"](spark, folder).collect()
    ordered = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at = Counter(), 0
    for (doc, _), ids in zip(ordered, brute.token_ids([t for _, t in ordered])):
        want[(doc, at, len(ids), brute.crc(ids))] += 1
        at += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_encoder_equals_whole_texts():
    import pyarrow as pa

    texts = ["Don't stop<|endoftext|>now. <|startoftext|>", "it's 3.14=x… …. é≠ Å.B ≮", "a b c\x85d\x0be", "ÉCOLE ΣΑΣ. İ! I'LL we'Ve '' '.' .'s", "x.y,z;w:1!2?3*4$5%6&7#(8)\"9=+/@-0", "", None, "日本語、テスト。🙂🙂 .🙂a", "|a| <b> a|b <|x|>"]
    ids, bounds = tokens.Encoder(tokens.vocabulary()).encode(pa.array(texts))
    for want, a, b in zip(brute.token_ids(texts), bounds, bounds[1:]):
        assert ids[a:b].tolist() == want.tolist()


def test_quality(spark, tables):
    folder, docs, _ = tables
    got = Q["op5_quality"](spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in pairs(docs))
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    junk = {d for d, t in pairs(docs) if "###" in (t or "")}
    scores = {k: [r.score for r in got if r.doc_id is not None and (r.doc_id in junk) == k and r.held_out] for k in (True, False)}
    assert np.mean([a < b for a in scores[True] for b in scores[False]]) > 0.9


def test_quality_held_out_on_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = Q["op5_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([a >= 0.3 for a in good]) > 0.97


def test_kd_shards(spark, tables):
    folder, docs, _ = tables
    got = Q["op6_kd_shards"](spark, folder).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs(docs))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_kd_shards_near_equal(spark):
    got = Q["op6_kd_shards"](spark, "/root/testdata/sf0.1").groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 16 and max(sizes) < 1.05 * min(sizes)


def test_kd_shards_are_native(spark, tables):
    plan = Q["op6_kd_shards"](spark, tables[0])._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_personal_data(spark, tables):
    folder, docs, _ = tables
    want = Counter()
    for d, t in pairs(docs):
        spans = brute.base_spans(t or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[(d, *(sum(k == x for k, _, _ in spans) for x in personal_data.KINDS), hashlib.sha256(line.encode()).hexdigest())] += 1
    got = Q["op7_personal_data"](spark, folder)
    assert counted(got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")) == want
    text = {d: t or "" for d, t in pairs(docs) if d not in (None, 5)}
    seen = defaultdict(list)
    for r in got.where("doc_id IS NOT NULL AND doc_id <> 5").collect():
        base = [f"{k}:{a}:{b}" for k, a, b in brute.base_spans(text[r.doc_id])]
        assert set(base) <= set(filter(None, r.spans.split(",")))
        for span in set(filter(None, r.spans.split(","))) - set(base):
            kind, a, b = span.split(":")
            seen[kind].append(text[r.doc_id][int(a) : int(b)])
    assert "jane (at) example (dot) com" in seen["email"] and "(511) 555-6887" in seen["phone"]


def test_base_spans_of_long_runs():
    for text in ("1" * 50_000 + ".2.3.4 5", "a" * 50_000 + "@", "a@b" * 20_000, "1.2.3." * 20_000, "+1" * 20_000, "1 " * 20_000):
        assert sorted((personal_data.KINDS[k], a, b) for k, a, b in personal_data.base_spans(text)) == sorted(brute.base_spans(text[:0])) or len(text) > 10
    for text in ("a@b.c@d.e f", "x..@y.z", "@a.b", "1.2.3.4.5", "256.1.1.1 1.1.1.256", "4539 1488 0343 6467", "+1 22 33 44 55", "é@ü.de a-b@c-d.e-f."):
        assert [(personal_data.KINDS[k], a, b) for k, a, b in personal_data.base_spans(text)] == brute.base_spans(text)


def test_redaction():
    text = "mail jo@x.org or 10.2.3.4"
    assert personal_data.redact(text, personal_data.find([text], personal_data.trained())[0]) == "mail <EMAIL> or <IP>"


def plain_labels(field, words):
    """Viterbi over all words, one at a time."""
    index = lambda t: [field.index[f] for f in t if f in field.index]
    e = [field.weights[index(t)].sum(axis=0) for t in personal_data.token_features(words)]
    score, back = [field.start + e[0]], []
    for x in e[1:]:
        through = score[-1][:, None] + field.moves
        back.append(through.argmax(axis=0))
        score.append(through.max(axis=0) + x)
    y = [int(score[-1].argmax())]
    for b in reversed(back):
        y.append(int(b[y[-1]]))
    return y[::-1]


SPELLED = ["JANE DOE AT EXAMPLE DOT COM", "John (At) Example (Dot) Org", "john at example (dot) com", "maria at mail [dot] net", "OFFICE[AT]EXAMPLE.COM", "office(At)example(Dot)com"]


def test_personal_data_decodes_all_words(tables):
    field, rng = personal_data.trained(), random.Random(8)
    texts = [t for _, t in pairs(tables[1]) if t and t.split() and len(t) < 20_000]
    bank = " ".join(personal_data.LABELLED.split("\n") + SPELLED).replace("[email:", "").replace("[phone:", "").split()
    texts += [*SPELLED, *(f"please write to {t} before noon" for t in SPELLED), "1" * 300 + "4", " ".join(["12"] * 500)]
    texts += [" ".join(rng.choice(bank) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    words = [personal_data.WORD.findall(t) for t in texts]
    got = field.decode([*words, []])
    assert [list(y) for y in got] == [*(plain_labels(field, w) for w in words), []]
    for t in (*SPELLED[:4], *(f"please write to {t} before noon" for t in SPELLED)):
        assert any(k == 0 for k, *_ in personal_data.find([t], field)[0]), t


def test_shapes_read_words_whole():
    assert "spelled" in personal_data.shape("x" * 300 + "[at]" + "y" * 300)
    card = "4539148803436467"
    assert "luhn=True" in personal_data.shape("0" * 284 + card) and "luhn=False" in personal_data.shape("0" * 284 + card[:-1] + "8")


def test_repeated_spans(spark, tables, monkeypatch):
    folder, docs, _ = tables
    want = brute.without_repeats(pairs(docs))
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert counted(Q["op8_repeated_spans"](spark, folder).select(*cols)) == want
    monkeypatch.setattr(repeated_spans, "HOT_BYTES", 1500)  # the way of hot anchors gives the same
    assert counted(Q["op8_repeated_spans"](spark, folder).select(*cols)) == want


def test_chunked_runs(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    off = np.array([0, 10, 10, 4000, 5000])
    whole = [np.concatenate(x) for x in zip(*repeated_spans.runs(data, off, 100, 16))]
    monkeypatch.setattr(repeated_spans, "CHUNK", 700)
    cut = [np.concatenate(x) for x in zip(*repeated_spans.runs(data, off, 100, 16))]
    starts = lambda x: [(d, s, a) for d, s0, s1, a in zip(*x[:4]) for s in range(s0, s1 + 1)]
    assert starts(whole) == starts(cut) and len(starts(whole)) == 3990 - 99 + 1000 - 99


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(1, rng.choice([1, 2, 5, 5000])) for _ in range(rng.randint(0, 80))] + [0]
        assert suffixes.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_recursion(monkeypatch):
    rng = random.Random(2)
    s = [rng.randint(1, 3) for _ in range(3000)] * 2 + [0]
    want = sorted(range(len(s)), key=lambda i: s[i:])
    for limit in (0, 10**6):  # names ordered by doubling, or by recursion alone
        monkeypatch.setattr(suffixes, "RECURSE_NAMES", limit)
        assert suffixes.suffix_array(np.array(s)).tolist() == want


PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><div class='ad'>Buy now</div><article><h1>A &amp; B</h1><p>one<br>two  three<p>four</article><footer>&copy; x</footer></body></html>", "A & B\none two three\nfour"),
    ("<html><head><title>t</title></head><body><header><h2>Site</h2><ul><li><a>a</a></li></ul></header><main><p>Only this text here, with some words.</p><p>And that.</p></main>"
     "<section class=comments><div class=comment><p>nice post</p></div></section></body></html>", "Only this text here, with some words.\nAnd that."),
    ("<body><article><p>before<script>var x='</p>';</script> after</p><!-- c --><form><label>Mail</label><input></form></article>", "before after"),
    ("", ""), (None, ""), ("<p", ""), ("<html><body></body></html>", ""),
]


def test_main_text(spark, tmp_path):
    rows = [(k, f"u{k}", h, "x") for k, (h, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], None), (None, None, PAGES[0][0], None), (99, "long", "<article>" + "<p>word and more</p>" * 20_000 + "</article>", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Q["op9_main_text"](spark, str(tmp_path)).collect()
    want = Counter((k, f"u{k}", t, len(t)) for k, (_, t) in enumerate(PAGES)) + Counter([(0, "u0", PAGES[0][1], len(PAGES[0][1])), (None, None, PAGES[0][1], len(PAGES[0][1]))])
    long_ = "\n".join(["word and more"] * 20_000)
    assert Counter(tuple(r) for r in got) == want + Counter([(99, "long", long_, len(long_))])


ARTICLE = "<article><h1>A title</h1><p>Words of the article, and more of them.</p><p>A second paragraph, with a little more.</p></article>"


def texts_of(spark, pages):
    rows = [(k, "u", h) for k, h in enumerate(pages)]
    return [r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_main_text_reads_no_labels_from_pages(spark):
    marks = ["", '<button data-open="x">Menu</button>', '<div data-open="false"></div>', "<details data-open></details>", "<div data-open></div>", '<div data-open="0"></div>']
    assert texts_of(spark, [f"<body>{m}{ARTICLE}</body>" for m in marks]) == ["A title\nWords of the article, and more of them.\nA second paragraph, with a little more."] * len(marks)
    assert main_text.Page("<p data-open=0>a</p>", labelled=False).label == [1, 1, 1]


def test_main_text_reads_on_after_odd_marks(spark):
    marks = ["", "<![foo]>", "<![1]>", "<![ x>", "<![>", "<![if !mso>", "<![endif]>", "<![CDATA[ x > y ]]>", "<![CDATA[ x>", "<!x [ y>", "<!DOCTYPE a [<!ENTITY b>"]
    want = "A title\nWords of the article, and more of them.\nA second paragraph, with a little more."
    assert texts_of(spark, [f"<body>{m}{ARTICLE}</body>" for m in marks]) == [want] * len(marks)
    prose = "<article><p>Words of the article, and a {} in the midst of them.</p><p>A second paragraph, with a little more.</p></article>"
    got = texts_of(spark, [prose.format(m) for m in ("<![1], mark>", "&#" + "9" * 5000 + ";", "&#" + "0" * 5000 + "65;")])
    assert got == [f"Words of the article, and a{x} in the midst of them.\nA second paragraph, with a little more." for x in ("", " \ufffd", " A")]


def test_main_text_parser_never_gives_up():
    rng, parts = random.Random(5), ["<", ">", "<!", "<![", "]", "]]>", "<!--", "-->", "--", "<?", "</", "/", "/>", "&", "&#", "&#x", "1", "9" * 5000, ";", "a", "p", " ", "=", "'", '"', "<p", "<script>", "</script", "cdata[", "CDATA[", "if", "doctype", "\x00", "\n", "é"]
    for _ in range(3000):
        page = main_text.Page("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) + "</script><p>last words</p>", labelled=False)
        assert len(page.text) == len(page.parent)


def test_main_text_held_out_pages():
    """Blocks of pages of the grammar that training has not seen."""
    rng, hit, found, wanted = random.Random(999), 0, 0, 0
    model = main_text.trained()
    for _ in range(150):
        page = main_text.Page(main_text._written_page(rng))
        open_ = main_text.decode(page, model.log_odds(main_text.features(page)))
        assert all(open_[p] or not o for p, o in zip(page.parent[1:], open_[1:]))
        for tag, up, label, o in zip(page.tag, page.parent, page.label, open_):
            if tag == "#text" and page.tag[up] not in main_text.NEVER:
                hit, found, wanted = hit + (o and label), found + o, wanted + label
    assert hit / found > 0.97 and hit / wanted > 0.97


def test_packing(spark, tables):
    folder, docs, _ = tables
    got = Q["op10_packing"](spark, folder).collect()
    check_packing(got, pairs(docs))


def check_packing(got, docs):
    """Every id lies in one piece; windows are gapless; padding is at most one window for each task."""
    want = Counter((d, brute.crc(ids), len(ids)) for (d, _), ids in zip(docs, brute.token_ids([t for _, t in docs])))
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert Counter((d, n) for d, _, n in want.elements()) == Counter({k: sum(r.length for r in v) // k[1] for k, v in by_doc.items()})
    ids = defaultdict(list)
    for (d, _), x in zip(docs, brute.token_ids([t for _, t in docs])):
        ids[d, len(x)].append(x)
    for k, rows in by_doc.items():
        for r in rows:
            assert any(brute.crc(x[r.start : r.start + r.length]) == r.ids_crc32 for x in ids[k])
        covered = Counter(p for r in rows for p in range(r.start, r.start + r.length))
        assert set(covered.values()) == {len(ids[k])} and len(covered) == k[1]
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_packer_takes_least_squares():
    packer = packing.Packer(10)
    for size in (4, 4, 3, 6, 2, 5, 5, 1, 9, 7):
        before = packer.count.copy()
        packer.place((0, 0, np.zeros(size, np.uint32), size))
        options = []
        for level in range(0, 10 - size + 1):
            if level == 0 or before[level]:
                after = before.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 10
                options.append((after**2).sum())
        assert (packer.count**2).sum() == min(options)


def test_vector_links(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * s, c % 2) for s in rng.choice([0.05, 0.2, 0.35], 40)]
    rows = [(k, v.astype(np.float32).tolist(), label) for k, (v, label) in enumerate(rows)]
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in (0, 0, 3)] + [rows[5], (5, rows[80][1], rows[80][2]), (None, rows[5][1], rows[5][2])]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [1.0, None], 1), (2004, [float("nan")] * 16, 1), (2005, [float("inf")] * 16, 1), (2006, rows[0][1], None),
             (2007, [1.0, 2.0], 1), (2008, [1.0, 2.0], 1), (2009, [2.0, 4.0], 1), (2010, [-0.0, 1.0], 1), (2011, [0.0, 1.0], 1)]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, cell int, copies string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q["op1_vector_links"](spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept")
    assert counted(got) == brute.vector_links(rows)


def test_pipeline(spark, tables):
    folder, docs, items = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = frame.columns, frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, folder)
        assert kept.columns == columns
        had, left = (Counter((r.doc_id, r.text) for r in x.select("doc_id", "text").collect()) for x in (before, kept))
        if name == "quality":
            scores = {(r.doc_id, r.text): r.score for r in quality.score(before.select("doc_id", "text"), quality.model(before, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
            assert left == Counter({k: n for k, n in had.items() if scores[k] >= 0.3})
        elif name == "near_copies":
            whole = brute.near_copies(list(had.elements()))
            assert Counter(d for d, _ in left.elements()) == Counter({d: n if d is None else 1 for d, _, _, k in whole if k for n in [sum(m for x, m in whole.items() if x[0] is None)]})
        elif name == "decontamination":
            assert left == Counter({k: n for k, n in had.items() if not next(iter(brute.contamination([k], items)))[5]})
        else:
            assert left == Counter((d, t and personal_data.redact(t, personal_data.find([t], personal_data.trained())[0])) for d, t in had.elements())
    final = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    check_packing(corpus_pipeline.run(spark, folder).collect(), final)


def test_pipeline_keeps_the_text_that_is_no_copy(spark):
    """(5, a) is a copy of (3, a), (5, b) is not: b stays, whichever text is smaller."""
    a, b = "a text of some nine words that comes twice", "zebras and other things that share nothing with it"
    for x, y in ((a, b), (b, a)):
        rows = [(3, x, "en"), (5, x, "en"), (5, y, "de"), (5, y, "en"), (None, x, "en"), (7, None, "en")]
        got = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
        assert counted(got) == Counter([(3, x, "en"), (5, y, "de"), (None, x, "en"), (7, None, "en")])


def test_blocks_of_long_lists(spark, tables, monkeypatch):
    from terrasphere.llm import near_copies, vector_links

    folder, docs, _ = tables
    monkeypatch.setattr(near_copies, "LIST_BLOCK", 5)
    monkeypatch.setattr(near_copies, "FAMILY_BLOCK", 4)
    got = near_copies.near_copies(spark.read.parquet(f"{folder}/documents.parquet"))
    assert counted(got.select("doc_id", "n_shingles", "component_id", "kept")) == brute.near_copies(pairs(docs))
    monkeypatch.setattr(vector_links, "BLOCK", 7)
    monkeypatch.setattr(vector_links, "QUERIES_BLOCK", 20)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=8)
    rows = [(k, (centre + rng.normal(size=8) * 0.3).astype(np.float32).tolist(), 1) for k in range(80)]
    got = vector_links.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert counted(got.select("vec_id", "n_links", "component_id", "kept")) == brute.vector_links(rows)


def test_windows_are_counted_once(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j")], "item_id long, text string")
    assert contamination.item_windows(items).count() == 2
