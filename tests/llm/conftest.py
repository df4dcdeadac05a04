"""Small tables that hold the awkward cases: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

EXTRA = {"score": "double", "spans": "string", "key": "string", "part": "int", "h": "int", "n": "int", "text_key": "string", "label": "int", "node": "int", "g": "int"}


def words(rng, n, bank):
    return " ".join(rng.choice(bank) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def documents():
    """(doc_id, text, lang, source)"""
    rng = random.Random(4)
    bank = ["".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(300)] + ["Être", "über", "Año"]
    base, passage = words(rng, 160, bank), words(rng, 110, bank)
    out = []
    for k in range(24):
        out.append(words(rng, rng.randint(3, 300), bank))
    for k in range(30):  # near copies, some near enough and some not
        w = base.split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(bank) + str(k)
        out.append(" ".join(w))
    out += [words(rng, 20 + k, bank) + " " + passage + " " + words(rng, 30, bank) for k in range(12)]
    out += [out[0], out[0], passage, passage.upper(), "", None, "   \n\t ", "one", "one two three", "ONE two Three", "x" * 5000, "ab " * 9000]
    out += ["tail " + words(rng, 30, bank) + " the quick brown fox jumps over the lazy dog again and again " + words(rng, 5, bank)]
    out += ["mail jo.doe@mail7.example.com or +1 (511) 555-6887, host 10.2.3.4 and 999.2.3.4, card 4539 1488 0343 6467 and 4363361756619572.",
            "write to jane (at) example (dot) com or call (511) 555-6887 a@b.c@d.e 1.2.3.4.5.6.7.8 ++1+22222222 @x.y é@ü.de",
            words(rng, 9000, bank) + " jo@example.org"]
    out += [w.replace(" ", "### ") + "&&& %%%" for w in out[:10] if w]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "cold", None])) for k, t in enumerate(out)]
    rows += [rows[3], rows[3], (5, "another version of five", "en", None), (None, rows[7][1], None, None), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def write(spark, rows, schema, path, parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Folder of the tables, and the documents' rows."""
    folder = str(tmp_path_factory.mktemp("llm") / "tables")
    docs = documents()
    extra = ", ".join(f"{c} {t}" for c, t in EXTRA.items())
    blank = (None,) * len(EXTRA)
    write(spark, [(d, t, lang, s, len(t) if t is not None else None, *blank) for d, t, lang, s in docs], f"doc_id long, text string, lang string, source string, n_chars long, {extra}", f"{folder}/documents.parquet")
    quality = [(d, int("###" not in (t or "")), 0) for d, t, _, _ in docs if d is not None] + [(10**6, 1, 0), (None, 1, None), (4, None, None)]
    write(spark, quality, "doc_id long, quality int, toxic int", f"{folder}/labels.parquet")
    items = [(1, "The quick brown fox jumps over the lazy dog, again and again"), (2, "one TWO three"), (3, docs[0][1]), (3, "one two three"), (4, None), (None, "one"), (6, "..."), (7, "lazy dog")]
    write(spark, [(*i, None) for i in items], "item_id long, text string, token string", f"{folder}/benchmark.parquet")
    return folder, docs, items


@pytest.fixture(scope="session")
def empty_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("llm-empty") / "tables")
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"),
                         ("benchmark", "item_id long, text string"), ("embeddings", "vec_id long, embedding array<float>, label int"), ("pages", "page_id long, url string, html string")):
        write(spark, [], schema, f"{folder}/{name}.parquet", 1)
    return folder
