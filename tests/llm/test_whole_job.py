"""The whole job where an operator once did a part of it."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from harrow.llm import decontamination, htmltext, licenses, q01_search, sharding, toxicity
from tests.llm.test_llm import DOCS, brute_alignment, brute_search


# 1 search


def test_search_asks_with_whole_texts(spark, tmp_path):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join([*(f"only{i}x{k}" for k in range(20)), *rng.choice(words, 25)])) for i in range(120)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    found = q01_search.query(spark, str(tmp_path)).collect()
    got = {(r["query_id"], r["doc_id"], r["rank"], round(r["score"] * 1e6)) for r in found}
    assert got == brute_search(docs, [d for d in docs if d[0] % 20 == 0], 10, None)
    assert len(got) == 60  # the 16 heaviest terms of each are its own and find it alone


# 7 decontamination


@pytest.mark.parametrize("size", [20, 40])
@pytest.mark.parametrize("every", [4, 5])
def test_edited_copy_beside_a_full_copy(spark, size, every):
    rng = np.random.default_rng(12)
    words = lambda n: list(rng.choice([f"t{i}" for i in range(4000)], n, replace=False))
    items, texts = [words(size) for _ in range(every)], []
    for phase, item in enumerate(items):  # of each item one full and one edited copy
        edited = [f"other{k}" if k % every == phase else w for k, w in enumerate(item)]
        assert brute_alignment(item, edited) >= 0.5 * 2 * size
        texts += [words(50) + item + words(50), words(50) + edited + words(50)]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*texts, words(150)])], DOCS)
    found = decontamination.with_leaks(docs, bench).select("doc_id", F.explode("leaks.item_id").alias("item")).collect()
    assert {(r["doc_id"], r["item"]) for r in found} == {(i, i // 2) for i in range(len(texts))}


# 3 HTML


LONG = "Long text here that reads on and on until it ends. " * 4
CARD = "<article><h3><a href=x>Teaser card</a></h3><p>Short words.</p></article>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><div class=story><p>{LONG}</p><p>{LONG}</p></div>{CARD * 3}</body>", f"{LONG}\n{LONG}"),
        (f"<body><article><p>{LONG}</p></article><article><p>Other {LONG}</p></article><div><a href=x>one</a><a href=y>two</a></div></body>", f"{LONG}\nOther {LONG}"),
        (f"<article><p>{LONG}</p><ul><li><a href=x>{LONG}</a></li><li>Other {LONG}</li></ul><p>{LONG}</p></article>", f"{LONG}\n{LONG}\nOther {LONG}\n{LONG}"),
        ("<body><div>" + "".join(f"<div>{k} {LONG}</div>" for k in range(15)) + "</div></body>", "\n".join(f"{k} {LONG}" for k in range(15))),
        (f"<main><h1>Title</h1><div><article><p>{LONG * 4}</p></article>{CARD}</div></main>", f"Title\n{LONG * 4}"),
    ],
)
def test_main_text_goes_by_content(html, text):
    assert htmltext.main_text(html).split("\n\n") == [x.strip() for x in text.split("\n")]


def test_clustering_decides(monkeypatch):
    """With the threshold out of the way, so that every line or none is content, these pages give other texts."""
    short = "".join(f"<div><b>Tag</b> <i>{k}</i> word</div>" for k in range(40))
    page = f"<body><div>{short}</div><div><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert htmltext.main_text(page) == f"{LONG.strip()}\n\n{LONG.strip()}"
    for value in (-1.0, float("inf")):
        monkeypatch.setattr(htmltext, "threshold", lambda values, v=value: v)
        assert htmltext.main_text(page) != f"{LONG.strip()}\n\n{LONG.strip()}"


# 4 toxicity


def test_recall_on_labelled_rows_outside_the_sample(spark):
    """Fitted on the labels that op2 may see, held against all others."""
    import zlib

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    chain = toxicity.fit(docs, labels.where(~held))
    scored = toxicity.with_toxicity(docs.join(labels.where(held), "doc_id"), chain).select("doc_id", "toxic", (F.col("toxicity.toxic") >= toxicity.REJECT).cast("int").alias("said")).toPandas()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in scored.doc_id)
    right = ((scored.said == 1) & (scored.toxic == 1)).sum()
    assert right / (scored.toxic == 1).sum() >= 0.9 and right / (scored.said == 1).sum() >= 0.95


def test_earlier_probabilities_come_from_models_that_have_not_seen_the_row(monkeypatch):
    """Marks, too, are chosen without the row: what is chosen in a fold uses labels of other rows only."""
    seen = []
    choose = toxicity.select_marks
    monkeypatch.setattr(toxicity, "select_marks", lambda rows, marks, y: seen.append(len(y)) or choose(rows, marks, y))
    texts = [f"plain words here {i}" + (" idiot moron" if i % 5 == 0 else "") for i in range(80)]
    y = np.array([[i % 5 == 0, 0, i % 5 == 0] for i in range(80)], np.int64)
    toxicity.train(texts, y, list(toxicity.CATEGORIES))
    assert seen == [60, 60, 60, 60, 80]


# 7 decontamination: every alignment that reaches the threshold and holds a seed


@pytest.mark.parametrize("kind", ["replaced", "inserted", "one long insertion", "removed"])
def test_recall_against_unseeded_alignment(spark, kind):
    rng = np.random.default_rng(len(kind))
    words = lambda n: list(rng.choice([f"t{i}" for i in range(3000)], n, replace=False))
    items, texts = [words(int(n)) for n in rng.integers(5, 60, 25)], []
    for item in items:
        n = len(item)
        if kind == "replaced":
            copy = [f"x{k}" if rng.random() < 0.25 else w for k, w in enumerate(item)]
        elif kind == "inserted":
            copy = [w for k, x in enumerate(item) for w in ([x, f"y{k}"] if rng.random() < 0.4 else [x])]
        elif kind == "removed":
            copy = [w for w in item if rng.random() > 0.3]
        else:
            at = int(rng.integers(1, n))
            copy = item[:at] + [f"z{k}" for k in range(int(0.9 * n))] + item[at:]
        texts.append(words(40) + copy + words(40))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = decontamination.with_leaks(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS), bench)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in found.select("doc_id", F.inline("leaks")).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            runs = {tuple(t[k : k + 3]) for k in range(len(t) - 2)}
            score = brute_alignment(item, t) / (2 * len(item))
            if score >= 0.5 and any(tuple(item[k : k + 3]) in runs for k in range(len(item) - 2)):
                want[i, j] = score
    assert got == pytest.approx(want) and len(want) >= 10


def test_short_items_on_demand_and_ties(spark):
    bench = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "one two three four"), (4, ""), (5, None), (6, "beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Alpha y beta gamma z beta gamma"), (2, "one two three four"), (3, None), (4, "gamma beta")], DOCS)
    asked = decontamination.with_leaks(docs, bench).select("doc_id", F.inline("leaks")).collect()
    assert {(r["doc_id"], r["item_id"], r["first_word"]) for r in asked} == {(1, 1, 1), (1, 2, 3), (1, 6, 3), (2, 3, 0)}  # the first of two equally good places; a short item only as a whole
    assert decontamination.with_leaks(docs, bench, least=5).where(F.size("leaks") > 0).count() == 0
    part = spark.createDataFrame([(1, "one two three x four")], DOCS)  # three of four words
    assert decontamination.with_leaks(part, bench).where(F.size("leaks") > 0).count() == 0


def test_many_item_blocks_one_after_another(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + k * k) % 500}" for k in range(12))) for i in range(60)] + [(99, None), (98, "")], "item_id long, text string")
    docs = spark.createDataFrame([(i % 40, f"x{i} " + " ".join(f"w{(i % 60 * 31 + k * k) % 500}" for k in range(12)) + " y", 7) for i in range(70)] + [(5, None, 7), (6, "", 7)], f"{DOCS}, _row long")
    one = decontamination.with_leaks(docs, bench)
    rows = lambda df: sorted((r["doc_id"], r["text"] or "", r["_row"], sorted(map(tuple, r["leaks"]))) for r in df.collect())
    want = rows(one)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    many = decontamination.with_leaks(docs, bench)
    assert many.columns == one.columns and rows(many) == want and sum(len(r[3]) for r in want) >= 70


# 8 licenses


def test_wrapped_notices_and_clashing_names(spark):
    notice = "Permission is hereby granted,\n free of charge, to any person\n obtaining a copy of this\nsoftware and associated\r\n documentation files"
    parted = notice.replace("\n obtaining", "\n\n obtaining")
    far = notice.replace("\n", "\nfiller line here\nand another\n")
    df = spark.createDataFrame([(1, notice), (2, parted), (3, far), (4, "x\n" * 50 + notice + "\ny" * 50), (5, None), (6, "")], DOCS)
    for name in ("_lines", "_words", "lines", "label"):
        df = df.withColumn(name, F.lit(7))
    out = licenses.scan(df.withColumn("places", F.lit(1)))
    assert out.columns == [*df.columns, "places", "n_words", "matches"] and out.where("_lines = 7 AND _words = 7").count() == 6
    assert {r["doc_id"] for r in out.where(F.exists("matches", lambda m: m["label"] == "mit")).collect()} == {1, 4}
    assert licenses.scan(df, n_words="a", places="b", matched="c").columns == [*df.columns, "a", "b", "c"]


# 10 sharding


def test_stored_map_versions_and_a_hot_key(spark, tmp_path):
    docs = spark.createDataFrame([(i if i % 3 else 0, "x" * (i % 50)) for i in range(3000)], DOCS)  # a third of all rows has one key
    records = sharding.record_sizes(docs)
    path = str(tmp_path / "maps")
    sharding.save_map(sharding.slot_map(sharding.slot_loads(records), 4), path)
    first = sharding.load_map(spark, path)
    sharding.save_map(sharding.grow(first, 4, 2), path)
    second, old = sharding.load_map(spark, path), sharding.load_map(spark, path, 1)
    assert (second.first()["version"], old.first()["version"]) == (2, 1)
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, first.collect()))
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.save_map(first, path)
    for slots in (old, second):
        out = sharding.assign(records, slots).toPandas()
        assert len(out) == 3000 and all(sorted(g["position"]) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_long_conversation_and_bounded_history(spark):
    """Windows by plain Python, on a conversation of many turns with costs around the history's limit."""
    from harrow.llm import chat

    sizes = [(7 * i * i + 3 * i) % 23 for i in range(3000)]
    rows = [(1, 0, "system", "s s")] + [(1, i + 1, ("user", "assistant")[i % 2], "w " * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    for history in (0, 30, 96):
        cost = [len(t.split()) + chat.PER_TURN for *_, t in rows]
        starts, used = [0], 0
        repeated = lambda s: max(n for n in range(s) if sum(cost[s - n : s]) <= history)
        for i, c in enumerate(cost):
            if i > 1 and used + c > 200:
                starts.append(i)
                used = cost[0] + sum(cost[i - repeated(i) : i])
            used += c
        want = [(k, 0 if k == 0 else 1 + repeated(s)) for k, s in enumerate(starts)]
        got = chat.format_windows(df, 200, history).select("window", "n_repeated").orderBy("window").collect()
        assert [tuple(r) for r in got] == want


def test_query_blocks_give_what_one_block_gives(spark, sf, monkeypatch):
    from harrow.llm import search

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    asked = docs.where("doc_id % 20 = 0")
    one = sorted(map(tuple, search.top_similar(docs, asked, terms=None).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 400)
    assert sorted(map(tuple, search.top_similar(docs, asked, terms=None).collect())) == one and one


def plain_quality(model, text):
    """The score of one text, feature by feature."""
    from harrow.llm import quality
    from harrow.llm.bytetext import word_hashes

    multipliers = [int(m) for m in quality._MULTIPLIERS]
    data = b" " + (text or "").encode() + b" "
    buckets = []
    for n in (3, 4):
        for at in range(len(data) - n + 1):
            gram = data[at : at + n]
            if all(c > 32 for c in gram[1:-1]):
                h = n
                for c, m in zip(gram, multipliers):
                    h = (h ^ (c if c > 32 else 32)) * m % 2**32
                buckets.append(((h ^ h >> 15) * multipliers[0] % 2**32) >> 32 - quality.BUCKETS_LOG2)
    words = [w for w in re.split(rb"[\x00-\x20]+", data) if w]
    for w in words:
        h = word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
        buckets.append(int(h) >> 64 - quality.BUCKETS_LOG2)
    buckets += [1 << quality.BUCKETS_LOG2 for a, b in zip(words, words[1:]) if a == b]
    logit = model.bias + sum(float(model.weights[b]) for b in buckets) / max(1, len(buckets))
    return 1 / (1 + math.exp(-max(-60, min(60, logit))))


def test_quality_query_against_plain_python(spark, sf):
    from harrow.llm import quality
    from harrow.llm.common import table
    from harrow.llm.q02_quality import held_out, query

    docs = table(spark, sf, "documents")
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf, "labels"), allowed=~held_out())
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    out = query(spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        score = plain_quality(model, texts[r["doc_id"]])
        assert math.isclose(r["score"], score, abs_tol=1e-6)
        assert r["predicted"] == int(score >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_a_score_does_not_depend_on_the_texts_around_it():
    from harrow.llm import quality

    model = quality.Model(np.zeros((1 << quality.BUCKETS_LOG2) + 1, np.float32), 0.0)
    model.weights[-1] = 5.0
    texts = ["one two", "two three three", None, "three", ""]
    assert list(model.scores(texts)) == [plain_quality(model, t) for t in texts] == [model.scores([t])[0] for t in texts]
