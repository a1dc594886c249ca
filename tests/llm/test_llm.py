"""The training-data operators against plain Python, on small tables with hard cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from harrow.llm import bpe, chat, decontamination, htmltext, licenses, quality, registry, search, sharding, simhash, toxicity
from harrow.llm.q05_chat import HOSTILE, digests, with_hostile
from harrow.llm.q09_bpe import digests as bpe_digests

DOCS = "doc_id long, text string"
#: Null, empty, blank, repeated rows, ties, clashing extra column names.
HARD = [
    (0, "Alpha beta gamma delta epsilon zeta", "en"),
    (1, "alpha BETA gamma delta epsilon zeta", "x"),
    (1, "alpha BETA gamma delta epsilon zeta", "x"),
    (2, None, None),
    (3, "", ""),
    (4, " \t\n ", None),
    (None, "no id at all here", "x"),
    (5, "word " * 30000, "long"),
    (6, "né à l'été<|endoftext|> 日本語   İK", None),
    (7, None, None),
]


def hard(spark, extra: str = "score"):
    return spark.createDataFrame(HARD, f"{DOCS}, {extra} string")


def empty(spark):
    return spark.createDataFrame([], f"{DOCS}, lang string")


# 1 search


def brute_search(docs, asked, k, terms):
    low = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")]
    rows = [(i, low(t)) for i, t in docs if i is not None]
    n, average = len(rows), sum(len(w) for _, w in rows) / max(1, len(rows))
    df = {}
    for _, w in rows:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    out = set()
    for q, text in asked:
        w = low(text)
        best = sorted(set(w), key=lambda t: (-(idf[t] * (w.count(t) * 2.2 / (w.count(t) + 1.2))), w.index(t)))[:terms]
        hits = []
        for i, d in rows:
            gain = 0
            for t in best:
                if tf := d.count(t):
                    gain += round(idf[t] * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / average))) * 1e6)
            if gain:
                hits.append((-gain, i))
        out |= {(q, i, rank, -g) for rank, (g, i) in enumerate(sorted(hits)[:k], 1)}
    return out


@pytest.mark.parametrize("terms", [3, 16, 1000])
def test_search(spark, terms):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 25), p=np.r_[0.4, np.full(59, 0.6 / 59)]))) for i in range(400)] + [(i, "w1 w2 w3 copy") for i in range(400, 700)]
    docs += [r[:2] for r in HARD if r[0] != 5 and r[0] is not None and r[0] != 1]
    docs = [(i + 1000 if k >= 700 else i, t) for k, (i, t) in enumerate(docs)]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    asked = [r for r in docs if r[0] % 20 == 0]
    found = search.top_similar(df, df.where("doc_id % 20 = 0"), k=5, terms=terms).collect()
    assert {(r["query_id"], r["hit_id"], r["rank"], round(r["score"] * 1e6)) for r in found} == brute_search(docs, asked, 5, terms)


def test_search_prunes_and_empty(spark):
    assert search.top_similar(empty(spark), empty(spark)).count() == 0


def test_search_of_languages_that_share_few_words(monkeypatch):
    """Like documents stand together, whatever their ids, so that most ranges hold one language; hits and ties are those of brute force."""
    for name, value in (("RANGE", 16), ("HOT", 3), ("SHARD_DOCS", 600), ("QUERY_CHUNK", 8), ("POSTINGS", 64), ("LIKE_LEAST", 16)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(3)
    docs = [(int(i) * 3, " ".join([*(f"l{n % 4}w{w}" for w in rng.zipf(1.4, rng.integers(4, 40)) % 90), f"x{n % 50}"])) for n, i in enumerate(rng.permutation(1300))]
    docs = [(i, docs[0][1]) if n % 40 == 0 else (i, t) for n, (i, t) in enumerate(docs)] + [(5000, ""), (5001, None)]
    shards = [r for b in search.index_shards(iter([pd.DataFrame(docs, columns=["doc_id", "text"])])) for r in b.itertuples()]
    assert len(shards) == 3 and sum(s.n_docs for s in shards) == len(docs)
    language = {i: (t or "")[:2] for i, t in docs}
    pure = [len({language[i] for i in np.frombuffer(s.ids, np.int64)[r : r + 16].tolist()}) == 1 for s in shards for r in range(0, s.n_docs, 16)]
    assert np.mean(pure) > 0.6
    held = [(i, set(np.concatenate([t for _, t in search.term_rows([x])] or [np.zeros(0, np.uint64)]).view(np.int64).tolist())) for i, x in docs]
    df = {}
    for _, own in held:
        for t in own:
            df[t] = df.get(t, 0) + 1
    asked = [(i, t) for i, t in docs if i % 21 == 0]
    rows = [(i, t, np.log(1.0 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))) for i, own in held if i % 21 == 0 for t in sorted(own)]
    queries = search.Queries(*map(np.array, zip(*rows)))
    best = search.Best(len(queries.ids), 7)
    for s in shards:
        search.search_shard(search.Shard(s, sum(x.n_words for x in shards) / len(docs), queries), queries, best)
    got, rank = set(), {}
    for q, score, i in zip(*(x.tolist() for x in best.hits)):
        rank[q] = rank.get(q, 0) + 1
        got.add((int(queries.ids[q]), i, rank[q], score))
    assert got == brute_search(docs, asked, 7, None)


# 2 quality


def test_quality(spark):
    good = [(i, f"plain words in sentence number {i} read well and end.", 1) for i in range(200)]
    bad = [(1000 + i, f"b@d### wor&&& {i}!! ju%%% nk*** str$$$ ing###", 0) for i in range(60)]
    rows = good + bad
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, allowed=F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    out = {r["doc_id"]: r["score"] for r in quality.with_quality(docs, model).collect()}
    unseen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([(out[i] >= quality.ACCEPT) == bool(y) for i, _, y in unseen]) > 0.97
    scored = quality.with_quality(hard(spark), model, score="q")
    assert scored.columns == ["doc_id", "text", "score", "q"] and scored.where("q BETWEEN 0 AND 1").count() == len(HARD)
    assert quality.with_quality(empty(spark), model).count() == 0
    alone = quality.fit(docs, labels.where("quality = 1"))
    assert quality.with_quality(docs, alone).where("score < 0.9").count() == 0
    assert quality.fit(empty(spark), labels).scores(["x"])[0] == pytest.approx(0.5)


# 3 HTML


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<nav><a href=x>m</a></nav><article><h1>T &amp; t</h1><p>a  b\n c<br>d<p>e</article><footer>f</footer>", "T & t\n\na b c d\n\ne"),
        ("<script>var a='</p>';</script><main><p>one <b>two</b></p><div class='sidebar'>no</div><form><p>no</p></form></main>", "one two"),
        ("<article><p>yes yes yes</p><section class=comments><article><p>no</p></article></section><div id='cookie-notice'>no</div></article>", "yes yes yes"),
        ("<div><div class=menu><a>x</a></div><div><p>Long text here that reads on and on.</p><p>Of.</p></div></div>", "Long text here that reads on and on.\n\nOf."),
        ("<aside>no</aside><header>no</header><p>a<!-- c -->b</p><style>p{}</style>", "ab"),
        ("<article><p>cut off in the midd", "cut off in the midd"),
    ],
)
def test_main_text(html, text):
    assert htmltext.main_text(html) == text


def test_html_frame(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "<p>x</p>" * 20000)], "page_id long, html string")
    out = {r["page_id"]: r["text"] for r in htmltext.with_main_text(df).collect()}
    assert out[1] == "" and out[2] == "\n\n".join(["x"] * 20000)
    assert htmltext.with_main_text(df.limit(0)).count() == 0


# 4 toxicity


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = list(rng.choice(words, 40))
        if bad := i % 5 == 0:
            text[3:3] = ["You", "Idiot,", "moron."]
        rows.append((i, " ".join(text), int(bad), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[3], r[2]) for r in rows[:300]], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels)
    out = {r["doc_id"]: r["toxicity"]["toxic"] for r in toxicity.with_toxicity(docs, chain).collect()}
    assert all((out[i] >= toxicity.REJECT) == bool(y) for i, _, y, _ in rows[300:])
    assert toxicity.with_toxicity(hard(spark, "toxicity_"), chain).where("toxicity.toxic < 0.5").count() == len(HARD)
    assert toxicity.with_toxicity(empty(spark), chain).count() == 0
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.with_toxicity(docs, none).where("toxicity.toxic > 0.01").count() == 0


# 5 chat


@pytest.mark.parametrize("budget", [20, 64, 512])
def test_chat(spark, budget):
    rng = np.random.default_rng(2)
    turns = []
    for c in range(25):
        for t in range(int(rng.integers(1, 14))):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            text = [None, "", HOSTILE, "### user\n<x>\\b\\l#</turn>\n", "w " * int(rng.integers(1, 40))][int(rng.integers(0, 5))]
            turns.append((c, t, None if c == 7 else role, text))
    turns += [(99, 0, "user", "same"), (99, 0, "user", "same"), (None, None, "a\n### b", "x"), (98, 0, "assistant", "y" * 300_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    windows = chat.format_windows(with_hostile(df), budget, 8)
    out = {r["conv_id"]: r for r in digests(chat.read_windows(windows)).collect()}
    every = {}
    for c, t, r, x in [*turns, (-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)]:
        every.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(out) == set(every)
    for c, rows in every.items():
        rows.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in rows)
        target = "".join(x for _, r, x in rows if r == "assistant")
        got = out[c]
        assert (got["n_turns"], got["turns_sha256"]) == (len(rows), hashlib.sha256(said.encode()).hexdigest())
        assert (got["loss_chars"], got["loss_sha256"]) == (len(target), hashlib.sha256(target.encode()).hexdigest())
    cost = lambda x: len([w for w in re.split(r"[\x00-\x20]+", x) if w]) + chat.PER_TURN
    for w in chat.read_windows(windows).join(windows.select("conv_id", "window", "formatted", "n_repeated"), ["conv_id", "window"]).collect():
        texts = [chat_plain(p.split("\n", 1)[1]) for p in w["formatted"].split("</turn>\n")[:-1]]
        system = w["window"] == 0 and w["formatted"].startswith("### system\n")
        assert sum(map(cost, texts)) <= budget or len(texts) - w["n_repeated"] - system == 1
    assert chat.format_windows(df.limit(0)).count() == 0


def chat_plain(s):
    return s.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\")


# 6 SimHash


def brute_fingerprint(text):
    import xxhash

    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(f"v{x}" for x in rng.integers(0, 500, 80)) for _ in range(30)]
    docs = [(100 + k, t.replace("v1 ", "z ", 1) + (" tail" if k % 2 else "")) for k, t in enumerate(base * 4)] + [r[:2] for r in HARD if r[0] is not None]
    found = simhash.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    prints = {i: brute_fingerprint(t) for i, t in docs}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert len(found) == len(docs)
    assert {(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found} == {(i, prints[i], find(i)) for i in ids}
    kept = simhash.keep_first(spark.createDataFrame(docs, DOCS), simhash.near_duplicates(spark.createDataFrame(docs, DOCS))).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({find(i) for i in ids})
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_links_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centre = int(rng.integers(0, 1 << 62))
    values = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(150)} | set(map(int, rng.integers(0, 1 << 62, 200)))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    near = {(a, b) for k, b in enumerate(values) for a in values[:k] if ((a ^ b) % (1 << 64)).bit_count() <= 4}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    from harrow.operators.graph import components

    def groups(edges):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return {v: find(v) for v in values}

    for block in (simhash.BLOCK, 8):  # the second cuts every crowded anchor
        monkeypatch.setattr(simhash.blocked, "__defaults__", (block,))
        links = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.links(df).collect()}
        assert groups(links) == groups(near)
        assert {r["node"]: r["root"] for r in components(simhash.links(df)).collect()} == {v: r for v, r in groups(near).items() if v != r}


# 7 decontamination


def test_decontamination(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"t{i}" for i in range(400)]
    item = lambda n: list(rng.choice(vocabulary, n))
    items = [item(n) for n in (30, 40, 12, 4)]
    edited = list(items[1])
    for k in range(3, 40, 6):
        edited[k] = "changed"
    texts = [item(200) for _ in range(40)]
    texts[3][50:50] = items[0]
    texts[9][0:0] = [w.upper() for w in edited]
    texts[11] += items[2]
    texts[12] += items[3]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900 + k, r[1]) for k, r in enumerate(HARD)]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(8, None), (9, "")], "item_id long, text string")
    out = decontamination.with_leaks(spark.createDataFrame(docs, DOCS), bench).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*").collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(3, 0), (9, 1), (11, 2), (12, 3)}  # the item of four words as a whole copy
    exact = next(r for r in out if r["doc_id"] == 3)
    assert (exact["score"], exact["first_word"], exact["last_word"]) == (1.0, 50, 79)
    assert decontamination.with_leaks(empty(spark), bench).count() == 0
    assert decontamination.with_leaks(hard(spark, "leaks_"), bench.limit(0)).where(F.size("leaks") > 0).count() == 0


def brute_alignment(q, t):
    h = [[0] * (len(t) + 1) for _ in range(len(q) + 1)]
    for i, a in enumerate(q, 1):
        for j, b in enumerate(t, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    rng = np.random.default_rng(8)
    for _ in range(60):
        q, t = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, (3, 14)).astype(np.uint64)
        score, _ = decontamination.local_alignment(q, t, np.ones(t.shape, bool))
        assert score.tolist() == [brute_alignment(q.tolist(), r) for r in t.tolist()]


# 8 licenses


def plain_licenses(text, templates, threshold=0.8):
    """(label, score) of every paragraph and template: all runs of as many words as a block has."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    parts = [[]]
    for line in low.split("\n"):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line)
        parts = [*parts[:-1], parts[-1] + words] if words else [*parts, []]
    out = []
    for label, notice in templates:
        tokens = set(notice.split())
        own = tokens - set().union(*(set(n.split()) for x, n in templates if (x, n) != (label, notice)))
        span = math.ceil(len(notice.split()) / threshold - 1e-9)
        for part in parts:
            blocks = [set(part[k : k + span]) for k in range(len(part))]
            best = [len(b & tokens) for b in blocks if len(b & tokens) >= threshold * len(tokens) - 1e-9 and len(b & own) >= threshold * len(own) - 1e-9]
            if best:
                out.append((label, max(best) / len(tokens)))
    return sorted(out)


def test_licenses_random(spark):
    """Copies with words changed, dropped and put in, cut into lines; and hundreds of templates."""
    rng = random.Random(8)
    texts = []
    for k in range(80):
        words = rng.choice(licenses.TEMPLATES)[1].split()
        words = [w if rng.random() > 0.15 else rng.choice(["the", "mit", "x", "license"]) for w in words if rng.random() > 0.1]
        for _ in range(rng.randrange(5)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["any", "of", "mit", "gnu"]))
        texts.append("".join(w + rng.choice([" ", "\n", ", ", " \n ", "\n\n" if rng.random() < 0.1 else " "]) for w in words))
    texts += ["licensed under the apache license version 2 0\nmit der zeit\n", "released under the apache license", "Released under the MIT license.", "mit " * 500 + "released under the mit license", "released under the\n\nmit license"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    many = licenses.TEMPLATES + [(f"made-{k}", " ".join(f"w{(k * 7 + j * j) % 900}" for j in range(5 + k % 25))) for k in range(500)]
    texts += [many[k][1] for k in range(20, 500, 60)]
    for templates, rows in ((licenses.TEMPLATES, texts[:85]), (many, texts[60:])):
        df = spark.createDataFrame(list(enumerate(rows)), DOCS)
        for r in licenses.scan(df, templates=templates).collect():
            want = plain_licenses(rows[r["doc_id"]], templates)
            assert sorted((m["label"], round(m["score"], 9)) for m in r["matches"]) == [(label, round(s, 9)) for label, s in want], rows[r["doc_id"]]
    assert [x[0] for x in plain_licenses(texts[80], licenses.TEMPLATES)] == ["apache-2"] and not plain_licenses(texts[81], licenses.TEMPLATES) and [x[0] for x in plain_licenses(texts[82], licenses.TEMPLATES)] == ["mit-line"]


def test_licenses(spark):
    texts = ["a\nPermission is hereby granted,\n free of charge, to any person\n obtaining a copy of this\nsoftware and associated\r\n documentation files\nb\nc\nd\n \ne", "MIT License\nApache License", "x\ncc by cc by", "mit licenses cc  by", "This program is free software: you can redistribute it and/or modify it under terms of the GNU General Public License as published by Free Software Foundation", None, "", "İ mit\nlicense", "a " * 5000 + "MIT license"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    out = [r for r in licenses.scan(df).orderBy("doc_id").collect()]
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    for r, w in zip(out, words):
        places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert r["n_words"] == len(w) and sorted((p["place"], p["label"]) for p in r["places"]) == places
        met = [label for label, score in plain_licenses(texts[r["doc_id"]] or "", licenses.TEMPLATES)]
        assert sorted(m["label"] for m in r["matches"]) == met
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(hard(spark, "score")).count() == len(HARD)


# 9 BPE


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    texts = [r[1] for r in HARD] + ["a" * 3000, "it's I'LL <|endoftext|><|endoftext|>x", "\x1c\x85  x\n\n  y  ", "zß" * 400, "日本" * 200, "\U0001f600‍️" * 9]
    texts += ["".join(map(chr, range(a, a + 400))) for a in range(0, 0x3000, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for r in bpe_digests(df, path).collect():
        ids = theirs.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        want = theirs.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    both = bpe.bpe_decode(bpe.bpe_encode(df, path), path).collect()
    assert all(r["decoded"] == (texts[r["doc_id"]] or "") for r in both)
    assert bpe_digests(empty(spark), path).count() == 0


def test_bpe_invalid_bytes():
    c = bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    assert c.decode(c.encode("日")[:1]) == "�"
    for text in ("thereupon", "reeeeeeeee", "0000011111"):
        assert c.encode_fragment(text.encode()) == c.merge(text.encode())


# 10 sharding


def test_sharding(spark):
    rng = np.random.default_rng(7)
    docs = [(i, "é" * int(rng.integers(0, 400))) for i in range(3000)] + [(i, "copy" * 50) for i in range(3000, 4500)] + [r[:2] for r in HARD if r[0] != 5]
    records = sharding.record_sizes(spark.createDataFrame(docs, DOCS))
    slots = sharding.slot_map(sharding.slot_loads(records), 8)
    out = sharding.assign(records, slots).toPandas()
    assert sorted(out["size"]) == sorted(len((t or "").encode()) + 16 for _, t in docs)
    assert sorted(out["text_crc32"]) == sorted(zlib.crc32((t or "").encode()) for _, t in docs)
    for _, g in out.groupby("shard"):
        assert sorted(g["position"]) == list(range(len(g)))
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() - loads.min() < 0.01 * loads.mean()
    grown = sharding.grow(slots, 8, 2)
    moves = slots.join(grown.select("virtual_slot", F.col("shard").alias("new")), "virtual_slot").where("shard <> new").select("new").distinct().collect()
    assert [r["new"] for r in moves] == [8]
    held = sharding.assign(records, grown).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()["n"]
    assert len(held) == 9 and held.max() / held.mean() < 1.05
    assert sharding.assign(sharding.record_sizes(empty(spark)), slots).count() == 0


# registered queries


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'" if not __import__("os").path.isdir(f"{sf}/{t}.parquet") else f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    found = registry.queries()[name](spark, sf).toPandas()
    want = c.execute(registry.oracle_sql()[name]).df()[list(found.columns)]
    key = lambda df: sorted(tuple("" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x).removesuffix(".0") for x in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))
    clean = lambda rows: [tuple(re.sub(r"\.0+$", "", x) for x in r) for r in rows]
    assert clean(key(found)) == clean(key(want))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert 0 < len(out) < docs.count() and out["lossless"].all()
    assert set(out["doc_id"]) == {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert len({r["text"] for r in kept.select("text").collect()}) == len(out)
