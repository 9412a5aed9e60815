"""The corpus operators against plain versions, held-out accuracy and awkward rows."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from specgrid.llm import ann, decontaminate, entry, html_text, langid, mixing, ngram_join, preference, quality, sharding, toxicity
from specgrid.llm.common import ALNUM_AZ

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, label string"
LONG = "lorem ipsum dolor sit amet " * 20000
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "a", 3), (5, "one", "en", "a", 3), (6, LONG, "en", "b", len(LONG)),
    (7, "one two three four five six seven eight", "en", None, 5), (7, "one two three four five six seven eight", "en", None, 5), (None, "no id at all here", "fr", "b", 3), (8, "\x00� é ß 漢字 😀", "de", "c", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in ODD], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def run(name, spark, sf):
    return entry.QUERIES[name](spark, sf)


# --- sharding and mixing


def test_shards(spark, sf, docs):
    rows = run("op2_virtual_slots", spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    load, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and 0 <= r["shard"] < 8
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values())


def test_slot_map_versions_move_little(spark, tmp_path):
    rng = random.Random(1)
    first, sizes = sharding.initial_map(8), {s: rng.randrange(1, 1000) for s in range(sharding.SLOTS)}
    even = sharding.rebalance(first, sizes, 8)
    load = lambda m: [sum(sizes[s] for s, x in m.items() if x == k) for k in range(8)]
    assert max(load(even)) - min(load(even)) < max(load(first)) - min(load(first)) and sum(even[s] != first[s] for s in first) < 400
    more = sharding.grow(even, sizes, 8)
    assert all(more[s] in (even[s], 8) for s in more) and abs(sum(sizes[s] for s in more if more[s] == 8) / sum(sizes.values()) - 1 / 9) < 0.01
    store = sharding.SlotMap(spark, str(tmp_path / "map"))
    store.append(1, first, sizes)
    store.append(2, even, sizes)
    assert {r["slot"]: r["shard"] for r in store.version().collect()} == even and store.version(1).count() == sharding.SLOTS


def test_sharding_odd_rows(odd, none):
    got = sharding.shard(odd, 3).collect()
    assert len(got) == len(ODD) and {r["label"] for r in got} == {"z"} and sharding.shard(none).count() == 0


def test_equal_rows_keep_the_law(spark):
    rows = [(7, "the same")] * 9000 + [(None, None)] * 3000 + [(i, "x" * (i % 90)) for i in range(6000)]
    for text_rows in (rows, rows[:12000]):
        got = sharding.shard(spark.createDataFrame(text_rows, "doc_id long, text string").repartition(5), 8).collect()
        load, places = defaultdict(int), defaultdict(list)
        for r in got:
            load[r["shard"]] += r["size"]
            places[r["shard"]].append(r["slot"])
        assert len(got) == len(text_rows) and max(load.values()) - min(load.values()) <= 0.02 * sum(load.values())
        assert all(sorted(x) == list(range(len(x))) for x in places.values())
    assert {(r["size"], r["text_crc32"]) for r in got if r["text"] is None} == {(1, 0)}


def plain_targets(sizes):
    """Targets by reshare until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            return full | {s: left * weight[s] / total for s in rest}
        for s in over:
            full[s] = 2 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(full.values())


def test_mixing(spark, sf):
    rows = run("op8_pivotal_mix", spark, sf).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    for s, t in plain_targets(sizes).items():
        assert abs(target[s] - t) < 1e-6 * (1 + t)
        assert abs(taken[s] - t) <= max(r["size"] for r in rows if r["source"] == s)
    again = {(r["doc_id"], r["taken"]) for r in run("op8_pivotal_mix", spark, sf).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_mixing_is_fair_and_conserves_words(spark):
    rows = [(i, "a", 10 + i % 7, i) for i in range(900)] + [(i, "b", 50, i) for i in range(900, 1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, h long")
    hits = np.zeros(1000)
    for seed in range(6):
        got = mixing.rounded_copies(df, weights=(1.0, 1.0), share=0.6, seed=1000 * seed).collect()
        took = sum(r["size"] * (r["base"] + r["extra"]) for r in got if r["source"] == "a")
        assert abs(took - got[0]["target"]) <= 60
        for r in got:
            hits[r["doc_id"]] += r["base"] + r["extra"]
    rate = next(r["target"] / r["source_size"] for r in got if r["source"] == "a")
    assert abs(hits[:300].mean() / 6 - rate) < 0.06 and abs(hits[600:900].mean() / 6 - rate) < 0.06


def test_mixing_odd_rows(odd, none):
    got = mixing.mix(odd)
    assert got.columns == odd.columns and mixing.mix(none).count() == 0
    rows = odd.select("doc_id", "source", mixing.word_count().alias("size"), mixing.row_hash().alias("h"))
    hashes = [r[0] for r in odd.sparkSession.createDataFrame([(1, None, "a"), (1, "a", None), (None, None, None)], "doc_id long, text string, source string").select(mixing.row_hash()).collect()]
    assert len(set(hashes)) == 3
    assert sum(r["m"] for r in mixing.rounded_copies(rows).collect()) == len(ODD)


# --- decontamination


def plain_contamination(docs, items, window=13):
    words = lambda t: t.encode().translate(ALNUM_AZ).split() if t else []
    spans = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            spans[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in spans}:
            for k in range(len(w) - n + 1):
                if x := spans.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark, sf, docs):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = plain_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    got = run("op3_positional_index", spark, sf)
    assert got.columns[-1] == "n_near" and sorted((tuple(r)[:-1] for r in got.collect()), key=str) == want and any(r[-1] for r in want)


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(10, "one"), (11, "one two three"), (12, None), (13, "..."), (14, "the the the the"), (15, "one"), (None, "no id at")], "item_id long, text string")
    got = decontaminate.decontaminate(odd, bench, columns=["doc_id"])
    rows = sorted(((r["doc_id"], r["n_words"], sum(b - a for a, b in r["hit_spans"]), r["item_ids"]) for r in got.collect()), key=str)
    want = plain_contamination([r[:2] for r in ODD], [(10, "one"), (11, "one two three"), (14, "the the the the"), (15, "one")])
    assert [r[:2] for r in rows] == [r[:2] for r in want] and [len(r[3]) for r in rows] == [r[3] for r in want]
    assert decontaminate.clean(none, bench).count() == 0 and decontaminate.clean(odd, bench.where("false")).count() == len(ODD)


def test_proximity(spark):
    words = " ".join(f"w{i}" for i in range(13))
    near = " ".join(f"w{i}" + (" extra" if i == 6 else "") for i in range(13))
    docs = spark.createDataFrame([(1, words), (2, near), (3, " ".join(f"w{i}" for i in range(1, 12)))], "doc_id long, text string")
    items = {0: decontaminate.words(words.encode())}
    df = decontaminate.document_frequencies(docs, set(items[0]))
    rows = decontaminate.anchors({0: items[0]}, {w: (1 if w in (b"w0", b"w12") else 5) for w in df})
    index = decontaminate.build_index(docs, {r[0] for r in rows})
    ids = {r["doc"]: r["doc_id"] for r in docs.select("doc_id", decontaminate.text_hash()).collect()}
    assert {ids[r["doc"]] for r in decontaminate.alignments(index, rows).collect()} == {1}
    assert {(ids[r["doc"]], r["drift"]) for r in decontaminate.proximity_matches(index, rows).collect()} == {(1, 0), (2, 1)}
    bench = spark.createDataFrame([("a", words)], "item_id string, text string")
    assert {r["doc_id"]: r["n_near"] for r in decontaminate.decontaminate(docs, bench, near=True).collect()} == {1: 0, 2: 1, 3: 0}


def test_contamination_in_blocks_and_with_odd_rows(spark, monkeypatch):
    """Several blocks of items, repeated and missing ids on both sides, copies of one text, and columns named like the operator's."""
    rng = random.Random(6)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randrange(40))
    items = [(f"i{i % 9}", " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(12)] + [(None, " ".join(word() for _ in range(20))), ("e", ""), ("n", None)]
    texts = []
    for i in range(60):
        ws = [word() for _ in range(rng.randrange(1, 60))]
        if i % 3 == 0:
            own = (items[rng.randrange(13)][1] or "").split()
            ws[rng.randrange(len(ws)) :] = own[rng.randrange(3) :] if i % 2 else own
        texts.append(" ".join(ws))
    texts += texts[:20]
    rows = [(None if i % 7 == 0 else i % 5, t, 777, "x", "y") for i, t in enumerate(texts)] + [(1, None, 777, "x", "y"), (None, "", 777, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, `__words` string, item_ids string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    bench = spark.createDataFrame(items, "item_id string, text string")
    plain = {t: rest for t, rest in ((r[0], r[1:]) for r in plain_contamination([(t, t) for t in {r[1] for r in rows}], [(k if k is not None else "?", t) for k, t in items]))}
    got = decontaminate.decontaminate(docs, bench)
    assert got.columns == ["doc_id", "text", "__words", "n_words", "hit_spans", "item_ids"]
    got = got.withColumn("n_hit", decontaminate.n_hit()).withColumn("bad", decontaminate.contaminated()).collect()
    assert len(got) == len(rows) and any(r["bad"] for r in got)
    for r in got:
        n_words, n_hit, _, _, bad = plain[r["text"]]
        assert (r["n_words"], r["n_hit"], r["bad"]) == (n_words, n_hit, bad)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(map(str, (r["text"] for r in kept.collect()))) == sorted(str(r[1]) for r in rows if not plain[r[1]][-1]) and {r["n_words"] for r in kept.collect()} == {777}


# --- similarity


def plain_components(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    group = {i: i for i in sets}
    ids, n_links = list(sets), 0
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                n_links += x != y
                old, new = sorted((group[ids[a]], group[ids[b]]), reverse=True)
                group = {i: new if g == old else g for i, g in group.items()}
    return sorted((i, len(sets[i]), group[i]) for i in sets), n_links


def test_components_of_planted_copies(spark):
    rng = random.Random(5)
    rows = []
    for size in (5, 9, 14, 40, 90, 300):
        for base in range(3):
            words = [f"w{rng.randrange(4000)}" for _ in range(size)]
            for edit in range(7):
                copy = list(words)
                for _ in range(edit * max(1, size // 60)):
                    copy[rng.randrange(len(copy))] = f"x{rng.randrange(4000)}"
                rows.append((len(rows), " ".join(copy + [f"y{edit}"] * (edit % 2))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80)):
        want, n_links = plain_components(rows, k, percent)
        got = sorted((r["doc_id"], r["n"], r["component_id"]) for r in ngram_join.components(df, k, percent).collect())
        assert got == want and len({c for _, _, c in want}) < len(rows)
    every, _ = ngram_join.links(df, 5, 80)
    assert every.count() == n_links  # no two rows of one text here


def test_components_dealt_over_parts(spark, monkeypatch):
    """A large group of near copies, a chain whose ends aren't similar, and texts that share a passage only, in parts of a few members."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, passage, chain = [word() for _ in range(60)], [word() for _ in range(25)], [word() for _ in range(80)]
    texts = [base[:i] + [word()] + base[i + 1 :] for i in range(60)]
    texts += [passage + [word() for _ in range(6)] for _ in range(25)] + [passage + [word()] for _ in range(3)]
    texts += [chain[i : i + 60] for i in range(0, 21, 2)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for name, value in (("BLOCK", 4), ("REST", 5), ("CHUNK_ENTRIES", 500), ("SLICE_BYTES", 700)):
        monkeypatch.setattr(ngram_join, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, n_links = plain_components(rows, 4, 85)
    assert sorted((r["doc_id"], r["n"], r["component_id"]) for r in ngram_join.components(df).collect()) == want
    assert {c for _, _, c in want} != {i for i, _ in rows} and ngram_join.links(df)[0].count() == n_links


def test_components_of_the_table(spark, sf, docs):
    want, _ = plain_components([(r["doc_id"], r["text"]) for r in docs.collect()], 4, 85)
    assert sorted(map(tuple, run("op5_count_vector_rtree", spark, sf).collect())) == want


def test_page_names_meet_for_every_similar_pair():
    rng = np.random.default_rng(2)
    for t in (0.8, 0.85):
        for n in (6, 7, 12, 33, 64, 150, 700):
            for _ in range(20):
                x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
                most = int((1 - t) / t * len(x))
                y = np.unique(np.concatenate([x[: len(x)], rng.integers(0, 1 << 62, most).astype(np.uint64)]))
                if len(x) >= t * len(y) and len(y) > len(x):
                    assert np.intersect1d(ngram_join.page_names(x, t), ngram_join.page_names(y, t)).size


def test_tree_join_equals_all_pairs():
    rng = np.random.default_rng(3)
    n = rng.integers(20, 60, 300)
    points = np.stack([np.bincount(rng.integers(0, 32, k), minlength=32) for k in n]).astype(np.int32)
    points[150:] = points[:150] + (rng.random((150, 32)) < 0.1)
    n = points.sum(axis=1)
    good = lambda i, j: np.minimum(points[i], points[j]).sum() >= np.ceil(0.85 / 1.85 * (n[i] + n[j]) - 1e-6)
    tree = ngram_join.RTree(points, n)
    got = [(min(i, j), max(i, j)) for i, j in zip(*ngram_join.tree_join(tree, tree, 0.85), strict=True)]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if good(i, j)}
    assert set(got) == want and len(got) == len(want) >= 100
    few, many = np.arange(20), np.arange(20, 300)
    got = ngram_join.tree_join(ngram_join.RTree(points[few], n[few]), ngram_join.RTree(points[many], n[many]), 0.85)
    assert set(zip(few[got[0]], many[got[1]], strict=True)) == {(i, j) for i in few for j in many if good(i, j)}
    left, right = np.repeat([[9, 0] * 16], 40, axis=0), np.repeat([[0, 9] * 16], 40, axis=0)
    assert not len(ngram_join.tree_join(ngram_join.RTree(left, left.sum(axis=1)), ngram_join.RTree(right, right.sum(axis=1)), 0.85)[0])


def test_bounds_keep_every_similar_pair():
    """Count vectors and parities of neighbouring levels, folded, never rule out a pair that is similar."""
    rng = np.random.default_rng(4)
    sets = []
    for n in (6, 31, 60, 64, 130, 255, 500, 1030, 2040):
        base = rng.integers(0, 1 << 62, n).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[int(drop * n) :], rng.integers(0, 1 << 62, int(add * n)).astype(np.uint64)])) for drop, add in ((0, 0), (0.1, 0), (0, 0.16), (0.05, 0.05), (0.3, 0))]
    members = ngram_join.Members(np.array(list(map(len, sets))), [ngram_join.counts(x).tobytes() for x in sets], [ngram_join.parities(x).tobytes() for x in sets])
    got = {(min(i, j), max(i, j)) for i, j in zip(*members.possible(0.85), strict=True)}
    similar = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(np.intersect1d(sets[i], sets[j])) >= 0.85 * len(np.union1d(sets[i], sets[j]))}
    assert similar <= got and len(similar) > 30 and len(got) < 200


def test_near_copies_odd_rows(odd, none):
    got = ngram_join.without_near_copies(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, [1, 2, 3, 4, 6, 7, None, 8]))
    assert ngram_join.without_near_copies(none).count() == 0


# --- classifiers


def accuracy(df, right):
    return df.select(F.avg(right.cast("int"))).first()[0]


def test_language(spark, docs):
    train = docs.where("doc_id % 3 <> 1").select("doc_id", "text", "lang")
    got = langid.predict(docs.where("doc_id % 3 = 1"), langid.fit(train)).join(docs.select("doc_id", "lang"), "doc_id")
    assert accuracy(got, F.col("lang") == F.col("lang_pred")) > 0.95


def test_language_odd_rows(odd, none):
    rows = {r["doc_id"]: r for r in langid.predict(odd, langid.fit(odd.where("lang is not null").select("doc_id", "text", "lang"))).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[6]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in rows.values())
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"} and langid.predict(none, langid.fit(odd.select("doc_id", "text", "lang").where("lang = 'en'"))).count() == 0


def ranked(pairs):
    """Share of (score, label) pairs of both labels that are in the right order."""
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_the_three_classifier_queries(spark):
    """On rows that the fit may not use: languages, toxic rows and quality ratings."""
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    crc = lambda i, n: zlib.crc32(str(i).encode()) % n
    got = run("op4_nearest_centroid", spark, sf).collect()
    assert len(got) == len(docs) and all(r["held_out"] == (crc(r["doc_id"], 3) == 1) for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] is not None]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.95
    got = run("op1_cumulative_link", spark, sf).collect()
    assert len(got) == len(docs) and all(r["selected"] == (r["tail_probability"] >= 0.5) for r in got)
    assert ranked([(r["expected_grade"], labels[r["doc_id"]]["quality"]) for r in got if r["held_out"] and r["doc_id"] in labels]) > 0.95
    sf = "/root/testdata/sf0.1"  # smaller tables hold a handful of toxic rows
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = run("op10_noisy_channel", spark, sf).collect()
    assert len(got) == 10_000 and all(r["held_out"] == (crc(r["doc_id"], 5) == 0) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert ranked([(r["score"], labels[r["doc_id"]]["toxic"]) for r in got if r["held_out"] and r["doc_id"] in labels]) > 0.9


def test_decoder_finds_the_likeliest_spelling():
    """Against all paths through the lattice of short tokens."""
    rng = np.random.default_rng(5)
    lm = toxicity.language_model(rng.poisson(0.3, toxicity.LETTERS**4).astype(float))
    tokens = ["1d10t", "$tuuupid", "a(1|<", "m00r0n!", "l.o.l", "4@$8!", "heeello", "x", "7+1|!", "b8b8b8"] + ["".join(rng.choice(list("ab1|$0."), 7)) for _ in range(20)]
    for token in tokens:
        paths = [((0, 0, 0), 0.0, "")]
        for i in range(len(token)):
            paths = [((*c[1:], ord(x) - 96) if x else c, s - cost + (float(lm[(*c, ord(x) - 96)]) if x else 0), t + shown) for c, s, t in paths for x, shown, cost in toxicity.arcs_of(token, i)]
        best = max(s + float(lm[(*c, 0)]) for c, s, _ in paths)
        own = toxicity.decode(token, lm)
        assert max(s + float(lm[(*c, 0)]) for c, s, t in paths if t == own) == pytest.approx(best, abs=1e-5), token


def test_invalid_utf8(spark):
    raw = spark.createDataFrame([(i, bytearray(b"some words \xff\xfe here \xe9t\xe9")) for i in range(3)], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text", "'en' as lang", "doc_id % 2 as toxic")
    assert {r["lang_pred"] for r in langid.predict(raw, langid.fit(raw)).collect()} == {"en"}
    assert toxicity.scores(raw, toxicity.fit(raw, raw)).count() == 3
    ratings = raw.select("doc_id", F.col("toxic").cast("int").alias("grade"))
    assert quality.grade(raw, quality.fit(raw, ratings)).where("expected_grade is not null").count() == 3


def test_repeated_ids_and_numerals(spark):
    rows = spark.createDataFrame([(i // 300, f"text {i}", i // 300) for i in range(600)] + [(9, "²½Ⅷ", None)], "doc_id long, text string, grade int")
    grades, w, _ = quality.fit(rows, rows.select("doc_id", "grade").distinct())
    assert grades == [0, 1] and len(w) == quality.DIMS
    a, b = (quality.features(x, quality.Powers()) for x in (b"good cats", b"evil dogs"))
    assert not np.array_equal(a, b) and np.array_equal(a, quality.features(b"good cats", quality.Powers()))
    assert langid.term_counts("²½Ⅷ".encode()) is None and langid.term_counts("²½a".encode()) is not None


def test_decoder():
    words = "you are an idiot and a stupid moron with some trash in the house said the clown".split()
    grams = np.zeros(toxicity.LETTERS**4)
    for w in words * 20:
        c = [0, 0, 0, *(ord(x) - 96 for x in w), 0]
        for i in range(len(c) - 3):
            grams[((c[i] * 27 + c[i + 1]) * 27 + c[i + 2]) * 27 + c[i + 3]] += 1
    r = toxicity.Restorer(toxicity.language_model(grams))
    assert r.text("you 1d10t and stuuupid m0r0n") == "you idiot and stupid moron"
    assert r.text("a m0r0n5 and some tras7") == "a morons and some trast" or "moron" in r.text("m0r0n5")
    assert "stupid" in r.text("so s t u p i d it is") and "clown" in r.text("a c.l.0.w.n here") and r.text("plain words stay as they are") == "plain words stay as they are"


def toxic_rows(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        words, toxic = [rng.choice(["house", "river", "green", "walk", "table", "cloud", "paper"]) + rng.choice(["", "s", "ing"]) for _ in range(30)], i % 5 == 0
        if toxic:
            bad = rng.choice(["idiot", "stupid"])
            words[rng.randrange(30)] = bad if i < 500 else {"idiot": "1d10t", "stupid": "s t u p i d"}[bad]
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity(spark):
    df = toxic_rows(spark)
    model = toxicity.fit(df, df.where("doc_id < 500").select("doc_id", "toxic"))
    got = toxicity.scores(df.where("doc_id >= 500"), model).join(df, "doc_id")
    assert accuracy(got, (F.col("__score") >= 0.5) == (F.col("toxic") == 1)) > 0.95
    assert toxicity.without_toxic(df, df.select("doc_id", "toxic")).columns == df.columns


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (4, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for some in (labels, labels.where("false")):
        got = toxicity.scores(odd, toxicity.fit(odd, some)).collect()
        assert len(got) == len(ODD) and all(0 <= r["__score"] <= 1 for r in got)
    assert toxicity.scores(none, toxicity.fit(none, labels)).count() == 0


def test_ordinal_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    w, cut = np.array([1.5, -1, 0.5, 0, 0]), np.array([-1.0, 0.5, 2.0])
    u = rng.logistic(size=4000)
    y = (x @ w + u)[:, None] > cut[None, :]
    got_w, got_cut = quality.cumulative_link(x, y.sum(axis=1), np.ones(4000), 4, rounds=800)
    assert np.allclose(got_w, w, atol=0.2) and np.allclose(got_cut, cut, atol=0.2) and (np.diff(got_cut) > 0).all()


def test_quality_grades(spark):
    rng = random.Random(2)
    text = lambda g: " ".join(rng.choice(["Good", "words", "here,", "fine."]) if rng.random() < g / 3 else rng.choice(["###", "$$$", "!!!"]) for _ in range(60))
    df = spark.createDataFrame([(i, text(i % 4), i % 4) for i in range(800)], "doc_id long, text string, grade int")
    model = quality.fit(df, df.where("doc_id < 600").select("doc_id", "grade"))
    got = quality.grade(df.where("doc_id >= 600"), model).join(df, "doc_id")
    assert got.select(F.corr("expected_grade", "grade")).first()[0] > 0.9
    low, high = (quality.grade(df, model, r).agg(F.avg("tail_probability")).first()[0] for r in (1, 3))
    assert low > high


def test_quality_odd_rows(spark, odd, none):
    ratings = spark.createDataFrame([(2, 0), (6, 1), (6, 1), (None, 1), (7, None)], "doc_id long, grade int")
    for some in (ratings, ratings.where("grade = 1"), ratings.where("false")):
        assert quality.grade(odd, quality.fit(odd, some)).count() == len(ODD)
    assert quality.grade(none, quality.fit(none, ratings)).count() == 0


# --- pages, vectors, conversations


def test_templates_and_marked_blocks(spark):
    page = lambda i: f"""<!DOCTYPE html><html><head><title>t{i}</title><script>var a="</p>";</script></head><body><div><a href=/>Home</a> <a href=/x>Our site</a></div><nav>menu</nav>
      <article><h1>Title {i}</h1><p>First &amp; <b>bold {i}<br>line<p>Same words everywhere.</p><div class="share-box">Share me</div><div><span>boxed template</span></div><ul><li>item {i}<li>two</ul></article>
      <div id="comments"><p>I disagree {i}</p></div><aside>side</aside><footer>&copy; site</footer></body>"""  # noqa: E731
    df = spark.createDataFrame([(i, "https://www.site.example/a", page(i)) for i in range(8)] + [(8, "https://other.example", "<p>Only &lt;this&gt;</p> tail"), (9, None, None), (10, "x", ""), (11, "https://o.example", "<div><p>cut off")], "page_id long, url string, html string")
    for keys in (html_text.BROADCAST_KEYS, -1):
        got = {r["page_id"]: r for r in html_text.extract(df, broadcast_keys=keys).collect()}
        for i in range(8):
            assert got[i]["text"] == f"Title {i}\nFirst & bold {i} line\nSame words everywhere.\nitem {i}\ntwo"
            assert got[i]["n_template"] >= 4
        assert got[8]["text"] == "Only <this>\ntail" and got[9]["text"] == got[10]["text"] == "" and got[11]["text"] == "cut off" and got[8]["n_chars"] == 16
    bare = spark.createDataFrame([(i, "http://b.example/", f"<body><div><span>Site name</span></div><div>Own words {i}</div></body>") for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract(bare).collect()} == {f"Own words {i}" for i in range(9)}
    assert html_text.extract(df.where("false")).count() == 0


@pytest.mark.parametrize(("tail", "text"), [
    ("last words <a hre", "last words"), ("last words <a href='x y", "last words"), ("last words </", "last words"), ("last words <!-", "last words"), ("a < b and 3<4 &lt; 5", "a < b and 3<4 < 5"),
    ("a < b <b", "a < b"), ("less <", "less <"), ('see <a href="x>this and the rest', "see this and the rest"),
])
def test_text_after_the_last_tag(tail, text):
    assert html_text.text_of("<body><p>First.</p><p>" + tail, b"", lambda key: False)[0] == "First.\n" + text


@pytest.mark.parametrize(("page", "text"), [
    ("<p>3 < 5 is true", "3 < 5 is true"), ('<article class="overflow-hidden"><p>x</p></article>', "x"), ('<p>a <a href="/the/hidden/gem">gem</a></p>', "a gem"), ('<article><div class="post-header"><h1>Title</h1></div><p>a</p></article>', "Title\na"),
    ('<p class="x>Hello</p>', "Hello"), ('<p title="a > b">Hello</p>', "Hello"), ("<div hidden>a</div><div style='color:red; display: none'>b</div><div aria-hidden=true>c</div>d", "d"), ('<article><header><h1>T</h1></header>a</article><header>b</header>', "T\na"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<p>y<div>z</div>", "a\nb\nc\nd\n1\n2\n3\nx\ny\nz"), ('<article><p>a</p><article class="related-post"><p>b</p></article></article>', "a"), ("</p></x>a</div>b", "ab"),
])
def test_markup(page, text):
    assert html_text.text_of(page, b"", lambda key: False)[0] == text


def test_deep_nesting_takes_one_pass():
    import time

    def took(n):
        began = time.process_time()
        assert html_text.text_of("<div>" * n + "deep" + "</p></x></div>" * n + "<p>after", b"", lambda key: False)[0].startswith("deep")
        return time.process_time() - began

    assert took(20000) < 40 * max(0.01, took(2000))


def test_site_without_telling_tags_or_classes(spark):
    around = "<div><div>Our shop</div><div>Buy it now</div></div>"
    rows = [(i, "http://plain.example/%d" % i, f"<html><body>{around}<div><p>Story {i} begins.</p><p>And ends.</p></div><div>Call us<div>every day</div></div></body></html>") for i in range(6)]
    rows += [(10 + i, "http://other.example/%d" % i, f"<body>{around}<div>Few pages {i}</div></body>") for i in range(4)]
    got = {r["page_id"]: (r["text"], r["n_template"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # the second paragraph recurs as well, on pages that mark no article
    assert all(got[i] == (f"Story {i} begins.", 3) for i in range(6)) and all(got[10 + i] == (f"Our shop\nBuy it now\nFew pages {i}", 0) for i in range(4))


def test_copied_pages_are_not_template(spark):
    boxed = "<body><div>Site name</div><article><h1>One</h1><div><p>Own words.</p><p>More of them.</p></div></article></body>"
    bare = "<body><div>Site name</div><h1>Two</h1><p>Bare words.</p><ul><li>point</ul></body>"
    urls = [f"{s}://c.example/a{q}" for s in ("http", "https") for q in ("", "?utm_source=x", "?utm_source=y")]
    rows = [(i, url, page) for page in (boxed, bare + "<footer>%d</footer>") for i, url in enumerate(urls)]
    rows = [(i + 10 * ("%d" in page), url, page.replace("%d", str(i))) for i, url, page in rows] + [(100 + i, "http://c.example/", f"<div>Site name</div><p>Page {i}</p>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for keys in (html_text.BROADCAST_KEYS, -1):
        got = {r["page_id"]: r["text"] for r in html_text.extract(df, broadcast_keys=keys).collect()}
        assert {got[i] for i in range(6)} == {"One\nOwn words.\nMore of them."}
        assert {got[10 + i] for i in range(6)} == {"Two\nBare words.\npoint"}
        assert [got[100 + i] for i in range(5)] == [f"Page {i}" for i in range(5)] and len(got) == 17


def test_template_of_a_large_host(spark):
    notice = "<div><p>Section notice</p></div>"
    df = spark.range(3000).selectExpr("id as page_id", "'http://large.example/' as url", f"concat('<article><p>Page ', id, '</p>', if(id < 5, '{notice}', ''), if(id between 10 and 13, '<div><p>four</p></div>', ''), '</article>') as html")
    for keys in (html_text.BROADCAST_KEYS, -1):
        got = {r["page_id"]: r["text"] for r in html_text.extract(df, broadcast_keys=keys).collect()}
        assert got == {i: f"Page {i}" + "\nfour" * (10 <= i <= 13) for i in range(3000)}


def test_pages_of_the_table(spark, sf):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = run("op6_site_template", spark, sf).collect()
    assert run("op6_site_template", spark, "/root/testdata/sf0.1").agg(F.sum("n_template")).first()[0] > 1000  # more pages of a host
    for r in got:
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert r["text"] == "\n".join(b for b in blocks if b)


def plain_nearest(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i in queries:
            near = sorted((-float(v @ w) / (np.sqrt(v @ v) * np.sqrt(w @ w)), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [j for _, j in near[:k]]
    return out


def test_neighbours(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = plain_nearest(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got = defaultdict(list)
    for r in sorted(run("op7_cross_polytope", spark, sf).collect()):
        got[r["query_id"]].append(r["vec_id"])
    assert got.keys() == want.keys() and sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_recall_ranks_and_scores(spark):
    """The largest table of vectors at hand: recall against brute force, and what is returned is exact and in order."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = df.collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    got = defaultdict(list)
    for r in run("op7_cross_polytope", spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = (x * x[q]).sum(axis=1) / (norm * norm[q])
        order = [j for j in np.lexsort((ids, -score)) if j != q][:5]
        rank, vec, s = zip(*got[ids[q]], strict=True)
        place = {v: j for j, v in enumerate(ids)}
        assert rank == (1, 2, 3, 4, 5) and all(a >= b - ann.TIE for a, b in zip(s, s[1:], strict=False)) and np.allclose(s, [score[place[v]] for v in vec], atol=1e-12)
        hit, total = hit + len(set(ids[order]) & set(vec)), total + 5
    assert len(got) == total // 5 and hit >= 0.9 * total


def test_neighbours_in_split_slots(spark, monkeypatch):
    """Slots dealt over several groups, for rows and for queries, find what one group finds; parallel vectors tie by id."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(300)] + [(300 + i, [(1.0 + i) * x for x in (1.0, 2.0, 3.0, 4.0, 0.0, 1.0, 0.0, 1.0)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    asked = df.where("vec_id % 20 = 0")
    found = lambda: sorted(map(tuple, ann.nearest(df, asked).collect()))
    want = found()
    monkeypatch.setattr(ann, "GROUP_ROWS", 7)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 3)
    assert found() == want and [r[2] for r in want if r[0] == 300] == [301, 302, 303, 304, 305] and [r[2] for r in want if r[0] == 320] == [300, 301, 302, 303, 304]


def test_neighbours_odd_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(30)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (105, [3.0, 1.0, 0.0]), (106, [1.0, 1.0]), (107, []), (0, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = defaultdict(list)
    for r in sorted(ann.nearest(df, df.where("vec_id in (0, 3, 100, 101, 105, 106)")).collect()):
        got[r["query_id"]].append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 3: [0, 1, 2, 4, 5], 105: [0, 1, 2, 3, 4]}
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_neighbours_scaled_and_shared_ids(spark):
    rng = np.random.default_rng(3)
    v = [1.0, 2.0, 3.0, 4.0]
    scaled = [(int(i), [x * 2.0**p for x in v]) for p, i in enumerate(rng.permutation(40))]
    near = lambda by: [float(x) for x in np.array(v) + by * rng.standard_normal(4)]
    # the query's id and one other stand on many rows nearer than the true neighbours
    shared = [(0, v)] + [(0, near(1e-4)) for _ in range(12)] + [(1, near(1e-3)) for _ in range(30)] + [(i, near(1e-2)) for i in range(2, 12)]
    for rows in (scaled, shared):
        df = spark.createDataFrame(rows, "vec_id long, v array<double>")
        asked = spark.createDataFrame([(0, v)], df.schema)
        plain = {}
        for i, w in rows:
            score = float((np.array(v) * np.array(w)).sum() / (np.sqrt((np.array(v) ** 2).sum()) * np.sqrt((np.array(w) ** 2).sum())))
            plain[i] = max(score, plain.get(i, -2))
        want = sorted((-s, i) for i, s in plain.items() if i != 0)[:5]
        for tables, probes in ((1, None), (ann.TABLES, ann.PROBES)):
            got = sorted(ann.nearest(df, asked, tables=tables, probes=probes).collect(), key=lambda r: r["rank"])
            assert [r["vec_id"] for r in got] == [i for _, i in want] and np.allclose([-r["score"] for r in got], [s for s, _ in want])


def test_preference_pairs(spark, sf):
    df = run("op9_preference_format", spark, sf)
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(entry.ORACLE_SQL["op9_preference_format"]).fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_preference_odd_rows(spark):
    turn = "array<struct<turn: bigint, role: string, text: string>>"
    a, b, c = (0, "user", "hi"), (1, "assistant", "yes é😀"), (1, "assistant", "no")
    pairs = spark.createDataFrame([(1, [a, b], [a, c]), (2, [a, b], [a, b]), (3, [a], [a, b]), (4, None, [a]), (5, [], [])], f"id int, chosen {turn}, rejected {turn}")
    rows = {r["id"]: r for r in preference.format_pairs(pairs).collect()}
    for r in rows.values():
        for side in ("chosen", "rejected"):
            text = r[f"{side}_completion"]
            assert all(text[x["start"] : x["end"]].endswith("\n<|end|>\n") for x in r[f"{side}_mask"])
    assert rows[1]["n_prefix"] == 1 and rows[1]["prompt"] == "<|user|>\nhi\n<|end|>\n" and rows[1]["chosen_completion"][rows[1]["chosen_mask"][0]["start"] :].startswith("yes é😀")
    assert rows[2]["n_prefix"] == 2 and rows[2]["chosen_completion"] == "" and rows[3]["chosen_completion"] == "" and rows[3]["rejected_completion"] and rows[4]["prompt"] == "" and rows[5]["chosen_mask"] == []
    conv = spark.createDataFrame([(None, 0, "user", "x"), (1, 0, None, None), (1, 1, "assistant", None), (2, 0, "assistant", "b"), (4, 0, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert [r["conv_id"] for r in preference.reply_pairs(conv).collect()] == [1] and preference.format_pairs(preference.reply_pairs(conv.where("false"))).count() == 0


def test_html_tokens_equal_a_pattern_and_take_linear_time():
    pattern = re.compile(
        r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
        r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|([^>]*)>)",
        re.S | re.I,
    )
    pieces = ["<div", "<p>", "</p", "</div>", "<script", "</script >", "<script>", "</SCRIPT>", "<!--", "-->", "<!doctype", "<?x", ">", ">", '"', "'", ' a="', " b='", "x ", "<", "</", "/", "\n", "<b-c", "<script-x", "<title>", "</title>", "&amp;", "=", "--"]
    rng = random.Random(11)
    for _ in range(20_000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        want = [(m.start(), m.end(), bool(m[2]), (m[3] or "").lower(), (m[4] if m[4] is not None else m[5]) or "") for m in pattern.finditer(page)]
        assert list(html_text.tokens(page)) == want, page
    for piece in ("<script a='", '<div a="', "<div ", "<", "<!", "<a b='\"", "<script a='\" ", "<p>", "<b a=\"'>", "</div x='>", "<!-- "):
        for tail in ("", ">", "'>", '"'):
            started = time.perf_counter()
            html_text.parse(piece * 20_000 + tail)
            assert time.perf_counter() - started < 2, (piece, tail)
