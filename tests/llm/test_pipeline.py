"""The corpus pipeline, stage by stage, on the smallest tables and on awkward rows."""

import re
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from specgrid.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from specgrid.llm.common import saved
from tests.llm.test_llm import ODD, plain_components, plain_contamination, plain_targets


def words_of(rows):
    """Words by source, and the most words of a document of each."""
    total, most = defaultdict(int), defaultdict(int)
    for r in rows:
        n = len((r["text"] or "").encode().split())
        total[r["source"]] += n
        most[r["source"]] = max(most[r["source"]], n)
    return total, most


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, sf))
        if name != "sharding":
            assert docs.columns == columns
        held, got = before.collect(), docs.collect()
        rows = [(r["doc_id"], r["text"]) for r in held]
        kept = {r["doc_id"] for r in got}
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            gone = {i for i, _ in rows} - kept
            assert len(gone) < 0.2 * len(rows) and sum(labels.get(i, 1) for i in gone) >= 0.5 * len(gone)
        if name == "ngram_jaccard_join":
            assert kept == {i for i, n, c in plain_components(rows, 5, 80)[0] if i == c or n == 0}
        if name == "decontamination":
            bench = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert kept == {r[0] for r in plain_contamination(rows, bench) if not r[-1]}
        if name == "mixing":
            (sizes, most), (took, _) = words_of(held), words_of(got)
            copies = defaultdict(int)
            for r in got:
                copies[r["doc_id"], r["text"]] += 1
            assert max(copies.values()) <= 2 and kept <= {i for i, _ in rows}
            assert all(abs(took[s] - t) <= most[s] for s, t in plain_targets(sizes).items())
        if name == "sharding":
            load, places = defaultdict(int), defaultdict(list)
            for r in got:
                assert r["size"] == len((r["text"] or "").encode()) + 1
                load[r["shard"]] += r["size"]
                places[r["shard"]].append(r["slot"])
            assert len(got) == len(rows) and all(sorted(x) == list(range(len(x))) for x in places.values())
            assert max(load.values()) - min(load.values()) <= 0.05 * sum(load.values())
    assert {"shard", "slot", "size"} <= set(docs.columns) and docs.count() > 0


#: Columns that the operators use themselves.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, n_words long, hit_spans string, item_ids string, size string, shard string, slot string, n long, sig long, h long, label string"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, sf, empty):
    """Nulls, empty and very long texts, ties, repeated rows and ids, clashing columns, and a table without rows."""
    rows = [(*r, 7, "spans", "ids", "size", "shard", "slot", 5, 6, 8, "z") for r in ODD + [ODD[6], ODD[3]]]
    docs = spark.createDataFrame([] if empty else rows, CLASH)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        got = saved(stage(spark, docs, sf))
        assert set(docs.columns) <= set(got.columns) and (name == "sharding" or got.columns == docs.columns)
        clash = [c for c in ("n_words", "hit_spans", "item_ids", "n", "sig", "h", "label") if c in docs.columns]
        assert all(r[c] == dict(zip(docs.columns, rows[0], strict=True))[c] for r in got.collect() for c in clash)
        docs = got
        seen.append(got.count())
    # toxicity keeps all; of the equal texts "one" and those of id 7 one row each stays; nothing is contaminated; mixing draws copies
    assert seen[:3] == ([0, 0, 0] if empty else [12, 8, 8]) and seen[3] == seen[4]


def test_stages_keep_columns_of_any_name(spark, sf):
    """Every quoted name in the operators' modules is a further column: it comes back as it went in, or is one that the operator adds."""
    used = set()
    for module in (decontaminate, mixing, ngram_join, sharding, toxicity):
        used |= set(re.findall(r"[\"\'`]([A-Za-z_][A-Za-z_0-9]*)[\"\'`]", Path(module.__file__).read_text()))
    core = ("doc_id", "text", "lang", "source", "n_chars")
    names = sorted({n.lower() for n in used} - {*core}) + ["a b", "dotted.name"]
    assert len(names) > 100 and {"__text", "__gone", "__h", "__decon_doc", "__m", "__before", "__slot"} <= set(names)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*core, *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        added = sharding.ADDED if name == "sharding" else []
        kept = [n for n in names if n not in added]
        assert set(got.columns) == {*docs.columns, *added} and (added or got.columns == docs.columns)
        rows = got.select("doc_id", *(f"`{n}`" for n in kept)).collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows[:30] for n in kept)
    whole = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet"), near=True)
    assert set(whole.columns) == {*docs.columns, "n_words", "hit_spans", "item_ids", "n_near"} and whole.select("__decon_doc", "n_words").first()[1] >= 0


def test_helpers_are_the_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    assert decontaminate.WINDOW == 13 and ngram_join.BLOCK > 0 and corpus_pipeline.ORACLE_SQL is None
