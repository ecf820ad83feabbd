"""The stages on the smallest tables and on odd rows, against brute force."""

import re
from collections import Counter

import corpus_pipeline
from tallyshelf.llm.q_shard import SHARDS
from tests_llm_brute import decontaminated, near_duplicates, quality_kept


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "source_mix", "sharding"]


def test_run_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    kept = {r["doc_id"]: r["text"] for r in docs if quality_kept(r["text"])}
    kept = {i: kept[i] for i in near_duplicates(kept, 5)}
    clean = {i for i, t in kept.items() if not decontaminated(t, items)}
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    got = out.collect()
    copies = Counter(r["doc_id"] for r in got)
    assert set(copies) <= clean and max(copies.values()) <= 3 and {r["shard"] for r in got} <= set(SHARDS)
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs}
    total, taken = sum(size[i] for i in clean), sum(size[i] * n for i, n in copies.items())
    assert abs(total - taken) < 0.1 * total
    # The three stages before the mix keep exactly what brute force keeps.
    stage = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:3]:
        stage = f(spark, stage, sf_dir)
        assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in stage.select("doc_id").collect()) == sorted(clean)


def test_odd_rows_pass_every_stage(spark, sf_dir):
    prose = " ".join(f"word{k} and" for k in range(30))
    rows = [(None, prose, None, None, None, "a", "b"), (1, None, "en", "s", 0, None, None), (2, "", "en", "s", 0, "", ""), (3, prose + " x", "en", "s", 5, "", ""),
            (3, prose + " x", "en", "s", 5, "", ""), (4, "other " + " ".join(f"w{k}" for k in range(20_000)), "en", None, 1, "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, _r string")
    for empty in (False, True):
        stage = docs.filter("false") if empty else docs
        for name, f in corpus_pipeline.STAGES:
            before, stage = stage.columns, f(spark, stage, sf_dir)
            assert stage.columns[:len(before)] == before
        assert stage.columns[-1] == "shard_1"
        assert stage.count() == 0 if empty else {r["doc_id"] for r in stage.collect()} <= {3, 4}
