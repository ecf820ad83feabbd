import random
import re

import pytest
from pyspark.sql import functions as F

from tallyshelf.llm import quality

SCHEMA = "doc_id bigint, text string, fail_bits string, _q int, kept double"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
         "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
         "n_stutter": sum(a == b for a, b in zip(w, w[1:]))}
    n = m["n_words"]
    fails = [n < 20, 100 * len(hit) > 30 * n, 10 * m["n_symbols"] > n, 100 * m["n_stutter"] > 20 * n,
             100 * m["n_dup_lines"] > 30 * m["n_lines"], m["word_chars"] < 2 * n or m["word_chars"] > 15 * n]
    return {**m, "fail_bits": sum(1 << k for k, f in enumerate(fails) if f)}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["Été", "b", "cc", "#x", "ddd.", "日本", "e f"]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    line = "one two three four five six seven eight nine"
    return made + [None, "", " \t\n", "a\x0bb\x0cc\r\nd", "\n".join([line] * 3), line, "x " * 30, "  lead\n\n\nlead  ",
                   " ".join(f"w{i % 900}" for i in range(2000))]


def test_ledger_against_brute_force(spark, texts):
    rows = [(i if i % 7 else None, t, "x", 1, 2.0) for i, t in enumerate(texts)] * 2
    got = quality.ledger(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] or -1, *[brute(r[1])[m] for m in (*quality.MEASURES, "fail_bits")]) for r in rows)
    assert sorted((r["doc_id"] or -1, *[r[m] for m in (*quality.MEASURES, "fail_bits")]) for r in got) == want


def test_policy_keep_and_columns(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in enumerate(texts)], SCHEMA)
    for policy in (quality.BASE, quality.PLAIN, quality.STRICT):
        kept = quality.keep(docs, policy)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute(t)["fail_bits"] & policy.mask}


def test_ablation(spark, texts):
    ledger = quality.ledger(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    bits = [brute(t)["fail_bits"] for t in texts]
    got = {r["rule"]: (r["failed"], r["rescued"]) for r in quality.ablation(ledger, quality.STRICT).collect()}
    want = {r: (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits)) for k, r in enumerate(quality.RULES)}
    assert got == want


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert quality.keep(docs).count() == quality.ledger(docs).count() == quality.ablation(quality.ledger(docs), quality.PLAIN).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string").repartition(1)
    plan = quality.ledger(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
