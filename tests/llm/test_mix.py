import random
import re
from collections import defaultdict

from tallyshelf.llm import mix

SCHEMA = "doc_id bigint, text string, source string, _mix int, size string"


def made(n=600):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        source = rng.choice(["big"] * 8 + ["a", "B", "é", None, "tiny"])
        rows.append((i if i % 50 else None, " ".join(["w"] * int(rng.paretovariate(1.1) * 5 % 3000)) if i % 20 else None, source, i % 3, "s"))
    return rows


def water_fill(sizes):
    """Shares by weight, the excess of the full ones shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, rest, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if rest * weight[s] / total > 3 * sizes[s]}
        if not full:
            target.update({s: rest * weight[s] / total for s in open_})
            break
        target.update({s: 3.0 * sizes[s] for s in full})
        rest -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return target


def test_targets_sizes_and_copies(spark):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix.mix(docs, "m").collect()
    assert len(got) == len(rows)
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["m"]["size"] == n and 0 <= r["m"]["copies"] <= 3
        sizes[r["source"]] += n
        taken[r["source"]] += n * r["m"]["copies"]
        biggest[r["source"]] = max(biggest[r["source"]], n)
    want = water_fill(sizes)
    for r in got:
        assert r["m"]["source_size"] == sizes[r["source"]] and abs(r["m"]["target"] - want[r["source"]]) < 1e-6
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(5, 0.02 * sizes[s]), s


def test_reruns_agree_and_partitions_do_not_matter(spark):
    docs = spark.createDataFrame(made(200), SCHEMA)
    key = lambda r: (r["doc_id"] or -1, r["text"] or "", r["source"] or "", r["m"]["copies"])
    assert sorted(map(key, mix.mix(docs, "m").collect())) == sorted(map(key, mix.mix(docs.repartition(7), "m").collect()))


def test_sample_repeats_documents(spark):
    docs = spark.createDataFrame(made(200), SCHEMA)
    out = mix.sample(docs)
    assert out.columns == docs.columns
    want = sum(r["m"]["copies"] for r in mix.mix(docs, "m").collect())
    assert out.count() == want


def test_odd_tables(spark):
    assert mix.mix(spark.createDataFrame([], SCHEMA), "m").count() == 0
    blank = spark.createDataFrame([(1, None, "a", 0, ""), (2, "", None, 0, "")], SCHEMA)
    assert {(r["m"]["size"], r["m"]["target"]) for r in mix.mix(blank, "m").collect()} == {(0, 0.0)}
    same = spark.createDataFrame([(1, "a b c", "s", 0, "")] * 5, SCHEMA)
    assert {r["m"]["copies"] for r in mix.mix(same, "m").collect()} == {1}


def test_preference_changes_inclusion(spark):
    """Within one source long documents are taken more often than scraps when there is a choice."""
    rows = [(i, " ".join(["w"] * (400 if i % 2 else 4)), "s", 0, "") for i in range(400)] + [(1000, "w " * 10, "t", 0, "")] + [
        (2000 + i, "w " * 400, "u", 0, "") for i in range(600)]
    got = [r for r in mix.mix(spark.createDataFrame(rows, SCHEMA), "m").collect() if r["source"] == "s"]
    share = {n: sum(r["m"]["copies"] for r in got if r["m"]["size"] == n) / 200 for n in (4, 400)}
    assert share[400] > share[4]
