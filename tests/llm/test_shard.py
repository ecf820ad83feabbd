import hashlib
import uuid
from collections import Counter

import pytest

from tallyshelf.llm import shard
from tallyshelf.llm.common import shared_folder
from tallyshelf.llm.q_shard import SHARDS


def brute(shards, size):
    """Whole preference lists, and turns that look for the first slot nobody has."""
    def number(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    lists = [[(number(f"{s}|start") % size + j * (number(f"{s}|step") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    owner = {}
    while len(owner) < size:
        for k in range(len(shards)):
            if len(owner) < size:
                owner[next(x for x in lists[k] if x not in owner)] = k
    return [owner[x] for x in range(size)]


def test_table_against_brute_force():
    names = [f"s{i}" for i in range(7)]
    assert shard.fill(names, 211) == brute(names, 211)


def test_balance_weights_and_small_moves():
    names = [f"s{i}" for i in range(20)]
    full = shard.fill(names)
    counts = Counter(full)
    assert max(counts.values()) - min(counts.values()) <= 1
    less = shard.fill(names[:-1])
    moved = sum(a != b for a, b in zip(full, less) if a != 19)
    assert moved < 0.05 * len(full)
    heavy = Counter(shard.fill(names[:2], weights=[1, 3]))
    assert abs(heavy[1] / heavy[0] - 3) < 0.01
    for bad in ((names, 210), ([], 211), (["a", "a"], 211)):
        with pytest.raises(ValueError):
            shard.fill(*bad)


def place(doc_id):
    said = "-" if doc_id is None else f"+{doc_id}"
    return int(hashlib.md5(said.encode()).hexdigest()[:15], 16) % 65537


def test_query_and_clashing_names(spark, sf_dir):
    table = shard.fill(SHARDS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "'x' AS shard", "1 AS _slot")
    docs = docs.unionAll(spark.createDataFrame([(None, "x", 1)] * 2, docs.schema))
    out = shard.place(docs, SHARDS)
    assert out.columns == ["doc_id", "shard", "_slot", "shard_1"]
    assert all(r["shard_1"] == SHARDS[table[place(r["doc_id"])]] for r in out.collect()) and out.count() == docs.count()
    assert shard.place(docs.filter("false"), SHARDS).count() == 0


def test_written_shards(spark, sf_dir):
    folder = shared_folder(spark, f"shards-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shard.write(docs, folder, [f"s{i}" for i in range(4)], files_per_shard=2)
    back = spark.read.parquet(folder)
    assert back.count() == docs.count() and {r["shard"] for r in back.select("shard").distinct().collect()} == {f"s{i}" for i in range(4)}
