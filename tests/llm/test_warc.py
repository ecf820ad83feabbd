import gzip

import pytest
from pyspark.sql import functions as F

from tallyshelf.llm import q_warc, warc
from tallyshelf.llm.common import shared_folder
from tallyshelf.llm.token_files import _get, _put


@pytest.fixture(scope="module")
def written(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>" * (i % 40), "x") for i in range(120)] + [(None, None, None, None), (5, "http://h/5", "<p>page 5</p>" * 5, "y")]
    folder = shared_folder(spark, "test-warc")
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, file string").repartition(3)
    warc.write(pages, folder)
    return folder, rows


def length_of(records):
    return records.agg(F.max(F.col("offset") + F.col("length"))).first()[0] or 0


def trees(spark, one, two):
    records = warc.manifest(spark, one)
    return [warc.tree(warc.leaves(spark, f, one), length_of(records)) for f in (one, two)]


def test_files_are_warc(spark, written):
    folder, rows = written
    records = warc.manifest(spark, folder).collect()
    assert len(records) == len(rows) and len({r["record_id"] for r in records}) == len(rows) - 1
    for r in records:
        data = _get(folder, r["file"])[r["offset"]:r["offset"] + r["length"]]
        plain = gzip.decompress(data)
        assert plain.startswith(b"WARC/1.1\r\n") and r["record_id"].encode() in plain and plain.endswith(b"\r\n\r\n")


def test_equal_replicas(spark, written):
    folder, _ = written
    two = shared_folder(spark, "test-equal")
    warc.replicate(spark, folder, two)
    a, b = trees(spark, folder, two)
    assert warc.audit(a, b).count() == 0
    assert a.levels[-1].collect()[0]["hash"] == b.levels[-1].collect()[0]["hash"]


def test_damage_is_found_where_it_is(spark, written, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 512)
    folder, _ = written
    records = warc.manifest(spark, folder).collect()
    files = sorted({r["file"] for r in records})
    bad = {(r["file"], r["offset"]) for r in records if r["row"] % 11 == 3}

    def change(name, data, entries):
        if name == files[0]:
            return None
        out = bytearray(data)
        for offset, _, _ in entries:
            if (name, offset) in bad:
                out[offset] ^= 1
        return bytes(out) + b"tail" if name == files[1] else bytes(out[:-1])

    two = shared_folder(spark, "test-damage")
    warc.replicate(spark, folder, two, change)
    got = {(r["file"], r["start"], r["kind"]) for r in warc.audit(*trees(spark, folder, two)).collect()}
    want = set()
    for r in records:
        whole = len(_get(folder, r["file"]))
        last = r["offset"] + r["length"] == whole
        if r["file"] == files[0]:
            want.add((r["file"], r["offset"], "missing"))
        elif (r["file"], r["offset"]) in bad or last and r["file"] != files[1]:
            want.add((r["file"], r["offset"], "changed"))
        if last and r["file"] == files[1]:
            want.add((r["file"], whole, "extra"))
    assert got == want and {k for *_, k in got} == {"missing", "changed", "extra"}


def test_file_the_trusted_folder_lacks_is_extra(spark, written):
    folder, _ = written
    two = shared_folder(spark, "test-extra")
    warc.replicate(spark, folder, two)
    _put(two, "other.warc.gz", [b"not ours"])
    got = {tuple(r) for r in warc.audit(*trees(spark, folder, two)).collect()}
    assert got == {("other.warc.gz", 0, 8, None, "extra")}


def test_empty(spark):
    one, two = shared_folder(spark, "test-none"), shared_folder(spark, "test-none")
    warc.write(spark.createDataFrame([], "url string, html string"), one)
    warc.replicate(spark, one, two)
    assert warc.audit(*trees(spark, one, two)).count() == 0


def test_query_against_all_bytes(spark, sf_dir):
    """The drill's damage, worked out from the pages' records alone."""
    got = {(r["record_id"], r["kind"]) for r in q_warc.op9_warc_fixity(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    ids = [warc.record(p["url"], p["html"])[0] for p in pages]
    hit = {i for i in ids if i[:2] in ("00", "01")}
    assert hit <= {i for i, _ in got} and {k for _, k in got} <= {"changed"}
    assert all(i[0] == "0" for i, _ in got)
