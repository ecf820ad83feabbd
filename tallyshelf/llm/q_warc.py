"""Query of the fixity audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm import warc
from tallyshelf.llm.common import shared_folder, table
from tallyshelf.llm.registry import query


def decay(name: str, data: bytes, entries: list) -> bytes:
    """What a drill does to a file: each record whose id begins with 00 or 01 has its middle byte changed,
    and a file whose last record's id begins with 0 loses the last byte."""
    out = bytearray(data)
    for offset, length, id_ in entries:
        if id_[:2] in ("00", "01"):
            out[offset + length // 2] ^= 0xFF
    return bytes(out[:-1] if entries[-1][2][0] == "0" else out)


# No SQL: offsets are those of compressed records. The tests compare the replicas' bytes record by record.
@query()
def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files, a replica that has gone through the drill, and where the two differ."""
    one, two = shared_folder(spark, "warc-one"), shared_folder(spark, "warc-two")
    warc.write(table(spark, sf_dir, "pages"), one)
    warc.replicate(spark, one, two, decay)
    a, b = (warc.leaves(spark, folder, one) for folder in (one, two))
    length = warc.manifest(spark, one).agg(F.max(F.col("offset") + F.col("length"))).first()[0] or 0
    return warc.audit(warc.tree(a, length), warc.tree(b, length))
