import random
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from tallyshelf.llm import token_counts as tc
from tallyshelf.llm import token_files
from tallyshelf.llm.common import shared_folder
from tallyshelf.llm.q_token_counts import op6_token_counts
from tallyshelf.llm.q_token_files import op10_token_files, tokenizer_path
from tallyshelf.llm.tokens import Encoder

ODD = ["don't we'll 'tis it's", "a  b   c\n\n d\n\n\te \n", "\n\nword", "x\r\ny", "日本語 and Ελλάδα", "naïve café¼ 3²", " lead", "tail ", "", None,
       "<|endoftext|> inside", "a b", "—dash… “q”", "1,234.5%%%", "\x1c\x1d", "é̀ combining", "a b", "'s's 's", "x" * 5000, "  \n  ",
       "emoji 🙂 here"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def test_encoder_is_the_library(library):
    rng = random.Random(4)
    bits = ["word", "Été", " ", "  ", "\n", "'s", "'", "12", ".", ",", "%%", "\t", "—", "ß", "don't", "x\r", "<|", "🙂", " "]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(2000)]
    known = Encoder(tokenizer_path())
    for _ in range(2):
        got = [np.frombuffer(x, known.type).tolist() for x in known.encode(texts)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_word_is_looked_up_once_and_the_limit_holds(library, monkeypatch):
    """A text's words come out of the table by one look-up each; beyond the limit nothing stays there."""
    class Table(dict):
        def __contains__(self, word):
            raise AssertionError("looked up twice")

    monkeypatch.setattr("tallyshelf.llm.tokens.REMEMBERED", 5)
    encoder = Encoder(tokenizer_path())
    encoder.known = Table()
    for texts in (["one two three"], ["one two four five six seven", "two eight"], ["nine one", None]):
        want = [np.array(library.encode(t or "", add_special_tokens=False).ids, encoder.type).tobytes() for t in texts]
        assert encoder.encode(texts) == want
        assert len(encoder.known) <= 5


def test_other_tokenizers_go_to_the_library():
    known, whole = Encoder(tokenizer_path("word_bpe_49k.json")), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = ["Some WORDS here", "a  b", None]
    assert [np.frombuffer(x, known.type).tolist() for x in known.encode(texts)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def brute(rows, library):
    out, start = {}, 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_query_against_the_library(spark, sf_dir, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    got = op10_token_files(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == brute(rows, library) and len(got) == len(rows)


def test_files_fetch_and_odd_rows(spark, library, monkeypatch):
    rows = [(i * 3, t) for i, t in enumerate(ODD * 3)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(None, "null id", "", 0), (6, "same id", "", 0)], "doc_id bigint, text string, ids string, start int")
    folder = shared_folder(spark, "test-ids")
    token_files.write(docs.repartition(3), folder, tokenizer_path())
    got = token_files.read(spark, folder).collect()
    assert len(got) == len(rows) + 2
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == [None] + sorted([*(i for i, _ in rows), 6])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(order, order[1:]))
    said = dict(rows)
    asked = spark.createDataFrame([(0,), (9,), (9,), (24,), (777,), (None,)], "doc_id bigint")
    found = {r["doc_id"]: r["ids"] for r in token_files.fetch(spark, folder, asked).collect()}
    assert found == {i: library.encode(said[i] or "", add_special_tokens=False).ids + [0] for i in (0, 9, 24)}
    none = shared_folder(spark, "test-no-ids")
    token_files.write(docs.filter("false"), none, tokenizer_path())
    assert token_files.read(spark, none).count() == 0


def test_file_knows_its_dictionary_and_its_end():
    data = token_files.train([b"abc" * 50] * 3)
    held = zstandard.ZstdCompressionDict(data)
    frame = zstandard.ZstdCompressor(dict_data=held).compress(b"\1\0" * 10)
    raw = b"".join(token_files._file([frame], [(1, 5, token_files.HEAD_BYTES, len(frame), 10)], token_files.hashlib.sha256(data).digest(), 2))
    entries, _ = token_files.read_index(raw, len(raw))
    assert entries["doc_id"].tolist() == [5] and token_files._header(raw, data) == np.dtype("<u2")
    with pytest.raises(ValueError):
        token_files._header(raw, data + b"x")
    with pytest.raises(ValueError):
        token_files.read_index(raw[:-1], len(raw) - 1)


SCHEMA = "source string, lang string, tokens bigint, old bigint, docs string"


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}


def test_rollup_commits_once_and_adds_up(spark):
    rows = spark.createDataFrame([("a", "en", 5, 2, ""), ("a", "en", 7, 2, ""), (None, None, 3, 1, ""), ("b", "de", None, None, "")], SCHEMA)
    rollup = tc.Rollup(spark, shared_folder(spark, "test-rollup"))
    assert totals(rollup) == {}
    assert rollup.commit("day/1", tc.inserted(rows, "v1")) and not rollup.commit("day/1", tc.inserted(rows, "v1"))
    assert totals(rollup) == {("a", "en", "v1"): (2, 12), (None, None, "v1"): (1, 3), ("b", "de", "v1"): (1, 0)}
    assert rollup.commit("day 2", tc.revised(rows, "v1", "tokens", "old")) and rollup.commit("empty", tc.inserted(rows.filter("false"), "v1"))
    assert totals(rollup)[("a", "en", "v1")] == (2, 4)
    rollup.compact()
    assert not rollup.commit("day 2", tc.inserted(rows, "v1")) and totals(rollup)[("a", "en", "v1")] == (2, 4)
    assert rollup.commit("gone", tc.deleted(rows, "v1", "old"))
    assert totals(rollup) == {}
    rollup.compact()
    assert tc.Rollup(spark, rollup.folder).totals().count() == 0 and not rollup.commit("gone", tc.inserted(rows, "v1"))


def test_a_batch_that_died_is_written_anew(spark):
    rows = spark.createDataFrame([("a", "en", 5, 2, "")], SCHEMA)
    rollup = tc.Rollup(spark, shared_folder(spark, "test-died"))
    rollup.commit("one", tc.inserted(rows, "v1"))
    fs, mark = rollup._path("batch-one/_SUCCESS")
    fs.delete(mark, False)
    assert totals(rollup) == {}
    assert rollup.commit("one", tc.inserted(rows, "v1")) and totals(rollup) == {("a", "en", "v1"): (1, 5)}


def test_query_of_counts(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    want = {}
    for r in rows:
        if first[r["text"]] == r["doc_id"]:
            for name, n in (("byte_bpe_50k/1", len(library.encode(r["text"], add_special_tokens=False).ids) + 1), ("words/1", len(r["text"].split()))):
                docs, tokens = want.get((r["source"], r["lang"], name), (0, 0))
                want[(r["source"], r["lang"], name)] = (docs + 1, tokens + n)
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in op6_token_counts(spark, sf_dir).collect()} == want
