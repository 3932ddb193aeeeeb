"""BPE against the tokenizers library, record files by an exact round trip, shards by their properties."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from tunefathom.llm import bpe, records, sharding
from tunefathom.session import work_path

ODD = ["", None, " ", "aaaa aaaaaaa", "Hello<|endoftext|>World <|startoftext|>x", "ΟΔΥΣΣΕΥΣ Σ", "İstanbul ǅ ﬁ", "é ́x a b\tc\r\nd   e", "it's I'LL 'tis 123 4½ ²",
       "<|endoftext", "\x1c\x1da b\x1f", "日本語 テスト", "𝔘𝔫𝔦 😀👍🏽", "​x", "a" * 5000, "abab" * 3000, "!!!???...", "a  b\n\n c", "\x00\x01", " xy", " lead", "trail \n", "same", "same"]
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(None if i == 3 else i * 7 % 50, t, "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), rows


def test_ids_and_decoded_text_equal_the_library(spark, frame):
    docs, rows = frame
    library = Library.from_file(WORDS)
    got = bpe.encode_decode(docs, WORDS, ("ids", "decoded", "n_tokens", "ids_sha256")).collect()
    assert len(got) == len(rows)
    want = {(r[0], r[1]): library.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    for r in got:
        ids = want[r["doc_id"], r["text"]]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_merges_of_lower_rank_first_and_overlapping_from_the_left():
    vocabulary = {s: i for i, s in enumerate(["a", "b", "c", "aa", "ab", "aab", "bc"])}
    table = bpe.MergeTable(vocabulary, [["b", "c"], ["a", "a"], ["a", "b"], ["aa", "b"]])
    symbols = np.array([0, 0, 0, 1, 0, 1, 2, 0])  # aaab | abc | a
    ids, lengths = table.encode(symbols, np.array([0, 4, 7]))
    assert ids.tolist() == [3, 4, 0, 6, 0] and lengths.tolist() == [2, 2, 1]


def test_a_small_cache_gives_the_same_ids(monkeypatch):
    texts = [f"word{i} other{i % 7} <|endoftext|>" for i in range(60)]
    spec = open(WORDS, encoding="utf-8").read()
    one = bpe.Tokenizer(spec)
    whole = [x.tolist() for x in one.encode(texts)]
    monkeypatch.setattr(bpe, "CACHED_RUNS", 5)
    two = bpe.Tokenizer(spec)
    assert [two.encode([t])[0].tolist() for t in texts] == whole


def test_pieces_are_encoded_without_the_symbols_at_their_ends():
    """A word followed by other symbols is no new piece, and the ids stay those of the library."""
    with open(BYTES, encoding="utf-8") as file:
        encoder = records.PieceEncoder(file.read())
    texts = ["plain words, plain. plain!? (plain) plain\nwords;", None, "", "it's, I'll. we''. x\u00b2, \u00aa. 12%, 3.5. \u65e5, \U0001f642! a'", "two  blanks. \t x\x01y",
             "a.b. c,d, <|endoftext|>. <|endoftext|> x|> y<| ... , na\u00efve. \u00e9t\u00e9### wide\u3000space\u3000\u2003 \x1c\x1d"]
    want = [e.ids for e in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids.tolist() for ids in encoder.encode(pa.array(["cut off", *texts]).slice(1))] == want
    assert [ids.tolist() for ids in encoder.encode(texts)] == want
    assert {" plain", " words", ",", "!?"} <= set(encoder.pieces) and not {" plain.", " plain!?", " words,"} & set(encoder.pieces)


def test_records_come_back_in_order(spark, frame):
    docs, rows = frame
    library = Library.from_file(BYTES)
    want, start = [], 0
    for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in records.round_trip(docs, BYTES, 2).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_single_records_and_damage(tmp_path):
    folder = f"file://{tmp_path}"
    writer = records.RecordWriter(folder, "x")
    for key, ids in [(5, [1, 2, 70000]), (None, []), (-9, [3])]:
        writer.add(key, np.array(ids, dtype=np.int64))
    writer.close()
    index = records.read_index(folder, "x")
    assert [(k, v.tolist()) for k, v in records.read_records(folder, "x", index[[2, 0]])] == [(-9, [3]), (5, [1, 2, 70000])]
    data = bytearray((tmp_path / "x.rec").read_bytes())
    data[20] ^= 1
    (tmp_path / "x.rec").write_bytes(bytes(data))
    with pytest.raises(ValueError):
        list(records.read_records(folder, "x", index))


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert records.round_trip(none, BYTES, 2).count() == 0
    assert bpe.encode_decode(none, WORDS).count() == 0
    assert sharding.assign_shards(none, "doc_id").count() == 0


def test_shards_are_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(names, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert ((table != fewer) & (table != 9)).sum() < 0.12 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_every_row_has_one_shard(spark, tmp_path):
    rows = spark.createDataFrame([(i % 30 if i else None, "x", "clash") for i in range(60)], "doc_id long, text string, shard string")
    placed = sharding.assign_shards(rows, "doc_id")
    assert placed.count() == 60 and placed.filter("shard is null").count() == 0
    assert placed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    sharding.write_shards(rows, "doc_id", str(tmp_path / "out"), files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_files_are_cut_by_bytes_and_stay_in_order(spark):
    texts = [None, "", *[f"text {i} of some words\nand lines  {i}" for i in range(200)], "same", "same"]
    docs = spark.createDataFrame([(i % 150 if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    folder = work_path(spark, "cut-records")
    manifest = records.write_token_records(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, folder, files=2, file_bytes=700)
    assert manifest.count() > 8
    rows = records.read_token_records(manifest, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", records.digest).collect()
    rows.sort(key=lambda r: r["start"])
    assert len(rows) == len(texts) and rows[0]["doc_id"] is None
    ids = [r["doc_id"] for r in rows[1:]]
    assert ids == sorted(ids)
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:i]) for i in range(len(rows))]
