import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_helpers import rows
from snaptable.llm import token_shards as ts
from snaptable.llm.common import shared_path
from snaptable.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ODD = ("İstanbul ΑΣ ΣΑΣ ﬁ ǅ", "can't I'LL we've 'S 't", "<|endoftext|> a<|startoftext|>b", "x <|ENDOFTEXT|> y<|EndOfText|>z", "<|End of<|endof text|>", "é ́x क़ ½² 12a3", "....!!! a.b,c ...x?", "\x0b\x1c a\x85b\xa0c", "日本語　空白", "a\x00b ﻿ x​y")


def test_word_by_word_is_the_whole_text(tokenizer):
    coder = ts.WordEncoder(tokenizer_path())
    texts = ["", " ", *ODD, "The quick brown, fox; jumps! " * 50, "z" * 500, "Où est-ce que ßtraße?"]
    assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=4))
def test_any_text_word_by_word(texts):
    coder = ts.encoder(tokenizer_path())
    assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode(texts)] == [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_tokenizer_that_is_not_word_by_word_reads_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path().replace("word_bpe_49k", "byte_bpe_50k")
    coder, plain = ts.WordEncoder(path), Tokenizer.from_file(path)
    assert not coder.by_words and ts.WordEncoder(tokenizer_path()).by_words
    assert [np.frombuffer(x, coder.kind).tolist() for x in coder.encode([*ODD, "Two  words"])] == [plain.encode(t, add_special_tokens=False).ids for t in (*ODD, "Two  words")]


def test_a_small_cache_changes_nothing(monkeypatch):
    texts = [f"word{i} the of {chr(97 + i % 26)}x" for i in range(300)]
    whole = ts.WordEncoder(tokenizer_path()).encode(texts)
    monkeypatch.setattr(ts, "CACHE_WORDS", 10)
    coder = ts.WordEncoder(tokenizer_path())
    assert [coder.encode([t])[0] for t in texts] == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1) | st.none(), st.lists(st.integers(0, 65535), max_size=20)), max_size=60), st.sampled_from([40, 200, 1 << 16]))
def test_shards_round_trip_and_lookup(entries, block):
    entries = sorted(((ts.key_of(k), np.array(v, "<u2").tobytes()) for k, v in entries), key=lambda e: e[0])
    old, ts.BLOCK_BYTES = ts.BLOCK_BYTES, block
    try:
        out = io.BytesIO()
        writer = ts.ShardWriter(out, 2)
        for e in entries:
            writer.add(*e)
        writer.close()
    finally:
        ts.BLOCK_BYTES = old
    shard = ts.ShardReader(out)
    assert [(k, v) for k, _, v in shard] == entries
    assert [s for _, s, _ in shard] == [sum(len(v) // 2 for _, v in entries[:i]) for i in range(len(entries))]
    for key in {k for k, _ in entries}:
        assert [x.tobytes() for x in shard.get(key)] == [v for k, v in entries if k == key]
    assert shard.get(ts.key_of("absent")) == [] and shard.get(b"") == []


def test_keys_sort_as_their_values():
    values = [None, -(2**63), -5, -1, 0, 1, 255, 256, 2**63 - 1]
    keys = [ts.key_of(v) for v in values]
    assert keys == sorted(keys) and [ts.value_of(k, False) for k in keys] == values
    assert ts.value_of(ts.key_of("é"), True) == "é" and ts.key_of("Z") < ts.key_of("a")


def test_the_filter_spares_most_absent_keys():
    out = io.BytesIO()
    writer = ts.ShardWriter(out, 2)
    for i in range(2000):
        writer.add(ts.key_of(2 * i), b"\x01\x00")
    writer.close()
    shard = ts.ShardReader(out)
    passed = sum(all(shard.bloom[p >> 3] >> (p & 7) & 1 for p in ts._probes(ts.key_of(2 * i + 1), shard.bits)) for i in range(2000))
    assert passed < 60 and len(shard.index) > 0
    for bad in (b"", b"x" * 64):
        with pytest.raises(ValueError, match="not a shard"):
            ts.ShardReader(io.BytesIO(bad))


def test_documents_in_ascending_order(corpus, tokenizer):
    found = {r.doc_id: r for r in ts.token_shards(corpus, tokenizer_path()).collect()}
    start = 0
    for i, text in sorted((r.doc_id, r.text) for r in corpus.collect()):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert tuple(found[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_single_documents_by_identifier(spark, corpus, tokenizer):
    manifest = ts.write_shards(corpus.repartition(7), tokenizer_path(), shared_path(spark, "shards"))
    for r in corpus.filter("doc_id % 37 = 0").collect():
        (ids,) = ts.lookup(manifest, r.doc_id)
        assert ids.tolist() == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
    assert ts.lookup(manifest, -5) == ts.lookup(manifest, 10**9) == ts.lookup(manifest, None) == ts.lookup([], 1) == []


def test_a_repeated_write_leaves_only_unnamed_files(spark, corpus):
    folder = shared_path(spark, "shards")
    first = ts.write_shards(corpus, tokenizer_path(), folder)
    second = ts.write_shards(corpus, tokenizer_path(), folder)
    assert rows(ts.read_shards(spark, first)) == rows(ts.read_shards(spark, second))
    assert {r["path"] for r in first}.isdisjoint(r["path"] for r in second)


def test_rows_of_every_kind(spark, odd, none):
    out = ts.token_shards(odd, tokenizer_path()).orderBy("start").collect()
    assert len(out) == odd.count() and out[0].doc_id is None and [r.doc_id for r in out[1:]] == sorted(r.doc_id for r in out[1:])
    assert [r.n_tokens for r in out if r.doc_id in (0, 1, 2)] == [1, 1, 1]
    assert ts.token_shards(none, tokenizer_path()).count() == 0
    named = odd.filter("doc_id is not null").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert sorted(r.doc_id for r in ts.token_shards(named, tokenizer_path()).collect()) == sorted(r.doc_id for r in named.collect())
