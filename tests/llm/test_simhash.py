import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_helpers import rows, texts_of
from snaptable.llm import simhash as sh


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    values = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def grouped(values, budget=4):
    """value: least position of its component, by comparing all pairs."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "\t", "\x1c", "\n", "word", "ÄÖ"]), max_size=12).map(" ".join))
def test_fingerprints_by_their_definition(text):
    assert sh.fingerprint(text) == plain_fingerprint(text)


def near(rng, n, centres, flips):
    out = []
    for _ in range(n):
        v = int(rng.choice(centres))
        for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
            v ^= 1 << int(b)
        out.append(v)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_trie_pairs_are_all_pairs_within_the_budget(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    values = sorted(set(near(rng, 250, centres, 7)))
    v = np.array(values, dtype=np.uint64)
    zero = np.zeros(len(v), dtype=np.int64)
    found = {(int(i), int(j)) for a, b in sh.trie_pairs(v, zero, zero, 4) for i, j in zip(a, b, strict=True)}
    assert found == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if (values[i] ^ values[j]).bit_count() <= 4}
    # two sides: pairs across only
    side = rng.integers(0, 2, len(v))
    order = np.lexsort((v, side))
    v2, s2 = v[order], side[order]
    found = {(int(i), int(j)) for a, b in sh.trie_pairs(v2, s2, zero, 4) for i, j in zip(a, b, strict=True)}
    left, right = np.flatnonzero(s2 == 0), np.flatnonzero(s2 == 1)
    assert found == {(i, j) for i in left for j in right if (int(v2[i]) ^ int(v2[j])).bit_count() <= 4}
    # several groups: none across
    group = np.sort(rng.integers(0, 5, len(v)))
    found = {(int(i), int(j)) for a, b in sh.trie_pairs(np.concatenate([np.sort(v[group == g]) for g in range(5)]), zero, group, 4) for i, j in zip(a, b, strict=True)}
    assert all(group[i] == group[j] for i, j in found)


@pytest.mark.parametrize("bucket_rows", [4096, 16, 2])
def test_components_are_those_of_all_pairs(spark, bucket_rows):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**64, 10, dtype=np.uint64)
    values = sorted(set(near(rng, 500, centres, 9)) | set(rng.integers(0, 2**64, 200, dtype=np.uint64).tolist()) | {0, 2**64 - 1})
    signed = [int(x) for x in np.array(values, dtype=np.uint64).view(np.int64)]
    frame = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    tree = {r.node % 2**64: r.root % 2**64 for r in sh.components(sh.links(frame, 4, bucket_rows)).collect()}
    wanted = grouped(values)
    parts = lambda m: sorted(sorted(v for v in values if m.get(v, v) == r) for r in {m.get(v, v) for v in values})
    assert parts(tree) == parts(wanted)


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    found = {r.node: r.root for r in sh.components(edges).collect()}
    assert len({found[i] for i in range(301)}) == 1 and found[1000] == found[1001] != found[0] and len(found) == 303


def test_documents_against_all_pairs(corpus):
    texts = texts_of(corpus)
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    wanted = grouped(set(prints.values()))
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(wanted[p], i)
    found = sh.near_duplicates(corpus).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {i: (f"{p:016x}", least[wanted[p]]) for i, p in prints.items()}


def test_a_hot_group_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one and the same text of some words").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    out = sh.near_duplicates(docs).groupBy("component_id").count().orderBy(F.desc("count")).head()
    assert out[:] == (0, 1000)


def test_rows_of_every_kind(odd, none):
    out = sh.near_duplicates(odd)
    assert out.count() == odd.count() and sh.near_duplicates(none).count() == 0
    assert rows(out.filter("doc_id < 3").select("fingerprint", "component_id")) == [("0" * 16, 0)] * 3
    assert rows(out.filter("doc_id = 4").select("component_id")) == [(3,)]
    assert out.filter("doc_id is null").head().component_id is None
    kept = sh.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 3").count() == 1 and kept.filter("doc_id is null").count() == 1
    assert kept.filter("doc_id < 3").count() == 1 and sh.keep_one(none).count() == 0
