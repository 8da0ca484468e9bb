from hypothesis import given, settings
from hypothesis import strategies as st

from llm_helpers import rows
from snaptable.llm import decontaminate as d


def distance(pattern, text):
    """Least edits between a pattern and any substring, by the plain table."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != t)))
        before = now
    return min(before)


letters = st.text("abc ", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=14), letters)
def test_myers_agrees_with_the_table(pattern, text):
    least, end = d.Myers(pattern).best(text)
    assert least == distance(pattern, text)
    assert distance(pattern, text[:end]) == least


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcd", min_size=8, max_size=40), min_size=1, max_size=4), st.text("abcd ", max_size=80), st.data())
def test_found_are_just_the_items_within_their_budget(items, noise, data):
    item = list(data.draw(st.sampled_from(items)))
    for _ in range(data.draw(st.integers(0, 4))):
        at = data.draw(st.integers(0, len(item) - 1)) if item else 0
        item[at : at + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["", "x", "a"]))
    text = noise[:40] + "".join(item) + noise[40:]
    finder = d.Finder(list(enumerate(items)), 0.1)
    wanted = {}
    for n, t in enumerate(items):
        least = distance(d.normal(t), d.normal(text))
        if least <= d.error_budget(d.normal(t), 0.1):
            wanted[n] = least
    found = finder.find(text)
    assert {n: e for n, e, _, _ in found} == wanted
    for n, e, a, b in found:
        assert distance(finder.items[n][1], d.normal(text)[a:b]) == e


def test_pieces_are_one_more_than_the_errors():
    item = "x" * 100
    cut = d.pieces(item, d.error_budget(item))
    assert len(cut) == 9 and "".join(p for _, p in cut) == item and d.error_budget("short") == 0


def test_documents_and_items_of_every_kind(spark, odd, none):
    bench = spark.createDataFrame(
        [(1, "two  THREE four five"), (2, None), (3, " "), (4, "absent from all of the texts"), (5, "two three four five"), (None, "w w w w w w w w")],
        "item_id bigint, text string",
    )
    found = d.find_leaks(odd, bench)
    assert rows(found.filter("doc_id in (3, 4)").select("doc_id", "item_id", "errors", "start", "end")) == sorted(
        (i, n, 0, 4, 23) for i in (3, 3, 4) for n in (1, 5)
    )
    assert rows(found.filter("item_id is null").select("doc_id").distinct()) == [(6,)]
    assert d.find_leaks(none, bench).count() == 0 and d.find_leaks(odd, bench.limit(0)).count() == 0
    kept = d.drop_leaks(odd, bench)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 4
    assert d.drop_leaks(none, bench).count() == 0 and d.drop_leaks(odd, bench.limit(0)).count() == odd.count()


def test_blocks_of_items_give_the_same(spark, corpus, monkeypatch):
    bench = spark.createDataFrame([(i, t[50:150]) for i, t in enumerate(sorted(r.text for r in corpus.collect())[:30])], "item_id bigint, text string")
    whole = rows(d.find_leaks(corpus, bench))
    kept = rows(d.drop_leaks(corpus, bench))
    monkeypatch.setattr(d, "BLOCK_CHARS", 300)
    assert rows(d.find_leaks(corpus, bench)) == whole and whole
    assert rows(d.drop_leaks(corpus, bench)) == kept and len(kept) == corpus.count() - len({r[0] for r in whole})


def test_more_blocks_than_a_worker_keeps(tmp_path, monkeypatch):
    """Texts are gathered, and automata made again, without a change to what is found."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for k in range(6):
        (tmp_path / f"block={k}").mkdir()
        pq.write_table(pa.table({"item": [k, None], "text": [f"item number {k} of all these", f"another {k} without a number"]}), tmp_path / f"block={k}" / "part.parquet")
    items = d.Items(f"file://{tmp_path}", 7, 0.05)  # the last block has no rows
    batch = pa.RecordBatch.from_arrays([pa.array([f"here is item number {k} of all these" for k in (4, 1)])], names=["t"])
    monkeypatch.setattr(d, "GATHERED", 100)
    groups = list(d.gathered(iter([batch] * 5), 0, items.blocks))
    assert [len(g) for g in groups] == [2, 2, 1]
    for _, texts in groups[0]:
        found = [[items.finder(b).items[n][0] for b in range(7) for n, e, *_ in items.finder(b).find(t) if not e] for t in texts]
        assert found == [[4], [1]]


def test_the_shortest_items_are_held_by_nothing(spark, corpus):
    bench = spark.createDataFrame([(1, "a"), (2, "  th   e ren  "), (3, None)], "item_id bigint, text string")
    assert d.find_leaks(corpus, bench).count() == 0 and d.drop_leaks(corpus, bench).count() == corpus.count()
    assert d.find_leaks(corpus, bench.limit(1), least_chars=1).select("doc_id").distinct().count() > 0
