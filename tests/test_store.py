"""The bucketed index: untouched files stay, versions are whole, results equal the whole-table operators'."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clausewise.operators import index, store


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, pos long, text string, regulation string, doc_type string, document_label string")


@pytest.fixture
def rows(spark):
    made = [(f"c{i}", i, f"t{i}", "GDPR" if i % 5 else "KVKK", "statute" if i % 2 else "guideline", "") for i in range(200)]
    return table(spark, [*made, (None, 200, None, None, None, None)])


def content(df):
    return sorted(map(str, df.collect()))


def files(path, at):
    return {b: sorted(p.name for p in Path(path, f).glob("*.parquet")) for b, f in at.folders.items()}


def test_upsert_touches_its_buckets_only(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    first = store.create(rows, path, 16)
    assert first.next_pos == 201 and content(store.open_store(spark, path)) == content(rows)
    new = table(spark, [("c7", 0, "old one", "GDPR", "statute", ""), ("c7", 1, "seven", "GDPR", "statute", ""), ("n1", 2, "new", "R", "statute", ""), (None, 3, "none", None, None, None)])
    before = files(path, first)
    second = store.merge(path, new)
    touched = {str(r[0]) for r in new.select(store.bucket(16)).distinct().collect()}
    assert {b for b in first.folders if second.folders[b] != first.folders[b]} <= touched and len(touched) <= 3
    after = files(path, second)
    assert all(after[b] == before[b] for b in before if b not in touched)
    got = {r.id: r for r in store.open_store(spark, path).collect()}
    assert got["c7"].text == "seven" and got["c7"].pos == 7 and got["n1"].pos == 203 and second.next_pos == 204 and len(got) == 202
    # the version before is still there, until it is cleared away
    assert content(store.open_store(spark, path, 0)) == content(rows)
    store.vacuum(spark, path)
    assert got[None].text == "none" and got[None].pos == 200
    assert store.versions(spark, path) == [1] and store.open_store(spark, path).count() == 202


def test_equals_whole_table(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    known = rows.where("id is not null")
    store.create(known, path, 8)
    batch = known.where("pos % 3 = 0").withColumn("text", F.lit("x")).unionByName(known.where("pos % 7 = 0").withColumn("id", F.concat(F.lit("n"), "id")))
    store.merge(path, batch)
    want = index.upsert(known, batch)
    assert content(store.open_store(spark, path)) == content(want)
    store.remove(spark, path, lambda df: index.delete_statute(df, "KVKK"))
    assert content(store.open_store(spark, path)) == content(index.delete_statute(want, "KVKK"))


def test_nothing_to_do(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    store.create(rows, path, 4)
    assert store.merge(path, rows.limit(0)).number == 0
    assert store.remove(spark, path, lambda df: index.delete_statute(df, "none such")).number == 0
    assert store.remove(spark, path, lambda df: df.where("false")).folders == {}
    assert store.open_store(spark, path).isEmpty()
    assert store.merge(path, rows.where("pos = 3")).number == 2 and store.open_store(spark, path).count() == 1


def test_empty_index_and_second_writer(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    at = store.create(rows.limit(0), path, 4)
    assert at.next_pos == 0 and store.open_store(spark, path).isEmpty()
    with pytest.raises(FileExistsError):
        store.create(rows, path)
    with pytest.raises(RuntimeError):
        store._publish(spark, path, at)
    with pytest.raises(FileNotFoundError):
        store.open_store(spark, str(tmp_path / "none"))
    assert store.versions(spark, path) == [0]
