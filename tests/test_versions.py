"""Versioned tables: whole or not at all, one writer at a time, once for each batch."""

import threading

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import versions as V

NOW = "timestamp_ntz'2024-01-02 00:00:00'"


@pytest.fixture
def store(spark, tmp_path):
    return V.Store(spark, str(tmp_path / "store"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def layer(spark, tag, n):
    return {"community": spark.range(n).select("id", F.lit(tag).alias("tag")), "parent": spark.range(n).select("id", F.lit(tag).alias("tag"))}


def test_layers_are_replaced_together(spark, store):
    assert store.snapshot() == V.Snapshot(0)
    V.replace_layers(store, layer(spark, "old", 3))
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            at = store.snapshot()
            seen.append(tuple(tuple(sorted({r.tag for r in store.read(n, at).collect()})) + (store.read(n, at).count(),) for n in ("community", "parent")))

    reader = threading.Thread(target=read)
    reader.start()
    before = store.snapshot()
    V.replace_layers(store, layer(spark, "new", 5))
    stop.set()
    reader.join()
    assert set(seen) <= {(("old", 3),) * 2, (("new", 5),) * 2}
    assert {r.tag for r in store.read("parent").collect()} == {"new"} and store.read("parent", before).count() == 3  # a snapshot stays


def test_a_writer_that_died_leaves_the_old_state(spark, store):
    V.replace_layers(store, layer(spark, "old", 3))

    def die(_):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.update(die)
    (path := store.folder) and open(f"{path}/versions/00000002.json", "w").write('{"tables": {"comm')  # half a manifest
    assert {r.tag for r in store.read("community").collect()} == {"old"}
    V.replace_layers(store, layer(spark, "new", 2))
    assert {r.tag for r in store.read("community").collect()} == {"new"} and store.snapshot().number == 3


def test_of_two_writers_one_is_refused(spark, store):
    base = store.snapshot()
    store.commit(base, {"a": spark.range(1)})
    with pytest.raises(V.Conflict):
        store.commit(base, {"a": spark.range(2)})
    assert store.read("a").count() == 1


def test_reset_empties_and_keeps_schemas(spark, store):
    store.commit(store.snapshot(), {"fact": spark.range(4), "article": spark.range(2)})
    V.reset(store, ["fact", "nowhere"])
    assert store.read("fact").count() == 0 and store.read("fact").columns == ["id"] and store.read("article").count() == 2


def test_a_batch_counts_once(spark, store):
    def change(ids):
        return lambda at: {"seen": (store.read("seen", at) if "seen" in at.tables else spark.range(0)).unionByName(spark.createDataFrame([(i,) for i in ids], "id long"))}

    assert V.apply_batch(store, 0, "c0", change([1, 2]))
    assert V.apply_batch(store, 1, None, change([3]))  # a malformed line holds the cursor
    assert not V.apply_batch(store, 1, "c1", change([3]))  # again after a restart
    at = store.snapshot()
    assert rows(store.read("seen")) == [(1,), (2,), (3,)] and at.notes == {"feed.batch": 1, "feed.cursor": "c0"}


def test_a_restarted_stream_gives_the_same_tables(spark, store, tmp_path):
    """The process dies after a batch is committed and before the stream knows: the batch comes again."""
    from quillgraph.streaming import feeds

    (tmp_path / "in").mkdir()
    for n, lines in enumerate((["a", "b"], ["c"])):
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(lines))
    dies = [True]

    def each(batch, number):
        V.apply_batch(store, number, str(number), lambda at: {"line": batch.unionByName(store.read("line", at)) if "line" in at.tables else batch})
        if dies.pop() if dies else False:
            raise RuntimeError("killed")

    stream = lambda: spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    with pytest.raises(Exception, match="killed"):
        feeds.run_once(stream(), str(tmp_path / "checkpoint"), each)
    feeds.run_once(stream(), str(tmp_path / "checkpoint"), each)
    assert rows(store.read("line")) == [("a",), ("b",), ("c",)] and store.snapshot().notes["feed.cursor"] == "1"


def test_drafts(spark, store):
    d = V.Drafts(store)
    put = lambda *rs: d.save(spark.createDataFrame(rs, "key string, draft string"))
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert rows(d.load(keys).fillna("-")) == [("a", "-"), ("b", "-")]
    put(("a", "1"), ("c", "x"))
    put(("a", "2"))
    assert rows(d.load(keys).fillna("-")) == [("a", "2"), ("b", "-")]
    d.clear()
    assert rows(d.load(keys).fillna("-")) == [("a", "-"), ("b", "-")]


def test_two_claimers_never_get_one_job(spark, store):
    jobs = spark.createDataFrame([(i, "pending" if i else "in_progress", "bootstrap" if i % 3 else "incremental", f"2024-01-01 00:00:{i:02d}", None if i else "2024-01-01 00:00:00") for i in range(12)], "job_id long, status string, lane string, at string, c string")
    jobs = jobs.select("job_id", "status", "lane", F.to_timestamp_ntz("at").alias("enqueued_at"), F.to_timestamp_ntz("c").alias("claimed_at"), F.lit(None).cast("string").alias("claimed_by"))
    store.commit(store.snapshot(), {"job": jobs})
    got = {}
    work = lambda w: got.update({w: [r.job_id for r in V.claim_jobs(store, w, 4, F.expr(NOW), 3600).collect()]})
    threads = [threading.Thread(target=work, args=(w,)) for w in "xy"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    every = got["x"] + got["y"]
    assert len(every) == len(set(every)) == 8 and set(every) == {0, 3, 6, 9, 1, 2, 4, 5}  # the lease of job 0 was over
    assert store.read("job").filter("status = 'in_progress'").count() == 8
