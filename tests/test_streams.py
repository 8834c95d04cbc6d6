"""Cache state, ledger, batches and progress: streams against batch replays, failures in the middle."""

import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.streaming import cache, sinks


def plain_cache(rows, ttl, capacity):
    """Requests in order, entries as a list from the one used longest ago to the latest."""
    out, shards = Counter(), {}
    for shard, request, at, kind, key, sha in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        held = shards[shard] = [e for e in shards.get(shard, []) if at - e["stored"] <= ttl * 1000]
        mine = next((e for e in held if e["key"] == key), None)
        outcome, evicted = "miss", None
        if kind == "put":
            held[:] = [e for e in held if e["key"] != key]
            if len(held) == capacity:
                oldest = min(held, key=lambda e: (e["used"], e["key"]))
                held.remove(oldest)
                evicted = oldest["key"]
            held.append({"key": key, "sha": sha, "stored": at, "used": at})
            outcome = "stored"
        elif mine:
            outcome = "hit" if mine["sha"] == sha else "changed"
            mine["used"] = at
            if outcome == "changed":
                held.remove(mine)
        out[(shard, request, kind, key, outcome, evicted)] += 1
    return out


@pytest.fixture(scope="module")
def requests():
    rng = random.Random(6)
    rows, at = [], 1_700_000_000_000
    for k in range(400):
        at += rng.choice([0, 1, 1000, 60_000])
        rows.append((f"s{rng.randrange(3)}", k, at, rng.choice(["put", "get", "get"]), f"k{rng.randrange(6)}", f"v{rng.randrange(2)}"))
    return rows


def test_replay(spark, requests):
    got = cache.replayed(spark.createDataFrame(requests, cache.REQUEST), 300, 3).collect()
    want = plain_cache(requests, 300, 3)
    assert Counter(tuple(r) for r in got) == want
    assert {o for *_, o, _ in want} == {"hit", "miss", "changed", "stored"} and any(e for *_, e in want)


def test_stream_gives_the_rows_of_the_replay(spark, requests, tmp_path):
    """Four files, rows shuffled inside a watermark's reach, the last file only moves the watermark."""
    rng = random.Random(9)
    late = sorted(requests, key=lambda r: r[2] + rng.uniform(0, 500_000))
    folder = tmp_path / "in"
    folder.mkdir()
    for k, part in enumerate([late[:150], late[150:280], late[280:], [("zz", 10**6, requests[-1][2] + 10**9, "get", "k", "v")], [("zz", 10**6 + 1, requests[-1][2] + 2 * 10**9, "get", "k", "v")]]):
        names = ("shard", "request", "at", "kind", "key", "sha")
        (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in part))
        time.sleep(0.02)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", cache.ROCKS)
    try:
        stream = spark.readStream.schema(cache.REQUEST).option("maxFilesPerTrigger", 1).json(str(folder))
        made = cache.cached_stream(stream, 300, 3, late="9 minutes")
        query = made.writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = Counter(tuple(r) for r in spark.table("answers").filter("shard <> 'zz'").collect())
    assert got == plain_cache(requests, 300, 3)


def test_a_batch_is_written_once(spark, tmp_path):
    """The second batch fails after its rows are written, before they are noted; the query starts anew."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"id": 10 * k + j}) for j in range(5)))
        time.sleep(0.02)
    fails = {1}

    class Breaking(sinks.Ledger):
        def note(self, batch):
            if batch in fails:
                fails.discard(batch)
                raise RuntimeError("lost the driver")
            super().note(batch)

    def run():
        keep, sinks.Ledger = sinks.Ledger, Breaking
        try:
            sink = sinks.ledger_sink(spark, out, lambda df: df.withColumn("twice", F.col("id") * 2))
        finally:
            sinks.Ledger = keep
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(source))
        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()

    ledger = sinks.Ledger(spark, out)
    with pytest.raises(Exception, match="lost the driver"):
        run().awaitTermination(120)
    assert ledger.batches() == [0] and ledger.read("id long, twice long").count() == 5  # what batch 1 left behind doesn't show
    run().awaitTermination(120)
    rows = [tuple(r) for r in ledger.read("id long, twice long").collect()]
    assert sorted(rows) == [(10 * k + j, 2 * (10 * k + j)) for k in range(3) for j in range(5)]
    sinks.ledger_sink(spark, out)(spark.createDataFrame([(99,)], "id long"), 2)  # batch 2 comes again, with other rows even
    assert ledger.read("id long").count() == 15
    assert sinks.Ledger(spark, str(tmp_path / "none")).read("id long").count() == 0


def test_payloads(spark):
    issues = spark.createDataFrame(
        [("o", "r", 7, "abc", k, s, float(k), f"f{k}.py", k, f"title {k}") for k, s in enumerate(["low", "high", "critical", "low"])] + [("o", "q", 8, "def", 9, "low", 1.0, "g.py", 3, "t")],
        "owner string, repo string, number int, sha string, id int, severity string, priority double, file_path string, line_start int, title string",
    )
    rows = {r.path: json.loads(r.payload) for r in sinks.review_requests(issues, 2).collect()}
    assert rows["/repos/o/r/pulls/7/reviews"]["event"] == "REQUEST_CHANGES" and rows["/repos/o/q/pulls/8/reviews"]["event"] == "APPROVE"
    assert rows["/repos/o/r/pulls/7/reviews"]["comments"] == [{"path": f"f{k}.py", "body": f"title {k}", "line": k, "side": "RIGHT"} for k in (3, 2)]
    assert rows["/repos/o/r/statuses/abc"] == {"state": "failure", "description": "4 issues, 1 critical, 1 high", "context": "code-quality"}
    comments = spark.createDataFrame([([("p", "b", 9, "LEFT", 4, None), ("p", "c", 9, "LEFT", 0, "RIGHT")],)], "c array<struct<path:string,body:string,line:int,side:string,start_line:int,start_side:string>>")
    made = json.loads(comments.select(sinks.review_payload(F.lit("COMMENT"), F.lit(None), F.col("c")).alias("x")).first().x)
    assert made["body"] == "" and made["comments"][0]["start_line"] == 4 and made["comments"][0]["start_side"] == "LEFT" and "start_line" not in made["comments"][1]


def test_batches_go_on_after_a_failure(spark):
    def analyze(frame):
        if (frame["size"] < 0).any():
            raise ValueError("negative size")
        return {"files": len(frame), "size": int(frame["size"].sum())}

    files = spark.createDataFrame([("b1", "x", 1), ("b1", "x", 2), ("b1", "y", -1), ("b2", "z", 5)], "batch string, repository string, size int")
    outcomes = sinks.batch_outcomes(files, analyze)
    assert {(r.batch, r.repository, r.ok, r.result, r.error) for r in outcomes.collect()} == {
        ("b1", "x", True, '{"files": 2, "size": 3}', None), ("b1", "y", False, None, "ValueError: negative size"), ("b2", "z", True, '{"files": 1, "size": 5}', None)}
    asked = spark.createDataFrame([("b1", "x"), ("b1", "y"), ("b2", "z"), ("b2", "later"), ("b3", "q")], "batch string, repository string")
    assert {tuple(r) for r in sinks.batch_status(asked, outcomes).collect()} == {("b1", 2, 1, 1, "completed"), ("b2", 2, 1, 0, "running"), ("b3", 1, 0, 0, "pending")}


def test_progress_is_read_back(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "progress")
    source.mkdir()
    for k in range(2):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"id": j}) for j in range(4)))
        time.sleep(0.02)
    writer = sinks.ProgressWriter(spark, out, total=8)
    spark.streams.addListener(writer)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(source))
        stream.writeStream.format("noop").queryName("watched").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
        bad = stream.select(F.raise_error(F.lit("broken")).alias("x")).writeStream.format("noop").queryName("bad").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="broken"):
            bad.awaitTermination(120)
        until = time.time() + 60
        while time.time() < until and len({r.query for r in sinks.read_progress(spark, out).filter("status IN ('completed', 'failed')").collect()} if (tmp_path / "progress").exists() else ()) < 2:
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(writer)
    rows = sinks.read_progress(spark, out).filter("query = 'watched'").collect()
    assert sorted((r.status, r.batch, r.rows_total, r.percent) for r in rows if r.status == "running") == [("running", 0, 4, 50.0), ("running", 1, 8, 100.0)]
    assert {r.status for r in rows} == {"started", "running", "completed"}
    failed = sinks.read_progress(spark, out).filter("query = 'bad' AND status = 'failed'").collect()
    assert len(failed) == 1 and "broken" in failed[0].error
