"""Documents from a stream of windows against the same in one batch."""

import json
import random
import time

from pyspark.sql import functions as F

from tessella.operators import score
from tessella.streaming.windows import complete_documents

SCHEMA = "strategy string, sample_id long, chunk_idx int, total_chunks int, actual_codes array<string>, codes array<string>"


def windows(rng):
    rows = []
    for s in ("ZS", "CoT"):
        for d in range(30):
            n = rng.randrange(1, 5)
            own = [f"F{x}" for x in rng.sample(range(9), 3)]
            rows += [[s, d, i, n, own, None if (d + i) % 7 == 0 else [f"F{x}" for x in rng.choices(range(9), k=rng.randrange(4))]] for i in range(n)]
    return rows


def write(folder, k, rows):
    (folder / f"{k:03}.json").write_text("\n".join(json.dumps(dict(zip([c.split(" ")[0] for c in SCHEMA.split(", ")], r, strict=True))) for r in rows))


def run(spark, folder, name, wait, rows, more=0.0):
    """The stream's rows once there are ``rows`` of them and ``more`` seconds have gone by (a timeout never lets a stream rest)."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    query = complete_documents(stream, wait).writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 100
        while spark.table(name).count() < rows and time.time() < end and query.isActive:
            time.sleep(0.5)
        time.sleep(more)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return spark.table(name)


def test_any_order_repeats_and_late_windows(spark, tmp_path):
    rng = random.Random(2)
    rows = windows(rng)
    sent = rows + rng.choices(rows, k=40)
    rng.shuffle(sent)
    sent += [r for r in rows if r[1] == 3]  # again, after their document is out
    sent.append(["ZS", 5, None, None, None, ["F1"]])
    for k in range(5):
        write(tmp_path, k, sent[k::5] if k < 4 else sent[4::5])
    got = run(spark, tmp_path, "complete", "1 hour", 60, 6.0)
    batch = score.union_over_chunks(spark.createDataFrame(rows, SCHEMA).withColumn("key", F.struct("strategy", "sample_id")).withColumn("codes", F.coalesce("codes", F.array().cast("array<string>"))), "key")
    want = {(r["key"]["strategy"], r["key"]["sample_id"]): (r["predicted_codes"], r["num_chunks"]) for r in batch.collect()}
    found = got.collect()
    assert len(found) == len(want) and {(r["strategy"], r["sample_id"]): (r["predicted_codes"], r["num_chunks"]) for r in found} == want
    assert all(r["complete"] for r in found)
    actual = {(r[0], r[1]): r[4] for r in rows}
    assert all(r["actual_codes"] == actual[r["strategy"], r["sample_id"]] for r in found)
    scored = score.scored(got)
    assert scored.where("tp + fn <> size(actual_codes)").count() == 0


def test_documents_that_stay_incomplete_come_out_after_the_wait(spark, tmp_path):
    write(tmp_path, 0, [["ZS", 1, 0, 2, ["F1"], ["F1"]], ["ZS", 2, 0, 1, ["F2"], ["F2"]]])
    got = run(spark, tmp_path, "waiting", "1 second", 2, 2.0)
    rows = {r["sample_id"]: (r["complete"], r["num_chunks"], r["predicted_codes"]) for r in got.collect()}
    assert rows == {1: (False, 1, ["F1"]), 2: (True, 1, ["F2"])}
