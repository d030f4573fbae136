"""Answers held by id and emitted once, over several starts of the stream."""

import json
import os

from pairloom.streaming.answers import stream_answers, write_answers


def put(folder, name, at, answers):
    folder.mkdir(exist_ok=True)
    lines = [{"custom_id": i, "response": {"status_code": 200, "body": {"choices": [{"message": {"content": t}}]}}} for i, t in answers]
    (folder / name).write_text("\n".join(map(json.dumps, lines)))
    os.utime(folder / name, (1_700_000_000 + at, 1_700_000_000 + at))


def test_each_id_comes_out_once(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    source, out, late, check = (tmp_path / n for n in ("in", "out", "late", "check"))

    def run():
        stream = stream_answers(spark, str(source), 100, files_per_batch=1)
        query = write_answers(stream, str(out), str(late), str(check), parse=lambda df: df)
        query.awaitTermination()
        rows = [
            sorted(tuple(r)[:2] for r in spark.read.schema("custom_id string, response string").parquet(str(p)).collect())
            for p in (out, late)
        ]
        return *rows, sum(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:] if p["stateOperators"])

    put(source, "a", 0, [("1", "a"), ("2", "b"), ("1", "c")])
    put(source, "b", 50, [("1", "b"), ("3", "x")])
    assert run()[:2] == ([], [])  # nothing's time has passed
    put(source, "c", 120, [("3", "z"), ("4", "y")])
    assert run()[:2] == ([("1", "c"), ("2", "b")], [])
    assert run()[:2] == ([("1", "c"), ("2", "b")], [])  # a start without new files repeats nothing
    put(source, "d", 160, [("1", "zz"), ("5", "n")])
    assert run()[:2] == ([("1", "c"), ("2", "b"), ("3", "z")], [("1", "zz")])
    put(source, "e", 5000, [("9", "end")])
    found = run()
    assert found[0] == [("1", "c"), ("2", "b"), ("3", "z"), ("4", "y"), ("5", "n")] and found[1] == [("1", "zz")]
    put(source, "f", 9000, [("10", "end")])
    found = run()
    assert ("9", "end") in found[0] and found[2] <= 4  # what is done leaves the state
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
