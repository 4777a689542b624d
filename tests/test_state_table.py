"""The edit state as files: late, repeated and unordered lines, batches that run again, snapshots."""

import json
import random

import pytest
from pyspark.sql import functions as F

from formloom.operators import audit as a
from formloom.session import names_in
from formloom.streaming import edits as st


def line(job, cell, new, seq, real=True):
    return json.dumps({"job_id": job, "wb_id": "w", "sheet": "S", "target_cell": cell, "old_value": None, "new_value": new, "round_idx": 0, "source": "x", "is_actual_edit": real, "seq": seq})


def put(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def test_late_and_repeated_files_give_the_batch_result(spark, tmp_path):
    r = random.Random(1)
    log = [("j" + str(r.randint(0, 1)), r.choice("ABC") + str(r.randint(1, 3)), str(k), k, r.random() < 0.8) for k in range(120)]
    r.shuffle(log)
    src, folder, checkpoint = tmp_path / "log", str(tmp_path / "state"), str(tmp_path / "check")
    src.mkdir()
    table = st.StateTable(spark, folder, st.CELL, every=2)
    for k in range(6):
        part = log[k * 20 : k * 20 + 20]
        put(src, f"f{k}.jsonl", [line(*x) for x in part + part[:5]] + ["", "broken {"] + [line(*x) for x in log[: k * 4]])
        if k % 2:
            st.run_into(st.stream_edit_state(st.read_edit_stream(spark, str(src), max_files=1)), table, checkpoint)
    want = {}
    for job, cell, new, seq, real in sorted(log, key=lambda x: x[3]):
        if real:
            want[job, cell] = (new, seq)
    assert {(x["job_id"], x["target_cell"]): (x["new_value"], x["seq"]) for x in table.read().collect()} == want
    assert names_in(spark, f"{folder}/snapshots") and len(table._changes()) < 6
    # The same rows as the batch operator gives.
    rows = [("w", "S", job, cell, new, seq, real) for job, cell, new, seq, real in log]
    e = spark.createDataFrame(rows, "wb_id string, sheet string, job string, target_cell string, new_value string, seq int, is_actual_edit boolean")
    for job in ("j0", "j1"):
        batch = {x["target_cell"]: (x["new_value"], x["seq"]) for x in a.latest_effective_edits(e.filter(F.col("job") == job)).collect()}
        assert batch == {c: v for (j, c), v in want.items() if j == job}


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    table = st.StateTable(spark, str(tmp_path / "t"), ["k"], every=2)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(rows(("a", 1), ("b", 1)), 0)
    table.write(rows(("a", 2), ("c", 2)), 1)
    table.write(rows(("a", 2), ("c", 2)), 1)
    assert sorted(map(tuple, table.read().collect())) == [("a", 2), ("b", 1), ("c", 2)]
    table.write(rows(("b", 5)), 2)
    table.write(rows(("d", None)), 3)
    assert sorted(map(tuple, table.read().collect()), key=str) == [("a", 2), ("b", 5), ("c", 2), ("d", None)]
    assert sorted(map(tuple, table.read(upto=1).collect())) == [("a", 2), ("b", 1), ("c", 2)]
    assert table._snapshots() == [1, 3] and table._changes() == [2, 3]
    (tmp_path / "t" / "snapshots" / "upto=9").mkdir()  # one that was not finished
    assert table.read().count() == 4
