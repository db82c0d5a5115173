"""p4: dropped files, conversations, threads; files that span blocks."""

import datetime as dt
import random

from strandline.llm import dialogue
from tests.conftest import MESSAGE, SOURCE_INDEX

AT = dt.datetime(2025, 1, 1)


def file(name, *turns, lines=None, **more):
    rows = [{"seq": hash((name, i)) % 10**9, "source_file": name, "line_no": i, "role": role, "content": text, "timestamp": stamp, "source_type": "jsonl"} | more for i, (role, text, stamp) in enumerate(turns, 1)]
    return rows, {"filename": name, "lines": len(turns) if lines is None else lines, "imported_at": AT}


def found(make, *files, index=True, extra=""):
    m = make(MESSAGE + extra, *[r for f in files for r in f[0]])
    s = make(SOURCE_INDEX, *[f[1] for f in files if index])
    return {(r["source_file"], r["reason"]) for r in dialogue.found(m, s).collect()}


def test_reasons(make):
    t = [f"2024-01-01T10:0{i}:00Z" for i in range(6)]
    files = [
        file("good", ("user", "q", t[0]), (" Assistant ", "a", t[1])),
        file("empty", ("user", " ​", t[0]), ("assistant", "<Media omitted>", t[1]), (None, None, None), lines=9),
        file("broken", ("user", "q", t[0]), ("assistant", "a", t[1]), lines=3),
        file("backwards", ("user", "q", t[3]), ("assistant", "a", t[1])),
        file("unstamped", ("assistant", "a", t[1]), ("user", "q", None)),
        file("roles", ("User", "q", t[0]), ("system", "a", t[1]), ("bot", "a", t[2])),
        file("silent", ("user", "q", t[0]), ("assistant", "imagen omitida", t[1])),
        file("ties", ("user", "q", t[0]), ("assistant", "a", t[0])),
        file("late", ("assistant", "a", t[5]), ("user", "q", t[0])),
    ]
    assert found(make, *files, extra=", block int, rank long, code int, row_id long") == {("empty", "empty"), ("broken", "broken"), ("backwards", "no_reply"), ("roles", "no_reply"), ("silent", "no_reply")}
    assert found(make, file("x", ("user", "q", None), lines=7), index=False) == {("x", "no_reply")}
    assert found(make) == set()


def test_a_file_over_many_blocks(make, spark):
    r = random.Random(8)
    rows = [{"seq": i, "source_file": "hot", "line_no": i, "role": "assistant" if i != 700 else "user", "content": "x" * r.randint(1, 9), "timestamp": f"2024-01-01T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z"} for i in range(1, 1501)]
    last = [x | {"source_file": "never", "role": "user" if x["line_no"] == 1500 else "assistant", "seq": x["seq"] + 5000} for x in rows]
    m = make(MESSAGE, *rows, *last).repartition(6)
    s = make(SOURCE_INDEX, {"filename": "hot", "lines": 1500, "imported_at": AT}, {"filename": "never", "lines": 1500, "imported_at": AT})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert {tuple(x) for x in dialogue.found(m, s).collect()} == {("never", "no_reply")}
        got = dialogue.conversations(m, s).orderBy("turn_no").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [x["line_no"] for x in got] == list(range(1, 1501)) and [x["turn_no"] for x in got] == list(range(1500))


def test_threads(make):
    rows = [{"seq": i, "source_file": "f", "line_no": i, "metadata": m} for i, m in enumerate(["{}", '{"reply_to": 1}', '{"reply_to": 2}', '{"reply_to": 77}', '{"reply_to": 5}', "no json"], 1)]
    got = {r["line_no"]: (r["root_line"], r["depth"], r["state"]) for r in dialogue.threads(make(MESSAGE, *rows)).collect()}
    assert got[1] == (1, 0, "ok") and got[3] == (1, 2, "ok") and got[4][2] == "orphan" and got[5][2] == "cycle" and got[6] == (6, 0, "ok")
    chains = {(r["leaf_line"], r["place"]): r["line_no"] for r in dialogue.reply_paths(make(MESSAGE, *rows)).collect()}
    assert chains == {(3, 0): 1, (3, 1): 2, (3, 2): 3}
    told = [x | {"role": "user" if x["line_no"] % 2 else "assistant", "content": "x", "timestamp": f"2024-01-01T10:0{x['line_no']}:00Z"} for x in rows]
    c = dialogue.conversations(make(MESSAGE, *told), make(SOURCE_INDEX, {"filename": "f", "lines": 6, "imported_at": AT})).orderBy("turn_no").collect()
    assert [(x["line_no"], x["thread_line"], x["thread_depth"], x["thread_state"]) for x in c[:4]] == [(1, 1, 0, "ok"), (2, 1, 1, "ok"), (3, 1, 2, "ok"), (4, 77, 0, "orphan")]
