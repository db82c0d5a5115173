"""p3 against a plain replay, and its edges."""

import random
from datetime import datetime, timedelta, timezone

from tests.conftest import LEDGER

from strandline.operators import replay


def plain(rows):
    first = {}
    for r in rows:
        kind = (r.get("event_type") or "").strip().lower()
        if r.get("event_id") and r.get("created_at") and kind in ("correction", "undo") and (r["event_id"] not in first or r["ledger_line"] < first[r["event_id"]]["ledger_line"]):
            first[r["event_id"]] = r
    state = {}
    for r in sorted(first.values(), key=lambda r: (datetime.fromisoformat(r["created_at"]), r["ledger_line"])):
        if r["event_type"].strip().lower() == "correction":
            if r.get("claim_id"):
                held = state.get((r["slug"], r["claim_id"]), {})
                state[r["slug"], r["claim_id"]] = {c: r.get(c) if r.get(c) is not None else held.get(c) for c in replay.CONTENT} | {"event_id": r["event_id"]}
        elif r.get("target_claim_id"):
            state.pop((r["slug"], r["target_claim_id"].removesuffix(":assert").removesuffix(":retract")), None)
    return state


def ledger(seed, n=400, claims=12):
    r, at, out = random.Random(seed), datetime(2022, 1, 1, tzinfo=timezone.utc), []
    for line in range(1, n + 1):
        if out and r.random() < 0.2:
            again = dict(r.choice(out), ledger_line=line)
            if again.get("created_at") and r.random() < 0.5:
                again["created_at"] = (datetime.fromisoformat(again["created_at"]).astimezone(timezone(timedelta(hours=r.randint(-8, 8))))).isoformat()
            out.append(again)
            continue
        # A third of the rows are one claim's; instants repeat.
        claim = "claim-hot" if r.random() < 0.33 else f"claim-{r.randrange(claims)}"
        when = at + timedelta(minutes=r.randrange(n // 2))
        row = {"ledger_line": line, "slug": "s" if r.random() < 0.9 else None, "event_id": f"e{line}" if r.random() > 0.02 else None, "created_at": when.isoformat() if r.random() > 0.02 else None}
        if r.random() < 0.7:
            row |= {"event_type": r.choice(["correction", " Correction "]), "claim_id": claim if r.random() > 0.02 else None, "assert_subject": f"v{line}" if r.random() < 0.7 else None, "confidence": r.random() if r.random() < 0.5 else None, "raw_text": "x" * 50_000 if line == 7 else None}
        else:
            row |= {"event_type": r.choice(["undo", "UNDO", "note", None]), "target_claim_id": claim + r.choice(["", ":assert", ":retract"])}
        out.append(row)
    r.shuffle(out)
    return out


def test_as_a_plain_replay(make, spark):
    for seed in range(3):
        rows = ledger(seed)
        got = {(r["slug"], r["claim_id"]): {c: r[c] for c in [*replay.CONTENT, "event_id"]} for r in replay.replay(replay.applicable(make(LEDGER, *rows).repartition(7))).collect()}
        assert got == plain(rows)


def test_small_batches(make, spark):
    rows = ledger(9)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {(r["claim_id"], r["event_id"]) for r in replay.found(make(LEDGER, *rows)).collect()} == {(k[1], v["event_id"]) for k, v in plain(rows).items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_edges(make):
    assert replay.found(make(LEDGER)).collect() == []
    nulls = make(LEDGER + ", kind string, canon string, claim string, at_us long", {"ledger_line": 1}, {"event_id": "e", "event_type": "undo", "created_at": "2022-01-01T00:00:00Z", "ledger_line": 2, "kind": "set"}, {"event_id": "f", "event_type": "correction", "created_at": "never", "claim_id": "c", "ledger_line": 3})
    assert replay.found(nulls).collect() == []
