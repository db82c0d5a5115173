"""p9: water-filling, shares reached, caps kept, copies counted once."""

import random

import pytest

from strandline.llm import mixing

DOCUMENTS, TARGETS = "doc_id long, text string, source string", "source string, target_share double, max_repeat int"


def test_water_fill():
    assert mixing.water_fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 1000}, 100) == {"a": 10.0, "b": 90.0}
    assert mixing.water_fill({"a": 0.2, "b": 0.2, "c": 0.6}, {"a": 0, "b": 1e9, "c": 1e9}, 100) == {"a": 0.0, "b": 25.0, "c": 75.0}
    assert mixing.water_fill({"a": 1.0}, {"a": 5}, 100) == {"a": 5.0} and mixing.water_fill({}, {}, 1) == {}
    r = random.Random(1)
    for _ in range(50):
        w = {s: r.random() for s in "abcdef"}
        caps = {s: r.randint(0, 100) for s in w}
        got = mixing.water_fill(w, caps, 200)
        assert all(got[s] <= caps[s] + 1e-9 for s in w) and abs(sum(got.values()) - min(200, sum(caps.values()))) < 1e-6
        free = [got[s] / w[s] for s in w if got[s] < caps[s] - 1e-9]
        assert not free or max(free) - min(free) < 1e-6


def test_mixture(make):
    r = random.Random(2)
    docs = [{"doc_id": i, "source": s, "text": " ".join(r.choice(["one", "two", "three"]) for _ in range(r.randint(5, 20))) + f" {i}"} for i, s in enumerate(r.choices(["big", "mid", "tiny"], [80, 30, 2], k=900))]
    docs += [{"doc_id": 5000 + i, "source": "mid", "text": docs[i]["text"]} for i in range(50)] + [{"doc_id": 9000, "source": "big"}, {"doc_id": 9001, "source": "big", "text": ""}, {"doc_id": 9002, "text": "none"}, {"doc_id": 9003, "source": "other", "text": "no"}]
    targets = [("big", 0.3, 1), ("mid", 0.3, 3), ("tiny", 0.3, 2), ("absent", 0.1, 4)]
    t = make(TARGETS, *[dict(zip(("source", "target_share", "max_repeat"), x, strict=True)) for x in targets])
    used, shares = mixing.mixture(make(DOCUMENTS + ", tokens long, copies int, digest string, h long, bucket long", *docs), t)
    rows = used.collect()
    caps = {s: n for s, _, n in targets}
    assert all(1 <= x["copies"] <= caps[x["source"]] for x in rows) and len({x["doc_id"] for x in rows}) == len(rows)
    texts = {d["doc_id"]: d.get("text") for d in docs}
    assert len({texts[x["doc_id"]] for x in rows}) == len(rows)
    s = {x["source"]: x for x in shares.collect()}
    total = sum(x["tokens"] for x in s.values())
    assert s["tiny"]["epochs"] == pytest.approx(2.0) and s["tiny"]["clamped"] and s["absent"]["mixed_tokens"] == 0
    # What tiny and absent lack goes to the others in equal parts; each is met to within one text.
    rest = (total - s["tiny"]["mixed_tokens"]) / 2
    assert abs(s["big"]["mixed_tokens"] - rest) <= 40 and abs(s["mid"]["mixed_tokens"] - rest) <= 40
    assert sorted(map(tuple, mixing.mixture(make(DOCUMENTS, *docs).repartition(3), t)[0].collect())) == sorted((x["doc_id"], x["source"], x["tokens"], x["copies"]) for x in rows)


def test_empty(make):
    used, shares = mixing.mixture(make(DOCUMENTS), make(TARGETS, {"source": "a", "target_share": 1.0, "max_repeat": 1}))
    assert used.collect() == [] and shares.first()["reached_share"] == 0.0
