"""p8: every planted passage within the rule is found, others are not; winnowing guarantees."""

import random

from strandline.llm import leaks

DOCUMENTS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(r, n, prefix=""):
    return [prefix + "".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_planted(make):
    r = random.Random(2)
    items = {i: words(r, r.randint(18, 60)) for i in range(30)}
    docs, want = [], set()
    for d in range(160):
        i = r.randrange(30)
        item = items[i]
        n = r.choice([8, 12, 13, 16, 18, 24, len(item)])
        n = min(n, len(item))
        at = r.randrange(len(item) - n + 1)
        part = list(item[at : at + n])
        edits = r.randint(0, n // 6) if n >= 16 else 0
        # Edits inside, at most one in six, places apart.
        for p in sorted(r.sample(range(1, n - 1), edits), reverse=True):
            kind = r.choice("cda")
            if kind == "c":
                part[p] = "changed"
            elif kind == "d":
                del part[p]
            else:
                part.insert(p, "added")
        text = " ".join(words(r, 40, "z") + part + words(r, 40, "y"))
        docs.append({"doc_id": d, "text": r.choice([text, text.upper(), text.replace(" ", ",\n> ", 7), f"<p>{text}</p>", text.replace(" ", " **", 3)])})
        if n >= 16:
            want.add((d, i))
    got = {tuple(x) for x in leaks.found(make(DOCUMENTS + ", fp long, pos int, lo int, item_id long", *docs), make(ITEMS, *[{"item_id": i, "text": "¿" + " ".join(t) + "?"} for i, t in items.items()])).collect()}
    assert got == want


def test_shared_runs_leave_a_fingerprint():
    r = random.Random(4)
    for _ in range(200):
        run = words(r, leaks.K + leaks.WINDOW - 1)
        a, b = words(r, 9) + run + words(r, 9), words(r, 3) + run + words(r, 11)
        assert set(leaks.fingerprints(a)[0]) & set(leaks.fingerprints(b)[0])


def test_salted_join_and_edges(make, monkeypatch):
    r = random.Random(5)
    text = " ".join(words(r, 20))
    d = make(DOCUMENTS, {"doc_id": 1, "text": text}, {"doc_id": 2, "text": text}, {"doc_id": 3}, {"doc_id": 4, "text": ""}, {"doc_id": 5, "text": "word " * 30_000 + text})
    i = make(ITEMS, {"item_id": 1, "text": text}, {"item_id": 2, "text": "too short"}, {"item_id": 3})
    assert {tuple(x) for x in leaks.found(d, i).collect()} == {(1, 1), (2, 1), (5, 1)}
    monkeypatch.setattr(leaks, "MOST_CHARS", 0)
    assert {tuple(x) for x in leaks.found(d, i).collect()} == {(1, 1), (2, 1), (5, 1)}
    assert leaks.found(make(DOCUMENTS), make(ITEMS)).collect() == []
    assert {tuple(x) for x in leaks.leaked_items(d, i).collect()} == {(1, 3), (2, 0), (3, 0)}


def test_edits_at_the_ends_of_an_item():
    r = random.Random(6)
    item, around = words(r, 16), words(r, 30, "z")
    changed = ["other", *item[1:]]
    assert leaks.holds(item, around + changed + around) and leaks.holds(item, around + [*item[:-1], "other"] + around)
    assert leaks.holds(item, around + item[1:] + around) and not leaks.holds(item, around + item[:13] + around)
    # Inside a longer item the ends of a passage stand as they are: 14 words are no passage of 16.
    longer = words(r, 20) + item[:14] + words(r, 20)
    assert not leaks.holds(longer, around + item[:14] + around)


def test_many_texts_at_once_as_one_by_one():
    r = random.Random(7)
    texts = [words(r, r.choice([0, 1, 2, 3, 4, 5, 40])) for _ in range(200)] + [["a"] * 30, ["a", "b"] * 20]
    of, at, g = leaks.winnow(texts, leaks.Hashes())
    for k, ws in enumerate(texts):
        assert leaks.fingerprints(ws) == (g[of == k].tolist(), at[of == k].tolist())
        assert len(ws) < leaks.K or (of == k).any()
