"""p1 against plain grouping, with hot forms and tiny buckets."""

import collections
import random

import pytest

from strandline.llm import copies
from tests.conftest import MESSAGE


def plain(rows):
    groups = collections.defaultdict(set)
    for r in rows:
        role = (r.get("role") or "").strip().lower()
        content = r.get("content")
        if role and content and r.get("seq") is not None and (key := copies.canonical(content)) and content.strip() != "<Media omitted>":
            groups[r.get("slug"), role, key].add(r["seq"])
    return {(min(g), s) for g in groups.values() for s in g if s != min(g)}


def rows_of(n=1500, seed=4):
    r, out = random.Random(seed), []
    base = ["hello big world", "te cuento que la puerta", "te cuento que la ventana", "straße", "a: 1; b: 2; c: 3", '{"c": "3", "a": 1, "b": "2"}', "x" * 30_000 + " end", "​", ""]
    for seq in range(n):
        text = base[0] if r.random() < 0.4 else r.choice(base) + (f" {r.randrange(60)}" if r.random() < 0.5 else "")
        text = r.choice([text, text.upper(), text.replace(" ", "   "), f"*{text}*", text + "…"])
        text = r.choice([text] * 20 + ["<Media omitted>"])
        out.append({"seq": seq, "slug": r.choice(["s", "t", None]), "role": r.choice(["user", " User ", "assistant", None, ""]), "content": r.choice([text, text, text, None])})
    return out


@pytest.mark.parametrize("fit", [4000, copies.FIT_BYTES])
def test_as_plain_grouping(make, monkeypatch, fit):
    monkeypatch.setattr(copies, "FIT_BYTES", fit)
    rows = rows_of()
    got = copies.found(make(MESSAGE + ", key string, leaf string, depth int", *rows).repartition(5)).collect()
    assert len(got) == len({tuple(x) for x in got})
    assert {tuple(x) for x in got} == plain(rows)
    counted = {r["first_seq"]: r["copies"] for r in copies.records(make(MESSAGE, *rows)).collect()}
    sizes = collections.Counter(first for first, _ in plain(rows))
    assert all(n == 1 + sizes[first] for first, n in counted.items()) and sizes.keys() <= counted.keys()


def test_buckets_fit_whatever_the_number_of_rows(make):
    r = random.Random(6)
    for n in (500, 4000):
        keys = ["same" if r.random() < 0.3 else "shared prefix " * 3 + "".join(r.choice("ab") for _ in range(12)) for _ in range(n)]
        cold, hot, steps = copies.radix(make("seq long, key binary", *[{"seq": i, "key": k.encode()} for i, k in enumerate(keys)]), 8000)
        sizes, leaf_of = collections.Counter(), {}
        for row in cold.collect():
            sizes[row["leaf"]] += len(row["key"]) + copies.ROW_BYTES
            assert leaf_of.setdefault(bytes(row["key"]), row["leaf"]) == row["leaf"]
        assert max(sizes.values()) <= 8000 and steps > 1
        assert {(x["first_seq"], x["n"]) for x in hot.collect()} == {(keys.index("same"), keys.count("same"))}


def test_trie_as_a_counter():
    r = random.Random(7)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 7))) for _ in range(900)]
    trie = copies.Trie()
    for i, k in enumerate(keys):
        trie.add(k, i)
    assert sorted((t[3], t[2], sorted(t[4])) for t in trie.terminals) == sorted((keys.index(k), n, [i for i, x in enumerate(keys) if x == k]) for k, n in collections.Counter(keys).items())


def test_fields_in_any_order_and_form(make):
    same = ["who: Ana; when: noon; where: home", '{"where": "home", "who": "ana", "when": "noon"}', "WHEN: noon\nwho: Ana\nwhere: home", "where: home | when: noon | who: Ana", "who Ana when noon where home"]
    other = ["who: Ana; when: noon", "when: noon; who: Ana", "who: Ana; when: home; where: noon"]
    rows = [{"seq": i, "slug": "s", "role": "user", "content": c} for i, c in enumerate(same + other)]
    assert {tuple(x) for x in copies.found(make(MESSAGE, *rows)).collect()} == {(0, i) for i in range(1, 5)}
    assert {(r["first_seq"], r["copies"]) for r in copies.records(make(MESSAGE, *rows)).collect()} == {(0, 5), (5, 1), (6, 1), (7, 1)}


def test_empty(make):
    assert copies.found(make(MESSAGE)).collect() == []
