"""p10: chunk borders do not matter, kinds of plain cases, the labelled sample, and edges."""

import os
import random

import numpy as np
import pytest

from strandline.llm import quality

DOCUMENTS = "doc_id long, text string"
PROSE = "The baker lost the guitar near the station, because nobody else wanted to. I have always liked patience, above all in the kitchen."
CASES = {
    PROSE: "prose",
    PROSE.upper(): "prose",
    "\n".join(f"Ana: {PROSE}" for _ in range(3)): "prose",
    PROSE + "\n\n- the guitar\n- the bread\n\n" + PROSE: "prose",
    "\n".join(f"- the guitar in the kitchen {i}" for i in range(8)): "list",
    "\n".join(["The guitar", "The old bicycle", "Light rain", "The umbrella in the yard", "A box of photos", "The drill,"]): "list",
    "\n".join(f"{i},the baker,2021-01-0{i},{i * 7}" for i in range(1, 9)): "table",
    "| a | b |\n| --- | --- |\n" + "\n".join(f"| the baker | {i} |" for i in range(6)): "table",
    "\n".join(f"id={i}; who=the baker; at=2020" for i in range(6)): "table",
    "click here\n" * 40: "junk",
    "68krgbnPCy9sd0SKKM6a9RGgsJtHvRCyVQXJuMRxIR412ivhnpSwNu4OJmhIKMYwIOofsGyJ" * 4: "junk",
    "===============\n*************\n-------------": "junk",
    "": "junk",
    "   \n ": "junk",
}


def test_kinds(make):
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(CASES)] + [{"doc_id": 99}, {"text": "x"}]
    got = {r["doc_id"]: r["kind"] for r in quality.statistics(make(DOCUMENTS + ", chunk int, state string, pieces int", *rows)).collect()}
    assert got == dict(enumerate(CASES.values()))
    assert quality.found(make(DOCUMENTS)).collect() == []


def test_chunks_do_not_matter():
    r = random.Random(1)
    for text in CASES:
        whole = quality.figures(quality.close(quality.count(text)))
        for _ in range(5):
            cuts = sorted({0, len(text), *(r.randrange(len(text) + 1) for _ in range(6))})
            states = [quality.count(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)] or [quality.count("")]
            while len(states) > 1:
                i = r.randrange(len(states) - 1)
                states[i : i + 2] = [quality.merge(*states[i : i + 2])]
            assert quality.figures(quality.close(states[0])) == whole


def test_long_texts_in_a_tree(make, monkeypatch):
    monkeypatch.setattr(quality, "FAN_IN", 3)
    d = make(DOCUMENTS, {"doc_id": 1, "text": (PROSE + "\n") * 60}, {"doc_id": 2, "text": "x" * 5000}, {"doc_id": 3, "text": "short and to the point, as it is."})
    a, b = ({r["doc_id"]: r for r in quality.statistics(d, c).collect()} for c in (97, quality.CHUNK))
    assert a == b


def test_labelled_sample(spark):
    where = "/root/testdata/sf0.1"
    if not os.path.isdir(where):
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/doc_label.parquet")
    rows = quality.statistics(docs.join(labels.select("doc_id"), "doc_id", "left_semi")).join(labels.withColumnRenamed("kind", "label"), "doc_id").collect()
    assert sum(r["kind"] == r["label"] for r in rows) / len(rows) >= 0.98


def in_chunks(text, size=quality.CHUNK):
    states = [quality.count(text[i : i + size]) for i in range(0, len(text), size)]
    while len(states) > 1:
        states = [quality.merge(*states[i : i + 2]) if i + 1 < len(states) else states[i] for i in range(0, len(states), 2)]
    return quality.figures(quality.close(states[0]))


def test_long_texts_are_no_junk_by_length():
    r = random.Random(5)
    words = ["".join(r.choice("abdeilnorst") for _ in range(6)) for _ in range(300)]
    sentence = lambda: " ".join(f"the {r.choice(words)} {r.choice(words)}" for _ in range(5)).capitalize() + "."
    for n in (50, 3000):
        assert in_chunks(" ".join(sentence() for _ in range(n)))["kind"] == "prose"
        assert in_chunks("\n".join(sentence() for _ in range(n)))["kind"] == "prose"
    rows = in_chunks("\n".join(f"{i},the baker,2021,{i * 7}" for i in range(160_000)))
    assert rows["kind"] == "table" and abs(rows["distinct_lines"] - 1) < 0.15
    # A block of 300 words, longer than what a window can tell, is junk where it is repeated without end.
    assert in_chunks((" ".join(sentence() for _ in range(30)) + " ") * 200)["kind"] == "junk"


def test_window_shares_as_counted():
    r = random.Random(6)
    for n in (0, 1, 6, 7, 8, 40):
        items = np.array([r.choice(range(8)) for _ in range(n)], np.uint64)
        size = min(7, n)
        want = sum(len(set(items[i : i + size].tolist())) / size for i in range(n - size + 1)) / (n - size + 1) if n else 0.0
        for cut in range(n + 1):
            s = quality.follow(quality.sequence(items[:cut], 7), quality.sequence(items[cut:], 7), 7)
            assert abs(quality.window_share(s, 7) - want) < 1e-12


def pieces_of(text, r, n):
    cuts = sorted({0, len(text), *(r.randrange(len(text) + 1) for _ in range(n))})
    return [quality.count(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def in_any_order(states, r):
    states = list(states)
    while len(states) > 1:
        i = r.randrange(len(states) - 1)
        states[i : i + 2] = [quality.merge(*states[i : i + 2])]
    return states[0]


def same(a, b):
    return all(a[k] == b[k] or abs(a[k] - b[k]) < 1e-12 for k in a if k != "kind") and a["kind"] == b["kind"]


def test_a_line_as_long_as_a_text():
    r = random.Random(9)
    words = ["".join(r.choice("abdeilnorst") for _ in range(r.randint(2, 9))) for _ in range(400)]
    prose = " ".join(r.choice(words) + r.choice(["", "", "", ",", ".", ". The"]) for _ in range(150_000))
    noise = "".join(r.choice("abcdefghij") for _ in range(200_000))
    texts = [prose[:1_000_000], noise, "ha " * 60_000, "x" * 150_000, "a line\n" + prose[:90_000] + "\n\n- " + prose[:30_000] + "\nend", ("word " * 40 + noise[:9000] + " ") * 9]
    for text in texts:
        whole = quality.figures(quality.close(quality.count(text)))
        for n in (1, 3, 40, 200):
            states = pieces_of(text, r, n)
            left = in_any_order(states, random.Random(0))
            assert same(quality.figures(quality.close(left)), whole)
            total = states[0]
            for s in states[1:]:
                total = quality.merge(total, s)
                assert max(len(x) for p in (total.head, total.tail) if p for x in (p.left, p.right)) <= 3 * quality.REACH
            assert same(quality.figures(quality.close(total)), whole)
    assert quality.figures(quality.close(quality.count(texts[1])))["kind"] == quality.figures(quality.close(quality.count(texts[3])))["kind"] == "junk"


def test_counts_of_whole_texts_as_of_states():
    texts = [*CASES, "a\rb\x85c\u2028d", "Ünïcödé wörds—and “quotes” … 12·5 €", "x " * 3000, "Ã© Ã¼ â€ \ufffd", "id=1; at=2\n\tk: v, w: x\n" * 5, "o'neill-smith it’s a_b c--d"] * 2
    table = quality.whole(texts)
    for text, row in zip(texts, table.to_dict("records"), strict=True):
        assert same(row, quality.figures(quality.close(quality.count(text)))), text[:50]


def test_counts_as_by_plain_python():
    text = "1. The baker, the guitar & <b>bread</b>.\nAna: one two  three; 12 ab12cd\n\n- (x) done! Yes"
    f = quality.figures(quality.close(quality.count(text)))
    assert (f["lines"], f["words"]) == (3, 17) and f["marked_share"] == 2 / 3 and f["speaker_share"] == 1 / 3 and f["ended_share"] == 1 / 3
    visible = sum(not c.isspace() for c in text)
    assert f["letter_ratio"] == sum(c.isalpha() for c in text) / visible and f["digit_ratio"] == sum(c.isdigit() for c in text) / visible and f["tag_share"] == 7 / visible and f["hex_share"] == 8 / visible
