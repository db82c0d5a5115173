"""What says something."""

from pyspark.sql import functions as F

from strandline.functions.text import clean_role, says_something

NOTHING = [None, "", " ", "​", "‎\n\t ", " ", "<Media omitted>", " IMAGEN omitida‎", "sticker  omitido\n", "﻿", "⠀"]
SOMETHING = ["a", "…", "<Media omitted> x", "*<Media omitted>*", "video omitido hoy", " . ", "x" * 100_000, "\n" * 5000 + "x"]


def test_says_something(make):
    rows = make("id int, t string", *[{"id": i, "t": t} for i, t in enumerate(NOTHING + SOMETHING)])
    got = {r["id"]: r["s"] for r in rows.select("id", says_something(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(got))] == [False] * len(NOTHING) + [True] * len(SOMETHING)


def test_roles(make):
    rows = make("t string", {"t": " User "}, {"t": None}, {"t": "ASSISTANT"})
    assert [r[0] for r in rows.select(clean_role(F.col("t"))).collect()] == ["user", None, "assistant"]
