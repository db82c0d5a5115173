"""Reference operators on small literal inputs, and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import context, corrections, dialogue, extract, governance, graph, messages, ordered, profiles, resolve, retrieval, wiki


def test_source_equivalence(make):
    rows = [{"source": "a", "fp": f"m{i}"} for i in range(100)] + [{"source": "b", "fp": f"m{i}"} for i in range(98)] + [{"source": "b", "fp": f"n{i}"} for i in range(2)]
    rows += [{"source": "c", "fp": x} for x in "xyz"] + [{"source": "d", "fp": x} for x in "xyz"] + [{"source": "e", "fp": x} for x in "xyzz"] + [{"source": "e", "fp": None}]
    got = {(r["a"], r["b"]): (r["overlap"], r["equivalent"]) for r in messages.equivalent_sources(make("source string, fp string", *rows)).collect()}
    assert got == {("a", "b"): (98, True), ("c", "d"): (3, True), ("c", "e"): (3, False), ("d", "e"): (3, False)}


def test_runs_over_blocks_as_in_plain_python(spark):
    r = random.Random(3)
    data = [(g, i, r.choice("ab")) for g in ("hot", "x", None) for i in range(600 if g == "hot" else 20)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([x for x in data if x[0]], "g string, i int, v string")
        got = ordered.runs(df, ["g"], [F.col("i")], "v").orderBy("g", "i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ids, last = [], None
    for row in got:
        if (row["g"], row["v"]) != last:
            ids.append(row["run"])
        assert row["run"] == ids[-1]
        last = (row["g"], row["v"])
    assert len(set(ids)) == len(ids)


def test_dialogue(make):
    m = make("c int, n int, role string, content string", *[{"c": 1, "n": i, "role": a, "content": b} for i, (a, b) in enumerate([("assistant", "lost"), ("user", "q1"), ("user", " q2 "), ("assistant", "a1"), ("assistant", "a2"), ("user", ""), ("user", "late")])], {"c": 2, "n": 1, "role": "assistant", "content": "only"}, {"c": 3, "n": 1, "role": None, "content": None})
    got = [(r["turn"], r["role"], r["content"]) for r in dialogue.turns(m, ["c"], ["n"]).orderBy("c", "turn").collect()]
    assert got == [(0, "user", "q1\nq2"), (1, "assistant", "a1\na2")]
    assert dialogue.next_version([]) == "v1" and dialogue.next_version(["v1", "v7"]) == "v8" and dialogue.next_version(["v1", "final"]) == "v3"


def test_facts():
    f = lambda text, known=(), recent=None: extract.facts(text, extract.Known(known), recent)
    assert [m[:2] for m in f("Ayer hablé con Carla")[0]] == [("Carla", 0.90)]
    assert f("mi amiga Carla vino")[1] == [("Carla", "friend_of", 0.96)]
    assert f("el Lunes y Domingo")[0] == []
    assert [m[0] for m in f("vi a Juan Carlos Pérez López ayer")[0]] == []
    assert f("vi a Juan Carlos Pérez López ayer", ["Juan Pérez"])[0][0][:2] == ("Juan Pérez", 0.99)
    assert f("ella es mi jefa", recent="Carla")[1] == [("Carla", "reports_to", 0.84)]


def test_coreference_reaches_two_messages(make):
    said = lambda *texts: make("slug string, seq long, role string, sender string, content string", *[{"slug": "s", "seq": i, "role": "assistant", "sender": "Ana", "content": t} for i, t in enumerate(texts)])
    nobody = make("slug string, name string")
    relations = lambda m: [(r["name"], r["relation"]) for r in extract.extract(m, nobody).where("kind = 'relation'").collect()]
    assert relations(said("hablé con Carla", "bien", "ya", "ella es mi amiga")) == [("Carla", "friend_of")]
    assert relations(said("hablé con Carla", "bien", "ya", "va", "ella es mi amiga")) == []


def test_coreference_over_blocks_as_in_one_go(make, spark):
    r = random.Random(8)
    texts = ["hablé con Carla", "ella es mi amiga", "bien", "vi a Juan Paz ayer y ella es mi jefa", "ya", "told Boris about it"]
    data = [{"slug": "s", "seq": i, "role": "assistant", "sender": "Ana" if i % 7 else "Bo", "content": r.choice(texts)} for i in range(300)]
    want, state = set(), {}
    for x in data:
        at = state.get(x["sender"], (None, extract.REACH + 1))
        state[x["sender"]], (found, relations) = extract._step(at, x["content"], extract.Known(()))
        want |= {(x["seq"], "mention", n, None) for n, *_ in found} | {(x["seq"], "relation", n, rel) for n, rel, _ in relations}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        m = make("slug string, seq long, role string, sender string, content string", *data)
        got = {(x["seq"], x["kind"], x["name"], x["relation"]) for x in extract.extract(m, make("slug string, name string")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want and any(k == "relation" for _, k, *_ in got)


def test_evaluation(make):
    c = make("expected array<string>, actual array<string>", {"expected": ["A", "b"], "actual": ["a"]}, {"expected": None, "actual": ["x"]})
    r = extract.evaluate(c).first()
    assert (r["true_positive"], r["false_positive"], r["false_negative"], r["precision"], r["recall"]) == (1, 1, 1, 0.5, 0.5)
    assert extract.evaluate(c.limit(0)).first()["f1"] == 1.0


def plain_projection(base, records):
    same = lambda e, c: e[1] == c[1] and ({e[0], e[2]} == {c[0], c[2]} if c[1] in ("friend_of", "sibling_of") else (e[0], e[2]) == (c[0], c[2]))
    edges = list(base)
    for retract, asserted in records:
        edges = [e for e in edges if not same(e, retract) and not same(e, asserted)] + [asserted]
    return sorted(edges)


def test_effective_graph_as_a_loop(make):
    r = random.Random(1)
    claim = lambda: (r.choice("abc"), r.choice(["friend_of", "sibling_of", "parent_of"]), r.choice("abc"))
    for _ in range(4):
        base, records = sorted({claim() for _ in range(6)}), [(claim(), claim()) for _ in range(8)]
        b = make("subject string, type string, object string, confidence double", *[dict(zip(("subject", "type", "object"), e, strict=True)) for e in base])
        cols = "ord long, claim_id string, retract_subject string, retract_predicate string, retract_object string, assert_subject string, assert_predicate string, assert_object string"
        c = make(cols, *[dict(zip([x.split()[0] for x in cols.split(", ")], (i, f"c{i}", *x, *y), strict=True)) for i, (x, y) in enumerate(records, 1)])
        assert sorted((e["subject"], e["type"], e["object"]) for e in graph.effective(b, c).collect()) == plain_projection(base, records)


def test_paths(make):
    e = make("subject string, object string", *[{"subject": a, "object": b} for a, b in ("ab", "bc", "cd", "ae", "ed", "xy", "aa")])
    chain = make("subject string, object string", *[{"subject": f"n{i:02d}", "object": f"n{i + 1:02d}"} for i in range(20)])
    assert graph.path(chain, "n00", "n20") == [f"n{i:02d}" for i in range(21)]
    assert graph.path(e, "a", "d") == ["a", "e", "d"] and graph.path(e, "a", "x") is None and graph.path(e, "q", "a") is None


def test_merge_keeps_best_and_first(make):
    e = make("slug string, subject string, object string, type string, confidence double, source string, seq long", *[{"slug": "s", "subject": a, "object": b, "type": "t", "confidence": c, "source": d, "seq": i} for i, (a, b, c, d) in enumerate([("A", "b", 0.5, "x"), ("a ", "B", 0.9, "y"), ("a", "b", 0.9, "z"), ("q", "Q", 1.0, "loop")])])
    assert [(r["source"], r["confidence"]) for r in graph.merge_edges(e, ["slug"], "seq").collect()] == [("y", 0.9)]


def test_resolution_tiers(make):
    q = make("query string", *[{"query": x} for x in ("abdair", "ana", "CARLA", "nick", "zoe", "an", "")])
    e = make("name string", *[{"name": x} for x in ("Abdair Coca", "abdair-e2e", "Ana Paz", "Ana Ruiz", "Carla", "Luisa")])
    a = make("name string, alias string", {"name": "Luisa", "alias": "Nick"})
    got = {r["query"]: (r["entity"], r["tier"], r["matches"]) for r in resolve.resolve(q, e, a).collect()}
    assert got["abdair"] == ("Abdair Coca", 3, 1) and got["ana"] == (None, 3, 2) and got["CARLA"] == ("Carla", 1, 1) and got["nick"] == ("Luisa", 2, 1)
    assert got["zoe"] == (None, None, 0) and got["an"] == (None, 4, 2) and got[""] == (None, None, 0)


def test_greedy_budget_as_a_fold(make):
    r = random.Random(2)
    rows = [{"q": q, "at": i, "cost": r.randint(1, 60)} for q in range(5) for i in range(30)]
    got = {(x["q"], x["at"]) for x in retrieval.select_within(make("q int, at int, cost int", *rows), ["q"], [F.asc("at")], "cost", 100, 4).collect()}
    want = set()
    for q in range(5):
        used, kept = 0, 0
        for x in sorted((x for x in rows if x["q"] == q), key=lambda x: x["at"]):
            if kept < 4 and (kept == 0 or used + x["cost"] <= 100):
                want.add((q, x["at"]))
                used, kept = used + x["cost"], kept + 1
    assert got == want


def test_evidence_and_gates(make):
    stored = make("id string, message_id string, content string, sender string, timestamp string", {"id": "1", "message_id": "f:1", "content": "me gusta el café solo", "sender": "Ana"}, {"id": "x", "message_id": "f:2", "content": "no me gusta el café frío", "sender": "Ana", "timestamp": "t"}, {"id": "3", "message_id": "f:3", "content": "me gusta el café", "sender": "Bo"})
    hits = make("id string, content string, sender string, timestamp string, distance double", {"id": "1", "content": "me gusta el café solo", "sender": "ana", "distance": 0.1}, {"id": "2", "content": "no me gusta el café frío", "sender": "Ana", "timestamp": "t", "distance": 0.3}, {"id": "3", "content": "me gusta el café", "sender": "Bo", "distance": 0.0}, {"id": "9", "content": "nada", "sender": "Ana", "distance": 0.0})
    question = "¿Qué café le gusta a Ana?"
    e = retrieval.evidence(hits, stored, question, "Ana")
    assert [(r["message_id"], r["score"]) for r in e.orderBy("message_id").collect()] == [("f:1", 0.92), ("f:2", 0.76)]
    g = retrieval.gates(e, question, "Ana").first()
    assert g["supported"] and g["contradictory"]
    assert retrieval.answer(e, question, "Ana")["reason"] == "contradictory_evidence"
    one = e.where("message_id = 'f:1'")
    told = retrieval.answer(one, question, "Ana")
    assert not told["abstained"] and retrieval.valid_citations(told["text"], told["citations"], {"f:1"}) and not retrieval.valid_citations(told["text"], ["f:9"], {"f:1"})
    assert retrieval.answer(e.limit(0), question, "Ana")["reason"] == "insufficient_relevant_evidence"


def test_corrections(make, spark):
    assert corrections.parse(spark, "Carlos is Juan's cousin, not his brother.") == ("Carlos", "Juan", "sibling_of", "cousin_of")
    assert corrections.parse(spark, "Carlos no es hermano de Juan, es su primo") == ("Carlos", "Juan", "sibling_of", "cousin_of")
    for bad in ("", "Carlos likes Juan", "A is B's friend, not his amigo", "A is B's zebra, not his friend", "x" * 2001):
        with pytest.raises(corrections.CorrectionError):
            corrections.parse(spark, bad)
    df = corrections.parsed(make("t string", {"t": "Ana is Bo's  wife, not his colleague"}, {"t": "Ana no es cónyuge de Bo; es su jefa."}, {"t": "no"}, {"t": None}), "t")
    assert [(r["subject"], r["object"], r["old"], r["new"]) for r in df.collect()] == [("Ana", "Bo", "coworker_of", "spouse_of"), ("Ana", "Bo", "spouse_of", "manager_of"), (None,) * 4, (None,) * 4]


def test_context(make):
    c = context.classify(make("b string", {"b": "ASSERT: Ana vive aquí"}, {"b": "Inferencia: quizá"}, {"b": "sin prefijo: no"}, {"b": "Nota:"}), "b")
    assert [(r["kind"], r["confidence"], r["body"]) for r in c.collect()] == [("assertion", 1.0, "Ana vive aquí"), ("inference", 0.5, "quizá"), ("freeform", 0.75, "sin prefijo: no"), ("freeform", 0.75, None)]
    n = make("slug string, name string, alias string", {"slug": "s", "name": "Ana Paz", "alias": "Ana Paz"}, {"slug": "s", "name": "Ana Paz", "alias": "anita"}, {"slug": "s", "name": "Bo", "alias": "Bo"})
    b = make("slug string, id int, t string", {"slug": "s", "id": 1, "t": "habla ANÍTA, dijo"}, {"slug": "s", "id": 2, "t": "Bo y Ana Paz"}, {"slug": "s", "id": 3, "t": "Bot"}, {"slug": "s", "id": 4, "t": None})
    assert [(r["id"], r["subject"], r["named"]) for r in context.subjects(b, n, "id", "t", ["slug"]).orderBy("id").collect()] == [(1, "Ana Paz", 1), (2, None, 2), (3, None, 0), (4, None, 0)]


def test_mentions_broadcast_no_words(spark):
    # Spark takes a block as one row of its table's size, however many words it has, so it would broadcast them.
    b = spark.range(3).select(F.lit("x").alias("slug"), "id", F.concat(F.repeat(F.lit("palabra "), 50), F.when(F.col("id") == 0, "Ana Paz").otherwise("Luz")).alias("t"))
    n = spark.range(2).select(F.lit("x").alias("slug"), F.when(F.col("id") == 0, "Ana Paz").otherwise("Luz Rey").alias("name"), F.when(F.col("id") == 0, "Ana Paz").otherwise("Luz").alias("alias"))
    m = context.mentions(b, n, "id", "t", ["slug"])
    assert "Broadcast" not in m._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r)[1:] for r in m.collect()) == [(0, "Ana Paz"), (1, "Luz Rey"), (2, "Luz Rey")]


def test_name_variants(make):
    p = make("slug string, key string, identity_type string", {"slug": "s", "key": "alizon", "identity_type": "contact"})
    m = make("slug string, sender string, content string", *[{"slug": "s", "sender": "Bo", "content": "Alisita alisa Alisita"}], {"slug": "s", "sender": "alizona", "content": "alizona alizona"})
    assert [(r["key"], r["variant"]) for r in profiles.name_variants(p, m, ["slug"]).collect()] == [("alizon", "Alisita")]


def test_wiki(make):
    pages = make("page string, text string", {"page": "identity", "text": "# I\n\n## Content\nBorn in a small town by the sea. [L1:a-1] See [[voice]] and [[lost]].\n\n## Sources\n- x [L2]\n"}, {"page": "voice", "text": "(awaiting data ingestion)"}, {"page": "_contradictions", "text": "## A\nStatus: resolved\n## B\nStatus: unresolved\n"}, {"page": "_changelog", "text": "| a | b |\n|---|---|\n"})
    assert [(r["page"], r["title"]) for r in wiki.sections(pages).orderBy("page").collect() if not r["page"].startswith("_")] == [("identity", "Content")]
    assert [r["question"] for r in wiki.questions(wiki.sections(pages)).collect()] == ["Tell me about yourself."]
    kinds = {(r["type"], r["page"]) for r in wiki.lint(pages, make("source_file string", {"source_file": "zzz.jsonl"})).collect()}
    assert kinds == {("broken_link", "identity"), ("empty_page", "voice"), ("unresolved_contradictions", "_contradictions"), ("empty_changelog", "_changelog"), ("low_source_coverage", "")}
    assert wiki.unresolved(pages).first()["unresolved"] == 1
    assert [p["id"] for p in wiki.probes(pages, "Ana")] == ["name", "identity"]
    assert "## Identity" in wiki.profile(pages, "Ana")


def test_governance(make):
    e, s = make("id string, m string", {"id": "a", "m": "1"}, {"id": "b", "m": "1"}, {"id": "c"}), make("id string, m string", {"id": "b", "m": "2"}, {"id": "c"}, {"id": "d"})
    assert {(r["id"], r["state"]) for r in governance.vector_difference(e, s, ["m"]).collect()} == {("a", "missing"), ("b", "changed"), ("c", "same"), ("d", "stale")}
    assert {(r["id"], r["m"]) for r in governance.upsert(s, e).collect()} == {("a", "1"), ("b", "1"), ("c", None), ("d", None)}
    assert {r["id"] for r in governance.prune(s, e).collect()} == {"b", "c"}
    u, p = make("x int", {"x": 1}, {"x": 2}), make("message_count long", {"message_count": 2})
    checks = governance.invariants(u, p, make("id string", {"id": "a"}), 2)
    assert {(r["layer"], r["agrees"]) for r in checks.collect()} == {("messages", True), ("profiles", True), ("vectors", False), ("declared", True)}
    assert governance.diagnosis(checks).first()["status"] == "error"
    i = make("filename string, lines int", {"filename": "a", "lines": 1}, {"filename": "b", "lines": 2})
    assert {(r["filename"], r["status"]) for r in governance.quarantine(i, make("filename string", {"filename": "b"}), "dup").collect()} == {("a", "active"), ("b", "quarantined")}
    assert {(r["filename"], r["lines"]) for r in governance.restore(i.where("filename = 'a'"), make("filename string", {"filename": "b"}, {"filename": "z"}), i).collect()} == {("a", 1), ("b", 2), ("z", None)}


def test_sinks_and_stream(spark, make, tmp_path):
    from strandline.sources import sinks
    from strandline.streaming import ingest

    root = f"file://{tmp_path}/pub"
    sinks.publish({"t": make("x int", {"x": 1})}, root)
    sinks.publish({"t": make("x int", {"x": 2})}, root)
    assert [r["x"] for r in sinks.current(spark, root, "t").collect()] == [2]
    led = f"file://{tmp_path}/ledger"
    event = {"event_type": "correction", "claim_id": "c", "created_at": "2024-01-01T00:00:00Z", "fingerprint": "f"}
    assert sinks.append_event(spark, led, event) is None and sinks.append_event(spark, led, event, lambda: {"known": 1}) == {"known": 1}
    assert sinks.read_ledger(spark, led).count() == 1
    sinks.append_event(spark, led, {"event_type": "odd", "created_at": "2024"})
    with pytest.raises(ValueError):
        sinks.read_ledger(spark, led)
    with sinks.lock(spark, f"{led}/.lock"), pytest.raises(OSError), sinks.lock(spark, f"{led}/.lock"):
        pass
    schema = "seq long, role string, content string"
    source = f"{tmp_path}/in"
    make(schema, {"seq": 1, "role": "user", "content": "a"}, {"seq": 2, "role": "user", "content": "a"}).coalesce(1).write.parquet(source)
    target, check = f"file://{tmp_path}/out", f"{tmp_path}/check"
    ingest.ingest(ingest.read_stream(spark, schema, source), target, check, ["seq"])
    make(schema, {"seq": 3, "role": "user", "content": "a"}, {"seq": 4, "role": "user", "content": "b"}).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(ingest.read_stream(spark, schema, source), target, check, ["seq"])
    assert sorted(r["seq"] for r in spark.read.parquet(target).collect()) == [1, 4]


def test_backups_have_no_file_per_source(spark, tmp_path):
    from strandline.sources import sinks

    path = f"{tmp_path}/backup"
    said = lambda name, role: spark.range(500).select(F.format_string(f"{name}%s", "id").alias("source_file"), F.lit(1).alias("line_no"), F.lit(role).alias("role"), F.format_string("text\n %s", "id").alias("content"), F.lit(None).cast("string").alias("sender"))
    sinks.append_messages(said("=/ é", "user").repartition(2), path)
    sinks.append_messages(said("a", "user").repartition(2), path)
    files = [f for f in tmp_path.rglob("*.json*") if not f.name.startswith(".")]
    assert len(files) == 4
    (tmp_path / "backup/part-odd.json").write_text('{"role": "user", "cont\n')
    first = lambda: {(r["source_file"], r["role"], r["content"]) for r in sinks.stored_messages(spark, path).collect()}
    mine = {(f"=/ é{i}", "user", f"text\n {i}") for i in range(500)}
    assert first() == mine
    # One that was begun with a directory per source file is read whole.
    said("=/ è", "assistant").where("id < 3").write.mode("append").partitionBy("source_file").json(path)
    assert first() == mine | {(f"=/ è{i}", "assistant", f"text\n {i}") for i in range(3)}


def test_budget_sees_the_whole_group(make):
    rows = [{"q": 1, "at": i, "cost": c} for i, c in enumerate([300, *[200, 500, 101] * 60, 50, 51, 50])] + [{"q": 2, "at": i, "cost": c} for i, c in enumerate([900, 1])]
    got = retrieval.select_within(make("q int, at int, cost int", *rows), ["q"], [F.asc("at")], "cost", 400, 5).collect()
    assert {(x["q"], x["at"]) for x in got} == {(1, 0), (1, 181), (1, 183), (2, 0)}
