"""An archive from import to export."""

import json

import pytest

from strandline.dataset import Dataset, choose
from strandline.operators import retrieval
from strandline.operators.context import ContextError
from strandline.operators.corrections import CorrectionError
from strandline.sources import sinks

CHAT = """1/2/24, 10:00 - Ana: hola, me gusta el café solo por la mañana
1/2/24, 10:01 - Luis Paz: ¿qué tal?
1/2/24, 10:02 - Ana: hablé con mi amiga Carla ayer
1/2/24, 10:03 - Luis Paz: bien, escribe a a@b.com
1/2/24, 10:04 - Ana: listo
"""


def test_whole_way(spark, tmp_path):
    source = tmp_path / "chat.txt"
    source.write_text(CHAT, encoding="utf-8")
    d = Dataset(spark, f"file://{tmp_path}/root", "ana", "Ana")
    assert d.preview(str(source)) == {"new": 5, "senders": {"Ana": 3, "Luis Paz": 2}, "personal_data": {"email": 1}, "equivalent": []}
    d.create("Ana")
    d.add(str(source))
    d.add(str(source))
    assert d.table("messages").count() == 5 and d.diagnose()["status"] == "healthy"
    edges = {(r["subject"], r["type"], r["object"]) for r in d.effective().collect()}
    assert {("Ana", "communicates_with", "Luis Paz"), ("Carla", "friend_of", "Ana")} <= edges and ("Luis Paz", "participant_in", "ana") in edges
    told = d.ask("¿Qué café le gusta a Ana?", "ana")
    assert not told["abstained"] and len(told["citations"]) == 1
    assert d.ask("¿Qué música prefiere Ana?", "Ana")["abstained"]
    with pytest.raises(CorrectionError):
        d.correct("Luis is Carla's cousin, not her boss")
    done = d.correct("Carla is Ana's cousin, not her friend")
    assert done["appended"] and not d.correct("Carla is Ana's cousin, not her friend")["appended"]
    after = {(r["subject"], r["type"], r["object"]) for r in d.effective().collect()}
    assert ("Carla", "cousin_of", "Ana") in after and ("Carla", "friend_of", "Ana") not in after
    assert d.undo(done["claim_id"]) and not d.undo(done["claim_id"])
    assert ("Carla", "friend_of", "Ana") in {(r["subject"], r["type"], r["object"]) for r in d.effective().collect()}
    with pytest.raises(ValueError):
        d.export(f"{tmp_path}/out")
    figures = d.export(f"{tmp_path}/out", "redact")
    assert figures["user_turns"] == figures["assistant_turns"] == 2 and figures["version"] == "v1"
    assert json.loads(spark.read.text(f"{tmp_path}/out/v1/conversations").first()[0])["role"] == "user"
    assert d.export(f"{tmp_path}/out", "allow")["version"] == "v2" and [h["version"] for h in d.metadata()["export_history"]] == ["v1", "v2"]
    # Once undone, a correction may be made again, once; another one of the same claim may not.
    again = d.correct("Carla is Ana's cousin, not her friend")
    assert again["appended"] and not d.correct("Carla is Ana's cousin, not her friend")["appended"]
    with pytest.raises(CorrectionError):
        d.correct("Carla is Ana's sister, not her friend")
    answer = d.ask("¿Carla es prima o friend?", "Ana")
    assert answer["citations"][:1] == [f"correction:{again['claim_id']}"]
    seen = {}

    def provider(question, participant, evidence, context_, language):
        seen.update(context_)
        return retrieval.Worded("x", ["nowhere"])

    with pytest.raises(retrieval.GroundingError):
        d.ask("¿Qué café le gusta a Ana?", "Ana", provider=provider)
    assert seen["identity_type"] == "persona" and "cousin_of" in seen["relationship_types"]
    assert d.ask("¿Qué café le gusta a Ana?", "Ana", provider=lambda *a: retrieval.Worded("", [], abstained=True))["reason"] == "provider_abstained"


def test_context_pages_and_checks(spark, tmp_path):
    (tmp_path / "chat.txt").write_text(CHAT, encoding="utf-8")
    d = Dataset(spark, f"file://{tmp_path}/root", "ana", "Ana")
    d.create("Ana")
    d.add(str(tmp_path / "chat.txt"))
    assert choose(spark, f"file://{tmp_path}/root") == "ana"
    (tmp_path / "identity_aliases.json").write_text('{"canonical": {"Luis Paz": ["Lucho"]}}', encoding="utf-8")
    (tmp_path / "root/ana/identity_aliases.json").write_text('{"canonical": {"Luis Paz": ["Lucho"]}}', encoding="utf-8")
    note = tmp_path / "note.txt"
    note.write_text("Fact: Lucho vive en Lima\n\nAna toca el piano\n\nnota: Ana toca el piano", encoding="utf-8")
    shown = d.preview_context(str(note))
    assert [(r["kind"], r["subject"], r["duplicate"]) for r in shown["records"].orderBy("number").collect()] == [("assertion", "Luis Paz", False), ("freeform", "Ana", False), ("freeform", "Ana", True)]
    assert shown["kinds"] == {"assertion": 1, "freeform": 1}
    assert d.add_context(shown) == {"stored": 2, "duplicates": 1} and d.table("messages").count() == 7
    assert d.add_context(d.preview_context(str(note)))["stored"] == 0
    note.write_text("Nadie conocido", encoding="utf-8")
    with pytest.raises(ContextError):
        d.add_context(shown)
    with pytest.raises(ContextError):
        d.preview_context(str(note))
    assert d.preview_context(str(note), "ana")["kinds"] == {"freeform": 1}
    note.write_bytes(b"\xff\xfe\x00")
    with pytest.raises(ContextError):
        d.preview_context(str(note))
    assert d.build_pages() == {"persona": "Ana", "pages": 6}
    d.build_pages()
    log = sinks.read_text(spark, f"{d.path}/wiki/_changelog.md")
    assert log.count("| rebuilt |") == 1 and "chat.txt" in log and "| identity |" in sinks.read_text(spark, f"{d.path}/wiki/_evidence.md")
    assert not [r for r in d.lint() if r["type"] == "broken_link"]
    checks = d.smoke()["checks"]
    assert checks["names"] == checks["paths"] == checks["messages"] == checks["pairs"] == "passed"
    copy = tmp_path / "copy.txt"
    copy.write_text(CHAT.replace("Ana: listo", "Ana: listo ya") + "1/2/24, 10:09 - Ana: hola  otra vez\n", encoding="utf-8")
    kept = d.keep_only("chat.txt")
    assert kept["quarantined"] == ["note.txt"] and d.sources().where("status = 'quarantined'").count() == 1
    assert d.metadata()["stats"]["total_messages"] == 5
