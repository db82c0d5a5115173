"""Readers on small files."""

import json
import sqlite3

import pytest

from strandline.sources import readers


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("source_file", "line_no").collect()]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_whatsapp_localised(spark, tmp_path):
    text = (
        "﻿13/8/25, 9:38 p. m. - Los mensajes y las llamadas están cifrados: nadie más\n13/8/25, 9:39 p. m. - Ana: primera\nsigue aquí\n"
        "13/8/25, 9:40 p. m. - Luis: hola\n13/8/25, 9:41 p. m. - Ana: <Multimedia omitido>\n13/8/25, 9:42 p. m. - Luis cambió algo\nhuérfana\n13/8/25, 9:43 p. m. - Ana: fin\n"
    )
    path = write(tmp_path / "chat.txt", text)
    got = rows(readers.whatsapp(spark, path, "ana"), "role", "sender", "content", "timestamp")
    assert got == [("assistant", "Ana", "primera\nsigue aquí", "2025-08-13T21:39:00"), ("user", "Luis", "hola", "2025-08-13T21:40:00"), ("assistant", "Ana", "fin", "2025-08-13T21:43:00")]
    assert readers.whatsapp_rejected(spark, path).first()["rejected"] == 2
    assert readers.detect(spark, path) == "whatsapp"


def test_whatsapp_forms_and_exact_persona(spark, tmp_path):
    path = write(tmp_path / "c.txt", "[8/13/25, 9:38:05 AM] Sam: one\n[8/13/25, 9:38:07 PM] Samantha: two: three\n99/99/25, 10:00 - Sam: odd\n")
    assert rows(readers.whatsapp(spark, path, "Sam", exact=True), "role", "content", "timestamp") == [("assistant", "one", "2025-08-13T09:38:05"), ("user", "two: three", "2025-08-13T21:38:07"), ("assistant", "odd", "99/99/25, 10:00")]


def test_telegram(spark, tmp_path):
    data = {"chats": {"list": [{"name": "c", "messages": [{"from": "Ana", "text": ["a ", {"type": "bold", "text": "b"}], "date": "2024-01-01T10:00:00"}, {"from": None, "from_id": "u1", "text": "x"}, {"from": "Ana", "text": "  "}]}]}}
    path = write(tmp_path / "result.json", json.dumps(data))
    assert rows(readers.telegram(spark, path, "Ana"), "role", "sender", "content", "timestamp") == [("assistant", "Ana", "a b", "2024-01-01T10:00:00"), ("user", "u1", "x", None)]
    assert readers.detect(spark, path) == "telegram"


def test_signal(spark, tmp_path):
    path = write(tmp_path / "s.json", json.dumps([{"sender": "Ana", "body": " hi ", "timestamp": 1700000000123}, {"source": "Bo", "text": "yo", "timestamp": 1700000000}, {"sender": "Ana", "body": ""}]))
    assert rows(readers.signal(spark, path, "an"), "role", "sender", "content", "timestamp") == [("assistant", "Ana", "hi", "2023-11-14T22:13:20.123000"), ("user", "Bo", "yo", "2023-11-14T22:13:20")]
    assert readers.detect(spark, path) == "signal"


def test_imessage(spark, tmp_path):
    path = tmp_path / "chat.db"
    c = sqlite3.connect(path)
    c.executescript("create table handle(id text); create table message(text text, is_from_me int, date int, handle_id int); insert into handle values ('+1'); insert into message values ('b', 0, 2000000000000000000, 1), ('a', 1, 1000000000, 0), ('', 0, 5, 1), (null, 0, 6, 1);")
    c.commit()
    c.close()
    assert rows(readers.imessage(spark, str(path), "Me"), "role", "sender", "content", "timestamp") == [("assistant", "Me", "a", "2001-01-01T00:00:01"), ("user", "+1", "b", "2064-05-18T03:33:20")]


def test_social(spark, tmp_path):
    tweets = [{"tweet": {"full_text": "hello https://t.co/x there", "created_at": "Wed Oct 10 20:19:24 +0000 2012", "id_str": "1", "in_reply_to_screen_name": "bo"}}, {"tweet": {"full_text": "RT @a b"}}, {"text": "quote", "quoted_status_id_str": "9"}]
    write(tmp_path / "t/data/tweets.js", "window.YTD = " + json.dumps(tweets))
    write(tmp_path / "t/data/direct-messages.js", "x = " + json.dumps([{"dmConversation": {"messages": [{"messageCreate": {"text": " dm ", "senderId": "5", "createdAt": "2020"}}]}}]))
    got = readers.read(spark, str(tmp_path / "t")).orderBy("source_file", "line_no").collect()
    assert [(r["content"], r["timestamp"]) for r in got] == [("dm", "2020"), ("hello  there", "2012-10-10T20:19:24+00:00"), ("quote", None)]
    assert got[1]["metadata"]["is_reply"] == "true" and got[2]["metadata"]["is_quote"] == "true"
    write(tmp_path / "i/content/posts_1.json", json.dumps([{"media": [{"title": "a", "creation_timestamp": 1600000000}, {"title": ""}]}, {"caption": "b"}]))
    write(tmp_path / "i/messages/inbox/bo_1/message_1.json", json.dumps({"messages": [{"content": "hey", "sender_name": "Ana B", "timestamp_ms": 1600000000000}]}))
    got = readers.read(spark, str(tmp_path / "i"), "ana").collect()
    assert sorted((r["role"], r["content"], r["timestamp"]) for r in got) == [("assistant", "a", "2020-09-13T12:26:40"), ("assistant", "b", None), ("assistant", "hey", "2020-09-13T12:26:40")]


def test_markdown_directory(spark, tmp_path):
    body = "A body of more than twenty characters with [[link|shown]] and [[other]]."
    write(tmp_path / "v/note.md", f"---\ndate: 2024-05-01\ntags: [a, 'b']\n---\n{body}")
    write(tmp_path / "v/2020-01-02 day.md", body)
    write(tmp_path / "v/.hidden/x.md", body)
    write(tmp_path / "v/skip/x.md", body)
    write(tmp_path / "v/short.md", "short")
    write(tmp_path / "v/.gitignore", "# no\nskip/\n")
    write(tmp_path / "v/.raw/note.json", '{"k": 1}')
    got = {r["source_file"]: r for r in readers.markdown(spark, str(tmp_path / "v")).collect()}
    assert sorted(got) == ["2020-01-02 day.md", "note.md"]
    note = got["note.md"]
    assert note["content"] == "A body of more than twenty characters with shown and other." and note["timestamp"] == "2024-05-01"
    assert json.loads(note["metadata"]["tags"]) == ["a", "b"] and note["metadata"]["raw_data"] == '{"k": 1}' and note["source_type"] == "gbrain-export"
    assert [r["source_file"] for r in readers.markdown(spark, str(tmp_path / "v"), since="2023-01-01").collect()] == ["note.md"]
    assert [r["source_type"] for r in readers.read(spark, write(tmp_path / "one.md", body)).collect()] == ["markdown"]


def test_text_csv_json(spark, tmp_path):
    assert rows(readers.read(spark, write(tmp_path / "a.txt", "short\n\n" + "long enough paragraph here\n\n\nanother paragraph of text")), "content") == [("long enough paragraph here",), ("another paragraph of text",)]
    assert rows(readers.read(spark, write(tmp_path / "a.csv", 'Sender;Text;Date\nAna;"x; y";2020\nBo; ;2021\nBo;z;2022\n'), "ana"), "role", "content", "timestamp") == [("assistant", "x; y", "2020"), ("user", "z", "2022")]
    lines = ['{"role": "human", "text": "q", "ts": 1600000000, "n": 5}', "broken", "", '{"speaker": null, "content": "a"}', '{"role": "bot", "content": null, "text": "lost"}', '{"from": "Ana", "message": 7}']
    got = readers.read(spark, write(tmp_path / "a.jsonl", "\n".join(lines)), "ana").orderBy("line_no").collect()
    assert [(r["role"], r["content"], r["timestamp"]) for r in got] == [("user", "q", "2020-09-13T12:26:40"), ("assistant", "a", None), ("assistant", "7", None)]
    assert got[0]["metadata"] == {"n": "5"}
    assert rows(readers.read(spark, write(tmp_path / "m.json", '{"memories": [{"id": "1", "memory": "m", "date": "2020"}, 5]}'), "Ana"), "role", "content", "source_type") == [("assistant", "m", "gbrain")]
    assert rows(readers.read(spark, write(tmp_path / "l.json", '[{"role": "user", "content": "u"}, 3]')), "role", "content") == [("user", "u")]


def test_unknown(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read(spark, write(tmp_path / "a.xyz", "x"))
