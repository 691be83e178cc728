import io
import json
import zipfile

from quillmark.sources import files, hits, tasks, transcripts
from quillmark.sources.registry import SOURCES, read_all


def line(kind, uid, sid, content, **more):
    return {"type": kind, "uuid": uid, "sessionId": sid, "timestamp": f"2024-03-01T10:00:{len(uid):02d}Z", "message": {"role": kind, "content": content}, **more}


def write_lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_transcripts(spark, tmp_path):
    top = tmp_path / "p" / "s-1.jsonl"
    launch = [{"type": "tool_result", "tool_use_id": "call-9", "content": [{"type": "text", "text": "agentId: wrong"}]}]
    write_lines(top, [
        line("user", "old", "s-0", "copied from before"),
        line("user", "u1", "s-1", "hello", cwd="/w", gitBranch="main"),
        "", "{broken", "[1]",
        line("assistant", "u22", "s-1", [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "call-9", "name": "Agent", "input": {"p": "q"}}], parentUuid="u1"),
        line("user", "u333", "s-1", launch, toolUseResult={"agentId": "a7"}),
        {"type": "weird", "uuid": "u4444", "sessionId": "s-1"},
    ])
    write_lines(tmp_path / "p" / "s-1" / "subagents" / "agent-a7.jsonl", [line("user", "k1", "s-1", "do it", isSidechain=True, agentType="explore")])
    sessions, observations, faults = transcripts.entities(transcripts.read_lines(spark, str(tmp_path)))
    got = {r["session_id"]: r.asDict() for r in sessions.collect()}
    assert set(got) == {"s-1", "s-1:a7"}
    assert got["s-1"]["cwd"] == "/w" and got["s-1"]["kind"] == "session"
    assert got["s-1:a7"]["root_session_id"] == "s-1" and got["s-1:a7"]["spawned_by_tool_use_id"] == "call-9" and got["s-1:a7"]["agent_type"] == "explore"
    rows = {r["obs_id"]: r.asDict() for r in observations.collect()}
    assert set(rows) == {"u1", "u22", "u333", "k1"}
    assert (rows["u22"]["type"], rows["u22"]["tool_name"], rows["u22"]["body"]) == ("tool_use", "Agent", "hm")
    assert rows["u333"]["type"] == "tool_result" and rows["k1"]["provenance"] == "agent" and rows["u1"]["provenance"] == "human"
    told = sorted((r["lineno"] or 0, r["reason"]) for r in faults.collect())
    assert told == [(0, "1 lines without a time"), (4, "corrupt JSON"), (5, "not an object")]


def test_node_map_export(spark, tmp_path):
    node = lambda parent, role, parts, **m: {"parent": parent, "message": {"author": {"role": role, **m}, "content": {"parts": parts}, "create_time": 1700000000.5}}
    chat = {"conversation_id": "c1", "create_time": 1700000000, "update_time": 1700000100, "mapping": {
        "r": {"parent": None, "message": None}, "n1": node("r", "user", ["hi", {"content_type": "image"}]), "n2": node("n1", "assistant", [""]), "n3": node("n2", "tool", [], name="py"), "n4": node("n1", "assistant", ["yes"]),
    }}
    (tmp_path / "conversations.json").write_text(json.dumps([chat, {"title": "no id"}]))
    made = SOURCES["chatgpt"].read(spark, str(tmp_path))
    rows = {r["obs_id"]: r.asDict() for r in made["observations"].collect()}
    assert set(rows) == {"chatgpt:n1", "chatgpt:n3", "chatgpt:n4"}
    assert rows["chatgpt:n1"]["body"] == "hi\n[non-text part: image]" and rows["chatgpt:n1"]["parent_obs_id"] is None
    assert rows["chatgpt:n4"]["parent_obs_id"] == "chatgpt:n1" and rows["chatgpt:n3"]["parent_obs_id"] is None and rows["chatgpt:n3"]["tool_name"] == "py"
    assert made["sessions"].count() == 1 and made["faults"].count() == 1


def test_message_list_export_in_a_zip(spark, tmp_path):
    blocks = [{"type": "text", "text": "a"}, {"type": "thinking", "thinking": "b"}, {"type": "tool_use", "id": "t1", "name": "find", "input": {"q": 1}}, {"type": "odd"}]
    chat = {"uuid": "c9", "created_at": "2024-01-01T00:00:00.123456Z", "updated_at": "2024-01-02T00:00:00Z", "chat_messages": [
        {"uuid": "m1", "sender": "human", "text": "top", "created_at": "2024-01-01T00:00:01Z", "parent_message_uuid": "00000000-0000-4000-8000-000000000000", "content": []},
        {"uuid": "m2", "sender": "assistant", "text": "x", "created_at": "2024-01-01T00:00:02Z", "parent_message_uuid": "m1", "content": blocks},
    ]}
    with zipfile.ZipFile(tmp_path / "export.zip", "w") as z:
        z.writestr("conversations.json", json.dumps([chat]))
    made = SOURCES["claude-web"].read(spark, str(tmp_path))
    rows = {r["obs_id"]: r.asDict() for r in made["observations"].collect()}
    assert set(rows) == {"claude-web:m1", "claude-web:m2", "claude-web:m2:b2"}
    assert rows["claude-web:m1"]["body"] == "top" and rows["claude-web:m1"]["parent_obs_id"] is None and rows["claude-web:m1"]["type"] == "user"
    assert rows["claude-web:m2"]["body"] == "a\n\nb" and rows["claude-web:m2:b2"]["tool_name"] == "find" and rows["claude-web:m2:b2"]["parent_obs_id"] == "claude-web:m2"


def test_hits(spark):
    pr = {"number": 5, "title": "T" * 300, "state": "open", "repository_url": "https://api.x/repos/acme/api", "body": None, "updated_at": "2024-01-01T00:00:00Z", "user": {"login": "u"}, "_checks": {"summary": "passing"}}
    issue = {"number": 6, "state": "closed", "html_url": "https://github.com/acme/web/issues/6", "assignees": [{"login": "v"}]}
    frame = lambda *xs: spark.createDataFrame([(json.dumps(x),) for x in xs], "raw string")
    good, bad = hits.all_endpoints({"pr": frame(pr, {"number": 1}), "assigned": frame(issue)})
    rows = {r["stable_id"]: r.asDict() for r in good.collect()}
    assert rows["github:acme/api:5"]["tags"] == ["acme/api", "pr", "open"] and len(rows["github:acme/api:5"]["subject"]) == 280
    assert rows["github:acme/web:6"]["tags"] == ["acme/web", "issue", "closed", "assigned"] and json.loads(rows["github:acme/web:6"]["extra"])["assignees"] == ["v"]
    assert bad.count() == 1 and "body_excerpt" not in rows["github:acme/api:5"]["extra"]


CSV = '﻿"Date: 2024"\n"a\nb"\n"Folder Name","List Name","Title","Tags","Content","Priority","Status","Created Time","Completed Time","Due Date","taskId"\n' + "".join(
    f'"F","L","{t}","x, y","c","{p}","{s}","2024-01-01T00:00:00+0000","{d}","","{i}"\n' for t, p, s, d, i in (("One", 5, 0, "", 1), ("", 2, 2, "2024-02-01T00:00:00+0000", 2), ("Lost", 0, 0, "", ""), ("Odd", 0, 7, "", 3))
)


def test_task_backup(spark, tmp_path):
    (tmp_path / "b.csv").write_text(CSV, encoding="utf-8")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    made = SOURCES["ticktick"].read(spark, str(tmp_path))
    rows = {r["stable_id"]: r.asDict() for r in made["records"].collect()}
    assert set(rows) == {"ticktick:1", "ticktick:2", "ticktick:3"}
    assert rows["ticktick:1"]["tags"] == ["x", "y", "L", "F", "open"] and json.loads(rows["ticktick:1"]["extra"])["priority"] == "high"
    assert rows["ticktick:2"]["subject"] == "2" and rows["ticktick:2"]["updated_at"].month == 2 and rows["ticktick:3"]["tags"][-1] == "status-unrecognised"
    assert [r["reason"] for r in made["faults"].collect()] == ["1 rows without an id"]


def test_task_api(spark):
    task = {"id": 7, "title": " Do ", "content": "c", "desc": "", "items": [{"title": "one"}, {"title": ""}], "tags": ["t"], "priority": 1, "status": 2, "createdTime": "2024-01-01T00:00:00.000+0000", "dueDate": "2024-05-01T02:00:00.000+0200"}
    frame = spark.createDataFrame([(json.dumps(task), "P"), (json.dumps({"id": None}), None), ("5", None)], "raw string, project_name string")
    good, bad = tasks.api_records(frame)
    row = good.first().asDict()
    assert row["stable_id"] == "ticktick:7" and row["subject"] == "Do" and row["body"] == "c\n- one" and row["tags"] == ["t", "P", "completed"]
    assert json.loads(row["extra"])["due_date"] == "2024-05-01T00:00:00+0000" and bad.count() == 2


def test_posts(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "posts.zip", "w") as z:
        z.writestr("posts/12.second-order.html", "<p>short</p>")
        z.writestr("posts/13.x.html", f"<h1>Long</h1><p>{'word ' * 100}</p>")
        z.writestr("posts/13.opens.csv", "a")
        z.writestr("posts.csv", "a")
    rows = {r["stable_id"]: r.asDict() for r in SOURCES["substack"].read(spark, str(tmp_path))["records"].collect()}
    assert rows["substack:12"]["subject"] == "Second Order" and "stub" in rows["substack:12"]["tags"]
    assert rows["substack:13"]["subject"] == "Long" and "stub" not in rows["substack:13"]["tags"]


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_tree_and_reports(spark, tmp_path):
    for name, data in {"a/n.md": b"x\n# Head\n", "a/b/w.docx": docx("Word text"), "t.txt": b"z" * 200_010, ".git/c.md": b"no", "node_modules/d.md": b"no", "e.png": b"no", "bad.docx": b"no zip", "f.pdf": b"%PDF"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    records, faults = files.tree_records(files.scan_tree(spark, str(tmp_path)))
    rows = {r["stable_id"]: r.asDict() for r in records.collect()}
    assert set(rows) == {"dropbox:a/n.md", "dropbox:a/b/w.docx", "dropbox:t.txt"}
    assert rows["dropbox:a/n.md"]["subject"] == "Head" and rows["dropbox:a/n.md"]["tags"] == ["a", "md"] and rows["dropbox:a/b/w.docx"]["body"] == "Word text"
    assert len(rows["dropbox:t.txt"]["body"]) == 200_000 and json.loads(rows["dropbox:t.txt"]["extra"])["truncated"] is True
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in faults.collect()) == ["bad.docx", "f.pdf"]
    reports = tmp_path / "reports"
    (reports / "_quarantine").mkdir(parents=True)
    (reports / "r1.md").write_text("# Report\nbody")
    (reports / "_quarantine" / "r2.md").write_text("# Never")
    assert [r["subject"] for r in files.report_records(spark, str(reports), "research").collect()] == ["Report"]


def test_a_source_that_fails_leaves_the_others(spark, tmp_path):
    (tmp_path / "r.md").write_text("# R")
    made, failed = read_all(spark, {"research": str(tmp_path), "nothing": "x"})
    assert set(made) == {"research"} and set(failed) == {"nothing"}
    assert files.newest_input(spark.createDataFrame([], "modified timestamp")).first()["newest"] is None


def test_backups_are_put_together_from_lines(spark):
    """As the csv module reads the whole file: stray quotes, quoted ends of lines, commas and quotes, in splits of two lines."""
    import csv
    import io

    from pyspark.sql import functions as F

    text = '﻿Date: 5" wide, "x\n\n"Title","taskId","Content","Status"\n"a ""q"", b","1","one\ntwo, ""\n"",""\nthree","0"\nplain 6" b,2,x "y" z,2\n"lost","","",""\n\n"open\n",3,"",0\n"d",4\n'
    rows = list(csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")))[3:]
    want = sorted((r[1], r[0], r[2] if len(r) > 2 else None) for r in rows if r and r[1])
    assert len(want) == 4
    whole = spark.createDataFrame([("/b", text)], "path string, value string").withColumn("modified", F.lit("2024-01-01").cast("timestamp"))
    lines = whole.select("path", "modified", F.posexplode(F.split("value", "\n")).alias("at", "raw")).withColumn("split", F.floor(F.col("at") / 2))
    for files_ in (whole, lines):
        got = tasks.parse_backups(files_).collect()
        assert sorted((r["taskid"], r["title"], r["content"]) for r in got) == want and {r["lost"] for r in got} == {1}
