"""Command line end to end; streams."""

import json

from strataline import cli
from strataline.streaming import tail
from tests.test_operators import REPORT


def test_build_query_analyze(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.txt").write_text("\n".join(REPORT))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert cli.main(["query", out, "--pattern", "anr"], spark) == 1 and "run build first" in capsys.readouterr().err
    assert cli.main(["build", src, out], spark) == 0 and "built" in capsys.readouterr().out
    assert cli.main(["build", src, out], spark) == 0 and "--force" in capsys.readouterr().out
    assert cli.main(["query", out, "--name", "q", "--pattern", "ANR"], spark) == 0 and "q: 2 results in 1 pages" in capsys.readouterr().out
    assert cli.main(["query", out, "--pattern", "(", "--type", "regex"], spark) == 1
    assert cli.main(["query", out], spark) == 1
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"name": "s", "type": "section", "pattern": "memory info"}, {"name": "none", "pattern": "zzz"}]}))
    capsys.readouterr()
    assert cli.main(["analyze", src, out, "--config", str(tmp_path / "q.json")], spark) == 0
    assert capsys.readouterr().out.strip() == "s: 4 results in 1 pages"
    files = tmp_path / "files"
    assert cli.main(["query", out, "--name", "q", "--pattern", "ANR", "--files", str(files)], spark) == 0
    assert {p.name for p in files.rglob("*.json")} == {"part_1.json", "result.json", "metadata.json"}
    assert cli.main(["query", out, "--name", "one", "--pattern", "ANR", "--single-file", "--files", str(files)], spark) == 0
    assert len(json.loads((files / "one" / "result.json").read_text())["results"]) == 2


def test_interactive(spark, tmp_path, capsys):
    (tmp_path / "r.txt").write_text("\n".join(REPORT))
    cli.build(spark, str(tmp_path / "r.txt"), str(tmp_path / "out"))
    words = iter(["crash", ""])
    cli._interactive(spark, str(tmp_path / "out"), lambda _: next(words))
    assert "com.example crash" in capsys.readouterr().out


def stream(spark, tmp_path, rows):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"report_id": 1, "line_number": i, "content": c, "ts": t}) for i, c, t in rows))
    return tail.read_lines(spark, str(src))


def run(df, name, mode="complete"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_keyword_rate(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, "an ANR", "2024-01-01T10:00:05Z"), (1, "an ANR", "2024-01-01T10:00:05Z"), (2, "anr crash", "2024-01-01T10:00:30Z"), (3, "crash", "2024-01-01T10:02:00Z"), (4, "=" * 30, "2024-01-01T10:02:01Z")])
    got = sorted((k, str(a)[11:16], n) for k, a, _, n in run(tail.keyword_rate(s, ["anr", "crash"]), "rates"))
    assert got == [("anr", "10:00", 2), ("crash", "10:00", 1), ("crash", "10:02", 1)]
    assert len(run(tail.markers(s), "marks", "append")) == 1


def test_sessions(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, "a", "2024-01-01T10:00:00Z"), (2, "b", "2024-01-01T10:01:00Z"), (3, "c", "2024-01-01T11:00:00Z")])
    assert sorted(r[3] for r in run(tail.quiet_spells(s), "spells")) == [1, 2]
