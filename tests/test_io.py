import json

import pytest

from veilspark.operators import scan
from veilspark.sources import readers, writers
from veilspark.streaming import scan as stream


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("card 4532 0151 1283 0366\n", encoding="utf-8")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00x")
    assert readers.text_files(spark, str(tmp_path / "a.txt")).first().text.startswith("card")
    with pytest.raises(Exception, match="UTF-8"):
        readers.text_files(spark, str(tmp_path / "b.bin")).collect()
    (tmp_path / "d.jsonl").write_text('{"text": "x", "spans": [[0, 1, "PERSON"]], "sensitivity": 1, "categories": []}\n\n')
    assert readers.json_lines(spark, str(tmp_path / "d.jsonl")).first().spans[0].kind == "PERSON"
    (tmp_path / "c.json").write_text(json.dumps({"tests": [{"id": "1", "text": "t", "expected": {"sensitivity": "low", "findings": [{"type": "email", "value": "v", "pii": True}]}}]}, indent=1))
    assert readers.corpus(spark, str(tmp_path / "c.json")).first().expected.findings[0].value == "v"
    (tmp_path / "t.json").write_text(json.dumps({"templates": [{"id": str(k), "lang": "en", "sensitivity": "low", "cell": "a" if k else "b", "text": "{P1} x"} for k in range(8)]}))
    pools = [r.pool for r in readers.templates(spark, str(tmp_path / "t.json")).orderBy("id").collect()]
    assert pools.count("valid") == 1 and pools[3] == "valid" and readers.templates(spark, str(tmp_path / "t.json"), skip_cells=("b",)).count() == 7
    (tmp_path / "bad.json").write_text(json.dumps({"templates": [{"id": "7", "lang": "en", "sensitivity": "low", "cell": "a", "text": "x"}]}))
    with pytest.raises(ValueError, match="7: no person placeholder"):
        readers.templates(spark, str(tmp_path / "bad.json"))
    (tmp_path / "torn.json").write_text("{")
    with pytest.raises(ValueError, match="not a file of templates"):
        readers.templates(spark, str(tmp_path / "torn.json"))
    report = scan.analyse(readers.standard_input(spark, 'API_TOKEN = "9f8e7d6c5b4a39281706f5e4d3c2b1a0aabbccdd"\n090-1234-5678'), id_col="source")
    lines = writers.report_lines(report).first().lines
    assert lines[0] == "stdin: sensitivity low" and lines[-1].startswith("  secret (") and " on line 1: 9f" in lines[-1] and "090-1234-5678" in lines[1]
    writers.write_json(report, str(tmp_path / "out"))
    one = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part*")))
    assert one["source"] == "stdin" and "number_type" not in one["findings"][0]
    writers.write_text(report, str(tmp_path / "txt"))


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.json").write_text(json.dumps({"source": str(k), "text": "card 4532 0151 1283 0366" if k else "nothing"}))
    q = stream.start(stream.report_stream(stream.text_stream(spark, str(folder), 1), show_values=True), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = {r.source: r.sensitivity.level for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"0": "none", "1": "high", "2": "high"}


def test_command_line(spark, tmp_path, capsys):
    from veilspark.__main__ import main

    (tmp_path / "a.txt").write_text("write to anna.keller@nordpost.de about card 4539 1488 0343 6467")
    (tmp_path / "b.txt").write_text("nothing here")
    assert main(["scan", str(tmp_path / "a.txt"), str(tmp_path / "b.txt"), "--fail-on", "high"]) == 2
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].endswith("a.txt: sensitivity high") and "  email: an…de" in lines and "  number (credit_card): 45…67" in lines and lines[-1].endswith("b.txt: sensitivity none")
    assert main(["scan", str(tmp_path / "b.txt"), "--json", "--show-values", "--fail-on", "low"]) == 0
    import json

    out = json.loads(capsys.readouterr().out)
    assert len(out) == 1 and out[0]["sensitivity"]["level"] == "none" and out[0]["source"].endswith("b.txt")
