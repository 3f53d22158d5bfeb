"""Readers and writers on files."""

import hashlib

from lucidtext.sources import readers, sinks


def test_fixture_files(spark, tmp_path):
    (tmp_path / "genitiv").mkdir()
    (tmp_path / "genitiv" / "flag_1.txt").write_text("# expected: flag\n# description: Genitiv\n\nDas Dach des Hauses.\n")
    (tmp_path / "genitiv" / "readme.md").write_text("no fixture")
    (row,) = readers.fixtures(spark, str(tmp_path)).collect()
    assert (row.rule, row.name, row.expected, row.description, row.text) == ("genitiv", "flag_1", "flag", "Genitiv", "Das Dach des Hauses.")


def test_tolerant_records(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    assert sorted(r.a for r in readers.tolerant_jsonl(spark, str(tmp_path / "r.jsonl"), "a int").collect()) == [1, 2]


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert readers.json_array(spark, str(tmp_path / "a.json"), "a int").count() == 2


def test_append_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    sinks.append_jsonl(df, str(tmp_path / "log"))
    sinks.append_jsonl(df, str(tmp_path / "log"))
    assert readers.jsonl(spark, str(tmp_path / "log"), "id int, t string").count() == 2


def test_checksums(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(b"abc")
    manifest = spark.createDataFrame([("m.bin", hashlib.sha256(b"abc").hexdigest()), ("gone.bin", "0")], "name string, sha256 string")
    assert {r.name: r.ok for r in readers.verified(spark, str(tmp_path), manifest).collect()} == {"m.bin": True, "gone.bin": False}


def test_cleaned_corpus(spark, tmp_path):
    sinks.cleaned_corpus(spark.createDataFrame([("Straße  \u201eja\u201c",), ("  ",)], "value string"), str(tmp_path / "c"))
    assert [r.value for r in readers.line_corpus(spark, str(tmp_path / "c")).collect()] == ['Strasse "ja"']
