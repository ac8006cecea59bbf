"""Readers align files by name, tell json lines from documents, and decode raw messages."""
import base64
import json

import pytest

from mailsift.sources.readers import read_dataframe, read_parquet_dataset
from mailsift.sources.writers import message_bodies


def _rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_csv_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,one\n")
    (tmp_path / "b.csv").write_text("y,x,z\ntwo,2,+\n")
    (tmp_path / "c d+.csv").write_text("x\n3\n4\n")
    (tmp_path / "empty.csv").write_text("")
    assert _rows(read_dataframe(spark, f"{tmp_path}/*.csv"), "x", "y", "z") == [
        ("1", "one", None), ("2", "two", "+"), ("3", None, None), ("4", None, None)]
    assert read_dataframe(spark, f"{tmp_path}/*.csv", max_records_per_file=1).count() == 3


def test_json_lines_arrays_and_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(json.dumps({"a": i, "m": {"b": "x"}}) + "\n" for i in range(3)))
    (tmp_path / "b.json").write_text(json.dumps([{"a": 3}, {"a": 4, "c": True}], indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"a": 5}, indent=2))
    (tmp_path / "d.json").write_text(json.dumps([{"a": 6}, {"a": 7}]))
    got = _rows(read_dataframe(spark, f"{tmp_path}/*.json"), "a", "`m.b`", "c")
    assert got == [(i, "x" if i < 3 else None, True if i == 4 else None) for i in range(8)]


def test_parquet_columns_are_merged_and_other_files_raise(spark, tmp_path):
    spark.createDataFrame([(1,)], "x int").write.mode("append").parquet(f"{tmp_path}/p")
    spark.createDataFrame([("b", 2)], "y string, x int").write.mode("append").parquet(f"{tmp_path}/p")
    assert _rows(read_dataframe(spark, f"{tmp_path}/p/*.parquet"), "x", "y") == [(1, None), (2, "b")]
    assert read_parquet_dataset(spark, f"{tmp_path}/p").count() == 2
    (tmp_path / "p" / "note.txt").write_text("x")
    with pytest.raises(TypeError):
        read_parquet_dataset(spark, f"{tmp_path}/p")


def test_message_bodies(spark):
    text = "Grüße\r\n\r\nzweite = Zeile"
    b64 = base64.b64encode(text.encode()).decode()
    raws = ["Subject: a\n\n" + text, "Subject: a\r\n\r\n" + text, "\n" + text,
            "Subject: a\nContent-Transfer-Encoding: BASE64\n\n" + b64,
            "Content-Transfer-Encoding: quoted-printable\n\nGr=C3=BC=C3=9Fe\r\n\r\nzweite =3D Z=\neile",
            f"Content-Type:\n multipart/mixed; boundary=q\n\npre\n--q\nContent-Transfer-Encoding: base64\n\n{b64}\n--q\n\nx\n--q--\n"]
    df = spark.createDataFrame([*((i, r) for i, r in enumerate(raws)), (90, None), (91, "Subject: a"), (92, ""),
                                (93, "Subject: a\n\ncontent-type: multipart/mixed")], "i int, raw string")
    got = {r.i: r.body for r in message_bodies(df).collect()}
    assert got == {**{i: text for i in range(len(raws))}, 90: None, 91: "", 92: "", 93: "content-type: multipart/mixed"}
