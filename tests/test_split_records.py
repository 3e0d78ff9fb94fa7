"""Files read in many small splits, against Python's own parsers."""

import csv
import json
import random

import pytest

from regionscore.sources import readers as RD
from regionscore.sources import split_records as SR


@pytest.fixture()
def small_splits(spark):
    """Splits of about 199 bytes."""
    for k, v in (("spark.sql.files.maxPartitionBytes", "199"), ("spark.sql.files.openCostInBytes", "0"), ("spark.sql.files.minPartitionNum", "1")):
        spark.conf.set(k, v)
    yield spark
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(k)


def entries():
    rng = random.Random(4)
    bits = ['"', "\\", "}", "{", "{}", "}}", "\n", "é", "\\\\", '\\"', "plain words", ",", ":", "[", "]", "\u2028", "𝔘", "/"]
    out = {}
    for i in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        out[f"u{i}{rng.choice(bits)}"] = {"summary": text, "n": i, "inner": {"a": text[::-1], "b": [{"c": text}, {}]}}
    return out


@pytest.mark.parametrize("indent,ascii_", [(None, True), (None, False), (2, False), (0, True)])
def test_json_object_equals_loads(small_splits, tmp_path, indent, ascii_):
    data = entries()
    p = tmp_path / "all.json"
    p.write_text(json.dumps(data, indent=indent, ensure_ascii=ascii_) + "\n", encoding="utf-8")
    kind = "struct<summary:string,n:int,inner:struct<a:string,b:array<struct<c:string>>>>"
    got = SR.read_json_object(small_splits, str(p), kind)
    assert SR.pieces(small_splits, str(p), "}").select("split").distinct().count() > 10
    found = {r.url: r for r in got.collect()}
    assert found.keys() == data.keys()
    for k, v in data.items():
        assert (found[k].summary, found[k].n, found[k].inner.a) == (v["summary"], v["n"], v["inner"]["a"])
        assert [x.c for x in found[k].inner.b] == [v["inner"]["b"][0]["c"], None]


@pytest.mark.parametrize("text", ['{}', ' { } \n', '{"a": {}}', '{"a":{"n":1},"b":{"n":2},"a":{"n":3}}', '{"x": null, "a": {"n": 1}, "z": {"n": 5}}',
                                  '\ufeff{"a": {"n": 7}}', '{"a": {"s": "}"}, "b": {"s": "{\\"}"}}'])
def test_small_objects(spark, tmp_path, text):
    p = tmp_path / "o.json"
    p.write_text(text, encoding="utf-8")
    got = {r.key: (r.n, r.s) for r in SR.read_json_object(spark, str(p), "struct<n:int,s:string>", "key").collect()}
    assert got == {k: ((v or {}).get("n"), (v or {}).get("s")) for k, v in json.loads(text.lstrip("\ufeff")).items()}


def test_several_files_and_broken_ones(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.json").write_text(json.dumps({f"k{i}{j}": {"n": j} for j in range(5)}))
    assert SR.read_json_object(spark, str(tmp_path), "struct<n:int>").count() == 15
    (tmp_path / "f1.json").write_text('{"a": {"n": 1}, "b": {"n": ')
    with pytest.raises(Exception, match="MALFORMED|JSON"):
        SR.read_json_object(spark, str(tmp_path), "struct<n:int>").collect()


TRICKY = ["plain", "two\nlines", 'quo"te', "comma, tab\t", "crlf\r\nend", "", "ਊĀ一", "\u0a0a\u0100\u010a\u0a00", "éÿ", '"', "\u0a22\u2200"]


@pytest.mark.parametrize("encoding,spark_name", [("utf-8", "UTF-8"), ("utf-16-le", "UTF-16LE"), ("utf-16-be", "UTF-16BE"), ("latin-1", "ISO-8859-1")])
def test_csv_records_in_splits(small_splits, tmp_path, encoding, spark_name):
    rng = random.Random(6)
    rows = [[str(i), *(rng.choice(TRICKY) for _ in range(2))] for i in range(60)]
    if encoding == "latin-1":
        rows = [[x if x.isascii() or x == "éÿ" else "x" for x in r] for r in rows]
    p = tmp_path / "t.csv"
    with open(p, "w", encoding=encoding, newline="") as f:
        if encoding.startswith("utf-16"):
            f.write("\ufeff")
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "Natural\nGas", " b  c"])
        w.writerows(rows)
    got = SR.read_csv_records(small_splits, str(p), ",", spark_name)
    assert got.columns == ["id", "Natural Gas", "b c", "source_file"]
    assert SR.pieces(small_splits, str(p), "\n").select("split").distinct().count() > 3
    assert sorted(([r[0], r[1] or "", r[2] or ""] for r in got.collect()), key=lambda r: int(r[0])) == rows


def test_formats_are_told_and_read(spark, tmp_path):
    data = {"utf-8": "id,name\n1,é — ”\n", "latin-1": "id,name\n1,éÿ\n", "cp1252": "id,name\n1,“é”\n", "utf-16": "id\tname\n1\t한 é\n"}
    for enc, text in data.items():
        (tmp_path / f"{enc}.csv").write_bytes(text.encode(enc))
    (tmp_path / "undefined.csv").write_bytes(b"id,name\n1,\x81\xe9\n")  # no character of cp1252
    found = {r.path.rsplit("/")[-1]: (r.encoding, r.sep) for r in RD.detect_format(spark, str(tmp_path)).collect()}
    assert found == {"utf-8.csv": ("utf-8", ","), "latin-1.csv": ("latin-1", ","), "cp1252.csv": ("cp1252", ","),
                     "utf-16.csv": ("UTF-16LE", "\t"), "undefined.csv": ("latin-1", ",")}
    paths = [str(tmp_path / f"{e}.csv") for e in data]
    got = RD.read_union(spark, paths, ["id", "name"], [found[f"{e}.csv"] for e in data])
    assert sorted(r.name for r in got.collect()) == sorted(t.split("\n")[1][2:] for t in data.values())
