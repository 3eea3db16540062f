import pytest

from tallyfold.errors import DelimitedParseError, EncodingDetectionError, HeaderDetectionError
from tallyfold.plans.engine import Engine


def test_large_as_small(spark, tmp_path):
    text = "Id,Name,Amount\n" + "".join(f'{i},"n, ""{i % 7}""",{i}.25\n' + ("\n" if i % 50 == 0 else "") for i in range(4000)) + "4000,short\n"
    (tmp_path / "x.csv").write_text(text)
    e = Engine(spark, str(tmp_path / "store"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # many splits
    try:
        large = e.ingest_large(str(tmp_path / "x.csv"), ",")
        assert e.ingest_large(str(tmp_path / "x.csv"), ",") == {"status": "already_loaded", "file_id": large["file_id"]}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    small = e.ingest(str(tmp_path / "x.csv"))
    assert large["rows"] == small["rows"] == 4001 and small["routing"] == "attached_existing"
    assert e.dataset(large["file_id"]).orderBy("src_row").collect() == e.dataset(small["file_id"]).orderBy("src_row").collect()
    assert e.columns(large["file_id"]) == e.columns(small["file_id"])
    assert not list((tmp_path / "store" / "staging").iterdir())


def test_folder_and_errors(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    for name, text in (("p1.csv", "A,B\n1,x\n2,y\n"), ("p2.csv", "A,B\n3,z\n")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    r = e.ingest_large(str(tmp_path / "in"), ",")
    assert [tuple(x) for x in e.dataset(r["file_id"]).orderBy("src_row").collect()] == [(1, 1, "x"), (2, 2, "y"), (3, 3, "z")]
    (tmp_path / "in" / "p3.csv").write_text("A,C\n4,z\n")
    with pytest.raises(HeaderDetectionError):
        e.ingest_large(str(tmp_path / "in"), ",")
    for name, content, error in (("long.csv", b"A,B\n1,2,3\n", DelimitedParseError), ("open.csv", b'A,B\n1,"2\n', DelimitedParseError), ("enc.csv", b"A,B\n1,\xc1\xe8\n", EncodingDetectionError), ("none.csv", b"", HeaderDetectionError)):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(error):
            e.ingest_large(str(tmp_path / name), ",")
    (tmp_path / "head.csv").write_text("A,B\n")
    assert e.ingest_large(str(tmp_path / "head.csv"), ",", "head")["rows"] == 0
