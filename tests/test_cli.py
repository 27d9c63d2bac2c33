"""Files converted by the command line, and as a stream."""

from docframe.cli import main


def test_files_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.html").write_text("<h1>A</h1>")
    (source / "b.csv").write_text("x,y\n1,2\n")
    (source / "c").write_text("?")
    main(["--in", str(source), "--out", str(tmp_path / "out"), "--to", "markdown"], spark)
    got = {r.path.rsplit("/", 1)[1]: (bytes(r.output or b""), r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.html": (b"# A\n", None), "b.csv": (b"| x | y |\n| --- | --- |\n| 1 | 2 |\n", None), "c": (b"", "unknown document format")}
    stream = ["--in", str(source), "--out", str(tmp_path / "streamed"), "--to", "text", "--stream", str(tmp_path / "checkpoint")]
    main(stream, spark)
    (source / "d.md").write_text("*d*\n")
    main(stream, spark)
    rows = spark.read.parquet(str(tmp_path / "streamed")).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows) == ["a.html", "b.csv", "c", "d.md"]
    assert {bytes(r.output) for r in rows if r.path.endswith(("a.html", "d.md"))} == {b"A\n", b"d\n"}
