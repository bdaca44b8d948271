from pointfold.sources import report


def test_lines_are_saved_in_order(spark, tmp_path):
    rows = [(f, p) for f in range(40) for p in range(f % 4 + 1)]
    df = spark.createDataFrame(rows, "frame long, label long").repartition(5)
    report.save(df, str(tmp_path / "out"))
    got = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert got == [report.HEADER] + ["".join(f"{p};" for p in range(f % 4 + 1)) + f",{f % 4 + 1}," for f in range(40)]
    report.save(df.limit(0), str(tmp_path / "out"), "overwrite")
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == report.HEADER + "\n"
