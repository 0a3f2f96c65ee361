import pytest
from pyspark.sql import functions as F

from tidemark.__main__ import main, parser


def test_options():
    args = parser().parse_args(["panel", "--raw-dir", "r", "--interim-dir", "i", "--timed"])
    assert args.which == "timed"
    everything = parser().parse_args(["all", "--example", "--interim-dir", "i", "--skip-experiments"])
    assert everything.seed == [1, 2, 3, 4, 5] and everything.skip_experiments and everything.runs is None and not everything.raw_dir
    with pytest.raises(SystemExit):
        parser().parse_args(["panel", "--interim-dir", "i"])
    with pytest.raises(SystemExit):
        parser().parse_args(["panel", "--raw-dir", "r", "--interim-dir", "i", "--timed", "--snapshot"])
    with pytest.raises(SystemExit):
        parser().parse_args(["experiments", "--interim-dir", "i", "--setting", "unknown"])


def test_experiments_from_written_sets(spark, tmp_path, capsys):
    rows = [(k, k % 2, float(k % 2) + (k % 7) / 5, float(k % 5), "ab"[k % 2] if k % 3 else "c") for k in range(120)]
    frame = spark.createDataFrame(rows, "CompanyID long, target int, N_Deal double, Percent_Females double, HQCountry string")
    for name in ("controlled", "leakboth"):
        frame.write.parquet(str(tmp_path / name))
    main(["experiments", "--interim-dir", str(tmp_path), "--setting", "no_team", "--model", "dt", "--seed", "1"], spark)
    assert '"setting": "no_team"' in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "predictions")).select("tag").distinct().collect()[0].tag == "no_team"


def test_runs_are_drawn_and_groups_fitted_apart(spark, tmp_path, capsys):
    rows = [(k, k % 2, float(k % 2) + (k % 7) / 5, float(k % 5) if k % 9 else None, "ab"[k % 2] if k % 3 else "c") for k in range(120)]
    frame = spark.createDataFrame(rows, "CompanyID long, target int, N_Deal double, Percent_Females double, HQCountry string")
    for name in ("controlled", "leakboth"):
        frame.write.parquet(str(tmp_path / name))
    main(["experiments", "--interim-dir", str(tmp_path), "--setting", "controlled", "--model", "lr", "dt", "--seed", "1", "2", "--grouped", "HQCountry", "--fit", "scale", "--runs", "1"], spark)
    assert '"setting": "controlled_scale-HQCountry"' in capsys.readouterr().out
    runs = spark.read.parquet(str(tmp_path / "predictions")).select("tag", "model", "seed").distinct().collect()
    assert len(runs) == 1 and runs[0].tag == "controlled_scale-HQCountry"


def test_panel_of_the_example(spark, tmp_path):
    """The tables written are those that the panel is built from, by rules of a file."""
    main(["tables", "--raw-dir", str(tmp_path / "raw")], spark)
    names = sorted(p.name for p in (tmp_path / "raw").iterdir())
    assert len(names) == 14 and "Fund.csv" in names
    assert spark.read.option("header", True).csv(str(tmp_path / "raw" / "Fund.csv")).columns == ["FundID", "Vintage"]
    (tmp_path / "rules.yaml").write_text("first_year: 2008\npanel:\n  venture_types: [Seed Round]\n")
    main(["panel", "--raw-dir", str(tmp_path / "raw"), "--interim-dir", str(tmp_path), "--timed", "--one-line", "--rules", str(tmp_path / "rules.yaml")], spark)
    found = spark.read.parquet(str(tmp_path / "panel_timed")).agg(F.min("YearFounded"), F.count(F.lit(1))).first()
    assert tuple(found) == (2010, 4)
