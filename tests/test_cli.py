"""The command line: options, output paths, and whole runs."""

import json
import zipfile

import pytest

from tamis import cli
from tamis.operators import sampling
from tamis.sources import tables


def parsed(*args):
    return cli.parser().parse_args(list(args))


def test_defaults_and_options():
    a = parsed("reduce", "-i", "data.csv", "-t", "target")
    assert (a.missing_threshold, a.correlation_threshold, a.gini_threshold, a.gini_bins, a.infer_schema_length, a.no_confirm, a.manual, a.drop_columns) == (0.3, 0.4, 0.05, 10, 10_000, False, False, ())
    a = parsed("reduce", "--input", "d.csv", "--target", "t", "--missing-threshold", "0.0", "--correlation-threshold", "1.0", "--gini-threshold", "0.1", "--gini-bins", "20", "--infer-schema-length", "0", "--drop-columns", "id, timestamp,uuid", "--manual", "--no-confirm", "--no-use-solver")
    assert (a.missing_threshold, a.correlation_threshold, a.gini_threshold, a.gini_bins, a.infer_schema_length, a.manual, a.no_confirm, a.use_solver) == (0.0, 1.0, 0.1, 20, 0, True, True, False)
    assert a.drop_columns == ("id", "timestamp", "uuid")
    assert parsed("reduce", "-i", "d.csv", "-t", "t", "-o", "out.parquet").output == "out.parquet"


def test_output_paths():
    for path, want in (("/path/to/data.csv", "/path/to/data_reduced.csv"), ("./rel/data.parquet", "./rel/data_reduced.parquet"), ("/a/b.sas7bdat", "/a/b_reduced.parquet")):
        assert tables.output_path(path, "reduced") == want
    assert tables.output_path("/data/my.csv", "gini_analysis", "json") == "/data/my_gini_analysis.json"


def test_sizes():
    assert sampling.parsed_sizes("North:100,South:50") == {"North": 100, "South": 50} and sampling.parsed_sizes("") == {}
    for bad in ("North", "North:x", "North:-1", "a:1:2"):
        with pytest.raises(ValueError, match="Invalid stratum spec"):
            sampling.parsed_sizes(bad)


def test_reduce_sample_and_convert(spark, tmp_path, capsys):
    path = tmp_path / "data.csv"
    path.write_text("target,good,same,text\n" + "".join(f"{i % 2},{i % 2 * 10 + i * 0.1:.1f},{i % 2 * 20 + i * 0.2:.1f},t{i % 3}\n" for i in range(60)))
    cli.main(["reduce", "-i", str(path), "-t", "target", "--correlation-threshold", "0.99", "--single-file"])
    out = capsys.readouterr().out
    assert "features before: 4" in out
    assert (tmp_path / "data_reduced.csv").is_file()
    with zipfile.ZipFile(tmp_path / "data_reduced_reduction_report.zip") as z:
        assert json.loads(z.read("data_reduced_reduction_report.json"))["summary"]["initial_features"] == 4
    assert {"good", "same"} - set(tables.read(spark, str(tmp_path / "data_reduced.csv")).columns) in ({"good"}, {"same"})
    cli.main(["sample", str(path), "-m", "stratified", "--strata-column", "text", "--strata-sizes", "t0:5,t1:2", "-o", str(tmp_path / "s.parquet")])
    assert sorted(r.sampling_weight for r in spark.read.parquet(str(tmp_path / "s.parquet")).collect()) == [4.0] * 5 + [10.0] * 2
    cli.main(["sample", str(path), "-n", "7", "--single-file"])
    assert tables.read(spark, str(tmp_path / "data_sampled.csv")).count() == 7
    cli.main(["convert", str(path)])
    assert capsys.readouterr().out.strip().endswith("data.parquet")
    for bad in (["sample", str(path), "-n", "1", "-f", "0.5"], ["sample", str(path), "-m", "equal", "-n", "1"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
