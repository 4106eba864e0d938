import numpy as np
import pytest

from squigspark.__main__ import main
from squigspark.schemas import READ
from squigspark.sources import container


def test_eval(spark, tmp_path, capsys):
    (tmp_path / "a.paf").write_text("r\t100\t1\t90\t+\tt\t500\t100\t200\t50\t60\t60\ttp:A:P\n")
    assert main(["eval", str(tmp_path / "a.paf"), str(tmp_path / "a.paf"), "--secondary", "no"]) == 0
    out = capsys.readouterr().out
    assert "Correct\t1\t100.00%" in out and "60\t1\t0" in out


def test_events_and_segments(spark, tmp_path, capsys):
    container.register(spark)
    x = np.repeat([80, 100, 70, 110, 90, 60], 10) + np.tile([-1, 0, 1, 0, 0], 12)
    rows = [("a", 0, 1.0, 0.0, 1.0, 4000.0, len(x), [int(v) for v in x])]
    spark.createDataFrame(rows, READ).coalesce(1).write.format("signal").mode("append").save(str(tmp_path / "r"))
    assert main(["events", str(tmp_path / "r")]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert {"0", "10", "20", "30", "40", "50"} <= {s.split("\t")[1] for s in lines} and lines[0].startswith("a\t0\t")
    assert main(["segments", str(tmp_path / "r")]) == 0
    assert capsys.readouterr().out.startswith("a\t0\t")


def test_bad_calls(spark):
    with pytest.raises(SystemExit):
        main(["nothing"])
    with pytest.raises(SystemExit):
        main(["map", "a.fa"])
