import numpy as np
import pytest

from gridloom import __main__ as cli


def test_flags_of_a_file(spark, tmp_path):
    r = np.random.default_rng(1)
    z = r.normal(size=(40, 6)) + 1j * r.normal(size=(40, 6))
    z[11, 2] = 99
    np.save(tmp_path / "a.npy", z)
    assert cli.main([f"{tmp_path}/a.npy", "--windows", "0", "--flags", f"{tmp_path}/out"]) == pytest.approx(100 / 240)
    found = spark.read.parquet(f"{tmp_path}/out").filter("flag").collect()
    assert [(x["channel"], x["baseline"]) for x in found] == [(11, 2)]


def test_generated_data(spark):
    assert 0 <= cli.main(["--preset", "small"]) < 1
    assert cli.baselines(7) == 112
    assert 0 <= cli.main(["--times", "6", "--channels", "24", "--antennas", "1"]) < 60
