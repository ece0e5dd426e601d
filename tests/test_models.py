"""The library of leakage models."""

import numpy as np
import pytest

from tracewright.model import TRACE_SCHEMA
from tracewright.operators import cpa
from tracewright.sources import models


def test_models_are_listed_saved_read_and_deleted(tmp_path):
    folder = str(tmp_path / "models")
    assert models.list_models(folder) == []
    assert not models.delete_model(folder, "weight")
    assert models.save_model(folder, "weight", cpa.MODEL_TEMPLATE) == "weight"
    assert models.save_model(folder, "  a model/ü.1 ", "x = 1\r\n# é") == "a_model___1"
    (tmp_path / "models" / "notes.txt").write_text("no model")
    assert models.list_models(folder) == ["a_model___1", "weight"]
    assert models.model_source(folder, "a model/ü.1").splitlines() == ["x = 1", "# é"]
    models.save_model(folder, "a_model___1", "def get_leakages(data, h):\n    return data[:, 0] * h\n")
    assert models.load_model(folder, "a_model___1")(np.array([[3]], np.uint8), 2).tolist() == [6]
    assert models.delete_model(folder, "a_model___1")
    assert models.list_models(folder) == ["weight"]
    assert sorted(p.name for p in (tmp_path / "models").iterdir()) == ["notes.txt", "weight.py"]


@pytest.mark.parametrize("name", ["", " \t"])
def test_a_blank_name_is_an_error(tmp_path, name):
    with pytest.raises(ValueError, match="name"):
        models.save_model(str(tmp_path), name, "")


def test_names_cannot_leave_the_folder(tmp_path):
    models.save_model(str(tmp_path / "models"), "../out", "")
    assert [p.name for p in tmp_path.iterdir()] == ["models"]
    with pytest.raises(FileNotFoundError):
        models.model_source(str(tmp_path / "models"), "out")


def test_a_stored_text_that_is_no_model_is_an_error_when_loaded(tmp_path):
    models.save_model(str(tmp_path), "none", "x = 1")
    with pytest.raises(ValueError, match="get_leakages"):
        models.load_model(str(tmp_path), "none")


def test_a_stored_model_runs_on_executors(spark, tmp_path):
    models.save_model(str(tmp_path), "weight", cpa.MODEL_TEMPLATE)
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 64, dtype=np.uint8)
    rows = [(i, [float(bin(int(v) ^ 5).count("1"))], bytearray([int(v)])) for i, v in enumerate(data)]
    traces = spark.createDataFrame(rows, TRACE_SCHEMA)
    best = max(cpa.cpa_user_model(traces, models.load_model(str(tmp_path), "weight"), 8).collect(), key=lambda r: r["corr"])
    assert best.hypothesis == 5 and best["corr"] == pytest.approx(1.0, abs=1e-6)
