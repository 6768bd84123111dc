import zipfile
from types import SimpleNamespace

import __spark_entry__
from ionquill.shipping import ship


def test_ships_once_and_only_where_needed(monkeypatch):
    sent = []
    spark = SimpleNamespace(sparkContext=SimpleNamespace(addPyFile=sent.append))
    ship(spark)  # the tests' workers have the folder on their path
    assert not sent
    monkeypatch.setenv("PYTHONPATH", "/elsewhere")
    ship(spark)
    ship(spark)
    assert len(sent) == 1
    names = zipfile.ZipFile(sent[0]).namelist()
    assert "ionquill/__init__.py" in names and "ionquill/functions/arrays.py" in names and not any("__pycache__" in n for n in names)


def test_entry(spark, tmp_path):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "q_spectral_angle" in queries
