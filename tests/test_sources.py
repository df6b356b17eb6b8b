"""Readers of index folders, streams and the entry point."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest

from trackline.functions import kernels
from trackline.sources import files, indexfolder, sinks
from trackline.streaming import online


@pytest.fixture()
def folder():
    top = tempfile.mkdtemp(prefix="spark-")
    os.makedirs(f"{top}/IDX")

    def put(name, text):
        with open(f"{top}/IDX/{name}", "w") as f:
            f.write(text)

    put("2020.csv", "Date,A1,B1,Z\n2020-12-30,1.5,x,0\nnot a date,9,9,9\n2020-12-31,2,3,0\n2020-12-29,0,0,0\n")
    put("2021.csv", "Date,A1,B1\n2020-12-31,5,\n2021-01-04,6,7\n")
    put("Compo.csv", "2020-10-01,id,w,,2021-01-01,id,w\nA,i1,0.5,,A,i1,0.2\nA,i1,0.1,,C,i3,bad\n,i2,0.4,,B,i2,0.8\n")
    put("Mapping.csv", "date,ticker,g,c\n2020-01-01,OLD,i1,c1\n2021-01-01,NEW,i1,c1\nbad,X,i9,c9\n")
    put("sector_mapping.csv", "t,s\nA,Energy\nA,Tech\nB,\n")
    put("Exclusions.csv", "ID_BB_COMPANY,TICKER,EST EXCLUS\nc1,T1,Oui\nc7,T7,1\nc8,T8,no\n")
    return top


def test_index_folder(spark, folder):
    got = files.load_index(spark, folder, "IDX", [2020, 2021])
    prices = {(r.date, r.asset): r.price for r in got["prices"].collect()}
    assert prices == {(dt.date(2020, 12, 30), "A1"): 1.5, (dt.date(2020, 12, 31), "A1"): 5.0, (dt.date(2020, 12, 31), "B1"): 3.0, (dt.date(2021, 1, 4), "A1"): 6.0, (dt.date(2021, 1, 4), "B1"): 7.0}
    weights = {(r.eff_date, r.ticker): r.weight for r in got["compositions"].collect()}
    assert weights == {(dt.date(2020, 10, 1), "A"): 0.6, (dt.date(2021, 1, 1), "A"): 0.2, (dt.date(2021, 1, 1), "B"): 0.8}
    assert {(r.asset, r.sector) for r in got["sectors"].collect()} == {("A", "Tech")}
    assert {r.asset for r in got["exclusions"].collect()} == {"NEW", "T7"}


def test_results_are_appended_and_read(spark):
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/summary"
    df = spark.createDataFrame([("m", 1)], "model string, seed int")
    assert sinks.read_or_empty(spark, path, df.schema).count() == 0
    sinks.append(df, path)
    sinks.append(df.selectExpr("'n' AS model", "seed"), path)
    assert {r.model for r in sinks.read_or_empty(spark, path, df.schema).collect()} == {"m", "n"}


def test_online_covariance_equals_the_steps(spark):
    x = np.random.default_rng(8).normal(size=(30, 3))
    top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    rows = spark.createDataFrame([("m", t, v.tolist()) for t, v in enumerate(x)], "model string, seq long, r array<double>")
    rows.coalesce(1).write.parquet(f"{top}/in")
    got = online.run_to_table(online.ewma_updates(spark.readStream.schema(rows.schema).parquet(f"{top}/in"), 3), f"{top}/run").orderBy("seq").collect()
    s = np.zeros((3, 3))
    for r, v in zip(got, x, strict=True):
        s = kernels.ewma_step(s, v, 0.94)
        assert np.isclose(r.trace, np.trace(s)) and np.isclose(r.frobenius, np.linalg.norm(s))


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 75
    if os.path.isdir(e.SMOKE_DIR):
        assert e.entry(spark).count() == 1


@pytest.fixture()
def tree(tmp_path):
    """Two indices: one with files of clashing names and endings and a mapping of its own, one with little."""

    def put(name, text):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write(text)

    put("Mapping.csv", "date,ticker,g,c\n2019-01-01,ROOT,i1,c1\n")
    put("A/Mapping.csv", "date,ticker,g,c\n2019-06-01,OLD,i1,c1\n2021-06-01,NEW,i1,c1\n2022-01-01,LATE,i2,c2\n")
    put("A/2020.csv", "Date,i1,i2,B\n2020-01-02,1,2,3\n2020-01-03,1.5,,4\n")
    put("A/2021.csv", "Date,i1,i3\n2021-01-04,5,6\n2021-01-04,5.5,\n")
    put("A/2022.xlsx", "no spreadsheet")
    put("A/2022.csv", "Date,i1\n2022-01-03,9\n")
    put("A/20222.csv", "Date,i1\n2022-01-03,9\n")
    put("A/notes.csv", "x\n1\n")
    put("A/2023/inner.csv", "x\n1\n")
    put("A/compo.csv", "2020-01-01,id,w\nWRONG,i1,1\n")
    put("A/Compo.csv", "2020-10-01,id,w,,2021-10-01,id,w\nX,i1,3,,X,i1,1\nOLD,i9,1,,Y,i8,1\n")
    put("A/sectors_mapping.csv", "t,s\nNEW,Second\n")
    put("A/sector_mapping.csv", "t,s\nNEW,First\n")
    put("B/2020.csv", "Date,i1\n2020-01-02,1\n")
    return str(tmp_path)


def test_files_are_found_by_name_and_ending(spark, tree):
    a = indexfolder.IndexFolder(spark, tree, "A", endings=("csv",))
    assert {(r.year, os.path.basename(r.path)) for r in a.year_files().collect()} == {(2020, "2020.csv"), (2021, "2021.csv"), (2022, "2022.csv")}
    assert os.path.basename(a.find("compositions")) == "Compo.csv" and os.path.basename(a.find("sectors")) == "sector_mapping.csv"
    assert a.find("exclusions", optional=True) is None and a.exclusions().collect() == []
    assert [r.sector for r in a.sectors().collect()] == ["First"]
    assert [r.sector for r in indexfolder.IndexFolder(spark, tree, "A", names={"sectors": "sectors_mapping.csv"}).sectors().collect()] == ["Second"]
    every = indexfolder.IndexFolder(spark, tree, "A")
    assert {os.path.basename(r.path) for r in every.year_files().collect()} == {"2020.csv", "2021.csv", "2022.xlsx"}
    with pytest.raises(ValueError, match="cannot read .*2022.xlsx"):
        every.prices()
    assert every.prices(end=dt.date(2021, 12, 31)).count() == 7
    b = indexfolder.IndexFolder(spark, tree, "B")
    assert b.sectors().collect() == []
    for wrong in (lambda: b.find("compositions"), lambda: indexfolder.IndexFolder(spark, tree, "C"), lambda: indexfolder.IndexFolder(spark, tree, "A", names={"sectors": "none.csv"}).find("sectors")):
        with pytest.raises(FileNotFoundError):
            wrong()


def test_ids_become_the_tickers_of_their_time(spark, tree):
    a = indexfolder.IndexFolder(spark, tree, "A", endings=("csv",))
    got = {(str(r.date), r.asset): r.price for r in a.prices().collect()}
    assert got == {("2020-01-02", "OLD"): 1, ("2020-01-02", "LATE"): 2, ("2020-01-02", "B"): 3, ("2020-01-03", "OLD"): 1.5, ("2020-01-03", "B"): 4, ("2021-01-04", "NEW"): 5.5, ("2021-01-04", "i3"): 6, ("2022-01-03", "NEW"): 9}
    assert {r.asset for r in a.prices(dt.date(2020, 1, 3), dt.date(2021, 12, 31), ["NEW", "B"]).collect()} == {"NEW", "B"}
    with pytest.raises(ValueError, match="2019"):
        a.prices(dt.date(2019, 1, 1))
    # The index without a mapping of its own takes the root's; a mapping can be left out.
    assert [r.asset for r in indexfolder.IndexFolder(spark, tree, "B").prices().collect()] == ["ROOT"]
    assert [r.asset for r in indexfolder.IndexFolder(spark, tree, "B", mapping=None).prices().collect()] == ["i1"]
    comp = {(str(r.date), r.asset): r.weight for r in a.compositions().collect()}
    assert comp == {("2020-10-01", "OLD"): 1.0, ("2021-10-01", "NEW"): 0.5, ("2021-10-01", "Y"): 0.5}
    asked = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2021, 1, 1),), (dt.date(2021, 10, 1),)], "date date")
    assert {(str(r.date), r.asset) for r in a.weights_as_of(asked).collect()} == {("2021-01-01", "OLD"), ("2021-10-01", "NEW"), ("2021-10-01", "Y")}
    with pytest.raises(ValueError, match="no composition of 2020-01-01, 2021-01-01"):
        a.weights_as_of(asked, exact=True)
    assert {r.asset for r in a.weights_as_of(asked.filter("date > '2021-06-01'"), exact=True).collect()} == {"NEW", "Y"}
