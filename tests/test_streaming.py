"""Online covariances that stop, are restored from a snapshot and go on."""

import numpy as np
import pytest

from trackline.streaming import online, state


def stream_of(spark, folder, rows):
    df = spark.createDataFrame(rows, "model string, seq long, r array<double>")
    df.repartition(2).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    with online.durable_state(spark):
        yield


def vectors(size):
    rng = np.random.default_rng(4)
    return {m: rng.normal(size=(30, size)) for m in ("a", "b")}


def plain(model, x):
    if isinstance(model, state.Ewma):
        s = np.zeros((x.shape[1],) * 2)
        for r in x:
            s = model.decay * s + (1 - model.decay) * np.outer(np.nan_to_num(r), np.nan_to_num(r))
        return s
    x = x[np.isfinite(x).all(axis=1)]
    return np.cov(x.T) if len(x) > 1 else np.zeros((x.shape[1],) * 2)


@pytest.mark.parametrize("model", [state.Ewma(0.9), state.Expanding()], ids=["ewma", "expanding"])
def test_a_stream_goes_on_from_a_snapshot(spark, tmp_path, model):
    x = vectors(3)
    x["a"][7, 1] = np.nan
    rows = {m: [(m, k, [None if np.isnan(w) else float(w) for w in v]) for k, v in enumerate(x[m])] for m in x}
    first = online.run_to_table(state.updates(stream_of(spark, f"{tmp_path}/in1", rows["a"][:12] + rows["b"][:20]), model, 3), f"{tmp_path}/run1")
    kept = state.snapshots(first)
    kept.write.parquet(f"{tmp_path}/snapshot")
    kept = spark.read.parquet(f"{tmp_path}/snapshot")
    assert {r.model: r.seq for r in kept.collect()} == {"a": 11, "b": 19}
    # The second stream begins earlier than the snapshot, and meets a key that is new.
    later = rows["a"][9:] + rows["b"][20:] + [("c", 0, [1.0, 2.0, 3.0])]
    second = online.run_to_table(state.updates(stream_of(spark, f"{tmp_path}/in2", later), model, 3, kept), f"{tmp_path}/run2")
    got = {(r.model, r.seq): r for r in first.union(second).collect()}
    assert len(got) == first.count() + second.count() == 61
    for m in x:
        for k in range(30):
            s = plain(model, x[m][: k + 1])
            assert (got[m, k].trace, got[m, k].frobenius) == (pytest.approx(np.trace(s)), pytest.approx(np.linalg.norm(s)))
    ends = state.matrices(state.snapshots(second), model).collect()
    want = plain(model, x["b"])
    assert {(r.i, r.j): r.cov for r in ends if r.model == "b"} == pytest.approx({(i, j): want[i, j] for i in range(3) for j in range(i, 3)})


def test_states_of_other_models_are_refused(spark, tmp_path):
    rows = [("a", k, [float(k), 1.0]) for k in range(4)]
    kept = state.snapshots(online.run_to_table(state.updates(stream_of(spark, f"{tmp_path}/in", rows), state.Ewma(0.9), 2), f"{tmp_path}/run"))
    with pytest.raises(Exception, match="is not one of ewma/0.8"):
        online.run_to_table(state.updates(stream_of(spark, f"{tmp_path}/in2", rows), state.Ewma(0.8), 2, kept), f"{tmp_path}/run2")
