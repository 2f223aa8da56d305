from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.functions.rand import np_uniform
from phenospark.operators import counts as C
from phenospark.operators import gibbs as G
from phenospark.plans import catalog
from sharded import sharded_sweep

DIMS = {"patient": 30, "diag": 8, "med": 9}


def frame(spark, rows):
    return spark.createDataFrame([tuple(int(v) for v in r) for r in rows], "rec_id long, patient long, diag long, med long, k long")


def planted(n=400, seed=0):
    """Records of three groups that share no medication or diagnosis."""
    rng = np.random.default_rng(seed)
    z = rng.integers(0, 3, n)
    return z, np.stack([
        np.arange(n), z * 10 + rng.integers(0, 10, n), np.minimum(z * 3 + rng.integers(0, 3, n), 7), z * 3 + rng.integers(0, 3, n),
        rng.integers(0, 10, n)], axis=1)


@pytest.fixture(scope="module")
def records(spark):
    truth, rows = planted()
    return truth, rows, frame(spark, rows).cache()


def test_leave_one_out_weights(spark):
    dims = {"patient": 2, "diag": 2, "med": 2}
    df = frame(spark, [(0, 0, 0, 0, 0), (1, 1, 1, 1, 0)])
    w = C.component_weights(df, C.component_counts(df), dims, C.Priors.from_dims(dims)).where("rec_id = 0").collect()
    got = {r["k"]: r["weight"] for r in w}
    assert got[0] == pytest.approx((25 / 51) ** 3)
    assert got[-1] == pytest.approx(0.5 / 8)


def test_stick_breaking():
    means = np.mean([C.stick_breaking_weights(0.5, 50, seed) for seed in range(4000)], axis=0)
    # E b = 1 / (1 + alpha), and what is left shrinks by alpha / (1 + alpha) each time
    np.testing.assert_allclose(means[:3], [2 / 3, 2 / 9, 2 / 27], atol=0.02)
    assert C.stick_breaking_weights(0.5, 50).sum() <= 1 + 1e-12


def test_draw_takes_the_first_weight_reached(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.26,), (0.75,), (1.0,)], "u double").withColumn("w", F.array(*map(F.lit, (0.5, 0.0, 1.0, 0.5))))
    got = [r["at"] for r in df.orderBy("u").select(C.draw_category("w", F.col("u")).alias("at")).collect()]
    assert got == [0, 0, 2, 2, 3]


def test_counts_of_every_axis_add_up(spark, records):
    _, rows, df = records
    counts = C.component_counts(df)
    assert {r["axis"]: r["n"] for r in counts.groupBy("axis").agg(F.sum("cnt").alias("n")).collect()} == dict.fromkeys(("all", *DIMS), len(rows))


def test_profiles_sum_to_one(spark, records):
    _, _, df = records
    counts, priors = C.component_counts(df), C.Priors.from_dims(DIMS)
    for axis, n in DIMS.items():
        sums = C.profiles(counts, DIMS, priors, axis).groupBy("k").agg(F.sum("prob").alias("s"), F.count("*").alias("n")).collect()
        assert len(sums) == 10 and all(abs(r["s"] - 1) < 1e-12 and r["n"] == n for r in sums)
        drawn = C.dirichlet_draws(counts, DIMS, priors, axis, seed=3).groupBy("k").agg(F.sum("prob").alias("s")).collect()
        assert all(abs(r["s"] - 1) < 1e-9 for r in drawn)


def test_top_items_break_ties_by_higher_index(spark):
    df = spark.createDataFrame([("med", 0, 0, 0.5), ("med", 0, 1, 0.5), ("med", 0, 2, 0.1)], "axis string, k long, idx long, prob double")
    assert [r["idx"] for r in C.top_items(df, 3).orderBy("rank").collect()] == [1, 0, 2]
    assert "WindowGroupLimit" in C.top_items(df, 3)._jdf.queryExecution().executedPlan().toString()


def test_deltas_equal_a_recount(spark, records):
    _, _, df = records
    after = df.withColumn("k", F.pmod(F.col("rec_id"), F.lit(4)))
    got = C.apply_deltas(C.component_counts(df), df, after)
    want = C.component_counts(after)
    assert sorted(map(str, got.select("axis", "k", "idx", "cnt").collect())) == sorted(map(str, want.collect()))


def test_large_axis_path_gives_the_same_weights(spark, records, monkeypatch):
    _, _, df = records
    counts, priors = C.component_counts(df).cache(), C.Priors.from_dims(DIMS)
    def read():
        return sorted(map(str, C.component_weights(df, counts, DIMS, priors).collect()))
    small = read()
    from phenospark.operators import joins
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert read() == small


@pytest.mark.parametrize("mode", G.MODES)
def test_a_sweep_keeps_every_record(spark, records, mode):
    _, rows, df = records
    after = G.gibbs_sweep(df, DIMS, C.Priors.from_dims(DIMS), mode)
    assert sorted(r["rec_id"] for r in after.collect()) == list(range(len(rows)))
    with pytest.raises(ValueError):
        G.gibbs_sweep(df, DIMS, C.Priors.from_dims(DIMS), "other")


def sequential(rows, dims, priors, uniforms):
    """The one-after-the-other rule, written out plainly."""
    rows = [list(map(int, r)) for r in rows]
    axes = (("patient", 1), ("med", 3), ("diag", 2))
    for n, row in enumerate(rows):
        others = rows[:n] + rows[n + 1:]
        live = sorted({r[4] for r in others})
        w = []
        for k in live:
            members = [r for r in others if r[4] == k]
            value = float(len(members))
            for name, col in axes:
                g = priors.gamma[name]
                value *= (sum(r[col] == row[col] for r in members) + g) / (len(members) + dims[name] * g)
            w.append(value)
        w.append(priors.alpha / np.prod(list(dims.values())))
        run = np.cumsum(w)
        at = int((run < uniforms[n] * run[-1]).sum())
        row[4] = live[at] if at < len(live) else min(set(range(len(live) + 1)) - set(live))
    return [r[4] for r in rows]


def test_one_shard_is_the_sequential_rule(spark):
    _, rows = planted(60, seed=5)
    priors = C.Priors(20.0, {a: 2.0 / n for a, n in DIMS.items()})
    df = frame(spark, rows)
    got = {r["rec_id"]: r["k"] for r in sharded_sweep(df, C.component_counts(df), DIMS, priors, seed=1, sweep=2, shards=1).collect()}
    want = sequential(rows, DIMS, priors, np_uniform(np.arange(60), 1, 2))
    # ids of new components may differ, the grouping may not
    assert len({(got[i], k) for i, k in enumerate(want)}) == len(set(want)) == len(set(got.values()))


def test_driver_and_table_paths_draw_the_same(spark, records):
    _, _, df = records
    runs = [G.fit_phenotypes(df.drop("k"), DIMS, sweeps=3, seed=2, limit=limit) for limit in (None, 0, 8 * 64 * 10)]
    first = sorted(map(str, runs[0].assignments.select("rec_id", "k").collect()))
    for run in runs[1:]:
        assert sorted(map(str, run.assignments.select("rec_id", "k").collect())) == first
        np.testing.assert_allclose(
            [r["log_joint"] for r in run.history.collect()], [r["log_joint"] for r in runs[0].history.collect()])
    last = runs[0].history.orderBy(F.desc("sweep")).first()
    stated = C.log_joint(runs[0].counts, DIMS, runs[0].priors).first()
    assert stated["n_components"] == last["n_components"]
    assert stated["log_joint"] == pytest.approx(last["log_joint"])


def test_scores_of_unseen_values_come_from_the_prior(spark):
    dims = {"patient": 2, "diag": 2, "med": 2}
    df = frame(spark, [(0, 0, 0, 0, 0), (1, 0, 0, 0, 0)])
    counts, priors = C.component_counts(df), C.Priors.from_dims(dims)
    new = frame(spark, [(5, 1, 1, 1, 0), (6, 0, 0, 0, 0)]).drop("k")
    got = {r["rec_id"]: r["score"] for r in C.score_triplets(new, counts, dims, priors).collect()}
    assert got[5] == pytest.approx((25 / 52) ** 3)
    assert got[6] == pytest.approx((27 / 52) ** 3)


def test_one_patient_with_most_records(spark):
    _, rows = planted(300, seed=7)
    rows[: 200, 1] = 4
    df = frame(spark, rows).drop("k")
    got = [
        sorted(map(str, G.fit_phenotypes(df, DIMS, sweeps=2, seed=2, limit=limit).assignments.select("rec_id", "k").collect()))
        for limit in (None, 0)
    ]
    assert got[0] == got[1] and len(got[0]) == 300


def test_slots_double_when_none_is_left(spark, records):
    _, rows, df = records
    fit = G.fit_phenotypes(df.drop("k"), DIMS, sweeps=2, seed=2, k0=2, k_max=2)
    assert [r["k_max"] for r in fit.history.orderBy("sweep").collect()][0] == 4
    assert fit.assignments.count() == len(rows)


def test_planted_groups_are_found(spark, records):
    truth, rows, df = records
    fit = G.fit_phenotypes(df.drop("k"), DIMS, C.Priors(0.5, {a: 1.0 / n for a, n in DIMS.items()}), sweeps=40, seed=4)
    z = {r["rec_id"]: r["k"] for r in fit.assignments.collect()}
    table = np.zeros((max(z.values()) + 1, 3), dtype=int)
    for i, t in enumerate(truth):
        table[z[i], t] += 1
    assert table.max(axis=1).sum() / len(rows) > 0.95
    # forty sweeps separate the groups; leftover small components need a longer burn-in to die
    history = fit.history.orderBy("sweep").collect()
    assert 3 <= history[-1]["n_components"] <= 12
    assert history[-1]["log_joint"] > history[0]["log_joint"] + 100


class Killed(RuntimeError):
    pass


def rows_of(fit):
    # sums of the log joint may round differently
    history = sorted((r["sweep"], r["n_components"], r["k_max"], round(r["log_joint"], 6)) for r in fit.history.collect())
    return (sorted(map(str, fit.assignments.select("rec_id", "k").collect())), history,
            sorted(map(str, fit.counts.collect())))


@pytest.mark.parametrize("limit, every, at", [(None, 1, "before"), (None, 2, "after"), (None, 1, "commit"), (0, 1, "commit")])
def test_a_killed_fit_goes_on_where_it_was(spark, records, tmp_path, monkeypatch, limit, every, at):
    """Killed before or after a sweep, or between a commit's counts and its log row."""
    _, _, df = records
    settings = dict(sweeps=5, seed=3, limit=limit)
    whole = rows_of(G.fit_phenotypes(df.drop("k"), DIMS, **settings))
    ran, sweep, commit = [], G.roomy_sweep, G.SweepLog.commit

    def dying(run, state, number, keep):
        if at == "before" and number == 4:
            raise Killed
        ran.append(number)
        out = sweep(run, state, number, keep)
        if at == "after" and number == 4:
            raise Killed
        return out

    def half(self, counts):
        if at == "commit" and self.waiting[-1][0] == 4:
            counts.write.mode("overwrite").parquet(f"{self.path}/counts/{1 - self.slot}")
            raise Killed
        return commit(self, counts)

    with monkeypatch.context() as m:
        m.setattr(G, "roomy_sweep", dying)
        m.setattr(G.SweepLog, "commit", half)
        with pytest.raises(Killed):
            G.fit_phenotypes(df.drop("k"), DIMS, path=str(tmp_path / "fit"), commit_every=every, **settings)
    assert max(ran) in (3, 4)
    ran.clear()
    with monkeypatch.context() as m:
        m.setattr(G, "roomy_sweep", lambda *a, **b: (ran.append(a[2]), sweep(*a, **b))[1])
        again = G.fit_phenotypes(df.drop("k"), DIMS, path=str(tmp_path / "fit"), commit_every=every, **settings)
    assert ran == list(range(3 if every == 2 else 4, 6))
    assert rows_of(again) == whole
    # finished: read, not run again; more sweeps go on from its end
    with monkeypatch.context() as m:
        m.setattr(G, "roomy_sweep", None)
        assert rows_of(G.fit_phenotypes(df.drop("k"), DIMS, path=str(tmp_path / "fit"), **settings)) == whole
    if limit is None and every == 1 and at == "before":
        more = settings | {"sweeps": 6}
        assert rows_of(G.fit_phenotypes(df.drop("k"), DIMS, path=str(tmp_path / "fit"), **more)) == rows_of(G.fit_phenotypes(df.drop("k"), DIMS, **more))
        with pytest.raises(ValueError):
            G.fit_phenotypes(df.drop("k"), DIMS, path=str(tmp_path / "fit"), sweeps=6, seed=4)
        with pytest.raises(ValueError):
            G.fit_phenotypes(df.drop("k"), DIMS, path=str(tmp_path / "fit"), **settings)


def test_long_axes_move_counts_not_draws(spark, records, monkeypatch):
    """Nothing of the size values x slots is written, joined or shuffled."""
    _, rows, df = records
    written = []
    monkeypatch.setattr(G, "materialize", lambda t, name, slot=None: (written.append((name, t.columns)), G_materialize(t, name, slot))[1])
    fit = G.fit_phenotypes(df.drop("k"), DIMS, sweeps=2, seed=2, limit=0)
    assert fit.assignments.count() == len(rows)
    assert {name for name, _ in written} == {"counts", "assigned"}
    run = G._Blocked(df.select("rec_id", *G.AXES), DIMS, C.Priors.from_dims(DIMS), 2, 0)
    state = run.start(10, 64)
    stored = state.large.where("axis = 'patient'")
    _, _, large = run.draw_parameters(state, 1)
    assert large["patient"].dtypes == [("patient", "bigint"), ("_c_patient", "array<struct<k:int,cnt:bigint>>")]
    assert large["patient"].select(F.sum(F.size("_c_patient"))).first()[0] == stored.count() < DIMS["patient"] * 64 / 4
    run.release()


G_materialize = G.materialize


def test_values_without_records_count_in_the_normaliser(spark):
    """Axes longer than their values in use; all forms draw the same."""
    dims = {"patient": 400, "diag": 8, "med": 9}
    _, rows = planted(120, seed=9)
    df = frame(spark, rows).drop("k")
    first, second = (G.fit_phenotypes(df, dims, sweeps=3, seed=5, limit=limit) for limit in (None, 0))
    assert rows_of(first)[0] == rows_of(second)[0]


def test_births_take_the_lowest_free_ids(spark):
    _, rows = planted(150, seed=3)
    rows[:, 4] = np.array([0, 3, 7])[rows[:, 4] % 3]
    df = frame(spark, rows)
    priors = C.Priors(3000.0, C.Priors.from_dims(DIMS).gamma)
    got = {r["rec_id"]: r["k"] for r in G.frozen_sweep(df, C.component_counts(df), DIMS, priors).collect()}
    born = [got[i] for i in sorted(got) if got[i] not in (0, 3, 7)]
    assert len(got) == 150 and 10 < len(born) < 150
    assert born == [k for k in range(200) if k not in (0, 3, 7)][: len(born)]


def test_patient_profiles_cover_every_patient(spark, monkeypatch):
    """The registered query gives each component's probability of every patient, counted or not."""
    assigned = spark.createDataFrame([(0, 0, 0, 0, 0), (1, 1, 0, 1, 4)], "rec_id long, patient long, diag long, med long, k long")
    dims = {"patient": 3, "diag": 1, "med": 2}
    held = SimpleNamespace(counts=C.component_counts(assigned), dims=dims, priors=C.Priors.from_dims(dims))
    monkeypatch.setattr(catalog, "_prepare", lambda spark, folder: held)
    rows = catalog.QUERIES["profiles_patient"](spark, "").collect()
    assert sorted((r["k"], r["idx"]) for r in rows) == [(k, i) for k in (0, 4) for i in range(3)]
    assert abs(sum(r["prob"] for r in rows) - 2) < 1e-6


def many_patients(spark, n=900):
    """Few records a patient, but for one with a third of them; some patients have none."""
    rng = np.random.default_rng(11)
    rows = np.stack([np.arange(n), rng.integers(0, 500, n), rng.integers(0, 8, n), rng.integers(0, 9, n), np.zeros(n, dtype=int)], axis=1)
    rows[: n // 3, 1] = 4
    return frame(spark, rows).drop("k"), DIMS | {"patient": 520}


def test_rows_of_a_long_axis_draw_as_tables_do(spark, tmp_path):
    """Past two writes of the counts, with doubled slots, a frequent value and a resumed fit."""
    df, dims = many_patients(spark)
    settings = dict(sweeps=10, seed=2, k0=2, k_max=2)
    far = rows_of(G.fit_phenotypes(df, dims, limit=0, **settings))
    assert max(r[2] for r in far[1]) > 2
    assert rows_of(G.fit_phenotypes(df, dims, **settings)) == far
    G.fit_phenotypes(df, dims, path=str(tmp_path / "fit"), **settings | {"sweeps": 7})
    assert rows_of(G.fit_phenotypes(df, dims, path=str(tmp_path / "fit"), **settings)) == far


def test_a_sweep_over_one_long_axis_is_one_stage(spark, monkeypatch):
    df, dims = many_patients(spark)
    context, sweep, stages = spark.sparkContext, G.roomy_sweep, []

    def counted(run, state, number, keep):
        context.setJobGroup(f"{run.run}-{number}", "")
        out = sweep(run, state, number, keep)
        tracker = context.statusTracker()
        stages.append(sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(f"{run.run}-{number}")))
        return out

    monkeypatch.setattr(G, "roomy_sweep", counted)
    try:
        G.fit_phenotypes(df, dims, sweeps=7, seed=2)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # the first adds up the gammas of its own sweep too, and every fourth writes the counts
    assert stages[1:3] == stages[4:6] == [1, 1]


def test_a_fit_goes_on_by_tables_when_its_slots_outgrow_the_tasks(spark, monkeypatch):
    df, dims = many_patients(spark)
    settings = dict(sweeps=4, seed=2, k0=2, k_max=2)
    far = rows_of(G.fit_phenotypes(df, dims, limit=0, **settings))
    monkeypatch.setattr(G._ByRows, "fits", lambda run, k: k <= 4)
    assert rows_of(G.fit_phenotypes(df, dims, **settings)) == far


def test_a_block_of_values_holds_stored_and_likely_cells_only():
    """The draws of a block are those of every cell that has records or may matter, and of no other."""
    k, g, level, key = 512, 1e-3, np.exp(-0.1), (1, 2, 1)
    idx, rare = np.arange(50, 450), np.arange(400) % 7 > 0
    counts = G._Cells(np.array([3, 3, 6, 7]), np.array([1, 500, 5, 0]), np.array([2, 1, 4, 9]))
    got = G._ordinary_draws(idx, rare, counts, k, g, level, key)
    dense = np.zeros((400, k))
    dense[counts.value, counts.slot] = counts.n
    every = G.np_log_gamma_draws(dense + g, idx[:, None] * k + np.arange(k), *key)
    assert len(got.n) < 0.2 * every.size and (np.diff(got.value * k + got.slot) > 0).all()
    assert np.array_equal(got.n, every[got.value, got.slot]) and rare[got.value].all()
    left = np.ones((400, k), dtype=bool)
    left[got.value, got.slot] = False
    assert (every[left & rare[:, None]] < -99.9).all() and not left[3, [1, 500]].any() and not left[6, 5]


def test_counts_are_written_sooner_where_sweeps_are_long(spark, monkeypatch):
    """When a task would go through many cells again, and the rows stay the same."""
    df, dims = many_patients(spark)
    monkeypatch.setattr(G, "REPLAY_CELLS", 1)
    written = []
    monkeypatch.setattr(G, "materialize", lambda t, name, slot=None: (written.append(name), G_materialize(t, name, slot))[1])
    soon = rows_of(G.fit_phenotypes(df, dims, sweeps=3, seed=2))
    assert written.count("rows") == 4
    monkeypatch.setattr(G, "REPLAY_CELLS", 1 << 40)
    assert rows_of(G.fit_phenotypes(df, dims, sweeps=3, seed=2)) == soon
