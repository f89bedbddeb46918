import json

import pytest
from pyspark.sql import functions as F

from affinade.operators import graph
from affinade.operators.metrics import rating_errors
from affinade.operators.neighbourhood import completed, head
from affinade.operators.split import assign_folds
from affinade.operators.topk import top_k
from affinade.plans import analysis, stages, target
from affinade.plans import evaluate as ev
from affinade.plans.evaluate import Context, evaluate, select_best, sweep
from affinade.plans.registry import MODELS, fit, settings_of
from affinade.plans.service import Recommender, Service
from affinade.plans.store import ModelStore
from affinade.sources import ratings as src
from affinade.sources import tables
from affinade.streaming.popularity import popularity_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ctx(spark):
    split = assign_folds(src.event_ratings(spark, SF)).cache()
    return Context.of(split)


@pytest.mark.parametrize("spec", [
    {"family": "global_mean"}, {"family": "user_mean"}, {"family": "item_mean"}, {"family": "bias", "iterations": 5}, {"family": "popularity"}, {"family": "popularity_positive"}, {"family": "random"},
    {"family": "ubcf", "k": 5}, {"family": "ibcf", "k": 5}, {"family": "regression", "k": 3, "iterations": 5}, {"family": "slim", "l1": 0.1, "l2": 1.0}, {"family": "graph"},
], ids=lambda s: s["family"])
def test_every_family_evaluates(ctx, spec):
    row = evaluate(ctx, fit(spec, ctx.data()), ctx.test).first()
    assert row.rmse is None or 0 <= row.rmse < 5
    assert 0 <= row.catalog_coverage <= 1 and 0 <= row.user_coverage <= 1 and (row.ndcg_mean is None or 0 <= row.ndcg_mean <= 1)


def test_unknown_and_impossible_models(ctx):
    assert len(MODELS) == 12
    with pytest.raises(KeyError):
        fit({"family": "nothing"}, ctx.data())
    with pytest.raises(ValueError):
        fit({"family": "ubcf", "similarity": "adjusted_cosine"}, ctx.data())


def test_sweep_keeps_the_first_of_equals(ctx):
    table = sweep(ctx, [{"family": "popularity"}, {"family": "popularity"}], ctx.val)
    assert select_best(table, "ndcg_mean").first().grid == 0


def test_service(ctx):
    app = Recommender(ctx, k=5)
    user = ctx.users.first().u
    seen = {r.i for r in ctx.train.where(F.col("u") == user).collect()}
    for mode in app.available_models():
        best = app.recommend(user, mode, 5).collect()
        assert [r["rank"] for r in best] == [1, 2, 3, 4, 5] and not seen & {r.i for r in best} and all(r.pred is not None for r in best)
    assert app.user_summary(user).first().n == ctx.train.where(F.col("u") == user).count()
    assert app.compare(user, 3).count() == 3
    assert app.explain(user, app.recommend(user, "affinity", 1).first().i).count() > 0
    with pytest.raises(KeyError):
        app.recommend(10**9)
    with pytest.raises(KeyError):
        app.recommend(user, "nothing")


def test_pareto_and_correlation(spark):
    t = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 0.0, 3.0)], "model string, x double, y double")
    assert {r.model for r in analysis.pareto_front(t, ["x", "y"]).collect()} == {"b", "c"}
    assert [(r.model, r.by) for r in analysis.dominated(t, ["x", "y"]).collect()] == [("a", "b")]
    flat = spark.createDataFrame([(1.0, 2.0)] * 4, "x double, y double")
    assert analysis.correlation(flat, "x", "y").first().pearson is None


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "r.data").write_text("1\t2\t5\t881250949\n1\t2\t3\t881250950\n")
    (tmp_path / "i.item").write_bytes("1|Café|01-Jan-1995||http://x|".encode("latin-1") + b"|".join([b"1"] + [b"0"] * 18) + b"\n")
    (tmp_path / "u.user").write_text("1|24|M|technician|85711\n")
    rows = src.read_ratings(spark, str(tmp_path / "r.data"))
    assert [tuple(r) for r in src.to_matrix(rows).collect()] == [(1, 2, 5.0)]
    item = src.read_items(spark, str(tmp_path / "i.item")).first()
    assert item.title == "Café" and item.genres[0] == 1.0 and len(item.genres) == 19
    assert src.read_users(spark, str(tmp_path / "u.user")).first().zip == "85711"
    with pytest.raises(ValueError):
        src.checked(spark, str(tmp_path / "u.user"), "0" * 32)
    tables.save_csv(rows, str(tmp_path / "csv"))
    assert tables.load_csv(spark, str(tmp_path / "csv"), rows.schema.simpleString()[7:-1].replace(":", " ")).count() == 2
    tables.save_json(rows, str(tmp_path / "json"))
    assert tables.load_json(spark, str(tmp_path / "json")).count() == 2
    spec = {"family": "x", "k": 2}
    assert tables.load_model(spark, str(tmp_path / "m"), spec) is None
    tables.save_model(rows, str(tmp_path / "m"), spec)
    assert tables.load_model(spark, str(tmp_path / "m"), {"k": 2, "family": "x"}).count() == 2
    assert "| 1 | 2 | 5.0000 |" in tables.markdown(rows.select("user_id", "item_id", "rating"))
    assert '"user_id":1' in tables.as_json(rows).first().json


STORED = {
    "popularity": {"family": "popularity"}, "user_mean": {"family": "user_mean"}, "bias": {"family": "bias", "iterations": 3}, "random": {"family": "random"},
    "ubcf": {"family": "ubcf", "k": 5}, "ubcf-rating": {"family": "ubcf", "k": 5, "rank_mode": "rating", "mean_center": False}, "ibcf": {"family": "ibcf", "k": 5}, "ibcf-affinity": {"family": "ibcf", "k": 5, "rank_mode": "affinity"},
    "regression": {"family": "regression", "k": 3, "iterations": 5}, "regression-affinity": {"family": "regression", "k": 3, "iterations": 5, "rank_mode": "affinity"},
    "slim": {"family": "slim", "l1": 0.1, "l2": 1.0}, "graph": {"family": "graph"},
}


@pytest.fixture(scope="module")
def served(spark, ctx, tmp_path_factory):
    fitted = {name: fit(spec, ctx.data(ctx.test)) for name, spec in STORED.items()}
    store = ModelStore(spark, str(tmp_path_factory.mktemp("store")), buckets=8)
    return Service.of(store, ctx, STORED, fitted), fitted


def test_stored_models_rank_as_they_were_fitted(ctx, served):
    """Lists and predictions of every family, for several users, are those of the model itself."""
    app, fitted = served
    users = [r.u for r in ctx.users.orderBy("u").limit(2).collect()]
    low, high = ctx.ratings.agg(F.min("r"), F.max("r")).first()
    assert app.available_models() == sorted(STORED)
    for name in STORED:
        data = ctx.data()
        whole = fitted[name].lists(data, 6).where(F.col("u").isin(users)).collect()
        for user in users:
            want = sorted((r["rank"], r.i, round(r.score, 8)) for r in whole if r.u == user)
            got = app.recommend(user, name, 6).collect()
            assert want and [(r["rank"], r.i, round(r.score, 8)) for r in got] == want, name
            assert all(r.pred is not None and low <= r.pred <= high and r.grp and r.cnt >= 0 for r in got), name
    for name in ("ubcf", "regression", "graph"):
        held = {(r.u, r.i): min(max(r.pred, low), high) for r in fitted[name].pred.where(F.col("u").isin(users)).collect()}
        for user in users:
            cells = {r.i: r.pred for r in app.models[name].candidates(user, 10_000).collect()}
            for (u, i), p in held.items():
                if u == user and i in cells:
                    assert abs(min(max(cells[i], low), high) - p) < 1e-9, name


def test_a_request_reads_the_users_buckets_only(ctx, served):
    app, _ = served
    user = ctx.users.orderBy("u").first().u
    for name in ("ubcf", "ibcf", "regression", "slim", "graph", "bias"):
        plan = app.models[name].list_of(user, 5)._jdf.queryExecution().executedPlan().toString()
        scans = plan.count("Scan parquet") - plan.count("/line")
        assert plan.count("SelectedBucketsCount: 1 out of 8") == scans > 0, name
        assert plan.count("/line") == 0 or "PushedFilters: [IsNotNull(place), LessThan(place" in plan, name


def test_explanations_read_the_users_and_items_buckets(ctx, served):
    app, fitted = served
    user = ctx.users.orderBy("u").first().u
    for name in ("popularity", "ibcf", "regression", "regression-affinity", "slim"):
        model = app.models[name]  # what only its base mean ranks has no reasons
        best = (model._table("own", "u").where(F.col("u") == user) if model.has_own else model.list_of(user, 1)).orderBy(F.desc("score")).first()
        rows = app.explain(user, best.i, name).collect() if best else []
        assert rows or (name == "slim" and not best), name
        assert all(abs(a.weight) >= abs(b.weight) - 1e-9 for a, b in zip(rows, rows[1:])), name
    item = fitted["graph"].score.where(F.col("u") == user).first().i
    sums = {"ubcf": "num", "ibcf-affinity": "aff"}
    for name, column in sums.items():
        spec, heads = STORED[name], fitted[name].tables["heads"]
        for r in heads.where(F.col("u") == user).orderBy(F.desc(column)).limit(1).collect():
            rows = app.explain(user, r.i, name, 100).collect()
            assert len(rows) <= spec["k"] and abs(sum(x.weight for x in rows) - r[column]) < 1e-9
    plan = app.models["ubcf"].explain(user, item)._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 8" in plan and "SelectedBucketsCount: 8 out of 8" not in plan
    direct = {(r.via): r.weight for r in graph.explain_paths(fitted["graph"].tables["edges"], ctx.train.sparkSession.createDataFrame([(user, item)], "u long, i long")).collect()}
    assert {r.via: r.weight for r in app.explain(user, item, "graph", 1000).collect()} == pytest.approx(direct)


def test_service_compares_and_refuses(ctx, served):
    app, _ = served
    user = ctx.users.orderBy("u").first().u
    rows = app.compare(user, 3, ["popularity", "ibcf"]).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and all(r.popularity is not None and r.ibcf is not None for r in rows)
    assert app.user_summary(user).first().n == ctx.train.where(F.col("u") == user).count()
    assert app.user_profile(user, 3).count() == 3
    for call in (lambda: app.recommend(user, "nothing"), lambda: app.recommend(10**9, "popularity"), lambda: app.model_metrics()):
        with pytest.raises(KeyError):
            call()


def test_stored_models_open_in_another_session(spark, ctx, served):
    """A session whose catalogue doesn't know the tables finds buckets again by their path."""
    app, _ = served
    user = ctx.users.orderBy("u").first().u
    want = [(r["rank"], r.i) for r in app.recommend(user, "ibcf", 4).collect()]
    for t in spark.catalog.listTables():
        if t.name.startswith("buckets_"):
            spark.sql(f"DROP TABLE {t.name}")
    again = Service(ModelStore(spark, app.store.root, buckets=8), ["ibcf"])
    assert [(r["rank"], r.i) for r in again.recommend(user, "ibcf", 4).collect()] == want
    plan = again.models["ibcf"].list_of(user, 4)._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 8" in plan


GRID = [{"family": f, "k": k, "similarity": s, "mean_center": c, "rank_mode": m} for f, s, c in (("ubcf", "cosine", True), ("ubcf", "cosine", False), ("ibcf", "adjusted_cosine", True)) for k in (2, 5) for m in ("rating", "score", "affinity")]


def test_a_swept_scan_equals_single_fits(ctx, monkeypatch):
    """All k and heads of one similarity come from one table and one ranked scan, with the metrics of fits one by one."""
    made = {"similarity": 0, "slots": 0}

    def counted(name, f):
        def run(*a, **kw):
            made[name] += 1
            return f(*a, **kw)

        return run

    monkeypatch.setattr(ev.similarity, "similarity", counted("similarity", ev.similarity.similarity))
    monkeypatch.setattr(ev.neighbourhood, "slots", counted("slots", ev.neighbourhood.slots))
    rows = {r.grid: r for r in sweep(ctx, GRID, ctx.val).collect()}
    assert made == {"similarity": 2, "slots": 2} and sorted(rows) == list(range(len(GRID)))
    monkeypatch.undo()
    for grid in (4, 15):
        one = evaluate(ctx, fit(GRID[grid], ctx.data(ctx.val)), ctx.val).first().asDict()
        for name, value in one.items():
            assert rows[grid][name] == pytest.approx(value, abs=1e-9), (grid, name)


def test_a_stopped_sweep_goes_on_where_it_was(ctx, tmp_path, monkeypatch):
    specs = [{"family": "popularity"}, {"family": "item_mean"}, *GRID[:6], {"family": "global_mean"}, {"family": "popularity"}]
    path, real, seen = str(tmp_path / "sweep"), ev.fit, []

    def stops(spec, data):
        if spec["family"] == "global_mean" and len(seen) < 3:
            seen.append("stop")
            raise RuntimeError("lost")
        seen.append(spec["family"])
        return real(spec, data)

    monkeypatch.setattr(ev, "fit", stops)
    with pytest.raises(RuntimeError):
        sweep(ctx, specs, ctx.val, path=path)
    assert seen == ["popularity", "item_mean", "stop"]
    kept = tables.load_table(ctx.train.sparkSession, path).count()
    assert kept == 2
    rows = sweep(ctx, specs, ctx.val, path=path).collect()
    assert seen == ["popularity", "item_mean", "stop", "global_mean"]  # what was there isn't fitted again
    assert [r.grid for r in sorted(rows, key=lambda r: r.grid)] == list(range(len(specs)))
    monkeypatch.setattr(ev, "scanned", None)  # nothing is left to scan
    assert sweep(ctx, specs, ctx.val, path=path).count() == len(specs)
    whole = {r.grid: r.ndcg_mean for r in rows}
    assert whole[0] == whole[len(specs) - 1]


def test_stages_run_from_files(spark, tmp_path, monkeypatch):
    """Split, sweeps, both selections, the test table with '-rating' arms and baselines, stored models, resources."""
    monkeypatch.setattr(stages, "BASELINES", [{"family": "popularity"}])
    grid = {"means": [{"family": "popularity"}, {"family": "item_mean"}, {"family": "global_mean"}]}
    todo, out = stages.stages(grid), str(tmp_path)
    for name in ("split", "eda", "means", "test", "resources"):
        todo[name](spark, SF, out)
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    sweep_rows = read("means_sweep").collect()
    assert len(sweep_rows) == 3
    best, rating = read("means_best").first(), read("means_best_rating").first()
    assert best.ndcg_mean == max(r.ndcg_mean for r in sweep_rows) and rating.rmse == min(r.rmse for r in sweep_rows)
    names = {"means", "popularity"} | ({"means-rating"} if best.grid != rating.grid else set())
    assert {r.model for r in read("test").collect()} == names == {r.model for r in read("lists").select("model").distinct().collect()}
    assert read("models/means/items").count() > 0 and read("predictions/model=means").count() > 0 and read("per_user/model=means").count() > 0
    kept = read("resources").collect()
    assert len(kept) == len(names) and all(r.fit_s >= 0 and r.rank_ms_per_user > 0 and r.cpu_s > 0 and r.peak_task_mb >= 0 for r in kept)
    for r in kept:
        kept_rows = sum(spark.read.parquet(str(p)).count() for p in (tmp_path / "models" / r.model).glob("*")) if (tmp_path / "models" / r.model).exists() else 0
        files = sum(f.stat().st_size for f in (tmp_path / "models" / r.model).rglob("*.parquet")) if kept_rows else 0
        assert r.model_rows == kept_rows and files <= r.model_bytes <= files + 10_000
    assert [r.total_s for r in read("resource_summary").collect()] == sorted((r.fit_s + r.predict_s + r.rank_s for r in kept), reverse=True)


def test_stage_names_and_grids(capsys):
    assert stages.main(["--list"]) == 0
    for wrong in (["--only", "nothing"], ["--from", "nothing"]):
        with pytest.raises(SystemExit):
            stages.main(wrong)
    assert {name: len(specs) for name, specs in stages.GRIDS.items()} == {"ubcf": 108, "ibcf": 162, "regression": 108, "slim": 31, "graph": 48}
    assert all(all(s in stages.GRIDS[n] for s in specs) for n, specs in stages.SMALL.items() if n != "graph")


def test_shared_lists_equal_lists_over_all_cells(ctx):
    """Models whose order of items is everybody's rank without the product of users and items."""
    for spec in ({"family": "global_mean"}, {"family": "user_mean"}, {"family": "bias", "iterations": 3}, {"family": "popularity"}, {"family": "random"}):
        fitted = fit(spec, ctx.data(ctx.test))
        rows = lambda df: sorted((r.u, r["rank"], r.i) for r in df.collect())
        assert rows(fitted.lists(ctx.data(), 5)) == rows(top_k(fitted.score, 5, ctx.train)), spec
        assert fitted.pred.count() == ctx.test.select("u", "i").distinct().count()


def test_stream_counts_equal_batch(spark, tmp_path):
    path = f"{SF}/events.parquet"
    schema = spark.read.parquet(path).schema
    (tmp_path / "in").mkdir()
    import shutil

    shutil.copy(path, tmp_path / "in" / "events.parquet")
    rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = popularity_stream(rows).writeStream.outputMode("complete").format("memory").queryName("pop").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from pop").first()[0] == spark.read.parquet(path).count()


@pytest.mark.parametrize("family", ["ubcf", "ibcf"])
def test_neighbourhoods_score_every_cell(spark, family):
    """Sparse ratings: cells without evidence count in the errors by their base mean, and lists are full."""
    train = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (2, 1, 4.0), (2, 2, 2.0), (3, 3, 1.0), (4, 4, 2.0), (4, 5, 5.0)], "u long, i long, r double")
    held = spark.createDataFrame([(3, 1, 4.0), (1, 4, 2.0), (4, 3, 5.0), (5, 6, 3.0)], "u long, i long, r double")
    ratings = train.unionByName(held)
    ctx = Context(ratings, train, held, held, ratings.select("u").distinct(), ratings.select("i").distinct())
    user_mean, item_mean, mu = {1: 4.0, 2: 3.0, 3: 1.0, 4: 3.5}, {1: 4.5, 2: 2.5, 3: 1.0, 4: 2.0, 5: 5.0}, 22 / 7
    fitted = fit({"family": family, "k": 3, "min_support": 1, "beta": None, "rank_mode": "score"}, ctx.data())
    heads = completed(fitted.tables["heads"], ctx.data().pairs(), train, family == "ubcf").cache()
    got = {(r.u, r.i): r for r in heads.collect()}
    assert {(r.u, r.i): r.pred for r in fitted.pred.collect()} == {c: r.pred for c, r in got.items()}
    assert len(got) == 30 and rating_errors(heads, held).first().n == 4
    for r in held.collect():
        assert abs(got[r.u, r.i].pred - (user_mean.get(r.u, mu) if family == "ubcf" else item_mean.get(r.i, mu))) < 1e-9
    assert got[5, 6].num == 0.0 and got[5, 6].aff == 0.0
    lists = top_k(head(heads, "score"), 3, train).groupBy("u").count().collect()
    assert sorted((r.u, r["count"]) for r in lists) == [(u, 3) for u in range(1, 6)]
    rows = lambda df: sorted((r.u, r["rank"], r.i, r.score) for r in df.collect())
    assert rows(fitted.lists(ctx.data(), 3)) == rows(top_k(head(heads, "score"), 3, train))
    for mode in ("rating", "affinity"):
        model = fit({"family": family, "k": 3, "min_support": 1, "beta": None, "rank_mode": mode}, ctx.data(held))
        assert rows(model.lists(ctx.data(), 4)) == rows(top_k(head(heads, mode), 4, train))
        assert "Cartesian" not in model.lists(ctx.data(), 4)._jdf.queryExecution().executedPlan().toString()


def test_refits_by_difference_equal_full_refits(ctx):
    """One user's lists of every family from stored sums, kind by kind of similarity, centring and head."""
    specs = {
        "positive": {"family": "popularity_positive"}, "item_mean": {"family": "item_mean"},
        "ub-cos": {"family": "ubcf", "k": 5}, "ub-pea": {"family": "ubcf", "k": 5, "similarity": "pearson", "rank_mode": "rating"},
        "ib-adj": {"family": "ibcf", "k": 4}, "ib-cos": {"family": "ibcf", "k": 4, "similarity": "cosine", "mean_center": False, "rank_mode": "score"}, "ib-pea": {"family": "ibcf", "k": 4, "similarity": "pearson", "center_by": "user"},
        "graph": {"family": "graph"}, "raw": {"family": "graph", "normalize": "none"}, "bias": {"family": "bias", "iterations": 2},
    }
    user = ctx.train.groupBy("u").agg(F.count_if(F.col("r") >= 4).alias("n")).orderBy(F.desc("n"), "u").first().u
    rows = lambda df: sorted((r.model, r["rank"], r.i, round(r.score, 7), r.is_hit) for r in df.collect())
    got, want = rows(target.lists_by_difference(ctx, user, specs, 5)), rows(target.lists_of(ctx, user, specs, 5))
    assert got == want
    assert {r[0] for r in got} == set(specs)


def test_ablations_change_one_factor(spark):
    """Blocks of every family from a made-up sweep: the setting that stays, the best variant of each value, ties and places."""
    rows = [(g, k, sim, c, "affinity", 1.0 - 0.01 * k + 0.1 * (sim == "pearson"), 0.1 * k * (2 if sim == "cosine" else 1)) for g, (sim, c, k) in enumerate((s, c, k) for s in ("cosine", "pearson") for c in (True, False) for k in (1, 2))]
    sweep_df = spark.createDataFrame(rows, "grid int, k int, similarity string, mean_center boolean, rank_mode string, rmse double, ndcg_mean double")
    got = {(r.factor, r.variant): r for r in analysis.ablations("ubcf", sweep_df).collect()}
    assert {f for f, _ in got} == {"similarity", "mean_center", "k", "rank_mode"} and len(got) == 7
    assert got["similarity", "pearson"].delta_ndcg == pytest.approx(-0.2) and got["similarity", "pearson"].delta_rmse == pytest.approx(0.1)
    summary = {r.factor: r for r in analysis.ablation_summary(analysis.ablations("ubcf", sweep_df)).collect()}
    assert summary["mean_center"].told_by == "none" and summary["mean_center"].best is None and summary["rank_mode"].n_variants == 1
    assert summary["similarity"].told_by == "ndcg" and summary["similarity"].best == "cosine" and summary["similarity"].position == 2  # spreads of similarity and k are equal
    grid = [(json.dumps(settings_of(s)), 1.0 + 0.001 * n, 0.9 if s.get("l1") == 5.0 and s["l2"] == 50.0 else 0.5 - 0.001 * n, n) for f in ("regression", "slim", "graph", "ibcf") for n, s in enumerate(stages.GRIDS[f])]
    every = spark.createDataFrame(grid, "spec string, rmse double, ndcg_mean double, grid int")
    blocks = set()
    for family in ("regression", "slim", "graph", "ibcf"):
        table = ev.with_settings(every.where(F.col("spec").contains(f'"{family}"')), ev.SETTINGS[family])
        out = analysis.ablations(family, table).collect()
        blocks |= {(family, r.factor) for r in out}
        assert all(r.delta_ndcg <= 0 and r.delta_rmse >= 0 for r in out)
        if family == "slim":
            count = lambda factor: sum(r.factor == factor for r in out)  # noqa: E731,B023
            assert (count("l1"), count("l2"), count("tau"), count("top_m")) == (9, 6, 5, 6)
        if family == "regression":
            gains = analysis.ols_against_ridge(table).collect()
            assert len(gains) == 4 and all(r.gain == pytest.approx(r.ols - r.ridge) and r.lam > 0 for r in gains)
    assert len(blocks) + 4 == 20


def test_findings_by_factor(spark):
    rows = [(0, "a", 1, 0.5, 0.2), (1, "a", 2, 0.4, 0.2), (2, "b", 1, 0.4, 0.1), (3, "b", 2, 0.9, None)]
    table = spark.createDataFrame(rows, "grid int, s string, k int, rmse double, ndcg_mean double")
    got = {(r.factor, r.level): (r.n, r.best_rmse, r.best_ndcg, r.rmse_grid, r.ndcg_grid) for r in analysis.findings_by_factor(table, ["s", "k"]).collect()}
    assert got[None, None] == (4, 0.4, 0.2, 1, 0) and got["s", "b"] == (2, 0.4, 0.1, 2, 2) and got["k", "2"] == (2, 0.4, 0.2, 1, 1) and len(got) == 5


def test_a_sweep_in_blocks_of_users_equals_the_ranked_scan(spark, ctx, monkeypatch):
    """With an item that nobody rated in training; no ranked scan of all candidates is made."""
    from dataclasses import replace

    from affinade.operators import wide

    more = replace(ctx, items=ctx.items.select("i").union(spark.range(1).selectExpr("-5L AS i")))
    specs = [s | {"similarity": "pearson"} if s["k"] == 5 else s for s in GRID if s["family"] == "ubcf"]
    want = {r.grid: r.asDict() for r in sweep(more, specs, ctx.val).collect()}
    monkeypatch.setattr(wide, "CANDIDATES", 1)
    monkeypatch.setattr(ev.neighbourhood, "slots", None)
    got = {r.grid: r.asDict() for r in sweep(more, specs, ctx.val).collect()}
    assert sorted(got) == sorted(want) == list(range(len(specs)))
    for grid, row in want.items():
        for name, value in row.items():
            assert got[grid][name] == (pytest.approx(value, abs=1e-8) if isinstance(value, float) else value), (grid, name)


def test_a_stored_model_made_in_blocks_explains_by_what_it_used(spark, tmp_path, monkeypatch):
    """Only similarities of neighbours are stored, and lists and reasons, those by negative similarities too, are those of the whole table."""
    import numpy as np

    from affinade.operators import wide

    rng = np.random.default_rng(3)
    rows = [(u, i, float(rng.integers(1, 6)), "train") for u in range(40) for i in range(9) if rng.random() < (0.2 if i < 3 else 0.8) or i == 8]
    ctx = Context.of(spark.createDataFrame(rows, "u long, i long, r double, fold string").cache())
    spec = {"family": "ubcf", "k": 8, "similarity": "pearson"}
    whole = fit(spec, ctx.data())
    monkeypatch.setattr(wide, "CANDIDATES", 1)
    few = fit(spec, ctx.data())
    assert few.tables["sim"].where("slot is null").count() < whole.tables["sim"].where("sim > 0").count()
    apps = [Service.of(ModelStore(spark, str(tmp_path / name), buckets=2), ctx, {"m": spec}, {"m": f}) for name, f in (("whole", whole), ("few", few))]
    negative = few.tables["sim"].where("slot is not null").limit(1).collect()
    assert negative
    want, got = ([(r["rank"], r.i, round(r.score, 8)) for r in app.recommend(5, "m", 4).collect()] for app in apps)
    assert want and got == want
    for user, item in ((negative[0].a, negative[0].i), (5, 6)):
        want, got = ({r.via: round(r.weight, 8) for r in app.explain(user, item, "m", 20).collect()} for app in apps)
        assert want and got == want
