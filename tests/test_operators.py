import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import fixtures
from pointloom.operators import calibration, clusters, consensus, evaluation, graph, grouping, localizations, neighbors, samples, scoring, together
from pointloom.operators.clusters import cluster_stats, remove_rows
from pointloom.operators.grouping import GroupingConfig, merge_groups, sample_groupings
from pointloom.plans import chains, joins, reports
from pointloom.sources import tables

LOCS = "loc_id long, x double, y double, sigma_x double, sigma_y double, sigma_xy double"


def rows(spark, points):
    return spark.createDataFrame([(i, float(x), float(y), 0.01, 0.01, 0.0) for i, (x, y) in enumerate(points)], LOCS)


def test_validation(spark):
    good = rows(spark, [(0, 0), (1, 1)])
    assert localizations.validate(good).count() == 2
    with pytest.raises(ValueError):
        localizations.validate(good.withColumn("sigma_x", F.lit(0.0)))
    with pytest.raises(ValueError):
        localizations.validate(good.withColumn("z", F.lit(1.0)))
    with pytest.raises(ValueError):
        localizations.resolve_tau(good, -0.1)


def test_pairs_match_brute_force(spark):
    pts = [((i * 37 % 101) / 500, (i * 53 % 97) / 500) for i in range(80)]
    got = {(r["i"], r["j"]) for r in neighbors.neighbor_pairs(rows(spark, pts)).collect()}
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if ((pts[i][0] - pts[j][0]) ** 2 + (pts[i][1] - pts[j][1]) ** 2) ** 0.5 < 0.06}
    assert got == want


def test_nearest_far_points(spark):
    a, b = rows(spark, [(0, 0), (100, 100)]), rows(spark, [(0.5, 0), (0.6, 0), (3, 3)]).withColumnRenamed("loc_id", "rid")
    got = {r["loc_id"]: r["rid"] for r in neighbors.nearest(a, b, "loc_id", "rid").collect()}
    assert got == {0: 0, 1: 2}


def test_empty_input(spark):
    none = rows(spark, [])
    assert neighbors.neighbor_pairs(none).count() == 0
    assert graph.components(none, neighbors.neighbor_pairs(none)).count() == 0
    assert localizations.bounding_box(none).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 19], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connect(links).collect()}
    assert {v for k, v in got.items() if k <= 19} == {0} and {v for k, v in got.items() if k >= 20 and k > 20} == {20}


def test_remove_rows_is_the_inverse(spark):
    df = rows(spark, [(i / 10, i / 7) for i in range(9)]).withColumn("g", F.lit(1))
    whole, part, rest = (cluster_stats(d, ["g"]) for d in (df, df.filter("loc_id < 4"), df.filter("loc_id >= 4")))
    a, b = remove_rows(whole, part, ["g"]).first(), rest.first()
    assert all(abs(a[c] - b[c]) < 1e-8 * max(1, abs(b[c])) for c in ("n", "l_xx", "e_x", "quad", "log_det"))


def test_mutual_best_takes_rounds(spark):
    pairs = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2), (2, 1, 0.15), (2, 2, 0.9)], "a int, b int, d double")
    got = {(r["a"], r["b"]) for r in neighbors.mutual_best(pairs, ["a"], ["b"], [F.col("d")], []).collect()}
    assert got == {(1, 1), (2, 2)}


@pytest.mark.parametrize("bound", [1_000_000, 50])
def test_chains_are_matched_by_component(spark, monkeypatch, bound):
    """A chain of 1,000 whose best pair is at one end, a tangle with ties, and a repeated pair; larger groups in rounds."""
    monkeypatch.setattr(neighbors, "MATCHED", bound)
    rng = random.Random(9)
    length = 1000 if bound > 1000 else 60
    data = [(i // 2, (i + 1) // 2, 1.0 + i) for i in range(length)] + [(10_000 + rng.randrange(9), 10_000 + rng.randrange(9), float(rng.randrange(4))) for _ in range(30)] + [(7_777, 7_777, 1.0)] * 2
    want, left, right = set(), set(), set()
    for a, b, _ in sorted(data, key=lambda p: (p[2], p[0], p[1])):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    pairs = spark.createDataFrame(data, "a long, b long, d double")
    got = [(r["a"], r["b"]) for r in neighbors.mutual_best(pairs, ["a"], ["b"], [F.col("d")], []).collect()]
    assert set(got) == want and (bound < 1000 or len(got) == len(want))
    grouped = pairs.withColumn("g", F.lit(3))
    assert {(r["a"], r["b"]) for r in neighbors.mutual_best(grouped, ["a"], ["b"], [F.col("d")], ["g"]).collect()} == want
    assert neighbors.mutual_best(pairs.limit(0), ["a"], ["b"], [F.col("d")], []).columns == ["a", "b", "d"]


def test_sample_choice_is_the_plain_one(spark):
    """Least mean variation of information over all samples, by blocks of three; a row is missing in some samples."""
    rng = random.Random(3)
    data = [(p, c, t, i, (i // 3 if rng.random() < 0.7 else rng.randrange(4))) for p in (1, 2) for c in (0, 1) for t in range(1, 5) for i in range(12) if not (t == 2 and i == 5)]
    label = {}
    for p, c, t, i, k in data:
        label.setdefault(p, {}).setdefault((c, t), {})[i] = k

    def vi(x, y):
        both = [(x[i], y[i]) for i in x if i in y]
        h = lambda v: sum(v.count(k) * math.log(v.count(k)) for k in set(v))
        return (h([a for a, _ in both]) + h([b for _, b in both]) - 2 * h(both)) / len(both)

    table = spark.createDataFrame(data, "partition_id long, chain_id int, iter int, loc_id long, cluster int")
    for r in consensus.vi_select(table, block=3).collect():
        mean = {s: sum(vi(x, y) for y in label[r["partition_id"]].values()) / 8 for s, x in label[r["partition_id"]].items()}
        best = min(mean, key=lambda s: (round(mean[s], 9), s))
        assert (r["chain_id"], r["iter"]) == best and abs(r["vi"] - mean[best]) < 1e-9
    assert consensus.vi_select(table).count() == 2 and consensus.vi_select(table.limit(0)).count() == 0


def test_the_whole_job_says_how_many_and_where(spark):
    """Three clear sources of 6, 8 and 10 rows: their number, sizes, and a mass of one around each."""
    rng = random.Random(2)
    centres = {(0.0, 0.0): 6, (1.0, 0.0): 8, (0.0, 1.0): 10}
    f = grouping.group_field(rows(spark, [(x + rng.gauss(0, 0.01), y + rng.gauss(0, 0.01)) for (x, y), n in centres.items() for _ in range(n)]), GroupingConfig(mu=8.0), pixel=0.01)
    assert f.emitters.count() == 3
    assert [tuple(r) for r in f.field_k.collect()] == [(3, 1)]
    assert sorted(tuple(r) for r in f.counts.collect()) == [(6, 1), (8, 1), (10, 1)]
    mass = {}
    for r in f.raster.collect():
        at = (float(round(r["ix"] * 0.01)), float(round(r["iy"] * 0.01)))
        mass[at] = mass.get(at, 0.0) + r["mass"]
    assert set(mass) == set(centres) and all(abs(m - 1.0) < 1e-3 for m in mass.values())


def test_acceptance_in_the_mixing_report(spark):
    trace = spark.createDataFrame([(1, 0, t, 2 + t % 2) for t in range(1, 9)], "partition_id long, chain_id int, iter int, k int")
    moves = spark.createDataFrame([(1, 0, "up", 1, 4), (1, 0, "up", 2, 4), (1, 0, "down", 0, 0), (1, 0, None, 1, 1)], "partition_id long, chain_id int, move string, accepted int, total int")
    got = {r["statistic"]: r["value"] for r in evaluation.mixing_report(trace, moves).collect()}
    assert got["acceptance of up"] == 0.375 and got["acceptance of down"] == 0.0
    assert len([s for s in got if s.startswith("acceptance")]) == 2 and got["mean"] == 2.5


def test_raster_mass(spark):
    c = spark.createDataFrame([(0.013, 0.021, 1e-4, r * 1e-4, 1e-4) for r in (0.0, 0.05, -0.6, 0.9)], "x double, y double, v_xx double, v_xy double, v_yy double")
    total = samples.posterior_raster(c, 0.004).agg(F.sum("mass").alias("m")).first()["m"]
    assert abs(total - 4) < 1e-9


def test_map_n_smooths_a_close_race(spark):
    h = spark.createDataFrame([(0, 2, 10), (0, 3, 9), (0, 4, 9), (1, 5, 20), (1, 6, 1)], "partition_id long, k int, n long")
    got = {r["partition_id"]: r["k"] for r in consensus.map_n(h, ["partition_id"]).collect()}
    assert got == {0: 3, 1: 5}


def test_merging_and_sampling_find_two_sources(spark):
    pts = [((k % 2) * 0.08 + (i * 7 % 11 - 5) / 2000, (i * 5 % 13 - 6) / 2000) for k in range(2) for i in range(12)]
    m = rows(spark, pts).withColumn("partition_id", F.lit(0).cast("long"))
    cfg = GroupingConfig(mu=12.0, rounds=2, sweeps=3)
    labels = merge_groups(m, neighbors.knn_edges(m, 6), cfg).collect()
    side = {}
    for r in labels:
        side.setdefault(r["cluster"], set()).add(r["loc_id"] // 12)
    assert len(side) == 2 and all(len(s) == 1 for s in side.values())
    drawn, hyper = sample_groupings(m, cfg)
    again, _ = sample_groupings(m, cfg)
    assert drawn.count() == 48 and hyper.count() == 2
    key = lambda d: sorted((r["iter"], r["loc_id"], r["cluster"]) for r in d.collect())
    assert key(drawn) == key(again)


def plain_merge(pts, links, cfg):
    """Merge the pair with the greatest gain until none gains; score written out for circular rows of sigma 0.01."""
    lg, w = math.lgamma, 1e4
    area = math.log((max(x for x, _ in pts) - min(x for x, _ in pts) + 0.06) * (max(y for _, y in pts) - min(y for _, y in pts) + 0.06))

    def ml(c):
        n, mx, my = len(c), sum(pts[i][0] for i in c) / len(c), sum(pts[i][1] for i in c) / len(c)
        spread = sum((pts[i][0] - mx) ** 2 + (pts[i][1] - my) ** 2 for i in c)
        return (1 - n) * math.log(2 * math.pi) + n * math.log(w) - 0.5 * w * spread - math.log(n * w) - area

    g = cfg.shape
    fixed = lg(g) - g * math.log(g / (g + cfg.mu)) - math.log(cfg.rho)
    groups = {i: {i} for i in range(len(pts))}
    while len(groups) > 1:
        tied = {(a, b) for a in groups for b in groups if a < b and any((i, j) in links or (j, i) in links for i in groups[a] for j in groups[b])}
        gain = lambda a, b: ml(groups[a] | groups[b]) - ml(groups[a]) - ml(groups[b]) + lg(len(groups[a]) + len(groups[b]) + g) - lg(len(groups[a]) + g) - lg(len(groups[b]) + g) + fixed + math.log(len(groups)) - area
        top = max(((gain(a, b), -a, -b) for a, b in tied), default=(-1, 0, 0))
        if top[0] <= 0:
            break
        groups[-top[1]] |= groups.pop(-top[2])
    return {frozenset(c) for c in groups.values()}


def merged_sets(labels):
    sets = {}
    for r in labels.collect():
        sets.setdefault(r["cluster"], set()).add(r["loc_id"])
    return {frozenset(c) for c in sets.values()}


def counted_rounds(monkeypatch):
    rounds, write = [], grouping.settle
    monkeypatch.setattr(grouping, "settle", lambda df, name: (rounds.append(name) if name == "merged" else None, write(df, name))[1])
    return rounds


def test_a_hub_takes_all_its_rows_at_once(spark, monkeypatch):
    # all rows are linked to the first only
    rounds = counted_rounds(monkeypatch)
    pts = [((i * 7 % 11 - 5) / 5000, (i * 5 % 13 - 6) / 5000) for i in range(32)]
    m = rows(spark, pts).withColumn("partition_id", F.lit(0).cast("long"))
    star = spark.createDataFrame([(0, i) for i in range(1, 32)], "i long, j long")
    got = merged_sets(merge_groups(m.coalesce(1), star.coalesce(1), GroupingConfig(mu=32.0)))
    assert got == {frozenset(range(32))} == plain_merge(pts, {(0, i) for i in range(1, 32)}, GroupingConfig(mu=32.0))
    assert len(rounds) <= 3


def test_merging_is_the_sequential_one_on_clear_sources(spark, monkeypatch):
    rounds = counted_rounds(monkeypatch)
    rng = random.Random(11)
    pts = [(k % 3 * 0.2 + rng.gauss(0, 0.01), k // 3 * 0.2 + rng.gauss(0, 0.01)) for k in range(6) for _ in range(rng.randint(6, 14))] + [(0.9, 0.9)]
    m = rows(spark, pts).withColumn("partition_id", F.lit(0).cast("long"))
    edges = neighbors.knn_edges(m, 6)
    got = merged_sets(merge_groups(m, edges, GroupingConfig(mu=10.0)))
    assert got == plain_merge(pts, {(r["i"], r["j"]) for r in edges.collect()}, GroupingConfig(mu=10.0)) and len(got) == 7
    assert len(rounds) < 12


@pytest.fixture
def many_pairs(spark, tmp_path):
    # eight pairs of sources with three rows each
    spark.range(48).selectExpr("id as event_id", "id % 16 as user_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_raster_takes_every_sample(spark, many_pairs):
    s = fixtures.samples(spark, many_pairs)
    want = s.select("partition_id", "iter", "cluster").distinct().count()
    assert s.select("iter").distinct().count() == 12
    assert abs(chains.g8(spark, many_pairs).agg(F.sum("mass").alias("m")).first()["m"] - want) < 1e-3


def test_sweep_takes_every_pair(spark, many_pairs, monkeypatch):
    monkeypatch.setattr(reports, "group_localizations", lambda locs, cfg: locs.groupBy("track_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumnRenamed("track_id", "emitter_id"))
    assert {r["trial"] for r in reports.l10(spark, many_pairs).collect()} == set(range(8))


def test_registered_sampling_burns_in(spark, monkeypatch):
    monkeypatch.setattr(reports, "_members", lambda s, d: None)
    monkeypatch.setattr(reports, "sample_groupings", lambda members, cfg: (cfg, None))
    cfg = reports.j2(spark, "")
    assert cfg.burn_in > 0 and cfg.rounds >= GroupingConfig.rounds and cfg.sweeps >= GroupingConfig.sweeps and cfg.chains > 1


def test_sampled_emitters_are_a_consensus(spark, monkeypatch):
    m = rows(spark, [((i * 7 % 11 - 5) / 2000, (i * 5 % 13 - 6) / 2000) for i in range(4)])
    # the last draw of chain 0 is one cluster, all others are two
    two, one = [0, 0, 1, 1], [0, 0, 0, 0]
    drawn = [(p, c, r, i, (one if (c, r) == (0, 2) else two)[i]) for p in [0] for c in range(2) for r in (1, 2) for i in range(4)]
    samples = spark.createDataFrame(drawn, "partition_id long, chain_id int, iter int, loc_id long, cluster long")
    monkeypatch.setattr(grouping, "sample_groupings", lambda members, cfg: (samples, None))
    monkeypatch.setattr(grouping, "partition_locs", lambda locs, *a, **k: (locs.drop("sigma_xy").withColumn("partition_id", F.lit(0).cast("long")).withColumn("is_overlap", F.lit(False)), None))
    monkeypatch.setattr(grouping, "overlap_discard", lambda em, members: em)
    monkeypatch.setattr(grouping, "near_boundary", lambda em, members, margin: em.limit(0))
    monkeypatch.setattr(grouping, "dedup_boundary", lambda em, margin: em)
    out = grouping.group_localizations(m, GroupingConfig(sampler="gibbs", chains=2)).collect()
    assert sorted(r["n"] for r in out) == [2, 2]


def test_registered_queries_keep_the_operators_defaults(spark, many_pairs, monkeypatch):
    calls = []

    def record(*args, **kwargs):
        calls.append((args, kwargs))
        raise StopIteration

    for f, module, name, n in [(reports.i9, reports.C, "bootstrap_ci", 2), (reports.i10, reports.C, "estimate_tau", 2), (reports.i11, reports.C, "estimate_tau_axis", 2), (chains.h5, chains.H, "mapn_collapsed", 2), (chains.h7, chains.H, "mapn_collapsed", 3), (chains.h4, chains.H, "median_refine", 2)]:
        monkeypatch.setattr(module, name, record)
        with pytest.raises(StopIteration):
            f(spark, many_pairs)
        assert len(calls[-1][0]) == n and not calls[-1][1], name


def test_effective_sample_size(spark):
    traces = {0: [3] * 8, 1: [1, 2, 3], 2: [0, 1] * 6, 3: [0, 0, 0, 1, 1, 1, 0, 0, 0, 1, 1, 1]}
    t = spark.createDataFrame([(c, i, v) for c, vs in traces.items() for i, v in enumerate(vs)], "chain long, iter long, k long")
    got = {r["chain"]: r["ess"] for r in evaluation.ess(t, ["chain"], "k").collect()}

    def want(vs):
        n, m = len(vs), sum(vs) / len(vs)
        var = sum((v - m) ** 2 for v in vs) / n
        rho = [1.0 if var == 0 else sum((vs[i] - m) * (vs[i + k] - m) for i in range(n - k)) / (n * var) for k in range(n // 2 + 1)]
        tau, k = 1.0, 1
        while k + 1 < len(rho) and round(rho[k] + rho[k + 1], 12) >= 0:
            tau, k = tau + 2 * (rho[k] + rho[k + 1]), k + 2
        return min(max(n / tau, 1.0), n)

    assert got[1] == 3 and got[0] == 1
    assert all(abs(got[c] - want(traces[c])) < 1e-9 for c in (2, 3))


def test_marginal_test_and_scorecard(spark):
    rng = random.Random(2)
    drawn = [(p, 0, i, 1 + (rng.random() < 0.5)) for p in (0, 1) for i in range(400)]
    trace = spark.createDataFrame(drawn, "partition_id long, chain_id int, iter int, k int")
    given = spark.createDataFrame([(1, 0.5), (2, 0.499), (3, 0.001), (4, 1e-9)], "k int, prob double")
    got = {(r["partition_id"], r["k"]): r["verdict"] for r in evaluation.k_marginal_test(trace, given).collect()}
    assert got == {(p, k): "inconclusive" if k == 3 else "pass" for p in (0, 1) for k in (1, 2, 3)}
    far = given.withColumn("prob", F.when(F.col("k") == 1, 0.8).otherwise(0.2))
    assert {r["verdict"] for r in evaluation.k_marginal_test(trace, far.filter("k < 3")).collect()} == {"fail"}
    trial = lambda sep, k, rmse=1.0, d2=2.0: (2, 20.0, sep, k, 2, 2, rmse, 1.0, d2)
    rules = lambda rows: {r["rule"]: r["passed"] for r in evaluation.sweep_scorecard(*(lambda t: (evaluation.sweep_curves(t), t))(spark.createDataFrame(rows, "n int, mu double, sep double, k int, k_flat int, k_count int, rmse double, oracle double, d2 double"))).collect()}
    good = [trial(0.0, 1), trial(0.0, 2), trial(5.0, 2), trial(10.0, 2)]
    assert all(rules(good).values())
    bad = rules([trial(0.0, 2), trial(5.0, 2, 1.4, 9.0), trial(10.0, 1)])
    assert [k for k, v in bad.items() if v] == ["floor against counts"]


def test_ranks_without_one_sort(spark):
    rng = random.Random(3)
    values = [(g, rng.choice([rng.random(), rng.random() * 1e6])) for g in (0, 1) for _ in range(300)]
    out = calibration.ranked(spark.createDataFrame(values, "g int, z double"), ["g"], "z").collect()
    for g in (0, 1):
        have = sorted((r["i"], r["z"]) for r in out if r["g"] == g)
        assert [z for _, z in have] == sorted(z for h, z in values if h == g) and [i for i, _ in have] == list(range(1, 301))
        assert {r["n"] for r in out if r["g"] == g} == {300}


def test_a_sync_written_twice_is_there_once(spark, tmp_path):
    path = f"{tmp_path}/archive"
    drawn = spark.createDataFrame([(p, 0, i, k, k % 2) for p in (0, 1) for i in (1, 2, 3) for k in range(4)], "partition_id long, chain_id int, iter int, loc_id long, cluster long")
    hyper = spark.createDataFrame([(i, 5.0) for i in (1, 2, 3)], "iter int, mu double")
    for sync in (1, 2, 2, 3, 1):
        tables.archive_samples(drawn.filter(F.col("iter") == sync), hyper.filter(F.col("iter") == sync), path, "flat", sync)
    key = lambda df: sorted((r["partition_id"], r["iter"], r["loc_id"], r["cluster"]) for r in df.collect())
    assert key(tables.read_archive(spark, path)) == key(drawn)
    assert key(tables.read_archive(spark, path, 1)) == key(drawn.filter("partition_id = 1"))
    assert spark.read.parquet(f"{path}/hyper").count() == 3


def test_boundary_pairs_merge(spark, monkeypatch):
    cols = "emitter_id long, partition_id long, x double, y double, sigma_x double, sigma_y double, sigma_xy double, n long, near_boundary boolean"
    em = spark.createDataFrame([(9, 0, 0.0, 0.0, 0.01, 0.01, 2e-5, 5, True), (4, 1, 0.012, 0.0, 0.01, 0.01, 0.0, 7, True), (5, 1, 0.03, 0.0, 0.01, 0.01, 0.0, 1, True), (6, 2, 0.5, 0.0, 0.01, 0.01, 0.0, 1, True), (7, 3, 0.505, 0.0, 0.01, 0.01, 0.0, 2, False)], cols)
    plans, write = [], consensus.settle
    monkeypatch.setattr(consensus, "settle", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if name == "merged" else None, write(df, name))[1])
    got = {r["emitter_id"]: r for r in consensus.dedup_boundary(em, 0.02).collect()}
    assert set(got) == {9, 5, 6, 7} and plans and not any("NestedLoop" in x for x in plans)
    a, b = 1 / (1e-8 - 4e-10 + 1e-10), 1 / (1e-8 + 1e-10)
    assert abs(got[9]["x"] - b * 0.012 / (a + b)) < 1e-12 and abs(got[9]["sigma_xy"] - a * 2e-5 / (a + b)) < 1e-15
    assert abs(got[9]["sigma_x"] - (1 / (2e4 + 1e-10)) ** 0.5) < 1e-12 and got[9]["n"] == 12 and got[5]["n"] == 1


def test_marginal_verdict(spark):
    rows_ = [(0, 1.0, "pass"), (0, None, "inconclusive"), (1, 9.0, "fail"), (1, 1.0, "pass"), (2, None, "inconclusive")]
    got = evaluation.k_marginal_verdict(spark.createDataFrame(rows_, "partition_id long, z double, verdict string")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 0, "pass"), (1, 2, 0, 1, "fail"), (2, 0, 1, 0, "inconclusive")]


def test_target_terms(spark):
    """Three clusters against sums written out by hand."""
    pts = spark.createDataFrame([(0, c, 0.01 * c + 0.001 * i, 0.0, 0.005, 0.005, 0.0) for c, n in ((1, 2), (2, 3), (3, 1)) for i in range(n)], "g int, cluster int, x double, y double, sigma_x double, sigma_y double, sigma_xy double")
    stats = clusters.cluster_stats(pts, ["g", "cluster"]).withColumn("local", F.lit(-1.5))
    area, shape, mu, rho, sizes = 0.2, 2.0, 5.0, 3.0, [2, 3, 1]
    k, n, lg = 3, 6, math.lgamma
    nb = lambda x, r, m: lg(x + r) - lg(r) - lg(x + 1) + r * math.log(r / (r + m)) + x * math.log(m / (r + m))
    ml = stats.select(F.sum(clusters.log_ml(*clusters.stats_columns(), F.lit(math.log(area)))).alias("s")).first()["s"]
    count = nb(n, k * shape, k * mu)
    prior = -rho * area + k * math.log(rho * area) - lg(k + 1)
    dm = lg(k * shape) - k * lg(shape) - lg(n + k * shape) + sum(lg(s + shape) for s in sizes)
    direct = sum(nb(s, shape, mu) for s in sizes) + sum(lg(s + 1) for s in sizes) - lg(n + 1)
    want = {"Decoupled": ml + count + prior, "DecoupledLocmix": -4.5 + count, "DMFlat": ml + count + dm + prior, "DMLocmix": -4.5 + count + dm, "DirectNegBinFlat": ml + direct + prior, "DirectNegBinLocmix": -4.5 + direct, "IPP": -4.5 + count + dm + prior, "FazelFlat": ml + count - n * math.log(k)}
    for target in scoring.TARGETS:
        got = scoring.log_target(stats, ["g"], target, area, shape, mu, rho, "local").first()["score"]
        assert abs(got - want[target]) < 1e-6, target


def test_pairs_of_rows_with_unlike_radii(spark):
    rng = random.Random(3)
    pts = [(i, rng.random(), rng.random(), s, s, 0.0) for i, s in enumerate([0.2, 0.05, 0.05, 0.0] + [rng.choice((0.001, 0.004, 0.011)) for _ in range(150)])]
    got = [(r["i"], r["j"]) for r in neighbors.neighbor_pairs(spark.createDataFrame(pts, LOCS)).collect()]
    want = [(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and math.dist(a[1:3], b[1:3]) < 3 * (a[3] + b[3])]
    assert sorted(got) == sorted(want)
    assert neighbors.neighbor_pairs(rows(spark, [(0, 0), (0, 0)]).withColumn("sigma_x", F.lit(0.0))).count() == 0


def test_nearest_matches_brute_force(spark):
    rng = random.Random(4)
    a = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(60)] + [(500.0, -3.0), (0.0, 9000.0)]
    b = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(90)] + [(499.0, 0.0)]
    got = sorted((r["loc_id"], r["rid"]) for r in neighbors.nearest(rows(spark, a), rows(spark, b).withColumnRenamed("loc_id", "rid"), "loc_id", "rid", 3).collect())
    assert got == sorted((i, j) for i, p in enumerate(a) for j in sorted(range(91), key=lambda j: (math.dist(p, b[j]), j))[:3])
    one = rows(spark, [(7, 7)]).withColumnRenamed("loc_id", "rid")
    assert neighbors.nearest(rows(spark, a), one, "loc_id", "rid", 2).count() == len(a)


@pytest.mark.parametrize("linear", [0, 4])
def test_nearest_on_crowded_and_far_rows(spark, monkeypatch, linear):
    """Two crowded spots, repeated rows and rows far off on either side: as brute force; a row without a position has none."""
    monkeypatch.setattr(neighbors, "_LINEAR", linear)
    rng = random.Random(6)
    spots = [(0.0, 0.0), (1e5, 3.0)]
    crowd = lambda n: [(x + rng.gauss(0, 0.001), y + rng.gauss(0, 0.001)) for x, y in spots for _ in range(n)]
    a, b = [*crowd(20), (-1e7, 5.0), (5e4, 1e4), (3e4, 0.0)], [*crowd(1500), *[(2.0, 2.0)] * 30, (9e8, -9e8)]
    right = rows(spark, b).withColumnRenamed("loc_id", "rid")
    for k in (1, 4) if linear == 0 else (3,):
        got = sorted((r["loc_id"], r["rid"]) for r in neighbors.nearest(rows(spark, a), right, "loc_id", "rid", k).collect())
        far = lambda p, j: math.sqrt((p[0] - b[j][0]) ** 2 + (p[1] - b[j][1]) ** 2)
        assert got == sorted((i, j) for i, p in enumerate(a) for j in sorted(range(len(b)), key=lambda j: (far(p, j), j))[:k])
    lost = rows(spark, [(1, 1)]).withColumn("x", F.lit(None).cast("double"))
    assert neighbors.nearest(lost, right, "loc_id", "rid").count() == 0
    assert neighbors.nearest(rows(spark, a), lost.withColumnRenamed("loc_id", "rid"), "loc_id", "rid").count() == 0


def test_pieces_along_the_curve(spark):
    rng = random.Random(5)
    pts = [(0, i, rng.choice((0.1, rng.random())), rng.choice((0.1, rng.random()))) for i in range(130)] + [(1, 200 + i, 0.0, float(i)) for i in range(20)]
    got = graph.split_oversized(spark.createDataFrame(pts, "component long, loc_id long, x double, y double"), 50).collect()
    sizes = {}
    for r in got:
        sizes.setdefault((r["component"], r["n_pieces"], r["piece"]), []).append(r["loc_id"])
    assert sorted((c, n, p, len(v)) for (c, n, p), v in sizes.items()) == [(0, 3, 0, 44), (0, 3, 1, 43), (0, 3, 2, 43), (1, 1, 0, 20)]


def test_rows_without_ids_are_numbered_densely(spark, tmp_path):
    df = rows(spark, [(i, i) for i in range(30)]).drop("loc_id").repartition(7)
    df.write.parquet(str(tmp_path / "locs"))
    ids = sorted(r["loc_id"] for r in tables.read_locs(spark, str(tmp_path / "locs")).collect())
    assert ids == list(range(30))


def test_bridges_are_cut(spark):
    """Two dense blobs with one row between them; the bridge's row goes with its nearest neighbour."""
    pts = [(0.001 * i, 0.0) for i in range(12)] + [(0.2 + 0.001 * i, 0.0) for i in range(12)] + [(0.1, 0.0)]
    pairs = [(i, j) for g in (range(12), range(12, 24)) for i in g for j in g if i < j] + [(11, 24), (12, 24)]
    table = spark.createDataFrame([(i, j, math.dist(pts[i], pts[j]), 0.02) for i, j in pairs], "i long, j long, d double, s double")
    labels = spark.createDataFrame([(i, 0) for i in range(25)], "loc_id long, component long")
    got = {r["loc_id"]: r["component"] for r in graph.refine_bridges(labels, table, 10, 0.5).collect()}
    assert got == {i: 0 for i in range(12)} | {i: 12 for i in range(12, 24)} | {24: 0}
    whole = {r["component"] for r in graph.refine_bridges(labels, table, 13, 0.5).collect()}
    assert whole == {0}


def test_twins_at_a_seam_are_merged(spark):
    cols = "emitter_id long, partition_id long, x double, y double, sigma_x double, sigma_y double, sigma_xy double, n long, near_boundary boolean"
    em = [(1, 1, 0.0, 0.0, 0.01, 0.01, 0.0, 4, True), (2, 2, 0.01, 0.0, 0.01, 0.01, 0.0, 6, True), (3, 2, 0.5, 0.0, 0.01, 0.01, 0.0, 5, True), (4, 1, 0.505, 0.0, 0.01, 0.01, 0.0, 2, False)]
    got = {r["emitter_id"]: r for r in consensus.dedup_boundary(spark.createDataFrame(em, cols), 0.05).collect()}
    assert set(got) == {1, 3, 4} and got[1]["n"] == 10
    assert got[1]["x"] == pytest.approx(0.005) and got[1]["sigma_x"] == pytest.approx(0.01 / 2**0.5)
    assert got[3]["x"] == 0.5 and got[4]["n"] == 2


def test_consensus_over_samples(spark):
    """Three samples of one split and one with everything together: the split wins, means are the rows' own."""
    locs = rows(spark, [(0, 0), (0.01, 0), (0, 0.01), (1, 1), (1.01, 1), (1, 1.01)])
    s = [(0, 0, it, i, (i // 3) + it * 10) for it in (1, 2, 3) for i in range(6)] + [(0, 0, 4, i, 7) for i in range(6)]
    smp = spark.createDataFrame(s, "partition_id long, chain_id long, iter long, loc_id long, cluster long")
    p = samples.psm(smp)
    best = {r["loc_id"]: (r["iter"], r["cluster"]) for r in consensus.dahl(smp, p).collect()}
    assert best == {i: (1, 10 + i // 3) for i in range(6)}
    em = {r["cluster"]: r for r in consensus.mapn_overlap(smp, locs, p).collect()}
    assert set(em) == {10, 11} and all(r["n"] == 3 for r in em.values())
    assert em[10]["x"] == pytest.approx(0.01 / 3) and em[11]["y"] == pytest.approx(1 + 0.01 / 3)
    assert em[10]["sigma_x"] == pytest.approx(0.01 / 3**0.5)


@pytest.fixture(scope="module")
def drawn(spark):
    """Two overlapping partitions of six samples; one row is in a cluster twice, some rows or labels are missing."""
    r = random.Random(3)
    s = [(p, c, i, n, r.randrange(4)) for p in range(2) for c in range(2) for i in range(3) for n in range(p * 5, p * 5 + 9) if r.random() < 0.8]
    s += [(1, 0, 1, 6, 2), (1, 0, 1, 6, 2), (1, 0, 1, None, 1), (1, 0, 9, 12, None)]
    return spark.createDataFrame(s, "partition_id long, chain_id int, iter int, loc_id long, cluster long")


def plain_pairs(s):
    """p of pairs by partition, by plain loops."""
    got, runs = {}, {}
    for r in s:
        runs.setdefault(r[0], set()).add(tuple(r[1:3]))
    for a in s:
        for b in s:
            if a[:3] == b[:3] and None not in (a[3], a[4], b[3]) and a[4] == b[4] and a[3] < b[3]:
                got[a[0], a[3], b[3]] = got.get((a[0], a[3], b[3]), 0) + 1
    return {k: n / len(runs[k[0]]) for k, n in got.items()}


def plan(df):
    return df._jdf.queryExecution().toString()


def test_pairs_of_samples_without_a_join(drawn):
    p = samples.psm(drawn)
    assert {(r["partition_id"], r["i"], r["j"]): r["p"] for r in p.collect()} == plain_pairs([tuple(r) for r in drawn.collect()])
    assert "Join" not in plan(p)  # no table has a row for each pair and sample


@pytest.mark.parametrize("entries", [1, 20, 1 << 21])
def test_sums_over_pairs_in_blocks(monkeypatch, entries):
    monkeypatch.setattr(together, "ENTRIES", entries)
    r = np.random.default_rng(2)
    for n, width in ((9, 4), (4, 9)):
        row, col = r.integers(0, n, 40), r.integers(0, width, 40)
        h = np.zeros((n, width))
        np.add.at(h, (row, col), 1)
        g, up = h @ h.T, np.triu(np.ones((n, n)), 1)
        whole, pairs, inside = together.Together(np.arange(n), row, col, width).sums()
        assert whole == (g * g * up).sum()
        assert pairs.tolist() == [(np.outer(c, c) * up).sum() for c in h.T] and inside.tolist() == [(np.outer(c, c) * g * up).sum() for c in h.T]


def test_association_distance_without_pairs(drawn):
    key = lambda df: {tuple(r)[:3]: r["distance"] for r in df.collect()}
    d = consensus.association_distance(drawn)
    assert key(d) == pytest.approx(key(consensus.association_distance(drawn, samples.psm(drawn))), abs=1e-9) and len(key(d)) == 13
    assert "Join" not in plan(d)


@pytest.mark.parametrize("query", [chains.h6, chains.h7, chains.h9, chains.h10, chains.h11])
def test_consensus_queries_store_no_pairs(spark, many_pairs, monkeypatch, query):
    stored = []
    for m in (chains.N, chains.H):
        monkeypatch.setattr(m, "settle", lambda df, name: stored.append(df.columns) or tables.settle(df, name))
    assert query(spark, many_pairs).count()
    assert not any({"i", "j"} <= set(c) for c in stored)


def test_stability_without_pairs(drawn):
    labels = drawn.filter("chain_id = 0 and iter = 0 and loc_id < 13").unionByName(drawn.limit(1).selectExpr("cast(7 as long) as partition_id", "chain_id", "iter", "loc_id", "cluster"))
    key = lambda df: {(r["partition_id"], r["cluster"]): (r["n"], pytest.approx(r["stability"], abs=1e-12)) for r in df.collect()}
    got = key(consensus.cluster_stability(labels, samples=drawn))
    assert got == {k: (n, s.expected) for k, (n, s) in key(consensus.cluster_stability(labels, samples.psm(drawn))).items()} and len(got) > 4


def test_components_of_a_partition_are_its_own(spark):
    """Rows 1 and 2 are together only in partition 1: in partition 0 they stay apart."""
    s = [(p, 0, i, n, c) for i in (1, 2) for p, n, c in ((0, 1, 1), (0, 2, 2), (0, 3, 1), (1, 1, 5), (1, 2, 5))]
    smp = spark.createDataFrame(s, "partition_id long, chain_id long, iter long, loc_id long, cluster long")
    members = smp.select("partition_id", "loc_id").distinct().unionByName(spark.createDataFrame([(1, 9)], "partition_id long, loc_id long"))
    assert {r["partition_id"]: r["k"] for r in consensus.psm_components(smp, members).collect()} == {0: 2, 1: 2}


def test_rows_are_not_broadcast(spark, many_pairs):
    s, locs = fixtures.samples(spark, many_pairs), fixtures.locs(spark, many_pairs)
    for df in (consensus.sample_emitters(s, locs), consensus.contingency(s, s.filter("iter = 1"))):
        assert "Broadcast" not in plan(df)


@pytest.mark.parametrize("cov", [0.0, 4e-5])
def test_local_means_on_a_grid(spark, cov):
    """Grid and look-up against plain loops, and no table of cells and rows."""
    r = random.Random(4)
    pts = [(g, r.random() / 10, r.random() / 10, 0.01 + r.random() / 200, 0.01, cov) for g in (1, 2) for _ in range(5)]
    df = spark.createDataFrame(pts, "g long, x double, y double, sigma_x double, sigma_y double, sigma_xy double")
    grid = scoring.locmix_grid(df, ["g"])
    assert "Join" not in plan(grid) and "BroadcastExchange" not in plan(grid)
    got = {(c["g"], c["ix"], c["iy"]): c for c in grid.collect()}
    for (g, ix, iy), c in got.items():
        each = []
        for _, x, y, a, b, k in (p for p in pts if p[0] == g):
            dx, dy, det = c["x0"] + ix * c["h"] - x, c["y0"] + iy * c["h"] - y, a * a * b * b - k * k
            each.append(math.exp(-0.5 * (b * b * dx * dx - 2 * k * dx * dy + a * a * dy * dy) / det) / (2 * math.pi * det**0.5))
        if (s := sum(each)) > 1e-250:
            assert c["logg"] == pytest.approx(math.log(s / 5), abs=1e-9)
    asked = spark.createDataFrame([(1, 7, 0.03, 0.04), (1, 8, -9.0, 0.05), (2, 7, 0.5, 0.01), (3, 7, 0.0, 0.0)], "g long, k long, x double, y double")
    key = lambda d: {(v["g"], v["k"]): v["logg"] for v in d.collect()}
    assert key(scoring.locmix_lookup(asked, df, ["g"], ["k"])) == pytest.approx(key(scoring.bilinear(asked, grid, ["g"], ["k"])))


def test_near_rows_are_connected_by_few_links(spark):
    r = random.Random(5)
    pts = [(i, r.random(), r.random() / 4, 0.002 * 4 ** r.randrange(3), 0.003, 0.0) for i in range(250)] + [(300, 0.5, 0.1, 0.0, 0.0, 0.0), (301, 0.5, 0.1, None, 0.1, 0.0)]
    pts += [(400 + i, 3 + i / 1e5, 0.0, 0.01, 0.01, 0.0) for i in range(100)]
    df = spark.createDataFrame(pts, LOCS)
    key = lambda d: {v["loc_id"]: v["component"] for v in d.collect()}
    want = key(graph.components(df, neighbors.neighbor_pairs(df)))
    assert key(graph.near_components(df)) == want and 5 < len(set(want.values())) < 200
    assert neighbors.near_links(df).filter("a >= 400").count() == 99  # of 4950 pairs


def test_density_clusters_without_kept_pairs(spark, monkeypatch):
    r = random.Random(6)
    df = rows(spark, [(r.gauss(k, 0.05), r.gauss(0, 0.05)) for k in range(3) for _ in range(40)] + [(0.5, 0.0), (9, 9)])
    key = lambda d: {v["loc_id"]: v["cluster"] for v in d.collect()}
    want = key(graph.density_clusters(df, neighbors.neighbor_pairs(df), 12))
    stored = []
    monkeypatch.setattr(graph, "settle", lambda d, name: stored.append(d.columns) or tables.settle(d, name))
    assert key(graph.density_clusters(df, None, 12)) == want and len(set(want.values())) > 2
    assert not any({"i", "j"} <= set(c) for c in stored)


def test_pairs_are_counted_at_all_taus_as_they_are_found(spark, many_pairs, monkeypatch):
    locs = fixtures.locs(spark, many_pairs)
    want = {t: neighbors.neighbor_pairs(localizations.apply_tau(locs, t)).count() for t in (0.0, 0.002, 0.005)}
    monkeypatch.setattr(joins.N, "candidate_count", lambda *a: 1 << 40)  # however many there are
    assert {v["tau"]: v["n"] for v in joins.c3(spark, many_pairs).collect()} == want


def test_an_archive_has_as_many_folders_however_many_partitions(spark, tmp_path):
    path = f"{tmp_path}/archive"
    draw = lambda ids, sync: spark.createDataFrame([(p, 0, sync, p * 10 + n, n) for p in ids for n in range(2)], "partition_id long, chain_id int, iter int, loc_id long, cluster long")
    hyper = spark.createDataFrame([(1, 1.0)], "iter int, mu double")
    tables.archive_samples(draw(range(300), 1), hyper, path, "flat", 1)
    tables.archive_samples(draw(range(100), 1), hyper, path, "flat", 1)  # again, some of them
    got = tables.read_archive(spark, path)
    assert got.count() == 600 and got.select("partition_id", "loc_id").distinct().count() == 600
    assert len(list((tmp_path / "archive" / "samples").glob("*=*"))) <= tables.BUCKETS
    one = tables.read_archive(spark, path, 7)
    assert {r["loc_id"] for r in one.collect()} == {70, 71} and len(one.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_lags_without_a_row_for_each(spark):
    """Gaps and twins in the iterations, missing values; no join of a chain with itself."""
    chains_ = {0: [(i, i * i % 7) for i in range(12)], 1: [(3 * i, i % 4) for i in range(9)], 2: [(0, 1), (0, 2), (1, 5), (2, None), (4, 2), (5, 1)]}
    t = spark.createDataFrame([(c, i, k) for c, v in chains_.items() for i, k in v], "chain long, iter long, k long")
    df = evaluation.autocorrelation(t, ["chain"], "k", 500, 2)
    assert "Join" not in plan(df)
    got = {(r["chain"], r["lag"]): r["rho"] for r in df.collect()}
    for c, v in chains_.items():
        some = [k for _, k in v if k is not None]
        m, n = sum(some) / len(some), len(v)
        var = sum((k - m) ** 2 for k in some) / len(some)
        for lag in range(n // 2 + 1):
            s = sum((a - m) * (b - m) for i, a in v for j, b in v if j == i + lag and None not in (a, b))
            assert got.pop((c, lag)) == pytest.approx(s / (n * var))
    assert not got
