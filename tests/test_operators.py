import random
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import semantics
from rankloom.operators import align as A
from rankloom.operators import board as B
from rankloom.operators import rules as L
from rankloom.operators import selection as S
from rankloom.operators import study as U
from rankloom.operators import texts as X
from rankloom.operators import views as V
from rankloom.plans import boards
from rankloom.sources import readers as R
from rankloom.streaming import log
from tests.schemas import RECORDS, record, source


def scores(spark, cells):
    return spark.createDataFrame([(b, m, float(v)) for b, ms in cells.items() for m, v in ms.items()], "benchmark string, model string, score double")


def test_normalised_edges(spark):
    y = scores(spark, {"A": {"x": 0.1, "y": 0.5, "z": 0.9}, "C": {"x": 0.5, "y": 0.5, "z": 0.5}, "S": {"x": 3}})
    got = {(r.benchmark, r.model): (r.score_rank, r.score_pct, r.score_z) for r in A.normalised(y).collect()}
    assert [got["A", m][0] for m in "xyz"] == [0, 0.5, 1] and got["C", "x"] == (0.5, 0.5, 0.0) and got["S", "x"] == (0.5, 0.0, 0.0)


def test_rank_similarity(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, 9), rng.integers(0, 4, 9)
    y = scores(spark, {"A": {f"m{i}": v for i, v in enumerate(a)}, "B": {f"m{i}": v for i, v in enumerate(b)}, "K": {f"m{i}": 1 for i in range(9)}, "T": {"m0": 1, "m1": 2}})
    got = {(r.p, r.q): (r.common_count, r.r) for r in A.rank_similarity(y, 3).collect()}
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() - 1) / 2 for x in v])
    assert got["A", "B"][1] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    assert got["A", "K"] == (9, None) and got["A", "T"] == (2, None)
    whole = {(r.p, r.q): r.common_count for r in A.all_pairs(scores(spark, {"A": {"x": 1}, "B": {"y": 1}}), A.rank_similarity(y, 3).limit(0)).collect()}
    assert whole == {("A", "B"): 0}


def test_cosine_and_gap(spark):
    tags = spark.createDataFrame([("A", "t1", 1.0), ("B", "t2", 1.0), ("C", "t1", 1.0), ("C", "t2", 1.0), ("Z", "t1", 0.0)], "benchmark string, tag string, weight double")
    got = {(r.p, r.q): r.s for r in A.tag_similarity(tags).collect()}
    assert got == {("A", "C"): pytest.approx(0.5**0.5), ("B", "C"): pytest.approx(0.5**0.5)}
    pairs = spark.createDataFrame([("a", "b", 0.9, 0.8, 0.9), ("a", "c", 0.1, -0.1, 0.45), ("b", "c", 0.5, 0.2, 0.6)], "p string, q string, s double, r double, r01 double")
    g = A.tag_gap(pairs, 0.2, 0.8).first()
    assert (g.intra, g.inter, g.delta_tag) == (pytest.approx(0.8), pytest.approx(-0.1), pytest.approx(0.9))
    assert A.alignment_loss(pairs).first().l_align == pytest.approx((0.01 + 0.04 + 0.09) / 3)
    lined = pairs.withColumn("r", 2 * F.col("s") - 1)
    c = A.alignment_correlation(lined).first()
    assert (c.rho_p, c.rho_s) == (pytest.approx(1), pytest.approx(1))
    flat = A.alignment_correlation(pairs.withColumn("s", F.lit(0.5))).first()
    assert flat.rho_p is None


def test_levels(spark):
    rows = spark.createDataFrame([("Strong ",), ("none",), (None,), ("dominant",)], "x string").select(semantics.level_weight(F.col("x"))).collect()
    assert [r[0] for r in rows] == [0.75, 0.0, 0.0, 1.0]


def test_merge_mixed_and_dated(spark):
    kinds = spark.createDataFrame([("manual", 4), ("tech_report", 5)], "kind string, trust int")
    rows = [
        record(1, 1.0, source=source("manual", published="2025-02-01")),
        record(2, 2.0, source=source("tech_report", published="2025-01-01")),
        record(3, 3.0, model="mix", source=source("manual", published="2025-02-01")),
        record(4, 4.0, model="mix", source=source("tech_report")),
        record(5, None, model="none"),
    ]
    rows += [record(6, 3.0, model="host", source=source("tech_report", "https://www.again.example/x")), record(7, 2.0, model="host", source=source("manual", "https://own.example/x")), record(8, 1.0, model="host", source=source("manual", "https://own.example/x"), extra='{"user_correction": true}')]
    rows += [record(9, 5.0, model="same", variants=[(5.0, " ", None), (5.0, None, None), None, (5.25, "x", None), (5.2, "X ", None), (9.0, "y", None), (8.0, "y", None)])]
    r = spark.createDataFrame(rows, RECORDS)
    got = {r.model_id: (r.score, r.variants) for r in B.merged(r, kinds, ("again.example",)).collect()}
    assert got == {"m": (1.0, 1), "mix": (4.0, 1), "host": (1.0, 2), "same": (9.0, 4)}
    order = {m: [x.record_id for x in sorted((x for x in B.variants(r, kinds, ("again.example",)).collect() if x.model_id == m), key=lambda x: x.place)] for m in ("host", "m")}
    assert order == {"host": [8, 7, 6], "m": [1, 2]}
    kept = {(x.config, x.score) for x in B.deduplicated(r, kinds).collect() if x.model_id == "same"}
    assert kept == {("", 5.0), ("x", 5.25)}
    assert B.merged(r.limit(0), kinds).count() == 0


def test_relevance(spark):
    tags = spark.createDataFrame([("A", "t1", 1.0), ("A", "t2", 0.0), ("B", "t1", 0.5), ("B", "t2", 0.5), ("Z", "t1", 0.0)], "benchmark string, tag string, weight double")
    got = [(r.benchmark, round(r.relevance, 6)) for r in B.relevance(tags, {"t1": 1.0}).collect()]
    assert got == [("A", 1.0), ("B", round(0.5**0.5, 6)), ("Z", 0.0)]
    with pytest.raises(ValueError):
        B.relevance(tags, {})
    with pytest.raises(ValueError):
        B.relevance(tags, {"t9": 1.0})
    assert B.greedy_cover(tags, 2) == ["A", "B"] and all(len(B.k_medoids(tags, k, seed)) == k for k in (1, 2, 3) for seed in range(5))


def test_resampling(spark):
    rng = np.random.default_rng(1)
    s = rng.random(60)
    pairs = spark.createDataFrame([(f"p{i // 12}", f"q{i:02}", float(v), float(v + rng.normal() * 0.1)) for i, v in enumerate(s)], "p string, q string, s double, r double")
    boot = U.pair_bootstrap(pairs, 40, 3).toPandas()
    assert (boot.n == 60).all() and boot.rho_p.between(0.8, 1).all() and len(set(boot.l_align)) > 30
    block = U.block_bootstrap(pairs, 40, 3).toPandas()
    assert block.n.nunique() > 10 and block.rho_p.dropna().between(0.5, 1).all()
    p = {r.metric: r for r in U.permutation_test(pairs, 999, 3).collect()}
    assert p["rho_p"].draws == 999 and p["rho_p"].p_two_sided == pytest.approx(0.001) and p["l_align"].p_low == pytest.approx(0.001) and abs(p["rho_s"].null_sd - 60**-0.5) < 0.02
    deltas = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", None)], "name string, delta double")
    assert tuple(U.sign_flips(deltas).first()) == (3, 1.0, pytest.approx(3 / 9))
    assert all(r.n == 0 and r.rho_p is None for r in U.pair_bootstrap(pairs.limit(0), 3, 1).collect()) and U.permutation_test(pairs.limit(0), 3, 1).count() == 0


def test_probes_against_brute_force(spark):
    rng = np.random.default_rng(4)
    y = {(b, m): float(rng.integers(0, 4)) for b in "ABCD" for m in "tuvwxyz" if rng.random() < 0.9}
    tags = spark.createDataFrame([(b, t, float(w)) for b in "ABCD" for t, w in zip("pq", rng.random(2))], "benchmark string, tag string, weight double")
    frame = lambda cells: spark.createDataFrame([(b, m, v) for (b, m), v in cells.items()], "benchmark string, model string, score double")
    sim = A.tag_similarity(tags)
    got = {r.dropped: (r.n_pairs, round(r.l_align, 4)) for r in U.probes(A.common_scores(frame(y)), sim, 4).collect()}
    for m in "tux":
        rest = A.aligned(sim, A.rank_similarity(frame({k: v for k, v in y.items() if k[1] != m}), 4))
        want = A.alignment_loss(rest).first()
        assert got[m] == (want.n_pairs, pytest.approx(want.l_align, abs=1e-4))


def test_splits(spark):
    names = spark.createDataFrame([(f"b{i:02}",) for i in range(23)], "benchmark string")
    folds = U.plain_folds(names, "benchmark", 5, 1).toPandas().fold.value_counts()
    assert sorted(folds) == [4, 4, 5, 5, 5]
    fam = spark.createDataFrame([(f"{f}-{i}",) for f, n in (("a", 7), ("b", 2), ("c", 1), ("d", 1), ("e", 5)) for i in range(n)], "id string")
    rows = U.family_split(fam, "id", F.substring_index("id", "-", 1), 0.75, 3).collect()
    assert sum(r.scope == "seen" for r in rows) == 12 and {r.scope for r in rows if r.id.startswith("b")} == {"seen", "held"}
    pairs = spark.createDataFrame([(f"b{i:02}", f"b{j:02}", -0.9 if i % 2 == j % 2 else 0.5) for i in range(8) for j in range(i + 1, 8)], "p string, q string, r double")
    got = U.balanced_folds(pairs, names.limit(8), 4, 1, 200).toPandas()
    assert (got.fold.value_counts() == 2).all() and got.total.iloc[0] == 0
    with pytest.raises(ValueError):
        U.balanced_folds(pairs, names.limit(1), 2, 1)


def test_gates_and_replay(spark):
    rows = [(0, 0, 0.5, 0.40, 0.3, 0.3, 0.3, 0.1, 5), (0, 1, 0.5, 0.30, 0.3, 0.3, 0.3, -0.1, 5), (0, 2, 0.5, 0.30, 0.3, 0.3, 0.2, 0.2, 5), (0, 3, 0.5, 0.30, 0.3, 0.3, 0.4, 0.2, 5), (0, 4, 0.5, None, 0.3, 0.3, 0.4, 0.2, 5), (0, 5, 0.5, float("nan"), 0.3, 0.3, 0.9, 0.2, 5)]
    c = spark.createDataFrame(rows, "fold int, iter int, train_l double, dev_l double, train_rho double, dev_rho double, dev_rho_p double, delta_tag double, tag_count int")
    got = [(r.improved, r.reason, r.stall, r.best) for r in S.replay(c).orderBy("iter").collect()]
    assert got == [(True, "new_best", 0, 0), (False, "delta_tag_gate_failed", 1, 0), (True, "new_best", 0, 2), (True, "new_best", 0, 3), (False, "not_better_than_current_best", 1, 3), (False, "not_better_than_current_best", 2, 3)]
    one = spark.range(1)
    gate = lambda x, t: one.select(S.passes_delta(F.lit(x).cast("double"), t)).first()[0]
    assert [gate(0.0, 0.0), gate(0.1, 0.0), gate(-0.1, -0.1), gate(float("nan"), 0.0), gate(None, 0.0)] == [False, True, True, False, False]
    assert S.config_faults({}) and len(S.config_faults({"min_common_models": 6, **{f"min_{x}_{y}": 10 for x in ("train", "dev", "test") for y in ("valid_pairs", "effective_benchmarks")}, "require_held_model_test": True, "score_model_scope": "seen", "fallback_to_seed": False, "allow_uniform_fallback": False, "json_contract_strict": True})) == 0
    ranged = S.running_best(spark.createDataFrame([(f"r{i:03}", float(i * 7 % 50)) for i in range(100)], "run_id string, mean double"), "run_id", "mean", 13)
    best = None
    for r in ranged.orderBy("run_id").collect():
        assert r.before == best
        best = max(best or 0.0, r["mean"]) if best is not None else r["mean"]


def test_matrix_work(spark):
    rng = np.random.default_rng(2)
    a = rng.random((6, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    long = lambda m, *seed: [(*seed, f"b{i}", f"x{j}", float(m[i, j])) for i in range(6) for j in range(3)]
    ref = spark.createDataFrame(long(a), "benchmark string, axis string, weight double")
    runs = spark.createDataFrame(long(a @ q, 1) + long(rng.random((6, 3)), 2), "seed int, benchmark string, axis string, weight double")
    got = {r.seed: r for r in U.procrustes(runs, "seed", ref).collect()}
    assert got["1"].residual < 1e-9 and got["1"].correlation == pytest.approx(1) and got["2"].residual > 0.1
    tags = ref.withColumnRenamed("axis", "tag")
    pairs = spark.createDataFrame([(f"b{i}", f"b{j}", 0.2 if (i + j) % 2 else 0.9) for i in range(6) for j in range(i + 1, 6)], "p string, q string, r double")
    fit = U.optimized_weights(tags, pairs, starts=2).collect()
    assert all(r.loss < 0.6 * r.initial_loss for r in fit if r.start == 1) and all(0 <= w.weight <= 1 for r in fit for w in r.weights)
    grid = {r.effect: r.power for r in U.power_grid(spark, [10], [20], [0.0, 0.9], 30).collect()}
    assert grid[0.9] > 0.9 and grid[0.0] < 0.3


def test_contamination(spark):
    y = scores(spark, {"A": {f"m{i}": v for i, v in enumerate((96, 97, 98, 99, 95))}, "A-pro": {f"m{i}": 60 for i in range(3)}, "B": {"m0": 1, "m1": 2}, "C": {"m0": 10, "m1": 20, "m2": 30}})
    hard = spark.createDataFrame([("A", "A-pro"), ("C", "C")], "benchmark string, hard string")
    got = {r.benchmark: r for r in B.contamination(y, hard).collect()}
    assert set(got) == {"A", "A-pro", "C"} and got["A"].saturated and got["A"].risk == "high" and got["A"].hard_pairs == 3 and got["C"].risk == "low" and got["C"].ceiling == 0


def test_corrections_all_or_nothing(spark):
    y = scores(spark, {"A": {"x": 0.5, "y": 0.6}})
    fix = lambda *rows: spark.createDataFrame(rows, "benchmark string, model string, old double, new double")
    assert {(r.model, r.score) for r in B.all_corrected(y, fix(("A", "x", 0.5, 0.7))).collect()} == {("x", 0.7), ("y", 0.6)}
    with pytest.raises(ValueError):
        B.all_corrected(y, fix(("A", "x", 0.5, 0.7), ("A", "z", 0.5, 0.7)))


def test_corrections_meet_one_reading_of_the_matrix(spark, monkeypatch):
    """Each reading of this matrix has other scores, as means near the middle of two roundings have."""
    drawn = F.udf(lambda model: random.random(), "double").asNondeterministic()
    cells = spark.createDataFrame([("A", f"m{i}") for i in range(200)], "benchmark string, model string")
    monkeypatch.setattr(boards, "matrix", lambda s, d: cells.withColumn("score", drawn("model")))
    got = boards.jn11_corrections(spark, "").collect()
    assert len(got) == 200 and 0 < sum(r.corrected for r in got) < 100
    assert {r.reason for r in boards.jn11_mismatches(spark, "").where("model >= 'm' AND model NOT LIKE '%?'").collect()} == set()


def test_corrections_round_as_the_sql(spark, monkeypatch):
    values = [i / 1e7 for i in range(5, 10_000_000, 99_990)]
    cells = spark.createDataFrame([("A", f"m{i}", v) for i, v in enumerate(values)], "benchmark string, model string, score double")
    monkeypatch.setattr(boards, "matrix", lambda s, d: cells)
    got = {r.model: (r.score, r.corrected) for r in boards.jn11_corrections(spark, "").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE y AS SELECT 'A' AS benchmark, 'm' || i AS model, v AS score FROM (SELECT unnest(?) AS v, unnest(range(?)) AS i)", [values, len(values)])
    assert got == {m: (s, c) for _, m, s, c in con.execute(boards._SELECTS["jn11_corrections"]).fetchall()}


def test_graph_and_texts(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), *[(f"n{i:02}", f"n{i + 1:02}") for i in range(20)]], "p string, q string")
    got = {}
    for r in X.min_label(pairs).collect():
        got.setdefault(r.component, set()).add(r.name)
        assert r.size == {"a": 3, "x": 2, "n00": 21}[r.component]
    assert got["a"] == {"a", "b", "c"} and got["x"] == {"x", "y"} and len(got["n00"]) == 21
    one = spark.range(1)
    names = {"openai/Some-Model-2_high-32k (16K thinking)": ("Some-Model-2", "high, 32K, 16K thinking"), "m-2025-08-07-preview": ("m-2025-08-07", None), "m-2025-08-07": ("m", None), "grok-4-20": ("grok-4-20", None), "a-exp_max": ("a", "max"), " x ": ("x", None), "": ("", None)}
    rows = spark.createDataFrame([(x,) for x in names], "x string")
    base, tag = X.split_name(F.col("x"))
    assert {r.x: (r.b, r.t) for r in rows.select("x", base.alias("b"), tag.alias("t")).collect()} == names
    tokens = {"CoT, 0-shot, cot": "CoT, 0-shot", "No Tool, with tools,no tools": "no tools, with tools", "Pass@1": "pass@1", "": "default", None: "default"}
    assert {r.x: r.t for r in spark.createDataFrame([(x,) for x in tokens], "x string").select("x", X.config_tokens(F.col("x")).alias("t")).collect()} == tokens
    g = lambda c: one.select(c.alias("v")).first().v
    L = F.lit
    assert g(X.token_f1(L("the cat cat"), L("cat the dog"))) == pytest.approx(0.5) and g(X.token_f1(L("the"), L(None).cast("string"))) == 1.0
    assert g(X.grade_letter(L("B or C?\nAnswer: (c)"), L("C"))) == 1.0 and g(X.grade_letter(L("A\nD"), L("A"))) == 0.0
    assert g(X.grade_short(L("Answer: No, it does not."), L("No"))) == 1.0 and g(X.grade_short(L("answer - ] ]"), L("]]"))) == 1.0 and g(X.grade_short(L("Answer: b"), L("(B)"))) == 1.0 and g(X.grade_short(L("Nothing"), L("No"))) == 0.0
    assert g(X.grade_spans(L("Answer: Two empires"), F.array(L("2"), L("x")))) == 1.0 and g(X.grade_spans(L("Answer: red fox"), F.array(L("fox"), L("the red fox")))) == 1.0
    assert g(X.grade_boxed(L("so \\boxed{1} and \\boxed{\\dfrac{1}{2}}"), L("\\frac{1}{2}"))) == 1.0 and g(X.grade_boxed(L("Answer: 3.0"), L("3"))) == 1.0
    assert g(X.grade_last_number(L("1,200 and then 3.5 apples"), L("3.5"))) == 1.0 and g(X.last_number(L("none"))) == ""
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), *[(f"n{i}", f"n{i + 1}") for i in range(9)]], "parent string, child string")
    paths = {(r.ancestor, r.node): r.distance for r in X.closure(edges).collect()}
    assert paths["n0", "n9"] == 9 and paths["r", "b"] == 1 and paths["a", "a"] == 0 and len(paths) == 2 + 45 + 13


def test_readers(spark, tmp_path):
    text = spark.createDataFrame([('{"_meta": 1, "A": {"m": 0.5, "_alias": "x", "n": "bad"}}',), ('{"scores": {"B": {"m": "0.25"}}}',)], "value string")
    assert {tuple(r) for r in R.score_map(text).collect()} == {("A", "m", 0.5), ("B", "m", 0.25)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/y.txt", "hello")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = R.zip_members(spark.read.format("binaryFile").load(str(tmp_path / "*.zip"))).collect()
    assert {(r.path[-5:], r.member, r.text) for r in got} == {("a.zip", "x/y.txt", "hello"), ("b.zip", None, None)}
    (tmp_path / "c.csv").write_text('a,b\n"x ""y""\nz",1\nlone\n')
    assert [tuple(r) for r in R.csv_table(spark, str(tmp_path / "c.csv")).collect()] == [('x "y"\nz', "1"), ("lone", "")]
    (tmp_path / "d.jsonl").write_text('﻿{"a": 1}\n\n{broken\n')
    assert [(r.a, r._corrupt is None) for r in R.json_lines(spark, str(tmp_path / "d.jsonl"), "a int").collect()] == [(1, True), (None, False)]
    html = spark.createDataFrame([("<table><tr><th>n</th></tr><tr><td><b>M1</b></td><td>0.5</td></tr><tr><td>M2</td><td>61.5 %</td></tr></table>",)], "h string")
    assert [tuple(x) for x in html.select(R.table_rows(F.col("h")).alias("r")).first().r] == [("M1", 50.0), ("M2", 61.5)]
    ranges = lambda c: [tuple(x) for x in spark.range(1).select(c.alias("r")).first().r]
    assert ranges(R.all_ranges(F.lit(250))) == [(0, 100), (100, 100), (200, 50)] and ranges(R.all_ranges(F.lit(0))) == []
    assert ranges(R.sample_ranges(F.lit(10_000), 500)) == [(i * 2000, 100) for i in range(5)] and ranges(R.sample_ranges(F.lit(0), 30)) == [(0, 30)] and ranges(R.sample_ranges(F.lit(150), 200)) == [(0, 100), (100, 50)]
    for name, text in (("a.json", '[{"model_id": "m", "score": 1.5}]'), ("_b.json", '[{"model_id": "x"}]'), ("c.draft.json", '[{"model_id": "x"}]'), ("d.txt", "x"), ("e.json", "{broken")):
        (tmp_path / "scores").mkdir(exist_ok=True)
        (tmp_path / "scores" / name).write_text(text)
    assert [tuple(r) for r in R.score_files(spark, [str(tmp_path / "scores")], "model_id string, score double").collect()] == [("a.json", "m", 1.5)]
    with pytest.raises(ValueError):
        R.plan_faults(spark.createDataFrame([("a",)], "scope string"), ("a",))


def test_stream_keeps_latest(spark, tmp_path):
    schema = "k string, at int, v string"
    for n, rows in enumerate(([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z"), ("b", 0, "late")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = log.keep_latest(spark.readStream.schema(schema).json(str(tmp_path / "in")), ["k"], "at", str(tmp_path / "state"), str(tmp_path / "check"))
        q.awaitTermination(60)
    assert {tuple(r) for r in log.latest_state(spark, str(tmp_path / "state")).select("k", "v").collect()} == {("a", "z"), ("b", "y")}


def test_dropped_files_come_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a", "one"), ("b", "two"), ("c", "one")):
        (tmp_path / "in" / name).write_text(text)
    files = log.dropped_files(spark, str(tmp_path / "in")).select("sha")
    q = files.writeStream.format("memory").queryName("drops").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("drops").count() == 2


def test_rules(spark):
    one = spark.range(1)
    g = lambda c: one.select(c.alias("v")).first().v
    w = lambda x: L.words(F.lit(x))
    assert g(L.has_phrase(w("A Multiple-Choice test"), "multiple choice")) and not g(L.has_phrase(w("multiplechoice"), "multiple choice")) and not g(L.has_phrase(w(None), "a"))
    assert not g(L.has_unnegated(w("it is not a multiple choice"), "multiple choice")) and g(L.has_unnegated(w("not here, but in the end a multiple choice"), "multiple choice"))
    assert g(L.leaks_score(w("the model got a score"))) and not g(L.leaks_score(w("the score of the game"))) and not g(L.leaks_score(w("never a model score")))
    faults = lambda xs, n: g(L.pattern_faults(F.array(*map(F.lit, xs)), F.lit(n)))
    assert faults(["picks the selected option", "reads gpqa items", "adds numbers"], "GPQA Diamond") == ["leaks:0:selected_option", "names_benchmark:1"]
    assert g(L.pattern_faults(F.lit(None).cast("array<string>"), F.lit(None).cast("string"))) == []
    assert g(L.rationale_faults(F.lit("Strong"), F.lit("there is no evidence"), F.lit("x"))) == ["contradicts:strong:no evidence"] and g(L.rationale_faults(F.lit("absent"), F.lit("no evidence"), F.lit("x"))) == []
    c = lambda x: g(L.contract_faults(F.lit(x), ("a", "b"), ("c",), ("z",), ("c",), ("a",)))
    assert c('{"a": "x", "b": 1, "c": [1]}') == [] and c('{"a": " ", "z": 1, "q": 2, "c": {}}') == ["missing:b", "banned:z", "extra:q", "no_list:c", "empty:a"] and c("[1]") == ["no_object"] and c(None) == ["no_object"]
    p = lambda x: g(L.prompt_faults(F.lit(x), ("tag",), ("MATH",), (("metric", "correlation"),), 100, 3))
    assert p("tag by what is read. Do not mention correlation.") == [] and p("tag; never ignore correlation 0.75") == ["score_literal", "metric"] and p("MATH tag") == ["names:MATH"] and p("") == ["empty", "missing:tag"] and p("tag " * 90) == ["too_long"]
    t = lambda v, s: g(L.taxonomy_faults(F.array(*map(F.lit, v)), F.array(*map(F.lit, s)), 1))
    assert t("ab", "ab") == [] and t("abcde", "ab") == ["too_many_new"] and t("a", "ab") == ["seed_missing", "smaller_than_seed"] and t("abb", "ab") == ["duplicate_ids"]
    w8, drift = L.coerced_weights(F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("x"), F.lit("q"), F.lit("1")), ("a", "b", "c"))
    assert g(w8) == {"a": 1.0, "b": 0.0, "c": 0.0} and g(drift) == ["no_number:b", "dropped:1", "filled:1"]
    assert [g(L.level_of(F.lit(x))) for x in (" HIGH", "3", "2.0", "odd", None)] == ["strong", "medium", "weak", "absent", "absent"]
    assert g(L.snippet(F.lit("Long words here that go on. Observable evidence includes x"), 17)) == "Long words here." and g(L.snippet(F.lit(" "), 9)) == ""
    assert g(L.anonymous(F.lit("Benchmark: q\nUses (X+) and (x+)."), F.lit("(x+)"), F.lit("B1"))) == "Benchmark: B1\nUses B1 and B1."
    assert g(L.repo_name(F.lit("..My Repo!!"))) == "my-repo" and g(L.repo_name(F.lit("--"))) is None
    assert [L.salvaged(x)[0] for x in ('[1]', 'so ```json\n{"a": 1}\n``` there', 'x {"a": {"b": 2}} y', '[{"a": 1}, {"a": 2}, {"a"', "none", None, "[" * 200_000)] == ["whole", "fenced", "object", "rows", "none", "none", "none"]


def test_views(spark):
    models = spark.createDataFrame([("a", "Base", "V", ["A-1"]), ("b", "Base (high)", "v ", None), ("c", "Other (2024)", "V", ["A-1"]), ("d", "Odd (16K, thinking)", "V", [])], "id string, name string, vendor string, aliases array<string>")
    groups = {r.model_id: (r.group_id, r.config) for r in V.model_groups(models).collect()}
    assert groups == {"a": ("a", None), "b": ("a", "high"), "c": ("c", None), "d": ("d", "16K, thinking")}
    rows = spark.createDataFrame([("B", "A-1", 1.0, 2), ("B", "a", 2.0, 1), ("_m", "a", 3.0, 1), ("B", None, 1.0, 3), ("C", " A-1 ", None, 1)], "benchmark string, model string, score double, place int")
    assert {tuple(r) for r in V.leaderboard(rows.where("model is not null"), V.alias_table(models)).collect()} == {("B", "a", 2.0)}
    assert {tuple(r) for r in V.leaderboard(rows.where("model is not null"), V.alias_table(models), [], ["b"]).collect()} == set()
    names = spark.createDataFrame([("BASE",), ("a_1",), ("base(high)",), ("?",), ("",)], "x string")
    assert {r.x: r.resolved for r in V.resolved(names, "x", models).collect()} == {"BASE": "a", "a_1": "a", "base(high)": "b", "?": None, "": None}
    big = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    got = {(r.g, r.id): r.place for r in V.placed(big, ["g"], ["id"], 13).collect()}
    assert all(p == i // 2 for (_, i), p in got.items()) and len(got) == 100


def test_error_modes_count_every_flagged_pair(spark, monkeypatch):
    from rankloom.plans import alignment

    s = F.col("id") / 59_999
    pairs = spark.range(60_000).select(F.col("id").cast("string").alias("p"), F.lit("z").alias("q"), s.alias("s"), (1 - 2 * s).alias("r"), (1 - s).alias("r01"))
    monkeypatch.setattr(alignment, "pair_table", lambda *_: pairs)
    assert tuple(alignment.ag41_error_modes(spark, "").first()) == (12_000, 12_000, "mixed")
