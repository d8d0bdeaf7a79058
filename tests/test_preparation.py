import json
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.functions import cleaning, trees
from rankloom.operators import hotdeck, nested, units
from tests.schemas import BENCHMARKS, RECORDS, record, source


def test_days_and_instants(spark):
    texts = ["2025-03-07", " 2025/03/07", "20250307", "7 Mar 2025", "March 7, 2025", "2025-03-07T00:00:00Z", "2025-03", "March 2025", "n/a", "", None, "2025-13-40", "May 99, 2025"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(cleaning.publication_day(F.col("x")).cast("string")).collect()
    assert [r[0] for r in rows] == ["2025-03-07"] * 6 + ["2025-03-15"] * 2 + [None] * 5
    texts = ["2026-01-07T08:57:26Z", "2026-01-07T17:57:26+09:00", "1767776246000", "2026-01-07T08:57:26.000Z", "2026-01-07", "soon", None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(F.unix_seconds(cleaning.instant(F.col("x")))).collect()
    assert [r[0] for r in rows] == [1767776246] * 4 + [1767744000, None, None]


def test_page_key(spark):
    texts = ["https://a.example/x/y", "HTTP://www.A.EXAMPLE/x/y/", "a.example/x/y.git", "https://a.example/x/y/tree/main", "https://a.example/x/y?ref=b#c", "https://a.example/", "a.example", "tbd", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(cleaning.page_key(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["a.example/x/y"] * 5 + [None] * 5


def test_told_scale(spark):
    want = {"out of 5": 5, "default (out of 10)": 10, "no. correct out of 500": 500, "200 tasks, solved count": 200, "resolved /250; 0-shot": 250, "‰": 1000, "in bps": 10000, "max 1.0": 1, "acc (0–1)": 1, "x/10": 10, "five-star mean": 5, "accuracy, %": 100, "ACCURACY ,  %": 100, "100-point scale": 100, "first 500 items": None, "full set, n=1000": None, "top-10 vote": None, "10-fold mean": None, "temp=0": None, "default": None, "32K": None, None: None}
    rows = spark.createDataFrame([(x,) for x in want], "x string").select("x", units.told_scale(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in rows} == want


def test_units(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}
    for i in range(1500):
        m = i // 10 % 30
        model, pct = f"m{m}", float(np.round(20 + 2 * m + rng.normal(), 1))
        kind = i % 10
        config, score, full = {0: ("fraction", round(pct / 100, 3), 1), 1: ("per mille", pct * 10, 1000), 2: ("default", round(pct / 100, 3), 1), 3: ("percent", pct, 100)}.get(kind, ("default", pct, 100))
        rows.append(record(i, round(score, 3), model=model, config=config))
        if full != 100:
            truth[i] = full
    rows += [record(9000, None), record(9001, math.nan), record(9002, -1.0), record(9003, 1200.0, bench="elo"), record(9004, 50.0, config=None, bench=None, model=None)]
    b = spark.createDataFrame([("b", "B", "math", "percent"), ("elo", "Elo", "chat", "rating")], BENCHMARKS)
    found = {r.record_id: r.full_scale for r in units.not_percent(spark.createDataFrame(rows, RECORDS), b).collect()}
    assert len(found.items() & truth.items()) >= 0.97 * len(truth) and len(found.keys() - truth.keys()) <= 3
    out = {r.record_id: r for r in units.to_percent(spark.createDataFrame(rows, RECORDS), b).collect()}
    assert len(out) == len(rows) and out[9000].unit_status == "unusable" and out[9003].unit_status == "rating" and out[9003].score_percent == 1200.0
    empty = spark.createDataFrame([], RECORDS)
    assert units.not_percent(empty, b).count() == 0
    assert units.not_percent(spark.createDataFrame([record(1, 5.0, config="default")], RECORDS), b).count() == 0


def test_shares_of_scales_come_from_all_untold_rows(spark, monkeypatch):
    seen, shift = [], units._shift
    monkeypatch.setattr(units, "_shift", lambda p, *a: (seen.append(len(p) if isinstance(p, np.ndarray) else p.count()), shift(p, *a))[1])
    told = [record(i, float(i % 90 + 1), config="percent") if i % 2 else record(i, i % 90 / 100, config="fraction") for i in range(200)]
    rows = spark.createDataFrame(told, RECORDS).unionByName(spark.range(1000, 26_000).select(F.col("id").alias("record_id"), (F.col("id") % 90 + 1).cast("double").alias("score"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], RECORDS).schema if f.name not in ("record_id", "score")]))
    units.not_percent(rows, spark.createDataFrame([("b", "B", "math", "percent")], BENCHMARKS)).count()
    assert seen == [25_000]

    p = np.random.default_rng(6).dirichlet([1, 2, 5], size=500)
    prior = np.array([0.5, 0.25, 0.25])
    share = prior
    for _ in range(30):
        q = p * share / prior
        share = np.maximum((q / q.sum(axis=1, keepdims=True)).mean(axis=0), 1e-6)
    got = shift(spark.createDataFrame(p.tolist(), "a double, b double, c double"), prior * 8)
    assert np.allclose(got, share / prior) and np.allclose(shift(spark.createDataFrame([], "a double, b double, c double"), prior), 1)


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int) + (x[:, 2] > 1.5)
    f = trees.train(x[:2000], y[:2000], 3, trees=15)
    p = f.probabilities(x[2000:])
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == y[2000:]).mean() > 0.93
    assert f.probabilities(x[:0]).shape == (0, 3)


def brute_fill(values):
    out = []
    for i, v in enumerate(values):
        near = [(abs(j - i), j > i, j) for j, w in enumerate(values) if w is not None]
        out.append(v if v is not None else values[min(near)[2]] if near else None)
    return out


def test_hot_deck_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(hotdeck, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    groups = {"big": [None if rng.random() < 0.9 else float(i) for i in range(400)], "none": [None] * 5, "one": [1.5], "gap": [None, 2.0, None, None, None, 3.0]}
    rows = [(g, i, v, "x") for g, vs in groups.items() for i, v in enumerate(vs)] + [(None, 0, None, "x"), (None, 1, 4.0, "x")]
    out = hotdeck.hot_deck(spark.createDataFrame(rows, "g string, i int, v double, extra string"), ["g"], ["i"], "v").collect()
    for g, vs in groups.items():
        mine = sorted((r for r in out if r.g == g), key=lambda r: r.i)
        assert [r.filled_value for r in mine] == brute_fill(vs)
        assert [r.filled for r in mine] == [v is None and any(w is not None for w in vs) for v in vs]
    gap = {r.i: r.distance for r in out if r.g == "gap" and r.filled}
    assert gap == {0: 1, 2: 1, 3: 2, 4: 1}
    assert not any(r.filled for r in out if r.g is None)


def test_gaps(spark):
    s = spark.createDataFrame([("r", "b", "m1", 0.5, "f1", 1), ("r", "b", "m2", None, "-", 1), ("r", "b2", "m1", 7.0, None, 1), ("r", "b", "m1", 0.5, "f1", 2)], "run_id string, benchmark string, model string, score double, metric string, loaded_at int")
    b = spark.createDataFrame([("b", "B", "c", "percent"), ("b2", "B2", "c", "rating")], BENCHMARKS)
    rec = spark.createDataFrame([record(1, 5.0), record(2, math.nan), record(3, None, bench="lone"), record(4, None, bench=None)], RECORDS)
    got = {tuple(r) for r in hotdeck.gaps_filled(s, rec, b).collect()}
    assert got == {("scores", "r|b|m2", "score"), ("scores", "r|b|m2", "metric"), ("scores", "r|b2|m2", "score"), ("score_records", "2", "score")}
    assert hotdeck.gaps_filled(s.limit(0), rec.limit(0), b).count() == 0


def test_nested_layouts(spark):
    rec = {"model_id": "a", "score": 1, "source": {"kind": "k", "url": "u"}, "variants": [{"score": 2, "variants": {"low": {"score": 3}, "bad": 4}}, None, "see", {"score": "5"}], "extra": {"slices": [{"name": "s", "trials": [{"seed": 1}, 2]}]}}
    payloads = {
        1: json.dumps([rec, 5, {"model_id": "b"}]),
        2: "﻿" + json.dumps({"_meta": {}, "records": json.dumps([{"score": 1}])}),
        3: json.dumps({"_note": "x", "m1": {"score": 1}, "m2": {"score": 2, "variants": json.dumps([{"score": 1}])}}),
        4: json.dumps({"model_id": "z", "variants": None}),
        5: '{"model_id": "a"}\n\n{"model_id": "b", "extra": "{\\"slices\\": [{}]}"}\n',
        6: '[{"model_id": "a", "b',
        7: None,
        8: "",
        9: "[" * 5000,
        10: "[" * 200_000 + "]" * 200_000,
        11: json.dumps([{"model_id": "m", "variants": "[" * 200_000 + "]" * 200_000, "extra": '{"slices": ' + "[" * 200_000 + "]" * 200_000 + "}"}]),
        12: "[1, 2]",
    }
    d = spark.createDataFrame([(k, v, "extra") for k, v in payloads.items()], "drop_id long, payload string, path string")
    got = {}
    for r in nested.entries(d).collect():
        got.setdefault(r.drop_id, set()).add((r.path, r.parent_path))
    assert got == {
        1: {("r0", ""), ("r0/v0", "r0"), ("r0/v0/vlow", "r0/v0"), ("r0/v3", "r0"), ("r0/s0", "r0"), ("r0/s0/t0", "r0/s0"), ("r2", "")},
        2: {("r0", "")},
        3: {("rm1", ""), ("rm2", ""), ("rm2/v0", "rm2")},
        4: {("r0", "")},
        5: {("r0", ""), ("r1", ""), ("r1/s0", "r1")},
        11: {("r0", "")},
    }
    assert {r.drop_id: r.reason for r in nested.unread(d).collect()} == {6: "no JSON", 7: "empty", 8: "empty", 9: "no JSON", 10: "nested too deeply", 12: "no entries"}
    t = nested.tables(d)
    inside = {(r.drop_id, r.outer_path, r.inner_path) for r in nested.contained(t["record"], t["variant"]).collect()}
    assert inside == {(1, "r0", "r0/v0"), (1, "r0", "r0/v0/vlow"), (1, "r0", "r0/v3"), (3, "rm2", "rm2/v0")}


tree = st.recursive(st.fixed_dictionaries({"score": st.integers()}), lambda c: st.fixed_dictionaries({"score": st.integers(), "variants": st.lists(c, max_size=3)}), max_leaves=12)


@settings(max_examples=40, deadline=None)
@given(st.lists(tree, max_size=4))
def test_intervals_are_containment(records):
    nodes = nested.walk(json.dumps(records))
    assert len({n[4] for n in nodes} | {n[5] for n in nodes}) == 2 * len(nodes)
    for a in nodes:
        for b in nodes:
            assert (a[4] < b[4] and b[5] < a[5]) == (b[1].startswith(a[1] + "/"))


@settings(max_examples=40, deadline=None)
@given(st.lists(tree, max_size=4))
def test_parents_are_the_innermost_intervals(records):
    for n in nested.walk(json.dumps(records)):
        assert n[2] == n[1].rpartition("/")[0]


def test_record_nodes(spark):
    r = spark.createDataFrame([record(1, 1.0, source=source("k"), variants=[(2.0, "c", source("x")), None, (3.0, None, None)]), record(2, None), record(3, 1.0, variants=[], extra='{"a": 1, "b": {"c": 2}}'), record(4, 1.0, extra="{broken")], RECORDS)
    got = {(x.record_id, x.path) for x in nested.record_nodes(r).collect()}
    assert got == {(1, "r"), (1, "r/o"), (1, "r/v0"), (1, "r/v0/o"), (1, "r/v2"), (2, "r"), (3, "r"), (4, "r")}


def test_record_tree_holds_extra(spark):
    r = spark.createDataFrame([record(1, 1.0, source=source("k"), variants=[(2.0, "c", source("x")), None], extra='{"price": {"in": 1.5, "a/b": null}, "tags": ["x", {"y": true}], "rank": 3}'), record(2, None), record(3, 1.0, extra="{broken"), record(4, 1.0, extra="{}")], RECORDS)
    rows = nested.record_tree(r).collect()
    got = {x.path: (x.type, x.parent_path, x.name, x.value) for x in rows if x.record_id == 1 and x.path.startswith("r/x")}
    assert got == {
        "r/x": ("object", "r", "extra", None), "r/x/price": ("object", "r/x", "price", None), "r/x/price/in": ("number", "r/x/price", "in", "1.5"),
        "r/x/price/a~1b": ("null", "r/x/price", "a/b", None), "r/x/tags": ("array", "r/x", "tags", None), "r/x/tags/0": ("string", "r/x/tags", "0", "x"),
        "r/x/tags/1": ("object", "r/x/tags", "1", None), "r/x/tags/1/y": ("boolean", "r/x/tags/1", "y", "true"), "r/x/rank": ("number", "r/x", "rank", "3"),
    }
    assert {(x.record_id, x.path) for x in rows if x.record_id > 1} == {(2, "r"), (3, "r"), (4, "r"), (4, "r/x")}
    one = [x for x in rows if x.record_id == 1]
    assert {x.path for x in one} - got.keys() == {"r", "r/o", "r/v0", "r/v0/o"}
    assert len({x.pre for x in one} | {x.post for x in one}) == 2 * len(one)
    for a in one:
        for b in one:
            assert (a.pre < b.pre and b.post < a.post) == b.path.startswith(a.path + "/")
