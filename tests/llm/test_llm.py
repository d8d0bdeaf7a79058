import itertools
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import canon, components, fusion, mixing, packing, queries, spam
from tests.schemas import BENCHMARKS, MODELS, RECORDS, record, source


def kinds(spark):
    return spark.createDataFrame([("manual", 4), ("tech_report", 5), ("github_repo", 3), ("arena_api", 2), (None, 1)], "kind string, trust int")


def test_precedence(spark):
    rows = [
        record(1, 1.0, source=source("manual", "u1", "n/a", None, "2025-01")),
        record(2, None, source=source("Tech Report", "", "t", "-", "15 Jan 2025"), variants=[None, (3.0, "c", source("scrape", None, None, "by", "2024"))]),
        record(3, 1.0, model="solo"),
        record(4, 1.0, model=""),
        record(5, 1.0, model=""),
        record(6, None, model=None),
        record(7, -1.0, model="bad"),
        record(8, float("nan"), model="bad"),
        *[record(i, 2.0, model="hot") for i in range(100, 400)],
    ]
    r = spark.createDataFrame(rows, RECORDS)
    got = {(x.model_id, x.field_name): (x.record_id, x.entry_no) for x in fusion.representatives(r, kinds(spark)).collect()}
    assert got == {("m", "score"): (1, 0), ("m", "url"): (1, 0), ("m", "ref"): (2, 0), ("m", "reported_by"): (2, 2), ("hot", "score"): (100, 0)}
    assert fusion.representatives(r.limit(0), kinds(spark)).count() == 0


def test_votes_and_copying(spark):
    rng, rows, n = random.Random(2), [], 0
    for g in range(400):
        true = float(g)
        wrong = true + rng.choice([0.25, 0.5, 0.75])
        for kind, right in (("manual", rng.random() < 0.9), ("tech_report", rng.random() < 0.9), ("arena_api", rng.random() < 0.9)):
            rows.append(record(n := n + 1, true if right else true + 0.125, model=f"g{g}", source=source(kind)))
        bad = wrong if rng.random() < 0.6 else true
        for _ in range(2):
            rows.append(record(n := n + 1, bad, model=f"g{g}", source=source("github_repo")))
        rows.append(record(n := n + 1, bad, model=f"g{g}", source=source("scrape")))
    r = spark.createDataFrame(rows, RECORDS)
    known = fusion.kinds_of(kinds(spark))
    claims = fusion.claimed(r, known[0])
    b = fusion.learn(claims, *known)
    at = {k: i for i, k in enumerate(b.kinds)}
    assert b.accuracy[at["manual"]] > b.accuracy[at["github_repo"]] + 0.2
    assert max(b.copying[at["github_repo"]][at[""]], b.copying[at[""]][at["github_repo"]]) > 0.9
    assert fusion.learn(claims, *known, 1).accuracy != b.accuracy
    out = fusion.by_votes(claims, b).where("field_name = 'score'").collect()
    assert sum(float(x.value) == float(x.model_id[1:]) for x in out) > 0.9 * len(out)


def test_order_is_a_prior_of_the_votes(spark, monkeypatch):
    """The posterior decides under either strength: three kinds of long standing against the newest entry. p1_found learns its votes."""
    old = [record(i, 5.0, source=source(k, published="2020-01-01")) for i, k in enumerate(("manual", "tech_report", "github_repo"))]
    r = spark.createDataFrame([*old, record(9, 7.0, source=source("arena_api", published="2024-01-01"))], RECORDS)
    seen, learn = [], fusion.learn
    monkeypatch.setattr(fusion, "learn", lambda *a: (seen.append(learn(*a)), seen[-1])[1])
    monkeypatch.setattr(queries, "t", lambda s, d, name: {"score_records": r, "source_kinds": kinds(spark)}[name])
    assert [(x.record_id, x.entry_no) for x in queries.p1_found(spark, "").collect()] == [(9, 0)]
    assert len(seen) == 1 and all(v > 0 for v in seen[0].vote)
    got = {s: fusion.representatives(r, kinds(spark), strength=s).collect()[0] for s in (0.0, 3.0, fusion.STATED)}
    assert {s: x.record_id for s, x in got.items()} == {0.0: 1, 3.0: 1, fusion.STATED: 9}
    at = {k: v for k, v in zip(seen[0].kinds, seen[0].vote)}
    many, one = (math.exp(sum(at[k] for k in ("manual", "tech_report", "github_repo"))), math.exp(at["arena_api"]))
    assert got[0.0].posterior == pytest.approx(many / (many + one + 9)) and got[3.0].posterior == pytest.approx(many / (many + one * math.exp(3) + 9))
    assert got[fusion.STATED].posterior == pytest.approx(1) and fusion.STATED > (fusion.MOST_KINDS + 1) * math.log(fusion.N_FALSE * 0.99 / 0.01)


def test_votes_count_rows_of_the_group(spark):
    """A field that one record of a group of two claims survives; groups of one row, with variants or not, give nothing."""
    rows = [
        record(1, 1.0, source=source("manual", "u")),
        record(2, None, source=source("manual", ref="t")),
        record(3, 1.0, model="solo", variants=[(2.0, "c", source("manual", "u"))]),
        record(4, 2.0, model="twice"),
        record(4, 2.0, model="twice"),
    ]
    r = spark.createDataFrame(rows, RECORDS)
    got = {(x.model_id, x.field_name): (x.value, x.n_values) for x in fusion.representatives(r, kinds(spark), "votes").collect()}
    assert got == {("m", "score"): ("1.0", 1), ("m", "url"): ("u", 1), ("m", "ref"): ("t", 1), ("twice", "score"): ("2.0", 1)}


def test_recency_is_a_prior(spark):
    """Two kinds of the same weight disagree: the later claim wins; without the prior the greater value does. Undated claims are old."""
    rows = [record(1, 9.0, source=source("manual", published="2020-01-01")), record(2, 5.0, source=source("manual", published="2024-06-01")), record(3, 9.0, model="x", source=source("manual")), record(4, 5.0, model="x", source=source("manual", published="2024-06-01")), record(5, 5.0, model='q"\\', source=source("manual")), record(6, 7.0, model='q"\\', source=source("manual"))]
    known = fusion.kinds_of(kinds(spark))
    g = fusion.claimed(spark.createDataFrame(rows, RECORDS), known[0])
    b = fusion.learn(g, *known)
    got = {r.model_id: (r.value, r.posterior) for r in fusion.by_votes(g, b).collect()}
    plain = {r.model_id: (r.value, r.posterior) for r in fusion.by_votes(g, b, 0.0).collect()}
    assert [got[m][0] for m in ("m", "x", 'q"\\')] == ["5.0", "5.0", "7.0"] and plain["m"][0] == plain["x"][0] == "9.0"
    assert got["m"][1] > plain["m"][1] and all(0 < p < 0.5 for _, p in plain.values())


def entries(spark, bench, model=()):
    b = spark.createDataFrame([(*x, "c") for x in bench], "entry_id long, run_id string, benchmark string, maintainer string, source_url string, derived_from string, key string")
    m = spark.createDataFrame([(*x, "c") for x in model], "entry_id long, run_id string, model string, team string, report_url string, base_model string, node string")
    return b, m


def test_groups(spark):
    b, m = entries(
        spark,
        [
            (1, "r", "x-1", "Ann Bo Lab and Cee Team", None, None),
            (2, "r", "y", "ANN_BO_LAB.", "https://h.example/", "none"),
            (3, "r", "z", "various", "h.example/p/q", "X 1"),
            (4, "r", "w", "n/a", "http://www.h.example/p/q/", None),
            (5, "r", "v", "-", "https://h.example", None),
            (6, "s", "x-1", "Ann Bo Lab", "h.example/p/q", None),
            (7, "r", "u", "N/A", None, "gone thing"),
            (8, "r", "t", "", None, "gone-thing"),
            (None, "r", "x-1", None, None, None),
        ],
        [(11, "r", "x-1", "Ann Bo Lab", None, None), (12, None, "q", None, None, None), (12, None, "q", None, None, None)],
    )
    assert {tuple(r) for r in components.related_groups(b, m).collect()} == {(1, 2), (1, 3), (1, 4), (7, 8)}
    assert components.related_groups(b.limit(0), m.limit(0)).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(600), rng.randrange(1000, 1500)) for _ in range(620)] + [(i, 5) for i in range(0, 200)] + [(700 + i, 2000 + i) for i in range(60)] + [(701 + i, 2000 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for n, k in links:
        a, c = find(n), find(-k)
        if a != c:
            root[a] = c
    want = {frozenset(g) for _, g in itertools.groupby(sorted({n for n, _ in links}, key=find), key=find)}
    got = {}
    for r in components.components(spark.createDataFrame(links, "node long, key long")).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert {frozenset(g) for g in got.values()} == want and all(c == min(g) for c, g in got.items())


def test_components_of_long_chains(spark):
    """Chains in rising, falling and changing order, and a ring: the frontier doubles, collisions merge."""
    order = list(range(5000, 5150))
    random.Random(1).shuffle(order)
    chains = [list(range(100, 300)), list(range(1300, 1100, -1)), [3000 + i // 2 if i % 2 else 3500 - i for i in range(150)], order, [*range(7000, 7050), 7000]]
    links = [(n, 100_000 * c + i + j) for c, chain in enumerate(chains, 1) for i, n in enumerate(chain) for j in (0, 1)]
    got = {}
    for r in components.components(spark.createDataFrame(links, "node long, key long")).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert got == {min(c): set(c) for c in chains}


def test_assigned(spark):
    b, m = entries(spark, [(i, "r", f"b{i}", f"team{i // 3}", None, None) for i in range(300)] + [(900, "r", "b0", None, None, None)], [(1000 + i, "r", f"m{i}", None, None, None) for i in range(200)])
    ratios = spark.createDataFrame([("benchmark", "train", 0.6), ("benchmark", "dev", 0.2), ("benchmark", "test", 0.2), ("model", "seen", 0.75), ("model", "held", 0.25)], "unit_kind string, bucket string, ratio double")
    rows = components.assigned(b, m, ratios).collect()
    assert len(rows) == 501 and all(r.assigned_bucket for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.component, set()).add(r.assigned_bucket)
    assert all(len(x) == 1 for x in by.values())
    shares = {(r.unit_kind, r.bucket): r for r in components.split_shares(components.assigned(b, m, ratios), ratios).collect()}
    assert len(shares) == 5 and abs(shares["benchmark", "train"].actual - 0.6) < 0.02 and shares["model", "held"].entries == 50
    n = Counter(r.assigned_bucket for r in rows)
    assert abs(n["train"] - 180) <= 4 and abs(n["dev"] - 60) <= 4 and abs(n["seen"] - 150) <= 1


def osa(a, b):
    rigid = set("0123456789.")
    d = [[99] * (len(b) + 1) for _ in range(len(a) + 1)]
    d[0][0] = 0
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if i and a[i - 1] not in rigid:
            d[i][j] = min(d[i][j], d[i - 1][j] + 1)
        if j and b[j - 1] not in rigid:
            d[i][j] = min(d[i][j], d[i][j - 1] + 1)
        if i and j:
            if a[i - 1] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 1][j - 1])
            elif not {a[i - 1], b[j - 1]} & rigid:
                d[i][j] = min(d[i][j], d[i - 1][j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and not {a[i - 1], a[i - 2]} & rigid:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


word = st.text(alphabet="ab1", max_size=7)


@settings(max_examples=150, deadline=None)
@given(st.sets(word.filter(bool), min_size=1, max_size=15), word, st.sampled_from([1, 2]))
def test_automaton_is_exact(entries, typed, k):
    t = canon.Trie()
    for w in entries:
        t.add([(w,)], w)
    assert t.within(typed, k) == {w: x for w in entries if (x := osa(typed, w)) <= k}


def forms(words):
    return {canon.squeeze("".join(x)) for x in itertools.product(*words)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab1", max_size=3), min_size=1, max_size=3, unique=True).map(tuple), min_size=1, max_size=4), st.text(alphabet="ab1", max_size=6))
def test_branches_say_the_same_as_all_forms(words, typed):
    """Alternatives meet again after each word; searched exactly or with errors in any place, all combinations are found."""
    t = canon.Trie()
    t.add(words, "x", soft=0)
    t.add([("aa",), ("b",)], "y", soft=0)
    every = forms(words)
    assert ("x" in t.exact(typed)) == (typed in every)
    if len(words) == 1:
        assert t.within(typed, 2).get("x") == min((d for w in every if (d := osa(typed, w)) <= 2), default=None)


def test_many_versions_take_little_room():
    m = canon.Matcher([("kolibra-v1-v2-v3-v4-v5-v6-v7-v8-9-10-11-12", [])])
    assert m.answer("kolibra version1 2.0 v3 4 v5.0 ver6 7 8 v9 10 11 v12") and not m.answer("kolibra version1 2.0 v3 4 v5.0 ver6 7 8 v9 10 11 v13")

    def size(node, seen):
        if id(node) in seen:
            return 0
        seen.add(id(node))
        return 1 + sum(size(x, seen) for k, x in node.items() if len(k) == 1) + sum(size(x, seen) for x in node.get(" next", ()))

    assert size(m.trie.root, set()) < 400
    assert m.near("kolibar 1 2 3 4 5 6 7 8 9 10 11 12") == {"kolibra-v1-v2-v3-v4-v5-v6-v7-v8-9-10-11-12": 1}


def test_mapping(spark):
    models = spark.createDataFrame([("kolibra-2.5-70b-pro", "Kolibra 2.5 70B Pro", "Vendor", ["Red Owl 5", None]), ("kolibra-2.5-70b", "Kolibra 2.5 70B", "Vendor", None)], MODELS)
    bench = spark.createDataFrame([("mathira-bench", "Mathira BENCH", "c", "percent"), ("mathira-bench-v2", "Mathira BENCH V2", "c", "percent")], BENCHMARKS)
    typed = {
        "Kolibra 2.5 70B Pro": "kolibra-2.5-70b-pro", "KOLIBRA/V2.5/70B": "kolibra-2.5-70b", "70b_kolirba_2.5_pro (new)": "kolibra-2.5-70b-pro", "vendor/kolibbra-2.5-70b-20251120": "kolibra-2.5-70b",
        "red owl 5™": "kolibra-2.5-70b-pro", "red owl 6": "", "kolibra-3.5-70b": "", "kolibra-2.5-7b": "", "kolibra-2.5-70b-mini": "", "zzz": "", "x" * 20000: "", "ｋｏｌｉｂｒａ ２．５ ７０Ｂ": "kolibra-2.5-70b", "kоlibra 2.5 70b, medium effort": "kolibra-2.5-70b",
    }
    rows = [record(i, 1.0, model=x, bench="mathira-bench") for i, x in enumerate(typed)]
    rows += [record(100, 1.0, model=None, bench=None, extra='{"leaderboard_model_name": "Kolibra2.570B"}'), record(101, 1.0, model=" ", bench="-", extra="{broken"), record(102, 1.0, model="kolibra-2.5-70b", bench="Mathira Benchmark 2.0 (EM)")]
    got = {(r.record_id, r.field_name): r.canonical_id for r in canon.mapped(spark.createDataFrame(rows, RECORDS), models, bench).collect()}
    want = {(i, "model_id"): c for i, c in enumerate(typed.values())} | {(100, "leaderboard_model_name"): "kolibra-2.5-70b", (102, "benchmark_id"): "mathira-bench-v2"}
    assert got == want
    found = {(r.typed, r.entry): (r.n, r.distance) for r in canon.candidates(spark.createDataFrame(rows + rows[:1], RECORDS), models, bench).collect()}
    assert found["Kolibra 2.5 70B Pro", "kolibra-2.5-70b-pro"] == (2, 0) and found["70b_kolirba_2.5_pro (new)", "kolibra-2.5-70b-pro"] == (1, 1)


@settings(max_examples=120, deadline=None)
@given(st.integers(4, 60), st.data())
def test_packing_is_whole_and_no_worse_than_best_fit(capacity, data):
    sizes = data.draw(st.lists(st.integers(1, capacity), max_size=60))
    n = Counter(sizes)
    patterns = packing.packed(dict(n), capacity)
    used = Counter()
    for times, content in patterns:
        assert times > 0 and sum(s * k for s, k in content.items()) <= capacity
        for s, k in content.items():
            used[s] += times * k
    assert used == n
    plain = sum(t for t, _ in packing.best_fit(dict(n), capacity))
    assert sum(t for t, _ in patterns) <= plain + 1


def test_packing_takes_as_many_patterns_for_any_number_of_sets():
    for n in (1_000, 1_000_000):
        assert packing.packed({55: n, 25: n, 18: n}, 100) == [(n, {55: 1, 25: 1, 18: 1})]
        assert len(packing.packed({50: n, 30: n, 19: n}, 100)) <= 6


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens int, before int")


def test_packed_documents(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.randint(1, 30)), "a", "en", 1, 1) for i in range(150)] + [(900, None, None, None, 1, 1), (901, "", "a", "en", 1, 1), (902, "word " * 999, "a", "en", 1, 1), (5, "again", "a", "en", 1, 1)]
    jobs = spark.createDataFrame([("s", 64), ("l", 100), (None, 5), ("z", 0)], "job string, capacity_tokens int")
    out = packing.packed_documents(documents(spark, rows), jobs)
    by, docs = Counter(), {}
    for r in out.collect():
        by[r.job, r.container_no] += r.n_tokens
        docs.setdefault((r.job, r.doc_id), []).append((r.piece_no, r.n_tokens))
    assert all(v <= {"s": 64, "l": 100}[k[0]] for k, v in by.items())
    assert all(0 <= r["fixed_items"] <= r["items"] for r in packing.fill_report(out, jobs).collect())
    assert len(docs) == 2 * 153 and {j for j, _ in docs} == {"s", "l"}
    assert [n for _, n in sorted(docs["s", 902])][:-1] == [64] * (len(docs["s", 902]) - 1)
    assert all(len(p) == (2 if k[1] == 5 else 1) for k, p in docs.items() if k[1] != 902)
    for r in packing.fill_report(out, jobs).collect():
        assert r.containers <= r.least_containers + 2
    assert packing.packed_documents(documents(spark, []), jobs).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.randint(5, 60)), "abcx"[min(3, int(rng.random() ** 2 * 4))], "en", 1, 1) for i in range(1500)] + [(9000, "word", None, None, 1, 1), (9001, None, "a", None, 1, 1)]
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.3, 2), ("c", 0.25, 4), ("gone", 0.05, 3), (None, 0.1, 1), ("x", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(documents(spark, rows), targets, total=12_000).cache()
    assert {r.domain for r in mix.collect()} == {"a", "b", "c"}
    cap = {"a": 2, "b": 2, "c": 4}
    assert all(1 <= r.copies <= cap[r.domain] for r in mix.collect())
    share = {r.source: r.actual_share for r in mixing.shares(mix, targets).collect()}
    assert share["gone"] == 0 and all(abs(share[k] - w / 0.95) < 0.01 for k, w in (("a", 0.4), ("b", 0.3), ("c", 0.25)))
    assert mixing.mixed(documents(spark, []), targets).count() == 0
    assert mixing.mixed(documents(spark, rows), targets.limit(0)).count() == 0


def test_scarce_sources_stop_at_their_cap(spark):
    rows = [(i, "word " * 20, "big" if i < 900 else "few", "en", 1, 1) for i in range(905)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("few", 0.5, 3)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.shares(mixing.mixed(documents(spark, rows), targets), targets).collect()}
    assert report["few"].docs == 5 and report["few"].most_copies == 3 and abs(report["few"].actual_share - 15 / (452.5 + 15)) < 0.005
    assert report["few"].missing_share == 0.5 - report["few"].actual_share and report["big"].missing_share == 0
    hot = mixing.mixed(documents(spark, [(7, "word", "big", "en", 1, 1)] * 3000), targets)
    assert hot.count() == 3000


def test_posteriors_decide_who_joins(spark):
    """Unlabelled pages that look like a scarce source are used for it, as often as its cap allows; others stay out."""
    lang = {"a": "en", "b": "de", "z": "fr"}
    rows = [(i, "word " * 20, s, lang[s], 1, 1) for i, s in enumerate("a" * 400 + "b" * 40 + "z" * 200)]
    rows += [(1000 + i, "word " * 20, None, "de", 1, 1) for i in range(60)] + [(2000 + i, "word " * 20, None, "fr", 1, 1) for i in range(60)]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(documents(spark, rows), targets, total=400 * 20.0).collect()
    used = Counter()
    for r in mix:
        used[("page" if r.source else "guess", r.domain)] += r.copies
    assert used["page", "b"] == 80 and 100 <= used["guess", "b"] <= 120 and not used["guess", None] and all(r.doc_id < 2000 for r in mix)
    alone = mixing.mixed(documents(spark, [r for r in rows if r[2]]), targets, total=400 * 20.0).collect()
    assert sum(r.copies for r in alone if r.domain == "b") == 80


def test_spam(spark):
    rng = random.Random(8)
    goods = ["kettles", "brushes", "candles", "ribbons", "lanterns", "saddles", "blankets", "teapots", "barrels", "mirrors"]
    plain = "the council of the town was told that a bridge over the river had been closed for the week and the men were sent to the mill by order of the mayor when he had heard it".split()
    def stuffed():
        few = rng.sample(goods, 4)
        return " ".join(f"cheap {rng.choice(few)}" for _ in range(60))
    def links():
        return "\n".join(f"http://{rng.choice('abcdef') * 5}{rng.randint(1, 99)}.example/{rng.choice(goods)}/{rng.randint(1, 999)}" for _ in range(25))
    def article():
        return " ".join(rng.choice(plain) for _ in range(120)) + "."
    def prices():
        return "\n".join(f"{rng.choice(goods).title()} {rng.randint(1, 9)}s. {rng.randint(1, 11)}d. to {rng.randint(10, 19)}s." for _ in range(30))
    rows, bad = [], set()
    for i in range(800):
        kind = (stuffed, links, article, article, article, article, article, prices)[i % 8]
        if kind in (stuffed, links):
            bad.add(i)
        rows.append((i, kind(), f"h{i % 5}", "en", 1, 1))
    rows += [(9000, None, None, None, 1, 1), (9001, "", "h1", None, 1, 1), (9002, "ab " * 3, "h1", None, 1, 1), (9003, article() * 300, "h2", None, 1, 1)]
    got = {r.doc_id for r in spam.spam_pages(documents(spark, rows)).collect()}
    assert len(got & bad) >= 0.97 * len(bad) and len(got - bad) <= 2
    assert spam.spam_pages(documents(spark, [])).count() == 0
    assert spam.spam_pages(documents(spark, [(1, article(), "h", "en", 1, 1)])).count() == 0
