"""Mixing sources to target weights by soft membership.

1. A categorical naive Bayes classifier over the table's columns (language, page, resolution, length, week day and the
   mark that breaks words) learns from all documents with a recorded source and gives each document without one a posterior
   over the wanted sources and 'other'. A recorded source is the document's domain with certainty.
2. The total (``total``, or else as many tokens as the documents of the wanted sources have) gives each domain its goal in
   tokens. Scarce sources stop at their cap, and ``shares`` reports what they fall short by. Shares of sources without any document can't be met and are shared out.
3. Projected-gradient least squares fits a rate from 0 to its cap for every document, so that the expected tokens of each
   domain (rates times tokens times membership) come as near to the goals as the caps allow; 'other' has the goal 0.
   With domain d weighted by 1 / (its soft tokens D_d) and steps taken per token, the Hessian's largest eigenvalue is 1, so
   steps of length 1 descend. Documents with a recorded source share their membership, so their part of a step is one
   number; those without one are summed up by their traits and their part is one pass over that table, without a shuffle.
   Where a source is scarce, the gradient draws on unlabelled documents that probably belong to it.
4. Rates become whole numbers of copies by systematic rounding: in hash order within domain and size class, a document gets a
   copy wherever the running sum of rates passes a whole number. The sums are whole numbers (2^-20 of a copy) and run over
   hash ranges in two steps, so a source may hold any share of the rows. Before that the classes of a domain, the largest
   documents first, have their sums of rates rounded, and the tokens that this adds or takes are carried to the next class.

Documents of a recorded source that is not listed stay out of the mix, as do unlabelled ones that more probably belong to
'other' than to any listed source. Targets that are null, zero or negative, and caps below 1, count as not listed; a source
listed twice counts with the sum of its shares and its largest cap. Documents without tokens are not used. Repeated rows
are documents of their own. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.cleaning import usable_text
from rankloom.llm.components import prefix_sums
from rankloom.llm.tokens import with_tokens
from rankloom.runtime import catalog_rows, stash

#: A step that lowers the objective by less than this share of it is the last; more steps than MOST_STEPS are an error.
TOLERANCE, MOST_STEPS = 1e-5, 1_000
#: Sources that a mix may name at most.
MOST_SOURCES = 500
#: Units of a copy in the running sums.
UNIT = 1 << 20
FEATURES = ("lang", "page", "dpi", "size", "day", "hyphen")
_X = [f"x_{f}" for f in FEATURES]


def _traits(docs: DataFrame) -> list[Column]:
    """The columns that the classifier looks at, each as a short text; null is a value of its own."""
    t = F.coalesce(F.col("text"), F.lit(""))
    marks = F.concat(*[F.when(F.instr(t, m) > 0, i).otherwise("") for i, m in (("a", "¬"), ("b", "­"), ("c", "‐"), ("d", "-\n"))])
    cols = {
        "lang": F.lower(F.trim("lang")),
        "page": F.least(F.col("page_no"), F.lit(40)).cast("string"),
        "dpi": F.col("dpi").cast("string"),
        "size": F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(1)))).cast("string"),
        "day": F.dayofweek("issue_date").cast("string"),
        "hyphen": marks,
    }
    have = set(docs.columns)
    need = {"lang": "lang", "page": "page_no", "dpi": "dpi", "size": "n_chars", "day": "issue_date", "hyphen": "text"}
    return [(F.coalesce(cols[f], F.lit("?")) if need[f] in have else F.lit("?")).alias(f"x_{f}") for f in FEATURES]


def targets_of(mix_targets: DataFrame) -> list[tuple[str, float, int]]:
    t = mix_targets.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("cap"))
    return [(r.source, float(r.w), int(r.cap)) for r in sorted(catalog_rows(t, MOST_SOURCES), key=lambda r: r.source)]


def _classifier(labelled: DataFrame, k: int):
    """Function from a frame of traits to posteriors over the k wanted sources and, last, 'other'; from (c, x_...) rows."""
    each = F.explode(F.array(F.struct(F.lit("").alias("f"), F.lit("").alias("v")), *[F.struct(F.lit(f).alias("f"), F.col(f"x_{f}").alias("v")) for f in FEATURES])).alias("x")
    counts = labelled.select("c", each).groupBy("c", "x.f", "x.v").agg(F.count("*").alias("n"))
    n = np.zeros(k + 1)
    seen: dict[str, dict[str, np.ndarray]] = {f: {} for f in FEATURES}
    for r in catalog_rows(counts, 1_000_000):  # sources times values of columns with few values
        if r.f:
            seen[r.f].setdefault(r.v, np.zeros(k + 1))[r.c] = r.n
        else:
            n[r.c] = r.n
    prior = np.where(n > 0, np.log((n + 1) / (n.sum() + k + 1)), -np.inf)
    prior = prior if n.any() else np.append(np.full(k, -np.inf), 0.0)
    tables = {f: {v: np.log((x + 0.5) / (n + 0.5 * (len(vs) + 1))) for v, x in vs.items()} for f, vs in seen.items()}
    fresh = {f: np.log(0.5 / (n + 0.5 * (len(vs) + 1))) for f, vs in seen.items()}

    def posterior(pdf: pd.DataFrame) -> np.ndarray:
        score = np.tile(prior, (len(pdf), 1))
        for f in FEATURES:
            codes, values = pd.factorize(pdf[f"x_{f}"])
            score += np.array([tables[f].get(v, fresh[f]) for v in values]).reshape(-1, k + 1)[codes]
        p = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else score
        return p / p.sum(axis=1, keepdims=True)

    return posterior


def _caps(m: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Caps of documents by membership: that of the most probable domain; 'other' has 0."""
    return np.append(cap, 0.0)[m.argmax(axis=1)] if len(m) else np.zeros(0)


def _rates(m: np.ndarray, caps: np.ndarray, start: float, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the given steps; each moves by the membership-weighted error and is clipped to 0..cap."""
    r = np.minimum(start, caps)
    for g in steps:
        r = np.clip(r - m @ g, 0.0, caps)
    return r


def fitted(docs: DataFrame, mix_targets: DataFrame, total: float | None = None, tokenizer: str | None = None) -> tuple[DataFrame, dict]:
    """(doc_id, source, domain, n_tokens, c, rate) of the documents that may enter, and the plan.

    ``c`` is the number of the recorded source, -1 for unlabelled documents; ``domain`` is the recorded or most probable
    source. The plan has names, caps, goals and expected tokens by domain ('other' last), steps and the objective.
    """
    targets = targets_of(mix_targets)
    names = [t[0] for t in targets]
    out = "doc_id bigint, source string, domain string, n_tokens bigint, c int, rate double"
    if not names:
        return docs.sparkSession.createDataFrame([], out), {"names": []}
    k = len(names)
    at = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), F.col("source")), F.lit(k))
    c = F.when(usable_text(F.col("source")), at).otherwise(-1).alias("c")
    traits = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text", c, *_traits(docs))
    sized = stash(with_tokens(traits, ["doc_id", "source", "c", *_X], tokenizer), "sized")
    posterior = _classifier(sized.where("c >= 0"), k)
    free = sized.where("c < 0 and n_tokens > 0").groupBy(*_X).agg(F.sum("n_tokens").alias("n_tokens"))

    def memberships(batches):
        for pdf in batches:
            yield pd.DataFrame({"n_tokens": pdf["n_tokens"], "m": list(posterior(pdf))})

    cells = stash(free.mapInPandas(memberships, "n_tokens bigint, m array<double>"), "cells")
    share, cap = np.array([t[1] for t in targets]), np.array([float(t[2]) for t in targets])
    have = np.zeros(k + 1)
    for r in sized.where("c >= 0").groupBy("c").agg(F.sum("n_tokens").alias("n")).collect():
        have[r.c] = r.n
    there = have[:k] > 0
    if not there.any():
        return docs.sparkSession.createDataFrame([], out), {"names": []}
    wanted = np.where(there, share, 0.0) / share[there].sum()
    total = float(have[:k].sum()) if total is None else total
    goal = np.append(wanted * total, 0.0)
    own = np.where(there, have[:k], 0.0)

    def summed(weigh) -> np.ndarray:
        """Sums of weigh(m, n_tokens) over the unlabelled documents."""

        def run(batches):
            x = np.zeros(k + 1)
            for pdf in batches:
                if len(pdf):
                    m = np.stack(pdf["m"].to_numpy())
                    x += (weigh(m) * pdf["n_tokens"].to_numpy()) @ m
            yield pd.DataFrame({"d": np.arange(k + 1), "x": x})

        x = np.zeros(k + 1)
        for r in cells.mapInPandas(run, "d int, x double").groupBy("d").agg(F.sum("x").alias("x")).collect():
            x[r.d] = r.x
        return x

    soft = np.append(own, 0.0) + summed(lambda m: (_caps(m, cap) > 0).astype(float))
    start = total / max(1.0, soft.sum())
    steps: list[np.ndarray] = []
    rate = np.minimum(start, cap)
    before = first = None
    while True:
        expected = np.append(rate * own, 0.0) + summed(lambda m: _rates(m, _caps(m, cap), start, steps))
        error = np.divide(expected - goal, soft, out=np.zeros(k + 1), where=soft > 0)
        objective = float(((expected - goal) * error).sum() / 2)
        first = objective if first is None else first
        if objective <= 1e-9 * first or before is not None and before - objective <= TOLERANCE * before:
            break
        if len(steps) == MOST_STEPS:
            raise RuntimeError("the rates of the mix don't settle")
        before = objective
        steps.append(error)
        rate = np.clip(rate - error[:k], 0.0, cap)

    def rates(batches):
        for pdf in batches:
            m = posterior(pdf)
            pick = np.array([*names, None], dtype=object)[m.argmax(axis=1)] if len(m) else []
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "domain": pick, "n_tokens": pdf["n_tokens"], "c": pdf["c"], "rate": _rates(m, _caps(m, cap), start, steps)})

    labelled = sized.where((F.col("c") >= 0) & (F.col("c") < k)).select("doc_id", "source", F.col("source").alias("domain"), "n_tokens", "c", F.get(F.array(*map(F.lit, rate.tolist())), F.col("c")).alias("rate"))
    rest = sized.where("c < 0").select("doc_id", "source", "n_tokens", "c", *_X).mapInPandas(rates, out).where("domain is not null")
    plan = {"names": names, "caps": cap.astype(int).tolist(), "goals": goal.tolist(), "expected": expected.tolist(), "steps": len(steps), "objective": objective, "rows": sized.count()}
    return labelled.unionByName(rest), plan


def _carried(rows: DataFrame) -> dict[str, float]:
    """Factor of the rates of each 'size class|domain' that makes their sum whole, with the tokens of rounding carried on."""
    sums = rows.groupBy("domain", "_size").agg(F.sum("rate").alias("n"), F.sum(F.col("rate") * F.col("n_tokens")).alias("t"))
    out, carry = {}, {}
    for r in sorted(catalog_rows(sums, MOST_SOURCES * 256), key=lambda r: (r.domain, -r["_size"])):  # classes of powers of 2^(1/4)
        each = r.t / r.n
        want = r.t + carry.get(r.domain, 0.0)
        k = max(0, round(want / each))
        carry[r.domain] = want - k * each
        out[f"{r['_size']}|{r.domain}"] = k / r.n
    return out


def mixed(docs: DataFrame, mix_targets: DataFrame, total: float | None = None, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, domain, n_tokens, copies): how often each document is used; documents not used are left out."""
    rated, plan = fitted(docs, mix_targets, total, tokenizer)
    if not plan["names"]:
        return rated.select("doc_id", "source", "domain", "n_tokens", F.lit(0).alias("copies"))
    rows = stash(rated.where("n_tokens > 0 and rate > 0").withColumns({"_size": F.floor(F.log2("n_tokens") * 4).cast("int"), "_key": F.xxhash64("doc_id", F.lit(5))}), "rated")
    cap = F.get(F.array(*map(F.lit, plan["caps"])), F.array_position(F.array(*map(F.lit, plan["names"])), F.col("domain")).cast("int") - 1)
    factors = F.create_map(*[F.lit(x) for kv in _carried(rows).items() for x in kv]) if not rows.isEmpty() else F.create_map(F.lit(""), F.lit(1.0))
    scaled = F.least(F.col("rate") * F.coalesce(F.try_element_at(factors, F.concat_ws("|", "_size", "domain")), F.lit(1.0)), cap.cast("double"))
    run = prefix_sums(rows.withColumn("_rate", F.round(scaled * UNIT).cast("bigint")), ["domain", "_size"], "_key", "_rate", plan["rows"])
    passed = lambda x: F.floor((x + UNIT // 2) / F.lit(UNIT))
    copies = (passed(F.col("before") + F.col("_rate")) - passed(F.col("before"))).cast("int")
    return run.select("doc_id", "source", "domain", "n_tokens", copies.alias("copies")).where("copies > 0")


def shares(mix: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """For every listed source (source, target_share, max_repeats, docs, tokens, recorded_tokens, actual_share, missing_share, most_copies).

    ``tokens`` and shares count documents by domain; ``recorded_tokens`` only those whose source is recorded.
    """
    n = F.col("n_tokens") * F.col("copies")
    used = mix.groupBy(F.col("domain").alias("source")).agg(F.count("*").alias("docs"), F.sum(n).alias("tokens"), F.sum(F.when(F.col("source") == F.col("domain"), n)).alias("recorded_tokens"), F.max("copies").alias("most_copies"))
    found = {r.source: r for r in catalog_rows(used, MOST_SOURCES)}
    whole = sum(r.tokens for r in found.values()) or 1
    rows = []
    for name, share, cap in targets_of(mix_targets):
        r = found.get(name)
        actual = r.tokens / whole if r else 0.0
        rows.append((name, share, cap, r.docs if r else 0, r.tokens if r else 0, (r.recorded_tokens or 0) if r else 0, actual, max(0.0, share - actual), r.most_copies if r else 0))
    return mix.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, docs bigint, tokens bigint, recorded_tokens bigint, actual_share double, missing_share double, most_copies int")
