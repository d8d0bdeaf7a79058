"""Rules over texts and JSON: phrases, leaks, contracts, vocabularies, prompts, manifests; rows of any shape made uniform.

Every rule gives an array of reasons, empty if nothing is wrong; a null text counts as empty and broken JSON as none. Phrases
are words with blanks between; texts are compared by their words of a-z and 0-9 in lower case.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.semantics import reasons

# Words that negate a phrase within the four words after them, words for scores, and what makes them scores of an evaluation.
NEGATIONS = ("not", "never", "without", "avoid", "avoids", "beyond", "rather", "instead")
SCORE_WORDS = ("score", "scores")
SCORE_CUES = ("model", "models", "leaderboard", "performance", "evaluation", "eval", "benchmark", "benchmarks", "accuracy", "metric", "metrics", "grading", "graded", "rubric")
# Phrases about the form of a task, about reputation, and that say nothing was seen.
SURFACE = ("multiple choice", "true false", "yes no", "short answer", "free form", "selected option", "answer format", "output format", "input format", "task format")
REPUTATION = ("leaderboard", "public reputation", "model performance", "expected performance", "benchmark difficulty", "public difficulty", "frontier", "hard benchmark", "easy benchmark")
NO_EVIDENCE = ("no evidence", "no direct evidence", "missing evidence", "not evidenced", "not present", "absent")
# Words that name no benchmark in particular.
GENERIC = ("benchmark", "bench", "dataset", "data", "test", "eval", "evaluation", "task", "tasks", "math", "code", "qa", "pro")
# What forbids something in a prompt, what turns that around, and what a score looks like.
PROHIBITS = r"\b(?:do\s+not|don't|never|must\s+not|shall\s+not|cannot|can'?t|forbidden|disallowed|not\s+allowed|avoid|without\s+(?:using|mentioning)|not\s+(?:a|an|the)\b)\b"
TURNS = r"\b(?:ignore|ignoring|ignored|disregard|disregarding|disregarded|overlook|overlooking|overlooked)\b"
SCORE_LITERAL = r"\b\d+\.\d{2,}\b"
# Other names of levels.
LEVEL_NAMES = {
    "1": "absent", "1.0": "absent", "2": "weak", "2.0": "weak", "3": "medium", "3.0": "medium", "4": "strong", "4.0": "strong", "5": "dominant", "5.0": "dominant",
    "none": "absent", "missing": "absent", "low": "weak", "moderate": "medium", "mid": "medium", "high": "strong", "primary": "dominant", "central": "dominant",
    "absent": "absent", "weak": "weak", "medium": "medium", "strong": "strong", "dominant": "dominant",
}
# What in a model's name tells its vendor, in order.
VENDORS = (("claude", "Anthropic"), ("openai", "OpenAI"), ("gemini", "Google"), ("llama", "Meta"), ("qwen", "Alibaba"), ("deepseek", "DeepSeek"), ("kimi", "Moonshot"), ("grok", "xAI"), ("solar", "Upstage"), ("olmo", "Allen Institute for AI"), ("yi", "01.AI"), ("exaone", "LG AI Research"), ("vaetk", "VAETKI"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def let(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f looks at it (also within its own lambdas)."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _at(tokens: Column, phrase: str) -> Column:
    """Places (from 1) at which the phrase stands."""
    p = phrase.split(" ")
    n = F.size(tokens) - len(p) + 1
    return F.when(n >= 1, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(tokens, i, len(p)) == F.array(*map(F.lit, p)))).otherwise(F.array().cast("array<int>"))


def _spaced(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def has_phrase(tokens: Column, phrase: str) -> Column:
    return F.contains(_spaced(tokens), F.lit(f" {phrase} "))


def _before(tokens: Column, i: Column, k: int) -> Column:
    """The k words before place i."""
    return F.slice(tokens, F.greatest(i - k, F.lit(1)), F.least(i - 1, F.lit(k)))


def has_unnegated(tokens: Column, phrase: str, negations: tuple[str, ...] = NEGATIONS) -> Column:
    """The phrase stands somewhere without a negation in the four words before."""
    no = F.array(*map(F.lit, negations))
    return let(tokens, lambda t: F.exists(_at(t, phrase), lambda i: ~F.arrays_overlap(_before(t, i, 4), no)))


def leaks_score(tokens: Column, scores: tuple[str, ...] = SCORE_WORDS, cues: tuple[str, ...] = SCORE_CUES, negations: tuple[str, ...] = NEGATIONS) -> Column:
    """A word for scores stands without a negation in the four words before, and with a cue among the three on either side."""
    no, near = F.array(*map(F.lit, negations)), F.array(*map(F.lit, cues))

    def found(t: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), lambda i: F.coalesce(F.get(t, i - 1).isin(*scores), F.lit(False)))
        return F.exists(places, lambda i: ~F.arrays_overlap(_before(t, i, 4), no) & F.arrays_overlap(F.slice(t, F.greatest(i - 3, F.lit(1)), F.least(i + 3, F.lit(7))), near))

    return let(tokens, found)


def first_phrase(tokens: Column, phrases: tuple[str, ...], unnegated: bool = False) -> Column:
    """The first of the phrases that stands in the text, null if none does."""

    def chosen(t: Column) -> Column:
        out = None
        for p in phrases:
            hit = has_unnegated(t, p) if unnegated else F.contains(t, F.lit(f" {p} "))
            out = F.when(hit, p) if out is None else out.when(hit, p)
        return out

    return let(tokens if unnegated else _spaced(tokens), chosen)


def benchmark_phrases(name: Column) -> Column:
    """What gives a benchmark away: all its words together if there are several, and each that is long, no number and not generic."""
    t = words(name)
    own = F.filter(t, lambda x: ~x.rlike(r"^\d+$") & (F.length(x) >= 3) & ~x.isin(*GENERIC))
    return F.array_distinct(F.concat(own, F.when(F.size(t) > 1, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))))


def mentions(tokens: Column, phrases: Column) -> Column:
    """Whether any phrase of an array stands in the text."""
    return let(_spaced(tokens), lambda text: F.exists(phrases, lambda p: F.contains(text, F.concat(F.lit(" "), p, F.lit(" ")))))


def pattern_faults(patterns: Column, name: Column, surface: tuple[str, ...] = SURFACE, reputation: tuple[str, ...] = REPUTATION) -> Column:
    """Evidence of a mapper: each pattern that is about form or reputation, or that names the benchmark, with its place."""

    def one(p: Column, i: Column, own: Column) -> Column:
        at = i.cast("string")
        leak = lambda t: F.concat(F.lit("leaks:"), at, F.lit(":"), F.replace(first_phrase(t, (*surface, *reputation)), F.lit(" "), F.lit("_")))
        return let(words(p), lambda t: F.array_compact(F.array(leak(t), F.when(mentions(t, own), F.concat(F.lit("names_benchmark:"), at)))))

    return let(benchmark_phrases(name), lambda own: F.flatten(F.transform(F.coalesce(patterns, F.array().cast("array<string>")), lambda p, i: one(p, i, own))))


def rationale_faults(level: Column, rationale: Column, name: Column, forbidden: tuple[str, ...] = SURFACE + REPUTATION, nothing: tuple[str, ...] = NO_EVIDENCE) -> Column:
    """Evidence of a maker: a rationale that leaks, that names the benchmark, or that says there is none for a level that isn't absent."""
    held = F.coalesce(F.lower(F.trim(level)), F.lit(""))
    return let(words(rationale), lambda t: F.array_compact(F.array(
        F.concat(F.lit("leaks:"), first_phrase(t, forbidden, True)), F.when(leaks_score(t), F.lit("leaks:eval_score")), F.when(mentions(t, benchmark_phrases(name)), F.lit("names_benchmark")),
        F.when(~held.isin("", "absent"), F.concat(F.lit("contradicts:"), held, F.lit(":"), first_phrase(t, nothing, True))))))


def contract_faults(text: Column, required: tuple[str, ...], allowed: tuple[str, ...] = (), banned: tuple[str, ...] = (), lists: tuple[str, ...] = (), filled: tuple[str, ...] = ()) -> Column:
    """A JSON object against its keys: missing, banned and other ones, what is no list, what is blank. 'no_object' for anything else."""
    m = F.from_json(text, "map<string,string>")
    keys = F.map_keys(m)
    arr = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    joined = lambda label, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{label}:"), F.array_join(F.array_sort(xs), "+")))
    rules = [
        joined("missing", F.array_except(arr(required), keys)), joined("banned", F.array_intersect(arr(banned), keys)), joined("extra", F.array_except(keys, arr((*required, *allowed, *banned)))),
        *[F.when(F.array_contains(keys, x) & ~F.coalesce(F.ltrim(F.try_element_at(m, F.lit(x))).startswith("["), F.lit(False)), F.lit(f"no_list:{x}")) for x in lists],
        *[F.when(F.array_contains(keys, x) & (F.coalesce(F.trim(F.try_element_at(m, F.lit(x))), F.lit("")) == ""), F.lit(f"empty:{x}")) for x in filled],
    ]
    return F.when(m.isNull(), F.array(F.lit("no_object"))).otherwise(F.array_compact(F.array(*rules)))


def levels_valid(levels: Column, axes: tuple[str, ...]) -> Column:
    """A map has exactly the axes and only legal levels."""
    return F.coalesce((F.array_sort(F.map_keys(levels)) == F.array(*map(F.lit, sorted(axes)))) & F.forall(F.map_values(levels), lambda x: x.isin("absent", "weak", "medium", "strong", "dominant")), F.lit(False))


def vocabulary_faults(vocab: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """``vocab`` (id, name, definition) with ``faults``: an id that is none, an id given before, no definition, a forbidden phrase."""
    text = words(F.concat_ws(" ", "id", "name", "definition"))
    again = F.row_number().over(W.partitionBy("id").orderBy("name")) > 1  # a catalog
    leak = first_phrase(text, forbidden)
    why = F.array_compact(F.array(F.when(~F.coalesce(F.col("id").rlike("^[a-z][a-z0-9_]*$"), F.lit(False)), F.lit("invalid_id")), F.when(again, F.lit("duplicate_id")), F.when(F.coalesce(F.trim("definition"), F.lit("")) == "", F.lit("no_definition")), F.when(leak.isNotNull(), F.concat(F.lit("leaks:"), leak))))
    return vocab.withColumn("faults", why)


def taxonomy_faults(vocab: Column, seed: Column, most_new: int = 4) -> Column:
    """Ids of a new vocabulary against those of the one before."""
    distinct = F.array_distinct(vocab)
    return reasons((F.size(F.array_except(seed, vocab)) > 0, "seed_missing"), (F.size(vocab) > F.size(seed) + most_new, "too_many_new"), (F.size(vocab) < F.size(seed), "smaller_than_seed"), (F.size(distinct) < F.size(vocab), "duplicate_ids"))


def allowed_part(text: Column) -> Column:
    """A text without the clauses that forbid something (unless what they forbid is to ignore it)."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), r"\n+|;")
    return F.array_join(F.filter(parts, lambda p: ~F.lower(p).rlike(PROHIBITS) | F.lower(p).rlike(TURNS)), " ")


def prompt_faults(prompt: Column, vocab: tuple[str, ...], names: tuple[str, ...], forbidden: tuple[tuple[str, str], ...], most: int = 3_500, least: int = 0) -> Column:
    """Guards of a prompt: its length, words that must stand in it, names that must not, score literals and forbidden patterns outside of prohibitions."""
    p = F.coalesce(prompt, F.lit(""))
    rest, n = allowed_part(p), F.length(F.trim(p))
    missing = F.filter(F.array(*map(F.lit, vocab)), lambda v: ~F.contains(p, v))
    rules = [F.when(p == "", "empty").when(n > most, "too_long").when(n < least, "too_short"), F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, "+")))]
    rules += [F.when(p.rlike(rf"\b{x}\b"), F.lit(f"names:{x}")) for x in names]
    rules += [F.when(rest.rlike(SCORE_LITERAL), F.lit("score_literal"))]
    rules += [F.when(F.lower(rest).rlike(x), F.lit(label)) for label, x in forbidden]
    return F.array_compact(F.array(*rules))


def manifest_faults(m: dict[str, Column], kind: str, version: int) -> Column:
    """A manifest's type, schema_version, sources (ARRAY of STRUCT with benchmark, repo_id and n_samples) and method."""
    s = F.coalesce(m["sources"], F.array().cast("array<struct<benchmark:string,repo_id:string,n_samples:bigint>>"))
    one = lambda x, i: F.array_compact(F.array(F.when((F.coalesce(x["benchmark"], F.lit("")) == "") | (F.coalesce(x["repo_id"], F.lit("")) == ""), F.concat(F.lit("source_incomplete:"), i.cast("string"))), F.when(F.coalesce(x["n_samples"] <= 0, F.lit(True)), F.concat(F.lit("source_without_samples:"), i.cast("string")))))
    head = reasons((F.coalesce(m["type"] != kind, F.lit(True)), "type"), (F.coalesce(m["schema_version"] != version, F.lit(True)), "schema_version"), (F.size(s) == 0, "no_sources"))
    return F.concat(head, F.flatten(F.transform(s, one)), reasons((F.coalesce(m["method"] != "concat", F.lit(True)), "method")))


# rows of any shape


def probed(row: Column, candidates: tuple[str, ...]) -> Column:
    """The first of the candidate keys (whatever its case) of a MAP that has a value that says something, cut to 500 letters."""
    low = F.transform_keys(row, lambda k, v: F.lower(k))
    return F.coalesce(*[F.nullif(F.trim(F.substring(F.try_element_at(low, F.lit(c.lower())), 1, 500)), F.lit("")) for c in candidates])


def list_text(c: Column) -> Column:
    """A JSON list as its first eight elements with ' / ' between; other text as it is."""
    xs = F.from_json(c, "array<string>")
    return F.when(c.startswith("["), F.array_join(F.slice(xs, 1, 8), " / ")).otherwise(c)


def uniform_item(group: Column, place: Column, text: Column, answer: Column, raw: Column) -> list[Column]:
    """(item_id, question, answer): an id with the place in five digits; a row without a question gives its JSON, 800 letters of it."""
    return [F.concat(group, F.lit("_"), F.lpad(place.cast("string"), 5, "0")).alias("item_id"), F.coalesce(text, F.concat(F.lit("[raw] "), F.substring(raw, 1, 800))).alias("question"), F.coalesce(answer, F.lit("")).alias("answer")]


def cut(c: Column, most: int) -> Column:
    """A text of at most ``most`` letters, '...' in place of what is cut."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most)), F.lit("..."))).otherwise(c)


def level_of(c: Column) -> Column:
    """A level by any of its names, absent for all else."""
    key = F.replace(F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVEL_NAMES.items() for x in kv]), key), F.lit("absent"))


def coerced_weights(raw: Column, vocab: tuple[str, ...], low: float = 0.0, high: float = 1.0) -> tuple[Column, Column]:
    """(weights, drift) of a MAP of texts: every tag of the vocabulary, within bounds, and what had to be mended."""
    neutral = min(max(0.0, low), high)
    v = {t: F.try_element_at(raw, F.lit(t)) for t in vocab}
    n = {t: F.when(~F.isnan(c.try_cast("double")) & (F.abs(c.try_cast("double")) < float("inf")), c.try_cast("double")) for t, c in v.items()}
    weights = F.create_map(*[x for t in vocab for x in (F.lit(t), F.when(n[t].isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), n[t]))).otherwise(F.lit(neutral)))])
    extra = F.size(F.array_except(F.map_keys(raw), F.array(*map(F.lit, vocab))))
    missing = sum((F.when(c.isNull(), 1).otherwise(0) for c in v.values()), F.lit(0))
    drift = F.array_compact(F.array(*[F.when(v[t].isNotNull() & n[t].isNull(), F.lit(f"no_number:{t}")) for t in vocab], F.when(extra > 0, F.concat(F.lit("dropped:"), extra.cast("string"))), F.when(missing > 0, F.concat(F.lit("filled:"), missing.cast("string")))))
    return weights, F.when(raw.isNull(), F.array(F.lit("no_weights"))).otherwise(drift)


def loss_bucket(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "unknown").when(c < 0.03, "low").when(c < 0.08, "moderate").otherwise("high")


def signed_bucket(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "unknown").when(c > 0.15, "strong_positive").when(c > 0, "positive").when(c < -0.15, "strong_negative").when(c < 0, "negative").otherwise("neutral")


def residual_bucket(c: Column) -> Column:
    v = F.abs(c)
    return F.when(c.isNull() | F.isnan(c), "unknown").when(v < 0.10, "small").when(v < 0.30, "medium").otherwise("large")


def anonymous(text: Column, name: Column, ref: Column) -> Column:
    """A text with the benchmark's line and name replaced by ``ref``, whatever their case."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(r"(?im)^\s*Benchmark\s*:\s*.*$"), F.concat(F.lit("Benchmark: "), ref))
    return F.when(F.coalesce(name, F.lit("")) == "", t).otherwise(F.regexp_replace(t, F.concat(F.lit(r"(?i)\Q"), name, F.lit(r"\E")), ref))


def snippet(text: Column, most: int) -> Column:
    """A definition on one line, up to where its evidence begins, cut at a word."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    t = F.trim(F.regexp_replace(t, r"(?is)observable evidence includes.*$", ""))
    t = F.regexp_replace(t, r"[ .;:]+$", "")
    short = F.regexp_replace(F.regexp_replace(F.substring(t, 1, most - 1), r" [^ ]*$", ""), r"[ .;:]+$", "")
    return F.when(t == "", "").when(F.length(t) <= most, F.concat(t, F.lit("."))).otherwise(F.concat(short, F.lit(".")))


def repo_name(c: Column) -> Column:
    """A name of a-z, 0-9, '.', '_' and '-' of up to 80 letters that starts with none of the marks; null if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", "")
    return F.nullif(F.regexp_replace(F.substring(s, 1, 80), r"[-._]+$", ""), F.lit(""))


def vendor_of(c: Column) -> Column:
    low = F.lower(c)
    out = F.when(low.startswith("gpt"), "OpenAI")
    for sign, vendor in VENDORS:
        out = F.when(low.contains(sign), vendor) if sign == "claude" else out.when(low.contains(sign), vendor)
        if sign == "claude":
            out = out.when(low.startswith("gpt"), "OpenAI")
    return out.otherwise("Unknown")


def salvaged(text: str | None) -> tuple[str, str | None]:
    """(how, json) of a text that should be JSON: 'whole', 'fenced', 'object' (the first balanced one), 'rows' (whole objects of a
    list that breaks off) or 'none'."""
    s = (text or "").strip()
    for how, t in (("whole", s), ("fenced", s.split("```")[1].removeprefix("json").strip() if s.count("```") >= 2 else "")):
        try:
            return how, json.dumps(json.loads(t))
        except (ValueError, RecursionError):
            pass
    decoder, rows, at, whole = json.JSONDecoder(), [], s.find("{"), s.find("[")
    listed = 0 <= whole < at
    while at >= 0:
        try:
            x, end = decoder.raw_decode(s, at)
        except (ValueError, RecursionError):
            if listed or not rows:
                break
            end = at + 1
        else:
            rows.append(x)
            if not listed:
                return "object", json.dumps(x)
        at = s.find("{", end)
    return ("rows", json.dumps(rows)) if rows else ("none", None)


def salvage(drops: DataFrame) -> DataFrame:
    """(drop_id, how, salvaged) of every payload."""

    def run(batches):
        for pdf in batches:
            found = [salvaged(x) for x in pdf["payload"]]
            yield pd.DataFrame({"drop_id": pdf["drop_id"], "how": [h for h, _ in found], "salvaged": [x for _, x in found]})

    return drops.select(F.col("drop_id").cast("bigint").alias("drop_id"), "payload").mapInPandas(run, "drop_id bigint, how string, salvaged string")
