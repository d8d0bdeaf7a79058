"""Names, configs, levels, answers and graphs: the operators on texts and small structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.runtime import stash


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9.+']+", "-"), r"^-+|-+$", "")


# Words of effort and qualifiers of snapshots that follow a model's name.
EFFORTS = ("high", "low", "medium", "minimal", "xhigh", "none", "unknown", "default", "think", "thinking", "reasoning")
QUALIFIERS = ("preview", "exp", "experimental", "webapp", "web-app")
PEELED = rf"(?i)((?:\s*[_ -](?:\d+k|max|{'|'.join(EFFORTS)}))+)$"
SNAPSHOT = r"(?:[-_]\d{4}[-_]\d{2}[-_]\d{2}|[-_]\d{8})+$"
QUALIFIED = rf"(?i)(?:[-_](?:{'|'.join(QUALIFIERS)}))+$"


def split_name(c: Column) -> tuple[Column, Column]:
    """(base, tag) of a model name as typed; tag is null if nothing tells one.

    A provider before '/', what stands in brackets at the end, budgets and efforts at the end, then dates and qualifiers are
    taken off. The tag has budgets and efforts in the order of the text, then the bracket.
    """
    s = F.regexp_replace(_stripped(c), r"^[A-Za-z0-9._-]+/", "")
    bracket = F.when(s.rlike(r"^.*?\s*\([^)]*\)\s*$"), F.trim(F.regexp_extract(s, r"^(.*?)\s*\(([^)]*)\)\s*$", 2)))
    s = F.when(bracket.isNotNull(), F.trim(F.regexp_extract(s, r"^(.*?)\s*\(([^)]*)\)\s*$", 1))).otherwise(s)
    words = F.filter(F.split(F.lower(F.regexp_extract(s, PEELED, 1)), r"[_ \-]+"), lambda x: x != "")
    words = F.transform(words, lambda x: F.when(x.rlike(r"^\d+k$"), F.upper(x)).otherwise(x))
    tags = F.concat(words, F.when(bracket.isNotNull(), F.array(bracket)).otherwise(F.array().cast("array<string>")))
    base = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(s, PEELED, "")), SNAPSHOT, ""), QUALIFIED, ""))
    return base, F.when(F.size(tags) > 0, F.array_join(tags, ", "))


# The one spelling of config tokens that come in several; others keep theirs.
TOKENS = {
    "codex": "Codex CLI", "codex cli": "Codex CLI", "forgecode": "Forge Code", "forge code": "Forge Code", "grok-cli": "Grok CLI", "grok cli": "Grok CLI",
    "no tool": "no tools", "no tools": "no tools", "with tool": "with tools", "with tools": "with tools", "without tool": "without tools", "without tools": "without tools",
    "high": "high", "low": "low", "medium": "medium", "max": "max", "minimal": "minimal", "xhigh": "xhigh", "base": "base",
    "high effort": "high effort", "low effort": "low effort", "medium effort": "medium effort", "max effort": "max effort", "default effort": "default effort",
    "thinking": "thinking", "non-thinking": "non-thinking", "non thinking": "non-thinking", "adaptive thinking": "adaptive thinking", "reasoning": "reasoning", "non-reasoning": "non-reasoning",
    "diamond": "Diamond",
}


def config_tokens(c: Column) -> Column:
    """A config with each token in its one spelling, once whatever its case, in order; 'default' if there is none."""
    known = F.create_map(*[F.lit(x) for kv in TOKENS.items() for x in kv])
    one = lambda t: F.coalesce(F.try_element_at(known, F.lower(F.trim(t))), F.when(F.lower(F.trim(t)).rlike(r"^pass@\d+$"), F.lower(F.trim(t))), F.trim(t))
    parts = F.transform(F.split(c, r"\s*,\s*"), one)
    low = F.transform(parts, lambda x: F.lower(x))
    out = F.array_join(F.filter(parts, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), ", ")
    return F.when(F.coalesce(c, F.lit("")) == "", "default").when(c == "default", c).otherwise(out)


def merged_config(before: Column, more: Column) -> Column:
    """Tokens of ``more`` after those of ``before``; an empty or default one gives way."""
    has = F.coalesce(more, F.lit("")) != ""
    first = F.coalesce(F.nullif(before, F.lit("")), F.lit("default"))
    return F.when(~has, config_tokens(first)).when(first == "default", more).otherwise(config_tokens(F.concat_ws(", ", first, more)))


def benchmark_name(c: Column) -> tuple[Column, Column]:
    """(base, config) of a benchmark name: all that stands in brackets at its end is the config, null if nothing does."""
    whole = r"^([^(]+?)\s*\((.+)\)\s*$"
    there = c.rlike(whole)
    return F.when(there, F.trim(F.regexp_extract(c, whole, 1))).otherwise(F.trim(c)), F.when(there, F.trim(F.regexp_replace(F.regexp_extract(c, whole, 2), r"\)\s*\(", ", ")))


def benchmark_slug(c: Column) -> Column:
    """Id of a benchmark name; dots, plus signs and apostrophes stay."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[()\[\]/]", " "), r"\s+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9.+'-]", ""), r"-+", "-"), r"^-|-$", "")


def plain_slug(c: Column) -> Column:
    """Words joined by '-', anything else gone."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def family(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"^([a-z]+)", 1)


# What in a benchmark's name tells its stratum, in order.
STRATA = (("math", ("AIME", "MATH", "GSM")), ("code", ("HUMANEVAL", "MBPP", "HUMAN EVAL", "CODE")), ("knowledge", ("MMLU", "GPQA", "HLE", "SIMPLEQA", "SUPERGPQA")))
# How the names of model families start.
FAMILIES = (("claude", "claude"), ("gpt-", "gpt"), ("gpt_", "gpt"), ("qwen", "qwen"), ("llama", "llama"), ("gemma", "gemma"), ("deepseek", "deepseek"), ("kimi", "kimi"), ("glm", "glm"), ("phi", "phi"))


def stratum(c: Column) -> Column:
    out = None
    for name, signs in STRATA:
        hit = F.upper(c).rlike("|".join(signs))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("reasoning")


def model_family(c: Column) -> Column:
    """A known family by how the name starts, else what stands before the first '-'."""
    s = F.lower(F.trim(c))
    out = None
    for start, name in FAMILIES:
        out = F.when(s.startswith(start), name) if out is None else out.when(s.startswith(start), name)
    return out.otherwise(F.coalesce(F.nullif(F.substring_index(s, "-", 1), F.lit("")), s))


# What in a benchmark's name tells its category, in order.
CATEGORIES = (
    ("general", r"(mmlu|hle|arc|bbh|gpqa|gdpval|trivia|hellaswag)"),
    ("math", r"(aime|math|gsm|hmmt|theorem|usamo|frontier|hidden)"),
    ("coding", r"(humaneval|mbpp|swe|livecode|aider|terminal|codeforces|cruxeval|scicode|monorepo|crux)"),
    ("agent", r"(tau2|browsecomp|mcp|osworld|toolathlon|mle|acebench|bfcl|nexus|vending)"),
    ("multimodal", r"(mmmu|charxiv|videommmu|chart|vibe-eval|zerobench|omnidoc)"),
    ("multilinguality", r"(mmmlu|mgsm|include|wmt|multi-|eclektic|global-mmlu)"),
    ("long", r"(longbench|mrcr|loft|nih|infinite|zeroscrolls|aa-lcr|graphwalks|frames)"),
    ("factuality", r"(simpleqa|faiths|facts|faithjudge|natural|trivia)"),
    ("safety", r"(jailbreak|safety|bbq|cve|cyber|ctf)"),
    ("health", r"(health|bio)"),
    ("preference", r"(arena|writingbench|alpaca|wildbench|mt-bench|preference)"),
    ("instruction", r"(ifeval|ifbench|collie|multichallenge|protocol)"),
    ("korean", r"^k|^ko-|^kor|kbank|click|kobalt|hrm8k|kgc"),
    ("chinese", r"^c-?eval|cmmlu|cmath|csimpleqa|cluewsc"),
)
# Benchmarks whose scores don't repeat.
UNSTEADY = r"(arena-hard|chatbot.?arena|alpaca.?eval|wildbench|writingbench|mt-bench|livebench)"


def category_of(c: Column) -> Column:
    """Category of a benchmark by its name; the first that fits."""
    out = None
    for name, sign in CATEGORIES:
        hit = F.lower(c).rlike(sign)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def unsteady(c: Column) -> Column:
    return F.lower(c).rlike(UNSTEADY)


def item_profiles(items: DataFrame) -> DataFrame:
    """(benchmark, tag, weight): mean level weight over the valid items; items (benchmark, tag, weight, valid)."""
    return items.groupBy("benchmark", "tag").agg(F.coalesce(F.avg(F.when(F.col("valid"), F.col("weight"))), F.lit(0.0)).alias("weight"))


# Words for numbers.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def final_answer(c: Column) -> Column:
    """What follows the last 'answer:' on its line, else the last line."""
    hits = F.regexp_extract_all(c, F.lit(r"(?i)answer\s*[:\-]\s*([^\n]+)"), 1)
    return F.when(F.size(hits) > 0, _stripped(F.try_element_at(hits, F.lit(-1)))).otherwise(_stripped(F.regexp_extract(_stripped(c), r"([^\n]*)$", 1)))


def first_number(c: Column) -> Column:
    return F.regexp_extract(F.replace(c, F.lit(",")), r"-?\d+(?:\.\d+)?", 0)


def last_number(c: Column) -> Column:
    """Text of the last number, '' if there is none; commas within numbers are dropped."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(F.replace(c, F.lit(",")), F.lit(r"-?\d+(?:\.\d+)?"), 0), F.lit(-1)), F.lit(""))


def grade_letter(text: Column, gold: Column) -> Column:
    """1 if the first capital or digit from 1 of the final answer is the gold label."""
    return (F.regexp_extract(F.upper(final_answer(text)), r"[A-Z1-9]", 0) == F.upper(_stripped(gold))).cast("double")


def grade_short(text: Column, gold: Column) -> Column:
    """A label in brackets by its letter; else equal texts, a short gold that the answer starts with, or equal brackets."""
    pred, g = final_answer(text), _stripped(gold)
    norm = lambda c: F.regexp_replace(F.lower(_stripped(c)), r"\s+", " ")
    a, b = norm(F.regexp_replace(pred, r"\.+$", "")), norm(g)
    word = lambda c: c.rlike(r"^[A-Za-z0-9_]$")
    starts = (F.size(F.split(b, " ")) <= 2) & F.startswith(a, b) & (word(F.right(b, F.lit(1))) != word(F.substr(a, F.length(b) + 1, F.lit(1))))
    brackets = b.rlike(r"[\[\](){}<>]") & (F.regexp_replace(a, r"\s+", "") == F.regexp_replace(b, r"\s+", ""))
    label = F.regexp_extract(g, r"^\(([A-Z])\)$", 1)
    return F.when(label != "", F.regexp_extract(F.upper(pred), r"[A-Z]", 0) == label).otherwise((a == b) | starts | brackets).cast("double")


def f1_tokens(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\b(a|an|the)\b", " "), r"[^a-z0-9 ]", " ")
    return F.filter(F.split(s, " +"), lambda x: x != "")


def token_f1(answer: Column, gold: Column) -> Column:
    """Multiset F1 of the words of two texts without articles; 1 if both are empty, 0 if one is."""
    a, b = f1_tokens(answer), f1_tokens(gold)
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    same = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2 * same / total)


def numbers_in_words(c: Column) -> Column:
    for n, w in enumerate(NUMBER_WORDS):
        c = F.regexp_replace(c, rf"(?i)\b{w}\b", str(n))
    return c


def grade_spans(text: Column, golds: Column) -> Column:
    """Greatest F1 over the golds; a gold that is a number is met by the same first number, in words or digits."""
    pred = final_answer(text)
    number = first_number(numbers_in_words(pred))
    one = lambda g: F.when(_stripped(g).rlike(r"^-?\d+(?:\.\d+)?$") & (number == _stripped(g)), 1.0).otherwise(token_f1(pred, g))
    return F.coalesce(F.array_max(F.transform(golds, one)), F.lit(0.0))


def grade_boxed(text: Column, gold: Column) -> Column:
    """The last boxed text, else the final answer, equal to the gold but for typesetting, or within 1e-6 as a number."""
    boxed = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"), 1), F.lit(-1))
    pred = F.coalesce(_stripped(boxed), final_answer(text))
    canon = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\left|\\right|\\!|\\,|\$| ", ""), r"\\dfrac", r"\\\\frac"), r"\.+$", ""))
    a, b = first_number(pred).try_cast("double"), first_number(gold).try_cast("double")
    return ((canon(pred) == canon(gold)) | F.coalesce(F.abs(a - b) < 1e-6, F.lit(False))).cast("double")


def grade_last_number(text: Column, gold: Column) -> Column:
    n = last_number(final_answer(text))
    return ((n != "") & (n == last_number(gold))).cast("double")


def min_label(pairs: DataFrame) -> DataFrame:
    """(name, component, size) of a catalog-sized graph (p, q): smallest label wins, with pointer jumping until nothing moves."""
    both = stash(pairs.select("p", "q").unionByName(pairs.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct(), "graph")
    label = stash(both.groupBy(F.col("p").alias("name")).agg(F.least(F.min("q"), F.first("p")).alias("component")), "label")
    while True:
        near = both.join(label.select(F.col("name").alias("q"), "component"), "q").groupBy(F.col("p").alias("name")).agg(F.min("component").alias("c"))
        step = label.join(near, "name").select("name", F.least("component", "c").alias("c"), "component")
        after = step.join(step.select(F.col("name").alias("c"), F.col("c").alias("up")), "c", "left").select("name", F.least(F.coalesce("up", "c"), "c").alias("component"), F.col("component").alias("_old"))
        after = stash(after, "label")
        label = after.drop("_old")
        if after.where("component <> _old").isEmpty():
            return label.join(label.groupBy("component").agg(F.count("*").alias("size")), "component").select("name", "component", "size")


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, node, distance) of a tree (parent, child), each node with itself at 0; one join for each doubling of the depth."""
    nodes = edges.select(F.col("parent").alias("node")).unionByName(edges.select(F.col("child").alias("node"))).distinct()
    out = stash(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("distance")), "paths")
    reach = 1
    while True:
        far = out.where(F.col("distance") == reach)
        more = stash(far.select("ancestor", F.col("node").alias("_mid")).join(out.select(F.col("ancestor").alias("_mid"), "node", F.col("distance").alias("_d")), "_mid").select("ancestor", "node", (F.col("_d") + reach).alias("distance")), "paths")
        if more.isEmpty():
            break
        out, reach = out.unionByName(more), 2 * reach
    return out.unionByName(nodes.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("distance")))
