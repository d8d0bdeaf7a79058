"""Queries of the rules over texts and JSON, of rows made uniform, and of readers and sinks over landed files."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.cleaning import kind_key, name_key, usable_score
from rankloom.functions.semantics import clamp, level_weight, weight_level
from rankloom.operators import rules as R
from rankloom.operators import views as V
from rankloom.plans.alignment import BASE, matrix, pair_table, tag_weights
from rankloom.plans.study import _ITEMS, _iterations, _items
from rankloom.runtime import shared_dir, small
from rankloom.runtime import table as t
from rankloom.sources import readers as S

_NO, _PRICE, _CUES = ("no", "not", "nobody", "nothing"), ("price", "prices", "sale"), ("the", "of", "and")
_FORM = ("5 shot", "0 shot", "with tools", "pass 10")
_EXTRA_KEYS = ("leaderboard_model_name", "votes", "ci", "vendor", "tags")


def _folder(s, what):
    return f"{shared_dir(s)}/{what}-{uuid.uuid4().hex}"


def fl9_unnegated(s, d):
    """Whether a page has 'of the', has it without a negation before, and speaks of prices near a cue."""
    w = R.words(F.col("text"))
    return t(s, d, "documents").select("doc_id", R.has_phrase(w, "of the").alias("has"), R.has_unnegated(w, "of the", _NO).alias("unnegated"), R.leaks_score(w, _PRICE, _CUES, _NO).alias("leaks"))


def fl10_mapper_faults(s, d):
    """Configs of a record, and the same with the benchmark named, as patterns of a mapper."""
    p = F.array(F.coalesce("config", F.lit("")), F.concat_ws(" on ", "config", "benchmark_id"))
    return t(s, d, "score_records").where("benchmark_id is not null").select("record_id", F.array_join(R.pattern_faults(p, F.col("benchmark_id"), _FORM, ("percent",)), ",").alias("faults"))


def fl11_maker_faults(s, d):
    """Configs as rationales of a level that hangs on the score."""
    level = F.when(F.coalesce(F.col("score") < 1, F.lit(True)), " Absent").otherwise("Strong")
    r = F.concat(F.coalesce("config", F.lit("")), F.lit(", not pass@10, no evidence of the model score"))
    return t(s, d, "score_records").select("record_id", F.array_join(R.rationale_faults(level, r, F.col("benchmark_id"), _FORM), ",").alias("faults"))


def fl21_role_audit(s, d):
    """Of each run: outputs of mappers and makers that have faults, and whether the run's evidence is clean."""
    m, k = fl10_mapper_faults(s, d).select("record_id", (F.col("faults") != "").alias("mapper")), fl11_maker_faults(s, d).select("record_id", (F.col("faults") != "").alias("maker"))
    r = t(s, d, "score_records").select("record_id", "run_id").join(m, "record_id", "left").join(k, "record_id", "left")
    g = r.groupBy("run_id").agg(F.count("mapper").alias("outputs"), F.count_if("mapper").alias("mappers"), F.count_if("maker").alias("makers"))
    return g.withColumn("clean", (F.col("mappers") == 0) & (F.col("makers") == 0))


def fl12_vocabulary(s, d):
    """Benchmarks as a vocabulary: ids of their first words."""
    v = t(s, d, "benchmarks").select(F.col("id").alias("benchmark"), F.regexp_replace(F.regexp_replace("id", "-(v2|lite|pro|multi|redux|500)$", ""), "-", "_").alias("id"), "name", F.col("description").alias("definition"))
    return R.vocabulary_faults(v, ("vqa tasks", "chat", "arena tasks")).select("benchmark", F.array_join("faults", ",").alias("faults"))


def fl13_prompts(s, d):
    """Pages as prompts."""
    f = R.prompt_faults(F.col("text"), ("the", "and"), ("London", "Paris", "Berlin"), (("asks_price", r"\bprices?\b"), ("asks_sale", r"\bsale\b")), 3_500, 200)
    return t(s, d, "documents").select("doc_id", F.array_join(f, ",").alias("faults"))


def fl14_taxonomies(s, d):
    """Benchmarks of a run against those of the run before."""
    g = t(s, d, "bench_split").where("run_id is not null and benchmark is not null").groupBy(F.substring("run_id", 5, 10).cast("int").alias("run")).agg(F.sort_array(F.collect_list("benchmark")).alias("v"))  # a run's entries are from the catalog
    before = g.select((F.col("run") + 1).alias("run"), F.array_distinct("v").alias("seed"))
    return g.join(before, "run").select("run", F.array_join(R.taxonomy_faults(F.col("v"), F.col("seed"), 20), ",").alias("faults"))


def fl15_contracts(s, d):
    """``extra`` of a record against a contract of keys."""
    return t(s, d, "score_records").where("extra is not null").select("record_id", F.array_join(R.contract_faults(F.col("extra"), ("rank",), _EXTRA_KEYS, ("price",), ("tags",), ("vendor",)), ",").alias("faults"))


def fl16_tag_parses(s, d):
    """Levels of a tagger on a category, without the weakest axes: valid if all are there."""
    p = _items(s, d).groupBy("tagger", "benchmark", "axis").agg(F.round(F.avg("weight"), 6).alias("w")).where("w >= 0.3")
    g = p.groupBy("tagger", "benchmark").agg(F.map_from_entries(F.collect_list(F.struct("axis", weight_level(F.col("w"))))).alias("levels"))  # five axes
    return g.select("tagger", "benchmark", R.levels_valid(F.col("levels"), ("dated", "linked", "referred", "reported", "varied")).alias("valid"))


def fl17_manifests(s, d):
    """Manifests made of the wanted sources by their cap: some have no samples, one has another method."""
    m = t(s, d, "mix_targets").groupBy("max_repeats").agg(F.sort_array(F.collect_list(F.struct(F.col("source").alias("benchmark"), F.when(F.col("target_share") > 0.025, F.col("source")).alias("repo_id"), F.floor(F.col("target_share") * 25).alias("n_samples")))).alias("sources"))
    cols = {"type": F.when(F.col("max_repeats") < 5, F.lit("mix")), "schema_version": F.lit(1), "sources": F.col("sources"), "method": F.when(F.col("max_repeats") != 1, F.lit("concat"))}
    return m.select("max_repeats", F.array_join(R.manifest_faults(cols, "mix", 1), ",").alias("faults"))


def _rows(s, d):
    return t(s, d, "score_records").where("benchmark_id is not null").withColumn("row", F.from_json("extra", "map<string,string>"))


def pj13_probed(s, d):
    """The first of several keys of ``extra`` that says something, and its tags as text."""
    return _rows(s, d).select("record_id", R.probed(F.col("row"), ("LEADERBOARD_MODEL_NAME", "Vendor", "rank")).alias("field"), R.list_text(F.try_element_at("row", F.lit("tags"))).alias("tags")).where("field is not null or tags is not null")


def pj14_thinned(s, d):
    """Rows with a model's name are thinned to it and their vendor; others keep the keys that matter."""
    r = F.col("row")
    named = R.probed(r, ("leaderboard_model_name",))
    rest = F.map_filter(r, lambda k, v: k.isin("rank", "votes"))
    return _rows(s, d).where("row is not null").select("record_id", F.when(named.isNotNull(), F.concat_ws("\n\n", F.concat(F.lit("Name: "), named), R.probed(r, ("vendor",)))).otherwise(F.nullif(F.array_join(F.transform(F.array_sort(F.map_keys(rest)), lambda k: F.concat(k, F.lit("="), F.try_element_at(rest, k))), ","), F.lit(""))).alias("thin")).where("thin is not null")


def pj15_items(s, d):
    """Records as items of their benchmark, numbered in order within it (in two steps: one benchmark has a tenth of the rows)."""
    q = V.placed(_rows(s, d).select("benchmark_id", "record_id", "row", "extra"), ["benchmark_id"], ["record_id"])
    return q.select("record_id", *R.uniform_item(name_key(F.col("benchmark_id")), F.col("place"), R.probed(F.col("row"), ("leaderboard_model_name", "vendor")), R.probed(F.col("row"), ("rank",)), F.coalesce("extra", F.lit("{}"))))


def pj16_examples(s, d):
    """Pages as examples: a header and the text on one line, cut to 300 letters."""
    return t(s, d, "documents").select("doc_id", F.concat_ws("\n", F.concat(F.lit("["), F.coalesce("source", F.lit("?")), F.lit("]")), R.cut(F.regexp_replace(F.coalesce("text", F.lit("")), "[\n\t ]+", " "), 300)).alias("example"))


def pj17_levels(s, d):
    """Levels as typed, and line numbers in their place, by name and weight."""
    q = t(s, d, "lineitem").select(F.when(F.col("l_quantity") < 10, "Weak ").when(F.col("l_quantity") < 20, "MODERATE").when(F.col("l_quantity") < 30, F.col("l_linenumber").cast("string")).when(F.col("l_quantity") < 40, "High").otherwise("very-odd").alias("typed"))
    return q.groupBy("typed").agg(F.count(F.lit(1)).alias("n")).select("typed", "n", R.level_of(F.col("typed")).alias("level"), level_weight(R.level_of(F.col("typed"))).alias("weight"))


def pj19_static_vectors(s, d):
    """Every tag on every benchmark of the catalog: the weight of the level of its share, within 0.1 and 0.9; the least where there is none."""
    w = tag_weights(s, d)
    grid = t(s, d, "benchmarks").select(F.col("id").alias("benchmark"), F.explode(V.listed(w, "tag")).alias("tag"))
    return grid.join(w, ["benchmark", "tag"], "left").select("benchmark", "tag", clamp(level_weight(weight_level(F.coalesce(F.col("weight") * 4, F.lit(0.0)))), 0.1, 0.9).alias("weight"))


def pj20_coerced(s, d):
    """``extra`` as weights of three tags, and what had to be mended."""
    w, drift = R.coerced_weights(F.from_json("extra", "map<string,string>"), ("rank", "ci", "vendor"), 0.0, 50.0)
    return t(s, d, "score_records").where("extra is not null").select("record_id", *[F.coalesce(F.round(F.try_element_at(w, F.lit(x)), 6), F.lit(0.0)).alias(x) for x in ("rank", "ci", "vendor")], F.array_join(drift, ",").alias("drift"))


def pj22_buckets(s, d):
    p = pair_table(s, d)
    e = F.round(F.col("s") - F.col("r01"), 6)
    return p.groupBy(R.loss_bucket(F.round(e * e, 9)).alias("loss"), R.signed_bucket(e).alias("signed"), R.residual_bucket(e).alias("residual")).agg(F.count(F.lit(1)).alias("n"))


def pj26_content_hash(s, d):
    """First 16 digits of the SHA-256 of a model as JSON with sorted keys."""
    j = F.to_json(F.struct(F.array_sort(F.coalesce("aliases", F.array().cast("array<string>"))).alias("aliases"), "id", "name", F.coalesce("vendor", F.lit("")).alias("vendor")))
    return t(s, d, "models").select("id", F.substring(F.sha2(j, 256), 1, 16).alias("key"))


def pj27_salvaged(s, d):
    """How much of each payload can be read as JSON."""
    return R.salvage(t(s, d, "raw_drops")).groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.count("salvaged").alias("kept"))


def pj28_anonymous(s, d):
    """Descriptions with the benchmark's first word replaced, as a snippet, and with a secret struck out."""
    b = t(s, d, "benchmarks")
    first = F.regexp_extract("id", "^([a-z]+)", 1)
    text = F.concat(F.lit("Benchmark: x\n"), F.coalesce("description", F.lit("")))
    return b.select("id", R.anonymous(text, first, F.lit("B-1")).alias("anonymous"), R.snippet(F.col("description"), 30).alias("snippet"), F.replace(F.col("source_url"), F.lit("hub."), F.lit("***")).alias("scrubbed"))


def pj29_costs(s, d):
    """Tokens of each source's pages at four letters each, and their cost at a price by language."""
    price = F.when(F.lower(F.trim("lang")) == "en", 2).otherwise(3)
    g = t(s, d, "documents").select("source", F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 4).alias("k"), price.alias("price"))
    return g.groupBy("source").agg(F.sum("k").alias("tokens"), F.round(F.sum(F.col("k") * F.col("price")) / 1000, 6).cast("double").alias("cost"))


def pj30_repo_name(s, d):
    return t(s, d, "score_records").where("model_id is not null").groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).select("model_id", "n", R.repo_name(F.col("model_id")).alias("repo"))


def pj33_parsed_models(s, d):
    """Id, bare name, vendor and aliases of model names as typed."""
    m = t(s, d, "score_records").where("model_id is not null").select(F.trim("model_id").alias("raw")).distinct()
    bare = F.regexp_replace("raw", r"\s*\([^)]*\)\s*$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(bare), r"[^a-z0-9.]+", "-"), r"^-+|-+$", "")
    return m.select("raw", slug.alias("id"), bare.alias("name"), R.vendor_of(bare).alias("vendor"), F.size(F.array_distinct(F.array("raw", bare, slug))).alias("aliases"))


def pj33_file_models(s, d):
    """The model that a file is about: what stands before '__' in its name, or all of it."""
    f = t(s, d, "raw_drops").select(F.regexp_replace(F.regexp_replace("file_name", r"(?i)\.json$", ""), "^([a-z]+)-", "$1__").alias("base"))
    return f.groupBy(F.when(F.instr("base", "__") > 1, F.substring_index("base", "__", 1)).otherwise(F.col("base")).alias("model")).agg(F.count(F.lit(1)).alias("n"))


# landed files: written from a table into the shared folder and read again


def sc3_wrapped_cache(s, d):
    """Score maps of which every second one is wrapped under 'scores'."""
    y = matrix(s, d).groupBy("benchmark").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "score")))).alias("cells"))
    own = F.map_from_arrays(F.array("benchmark"), F.array("cells"))
    text = F.when(F.length("benchmark") % 2 == 0, F.to_json(F.struct(own.alias("scores")))).otherwise(F.to_json(own))
    path = _folder(s, "cache")
    y.select(text.alias("value")).write.text(path)
    return S.score_map(s.read.text(path, wholetext=False))


def sc6_label_lines(s, d):
    """JSON lines with blanks, byte order marks and broken lines among them; reviewed ones are kept."""
    b = t(s, d, "bench_split").select(F.to_json(F.struct("entry_id", F.coalesce(F.lower(F.trim("bucket")), F.lit("none")).alias("reviewer_status"))).alias("j"), (F.col("entry_id") % 5).alias("k"))
    path = _folder(s, "labels")
    b.select(F.when(F.col("k") == 0, F.concat(F.lit("\ufeff"), "j")).when(F.col("k") == 1, F.concat("j", F.lit("\n\n"))).when(F.col("k") == 2, F.concat("j", F.lit("\n{broken"))).otherwise(F.col("j")).alias("value")).write.text(path)
    return S.json_lines(s, path, "entry_id bigint, reviewer_status string").where("_corrupt is null and reviewer_status = 'test'").select("entry_id")


def sc7_dataset_map(s, d):
    """A map with full-line comments in it."""
    b = t(s, d, "benchmarks").select(F.concat(F.lit("// "), "name", F.lit("\n"), F.to_json(F.struct("id", F.coalesce("language", F.lit("-")).alias("split"))), F.lit("\n  // end")).alias("value"))
    return b.select(S.commented_json(F.col("value"), "id string, split string").alias("r")).select("r.*")


def sc9_ranges(s, d):
    """Chunks that sample 250 of a source's pages, a hundred at a time."""
    n = t(s, d, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("total"))
    return n.select("source", F.explode(S.sample_ranges(F.col("total"), 250)).alias("r")).select("source", "r.*")


def sc10_full_ranges(s, d):
    n = t(s, d, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("total"))
    return n.select("source", F.explode(S.all_ranges(F.col("total"), 30)).alias("r")).select("source", "r.*")


def sc11_pruned_columns(s, d):
    """A Parquet table without the columns that are too wide to fetch."""
    r = S.without_columns(t(s, d, "score_records"), ("Variants", "EXTRA", "source"))
    return r.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"), F.lit(len(r.columns)).alias("columns"))


def sc13_response_cache(s, d):
    """Response logs in several files: of a key the last line of the last file counts."""
    r = t(s, d, "score_records").where("model_id <> '' and benchmark_id <> ''").select(F.col("model_id").alias("slug"), F.col("benchmark_id").alias("bench"), (F.col("record_id") % 3).alias("part"), "record_id")
    path = _folder(s, "responses")
    r.repartition(3, "part").sortWithinPartitions("part", "record_id").write.partitionBy("part").json(path)
    return S.last_in_files(s.read.schema("slug string, bench string, record_id bigint, part int").json(path), ["slug", "bench"], ["part", "record_id"]).select("slug", "bench", "record_id")


def sc14_csv(s, d):
    """Names with quotes, commas and line feeds written as CSV and read again."""
    b = t(s, d, "benchmarks").select("id", F.concat("name", F.lit(' "x", y\nz')).alias("label"), F.coalesce("note", F.lit("")).alias("note"))
    path = _folder(s, "csv")
    b.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    return S.csv_table(s, path)


def sc16_yaml_blocks(s, d):
    """Fields of blocks in a list of YAML."""
    y = t(s, d, "models").select(F.concat(F.lit("- id: "), "id", F.lit("\n  vendor: '"), F.coalesce("vendor", F.lit("")), F.lit("'\n- note: x\n")).alias("value"))
    return y.select(F.explode(S.yaml_blocks(F.col("value"))).alias("b")).select(S.yaml_field(F.col("b"), "id").alias("id"), S.yaml_field(F.col("b"), "vendor").alias("vendor")).where("id is not null")


def sc17_html_table(s, d):
    """Cells of the matrix as rows of an HTML table for each benchmark."""
    y = matrix(s, d).where("score <= 1").groupBy("benchmark").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("model", "score"))), lambda x: F.concat(F.lit("<tr><td><b>"), x["model"], F.lit("</b></td><td>"), F.format_string("%.7f", x["score"]), F.lit("</td></tr>"))), "\n").alias("h"))
    return y.select("benchmark", F.explode(S.table_rows(F.col("h"))).alias("r")).select("benchmark", "r.name", F.round("r.score", 4).alias("score"))


def sc18_payload_chunks(s, d):
    """Objects out of a page whose script pushes a payload in pieces."""
    m = t(s, d, "models").select("id", F.coalesce("vendor", F.lit("")).alias("vendor"))
    page = m.select(F.concat(F.lit('<script>push([1,"x:{\\"model\\":\\"'), "id", F.lit('\\",\\"ven"])</script><script>push([1,"dor\\":\\"'), "vendor", F.lit('\\"}"])</script>')).alias("html"))
    return page.select(F.explode(S.payload_objects(F.col("html"), ("model", "vendor"))).alias("x")).select("x.*")


def sc20_plan(s, d):
    """Planned cells as CSV with doubled rows and unknown scopes: what is wrong with each."""
    p = t(s, d, "model_split").where("model is not null").select(F.coalesce(F.lower(F.trim("scope")), F.lit("?")).alias("scope"), F.col("run_id").alias("benchmark"), "model")
    path = _folder(s, "plan")
    p.write.csv(path, header=True)
    return S.plan_faults(S.csv_table(s, path), ("seen", "held")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def sk1_pair_json(s, d):
    """Pairs keyed p||q written as JSON and read again."""
    path = _folder(s, "pairs")
    pair_table(s, d).select(F.concat_ws("||", "p", "q").alias("key"), "s", "r").write.json(path)
    return s.read.schema("key string, s double, r double").json(path)


def sk2_artifacts(s, d):
    """Iterations written by fold and iteration; one fold read again by its folder alone."""
    path = _folder(s, "artifacts")
    _iterations(s, d).select("fold", "iter", "scope", "l_align", "n_pairs").write.partitionBy("fold", "iter").parquet(path)
    return s.read.parquet(path).where("fold = 1").select("iter", "scope", "l_align", "n_pairs")


def sk4_nan_to_null(s, d):
    """Scores as JSON in which NaN is null."""
    path = _folder(s, "metrics")
    t(s, d, "score_records").select("record_id", F.when(~F.isnan("score"), F.col("score")).alias("score")).write.json(path, ignoreNullFields=False)
    return s.read.schema("record_id bigint, score double").json(path).groupBy((F.col("record_id") % 100).alias("k")).agg(F.count("score").alias("scores"), F.count_if(F.col("score").isNull()).alias("nulls"))


def sk5_replaced(s, d):
    """Snapshots by source: a new one takes the place of the old one of its source, the others stay."""
    path = _folder(s, "snapshots")
    rows = t(s, d, "score_records").select(F.coalesce(F.nullif(kind_key(F.col("source.kind")), F.lit("")), F.lit("none")).alias("source_id"), "record_id")
    rows.write.partitionBy("source_id").parquet(path)
    rows.where("source_id = 'manual' and record_id % 2 = 0").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)
    return s.read.schema("record_id bigint, source_id string").parquet(path).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def sk7_compacted(s, d):
    """A log appended in two steps and compacted to the last row of each key."""
    path = _folder(s, "log")
    rows = t(s, d, "scores").where("benchmark is not null and model is not null").select("benchmark", "model", F.unix_micros("loaded_at").alias("at"), "run_id")
    rows.where("run_id < 'run-000010'").write.mode("append").json(path)
    rows.where("run_id >= 'run-000010'").write.mode("append").json(path)
    log = s.read.schema("benchmark string, model string, at bigint, run_id string").json(path)
    log.groupBy("benchmark", "model").agg(F.max(F.struct("at", "run_id")).alias("x")).select("benchmark", "model", "x.*").write.parquet(f"{path}-compacted")
    return s.read.parquet(f"{path}-compacted")


def sk9_missing_plan(s, d):
    """Cells of the catalog without a score as CSV, and how many each benchmark lacks."""
    path = _folder(s, "missing")
    from rankloom.operators import align as A

    A.missing_cells(matrix(s, d)).write.csv(path, header=True)
    return S.csv_table(s, path).groupBy("benchmark").agg(F.count(F.lit(1)).alias("missing"))


def sk10_report(s, d):
    """A report in Markdown: a line for each category."""
    g = t(s, d, "benchmarks").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("note").isNotNull()).alias("noted"))
    w = W.partitionBy(F.lit(1)).orderBy(F.desc("n"), "category")  # a few categories
    return g.select((F.row_number().over(w) - 1).alias("line"), F.concat(F.lit("| "), "category", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("noted").cast("string"), F.lit(" |")).alias("text"))


def sk11_corpus_manifest(s, d):
    """Pages written by source, and a manifest of what each has."""
    path = _folder(s, "corpus")
    slug = F.regexp_replace(F.coalesce("source", F.lit("none")), "[^a-z0-9]+", "-")
    t(s, d, "documents").select(slug.alias("slug"), "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("letters")).write.partitionBy("slug").json(path)
    return s.read.schema("doc_id bigint, letters int, slug string").json(path).groupBy("slug").agg(F.count(F.lit(1)).alias("rows"), F.sum("letters").alias("letters"), F.when(F.sum("letters") > 0, "ok").otherwise("empty").alias("status"))


def sx1_latest(s, d):
    """A log in two landings read as a stream: the last row of each key by its time."""
    from rankloom.streaming import log

    base = _folder(s, "stream")
    rows = t(s, d, "model_split").where("model is not null").select("model", "entry_id", "run_id")
    schema = "model string, entry_id bigint, run_id string"
    for part in ("entry_id % 2 = 0", "entry_id % 2 = 1"):
        rows.where(part).write.mode("append").json(f"{base}/in")
        log.keep_latest(s.readStream.schema(schema).json(f"{base}/in"), ["model"], "entry_id", f"{base}/state", f"{base}/check").awaitTermination()
    return log.latest_state(s, f"{base}/state").select("model", "entry_id", "run_id")


def sx3_resumed(s, d):
    """Tasks that a cache has no valid answer for: only these run again."""
    done = t(s, d, "scores").where(usable_score(F.col("score"))).select("run_id", "benchmark", "model").distinct()
    todo = t(s, d, "scores").where("benchmark is not null and model is not null").select("run_id", "benchmark", "model").distinct()
    return todo.join(done, ["run_id", "benchmark", "model"], "left_anti")


def st5_composed(s, d):
    """The first three pages of every wanted source in the order of the manifest, then shuffled by hash; short sources are marked."""
    m = t(s, d, "mix_targets").select("source", "target_share")
    j = m.join(_first_three(t(s, d, "documents").where("source is not null")), "source", "left")
    w = W.partitionBy(F.lit(1)).orderBy(F.md5(F.concat_ws("|", F.lit("42"), "source", F.col("doc_id").cast("string"))), "doc_id")  # three rows of each source
    return j.select("source", F.explode_outer("ids").alias("doc_id"), (F.coalesce(F.size("ids"), F.lit(0)) < 3).alias("short")).withColumn("place", F.row_number().over(w))


def _first_three(docs):
    """The three smallest ids of each source, kept small map-side: each of them in turn."""
    a = docs.groupBy("source").agg(F.min("doc_id").alias("a"))
    b = docs.join(small(a), "source").where("doc_id > a").groupBy("source").agg(F.min("doc_id").alias("b"))
    c = docs.join(small(b), "source").where("doc_id > b").groupBy("source").agg(F.min("doc_id").alias("c"))
    return a.join(b, "source", "left").join(c, "source", "left").select("source", F.array_compact(F.array("a", "b", "c")).alias("ids"))


_HELP = {"matrix", "pair_table", "tag_weights", "shared_dir", "small", "t", "clamp", "level_weight", "weight_level", "kind_key", "name_key", "usable_score"}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[0] != "_" and k not in _HELP | {"W"}}

_L = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_AT = lambda t, p: f"list_filter(range(1, len({t}) - {len(p.split(' ')) - 2}), lambda i: {t}[i:i + {len(p.split(' ')) - 1}] = {_L(p.split(' '))})"
_UN = lambda t, p, no: f"len(list_filter({_AT(t, p)}, lambda i: NOT list_has_any({t}[greatest(i - 4, 1):i - 1], {_L(no)}))) > 0"
_LEAK = lambda t, ws, cues, no: f"len(list_filter(range(1, len({t}) + 1), lambda i: list_contains({_L(ws)}, {t}[i]) AND NOT list_has_any({t}[greatest(i - 4, 1):i - 1], {_L(no)}) AND list_has_any({t}[greatest(i - 3, 1):i + 3], {_L(cues)}))) > 0"
_HAS = lambda t, p: f"len({_AT(t, p)}) > 0"
_FIRST = lambda t, ps, no=None: "CASE " + " ".join(f"WHEN {_UN(t, p, no) if no else _HAS(t, p)} THEN '{p}'" for p in ps) + " END"
_GEN = _L(R.GENERIC)
_OWN = f"list_distinct(list_concat(list_filter(n, lambda x: NOT regexp_full_match(x, '\\d+') AND length(x) >= 3 AND NOT list_contains({_GEN}, x)), CASE WHEN len(n) > 1 THEN [array_to_string(n, ' ')] ELSE [] END))"
_MENTIONS = "len(list_filter(own, lambda p: contains(' ' || array_to_string({0}, ' ') || ' ', ' ' || p || ' '))) > 0"
_KEY = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
_X = "CASE WHEN json_valid(extra) AND json_type(extra) = 'OBJECT' THEN extra::JSON END"
_LEVELS = "CASE replace(replace(lower(trim(typed)), '-', '_'), ' ', '_') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.LEVEL_NAMES.items()) + " ELSE 'absent' END"
_VENDOR = "CASE WHEN contains(lower(name), 'claude') THEN 'Anthropic' WHEN starts_with(lower(name), 'gpt') THEN 'OpenAI' " + " ".join(f"WHEN contains(lower(name), '{k}') THEN '{v}'" for k, v in R.VENDORS[1:]) + " ELSE 'Unknown' END"
_KIND = "coalesce(nullif(regexp_replace(lower(trim(source.kind)), '[ _-]+', '_', 'g'), ''), 'none')"

SQL = {
    "fl9_unnegated": f"SELECT doc_id, {_HAS('w', 'of the')} AS has, {_UN('w', 'of the', _NO)} AS unnegated, {_LEAK('w', _PRICE, _CUES, _NO)} AS leaks FROM (SELECT doc_id, {_TOK.format('text')} AS w FROM documents)",
    "fl10_mapper_faults": f"WITH a AS (SELECT record_id, {_OWN} AS own, {_TOK.format('config')} AS x, {_TOK.format('y')} AS z FROM (SELECT *, {_TOK.format('benchmark_id')} AS n, concat_ws(' on ', config, benchmark_id) AS y FROM score_records WHERE benchmark_id IS NOT NULL)) SELECT record_id, concat_ws(',', 'leaks:0:' || replace({_FIRST('x', (*_FORM, 'percent'))}, ' ', '_'), CASE WHEN {_MENTIONS.format('x')} THEN 'names_benchmark:0' END, 'leaks:1:' || replace({_FIRST('z', (*_FORM, 'percent'))}, ' ', '_'), CASE WHEN {_MENTIONS.format('z')} THEN 'names_benchmark:1' END) AS faults FROM a",
    "fl11_maker_faults": f"WITH a AS (SELECT record_id, score, {_OWN} AS own, {_TOK.format('y')} AS x FROM (SELECT *, {_TOK.format('benchmark_id')} AS n, coalesce(config, '') || ', not pass@10, no evidence of the model score' AS y FROM score_records)) SELECT record_id, concat_ws(',', 'leaks:' || {_FIRST('x', _FORM, R.NEGATIONS)}, CASE WHEN {_LEAK('x', R.SCORE_WORDS, R.SCORE_CUES, R.NEGATIONS)} THEN 'leaks:eval_score' END, CASE WHEN {_MENTIONS.format('x')} THEN 'names_benchmark' END, CASE WHEN score >= 1 THEN 'contradicts:strong:' || {_FIRST('x', R.NO_EVIDENCE, R.NEGATIONS)} END) AS faults FROM a",
    "fl12_vocabulary": f"WITH v AS (SELECT id AS benchmark, regexp_replace(regexp_replace(id, '-(v2|lite|pro|multi|redux|500)$', ''), '-', '_', 'g') AS id, name, description FROM benchmarks), w AS (SELECT *, {_TOK.format(chr(34) + 'all' + chr(34))} AS x, row_number() OVER (PARTITION BY id ORDER BY name) AS k FROM (SELECT *, concat_ws(' ', id, name, description) AS \"all\" FROM v)) SELECT benchmark, concat_ws(',', CASE WHEN NOT regexp_full_match(id, '[a-z][a-z0-9_]*') THEN 'invalid_id' END, CASE WHEN k > 1 THEN 'duplicate_id' END, CASE WHEN coalesce(trim(description), '') = '' THEN 'no_definition' END, 'leaks:' || {_FIRST('x', ('vqa tasks', 'chat', 'arena tasks'))}) AS faults FROM w",
    "fl13_prompts": f"WITH p AS (SELECT doc_id, coalesce(text, '') AS p, length(trim(coalesce(text, ''))) AS n FROM documents), r AS (SELECT *, array_to_string(list_filter(string_split_regex(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+|;'), lambda x: NOT regexp_matches(lower(x), '{R.PROHIBITS.replace(chr(39), chr(39) * 2)}') OR regexp_matches(lower(x), '{R.TURNS}')), ' ') AS rest FROM p) SELECT doc_id, concat_ws(',', CASE WHEN p = '' THEN 'empty' WHEN n > 3500 THEN 'too_long' WHEN n < 200 THEN 'too_short' END, 'missing:' || nullif(concat_ws('+', CASE WHEN NOT contains(p, 'the') THEN 'the' END, CASE WHEN NOT contains(p, 'and') THEN 'and' END), ''), CASE WHEN regexp_matches(p, '\\bLondon\\b') THEN 'names:London' END, CASE WHEN regexp_matches(p, '\\bParis\\b') THEN 'names:Paris' END, CASE WHEN regexp_matches(p, '\\bBerlin\\b') THEN 'names:Berlin' END, CASE WHEN regexp_matches(rest, '{R.SCORE_LITERAL}') THEN 'score_literal' END, CASE WHEN regexp_matches(lower(rest), '\\bprices?\\b') THEN 'asks_price' END, CASE WHEN regexp_matches(lower(rest), '\\bsale\\b') THEN 'asks_sale' END) AS faults FROM r",
    "fl14_taxonomies": "WITH g AS (SELECT substr(run_id, 5)::INT AS run, list(benchmark) AS v FROM bench_split WHERE run_id IS NOT NULL AND benchmark IS NOT NULL GROUP BY 1) SELECT g.run, concat_ws(',', CASE WHEN len(list_filter(list_distinct(b.v), lambda x: NOT list_contains(g.v, x))) > 0 THEN 'seed_missing' END, CASE WHEN len(g.v) > len(list_distinct(b.v)) + 20 THEN 'too_many_new' END, CASE WHEN len(g.v) < len(list_distinct(b.v)) THEN 'smaller_than_seed' END, CASE WHEN len(list_distinct(g.v)) < len(g.v) THEN 'duplicate_ids' END) AS faults FROM g JOIN g b ON b.run + 1 = g.run",
    "fl15_contracts": f"SELECT record_id, CASE WHEN x IS NULL THEN 'no_object' ELSE concat_ws(',', CASE WHEN NOT list_contains(k, 'rank') THEN 'missing:rank' END, CASE WHEN list_contains(k, 'price') THEN 'banned:price' END, 'extra:' || nullif(array_to_string(list_sort(list_filter(k, lambda z: NOT list_contains({_L((*_EXTRA_KEYS, 'rank', 'price'))}, z))), '+'), ''), CASE WHEN list_contains(k, 'tags') AND coalesce(json_type(x, '$.tags'), '') <> 'ARRAY' THEN 'no_list:tags' END, CASE WHEN list_contains(k, 'vendor') AND coalesce(trim(x->>'$.vendor'), '') = '' THEN 'empty:vendor' END) END AS faults FROM (SELECT record_id, x, json_keys(x) AS k FROM (SELECT record_id, {_X} AS x FROM score_records WHERE extra IS NOT NULL))",
    "fl16_tag_parses": f"WITH {_ITEMS.strip()} SELECT tagger, benchmark, count(*) = 5 AS valid FROM (SELECT tagger, benchmark, axis, round(avg(weight), 6) AS w FROM items GROUP BY ALL) WHERE w >= 0.3 GROUP BY 1, 2",
    "fl17_manifests": "WITH m AS (SELECT max_repeats, source, target_share, row_number() OVER (PARTITION BY max_repeats ORDER BY source) - 1 AS i FROM mix_targets) SELECT max_repeats, concat_ws(',', CASE WHEN max_repeats >= 5 THEN 'type' END, nullif(string_agg(nullif(concat_ws(',', CASE WHEN target_share <= 0.025 THEN 'source_incomplete:' || i END, CASE WHEN floor(target_share * 25) <= 0 THEN 'source_without_samples:' || i END), ''), ',' ORDER BY i), ''), CASE WHEN max_repeats = 1 THEN 'method' END) AS faults FROM m GROUP BY 1",
    "pj13_probed": f"SELECT * FROM (SELECT record_id, coalesce(nullif(trim((x->>'$.leaderboard_model_name')[:500]), ''), nullif(trim((x->>'$.vendor')[:500]), ''), nullif(trim((x->>'$.rank')[:500]), '')) AS field, CASE WHEN json_type(x, '$.tags') = 'ARRAY' THEN array_to_string((x->>'$.tags[*]')[1:8], ' / ') ELSE x->>'$.tags' END AS tags FROM (SELECT record_id, {_X} AS x FROM score_records WHERE benchmark_id IS NOT NULL)) WHERE field IS NOT NULL OR tags IS NOT NULL",
    "pj14_thinned": f"SELECT * FROM (SELECT record_id, CASE WHEN nullif(trim(x->>'$.leaderboard_model_name'), '') IS NOT NULL THEN concat_ws(chr(10) || chr(10), 'Name: ' || trim((x->>'$.leaderboard_model_name')[:500]), nullif(trim((x->>'$.vendor')[:500]), '')) ELSE nullif(concat_ws(',', 'rank=' || (x->>'$.rank'), 'votes=' || (x->>'$.votes')), '') END AS thin FROM (SELECT record_id, {_X} AS x FROM score_records WHERE benchmark_id IS NOT NULL)) WHERE thin IS NOT NULL",
    "pj15_items": f"SELECT record_id, {_KEY.format('benchmark_id')} || '_' || lpad((row_number() OVER (PARTITION BY benchmark_id ORDER BY record_id) - 1)::VARCHAR, greatest(5, 5), '0') AS item_id, coalesce(nullif(trim((x->>'$.leaderboard_model_name')[:500]), ''), nullif(trim((x->>'$.vendor')[:500]), ''), '[raw] ' || coalesce(extra, '{{}}')[:800]) AS question, coalesce(nullif(trim((x->>'$.rank')[:500]), ''), '') AS answer FROM (SELECT *, {_X} AS x FROM score_records WHERE benchmark_id IS NOT NULL)",
    "pj16_examples": "SELECT doc_id, '[' || coalesce(source, '?') || ']' || chr(10) || CASE WHEN length(x) > 300 THEN rtrim(x[:300]) || '...' ELSE x END AS example FROM (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '[\\n\\t ]+', ' ', 'g') AS x FROM documents)",
    "pj17_levels": f"SELECT typed, n, level, CASE level WHEN 'weak' THEN 0.25 WHEN 'medium' THEN 0.5 WHEN 'strong' THEN 0.75 WHEN 'dominant' THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM (SELECT typed, n, {_LEVELS} AS level FROM (SELECT CASE WHEN l_quantity < 10 THEN 'Weak ' WHEN l_quantity < 20 THEN 'MODERATE' WHEN l_quantity < 30 THEN l_linenumber::VARCHAR WHEN l_quantity < 40 THEN 'High' ELSE 'very-odd' END AS typed, count(*) AS n FROM lineitem GROUP BY 1))",
    "pj19_static_vectors": f"WITH {BASE} SELECT benchmark, tag, greatest(0.1, least(0.9, CASE WHEN w >= 0.875 THEN 1.0 WHEN w >= 0.625 THEN 0.75 WHEN w >= 0.375 THEN 0.5 WHEN w >= 0.125 THEN 0.25 ELSE 0.0 END))::DOUBLE AS weight FROM (SELECT b.id AS benchmark, t.tag, coalesce(tw.weight * 4, 0) AS w FROM benchmarks b CROSS JOIN (SELECT DISTINCT tag FROM tw) t LEFT JOIN tw ON tw.benchmark = b.id AND tw.tag = t.tag)",
    "pj20_coerced": f"SELECT record_id, " + ", ".join(f"CASE WHEN try_cast(x->>'$.{c}' AS DOUBLE) IS NULL THEN 0 ELSE round(greatest(0, least(50, try_cast(x->>'$.{c}' AS DOUBLE))), 6) END::DOUBLE AS {c}" for c in ("rank", "ci", "vendor")) + ", CASE WHEN x IS NULL THEN 'no_weights' ELSE concat_ws(',', " + ", ".join(f"CASE WHEN (x->>'$.{c}') IS NOT NULL AND try_cast(x->>'$.{c}' AS DOUBLE) IS NULL THEN 'no_number:{c}' END" for c in ("rank", "ci", "vendor")) + f", 'dropped:' || nullif(len(list_filter(json_keys(x), lambda k: k NOT IN ('rank', 'ci', 'vendor'))), 0), 'filled:' || nullif((x->>'$.rank' IS NULL)::INT + (x->>'$.ci' IS NULL)::INT + (x->>'$.vendor' IS NULL)::INT, 0)) END AS drift FROM (SELECT record_id, {_X} AS x FROM score_records WHERE extra IS NOT NULL)",
    "pj22_buckets": f"WITH {BASE} SELECT CASE WHEN round(e * e, 9) < 0.03 THEN 'low' WHEN round(e * e, 9) < 0.08 THEN 'moderate' ELSE 'high' END AS loss, CASE WHEN e > 0.15 THEN 'strong_positive' WHEN e > 0 THEN 'positive' WHEN e < -0.15 THEN 'strong_negative' WHEN e < 0 THEN 'negative' ELSE 'neutral' END AS signed, CASE WHEN abs(e) < 0.1 THEN 'small' WHEN abs(e) < 0.3 THEN 'medium' ELSE 'large' END AS residual, count(*) AS n FROM (SELECT round(s - r01, 6) AS e FROM pt) GROUP BY 1, 2, 3",
    "pj26_content_hash": "SELECT id, sha256('{\"aliases\":' || to_json(list_sort(coalesce(aliases, [])))::VARCHAR || ',\"id\":' || to_json(id)::VARCHAR || ',\"name\":' || to_json(name)::VARCHAR || ',\"vendor\":' || to_json(coalesce(vendor, ''))::VARCHAR || '}')[:16] AS key FROM models",
    "pj28_anonymous": "SELECT id, regexp_replace('Benchmark: B-1' || chr(10) || coalesce(description, ''), '(?i)' || regexp_extract(id, '^([a-z]+)', 1), 'B-1', 'g') AS anonymous, CASE WHEN x = '' THEN '' WHEN length(x) <= 30 THEN x || '.' ELSE regexp_replace(regexp_replace(x[:29], ' [^ ]*$', ''), '[ .;:]+$', '') || '.' END AS snippet, replace(source_url, 'hub.', '***') AS scrubbed FROM (SELECT *, regexp_replace(trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g')), '[ .;:]+$', '') AS x FROM benchmarks)",
    "pj29_costs": "SELECT source, sum(k)::BIGINT AS tokens, round(sum(k * p) / 1000, 6)::DOUBLE AS cost FROM (SELECT source, ceil(coalesce(length(text), 0) / 4)::BIGINT AS k, CASE WHEN lower(trim(lang)) = 'en' THEN 2 ELSE 3 END AS p FROM documents) GROUP BY 1",
    "pj30_repo_name": "SELECT model_id, n, nullif(regexp_replace(regexp_replace(regexp_replace(lower(model_id), '[^a-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g')[:80], '[-._]+$', ''), '') AS repo FROM (SELECT model_id, count(*) AS n FROM score_records WHERE model_id IS NOT NULL GROUP BY 1)",
    "pj33_parsed_models": f"SELECT raw, id, name, {_VENDOR} AS vendor, len(list_distinct([raw, name, id])) AS aliases FROM (SELECT raw, name, regexp_replace(regexp_replace(lower(name), '[^a-z0-9.]+', '-', 'g'), '^-+|-+$', '', 'g') AS id FROM (SELECT DISTINCT trim(model_id) AS raw, regexp_replace(trim(model_id), '\\s*\\([^)]*\\)\\s*$', '') AS name FROM score_records WHERE model_id IS NOT NULL))",
    "pj33_file_models": "SELECT regexp_extract(file_name, '^([a-z]+)-', 1) AS model, count(*) AS n FROM raw_drops GROUP BY 1",
    "sc3_wrapped_cache": f"WITH {BASE} SELECT benchmark, model, score FROM y",
    "sc6_label_lines": "SELECT entry_id FROM bench_split WHERE lower(trim(bucket)) = 'test'",
    "sc7_dataset_map": "SELECT id, coalesce(language, '-') AS split FROM benchmarks",
    "sc9_ranges": "SELECT source, least(i * greatest(1, total // 3), greatest(0, total - 83)) AS start, 83 AS length FROM (SELECT coalesce(source, '') AS source, count(*) AS total FROM documents GROUP BY 1), range(0, 3) t(i) WHERE total > 250 UNION ALL SELECT source, i * 100, least(100, total - i * 100) FROM (SELECT coalesce(source, '') AS source, count(*) AS total FROM documents GROUP BY 1), range(0, 3) t(i) WHERE total <= 250 AND i * 100 < total",
    "sc10_full_ranges": "SELECT source, s AS start, least(30, total - s) AS length FROM (SELECT coalesce(source, '') AS source, count(*) AS total FROM documents GROUP BY 1), LATERAL (SELECT unnest(range(0, total, 30)) AS s)",
    "sc11_pruned_columns": "SELECT run_id, count(*) AS n, min(record_id) AS first, 7 AS columns FROM score_records GROUP BY 1",
    "sc13_response_cache": "SELECT model_id AS slug, benchmark_id AS bench, arg_max(record_id, [record_id % 3, record_id]) AS record_id FROM score_records WHERE model_id <> '' AND benchmark_id <> '' GROUP BY 1, 2",
    "sc14_csv": "SELECT id, name || ' \"x\", y' || chr(10) || 'z' AS label, coalesce(note, '') AS note FROM benchmarks",
    "sc16_yaml_blocks": "SELECT id, coalesce(vendor, '') AS vendor FROM models",
    "sc17_html_table": f"WITH {BASE} SELECT benchmark, model AS name, round(score * 100, 4) AS score FROM y WHERE score <= 1",
    "sc18_payload_chunks": "SELECT id AS model, coalesce(vendor, '') AS vendor FROM models",
    "sc20_plan": "WITH p AS (SELECT coalesce(lower(trim(scope)), '?') AS scope, run_id, model FROM model_split WHERE model IS NOT NULL) SELECT fault, count(*) AS n FROM (SELECT CASE WHEN scope NOT IN ('seen', 'held') THEN 'scope' WHEN count(*) OVER (PARTITION BY scope, run_id, model) > 1 THEN 'doubled' ELSE 'none' END AS fault FROM p) GROUP BY 1",
    "sk1_pair_json": f"WITH {BASE} SELECT p || '||' || q AS key, s, r FROM pt",
    "sk4_nan_to_null": "SELECT record_id % 100 AS k, count(x) AS scores, count(*) - count(x) AS nulls FROM (SELECT record_id, CASE WHEN NOT isnan(score) THEN score END AS x FROM score_records) GROUP BY 1",
    "sk5_replaced": f"SELECT source_id, count(*) AS n FROM (SELECT {_KIND} AS source_id, record_id FROM score_records) WHERE source_id <> 'manual' OR record_id % 2 = 0 GROUP BY 1",
    "sk7_compacted": "SELECT benchmark, model, epoch_us(max(loaded_at)) AS at, arg_max(run_id, [epoch_us(loaded_at)::VARCHAR, run_id]) AS run_id FROM scores WHERE benchmark IS NOT NULL AND model IS NOT NULL AND run_id IS NOT NULL GROUP BY 1, 2",
    "sk9_missing_plan": f"WITH {BASE} SELECT benchmark, (SELECT count(DISTINCT model) FROM y) - count(*) AS missing FROM y GROUP BY 1 HAVING count(*) < (SELECT count(DISTINCT model) FROM y)",
    "sk10_report": "SELECT row_number() OVER (ORDER BY n DESC, category) - 1 AS line, '| ' || category || ' | ' || n || ' | ' || noted || ' |' AS text FROM (SELECT category, count(*) AS n, count(note) AS noted FROM benchmarks GROUP BY 1)",
    "sk11_corpus_manifest": "SELECT regexp_replace(coalesce(source, 'none'), '[^a-z0-9]+', '-', 'g') AS slug, count(*) AS rows, sum(coalesce(length(text), 0))::BIGINT AS letters, CASE WHEN sum(coalesce(length(text), 0)) > 0 THEN 'ok' ELSE 'empty' END AS status FROM documents GROUP BY 1",
    "sx1_latest": "SELECT model, max(entry_id) AS entry_id, arg_max(run_id, entry_id) AS run_id FROM model_split WHERE model IS NOT NULL GROUP BY 1",
    "sx3_resumed": "SELECT run_id, benchmark, model FROM scores WHERE benchmark IS NOT NULL AND model IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (score >= 0 AND NOT isnan(score)) = 0",
    "st5_composed": "WITH d AS (SELECT source, doc_id FROM documents WHERE source IN (SELECT source FROM mix_targets) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3), n AS (SELECT source, count(*) AS k FROM d GROUP BY 1) SELECT m.source, doc_id, coalesce(k, 0) < 3 AS short, row_number() OVER (ORDER BY md5(concat_ws('|', '42', m.source, doc_id)), doc_id NULLS FIRST) AS place FROM mix_targets m LEFT JOIN d ON d.source = m.source LEFT JOIN n ON n.source = m.source",
}
from rankloom.plans.study import SQL as _STUDY  # noqa: E402

SQL["fl21_role_audit"] = f"SELECT run_id, count(m.faults) AS outputs, count(*) FILTER (m.faults <> '') AS mappers, count(*) FILTER (k.faults <> '') AS makers, count(*) FILTER (m.faults <> '') = 0 AND count(*) FILTER (k.faults <> '') = 0 AS clean FROM score_records LEFT JOIN ({SQL['fl10_mapper_faults']}) m USING (record_id) LEFT JOIN ({SQL['fl11_maker_faults']}) k USING (record_id) GROUP BY 1"
SQL["sk2_artifacts"] = _STUDY["it7_candidates"].replace("SELECT * FROM cand", "SELECT iter, scope, l_align, n_pairs FROM iters WHERE fold = 1")
