"""Deeply nested semi-structured records as flat tables linked by interval labels.

A depth-first walk numbers every entry of a document on the way down (``pre``) and on the way up (``post``). An entry lies
within another if and only if its numbers do. Entries are linked by these intervals in one sweep in the order of ``pre``:
the intervals still open are the entries around (``contained``), the innermost of them is the parent (``parent_path``).

Entries are JSON objects: records, their variants at any depth, the slices of ``extra`` and the trials of a slice, and
the sources of records and variants. Layouts: a list of records; an object with a list ``records``; an object whose keys
are models; one record alone; one JSON text per line. A byte order mark is skipped. A list kept as JSON text is still a
list, an object in place of a list has keys for positions, other elements are no entries but keep their position.
Top-level keys that start with '_' are metadata. A payload that is null, empty, unreadable or nested more deeply than the
JSON reader follows gives no rows, and ``unread`` reports it; JSON text within a payload that can't be read counts as text.
An empty table gives no rows. Repeated drops give rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys of a record, by which one alone is told from an object whose keys are models.
RECORD_KEYS = frozenset(("model_id", "benchmark_id", "score", "config", "source", "variants", "extra"))

NODES = "drop_id bigint, type string, path string, parent_path string, depth int, pre bigint, post bigint, model_id string, benchmark_id string, name string, score double, config string, source_kind string, source_url string, source_ref string, source_published string, source_fetched_at string, rest string"
_FIELDS = ("model_id", "benchmark_id", "name", "score", "config", "source_kind", "source_url", "source_ref", "source_published", "source_fetched_at", "rest")


def _listed(v):
    """(position, element) of a list, of an object in place of one, or of either kept as JSON text."""
    if isinstance(v, str):
        try:
            v = json.loads(v)
        except (ValueError, RecursionError):
            return ()
    if isinstance(v, list):
        return enumerate(v)
    return v.items() if isinstance(v, dict) else ()


def _top(payload: str | None):
    """(position, record) of a payload in whatever layout."""
    text = (payload or "").lstrip("﻿ \t\r\n")
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return _lines(text)
    if isinstance(v, dict):
        own = {k: x for k, x in v.items() if not k.startswith("_")}
        if "records" in own:
            return _listed(own["records"])
        return ((0, v),) if RECORD_KEYS & own.keys() and not all(isinstance(x, dict) for x in own.values()) else own.items()
    return _listed(v) if isinstance(v, list) else ()


def _lines(text: str):
    """One JSON text per line; not so if the first line is none or no object. A broken line keeps its position."""
    out = []
    for at, line in enumerate(x for x in text.split("\n") if x.strip()):
        try:
            out.append((at, json.loads(line)))
        except (ValueError, RecursionError):
            if at == 0:
                return ()
        if at == 0 and not isinstance(out[0][1], dict):
            return ()
    return out


def _number(v):
    if isinstance(v, bool) or v is None:
        return None
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _text(v):
    try:
        return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    except RecursionError:
        return None


def parents(intervals: list[tuple[int, int]]) -> list[int | None]:
    """Place of the innermost interval around each of ``intervals``, which are in the order of their starts; None if none is."""
    out, open_ = [], []
    for i, (pre, _) in enumerate(intervals):
        while open_ and intervals[open_[-1]][1] < pre:
            open_.pop()
        out.append(open_[-1] if open_ else None)
        open_.append(i)
    return out


def walk(payload: str | None):
    """Lists (type, path, parent, depth, pre, post, fields...) of a payload in document order, without recursion."""
    out, clock = [], 0
    stack = [("record", f"r{at}", 0, x) for at, x in reversed(list(_top(payload))) if isinstance(x, dict)]
    open_ = []
    while stack:
        top = stack.pop()
        if top is None:
            out[open_.pop()][5] = clock = clock + 1
            continue
        kind, path, depth, x = top
        clock += 1
        source = x.get("source") if kind != "source" else x
        s = source if isinstance(source, dict) else {"kind": source} if isinstance(source, str) else {}
        extra = x.get("extra")
        if isinstance(extra, str):
            try:
                extra = json.loads(extra)
            except (ValueError, RecursionError):
                extra = None
        known = {"variants", "source", "trials", "extra", *_FIELDS}
        rest = {k: v for k, v in x.items() if k not in known} if kind != "source" else {k: v for k, v in x.items() if k not in ("kind", "url", "ref", "published", "fetched_at")}
        if isinstance(extra, dict):
            rest |= {f"extra.{k}": v for k, v in extra.items() if k != "slices"}
        out.append([kind, path, "", depth, clock, 0, _text(x.get("model_id")), _text(x.get("benchmark_id")), _text(x.get("name")), _number(x.get("score")), _text(x.get("config")), _text(s.get("kind")), _text(s.get("url")), _text(s.get("ref")), _text(s.get("published")), _text(s.get("fetched_at")), _text(rest) if rest else None])
        open_.append(len(out) - 1)
        children = []
        if kind in ("record", "variant"):
            if isinstance(source, dict):
                children.append(("source", f"{path}/o", depth + 1, source))
            children += [("variant", f"{path}/v{at}", depth + 1, v) for at, v in _listed(x.get("variants")) if isinstance(v, dict)]
            if isinstance(extra, dict):
                children += [("slice", f"{path}/s{at}", depth + 1, v) for at, v in _listed(extra.get("slices")) if isinstance(v, dict)]
        elif kind == "slice":
            children += [("trial", f"{path}/t{at}", depth + 1, v) for at, v in _listed(x.get("trials")) if isinstance(v, dict)]
        stack.append(None)
        stack.extend(reversed(children))
    for row, parent in zip(out, parents([(x[4], x[5]) for x in out])):
        row[2] = "" if parent is None else out[parent][1]
    return out


def trouble(payload: str | None) -> str | None:
    """Why a payload gives no entries, None if it gives some."""
    if not (payload or "").strip("\ufeff \t\r\n"):
        return "empty"
    if any(isinstance(x, dict) for _, x in _top(payload)):
        return None
    try:
        json.loads(payload.lstrip("\ufeff \t\r\n"))
    except RecursionError:
        return "nested too deeply"
    except ValueError:
        return "no JSON"
    return "no entries"


def unread(drops: DataFrame) -> DataFrame:
    """(drop_id, reason) of the payloads that give no entries."""

    def run(batches):
        for pdf in batches:
            rows = [(drop, why) for drop, payload in zip(pdf["drop_id"], pdf["payload"]) if (why := trouble(payload))]
            yield pd.DataFrame(rows, columns=["drop_id", "reason"])

    return drops.select(F.col("drop_id").cast("bigint").alias("drop_id"), "payload").mapInPandas(run, "drop_id bigint, reason string")


def nodes(drops: DataFrame) -> DataFrame:
    """All entries of all payloads (columns: NODES). One pass, no shuffle; a payload is one value of one row."""
    names = [x.strip().split(" ")[0] for x in NODES.split(",")]

    def run(batches):
        for pdf in batches:
            rows = [(drop, *row) for drop, payload in zip(pdf["drop_id"], pdf["payload"]) for row in walk(payload)]
            yield pd.DataFrame(rows, columns=names)

    return drops.select(F.col("drop_id").cast("bigint").alias("drop_id"), "payload").mapInPandas(run, NODES)


def tables(drops: DataFrame) -> dict[str, DataFrame]:
    """A table for each type of entry, with its own columns and the interval labels."""
    n = nodes(drops)
    link = ["drop_id", "path", "parent_path", "depth", "pre", "post"]
    columns = {
        "record": ["model_id", "benchmark_id", "score", "config", "rest"],
        "variant": ["score", "config", "rest"],
        "source": ["source_kind", "source_url", "source_ref", "source_published", "source_fetched_at", "rest"],
        "slice": ["name", "score", "rest"],
        "trial": ["score", "rest"],
    }
    return {k: n.where(F.col("type") == k).select(*link, *c) for k, c in columns.items()}


def contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs (drop_id, outer_path, inner_path) with the inner entry anywhere within the outer one, by interval containment.

    One sweep over the entries of each payload in the order of ``pre``, with the outer intervals that are open on a stack,
    so the work is that of sorting a payload and writing its pairs. A payload is one value of one row, which bounds it.
    """
    mark = lambda df, is_outer: df.select("drop_id", "path", "pre", "post", F.lit(is_outer).alias("is_outer"))

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, open_, out = pdf.sort_values(["pre", "is_outer"]), [], []
        for drop, path, pre, post, is_outer in zip(pdf["drop_id"], pdf["path"], pdf["pre"], pdf["post"], pdf["is_outer"]):
            while open_ and open_[-1][1] < pre:
                open_.pop()
            if is_outer:
                open_.append((path, post))
            else:
                out += [(drop, x, path) for x, end in open_ if end > post]
        return pd.DataFrame(out, columns=["drop_id", "outer_path", "inner_path"])

    return mark(outer, True).unionByName(mark(inner, False)).groupBy("drop_id").applyInPandas(sweep, "drop_id bigint, outer_path string, inner_path string")


def entries(drops: DataFrame) -> DataFrame:
    """(drop_id, path, parent_path) of records, variants, slices and trials."""
    return nodes(drops).where("type <> 'source'").select("drop_id", "path", "parent_path")


def record_nodes(records: DataFrame) -> DataFrame:
    """The same labels for score_records: (record_id, type, path, parent_path, pre, post, score, config, kind, url, ref, ...).

    Built from the arrays with built-in functions: the record, its source, each variant and the variant's source. Null
    variants keep their position and give no row. ``record_tree`` adds ``extra``.
    """
    node = lambda t, path, parent, pre, post, score, config, s: F.struct(F.lit(t).alias("type"), path.alias("path"), parent.alias("parent_path"), pre.cast("bigint").alias("pre"), post.cast("bigint").alias("post"), score.cast("double").alias("score"), config.alias("config"), s["kind"].alias("kind"), s["url"].alias("url"), s["ref"].alias("ref"), s["reported_by"].alias("reported_by"), s["published"].alias("published"), s["fetched_at"].alias("fetched_at"))
    empty = F.lit(None).cast("string")
    v = F.coalesce(F.col("variants"), F.array().cast(records.schema["variants"].dataType))
    void = F.lit(None).cast(records.schema["source"].dataType)
    n = F.size(v)
    variants = F.transform(v, lambda x, i: F.when(x.isNotNull(), node("variant", F.concat(F.lit("r/v"), i.cast("string")), F.lit("r"), 4 + 4 * i, 7 + 4 * i, x["score"], x["config"], void)))
    sources = F.transform(v, lambda x, i: F.when(x["source"].isNotNull(), node("source", F.concat(F.lit("r/v"), i.cast("string"), F.lit("/o")), F.concat(F.lit("r/v"), i.cast("string")), 5 + 4 * i, 6 + 4 * i, F.lit(None), empty, x["source"])))
    own = F.array(
        node("record", F.lit("r"), F.lit(""), F.lit(1), 5 + 4 * n, F.col("score"), F.col("config"), void),
        F.when(F.col("source").isNotNull(), node("source", F.lit("r/o"), F.lit("r"), F.lit(2), F.lit(3), F.lit(None), empty, F.col("source"))),
    )
    return records.select("record_id", F.explode(F.filter(F.concat(own, variants, sources), lambda x: x.isNotNull())).alias("x")).select("record_id", "x.*")


_EXTRA = "array<struct<type:string,path:string,parent_path:string,pre:bigint,post:bigint,name:string,value:string>>"


def walk_extra(extra: str | None, clock: int) -> list[tuple]:
    """Tuples of _EXTRA for ``extra`` itself and all that it holds, in document order, with numbers after ``clock``.

    The type is that of the JSON value; numbers, texts and truth values come with their text. '~' and '/' in keys are
    written '~0' and '~1' in paths. Null and broken JSON give none.
    """
    try:
        top = json.loads(extra) if extra is not None else None
    except (ValueError, RecursionError):
        return []
    if extra is None:
        return []
    out, open_, stack = [], [], [("extra", "r/x", "r", top)]
    while stack:
        at = stack.pop()
        if at is None:
            out[open_.pop()][4] = clock = clock + 1
            continue
        name, path, parent, v = at
        clock += 1
        kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "null" if v is None else "number"
        out.append([kind, path, parent, clock, 0, name, None if v is None or isinstance(v, (dict, list)) else v if isinstance(v, str) else json.dumps(v)])
        open_.append(len(out) - 1)
        inner = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        stack.append(None)
        stack.extend(reversed([(str(k), path + "/" + str(k).replace("~", "~0").replace("/", "~1"), path, x) for k, x in inner]))
    return [tuple(x) for x in out]


def record_tree(records: DataFrame) -> DataFrame:
    """record_nodes with ``extra``: its object, and every key, nested object and array element at any depth, as typed nodes.

    They come after the variants, under 'r/x', with ``name`` (the key or position) and ``value``; the record's ``post``
    moves behind them, so that containment holds for all types. No shuffle.
    """
    n = F.coalesce(F.size(F.coalesce("variants", F.array().cast(records.schema["variants"].dataType))), F.lit(0))
    extras = F.udf(walk_extra, _EXTRA, useArrow=True)(F.col("extra"), (3 + 4 * n).cast("bigint"))
    own = record_nodes(records.select("record_id", "score", "config", "source", "variants")).withColumns({"name": F.lit(None).cast("string"), "value": F.lit(None).cast("string")})
    nodes = records.select("record_id", "score", "config", n.alias("_n"), extras.alias("_x"))
    top = nodes.select("record_id", F.lit("record").alias("type"), F.lit("r").alias("path"), F.lit("").alias("parent_path"), F.lit(1).cast("bigint").alias("pre"), (5 + 4 * F.col("_n") + 2 * F.size("_x")).cast("bigint").alias("post"), F.col("score").cast("double").alias("score"), "config")
    below = nodes.select("record_id", F.inline("_x"))
    return own.where("type <> 'record'").unionByName(top, allowMissingColumns=True).unionByName(below, allowMissingColumns=True)
