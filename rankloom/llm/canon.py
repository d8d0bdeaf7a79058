"""Mapping free-entered values to a canonical list: a trie of reference entries searched with a Levenshtein automaton.

The trie holds every path on which an entry may be written: its id, name and aliases, with the version before or after
the size, with or without the 'v', 'bench' or 'benchmark', as letters, digits and dots only. A typed value is folded
(width, case, look-alike letters, separators), decorations are peeled off its ends (notes in brackets, effort and budget
tags, dates, marks, organisation prefixes), and what remains is searched with all entries within a distance that
depends on its length: 0 below 5 letters, 1 below 6, else 2 edits (insertion, deletion, substitution, transposition).
Digits and dots can't be edited, nor what follows the first word of a name: another version, size or role is another entry.

Alternatives of a word are branches of the trie that meet again where the word ends, so a name with many versions in it
takes as much room as its letters and their alternatives, not their product.

The automaton is the universal one: its state is the set of (offset, edits) pairs relative to the depth in the trie, its
input the bits that say where the next letter stands in a window of the typed value; transitions are computed once and
kept. The nearest entry wins; if two entries are equally near the value is ambiguous and reported as unmatched. Values
that fit no entry come out with ''.

Null, empty, blank and placeholder values give no row, nor does a value that is an id as written. Repeated rows are
answered alike. Very long texts are searched whole; as the trie is finite the search ends after its depth. An empty list
of entries leaves every value unmatched. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.cleaning import usable_text
from rankloom.runtime import catalog_rows, small

# Cyrillic and Greek letters that look like Latin ones, and what they look like.
LOOK_ALIKES = str.maketrans(
    "авекмнорстухіјѕԁԛԝьгαβεικνορτυχ",
    "abekmhopctyxijsdqwbrabeiknoptux",
)
# Tags that follow a name without being part of it.
_TAGS = r"(?:low|medium|high|max|min|minimal|xhigh|thinking|reasoning|preview|exp|experimental|latest|new|beta|free|default|test|em|acc\.?|accuracy|effort|\d+k|\d+-shot|pass@\d+)"
_TAIL = re.compile(rf"(?:\s*[\(\[\{{][^()\[\]{{}}]*[\)\]\}}]|[\s_,;:/@-]+(?:{_TAGS})(?:[ -]effort)?|[\s_@-]*(?:19|20)\d\d-?[01]\d-?[0-3]\d|[\s*†‡§#.,;:_-]+)$")
_MARKS = dict.fromkeys(map(ord, "™®©†‡*§¹²³"), None)


def fold(text: str) -> str:
    """Plain lower-case letters for full-width, accented and look-alike ones; marks and outer blanks gone."""
    s = unicodedata.normalize("NFKC", text.translate(_MARKS)).lower().translate(LOOK_ALIKES)
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).strip()


def squeeze(text: str) -> str:
    """Letters, digits and the dots between digits."""
    s = re.sub(r"[^a-z0-9.]+", "", text)
    return re.sub(r"(?<!\d)\.|\.(?!\d)", "", s)


def written_forms(text: str) -> list[tuple[list[tuple[str, ...]], int]]:
    """Ways of writing a name: its words, each with its alternatives, as they stand and with the size put first.

    Each with the place of its first word, the only one in which letters may be wrong.
    """
    tokens = [t for t in re.split(r"[\s_/:-]+", fold(text)) if t]
    ways = []
    for i, t in enumerate(tokens):
        if i and re.fullmatch(r"\d+(?:\.\d+)?", t):
            ways.append((t, f"v{t}"))
        elif i and (m := re.fullmatch(r"v\.?(\d+)", t)):
            ways.append((f"v{m[1]}", m[1], f"{m[1]}.0", f"v{m[1]}.0", f"version{m[1]}", f"ver{m[1]}"))
        elif t in ("bench", "benchmark"):
            ways.append(("bench", "benchmark"))
        else:
            ways.append((squeeze(t),))
    if not any(any(w) for w in ways):
        return []
    size = next((i for i, t in enumerate(tokens) if i and re.fullmatch(r"\d+(?:\.\d+)?[bm]", t)), None)
    return [(ways, 0)] + ([([ways[size], *ways[:size], *ways[size + 1 :]], 1)] if size is not None else [])


class Automaton:
    """Universal Levenshtein automaton of at most ``k`` edits with transpositions; digits and dots are not editable.

    A state is a frozenset of (offset, edits, swapped): ``offset`` is how far into the typed value the position lies,
    less the depth in the trie. The window of a step is the typed letters at offsets -k to k+1.
    """

    def __init__(self, k: int):
        self.k, self.memo = k, {}
        self.start = frozenset((o, o, 0) for o in range(1))

    def step(self, state: frozenset, hit: int, fixed: int, rigid: bool, skips: bool, left: int) -> frozenset:
        """hit, fixed: bits of the window with the letter, and with letters that can't be edited. rigid: the letter
        itself can't. skips: typed letters may be too many here. left: typed letters from the window's start on, at most 2k+3."""
        key = (state, hit, fixed, rigid, skips, left)
        out = self.memo.get(key)
        if out is None:
            out = self.memo[key] = self._step(state, hit, fixed, rigid, skips, left)
        return out

    def _step(self, state: frozenset, hit: int, fixed: int, rigid: bool, skips: bool, left: int) -> frozenset:
        k, found = self.k, set()
        for o, e, swapped in self._closed(state, fixed, left) if skips else state:
            at = o + k  # in the window
            inside = at < left
            if swapped:  # the letter must be the one passed over, which stands before
                if inside and hit >> at & 1:
                    found.add((o + 1, e, 0))
                continue
            if inside and hit >> at & 1:
                found.add((o, e, 0))
            if e < k and not rigid:
                found.add((o - 1, e + 1, 0))  # the trie has a letter more
                if inside and not fixed >> at & 1:
                    found.add((o, e + 1, 0))  # another letter
                    if at + 1 < left and hit >> (at + 1) & 1 and not fixed >> (at + 1) & 1:
                        found.add((o - 1, e + 1, 1))
        return frozenset(x for x in found if -k <= x[0] <= k)

    def _closed(self, state: frozenset, fixed: int, left: int) -> set:
        """With the letters that the typed value has too many skipped."""
        todo, seen = list(state), set(state)
        while todo:
            o, e, swapped = todo.pop()
            at = o + self.k
            if e < self.k and not swapped and at < left and not fixed >> at & 1 and o < self.k:
                x = (o + 1, e + 1, 0)
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen


@dataclass
class Trie:
    """Reference entries by the letters of their written forms."""

    root: dict = field(default_factory=dict)
    automata: dict = field(default_factory=lambda: {k: Automaton(k) for k in (1, 2)})

    def add(self, words: list[tuple[str, ...]], entry: str, soft: int = 0) -> None:
        """``soft``: the word whose letters may be wrong. A node's letters lead on; ' next' leads on without one."""
        at = self.root
        for i, ways in enumerate(words):
            end = at.setdefault(" words", {}).setdefault((ways, i == soft), {})
            for way in ways:
                node = at
                for c in way:
                    if i == soft:
                        node[" skips"] = True
                    node = node.setdefault(c, {})
                    if i == soft:
                        node[" soft"] = True
                if i == soft:
                    node[" skips"] = end[" skips"] = True
                if not any(x is end for x in node.setdefault(" next", [])):
                    node[" next"].append(end)
            at = end
        at.setdefault("", set()).add(entry)

    @staticmethod
    def _spread(nodes: list[dict]) -> list[dict]:
        """The nodes and all that follow without a letter."""
        out, seen = list(nodes), {id(x) for x in nodes}
        for x in out:
            for y in x.get(" next", ()):
                if id(y) not in seen:
                    seen.add(id(y))
                    out.append(y)
        return out

    def exact(self, text: str) -> set:
        nodes = self._spread([self.root])
        for c in text:
            nodes = self._spread([x[c] for x in nodes if c in x])
            if not nodes:
                return set()
        return set().union(*(x.get("", ()) for x in nodes))

    def within(self, text: str, k: int) -> dict[str, int]:
        """Entries within ``k`` edits of ``text`` and their distances."""
        a, n, found = self.automata[k], len(text), {}
        rigid = set("0123456789.")
        where: dict[str, int] = {}
        for i, c in enumerate(text):
            where[c] = where.get(c, 0) | 1 << (i + k)
        fixed_at = 0
        for c in rigid:
            fixed_at |= where.get(c, 0)
        width = 2 * k + 3
        mask = (1 << width) - 1
        stack = [(self.root, 0, a.start)]
        while stack:
            node, depth, state = stack.pop()
            stack.extend((x, depth, state) for x in node.get(" next", ()))
            left = min(width, n - depth + k)
            skips = " skips" in node
            if "" in node:
                # a position at the end of the typed value, after skipping what it has too many
                best = min((e + n - depth - o for o, e, swapped in state if not swapped and (n - depth - o == 0 or skips and n - depth - o > 0) and not (fixed_at >> (depth + o + k))), default=k + 1)
                if best <= k:
                    for x in node[""]:
                        found[x] = min(best, found.get(x, best))
            if left <= 0:
                continue
            fixed = fixed_at >> depth & mask
            for c, child in node.items():
                if len(c) == 1:
                    after = a.step(state, where.get(c, 0) >> depth & mask, fixed, c in rigid or " soft" not in child, skips, left)
                    if after:
                        stack.append((child, depth + 1, after))
        return found


def edits_for(text: str) -> int:
    letters = sum(c.isalpha() for c in text)
    return 0 if letters < 5 else 1 if letters < 6 else 2


class Matcher:
    """Answers typed values; one for each list, built once in each Python worker."""

    def __init__(self, entries: list[tuple[str, list[str]]], prefixes: list[str] = ()):
        self.trie = Trie()
        self.prefixes = {squeeze(fold(p)) for p in prefixes if p} - {""}
        self.seen: dict[str, str] = {}
        for entry, names in entries:
            for name in {entry, *names}:
                if name:
                    for words, soft in written_forms(name):
                        self.trie.add(words, entry, soft)

    def _starts(self, s: str) -> list[str]:
        """The text itself, and without what may be the name of an organisation before it."""
        out = [s]
        if m := re.match(r"^([^/:]+)(?:/|:\s+)(.+)$", s):
            out.append(m[2])
        words = s.split(" ", 1)
        if len(words) == 2 and squeeze(words[0]) in self.prefixes:
            out.append(words[1])
        return out

    def answer(self, typed: str) -> str:
        out = self.seen.get(typed)
        if out is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            out = self.seen[typed] = self._answer(typed)
        return out

    def near(self, typed: str) -> dict[str, int]:
        """All entries within the distance that the length allows, with their distances; those written exactly so have 0."""
        bare = fold(typed)
        while True:
            for s in self._starts(bare):
                q = squeeze(s)
                if q and (hit := self.trie.exact(q)):
                    return dict.fromkeys(hit, 0)
            cut = _TAIL.sub("", bare)
            if cut == bare or not cut:
                break
            bare = cut
        near: dict[str, int] = {}
        for q in dict.fromkeys(squeeze(s) for s in self._starts(bare)):
            if k := edits_for(q):
                for entry, d in self.trie.within(q, k).items():
                    near[entry] = min(d, near.get(entry, d))
        return near

    def _answer(self, typed: str) -> str:
        near = self.near(typed)
        least = min(near.values(), default=0)
        best = [x for x, d in near.items() if d == least]
        return best[0] if len(best) == 1 else ""


Lists = dict[str, tuple[list[tuple[str, list[str]]], list[str]]]


def matchers(lists: Lists, key: str) -> dict[str, Matcher]:
    """The matchers of the lists; built once in each Python worker, which keeps those of the last few calls."""
    kept = sys.__dict__.setdefault("_rankloom_matchers", {})
    if key not in kept:
        if len(kept) >= 4:
            kept.clear()
        kept[key] = {name: Matcher(*x) for name, x in lists.items()}
    return kept[key]


def canonical_ids(values: DataFrame, lists: Lists) -> DataFrame:
    """Adds ``canonical_id`` to rows with text columns ``typed`` and ``list``. Each task answers its own rows, so nothing is
    shuffled and a value that a third of the rows hold costs one search for each worker."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in values.schema)}, canonical_id string"
    key = hashlib.md5(repr(lists).encode()).hexdigest()

    def run(batches):
        m = matchers(lists, key)
        for pdf in batches:
            pdf["canonical_id"] = [m[of].answer(x) for of, x in zip(pdf["list"], pdf["typed"])]
            yield pdf

    return values.mapInPandas(run, schema)


def model_entries(models: DataFrame) -> tuple[list[tuple[str, list[str]]], list[str]]:
    rows = catalog_rows(models.where("id is not null").select("id", "name", "aliases", "vendor"))
    return [(r.id, [r.name, *(r.aliases or [])]) for r in rows], sorted({r.vendor for r in rows if r.vendor})


def benchmark_entries(benchmarks: DataFrame) -> list[tuple[str, list[str]]]:
    return [(r.id, [r.name]) for r in catalog_rows(benchmarks.where("id is not null").select("id", "name"))]


def typed_values(records: DataFrame, models: DataFrame, benchmarks: DataFrame) -> tuple[DataFrame, Lists]:
    """(record_id, field_name, list, typed) of every value that says something and is no id as written, and the lists."""
    entries, vendors = model_entries(models)
    lists = {"model": (entries, vendors), "benchmark": (benchmark_entries(benchmarks), [])}
    name = F.get_json_object("extra", "$.leaderboard_model_name")
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(of).alias("list"), v.alias("typed")) for f, of, v in (("model_id", "model", F.col("model_id")), ("benchmark_id", "benchmark", F.col("benchmark_id")), ("leaderboard_model_name", "model", name))])
    typed = records.select(F.col("record_id").cast("bigint").alias("record_id"), F.explode(each).alias("x")).select("record_id", "x.*").where(usable_text(F.col("typed")))
    ids = models.select(F.lit("model").alias("list"), F.col("id").alias("typed")).unionByName(benchmarks.select(F.lit("benchmark").alias("list"), F.col("id").alias("typed")))
    return typed.join(small(ids), ["list", "typed"], "left_anti").select("record_id", "field_name", "list", "typed"), lists


def mapped(records: DataFrame, models: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(record_id, field_name, typed, canonical_id) of every typed value that is no id as written; '' if it fits no entry."""
    return canonical_ids(*typed_values(records, models, benchmarks)).select("record_id", "field_name", "typed", "canonical_id")


def candidates(records: DataFrame, models: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(list, typed, n, entry, distance): for every distinct typed value all entries within the distance its length allows."""
    values, lists = typed_values(records, models, benchmarks)
    key = hashlib.md5(repr(lists).encode()).hexdigest()

    def run(batches):
        m = matchers(lists, key)
        for pdf in batches:
            rows = [(of, x, n, e, d) for of, x, n in zip(pdf["list"], pdf["typed"], pdf["n"]) for e, d in sorted(m[of].near(x).items())]
            yield pd.DataFrame(rows, columns=["list", "typed", "n", "entry", "distance"])

    return values.groupBy("list", "typed").agg(F.count("*").alias("n")).mapInPandas(run, "list string, typed string, n bigint, entry string, distance int")
