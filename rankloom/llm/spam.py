"""Keyword-stuffed and link-list pages: bagged decision trees on content and link features, smoothed by host.

1. Every page is measured once, whole text, in one pass, and its words and features are kept. Pages that are mostly links or
   tags, or mostly the same few word pairs without function words, are weak spam; running sentences and tables of numbers
   are weak ham. In the same pass each task adds up in how many pages of either label a word stands.
2. The counts over all pages give a lexicon of the goods that spam is about: words far more frequent on spam pages than on
   others. A word needs one in LEXICON_SHARE spam pages, so there are at most LEXICON_SHARE times as many words as a spam
   page has on average. The lexicon knows misread words (one letter off). Its share of a page joins the other features.
3. Second, sharper weak labels that use it train bagged trees on a bounded sample of labelled pages, drawn by hash (each
   tree on a bootstrap of the sample, all features at each split).
4. Every page is scored. Its log-odds then move by how far the spam rate of its host (the source of the page) lies from
   the rate of all pages; a host with few pages moves little.

A page is spam from probability 0.5. A text that is null, empty or without a word is not spam. A null source is a host of
its own. Repeated rows are judged alike. Without both kinds of weak labels no page is spam. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import trees
from rankloom.runtime import stash

#: Pages whose weak labels the trees are learned from, at most, roughly.
SAMPLE_PAGES = 15_000
#: A word of the lexicon stands on one in so many weakly labelled spam pages, and so many times as often as on others.
LEXICON_SHARE, LEXICON_RATIO = 80, 6
#: Words that a task counts before it hands its counts on.
HELD_WORDS = 400_000
#: Pages of prior weight in a host's spam rate, and how strongly the rate moves a page.
HOST_PRIOR, HOST_PULL = 60.0, 0.35

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of to and a in was is for on that by with at be has no from an it as been were had he his which not but this have they their or are "
    "der die das und zu den im ist war ein eine einen einem von mit auf für nicht sich dem des wurde hat es bei aus nach wie zur zum man "
    "le la les de du un une et à en est que par pour dans au sur été ne pas se plus qui il elle a avec sans "
    "el los las del y por con para no su al fue ha lo una sin como más".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_BROKEN = re.compile(r"(?<=\w)[-¬­‐‑]\s*\n\s*(?=[^\W\d_])")
_DIGITS, _STOPS, _WEB = re.compile(r"\d+"), re.compile(r"[.!?](?=\s|$)"), re.compile(r"[wv]{3}", re.I)
_MARKS = "»«•·|;*,:/=>–—"
# a link may be misread; each way of writing one is only looked for where a sign of it stands
_WAYS = (r"\bh?[tfr]{1,2}[tfr]?p?s?:/+", r"\b[wv]{3,6}\b[. ,]?", r"\b[\w-]{2,}\s?[.,]\s?(?:[a-z|;:0-9]{2,8})/[\w-]+", r"[\[(][\w-]{3,}[.,][\w|;]{3,9}[\])]")
_LINKS = {at: re.compile("|".join(w for i, w in enumerate(_WAYS) if at >> i & 1), re.I) for at in range(1, 16)}

FEATURES = ("links", "tags", "functions", "pairs", "distinct", "top5", "digits", "capitals", "marks", "stops", "length", "longest_run", "n_links")


def links_in(text: str) -> int:
    slash = "/" in text
    at = (slash and ":/" in text) | bool(_WEB.search(text)) << 1 | slash << 2 | ("[" in text or "(" in text) << 3
    return len(_LINKS[at].findall(text)) if at else 0


def measures(text: str) -> tuple[list[float], Counter, int]:
    """The features of a page, its words with their counts, and the number of words."""
    joined = _BROKEN.sub("", text) if "\n" in text else text
    typed = _WORD.findall(joined)
    w = [x.lower() for x in typed]
    n = max(1, len(w))
    count = Counter(w)
    pairs = Counter(zip(w, w[1:]))
    repeated = sum(c for c in pairs.values() if c > 1) / max(1, len(w) - 1)
    run = longest = 0
    for x in w:
        if x in FUNCTION_WORDS:
            run = 0
        else:
            run += 1
            if run > longest:
                longest = run
    links = links_in(joined)
    return [
        links / n,
        joined.count("#") / n,
        sum(count[x] for x in count.keys() & FUNCTION_WORDS) / n,
        repeated,
        len(count) / n,
        sum(sorted(count.values(), reverse=True)[:5]) / n,
        len(_DIGITS.findall(joined)) / n,
        sum(not x.islower() and not x.isupper() for x in typed) / n,
        (sum(map(joined.count, _MARKS)) + joined.count(" - ")) / n,
        len(_STOPS.findall(joined)) / n,
        float(np.log(n)),
        min(200.0, float(longest)),
        min(30.0, float(links)),
    ], count, len(w)


def first_label(f: list[float], n: int) -> int | None:
    """Weak label without a lexicon: 1 spam, 0 not, None unknown."""
    links, tags, functions, pairs, distinct, _, digits, *_ = f
    if n < 20:
        return None
    if functions < 0.12 and (links > 0.12 or tags > 0.12):
        return 1
    if functions < 0.08 and pairs > 0.55 and distinct < 0.35 and digits < 0.1:
        return 1
    if links < 0.02 and tags < 0.02 and (functions > 0.2 and pairs < 0.75 and distinct > 0.2 or digits > 0.25):
        return 0
    return None


def second_label(f: list[float], goods: float, n: int) -> int | None:
    """Weak label with the share of goods known."""
    links, tags, functions, _, _, _, digits, *_, n_links = f
    if n < 8:
        return 0
    if digits > 0.22 and links < 0.1:
        return 0
    if n_links <= 2 and goods < 0.1 and functions > 0.2:
        return 0
    if goods > 0.3 and digits < 0.2 or functions < 0.15 and (links > 0.12 or tags > 0.12):
        return 1
    if goods < 0.1 and tags < 0.05 and (links < 0.05 or n_links <= 2):
        return 0
    return None


class Goods:
    """Whether a word is in the lexicon or, from five letters on, one letter off an entry of it. Kept by word."""

    def __init__(self, lexicon: list[str]):
        self.exact, self.near, self.seen = set(lexicon), set(), {}
        for w in lexicon:
            if len(w) >= 4:
                self.near.update(w[:i] + "?" + w[i + 1 :] for i in range(len(w)))

    def __call__(self, w: str) -> bool:
        out = self.seen.get(w)
        if out is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            out = w in self.exact or (len(w) >= 4 and w not in FUNCTION_WORDS and any(w[:i] + "?" + w[i + 1 :] in self.near for i in range(len(w))))
            self.seen[w] = out
        return out


_PAGES = "doc_id bigint, host string, n_words int, f array<float>, words string, counts array<int>, spam int, ham int"


def measured(docs: DataFrame) -> DataFrame:
    """Rows of _PAGES: one for each page, and from each task the words of its weakly labelled pages (host null) with the
    number of spam and ham pages that have them; the word '' counts the pages."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    names = [x.strip().split(" ")[0] for x in _PAGES.split(",")]

    def run(batches):
        seen = Counter(), Counter()  # ham, spam

        def handed_on():
            words = list(seen[0].keys() | seen[1].keys())
            out = pd.DataFrame([(None, None, None, None, w, None, seen[1][w], seen[0][w]) for w in words], columns=names)
            seen[0].clear(), seen[1].clear()
            return out

        for pdf in batches:
            rows = []
            for doc, host, text in zip(pdf["doc_id"], pdf["host"], pdf["text"]):
                f, count, n = measures(text)
                label = first_label(f, n)
                if label is not None:
                    seen[label].update([""])
                    seen[label].update(x for x in count if len(x) > 2 and x not in FUNCTION_WORDS)
                rows.append((doc, host, n, f, " ".join(count), list(count.values()), None, None))
            yield pd.DataFrame(rows, columns=names)
            if len(seen[0]) + len(seen[1]) > HELD_WORDS:
                yield handed_on()
        yield handed_on()

    return d.mapInPandas(run, _PAGES)


def lexicon_of(pages: DataFrame) -> list[str]:
    """The words that tell spam from other pages, from the counts of all pages."""
    counts = pages.where("host is null").groupBy(F.col("words").alias("word")).agg(F.sum("spam").alias("spam"), F.sum("ham").alias("ham"))
    total = counts.where("word = ''").first()
    if not total or not total.spam or not total.ham:
        return []
    good = counts.where((F.col("word") != "") & (F.col("spam") >= max(3, total.spam / LEXICON_SHARE)) & (F.col("spam") / total.spam > LEXICON_RATIO * F.col("ham") / total.ham))
    return sorted(r.word for r in good.select("word").collect())


def _with_goods(pdf: pd.DataFrame, goods: Goods) -> tuple[np.ndarray, np.ndarray]:
    """Features and share of goods of the pages of a batch."""
    f = np.array(pdf["f"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    share = [sum(c for w, c in zip(words.split(" "), counts) if goods(w)) / max(1, n) if n else 0.0 for words, counts, n in zip(pdf["words"], pdf["counts"], pdf["n_words"])]
    return f, np.array(share, dtype=float)


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, host, n_words, raw, probability): of every page, before and after smoothing by host."""
    all_ = stash(measured(docs), "pages")
    pages = all_.where("host is not null").select("doc_id", "host", "n_words", "f", "words", "counts")
    lexicon = lexicon_of(all_)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < min(1.0, SAMPLE_PAGES / max(1, pages.count())) * (1 << 30)

    def labelled(batches):
        goods = Goods(lexicon)
        for pdf in batches:
            f, share = _with_goods(pdf, goods)
            label = [second_label(x, g, n) for x, g, n in zip(f.tolist(), share, pdf["n_words"])]
            out = pd.DataFrame(f, columns=list(FEATURES)).assign(goods=share, label=label)
            yield out[out["label"].notna()].astype({"label": int})

    columns = [*FEATURES, "goods"]
    rows = pages.where(draw & (F.col("n_words") > 0)).mapInPandas(labelled, ", ".join(f"{f} double" for f in columns) + ", label int").toPandas()
    y = rows["label"].to_numpy(dtype=int)
    # bagged trees: every tree sees a bootstrap of the sample and, at each split, all features
    forest = trees.train(rows[columns].to_numpy(dtype=float), y, 2, trees=30, depth=7, seed=5) if 0 < y.sum() < len(y) else None

    def judge(batches):
        goods = Goods(lexicon)
        for pdf in batches:
            x = np.column_stack(_with_goods(pdf, goods))
            p = forest.probabilities(x)[:, 1] if forest is not None else np.zeros(len(x))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "host": pdf["host"], "n_words": pdf["n_words"], "raw": np.clip(p, 0.005, 0.995)})

    judged = stash(pages.mapInPandas(judge, "doc_id bigint, host string, n_words int, raw double"), "judged")
    by = judged.groupBy("host").agg(F.count("*").alias("_n"), F.sum((F.col("raw") >= 0.5).cast("double")).alias("_k"))
    whole = by.agg(F.sum("_n").alias("n"), F.sum("_k").alias("k")).first()
    rate = ((whole.k or 0.0) + 0.5) / ((whole.n or 0) + 1)
    base = float(np.log(rate / (1 - rate)))
    own = (F.col("_k") + HOST_PRIOR * rate) / (F.col("_n") + HOST_PRIOR)
    move = by.select("host", (F.lit(HOST_PULL) * (F.log(own / (1 - own)) - base)).alias("_move"))
    odds = F.log(F.col("raw") / (1 - F.col("raw"))) + F.col("_move")
    return judged.join(move, "host").select("doc_id", "host", "n_words", "raw", (1 / (1 + F.exp(-odds))).alias("probability"))


def spam_pages(docs: DataFrame) -> DataFrame:
    """(doc_id) of every page that is for the greater part repeated keywords, links or product tags."""
    return scored(docs).where("probability >= 0.5 and n_words > 0").select("doc_id")
