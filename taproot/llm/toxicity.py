"""Toxicity by a learned lexicon, its misspellings and the context of each hit.

1. `learn` finds the lexicon in labelled documents: words and stems (prefixes with any ending) that toxic documents
   have and clean ones don't, by a test with Bonferroni's correction. One document of each family of near copies
   counts, so the other words of a toxic text and its copies stay out. Some stems occur in clean documents by chance but
   bring several different words in toxic ones: these are word families, taken where the documents with two or more words
   of a stem speak for toxicity at odds above four times the number of stems of that length, so a few documents suffice.
2. The lexicon is a trie. The Levenshtein automaton of a word is intersected with it: terms of at least five letters
   match at distance one, of nine at two (a swap of neighbours is one edit); stems match exactly. Misspellings that
   clean training documents use are ordinary words and don't count. Letters written as digits or signs are undone.
3. A hit is judged in a window of words: one inside quotation marks or beside a reporting cue is a quotation, all
   others are abuse.
4. A logistic score weighs abuse by exact terms, abuse by misspelled ones, quotations, and the different words of
   families beyond the first and beyond what clean text of that length has. It is fitted on the same sample by ridge
   regression towards a prior, so it is defined without any label.

Learning uses a bounded sample: at most `SAMPLE` labelled documents, the least by hash of their doc_id (ties by doc_id).
Scoring covers every whole text, very long ones too. Null texts count as empty; empty texts score as those without hits.
Repeated rows score alike. Repeated labels of a document count as toxic if one is; null labels are ignored. Without
labels nothing is in the lexicon, and every score is the prior's. An empty table gives an empty table. Extra columns,
whatever their names, stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taproot.llm import common
from taproot.llm.encoding import groups
from taproot.llm.ngram_join import signatures

#: Labelled documents to learn from, at most; they bound the lexicon too.
SAMPLE = 20_000
THRESHOLD = 0.7
#: Words on each side of a hit that are its context.
CONTEXT = 6
STEMS, FAMILY_STEMS = range(4, 9), range(3, 9)
MEMO = 500_000
PRIOR = np.array([-3.0, 4.0, 2.5, 0.5, 3.0])
#: Share of the documents with a family's words that are toxic, if the family is, and the least odds for taking one: in all, and
#: for each stem of that length, so that about a quarter of a stem is taken by chance.
FAMILY_SHARE, FAMILY_ODDS, FAMILY_ODDS_EACH = 0.9, 30.0, 4.0
RIDGE = 0.05
CUES = frozenset("said says wrote quote quoted quotes called word term sagte schrieb zitat wort dit écrit citation mot dijo escribió cita palabra".split())
OPENING, CLOSING = "\"“„«‹'‘", "\"”“»›'’"
_SIGNS = str.maketrans("@$!013457", "asioieast")
_WORD, _JOINED = re.compile(r"[\w@$!]+"), re.compile(r"[@$!_]+")


def readings(piece: str) -> list[list[str]]:
    """The words in a piece of text: lower case, outer signs off, digits and signs between letters undone.

    A sign or underscore may stand for a letter or between two words, so each place gives its words apart and then,
    where that differs, as one.
    """
    w = piece.lower().strip(" \t\n.,;:!?%&*#()[]{}<>|/\\\"“”„«»‹›'‘’-–—_+=~`^")
    if w.isalpha():
        return [[w]]
    undone = lambda x: x.translate(_SIGNS) if any(c.isalpha() for c in x) else x
    found = []
    for x in _WORD.findall(w):
        apart = [undone(y) for y in _JOINED.split(x) if y]
        found.append(apart if apart == [undone(x)] else [*apart, undone(x)])
    return found


def words(piece: str) -> list[str]:
    return [w for place in readings(piece) for w in place]


class Automaton:
    """The Levenshtein automaton of a word (with swaps of neighbours): a state is two rows of distances."""

    def __init__(self, word: str, most: int) -> None:
        self.word, self.most = word, most

    def start(self):
        return (None, None, tuple(range(len(self.word) + 1)))

    def step(self, state, c: str):
        before, last, row = state
        w, new = self.word, [row[0] + 1]
        for i, x in enumerate(w, 1):
            d = min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (x != c))
            if before is not None and i > 1 and x == last and w[i - 2] == c:
                d = min(d, before[i - 2] + 1)
            new.append(d)
        return (row, c, tuple(new))

    def alive(self, state) -> bool:
        return min(state[2]) <= self.most or (state[0] is not None and min(state[0]) < self.most)

    def distance(self, state) -> int:
        return state[2][-1]


@dataclass
class Lexicon:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    ordinary: frozenset = frozenset()
    weights: tuple = tuple(PRIOR)
    families: list[str] = field(default_factory=list)
    chance: float = 0.0  # different words of families in a word of clean text

    def __post_init__(self) -> None:
        self.trie: dict = {}
        for w in self.words:
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        fuzzy = [w for w in self.words if len(w) >= 5]
        cut = lambda w, k: [w[i * len(w) // (k + 1) : (i + 1) * len(w) // (k + 1)] for i in range(k + 1)]
        self.exact, self.prefixes, self.related = frozenset(self.words), tuple(self.stems), tuple(self.families)
        swap = lambda w, c: w[: c - 1] + w[c] + w[c - 1] + w[c + 1 :]
        # An edit leaves one half of a term whole, two leave a third, but a swap over a cut breaks both sides: what it
        # makes is looked up itself, and its halves are where a second edit may follow.
        swapped = {swap(w, c) for w in fuzzy if len(w) >= 9 for c in (len(w) // 3, 2 * len(w) // 3)}
        self.heads = tuple({cut(w, 1)[0] for w in (*fuzzy, *swapped)})
        self.tails = tuple({cut(w, 1)[1] for w in (*fuzzy, *swapped)})
        self.swaps = frozenset(swap(w, len(w) // 2) for w in (*fuzzy, *swapped))
        self.middles = tuple({p for w in fuzzy if len(w) >= 9 for p in cut(w, 2)})

    @staticmethod
    def reach(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def fuzzy(self, word: str) -> str | None:
        """A term within its reach of the word: the word's automaton intersected with the trie."""
        auto = Automaton(word, 2)
        stack = [(self.trie, auto.start())]
        while stack:
            node, state = stack.pop()
            for c, below in node.items():
                if c == "":
                    if 0 < auto.distance(state) <= self.reach(below):
                        return below
                elif auto.alive(new := auto.step(state, c)):
                    stack.append((below, new))
        return None

    def match(self, word: str) -> int:
        """0: no term, 1: a term or stem, 2: a misspelled term, 4: a word of a family."""
        if not word:
            return 0
        if word in self.exact or (self.prefixes and word.startswith(self.prefixes)):
            return 1
        if self.related and word.startswith(self.related):
            return 4
        near = (self.heads and (word.startswith(self.heads) or word.endswith(self.tails))) or word in self.swaps or any(m in word for m in self.middles)
        return 2 if near and len(word) >= 4 and word not in self.ordinary and self.fuzzy(word) else 0


    def hits(self, piece: str) -> tuple[int, ...]:
        """What each word of a piece matches, without those that match none; joined words count only where none alone does."""
        out: list[int] = []
        for place in readings(piece):
            kinds = [self.match(w) for w in place]
            apart = [k for k in kinds[:-1] if k]
            out += apart or [k for k in kinds[-1:] if k]
        return tuple(out)


class Judge:
    """Features and scores of texts by one lexicon, with a bounded memo of pieces."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.memo: dict[str, tuple[int, ...]] = {}

    def kinds(self, pieces: list[str]) -> list[tuple[int, int]]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        try:
            found = [memo[p] for p in pieces]
        except KeyError:
            hits = self.lexicon.hits
            for p in pieces:
                if p not in memo:
                    memo[p] = hits(p)
            found = [memo[p] for p in pieces]
        return [(i, k) for i, kinds in enumerate(found) for k in kinds] if any(found) else []

    @staticmethod
    def quoted(pieces: list[str], i: int) -> bool:
        before, after = pieces[max(0, i - CONTEXT) : i + 1], pieces[i : i + CONTEXT + 1]
        opened = any(p[0] in OPENING for p in before) and not any(p.rstrip(".,;:!?")[-1:] in CLOSING for p in before[:-1])
        if opened and any(p.rstrip(".,;:!?")[-1:] in CLOSING for p in after):
            return True
        return any(w in CUES for p in before[-4:-1] for w in words(p))

    def features(self, text: str | None) -> tuple[int, int, int]:
        """Hits as abuse by exact terms and by misspelled ones, and as quotations."""
        return self.measured(text)[:3]

    def measured(self, text: str | None) -> tuple[int, int, int, int, int]:
        """Hits as abuse by exact terms and by misspelled ones, as quotations, different words of families, and words in all."""
        pieces = (text or "").split()
        out, related = [0, 0, 0], set()
        for i, kind in self.kinds(pieces):
            if self.quoted(pieces, i):
                out[2] += 1
            elif kind == 4:
                related.update(w for w in words(pieces[i]) if w.startswith(self.lexicon.related))
            else:
                out[kind - 1] += 1
        return *out, len(related), len(pieces)

    def score(self, text: str | None) -> float:
        x = weighed(np.array([self.measured(text)], np.float64), self.lexicon.chance)[0]
        return float(1 / (1 + np.exp(-(self.lexicon.weights[0] + x @ np.array(self.lexicon.weights[1:])))))


def weighed(features: np.ndarray, chance: float) -> np.ndarray:
    """What the score weighs, from rows of features: families count from the second word on, less what chance brings."""
    related = features[:, 3] / (1 + chance * features[:, 4])
    return np.column_stack([np.log2(1 + features[:, :3]), np.log2(np.maximum(related, 1))])


def fit(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic weights of what is `weighed` by Newton steps, with a ridge towards the prior; weights of hits never fall below 0."""
    x = np.column_stack([np.ones(len(features)), features]) if len(features) else np.zeros((0, len(PRIOR)))
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + RIDGE * len(w) * (w - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * len(w) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([w[:1], np.maximum(w[1:], 0)])


def terms(text: str) -> set[str]:
    """The words of a text and their stems with a star; what it has twice or more comes again after a caret.

    Stems that two or more different words have come after a tilde too.
    """
    own = Counter(w for p in text.split() for w in words(p) if len(w) >= 3)
    found, different = Counter(own), Counter()
    for w, k in own.items():
        for n in FAMILY_STEMS:
            if len(w) > n:
                different[w[:n] + "*"] += 1
                if n in STEMS:
                    found[w[:n] + "*"] += k
    return {*found, *("^" + t for t, k in found.items() if k > 1), *("~" + t for t, k in different.items() if k > 1)}


def families(rows: list[tuple[str, int, int]], share: float, tried: dict[int, int] | None = None) -> list[str]:
    """Stems of word families from (stem, toxic, clean documents with two or more of its words) and the share of toxic documents.

    A stem is taken if at least three toxic documents have it and its odds, those documents' likelihood at `FAMILY_SHARE`
    over that at ``share``, are `FAMILY_ODDS_EACH` for each stem of that length; of nested stems the likeliest, the longest of equal ones. ``tried``: how many
    stems of each length there are, where ``rows`` are only some of them.
    """
    tried = Counter(len(t) for t, _, _ in rows) if tried is None else tried
    share = min(max(share, 1e-6), 0.5)
    gain, loss = math.log(FAMILY_SHARE / share), math.log((1 - share) / (1 - FAMILY_SHARE))
    odds = {t: bad * gain - good * loss for t, bad, good in rows if bad >= 3}
    out: list[str] = []
    for t in sorted(odds, key=lambda t: (-odds[t], -len(t), t)):
        if odds[t] >= math.log(max(FAMILY_ODDS, FAMILY_ODDS_EACH * tried[len(t)])) and not any(t.startswith(o) or o.startswith(t) for o in out):
            out.append(t)
    return out


def chosen(support: dict[str, int]) -> list[str]:
    """The terms that no more frequent one explains: longer words under a stem, and stems that only one word has."""
    out: list[str] = []
    stems: set[str] = set()
    most: dict[str, int] = {}  # the best support of a chosen word by its stems
    for t in sorted(support, key=lambda t: (-support[t], t[-1] == "*", -len(t), t)):
        is_stem, own = t[-1] == "*", t.rstrip("*")
        under = any(own[:n] in stems for n in STEMS if n <= len(own))
        if under or (is_stem and most.get(own, 0) >= 0.9 * support[t]):
            continue
        out.append(t)
        if is_stem:
            stems.add(own)
        else:
            for n in STEMS:
                if n <= len(own):
                    most[own[:n]] = max(most.get(own[:n], 0), support[t])
    return out


def first_of_kind(labels: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Which rows share no band (a row of ``bands`` each) with an earlier row of their label."""
    keep = np.zeros(len(labels), bool)
    for label in np.unique(labels):
        own = np.flatnonzero(labels == label)
        _, first, band = np.unique(bands[own], return_index=True, return_inverse=True)
        keep[own] = ((first // bands.shape[1])[band.reshape(-1, bands.shape[1])] == np.arange(len(own))[:, None]).all(1)
    return keep


def unlike(texts: DataFrame) -> DataFrame:
    """(doc) of one text per label and family of near copies, so that a copy's words don't count again."""
    signed = signatures(texts.select(F.xxhash64("text").alias("doc_id"), "text")).drop("text_key", "n", "x")
    rows = signed.join(texts.select(F.xxhash64("text").alias("doc_id"), "toxic"), "doc_id").orderBy("doc_id").toArrow()  # at most the sample
    docs, labels = rows["doc_id"].to_numpy(), rows["toxic"].to_numpy()
    keep = first_of_kind(labels, np.column_stack([rows[n].to_numpy() for n in rows.column_names if n not in ("doc_id", "toxic")]))
    return texts.sparkSession.createDataFrame([(d,) for d in docs[keep].tolist()], "doc long")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from (doc_id, text) and (doc_id, toxic)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = common.Stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    held = common.Stored(docs.select("doc_id", "text").join(F.broadcast(own.read()), "doc_id").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic")))
    own.drop()
    texts = held.read()
    kept = F.broadcast(unlike(texts))
    lone = texts.join(kept, F.xxhash64("text") == F.col("doc")).select("text", "toxic")
    sizes = {r["toxic"]: r["count"] for r in lone.groupBy("toxic").count().collect()}
    toxic, total = sizes.get(1, 0), sum(sizes.values())
    if not toxic:
        held.drop()
        return Lexicon()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (bad if label else good).update(terms(text))
        names = sorted({*bad, *good})
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([bad[t] for t in part], pa.int64()), pa.array([good[t] for t in part], pa.int64())], names=["term", "bad", "good"])

    counts = common.Stored(lone.mapInArrow(common.sparing(count), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    # Chance that a term of so many documents is in toxic ones only, times the terms tried: once by documents that
    # have it, once by documents that have it twice.
    rows, support = counts.read(), {}
    for twice in (False, True):
        kind = rows.where((F.col("term").startswith("^") == twice) & ~F.col("term").startswith("~"))
        tried = kind.where("bad + good >= 3").count()
        need = max(3, math.ceil(math.log(0.05 / max(tried, 1)) / math.log(min(toxic / total, 0.9))))
        found = kind.where((F.col("bad") >= need) & (F.col("good") <= 0.02 * F.col("bad"))).withColumn("term", F.regexp_replace("term", r"^\^", "")).select("term")
        own = rows.join(found, "term").where(F.col("good") <= 0.02 * F.col("bad"))
        support |= {r["term"]: r["bad"] for r in own.select("term", "bad").collect()}  # of the sample
    several = rows.where("term LIKE '~%' AND bad + good >= 3").select(F.expr("substring(term, 2, length(term) - 2)").alias("stem"), "bad", "good").toArrow()  # of the sample
    lengths = Counter(pc.utf8_length(several["stem"]).to_pylist())
    several = several.filter(pc.greater_equal(several["bad"], 3))
    # A stem that clean documents hardly ever have needs no second word.
    alone = tuple(t[:-1] for t in support if t[-1] == "*")
    related = [t for t in families(list(zip(*(c.to_pylist() for c in several.columns), strict=True)), toxic / total, lengths) if not (alone and t.startswith(alone))]
    cover = [t for t in chosen(support) if not (related and t.startswith(tuple(related)))]
    lexicon = Lexicon([t for t in cover if t[-1] != "*"], [t[:-1] for t in cover if t[-1] == "*"], families=related)

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [t for t in b.column(0).to_pylist() if t[-1] != "*" and t[0] not in "^~" and lexicon.match(t) == 2]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["term"])

    used = counts.read().where("good > 0 AND good >= 0.1 * bad").select("term").mapInArrow(misspelled, "term string").collect()
    lexicon = Lexicon(lexicon.words, lexicon.stems, frozenset(r["term"] for r in used), families=related)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(lexicon)
        for b in batches:
            got = [judge.measured(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([g[i] for g in got], pa.int64()) for i in range(5)), b.column(1)], names=[*"abcde", "toxic"])

    schema = ", ".join(f"{n} long" for n in "abcde") + ", toxic int"
    measured = texts.mapInArrow(common.sparing(measure), schema).toArrow()  # at most ``sample`` rows
    rows = np.column_stack([c.to_numpy().astype(np.float64) for c in measured.columns])
    counts.drop()
    held.drop()
    clean = rows[rows[:, 5] == 0].sum(axis=0)
    chance = float(clean[3] / clean[4]) if clean[4] else 0.0
    return Lexicon(lexicon.words, lexicon.stems, lexicon.ordinary, tuple(fit(weighed(rows[:, :5], chance), rows[:, 5])), related, chance)


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` (with a text) and a column toxicity; every other column stays as it is."""
    names = docs.columns
    flat = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), F.col("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(lexicon)
        for b in batches:
            found = [judge.score(t) for g in groups(b, 1) for t in g.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=["row", "toxicity"])

    return flat.mapInArrow(common.sparing(score), T.StructType([T.StructField("row", docs.schema), T.StructField("toxicity", T.DoubleType())]))


def training(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out third."""
    return labels.where(F.coalesce(common.crc32_of_id(F.col("doc_id")) % 3 != 1, F.lit(False))).select("doc_id", "toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with the columns that they had."""
    lexicon = learn(docs, training(labels))
    return scored(docs, lexicon).where(F.col("toxicity") < threshold).select("row.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, training(common.table(spark, sf_dir, "labels")))
    found = scored(docs, lexicon).select("row.doc_id", F.col("toxicity").alias("score"))
    held_out = F.coalesce(common.crc32_of_id(F.col("doc_id")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
