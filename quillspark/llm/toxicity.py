"""Toxicity by weak supervision: voters, a generative label model with correlations, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, held_out, map_batches, stored, table

WORD = re.compile(r"[^\W\d_]+")
#: Lexicon voters: plain English lists of insults by kind.
LEXICONS = {
    "stupidity": ("idiot", "idiots", "idiotic", "moron", "morons", "stupid", "dumb", "dumbass", "imbecile", "fool", "dimwit", "retard", "halfwit", "simpleton", "brainless"),
    "contempt": ("pathetic", "worthless", "loser", "losers", "useless", "failure", "nobody", "coward", "weakling", "incompetent"),
    "ridicule": ("clown", "clowns", "joke", "laughable", "ridiculous", "buffoon", "freak", "weirdo", "creep"),
    "disgust": ("disgusting", "scum", "trash", "garbage", "filth", "filthy", "vermin", "vile", "nasty", "repulsive", "sickening", "pig"),
    "hate": ("hate", "despise", "loathe", "kill", "die", "hang", "destroy", "eradicate", "subhuman"),
    "profanity": ("fuck", "fucking", "fucker", "shit", "shitty", "bitch", "bastard", "asshole", "crap", "damn", "dick", "whore", "slut"),
}
#: Pattern voters.
PATTERNS = {
    "you_are": re.compile(r"\b(?:you|they|he|she) (?:are|is|re) (?:such )?(?:an?|all|so|just) \w+"),
    "go_away": re.compile(r"\b(?:shut up|go away|get lost|drop dead|screw you)\b"),
    "masked": re.compile(r"\b[a-z]{1,3}[*@#]{2,}[a-z]*\b"),
}
#: Words and stems learned from labelled rows are dealt to so many further lexicon voters, by rank, the words to one half of them and the
#: stems to the other; so they cover the languages that the lists do not.
LEARNED_VOTERS = 6
LEARNED_WORDS = 48
#: Lengths of the stems, the first letters of longer words, and the least share of a text's words, two at least, that must have a stem for it to count.
STEMS = (4, 5, 6, 7)
DENSE = 0.01
MIN_SUPPORT = 8
#: Bounds of the samples: labelled rows of either label for the learned words, rows for the classifier.
LABELLED_SAMPLE = 8_000
CLASSIFIER_SAMPLE = 40_000
VOTERS = (*LEXICONS, *PATTERNS, *[f"learned_{i}" for i in range(LEARNED_VOTERS)], "plain")
N_FEATURES = 2 * len(VOTERS) + 2


def _as_text(words: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of words and stems (with a star) by label, counted in each batch."""
    for batch in words:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = Counter(WORD.findall(text.lower()))
            counts[label].update(found.keys())
            stems: Counter = Counter()
            for w, times in found.items():
                for k in STEMS:
                    if len(w) > k:
                        stems[w[:k]] += times
            least = max(2, DENSE * sum(found.values()))
            counts[label].update([f"{stem}*" for stem, times in stems.items() if times >= least])
        rows = [(w, y, n) for y, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["word", "toxic", "n"])


def learn_words(labelled: DataFrame, limit: int = LEARNED_WORDS) -> tuple[list[str], set[str]]:
    """What the labelled rows tell: words and stems to vote by, and listed words to leave out.

    The first are the words, and the stems of a hundredth of a text's words, whose presence most favours label 1, most telling first: their odds are 4 at least even two standard errors lower; of a stem and its words the better stays. The
    second are those whose odds are under 2 even two standard errors higher,
    as of a word that means nothing bad in another language.
    """
    counts = map_batches(labelled.filter("text is not null and toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic")), _as_text, "word string, toxic int, n long")
    totals = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, q = F.col("pos") + 0.5, F.col("neg") + 0.5
    by_word = counts.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
    odds = F.log(p / (totals.get(1, 0) + 1)) - F.log(q / (totals.get(0, 0) + 1))
    error = F.sqrt(1 / p + 1 / q)
    scored = stored(by_word.filter(F.col("pos") + F.col("neg") >= MIN_SUPPORT).withColumn("odds", odds).withColumn("error", error))
    told = scored.filter(F.col("odds") - 2 * F.col("error") >= float(np.log(4)))
    harmless = scored.filter(F.col("word").isin([w for words in LEXICONS.values() for w in words]) & (F.col("odds") + 2 * F.col("error") < float(np.log(2))))
    chosen: list[str] = []
    for r in told.orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "word").limit(20 * limit).collect():
        own = r["word"].rstrip("*")
        if len(chosen) < limit and not any(own.startswith(c.rstrip("*")) or c.rstrip("*").startswith(own) for c in chosen):
            chosen.append(r["word"])
    return chosen, {r["word"] for r in harmless.collect()}


class Voters:
    def __init__(self, learned: list[str], harmless: set[str] = frozenset()):
        self.of: dict[str, list[int]] = {}
        for v, words in enumerate(LEXICONS.values()):
            for w in words:
                if w not in harmless:
                    self.of.setdefault(w, []).append(v)
        self.stems: dict[str, list[int]] = {}
        first = len(LEXICONS) + len(PATTERNS)
        half = LEARNED_VOTERS // 2
        for rank, w in enumerate([w for w in learned if not w.endswith("*")]):
            self.of.setdefault(w, []).append(first + rank % half)
        for rank, w in enumerate([w for w in learned if w.endswith("*")]):
            self.stems.setdefault(w.rstrip("*"), []).append(first + half + rank % half)
        self.lengths = sorted({len(s) for s in self.stems})

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        """The votes as bits and the classifier's features: rates and presences by voter, length, share of distinct words."""
        out = np.zeros(N_FEATURES)
        lower = (text or "").lower()
        words = Counter(WORD.findall(lower))
        n = sum(words.values())
        hits = np.zeros(len(VOTERS))
        for w in words.keys() & self.of.keys():
            for v in self.of[w]:
                hits[v] += words[w]
        stems: Counter = Counter()
        for k in self.lengths:
            for w in words:
                if w[:k] in self.stems and len(w) > k:
                    stems[w[:k]] += words[w]
        for stem, times in stems.items():
            if times >= max(2, DENSE * n):
                for v in self.stems[stem]:
                    hits[v] += times
        for v, pattern in enumerate(PATTERNS.values(), len(LEXICONS)):
            hits[v] = sum(1 for _ in pattern.finditer(lower))
        hits[-1] = not hits[:-1].any()
        out[: len(VOTERS)] = np.log1p(100 * hits / max(n, 20))
        out[len(VOTERS) : 2 * len(VOTERS)] = hits > 0
        out[-2] = np.log1p(n) / 10
        out[-1] = len(words) / max(n, 1)
        return int(sum(1 << v for v, h in enumerate(hits) if h)), out


def features(docs: DataFrame, learned: list[str], harmless: set[str]) -> DataFrame:
    """``(doc_id, votes, x)`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(learned, harmless)
        for batch in batches:
            got = [voters(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1].tolist() for g in got], pa.list_(pa.float32()))], ["doc_id", "votes", "x"])

    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, votes long, x array<float>")


@dataclass
class LabelModel:
    """P(label) and P(vote | label, parent's vote): a tree of correlated voters, fitted by expectation maximisation.

    The parent of a voter is the one with which it shares most information
    given the label (a maximum spanning tree), so voters that agree because
    they see the same words do not count twice.
    """

    prior: float
    parents: list[int]
    tables: np.ndarray  # voter, label, parent's vote -> P(vote = 1)

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        total = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for v, parent in enumerate(self.parents):
            state = votes[:, parent] if parent >= 0 else np.zeros(len(votes), dtype=int)
            p = self.tables[v][:, state]
            p = np.where(votes[:, v] == 1, p, 1 - p)
            total += np.log(p[1]) - np.log(p[0])
        return total

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -30, 30)))


def _tree(votes: np.ndarray, post: np.ndarray, weight: np.ndarray) -> list[int]:
    """Chow-Liu parents by mutual information given the label."""
    m = votes.shape[1]
    info = np.zeros((m, m))
    for label in (0, 1):
        w = weight * (post if label else 1 - post)
        total = w.sum()
        if total <= 0:
            continue
        one = np.stack([1 - votes, votes])  # state, row, voter
        joint = np.einsum("sri,r,trj->stij", one, w, one) / total + 1e-9
        single = np.einsum("sri,r->si", one, w) / total + 1e-9
        info += total * (joint * (np.log(joint) - np.log(single[:, None, :, None]) - np.log(single[None, :, None, :]))).sum(axis=(0, 1))
    parents, linked = [-1] * m, [0]
    while len(linked) < m:
        _, i, j = max((info[i, j], -i, -j) for i in linked for j in range(m) if j not in linked)
        parents[-j] = -i
        linked.append(-j)
    return parents


def fit_label_model(patterns: list[tuple[int, float, float, float]], rounds: int = 30) -> LabelModel:
    """``patterns``: votes as bits, rows without label, with label 0, with label 1. Labelled rows keep their label, with some noise."""
    m = len(VOTERS)
    votes = np.array([[bits >> v & 1 for v in range(m)] for bits, *_ in patterns], dtype=int).reshape(-1, m)
    counts = np.array([p[1:] for p in patterns], dtype=float).reshape(-1, 3)
    free, zero, one = counts.T
    known = zero.sum() + one.sum()
    if known:
        free = free * min(1.0, known / max(free.sum(), 1.0))  # rows without label weigh no more than those with one, or they would choose the classes
    prior = float(np.clip((one.sum() + 1) / (known + 2), 0.01, 0.99)) if known else 0.1
    hits = votes[:, :-1].sum(axis=1)
    post = (one + prior * 2) / (zero + one + 2) if known else np.clip(hits / 3, 0.02, 0.95)
    model = None
    for _ in range(rounds):
        pos = post * free + 0.98 * one + 0.02 * zero
        all_ = free + zero + one
        soft = pos / np.maximum(all_, 1e-9)
        parents = _tree(votes, soft, all_)
        tables = np.zeros((m, 2, 2))
        for v, parent in enumerate(parents):
            state = votes[:, parent] if parent >= 0 else np.zeros(len(votes), dtype=int)
            for label, w in ((0, all_ - pos), (1, pos)):
                for s in (0, 1):
                    at = state == s
                    tables[v, label, s] = ((w * votes[:, v])[at].sum() + 0.5) / (w[at].sum() + 1)
        model = LabelModel(float(np.clip(pos.sum() / max(all_.sum(), 1), 0.005, 0.995)), parents, np.clip(tables, 1e-4, 1 - 1e-4))
        new = model.posterior(votes)
        if np.abs(new - post).max(initial=0) < 1e-5:
            break
        post = new
    return model


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression on posterior labels by Newton steps: weights (bias first), mean and scale of the features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (p - target) + ridge * w)
        size = np.abs(move).max()
        w -= move * min(1.0, 4.0 / max(size, 1e-9))
        if size < 1e-8:
            break
    return w, mean, scale


def score_documents(docs: DataFrame, labels: DataFrame, learn: F.Column) -> DataFrame:
    """``(doc_id, score, posterior, votes)`` of every row of ``docs(doc_id, text)``.

    ``labels(doc_id, toxic)`` count only where ``learn`` (of doc_id) holds;
    several labels of one id count as toxic if any is. Every row gets a score
    in [0, 1]: null and empty texts that of a text without words; repeated
    rows equal ones, rows with a null id too, which no label reaches; texts
    and words of any length count whole; without labels the voters alone make
    the label model; an empty table gives none. Other columns are not read.
    """
    known = labels.filter(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = stored(known)
    picked = [hashed_sample(known.filter(F.col("toxic") == y), "doc_id", LABELLED_SAMPLE) for y in (0, 1)]
    sample = F.broadcast(stored(picked[0].unionByName(picked[1])))  # at most twice LABELLED_SAMPLE ids
    learned, harmless = learn_words(docs.select("doc_id", "text").join(sample, "doc_id"))
    rows = stored(features(docs, learned, harmless))
    marked = rows.select("doc_id", "votes").join(known, "doc_id", "left")
    seen = marked.groupBy("votes").agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("free", F.col("toxic").isNull()), ("zero", F.coalesce(F.col("toxic") == 0, F.lit(False))), ("one", F.coalesce(F.col("toxic") == 1, F.lit(False))))])
    patterns = [tuple(r) for r in seen.orderBy("votes").collect()]  # 2 ** len(VOTERS) rows at most
    if not patterns:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("posterior"), "votes")
    label_model = fit_label_model(patterns)
    some = hashed_sample(rows.filter(learn), "doc_id", CLASSIFIER_SAMPLE).select("votes", "x").collect()
    bits = lambda values: np.array([[b >> v & 1 for v in range(len(VOTERS))] for b in values], dtype=int).reshape(-1, len(VOTERS))
    if some:
        linear = fit_linear(np.array([r["x"] for r in some], dtype=float), label_model.posterior(bits([r["votes"] for r in some])))
    else:
        linear = (np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES), np.ones(N_FEATURES))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, mean, scale = linear
        for batch in batches:
            votes = batch.column("votes").to_numpy()
            x = np.asarray(batch.column("x").flatten().to_numpy(), dtype=float).reshape(len(votes), N_FEATURES)
            score = 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / scale) @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(label_model.posterior(bits(votes))), batch.column("votes")], ["doc_id", "score", "posterior", "votes"])

    return map_batches(rows, work, f"doc_id {kind}, score double, posterior double, votes long")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
