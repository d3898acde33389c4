"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters are words and word beginnings that the training fold marks, by their presence or by how
often they stand among a text's words, a seed lexicon, patterns, and the training label itself.
The label model is a two-class mixture: each voter, the label like any other, has a chance to
vote in either class, estimated by expectation maximisation that starts from the votes. Voters
that still agree once the class is accounted for are correlated, and each counts less the more
it shares. The classifier is a logistic regression on the voters' features, fitted to the
posteriors; it never sees a label.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewheel.llm.common import stage

#: Most labelled rows that are used, those of the smallest hash of doc_id.
SAMPLE_ROWS = 12_000
#: About how many words and word beginnings a sample has.
FEATURE_SPACE = 1_000_000
PREFIXES = (3, 4, 5, 6, 7, 8)
#: The voters of a word or beginning: it stands in the text at all, or so often among a thousand words.
RATES = (0, 2, 4, 8, 16, 32)
WORDS = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.7
#: To the classifier a toxic text that is missed is as bad as so many clean ones that are marked.
TOXIC_COST = 3.0
#: Correlations below this are taken for chance.
CORRELATED = 0.3
#: Words that insult in themselves. What the labelled texts say is mined, not listed.
SEEDS = ("idiot", "imbecile", "dumbass", "bastard", "asshole", "bitch", "retard", "scumbag", "dimwit", "fool", "vermin")

#: Pattern voters: name, strings of which one must be in the text, and expression, searched in the text in small letters.
PATTERNS = (
    ("you_are", ("you are", "you're"), re.compile(r"\byou(?:'re| are) (?:all |just )?(?:an? |such |so |nothing)")),
    ("silencing", ("shut", "get lost", "go to hell", "screw you", "drop dead"), re.compile(r"\b(?:shut (?:up|your)|get lost|go to hell|screw you|drop dead)\b")),
    ("hatred", ("hate", "despise", "loathe"), re.compile(r"\b(?:hates? (?:you|them|these|those)|despises? (?:you|them)|loathes? (?:you|them))\b")),
    ("threat", ("kill", "hurt", "hang", "shoot", "burn"), re.compile(r"\b(?:kill|hurt|hang|shoot|burn) (?:you|yourself|yourselves|them all|him|her)\b")),
    ("unwanted", ("nobody", "no one"), re.compile(r"\bno(?:body| one) (?:likes|wants|needs|cares about) (?:you|them)\b")),
    ("those_people", (" people are", " people should", " people deserve"), re.compile(r"\b(?:you|those|these) people (?:are|should|deserve)\b")),
    ("german", ("du bist", "ihr seid", "halt die", "halt's", "verpiss"), re.compile(r"\b(?:du bist (?:ein|so|doch)|ihr seid (?:alle|so)|halt(?: die (?:klappe|fresse)|'s maul)|verpiss dich)\b")),
    ("french", ("tu es", "t'es", "ta gueule", "ferme-la"), re.compile(r"\b(?:(?:tu es|t'es) (?:une?|qu'une?|trop) |ta gueule\b|ferme-la\b)")),
    ("spanish", ("eres", "cállate", "vete a"), re.compile(r"\b(?:eres (?:una?|tan) |cállate\b|vete a la\b)")),
    ("exclaiming", ("!!!",), re.compile(r"!!!")),
)


class Lexicon:
    """Finds which features hold in a text: whole words (w:) and word beginnings (p:), after an @ how often."""

    def __init__(self, features: list[str]):
        import ahocorasick

        self.features, self.n = features, len(features)
        self.automaton = ahocorasick.Automaton()
        self.voters: dict[str, list[tuple[int, int]]] = {}
        for k, f in enumerate(features):
            name, _, rate = f.partition("@")
            self.voters.setdefault(name, []).append((k, int(rate or 0)))
        by_text: dict[str, list[tuple[str, bool]]] = {}
        for name in self.voters:
            by_text.setdefault(name[2:], []).append((name, name[0] == "w"))
        for text, uses in by_text.items():
            self.automaton.add_word(text, (len(text), uses))
        if by_text:
            self.automaton.make_automaton()

    def hits(self, low: str) -> tuple[set[int], int]:
        """The features that hold, and how often any of their words or beginnings stands there."""
        if not self.n:
            return set(), 0
        counts: Counter[str] = Counter()
        for end, (length, uses) in self.automaton.iter(low):
            if end >= length and low[end - length].isalpha():
                continue
            for name, whole in uses:
                if not whole or not low[end + 1 : end + 2].isalpha():
                    counts[name] += 1
        found, total = set(), 0
        words = len(WORDS.findall(low)) if counts else 0
        for name, count in counts.items():
            held = [k for k, rate in self.voters[name] if 1000 * count >= rate * words]
            found.update(held)
            total += count if held else 0
        return found, total

    def row(self, text: str | None) -> np.ndarray:
        """The features of a text: the lexicon's, one for any of them, the log of their number, the patterns'."""
        low = (text or "").lower()
        found, total = self.hits(low)
        out = np.zeros(self.n + 2 + len(PATTERNS), np.float32)
        out[list(found)] = 1
        out[self.n], out[self.n + 1] = bool(found), np.log1p(total)
        for k, (_, parts, p) in enumerate(PATTERNS):
            out[self.n + 2 + k] = any(x in low for x in parts) and p.search(low) is not None
        return out


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic, text) of at most ``rows`` labelled documents outside the held-out third."""
    id_text = F.col("doc_id").cast("string")
    marked = labels.where((F.crc32(id_text.cast("binary")) % 3 != 1) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows


def distinct_texts(sample: DataFrame) -> DataFrame:
    """Each text once, with its smallest doc_id and highest label: copies would outvote what is said once."""
    return sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic", "text")


def text_features(text: str) -> dict[str, int]:
    """Each word and word beginning of a text, with the place in RATES of the highest rate that it reaches."""
    words = WORDS.findall(text.lower())
    counts: Counter[str] = Counter()
    for w, c in Counter(words).items():
        if len(w) > 1:
            counts["w:" + w] += c
        for n in PREFIXES:
            if n <= len(w):
                counts["p:" + w[:n]] += c
    return {f: bisect_right(RATES, 1000 * c / len(words)) - 1 for f, c in counts.items()}


def mined_features(sample: DataFrame) -> list[str]:
    """Words and word beginnings, by presence or rate, that mark toxic texts more than chance does; the surest first.

    ``sample`` has each text once. A feature qualifies if the chance that as many of its texts
    are toxic, by Chernoff's bound, is so small that among FEATURE_SPACE features less than one
    in a hundred would have it. Features that also mark clean texts are for the label model to weigh.
    Of equally sure features beginnings come first, the longest of them foremost: a short one that
    marks the same texts would mark other words of other texts.
    """
    base = sample.agg(F.avg("toxic").alias("b")).collect()[0]["b"]
    if not base or base >= 1:
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                seen: Counter[tuple[str, int, int]] = Counter()
                for text, toxic in zip(b["text"][at : at + 500], b["toxic"][at : at + 500], strict=True):
                    seen.update((f, level, toxic) for f, level in text_features(text).items())
                yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["feature", "level", "toxic", "n"])

    rows = sample.select("text", "toxic").mapInPandas(run, "feature string, level int, toxic int, n long")
    reached = [F.when(F.col("level") >= k, F.col("n")).otherwise(0) for k in range(len(RATES))]
    by_rate = [F.struct(F.lit(r).alias("rate"), F.sum(F.col("toxic") * n).alias("hits"), F.sum(n).alias("n")) for r, n in zip(RATES, reached, strict=True)]
    counts = rows.groupBy("feature").agg(F.array(*by_rate).alias("c")).select("feature", F.inline("c")).where(f"hits > {base} * n")
    share = "hits * ln(hits / (n * {b})) + if(n > hits, (n - hits) * ln((n - hits) / (n * {c})), 0)".format(b=base, c=1 - base)
    found = counts.select("feature", "rate", F.expr(share).alias("lift")).where(F.col("lift") >= float(np.log(100 * FEATURE_SPACE)))
    found = found.orderBy(F.desc("lift"), F.substring("feature", 1, 1), F.desc(F.length("feature")), "feature", "rate").collect()
    return [f"{r['feature']}@{r['rate']}" if r["rate"] else r["feature"] for r in found]


def vote_matrix(sample: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, which is bounded, as arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(features)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "row": [lexicon.row(t).tobytes() for t in b["text"]]})

    got = sample.mapInPandas(run, "doc_id long, toxic int, row binary").orderBy("doc_id", "row").collect()
    if not got:
        return np.zeros((0, len(features) + 2 + len(PATTERNS)), np.float32), np.zeros(0)
    return np.stack([np.frombuffer(r["row"], np.float32) for r in got]), np.array([r["toxic"] for r in got], float)


def marked_rows(sample: DataFrame, features: list[str]) -> tuple[list[set[int]], set[int], int]:
    """The rows of the sample that each feature marks, and those that are toxic, as sets of row numbers; the number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(features)
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "found": [sorted(lexicon.hits(t.lower())[0]) for t in b["text"]]})

    marks: list[set[int]] = [set() for _ in features]
    rows = sample.mapInPandas(run, "toxic int, found array<int>").collect()
    for i, (_, found) in enumerate(rows):
        for k in found:
            marks[k].add(i)
    return marks, {i for i, (y, _) in enumerate(rows) if y}, len(rows)


@dataclass
class LabelModel:
    """What the label model has learnt: the rows' chance of class 1, each voter's chance to vote in either class, and
    how much of a voter's log-odds counts."""

    posterior: np.ndarray
    chance: np.ndarray
    share: np.ndarray


def first_guess(votes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Of the groups of voters that ever vote, the part that votes in each row: a majority vote by kind of voter."""
    said = np.stack([votes[:, groups == g].any(axis=1) for g in np.unique(groups)], axis=1)
    said = said[:, said.any(axis=0)]
    return said.mean(axis=1) if said.shape[1] else np.zeros(len(votes))


def label_model(votes: np.ndarray, groups: np.ndarray, rounds: int = 25) -> LabelModel:
    """Two classes fitted to 0/1 ``votes`` (rows by voters) by EM, from the majority vote of the kinds ``groups``.

    ``chance[c, j]`` is the chance that voter j votes in class c. ``share[j]`` is how much of
    its log-odds counts: one over one and the sum of its correlations with the other voters
    that the classes leave; a label is not made from a text's words, so it has none. No voter's
    accuracy is given; all are estimated.
    """
    apart = groups == "label"
    post = np.clip(first_guess(votes, groups), 0.02, 0.98)
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        weight = np.stack([1 - post, post])
        chance = (weight @ votes + 0.5) / (weight.sum(axis=1, keepdims=True) + 1.0)
        left = votes - (np.outer(1 - post, chance[0]) + np.outer(post, chance[1]))
        spread = np.sqrt((left**2).mean(axis=0)) + 1e-6
        corr = (left.T @ left) / len(left) / np.outer(spread, spread)
        np.fill_diagonal(corr, 0)
        corr[apart], corr[:, apart] = 0, 0
        share = 1 / (1 + np.where(corr > CORRELATED, corr, 0).sum(axis=1))
        on, off = np.log(chance[1] / chance[0]), np.log((1 - chance[1]) / (1 - chance[0]))
        odds = np.log(prior / (1 - prior)) + votes @ (share * on) + (1 - votes) @ (share * off)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return LabelModel(post, chance, share)


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 12) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on soft labels, by Newton's method; class 1 counts TOXIC_COST."""
    x = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    cost = 1 + (TOXIC_COST - 1) * y
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = cost * np.maximum(p * (1 - p), 1e-4)
        w = w - np.linalg.solve((x * s[:, None]).T @ x + np.diag(keep), x.T @ (cost * (p - y)) + keep * w)
    return w


def lift(hits: int, n: int, base: float) -> float:
    """Minus the log of Chernoff's bound on the chance that ``hits`` or more of ``n`` texts are toxic; 0 at no lift."""
    if not n or hits <= base * n:
        return 0.0
    clean = n - hits
    return hits * np.log(hits / (n * base)) + (clean * np.log(clean / (n * (1 - base))) if clean else 0.0)


def needed(marks: list[set[int]], toxic: set[int], total: int, mined: int, least: int = 3, voters: int = 3) -> list[int]:
    """The mined features that say something of rows that no seed and few chosen before mark, the surest first.

    A row is settled when a seed or ``voters`` chosen features mark it. Among the others, a
    feature marks at least ``least`` toxic rows, and more than chance does among so many
    features; of features that mark the same rows one is chosen. Those from place ``mined`` on
    are the seeds'; ``total`` is the number of rows.
    """
    covered, out = set().union(*marks[mined:]), []
    times: Counter[int] = Counter()
    left = {k: marks[k] - covered for k in range(mined)}
    while left:
        base = len(toxic - covered) / max(total - len(covered), 1)
        left = {k: new for k, new in left.items() if len(new & toxic) >= least}
        sure = {k: lift(len(new & toxic), len(new), base) for k, new in left.items()}
        best = max(sure, key=lambda k: (sure[k], -k), default=None)
        if best is None or sure[best] < np.log(100 * mined):
            break
        out.append(best)
        same = marks[best]
        times.update(left.pop(best))
        newly = {i for i in same if times[i] >= voters}
        covered |= newly
        left = {k: new - newly for k, new in left.items() if marks[k] != same}
    return out


@dataclass
class ToxicityModel:
    """The lexicon, the classifier's weights, and what was learnt of each voter: (voter, kind, votes, precision, share)."""

    features: list[str]
    weights: np.ndarray
    voters: list[tuple[str, str, int, float, float]]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, words: Sequence[str] = SEEDS) -> ToxicityModel:
    """Voters, label model and classifier from the training fold; ``words`` are the seed lexicon.

    With labels of one class only, the label is no voter and the seeds and patterns are fitted
    alone; without any labelled row, any seed word decides.
    """
    sample = stage(distinct_texts(training_sample(docs, labels, rows)), "sample")
    mined, seeds = mined_features(sample), [f"{'p' if len(s) > 4 else 'w'}:{s}" for s in words]
    features = [mined[k] for k in needed(*marked_rows(sample, mined + seeds), len(mined))] + seeds
    x, y = vote_matrix(sample, features)
    n_mined, own = len(features) - len(seeds), [*range(len(features)), *range(len(features) + 2, x.shape[1])]  # without the sums over the lexicon
    names = features + [name for name, _, _ in PATTERNS]
    kinds = ["mined"] * n_mined + ["seed"] * len(seeds) + ["pattern"] * len(PATTERNS)
    votes = (x > 0)[:, own].astype(float)
    if len(set(y.tolist())) == 2:
        votes, names, kinds = np.hstack([votes, y[:, None]]), [*names, "label"], [*kinds, "label"]
    if not votes.any():
        w = np.zeros(len(features) + 3 + len(PATTERNS))
        w[len(features)], w[-1] = 6.0, -4.0
        return ToxicityModel(features, w, [])
    heard = votes.any(axis=0)  # one that never votes says nothing
    votes, names, kinds = votes[:, heard], [x for x, h in zip(names, heard, strict=True) if h], [x for x, h in zip(kinds, heard, strict=True) if h]
    fitted = label_model(votes, np.array(kinds))
    n = votes.sum(axis=0)
    right = (fitted.posterior @ votes) / np.maximum(n, 1)
    voters = [(a, k, int(c), float(r), float(s)) for a, k, c, r, s in zip(names, kinds, n, right, fitted.share, strict=True)]
    return ToxicityModel(features, fit_linear(x, fitted.posterior), voters)


def voter_report(spark, model: ToxicityModel) -> DataFrame:
    """(voter, kind, votes, precision, share): what the label model has learnt of each voter on the sample."""
    return spark.createDataFrame(model.voters, "voter string, kind string, votes long, precision double, share double")


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; whole texts are read."""
    features, w = model.features, model.weights.tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, v = Lexicon(features), np.array(w)
        for b in batches:
            rows = np.stack([lexicon.row(t) for t in b["text"]]) if len(b) else np.zeros((0, len(v) - 1))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": 1 / (1 + np.exp(-np.clip(rows @ v[:-1] + v[-1], -30, 30)))})

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = texts.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, words: Sequence[str] = SEEDS) -> DataFrame:
    """Scores of every row of ``docs``; a null text is empty and scores as a clean one.

    Labels count only outside the held-out third of doc_ids; null labels are left out, of
    several labels of a doc_id the highest holds. Rows may repeat; either table may be empty;
    other columns are ignored.
    """
    return score(docs, fit(docs, labels, rows, words))


def query(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; edge cases are those of ``toxicity``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels)
