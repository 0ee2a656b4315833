"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

WORD = re.compile(r"[^\W\d_]+")
RUNS = re.compile(r"([!?*#$%&@])\1+")
MIXED = re.compile(r"(?<=[^\W\d_])[0-9@$!*]+(?=[^\W\d_])")  # inside a word
LAST, FIRST = re.compile(r"[^\W\d_]+$"), re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-*_][^\W\d_](?![^\W_])){3,}")
UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")
SHOUT = re.compile("[A-ZÀ-ÖØ-Þ]{3,}")
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted ustedes vosotros".split())
# A small lexicon to start from; words and stems are learned beside it.
INSULTS = frozenset("idiot moron scum loser clown pathetic worthless trash disgusting stupid dumb imbecile fool jerk idiota estúpido imbécil asqueroso basura crétin débile connard ordure pourri trottel depp dumm abschaum widerlich".split())

PRIOR = 0.05  # toxic share assumed before any label
FEWEST = 20  # labelled rows below which nothing is learned from them but their share

FEATURES = (
    "log_words", "word_density", "word_hits", "word_hit_max", "stem_density", "stem_hits", "stem_hit_max", "seed_hits", "seed_rate",
    "second_person_rate", "near_second_person", "upper_rate", "shout_rate", "exclaim_rate", "question_rate", "symbol_run_rate",
    "mixed_rate", "spaced_rate", "hidden_hits", "hit_kinds",
)


def stems(word: str) -> list[str]:
    """Marked prefixes of four to six letters."""
    return ["^" + word[:k] for k in (4, 5, 6) if len(word) > k]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Lexicon(dict):
    """word -> None, or (word weight, stem weight, insult, second person); looked up once a word while remembered."""

    def __init__(self, weights: dict[str, float], remember: int = 500_000):
        super().__init__()
        self.weights, self.remember = weights, remember

    def __missing__(self, word: str) -> tuple[float, float, bool, bool] | None:
        if len(self) >= self.remember:
            self.clear()
        get = self.weights.get
        found = (get(word, 0.0), max((get(s, 0.0) for s in stems(word)), default=0.0), word in INSULTS, word in SECOND_PERSON)
        self[word] = found = found if any(found) else None
        return found


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Dense features of one whole text; an empty one has all zero."""
    words = words_of(text)
    n = max(1, len(words))
    letters = sum(map(len, words)) or 1
    marked = [(i, x) for i, x in enumerate(map(lexicon.__getitem__, words)) if x is not None]
    hits = [x[0] for _, x in marked if x[0]]
    stem_hits = [x[1] for _, x in marked if x[1]]
    seed = sum(x[2] for _, x in marked)
    places = [i for i, x in marked if x[0] or x[1] or x[2]]
    persons = [i for i, x in marked if x[3]]
    near = 0
    if persons and places:
        gaps = np.searchsorted(persons, places)
        at, to = np.array(places), np.array([-(10**9), *persons, 10**9])
        near = int((np.minimum(at - to[gaps], to[gaps + 1] - at) <= 4).sum())
    shouts = SHOUT.findall(text)
    mixed = [(text[: m.start()][-24:], m[0], text[m.end() : m.end() + 24]) for m in MIXED.finditer(text)]
    hidden = 0
    for before, inner, after in mixed:
        x = lexicon[(LAST.search(before)[0] + inner + FIRST.match(after)[0]).lower().translate(PLAIN)]
        hidden += x is not None and (x[0] > 0 or x[2])
    return [
        np.log1p(len(words)), sum(hits) / n, len(hits), max(hits, default=0.0), sum(stem_hits) / n, len(stem_hits), max(stem_hits, default=0.0), seed, seed / n,
        len(persons) / n, near / n * 100, len(UPPER.findall(text)) / letters, len(shouts) / n, text.count("!") / n, text.count("?") / n, len(RUNS.findall(text)) / n,
        len(mixed) / n, len(SPACED.findall(text)) / n, hidden, len({words[i] for i in places}),
    ]


@dataclass
class Trees:
    """Boosted regression trees on the logistic loss, over features cut at quantiles."""

    edges: list[np.ndarray]
    trees: list[list[tuple[int, int, int, int, float]]]  # (feature or -1, cut, left, right, value)
    base: float
    steps: tuple[np.ndarray, np.ndarray]  # isotonic: margins, probabilities

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = _binned(x, self.edges)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            feature, cut, left, right, value = (np.array(c) for c in zip(*tree))
            for _ in range(8):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = binned[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        xs, ys = self.steps
        return np.clip(np.interp(self.margin(x), xs, ys), 0.0, 1.0) if len(xs) else 1 / (1 + np.exp(-self.margin(x)))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)


def isotonic(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; blocks are smoothed by one pseudo-count of the mean rate so that none is 0 or 1."""
    if not len(labels):
        return np.array([]), np.array([])
    order = np.argsort(margins, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first and last margin
    for m, y in zip(margins[order], labels[order]):
        blocks.append([float(y), 1.0, m, m])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    rate = labels.mean()
    level = [(b[0] + rate) / (b[1] + 1) for b in blocks]
    level = list(np.maximum.accumulate(level))
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.repeat(level, 2)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, leaf: int = 5, ridge: float = 1.0) -> Trees:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else [np.array([])] * x.shape[1]
    binned = _binned(x, edges) if len(x) else x.astype(int)
    p = (y.sum() + FEWEST * PRIOR) / (len(y) + FEWEST)  # a few labels leave the rate near the prior
    base = float(np.log(p / (1 - p)))
    margin, trees = np.full(len(y), base), []
    for _ in range(rounds if len(y) >= FEWEST else 0):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        nodes: list[tuple[int, int, int, int, float]] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes.append((-1, 0, 0, 0, float(-rate * gs / (hs + ridge))))
            best = (1e-6, -1, 0)
            if level < depth and len(rows) >= 2 * leaf:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    cg, ch, cn = (np.bincount(b, weights=v, minlength=len(e) + 1).cumsum()[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                    gain = cg**2 / (ch + ridge) + (gs - cg) ** 2 / (hs - ch + ridge) - gs**2 / (hs + ridge)
                    gain[(cn < leaf) | (len(rows) - cn < leaf)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), j, k)
            if best[1] >= 0:
                go = binned[rows, best[1]] <= best[2]
                left, right = grow(rows[go], level + 1), grow(rows[~go], level + 1)
                nodes[at] = (best[1], best[2], left, right, 0.0)
            return at

        grow(np.arange(len(y)), 0)
        trees.append(nodes)
        margin += Trees(edges, [nodes], 0.0, (np.array([]), np.array([]))).margin(x)
    return Trees(edges, trees, base, (np.array([]), np.array([])))


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    trees: Trees

    def scores(self, texts: list[str], lexicon: Lexicon) -> np.ndarray:
        return self.trees.score(np.array([features(t, lexicon) for t in texts], dtype=float).reshape(len(texts), len(FEATURES)))


def fold(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, lexicon_size: int = 4000, salt: int = 11) -> ToxicityModel:
    """Fit on at most `sample` labelled rows, those with the smallest hash of their id: the documented bound.

    A third of them each learns the lexicon (log-odds of words and stems), the trees, and the calibration, so that none
    judges rows it was made from.  Labels of one id are joined by their maximum; null labels and ids are left out.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    picked = marked.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(sample)
    part = F.pmod(F.xxhash64("id", F.lit(salt + 1)), F.lit(3)).alias("part")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(texts.join(F.broadcast(picked), "id").select("id", "text", "y", part), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush() -> Iterator[pa.RecordBatch]:
            keys = sorted(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["term", "pos", "neg"])
            seen[0].clear(), seen[1].clear()

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(words_of(text))
                seen[1 if y > 0 else 0].update(own.union(*map(stems, own)))
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield from flush()
        yield from flush()

    first = rows.where("part = 0")
    n = first.agg(F.count(F.when(F.col("y") > 0, 1)).alias("pos"), F.count(F.when(F.col("y") <= 0, 1)).alias("neg")).first()
    totals = first.select("text", "y").mapInArrow(count, "term string, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / F.lit(n["pos"] + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n["neg"] + 1.0))
    learned = totals.where("pos >= 3").withColumn("odds", odds).where("odds > 2.5").orderBy(F.desc("odds"), "term").limit(lexicon_size)
    weights = {r["term"]: r["odds"] for r in learned.select("term", "odds").collect()}

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(weights)
        for batch in batches:
            made = [features(t, known) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1), batch.column(2), batch.column(3)], names=["x", "y", "part", "id"])

    made = rows.where("part > 0").select("text", "y", "part", "id").mapInArrow(dense, f"x array<double>, y int, part bigint, id {rows.schema['id'].dataType.simpleString()}").orderBy("id").toPandas()
    x = np.array(made["x"].tolist(), dtype=float).reshape(len(made), len(FEATURES))
    y, second = (made["y"].to_numpy() > 0).astype(float), (made["part"] == 1).to_numpy()
    trees = boost(x[second], y[second])
    held = y[~second]
    if len(held) >= FEWEST and 0 < held.mean() < 1:  # else there is nothing to calibrate by
        trees.steps = isotonic(trees.margin(x[~second]), held)
    return ToxicityModel(weights, trees)


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of `docs` and `score_col`: the calibrated probability of the whole text; null texts are empty.  A column
    of that name is replaced."""
    rows = docs.drop(score_col)
    names, at = rows.columns, rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(model.weights)
        for batch in batches:
            made = model.scores([t or "" for t in batch.column(at).to_pylist()], known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*names, score_col])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(score_col, DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; rows with crc32(doc_id) mod 4 = held_out teach nothing.

    Empty and null texts are scored as texts without words.  Without labels a base rate of 0.05 is scored, and with
    under 60 or so not much else.  Repeated
    rows are scored each; ties need no order; other columns are ignored.
    """
    out = fold("doc_id") % 4 == held_out
    model = fit(docs.select("doc_id", "text"), labels.where(~out))
    rows = docs.select("doc_id", out.alias("held_out"), "text")
    scored = score(rows, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
