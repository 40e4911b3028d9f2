"""Toxicity by weak supervision: many weak voters, a generative label model, a linear classifier on its posteriors.

Voters. Lexicon voters are words, pattern voters are word beginnings and the shape of a text (marks, digits); the
former are found in the labelled texts of the training fold alone. A voter votes toxic or clean, or abstains.

Label model. Over all documents only the counts of votes and of pairs of votes are gathered (a matrix of fixed size,
whatever the number of documents). A voter may be one-sided: it votes in one way or abstains, and abstaining tells
something too. So the model works on the events that a voter votes: given the label these are independent but for
correlations, hence the covariance of two is share * (1 - share) * d_i * d_j, where d is by how much a voter votes more
often on toxic texts than on clean ones. Three covariances give each d without labels (triplets, the median of many is
taken), d and the voter's rate give its rates on both classes, and so its precision. The share of toxic texts is that
of the training fold. What the covariance of two voters has beyond that product is their correlation; voters that are
correlated are left out of each other's triplets and share one voice. Votes and abstentions, rates and weights give a
posterior per document.

Classifier. A logistic regression over words and word beginnings is trained on the posteriors of a bounded sample of
documents, then scores every whole text. What it knows comes from the training fold's labels, through the voters;
labels, language, source and id never are inputs of a score. Texts become hashed features where they lie; what is
gathered for the training are the few features that tell the classes apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Folds by crc32 of the id, of which the first is held out.
FOLDS = 5
#: Voters of each kind at most; least number, and share of all, of labelled toxic texts behind one; its least precision.
VOTERS, SUPPORT, SHARE, PRECISION = 60, 5, 0.002, 0.97
#: Labelled documents that find the voters, and documents that train the classifier, at most; chosen by digests.
LABELLED, TRAINED = 100_000, 16_000
#: Slots of hashed features, passes and strength of the ridge in training, least number of texts with a feature.
SLOTS, PASSES, RIDGE, RARE = 1 << 18, 200, 1e-4, 8
#: Standard deviations by which a feature's share of toxic texts must leave the average, to be trained on; most such
#: features that are trained on, those that leave it most.
SCREEN, FEATURES = 6.0, 4096
#: Standard deviations from which a covariance counts, partners of a voter in its triplets, rounds of setting apart
#: correlated voters, correlation from which two are never in one triplet, and from which they share a voice, precision
#: of a voter that has neither triplet nor prior, weight of a prior as the inverse of a relative variance.
SURE, PARTNERS, ROUNDS, COPIED, TIED, DEFAULT, PRIOR = 4.0, 16, 4, 0.5, 0.1, 0.8, 400.0
#: Words whose slots a worker remembers, different features it counts before it passes them on.
WORDS, COUNTED = 1 << 17, 1 << 17
#: Characters of the word beginnings.
STEMS = (4, 5, 6)
#: Voters on the shape of a text: marks, digits, and the share of characters above which they vote clean.
SHAPES = ((re.compile(r"[^\w\s]"), 0.15), (re.compile(r"\d"), 0.15))
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(text: str) -> set[str]:
    """Words, and word beginnings marked by a star."""
    seen = words(text)
    return seen | {w[:n] + "*" for w in seen for n in STEMS if len(w) > n}


def word_features(word: str) -> tuple[str, ...]:
    """What a word gives to :func:`features`."""
    return (word, *(word[:n] + "*" for n in STEMS if len(word) > n))


def slot(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) % SLOTS


class PerWord:
    """What ``of`` gives for each word of a text, as one set; a bounded number of words is remembered.

    Only ``of`` travels to the workers, each of which remembers for itself.
    """

    def __init__(self, of, most: int = WORDS):
        self.of, self.most, self.known = of, most, {}

    def __reduce__(self):
        return PerWord, (self.of, self.most)

    def __call__(self, text: str) -> set[int]:
        out: set[int] = set()
        known = self.known
        for w in words(text):
            own = known.get(w)
            if own is None:
                if len(known) >= self.most:
                    known.clear()
                own = known[w] = tuple(self.of(w))
            if own:
                out.update(own)
        return out


class Voters:
    """Lexicon and stem voters, which vote toxic or abstain, and voters on shape, which vote clean or abstain."""

    def __init__(self, names: list[str], precision: list[float] = ()):
        self.at = at = {name: i for i, name in enumerate(names)}
        self.prior = np.array([*precision, *[DEFAULT] * (len(names) - len(precision)), *[0.0] * len(SHAPES)])
        self.m = len(names) + len(SHAPES)
        self.sides = np.array([1] * len(names) + [-1] * len(SHAPES))
        self.hits = PerWord(lambda w: [at[x] for x in word_features(w) if x in at])

    def vote(self, text: str) -> np.ndarray:
        """True where a voter votes, false where it abstains."""
        out = np.zeros(self.m, bool)
        out[list(self.hits(text))] = True
        for k, (kind, share) in enumerate(SHAPES):
            out[len(self.at) + k] = len(kind.findall(text)) > share * len(text)
        return out

    def votes(self, texts: list[str]) -> np.ndarray:
        return np.array([self.vote(t) for t in texts], bool).reshape(-1, self.m)


def choose_voters(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, most: int = VOTERS, precision: float = PRECISION) -> Voters:
    """The features that mark toxic texts best, ``most`` words and ``most`` beginnings, by counts of texts with them.

    Precision counts both classes by share, so that it doesn't depend on the balance of the labels.
    """
    good = []
    for x, c in toxic.items():
        rate, other = c / max(1, n_toxic), clean.get(x, 0)
        if rate / (rate + other / max(1, n_clean)) >= precision and c / (c + other) >= precision:
            good.append((-c * float(np.log(rate / ((other + 0.5) / (n_clean + 1)))), x, (c + 0.5) / (c + other + 1)))
    good.sort()
    chosen = [g for g in good if g[1][-1] != "*"][:most] + [g for g in good if g[1][-1] == "*"][:most]
    return Voters([x for _, x, _ in chosen], [p for _, _, p in chosen])


def find_voters(training: DataFrame) -> tuple[Voters, float]:
    """Voters from labelled texts (text, toxic) of the training fold, and the share of toxic ones.

    Features of toxic texts are counted first; those in enough toxic texts are then counted in the clean ones. What
    comes to the driver is bounded by the support: a text has few features, so few can be in a given share of texts.
    """
    n_clean, n_toxic = training.agg(F.count(F.when(F.col("toxic") == 0, 1)), F.count(F.when(F.col("toxic") != 0, 1))).first()
    support = max(SUPPORT, int(SHARE * n_toxic))

    def counted(frame: DataFrame, wanted: frozenset | None) -> dict[str, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[str, int] = {}

            def out():
                columns = [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=["x", "n"])

            for batch in batches:
                for t in batch.column("text"):
                    for x in features(t.as_py()) if wanted is None else wanted.intersection(features(t.as_py())):
                        found[x] = found.get(x, 0) + 1
                if len(found) > COUNTED:
                    yield out()
                    found.clear()
            yield out()

        sums = frame.select("text").mapInArrow(run, "x string, n long").groupBy("x").agg(F.sum("n").alias("n"))
        return {x: n for x, n in sums.where(F.col("n") >= (support if wanted is None else 1)).collect()}

    toxic = counted(training.where("toxic <> 0"), None)
    clean = counted(training.where("toxic = 0"), frozenset(toxic)) if toxic else {}
    return choose_voters(toxic, clean, n_toxic, n_clean), n_toxic / max(1, n_toxic + n_clean)


class LabelModel:
    """Rates, precisions and correlations of voters from the counts of their votes."""

    def __init__(self, n: int, votes: np.ndarray, both: np.ndarray, sides: np.ndarray, balance: float = 0.5, prior: np.ndarray | None = None):
        """``n`` documents; ``votes`` of each voter; ``both``: documents where two vote; ``sides``: 1 for voters that
        vote toxic, -1 for those that vote clean; ``balance``: share of toxic texts; ``prior``: precisions known
        beforehand, which count beside the triplets, and alone for voters that agree with too few others
        (one no better than chance has no voice)."""
        self.balance = share = min(max(balance, 0.01), 0.5)
        n, m = max(n, 1), len(votes)
        rate = votes / n
        covariance = both / n - np.outer(rate, rate)
        deviation = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
        agreeing = covariance * np.outer(sides, sides)
        sure = agreeing * np.sqrt(n) / np.outer(deviation, deviation)
        usable = sure > SURE
        united = votes[:, None] + votes[None, :] - both
        tied = both > 0.9 * np.maximum(united, 1)  # two that nearly always vote together are one opinion to begin with
        for x in (usable, tied):
            np.fill_diagonal(x, False)
        scale = share * (1 - share)
        doubt = 1 / np.maximum(sure, 1e-9) ** 2
        # a voter can't hit more texts of its class than it votes on
        own_share = np.where(sides > 0, share, 1 - share)
        most = np.minimum(rate / own_share, 1 - rate)
        given = np.full(m, DEFAULT) if prior is None else np.asarray(prior, float)
        strength = 0.0 if prior is None else PRIOR
        assumed = np.clip((given - own_share) / (1 - own_share), 0, 1) * most
        for _ in range(ROUNDS):
            apart = assumed.copy()
            for i in range(m):
                rest = np.flatnonzero(usable[i] & ~tied[i])
                rest = rest[np.lexsort((rest, doubt[i, rest]))[:PARTNERS]].tolist()
                found = [(doubt[i, j] + doubt[i, k] + doubt[j, k], agreeing[i, j] * agreeing[i, k] / agreeing[j, k]) for j, k in combinations(rest, 2) if usable[j, k] and not tied[j, k]]
                if found:  # the surer half of the triplets
                    found = sorted(found)[: (len(found) + 1) // 2]
                    own = min(np.sqrt(np.median([x for _, x in found]) / scale), most[i])
                    sure_of_it = 4 / found[len(found) // 2][0]  # of a root its relative variance is a quarter
                    apart[i] = (sure_of_it * own + strength * assumed[i]) / (sure_of_it + strength)
            apart *= sides
            toxic, clean = rate + (1 - share) * apart, rate - share * apart
            inside = np.sqrt(np.maximum(share * toxic * (1 - toxic) + (1 - share) * clean * (1 - clean), 1e-12))
            rest_ = (covariance - scale * np.outer(apart, apart)) / np.outer(inside, inside)
            np.fill_diagonal(rest_, 0)
            now = np.abs(rest_) > COPIED
            if (now == tied).all():
                break
            tied = now
        least = 0.5 / n
        self.toxic, self.clean = np.clip(toxic, least / share, 1 - least / share), np.clip(clean, least / (1 - share), 1 - least)
        even = np.abs(apart) < 1e-12
        self.toxic[even] = self.clean[even] = np.clip(rate[even], least, 1 - least)
        own = np.where(sides > 0, share * self.toxic, (1 - share) * self.clean)
        self.precision = own / (share * self.toxic + (1 - share) * self.clean)
        self.correlated = np.abs(rest_) > np.maximum(TIED, SURE / np.sqrt(n))
        self.correlation = np.clip(np.where(self.correlated, rest_, 0.0), 0, 1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic for rows of votes (true or 1: votes, else it abstains).

        Of the voters that vote on a text those that are correlated share a voice, and so do those that abstain: a vote
        counts for one by one plus its correlations with the others' votes. A vote that stands alone counts in full.
        """
        votes = votes.astype(float)
        voted = votes * np.log(self.toxic / self.clean) / (1 + votes @ self.correlation)
        silent = (1 - votes) * np.log((1 - self.toxic) / (1 - self.clean)) / (1 + (1 - votes) @ self.correlation)
        z = (voted + silent).sum(axis=1) + np.log(self.balance / (1 - self.balance))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def screen(n: np.ndarray, toxic: np.ndarray, rows: int, mean: float, most: int = FEATURES) -> np.ndarray:
    """Slots to train on, ascending: ``n`` texts have one, their targets add up to ``toxic``; ``mean`` is that of all
    ``rows`` texts. One that is in fewer than RARE texts, or whose mean target is what chance would give, stays out."""
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    away = np.abs(toxic - n * mean) / np.sqrt(np.maximum(n, 1) * mean * (1 - mean))
    good = np.flatnonzero((n >= RARE) & (away >= SCREEN))
    return np.sort(good[np.lexsort((good, -away[good]))[:most]]) if rows else good[:0]


def train(flat: np.ndarray, sizes: np.ndarray, target: np.ndarray, features: int, passes: int = PASSES, ridge: float = RIDGE) -> np.ndarray:
    """Weights (and last the intercept) of a logistic regression on soft labels, by full-batch Adam steps.

    Row i has the ``sizes[i]`` next features of ``flat``. The rarer class weighs more, by the square root of its rarity.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    toxic = target > 0.5
    cost = np.where(toxic, 1 / np.sqrt(max(1, toxic.sum())), 1 / np.sqrt(max(1, (~toxic).sum())))
    cost /= max(cost.sum(), 1e-12)
    w, first, second = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    for t in range(1, passes + 1):
        z = np.bincount(owner, w[flat], len(sizes)) + w[-1]
        error = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        grad = np.append(np.bincount(flat, error[owner], features) + ridge * w[:-1], error.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w


class Classifier:
    """What scores a text: ``weights`` has one for each slot and, last, the intercept. Most are zero and not looked at."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        heavy = {int(k): float(weights[k]) for k in np.flatnonzero(weights[:-1])}
        self.heavy, self.intercept = heavy, float(weights[-1])
        self.slots = PerWord(lambda w: [k for k in map(slot, word_features(w)) if k in heavy])

    def score(self, text: str) -> float:
        heavy = self.heavy
        z = self.intercept + sum(heavy[k] for k in sorted(self.slots(text)))
        return 1 / (1 + float(np.exp(-min(max(z, -500.0), 500.0))))


def count_votes(texts: DataFrame, voters: Voters) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of ``texts`` (column text), votes of each voter, and texts where two vote. What comes back is of fixed size."""
    m = voters.m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + m + m * m, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                votes = voters.votes(batch.column("text").slice(at, 1024).to_pylist())
                some = votes[votes.any(axis=1)].astype(np.float32)  # exact: at most 1024
                total += np.concatenate([[len(votes)], some.sum(0), (some.T @ some).ravel()]).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "v"])

    sums = np.zeros(1 + m + m * m, np.int64)
    for k, v in texts.select("text").mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v")).collect():
        sums[k] = v
    return int(sums[0]), sums[1 : m + 1], sums[m + 1 :].reshape(m, m)


def learn(texts: DataFrame, voters: Voters, model: LabelModel, trained: int = TRAINED) -> np.ndarray:
    """Weights of the classifier, from the posteriors of ``texts`` (doc_id, text): of ``trained`` different ones at most,
    those of least digest. One task gets ``trained`` rows of at most FEATURES numbers, never a text."""
    pool = texts.select("doc_id", "text", F.xxhash64(F.lit(13), "text").alias("digest"))
    ones = pool.groupBy("digest").agg(F.max("doc_id").alias("doc_id")).orderBy("digest").limit(trained)
    ones = F.broadcast(ones.select(F.col("digest").alias("d"), F.col("doc_id").alias("i")))

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = PerWord(lambda w: map(slot, word_features(w)))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                some = part.column("text").to_pylist()
                target = pa.array(model.posterior(voters.votes(some)))
                found = pa.array([np.array(sorted(slots(t)), "<u4").tobytes() for t in some], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("digest"), target, found], names=["digest", "target", "slots"])

    chosen = pool.join(ones, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")))
    rows = chosen.select("digest", "text").mapInArrow(slotted, "digest long, target double, slots binary")
    rows = cut(rows.dropDuplicates(["digest"]))  # of rows that repeat id and text one

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, toxic = np.zeros(SLOTS, np.int64), np.zeros(SLOTS)
        for batch in batches:
            for target, found in zip(batch.column("target").to_pylist(), batch.column("slots")):
                k = np.frombuffer(found.as_py(), "<u4")
                n[k] += 1
                toxic[k] += target
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(toxic[at])], names=["k", "n", "toxic"])

    n, toxic = np.zeros(SLOTS, np.int64), np.zeros(SLOTS)
    sums = rows.mapInArrow(counted, "k long, n long, toxic double").groupBy("k").agg(F.sum("n").alias("n"), F.round(F.sum("toxic"), 6).alias("toxic"))
    sums = sums.toArrow()  # SLOTS rows at most
    at = sums.column("k").to_numpy()
    n[at], toxic[at] = sums.column("n").to_numpy(), sums.column("toxic").to_numpy()
    count, mean = rows.agg(F.count(F.lit(1)), F.round(F.avg("target"), 9)).first()
    used = screen(n, toxic, count, mean or 0.5)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(SLOTS, -1)
        number[used] = np.arange(len(used))
        for batch in batches:
            own = [number[np.frombuffer(s.as_py(), "<u4")] for s in batch.column("slots")]
            slim = pa.array([x[x >= 0].astype("<u2").tobytes() for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("target"), slim], names=["digest", "target", "slots"])

    def fitted(_key, cell):
        ordered = cell.sort_by("digest")
        own = [np.frombuffer(s.as_py(), "<u2") for s in ordered.column("slots")]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        w = train(np.concatenate(own), sizes, ordered.column("target").to_numpy(), len(used))
        return pa.table({"k": pa.array([*used.tolist(), SLOTS], pa.int64()), "w": w})

    weights = np.zeros(SLOTS + 1, np.float32)  # one bounded group, on an executor; the driver gets the weights
    slim = rows.mapInArrow(kept, "digest long, target double, slots binary")
    learned = slim.groupBy(F.lit(0).alias("one")).applyInArrow(fitted, "k long, w double").toArrow()
    weights[learned.column("k").to_numpy()] = learned.column("w").to_numpy()
    return weights


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, trained: int = TRAINED) -> tuple[Classifier, Voters, LabelModel]:
    """Learn from the labels of the training fold and from the votes on all of ``docs``.

    Voters come from ``labelled`` different labelled texts at most, the classifier from ``trained`` different texts of
    the training fold at most. Labels with a null doc_id or class are passed over; of several labels of one document the
    greatest counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # of copies one counts, so that no group of them makes a voter; ``labelled`` ids at most are broadcast, so no text moves
    copies = texts.select("doc_id", F.xxhash64("text").alias("copy")).join(known, "doc_id")
    ones = copies.groupBy("copy").agg(F.max("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    ones = cut(ones.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(labelled).select("doc_id", "toxic"))
    voters, balance = find_voters(texts.join(F.broadcast(ones), "doc_id").select("text", "toxic"))
    model = LabelModel(*count_votes(texts, voters), voters.sides, balance, voters.prior)
    # the classifier learns from posteriors, of training-fold documents only, so held-out texts stay unseen
    return Classifier(learn(texts.where(~held_out(F.col("doc_id"))), voters, model, trained)), voters, model


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5) of every row, over its whole text.

    Null texts count as empty, and an empty text has the score of the intercept; a null doc_id counts as an empty one
    for the fold; repeated rows score alike; an empty table gives an empty result; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [classifier.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    scored = slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``docs`` and the training fold of ``labels``, score every row of ``docs``."""
    return score(docs, fit(docs, labels)[0])


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns as they were."""
    classifier = fit(docs, labels)[0]

    @F.pandas_udf("double")
    def scored(texts):
        return texts.map(lambda t: classifier.score(t or ""))

    return docs.where(scored(F.col("text")) < 0.5)
