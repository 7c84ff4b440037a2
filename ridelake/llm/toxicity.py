"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are word lists of insults, and patterns (words and word beginnings) that
between them cover the toxic rows of a bounded sample of labelled ones. A voter
that occurs in a text votes for toxic, others abstain; where all abstain, the
silence itself votes for clean. The label model learns, by expectation maximisation
over the votes of all documents, how often each voter fires on toxic and on clean
texts, starting from and held near the labelled rows, and at last how voters are
correlated beyond that; correlated voters share their weight. The posteriors of a bounded sample of documents are the labels a
logistic classifier is fitted on, with hashed word beginnings as features. It
scores every whole text.
"""

from __future__ import annotations

import io
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ridelake.llm.common import remainder, short_batches, stage
from ridelake.llm.quality import sigmoid_fit
from ridelake.llm.samples import bits_of, gathered, labelled

#: Lexicon voters, by theme.
LEXICONS = {
    "wits": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile cretin halfwit dimwit retard retarded",
    "worth": "worthless pathetic loser losers useless failure nobody",
    "filth": "scum scumbag trash garbage filth filthy vermin disgusting vile",
    "scorn": "clown clowns laughable buffoon freak freaks creep",
    "abuse": "bastard bastards bitch bitches asshole assholes fuck fucking shit shitty crap cunt whore slut dickhead",
}
#: Pattern voters: a taunt aimed at someone, and a threat.
TAUNT = re.compile(r"\b(?:you are|you're|ur) (?:an? |such an? |so |the )?(?:\w+ )?(?:" + "|".join(" ".join(LEXICONS.values()).split()) + r")\b")
THREAT = re.compile(r"\b(?:i will|i'll|going to|gonna) (?:kill|hurt|destroy|beat|find) (?:you|him|her|them)\b")

#: Labelled rows of each class that patterns are found in, at most.
SAMPLE_ROWS = 3000
#: Documents of each side of the label model that the classifier is fitted on, at most.
FIT_ROWS = 4000
#: Pattern voters found, at most; with the others they fit the bits of a long.
FOUND = 48
LEAST_ROWS, LEAST_LIFT = 4, 2.5
#: Candidates looked at, voters wanted on each toxic row, toxic rows a clean one outweighs.
CANDIDATES, DEPTH, CLEAN_COST = 2000, 2, 5
#: Weight of the labelled rows in the label model, as a share of all documents.
HOLD = 0.5
BEGINNINGS = (3, 4, 5, 6)
EM_ROUNDS = 8
#: Smallest correlation of two voters that counts, and parts that distinct votes lie in.
LEAST_CORRELATION, VOTE_PARTS = 0.1, 32
SIZE = 1 << 17
#: Deviation from the mean that a feature of the classifier shows at least.
LEAST_Z = 5.0
#: Steps of the logistic fit, their length, and the pull of weights to zero.
STEPS, PACE, SHRINK = 400, 0.3, 2e-4
FOLDS, HELD = 3, 1
THRESHOLD = 0.7

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def words(text: str | None) -> set[str]:
    """Distinct lower-case words without the ASCII symbols at their ends."""
    return {w.strip(_EDGES) for w in set((text or "").lower().split())}


def terms(text: str | None) -> set[str]:
    """The words and, marked by a star, their beginnings."""
    found = words(text)
    found.discard("")
    out = set(found)
    for n in BEGINNINGS:
        out.update(w[:n] + "*" for w in found if len(w) >= n)
    return out


def _patterns(docs: DataFrame, labels: DataFrame, rows: int) -> list[str]:
    """Terms that tell the toxic rows of the sample from the clean ones."""
    sample, _ = labelled(docs, labels, "toxic", FOLDS, HELD, rows)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def flush():
            names = list(toxic.keys() | clean.keys())
            columns = [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([clean[n] for n in names], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])

        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("label").to_pylist()):
                (toxic if y else clean).update(terms(text.as_py()))
                if len(toxic) + len(clean) > 500_000:
                    yield flush()
                    toxic, clean = Counter(), Counter()
        yield flush()

    sample = sample.withColumn("copy", F.xxhash64("text")).dropDuplicates(["copy"])
    sample = stage(sample.select("text", "label"), "labelled")
    counts = sample.repartition(16, F.xxhash64("text")).mapInArrow(counted, "term string, toxic long, clean long")
    total = sample.agg(F.sum("label"), F.count("*")).first()
    toxic, clean = total[0] or 0, (total[1] or 0) - (total[0] or 0)
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter(F.col("t") >= LEAST_ROWS)
    lift = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    counts = counts.withColumn("lift", lift).filter(F.col("lift") >= LEAST_LIFT)
    best = counts.orderBy(F.desc(F.col("lift") * F.sqrt("t")), F.length("term"), "term").limit(CANDIDATES).collect()
    place = {r.term: i for i, r in enumerate(best)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[t] for t in terms(x.as_py()) if t in place) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("label")], ["found", "label"])

    rows_ = sample.mapInArrow(present, "found array<int>, label int").filter(F.size("found") > 0).collect()
    return _cover([r.term for r in best], [(r.found, r.label) for r in rows_])


def _cover(names: list[str], rows: list[tuple[list[int], int]]) -> list[str]:
    """Terms, the one that adds most first, until toxic rows have ``DEPTH`` of them or no term adds enough."""
    has = np.zeros((len(rows), len(names)), dtype=bool)
    for i, (found, _) in enumerate(rows):
        has[i, found] = True
    label = np.array([y for _, y in rows], dtype=bool)
    depth, chosen = np.zeros(len(rows), dtype=int), []
    usable = np.ones(len(names), dtype=bool)
    stems = [n.rstrip("*") for n in names]
    while len(chosen) < FOUND and usable.any():
        need = label & (depth < DEPTH)
        gain = np.where(usable, has[need].sum(axis=0) - CLEAN_COST * has[~label].sum(axis=0), -1)
        best = min(range(len(names)), key=lambda j: (-gain[j], len(stems[j]), names[j]))
        if gain[best] < LEAST_ROWS:
            break
        chosen.append(names[best])
        depth += has[:, best]
        for j, stem in enumerate(stems):  # what the term includes, or is part of, is no voter of its own
            if stem.startswith(stems[best]) or stems[best].startswith(stem):
                usable[j] = False
    return chosen


class Voters:
    """The voters in the order of the bits of a vote."""

    def __init__(self, patterns: list[str]):
        self.bit: dict[str, int] = {}
        for i, lexicon in enumerate(LEXICONS.values()):
            self.bit.update({w: 1 << i for w in lexicon.split()})
        n = len(LEXICONS)
        self.taunt, self.threat = 1 << n, 1 << n + 1
        self.found = {p: 1 << n + 2 + i for i, p in enumerate(patterns)}
        self.silence = 1 << n + 2 + len(patterns)
        self.count = n + 3 + len(patterns)
        self.lengths = sorted({len(p) - 1 for p in patterns if p.endswith("*")})

    def vote(self, text: str | None) -> int:
        votes, get, found = 0, self.bit.get, self.found.get
        low = (text or "").lower()
        for w in {w.strip(_EDGES) for w in set(low.split())}:
            votes |= get(w, 0) | found(w, 0)
            for n in self.lengths:
                votes |= found(w[:n] + "*", 0)
        if votes & (self.taunt - 1) and TAUNT.search(low):
            votes |= self.taunt
        if ("kill" in low or "hurt" in low or "destroy" in low or "beat" in low) and THREAT.search(low):
            votes |= self.threat
        return votes or self.silence


def _fired(votes: np.ndarray, n: int) -> np.ndarray:
    return ((votes[:, None] >> np.arange(n)) & 1).astype(float)


class LabelModel:
    """Two classes; each voter fires with its own probability in each, and voters are correlated within the toxic one.

    ``share`` is that of toxic texts, ``fires`` the probabilities by class, ``correlation`` that of two voters
    beyond what the classes explain. A voter that repeats others says less: its evidence is
    divided by one plus its correlations. The last voter is the silence of all others.
    """

    def __init__(self, fires: np.ndarray, share: float, correlation: np.ndarray | None = None):
        self.fires, self.share = fires, share
        self.correlation = np.zeros((fires.shape[1],) * 2) if correlation is None else correlation
        self.weight = 1 / (1 + self.correlation.sum(axis=1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fired = _fired(votes, len(self.weight))
        logit = np.log(self.share / (1 - self.share)) + fired @ (np.log(self.fires[1] / self.fires[0]) * self.weight)
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def _moments(votes: DataFrame, model: LabelModel) -> np.ndarray:
    """Posterior-weighted counts over all documents: by class, a voter's own on the diagonal and pairs beside it.

    Each partition of the distinct votes adds one array.
    """
    n = len(model.weight)
    sent = votes.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * n * n)
        for batch in batches:
            masks, counts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fired, p = _fired(masks, n), sent.value.posterior(masks)
            for y, q in enumerate(((1 - p) * counts, p * counts)):
                total[y] += q.sum()
                total[2 + y * n * n : 2 + (y + 1) * n * n] += ((fired * q[:, None]).T @ fired).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["amounts"])

    parts = votes.mapInArrow(run, "amounts binary").collect()
    return sum((np.frombuffer(r.amounts) for r in parts), np.zeros(2 + 2 * n * n))


def _rates(own: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.clip((own + np.array([[0.01], [0.5]])) / (size[:, None] + 1), 1e-6, 1 - 1e-6)


def _correlation(both: np.ndarray, n: float) -> np.ndarray:
    """Correlations of the voters on the ``n`` toxic texts, where they fire; weak ones and the silence's count as none."""
    p = np.diag(both) / max(n, 1e-9)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    out = np.clip((both / max(n, 1e-9) - np.outer(p, p)) / np.maximum(spread, 1e-9), 0, 1)
    np.fill_diagonal(out, 0)
    out[out < LEAST_CORRELATION] = 0
    out[-1] = out[:, -1] = 0
    return out


def fit_label_model(votes: DataFrame, known: tuple[np.ndarray, np.ndarray]) -> LabelModel:
    """Accuracies and correlations of the voters from distinct votes and their counts (votes, count).

    The correlations come from the posteriors of the last round; in every round they would feed on themselves, as fewer
    texts count as toxic the more the votes are discounted. ``known`` has what the labelled rows say: by class,
    how often each voter fires, and the rows.
    """
    own, size = known
    n = own.shape[1]
    start = _rates(own, size)
    model = LabelModel(start, 0.1)
    for _ in range(EM_ROUNDS):
        moments = _moments(votes, model)
        size, pairs = moments[:2], moments[2:].reshape(2, n, n)
        if size.sum() == 0:
            return model
        hold = HOLD * np.maximum(size, 1)[:, None]
        rates = (_rates(np.stack([np.diag(p) for p in pairs]), size) * size[:, None] + start * hold) / (size[:, None] + hold)
        model = LabelModel(rates, float(np.clip(size[1] / size.sum(), 1e-3, 0.5)))
    return LabelModel(model.fires, model.share, _correlation(pairs[1], size[1]))


def features(text: str | None, voters: Voters) -> list[int]:
    """Hashed places of the text's terms, of the voters that fire, and of whether any does."""
    votes, found = voters.vote(text), terms(text)
    if votes != voters.silence:
        found.update(f" {i}" for i in range(voters.count) if votes >> i & 1)
        found.add(" any")
    return [zlib.crc32(t.encode()) & (SIZE - 1) for t in found]


def fit(places: np.ndarray, starts: np.ndarray, target: np.ndarray, odds: float, patterns: list[str]) -> bytes:
    """Logistic weights on soft labels; features that do not point to toxic texts are left out."""
    n, row = len(target), np.repeat(np.arange(len(target)), np.diff(starts))
    seen = np.bincount(places, minlength=SIZE)
    toxic = np.bincount(places, weights=target[row], minlength=SIZE)
    share = float(np.clip(target.mean(), 1e-6, 1 - 1e-6))
    z = (toxic - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    kept = (seen >= 3) & (z >= LEAST_Z)
    use = kept[places]
    places, row = places[use], row[use]
    weights, bias = np.zeros(SIZE), np.log(share / (1 - share))
    speed, bias_speed = np.full(SIZE, 1e-8), 1e-8
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=weights[places], minlength=n) + bias, -35, 35)))
        gap = (p - target) / n
        slope = np.bincount(places, weights=gap[row], minlength=SIZE)
        speed += slope**2
        bias_speed += gap.sum() ** 2
        pace = np.where(kept, PACE / np.sqrt(speed), 0)
        weights -= pace * slope
        weights = np.maximum(weights - pace * SHRINK, 0)  # what explains little goes; no word makes a text clean
        bias -= PACE * gap.sum() / np.sqrt(bias_speed)
    margins = np.bincount(row, weights=weights[places], minlength=n) + bias
    scale, shift = sigmoid_fit(margins, (target >= 0.5).astype(float))
    out = io.BytesIO()
    np.savez(out, weights=weights * scale, bias=np.array([bias * scale + shift - np.log(odds)]), patterns=np.array(patterns, dtype=str))
    return out.getvalue()


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, fit_rows: int = FIT_ROWS) -> bytes | None:
    """The classifier; ``labels`` (doc_id, toxic) is read outside the held-out fold, to find patterns and start the label model."""
    spark = docs.sparkSession
    short_batches(spark)
    patterns = _patterns(docs, labels, rows)
    voters = Voters(patterns)
    sent = spark.sparkContext.broadcast(voters)

    @F.pandas_udf(LongType())
    def vote(texts):
        return texts.map(sent.value.vote, na_action=None)

    sample, _ = labelled(docs, labels, "toxic", FOLDS, HELD, rows)
    own, size = np.zeros((2, voters.count)), np.zeros(2)
    for row in sample.groupBy("label", vote("text").alias("votes")).count().collect():  # at most the rows of the sample
        own[row.label] += _fired(np.array([row.votes]), voters.count)[0] * row["count"]
        size[row.label] += row["count"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    votes = stage(docs.select(F.xxhash64(text).alias("key"), vote(text).alias("votes")), "votes")
    distinct = stage(votes.groupBy("votes").agg(F.count("*").alias("count")).coalesce(VOTE_PARTS), "distinct")
    model = fit_label_model(distinct, (own, size))
    judge = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def posterior(masks):
        return masks.map(dict(zip(u := masks.unique(), judge.value.posterior(u))).get).astype(float)

    # Equal texts count once; the key is a hash, so the smallest keys are a fair sample.
    judged = votes.groupBy("key").agg(F.first("votes").alias("votes")).withColumn("target", posterior("votes"))
    sides = [(F.col("target") < 0.5), (F.col("target") >= 0.5)]
    sizes = judged.agg(*[F.count_if(side) for side in sides]).first()
    chosen = [judged.filter(side).orderBy("key").limit(fit_rows).select("key", "target") for side in sides]
    sample = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    sample = sample.join(F.broadcast(chosen[0].unionByName(chosen[1])), "key").dropDuplicates(["key"])
    odds = 1.0
    if all(sizes):
        odds = min(sizes[1], fit_rows) / min(sizes[0], fit_rows) * sizes[0] / sizes[1]
    bits = bits_of(sample, partial(features, voters=voters), SIZE, "target")
    return gathered(bits, partial(fit, odds=odds, patterns=patterns), "target")


def scorer(docs: DataFrame, model: bytes | None):
    """A column function text -> probability of toxicity; 0 without a model."""
    parts = dict(np.load(io.BytesIO(model))) if model else None
    line = None
    if parts is not None:
        at = np.flatnonzero(parts["weights"])
        line = dict(zip(at.tolist(), parts["weights"][at].tolist())), float(parts["bias"][0]), Voters(parts["patterns"].tolist())
    sent = docs.sparkSession.sparkContext.broadcast(line)

    @F.pandas_udf("double")
    def score(texts):
        if sent.value is None:
            return texts.map(lambda _: 0.0, na_action=None).astype(float)
        weights, bias, voters = sent.value
        get = weights.get

        def one(text) -> float:
            margin = bias + sum(get(i, 0.0) for i in set(features(text, voters)))
            return float(1 / (1 + np.exp(-min(max(margin, -35.0), 35.0))))

        return texts.map(one, na_action=None).astype(float)

    return lambda text: score(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, FOLDS) == HELD


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts get the score of the bias; an empty table gives no rows.
    """
    score = scorer(docs, train(docs, labels, rows, fit_rows))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
