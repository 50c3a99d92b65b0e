"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

Labellers look at a text's tokens and vote poor, good or nothing. Expectation-maximisation
over the counts of vote patterns (all documents; at most 3 to the power of the labellers'
number of rows) estimates each labeller's rates per class and the classes' shares, starting
from "some defect was seen". A pattern's posterior probability of poor text is the soft label.

The scorer is logistic regression on hashed token shares: each token adds its lower-cased
word and its shape (letter case, marks and digits, runs shortened), and a token equal to
the one before adds a feature of its own. It is fitted on a bounded sample, the ``FIT_ROWS``
different documents with the least hash, and then scores every document; texts whose score is over
``REJECT`` are rejected.

Defined cases: a text without tokens (null, empty, white space) has score and posterior 1
and is rejected; such texts take no part in the estimate; a labeller that a text is too short for votes nothing;
repeated rows are scored one by one; null ids stay null; an empty table gives no rows; the
filter returns all columns of the rows it keeps.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeaudit.llm.common import cut, drop_caches, importable, keep_cache

DIMENSIONS, FIT_ROWS, REJECT = 1 << 13, 4_096, 0.5
EM_ROUNDS, FIT_STEPS, FIT_RATE, FIT_DECAY = 200, 300, 0.1, 1e-4
CACHE_TOKENS = 500_000
SHORT = 20  # shares of shorter texts are taken as if they had so many tokens
POOR, GOOD, NONE = 1, 0, 2
SCORED = (("__posterior", T.DoubleType()), ("__score", T.DoubleType()), ("__keep", T.BooleanType()))

# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in is that it for was on are as with at be this have from or by an not you a he they we but
    der die das und ist in zu den von mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie
    le la les de des et un une que qui est dans pour par sur pas au ce il elle ne en avec plus on du
    el los las del y o con no por para su se como más pero sus al lo es""".split()
)
SYMBOLS = frozenset("#$%&*|!^~<>{}[]\\=+@_")
#: The first ``DEFECTS`` labellers vote poor or nothing, the others also good.
LABELLERS = ("symbols", "capitals", "repeats", "separators", "odd words", "marks", "variety", "top word", "stop words", "sentence ends")
DEFECTS = 8
#: A defect's labeller sees one kind of poor text: it finds at most this share of all poor texts, and errs on at most this share of good ones.
FINDS, ERRS = 0.3, 0.01

_PLAIN = re.compile(r"[\"'(]?[^\W_]+(?:[-'’][^\W_]+)*[.,;:!?\"')]?")
_DIGITS, _LOWER, _UPPER = re.compile(r"\d+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+")


def hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIMENSIONS


REPEAT = hashed("repeat")


def _outcomes(patterns: np.ndarray) -> np.ndarray:
    """One column per labeller of the votes that a pattern's number holds."""
    return np.asarray(patterns)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


class Tokens:
    """Facts about tokens, kept per worker: one row of numbers for each token met."""

    COLUMNS = 9  # characters, letters, capitals, symbols, has letter or digit, stop word, ends a sentence, is a plain word, marks

    def __init__(self):
        self.places: dict[str, int] = {}
        self.facts = np.zeros((1024, self.COLUMNS), np.float32)
        self.features = np.zeros((1024, 2), np.int64)

    def _add(self, token: str) -> int:
        place = len(self.places)
        if place == len(self.facts):
            self.facts = np.concatenate((self.facts, np.zeros_like(self.facts)))
            self.features = np.concatenate((self.features, np.zeros_like(self.features)))
        ended = token[-1] in ".,;:!?"
        bare = token[:-1] if ended else token
        if bare.isalpha():  # a plain word: its facts follow from its case
            if bare.islower():
                capitals, shape = 0, "a"
            elif bare[1:].islower():
                capitals, shape = 1, "Aa"
            else:
                capitals, shape = sum(map(str.isupper, bare)), _UPPER.sub("A", _LOWER.sub("a", bare))
            word = bare.lower()
            self.facts[place] = len(token), len(bare), capitals, 0, 1, word in STOP_WORDS, ended and token[-1] in ".!?", 1, ended
            shape += token[-1] if ended else ""
        else:
            letters = sum(map(str.isalpha, token))
            word = token.strip(".,;:!?\"'()#$%&*|").lower()
            self.facts[place] = (
                len(token), letters, sum(map(str.isupper, token)), sum(c in SYMBOLS for c in token), letters > 0 or any(map(str.isdigit, token)),
                word in STOP_WORDS, token[-1] in ".!?", _PLAIN.fullmatch(token) is not None, sum(not (c.isalnum() or c in "'-") for c in token),
            )
            shape = _UPPER.sub("A", _LOWER.sub("a", _DIGITS.sub("0", token)))
        self.features[place] = hashed("word " + word), hashed("shape " + shape[:12])
        self.places[token] = place
        return place

    def look_up(self, text: str) -> np.ndarray:
        if len(self.places) > CACHE_TOKENS:
            self.__init__()
        tokens = text.split()
        places = self.places
        for token in set(tokens).difference(places):
            self._add(token)
        return np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))


_tokens = Tokens()
keep_cache("quality", lambda: _tokens.__init__())


def votes(places: np.ndarray, facts: np.ndarray) -> list[int]:
    """The labellers' votes on one text's tokens."""
    n = len(places)
    chars, letters, capitals, symbols, spoken, stops, ends, plain, marks = facts[places].sum(axis=0, dtype=np.float64)
    repeats = (places[1:] == places[:-1]).mean() if n > 1 else 0.0
    kinds = np.unique(places, return_counts=True)[1]
    few, enough, many = n >= 4, n >= 10, n >= 20

    def defect(found: bool) -> int:
        return POOR if found else NONE

    return [
        defect(symbols / chars > 0.04),
        defect(letters > 0 and capitals / letters > 0.4),
        defect(enough and repeats > 0.15),
        defect(few and 1 - spoken / n > 0.15),
        defect(few and 1 - plain / n > 0.3),
        defect(few and marks / chars > 0.12),
        defect(many and n <= 2000 and len(kinds) / n < 0.3),
        defect(enough and kinds.max() / n > 0.25),
        (POOR if stops / n < 0.03 else GOOD if stops / n > 0.1 else NONE) if many else NONE,
        (POOR if ends / n < 0.005 or ends / n > 0.5 else GOOD if 0.01 < ends / n < 0.3 else NONE) if many else NONE,
    ]


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_caches("quality")
    for batch in batches:
        patterns = []
        for text in batch.column(0).to_pylist():
            places = _tokens.look_up(text or "")
            patterns.append(sum(v * 3**i for i, v in enumerate(votes(places, _tokens.facts))) if len(places) else -1)
        yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.int32()), *batch.columns[1:]], ["pattern", *batch.schema.names[1:]])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        patterns, ids, shares = [], [], []
        for text in batch.column(0).to_pylist():
            places = _tokens.look_up(text)
            patterns.append(sum(v * 3**i for i, v in enumerate(votes(places, _tokens.facts))))
            at, count = np.unique(_features(places), return_counts=True)
            ids.append(at)
            shares.append(count * 100.0 / max(len(places), SHORT))
        yield pa.RecordBatch.from_arrays(
            [pa.array(patterns, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(shares, pa.list_(pa.float64()))], ["pattern", "ids", "shares"]
        )


def _features(places: np.ndarray) -> np.ndarray:
    again = np.count_nonzero(places[1:] == places[:-1])
    return np.concatenate((_tokens.features[places].ravel(), np.full(again, REPEAT)))


def _scores(texts: list[str], weights: np.ndarray, bias: float, labels: np.ndarray) -> np.ndarray:
    """Posterior and score of each text. (The token cache is the worker's own, so only module functions use it.)"""
    out = np.ones((len(texts), 2))
    for row, text in enumerate(texts):
        places = _tokens.look_up(text)
        if len(places):
            again = np.count_nonzero(places[1:] == places[:-1])
            z = bias + (weights[_tokens.features[places]].sum() + again * weights[REPEAT]) * 100.0 / max(len(places), SHORT)
            pattern = sum(v * 3**i for i, v in enumerate(votes(places, _tokens.facts)))
            out[row] = labels[pattern], 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return out


class WeakLabels:
    """Two classes, and per class and labeller the rates of its three outcomes (good, poor, nothing)."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray):
        seen = _outcomes(patterns)
        poor = np.where((seen[:, :DEFECTS] == POOR).any(axis=1), 0.9, 0.1)
        for _ in range(EM_ROUNDS):
            weight = np.stack((counts * (1 - poor), counts * poor))
            self.share = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
            self.rates = np.stack([(weight @ (seen == outcome) + 1) / (weight.sum(axis=1, keepdims=True) + 3) for outcome in range(3)], axis=2)
            for rates, most in ((self.rates[0], ERRS), (self.rates[1], FINDS)):
                said = np.minimum(rates[:DEFECTS, POOR], most)
                rates[:DEFECTS, GOOD], rates[:DEFECTS, POOR], rates[:DEFECTS, NONE] = 1e-9, said, 1 - said
            new = self.posterior(patterns)
            moved, poor = np.abs(new - poor).max(initial=0), new
            if moved < 1e-9:
                break

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of poor text."""
        seen = _outcomes(patterns)
        logs = np.log(self.share)[:, None] + sum(np.log(self.rates[:, k, seen[:, k]]) for k in range(DEFECTS))
        for k in range(DEFECTS, len(LABELLERS)):  # "nothing" here means a text too short to judge: no evidence
            logs += np.where(seen[:, k] == NONE, 0.0, np.log(self.rates[:, k, seen[:, k]]))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """Each labeller's estimated share of right votes among its votes."""
        right = self.share[0] * self.rates[0, :, GOOD] + self.share[1] * self.rates[1, :, POOR]
        return dict(zip(LABELLERS, (right / (self.share @ self.rates[:, :, :2].sum(axis=2))).tolist()))


def fit_scorer(ids: list[np.ndarray], shares: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression with soft targets, by full-batch Adam."""
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    at, x = np.concatenate(ids).astype(np.int64), np.concatenate(shares)
    weights = np.zeros(DIMENSIONS + 1)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, FIT_STEPS + 1):
        z = np.bincount(owner, x * weights[at], len(ids)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) / len(ids)
        slope = np.append(np.bincount(at, x * error[owner], DIMENSIONS), error.sum()) + FIT_DECAY * weights
        first += 0.1 * (slope - first)
        second += 0.001 * (slope**2 - second)
        weights -= FIT_RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def weak_labels(docs: DataFrame) -> WeakLabels:
    """The weak-label model of all documents; ``accuracies()`` gives its estimate for each labeller."""
    importable(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = docs.select(text.alias("text")).mapInArrow(_vote, "pattern int").where("pattern >= 0")
    counts = patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").toArrow()
    return WeakLabels(counts.column("pattern").to_numpy(), counts.column("n").to_numpy().astype(float))


def labeller_accuracies(docs: DataFrame) -> DataFrame:
    """labeller, accuracy: the estimated share of right votes among each labeller's votes."""
    rows = list(weak_labels(docs).accuracies().items())
    return docs.sparkSession.createDataFrame(rows, "labeller string, accuracy double")


def _scored(docs: DataFrame, fit_rows: int) -> DataFrame:
    """``docs`` with __posterior, __score (1 is poor) and __keep."""
    model = weak_labels(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    # The least hashes are found without the texts; then the few texts are fetched, one for each hash.
    hashes = F.struct(F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(7), "doc_id", "text").alias("h2"))
    hashed = docs.select(text.alias("text"), hashes.alias("order")).where(F.col("text").rlike(r"\S"))
    last = hashed.select("order").distinct().orderBy("order").limit(fit_rows).agg(F.max("order").alias("last")).first()["last"]
    within = (F.col("order") <= F.struct(F.lit(last["h1"]), F.lit(last["h2"]))) if last else F.lit(False)
    chosen = hashed.where(within).groupBy("order").agg(F.first("text").alias("text"))
    chosen = cut(chosen.orderBy("order").select("text"), "fit-texts")
    sample = chosen.mapInArrow(_sample, "pattern int, ids array<long>, shares array<double>").toArrow()
    if sample.num_rows:
        weights, bias = fit_scorer(
            [np.array(x) for x in sample.column("ids").to_pylist()],
            [np.array(x) for x in sample.column("shares").to_pylist()],
            model.posterior(sample.column("pattern").to_numpy()),
        )
    else:
        weights, bias = np.zeros(DIMENSIONS), 0.0
    labels = model.posterior(np.arange(3 ** len(LABELLERS)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _scores(batch.column(batch.num_columns - 1).to_pylist(), weights, bias, labels)
            names = [*batch.schema.names[:-1], *(name for name, _ in SCORED)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 1] <= REJECT)], names)

    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in SCORED)])
    return docs.select("*", text.alias("__text")).mapInArrow(score, schema)


def classify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, posterior (of the weak labels), score (of the scorer; 1 is poor) and keep for every row of ``docs``."""
    scored = _scored(docs.select("doc_id", "text"), fit_rows)
    return scored.select("doc_id", *(F.col(name).alias(name.removeprefix("__")) for name, _ in SCORED))


def keep_good(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with all their columns."""
    return _scored(docs, fit_rows).where("__keep").select(*docs.columns)
