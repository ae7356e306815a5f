"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, with look-alike characters put back, and stems, from which a text has several words, that a
share of the toxic texts hold and that are LEXICON_TIMES as likely there as in others. Features are rates of a text's words
and characters: lexicon densities (overall, found only after look-alike characters were put back, the densest window), hits
near a second-person word, capitals, punctuation and obfuscation. The lexicon and Spark's gradient-boosted trees are learned
from four fifths of the sample; its isotonic regression calibrates on the rest, which neither has seen.

The classifier is fitted on at most FIT_ROWS labelled rows (the ids with the smallest hashes), which bounds the sample;
everything else covers all rows. Labels, lang, source and ids are never inputs of a score.

Nulls: a null text is an empty one, and gets a score like any other; a null id is not held out; rows without a usable label
or id don't train. Repeated rows are scored one by one and train once. If the sample lacks one of the classes, every score is
the share of toxic rows (0 without labels). An empty table gives an empty result. Extra columns stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: The bound of the training sample, and what a word needs to enter the lexicon.
FIT_ROWS = 20_000
LEXICON_WORDS, LEXICON_SHARE, LEXICON_TIMES, LEXICON_DEVIATIONS = 512, 0.01, 20.0, 2.0
#: Lengths of stems, and what marks one in the lexicon.
STEM, MARK = range(4, 9), "*"
THRESHOLD = 0.7
TREES, TREE_DEPTH, STEP = 24, 4, 0.2
NEAR, WINDOW = 3, 50
#: Second-person words of the corpus's languages.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros os vuestro".split())
#: Characters that stand in for letters.
LOOK_ALIKE = str.maketrans("0134578@$!|€", "oieastbasiie")

HIT, HIDDEN, SECOND, CAPS, MIXED, STRETCHED, RUN, SINGLE = (1 << i for i in range(8))
FEATURES = 18


def plain(token: str) -> tuple[str, str]:
    """A token's letters in lower case, as they stand and with look-alike characters put back."""
    low = token.lower().strip(".,;:!?\"'()[]{}<>#%&*-_~=+/\\")
    return "".join(filter(str.isalpha, low)), "".join(filter(str.isalpha, low.translate(LOOK_ALIKE)))


class Codes(dict):
    """What a token is, as bits; remembered up to a bound."""

    BOUND = 400_000

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        bare, back = plain(token)
        core = token.strip(".,;:!?\"'()[]{}<>#%&*-_~=+/\\")
        known = lambda w: w in self.lexicon or any(w[:n] + MARK in self.lexicon for n in STEM if n < len(w))
        code = HIT if known(bare) or known(back) else 0
        code |= HIDDEN if code and not known(bare) else 0
        code |= SECOND if bare in YOU else 0
        code |= CAPS if len(bare) > 1 and core.isupper() else 0
        code |= MIXED if bare and not core.isalpha() and any(c in "0134578@$!|*#" for c in core) else 0
        code |= STRETCHED if any(a == b == c for a, b, c in zip(bare, bare[1:], bare[2:], strict=False)) else 0
        code |= RUN if len(token) - len(token.rstrip(".,;:!?#%&*$-_~=+")) > 1 else 0
        code |= SINGLE if len(bare) == 1 else 0
        self[token] = code
        return code


def _spelt(tokens: list[str], codes: np.ndarray, lexicon: frozenset[str]) -> int:
    """Lexicon words whose letters stand apart."""
    single = np.flatnonzero(np.concatenate(([0], (codes & SINGLE) > 0, [0]))[1:] != np.concatenate(([0], (codes & SINGLE) > 0, [0]))[:-1])
    return sum(plain("".join(tokens[s:e]))[0] in lexicon for s, e in zip(single[::2], single[1::2], strict=True) if e - s > 2)


def features(text: str, codes: Codes) -> list[float]:
    tokens = text.split()
    c = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
    n, raw = max(len(tokens), 1), text.encode()
    size = max(len(raw), 1)
    hit = (c & HIT) > 0
    hits, apart = int(hit.sum()), _spelt(tokens, c, codes.lexicon)
    summed = np.concatenate(([0], np.cumsum(hit)))
    densest = int((summed[WINDOW:] - summed[:-WINDOW]).max()) if len(tokens) > WINDOW else hits
    you = np.concatenate((np.zeros(NEAR + 1, np.int64), np.cumsum((c & SECOND) > 0)))
    you = np.concatenate((you, np.full(NEAR, you[-1])))
    at = np.flatnonzero(hit)
    near = int((you[at + 2 * NEAR + 1] > you[at]).sum())
    rate = lambda bit: float(((c & bit) > 0).sum()) / n
    without = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    return [float(np.log1p(len(tokens))), hits / n, float(np.log1p(hits)), densest / WINDOW, rate(HIDDEN), float(apart), near / n, float(np.log1p(near)), rate(SECOND), rate(CAPS), without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), rate(MIXED), rate(STRETCHED), rate(RUN), rate(SINGLE), without(b"!"), without(b"?"), without(b"\"#$%&'()*+,-./:;<=>@[]^_{|}~")]


def _feature_column(lexicon: frozenset[str], text):
    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes = Codes(lexicon)
        for s in series:
            yield pd.Series([features(t or "", codes) for t in s])

    return run(text)


def held_out(doc_id):
    """The fold that never trains; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _lexicon(sample: DataFrame) -> frozenset[str]:
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                own = {x for w in set((t or "").split()) for x in plain(w) if len(x) > 2}
                stems = Counter(w[:n] + MARK for w in own for n in STEM if n < len(w))
                own = sorted(own | {x for x, k in stems.items() if k > 1})
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([y] * len(own), pa.int32())], names=["word", "toxic"])

    pos, neg = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not pos or not neg:
        return frozenset()
    counts = sample.select("text", "toxic").mapInArrow(words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"))
    odds = F.ln((F.col("p") + 0.5) / (pos + 1)) - F.ln((F.col("n") - F.col("p") + 0.5) / (neg + 1))
    spread = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") - F.col("p") + 0.5))
    best = counts.filter(F.col("p") >= max(4.0, LEXICON_SHARE * pos)).withColumn("odds", odds).withColumn("sure", F.col("odds") - LEXICON_DEVIATIONS * spread)
    best = best.filter((F.col("odds") >= float(np.log(LEXICON_TIMES))) & (F.col("sure") > 0))
    return frozenset(r["word"] for r in best.orderBy(F.desc("sure"), "word").limit(LEXICON_WORDS).select("word").collect())


class Model:
    """A lexicon, boosted trees and a calibration; or only a base rate."""

    def __init__(self, lexicon: frozenset[str], trees=None, steps=None, base: float = 0.0):
        self.lexicon, self.trees, self.steps, self.base = lexicon, trees, steps, base

    def score(self, docs: DataFrame) -> DataFrame:
        """row (a struct of docs' columns, whatever their names) and score, from 0 to 1."""
        rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
        if self.trees is None:
            return rows.withColumn("score", F.lit(float(self.base)))
        from pyspark.ml.functions import array_to_vector, vector_to_array

        rows = rows.withColumn("_features", array_to_vector(_feature_column(self.lexicon, F.col("row.text").cast("string"))))
        out = self.trees.transform(rows).withColumn("_p", vector_to_array("_probability")[1])
        # The calibration has flat steps; a small part of the trees' own value keeps the order within a step.
        score = F.least(F.greatest(0.995 * F.col("_calibrated") + 0.005 * F.col("_p"), F.lit(0.0)), F.lit(1.0))
        return self.steps.transform(out).select("row", score.alias("score"))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, rows: int = FIT_ROWS) -> Model:
    """Fits on at most that many labelled rows outside the held-out fold."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    own = own.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    # At most FIT_ROWS pairs of numbers are broadcast. Copies count once, lest one text becomes many votes.
    sample = scratch.save(texts.join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("fold")).agg(F.max(F.struct("doc_id", "text", "toxic")).alias("x")).select("fold", "x.text", "x.toxic"))
    n, pos = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not pos or pos == n:
        return Model(frozenset(), base=(pos or 0) / n if n else 0.0)
    part = F.pmod(F.col("fold"), F.lit(5))
    lexicon = _lexicon(sample.filter(part != 0))
    rows_in = scratch.save(sample.select("fold", F.col("toxic").cast("double").alias("toxic"), _feature_column(lexicon, F.col("text")).alias("f")))
    vectors = rows_in.select("fold", "toxic", array_to_vector("f").alias("_features")).coalesce(4)
    learn, check = vectors.filter(part != 0).persist(), vectors.filter(part == 0)
    trees = GBTClassifier(featuresCol="_features", labelCol="toxic", predictionCol="_prediction", maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=STEP, minInstancesPerNode=5, seed=7).setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(learn)
    learn.unpersist()
    calibrate = trees.transform(check).select(vector_to_array("_probability")[1].alias("_p"), "toxic")
    if calibrate.isEmpty():
        return Model(lexicon, base=pos / n)
    steps = IsotonicRegression(featuresCol="_p", labelCol="toxic", predictionCol="_calibrated").fit(calibrate)
    return Model(lexicon, trees, steps)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, Scratch(docs.sparkSession))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = model.score(rows)
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    return fit(docs, labels, Scratch(docs.sparkSession)).score(docs).filter(F.col("score") < THRESHOLD).select("row.*")
