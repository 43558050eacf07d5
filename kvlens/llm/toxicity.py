"""Toxicity scores after noisy-channel restoration of obfuscated words.

A character language model (trigrams counted over all documents) and a channel of leetspeak, repetition,
symbols and spacing make a lattice of every suspicious string; Viterbi search restores the likeliest text.
A log-odds model of restored words and their beginnings, fitted on labelled texts, scores it.

Learning uses at most MAX_TRAIN labelled texts (a hash of the id picks them); near copies among them count
once, so a copied text doesn't make its ordinary words look toxic.  How strong evidence must be is chosen by
cross-validation among these texts.  Labels enter nowhere else.

Defined cases: null and empty texts get the score of a text without evidence; a document without label is
scored alike; without any toxic label all scores are the bias; repeated rows get equal scores; repeated
labels of one document count as toxic if one is; a doc_id that is null counts as held out if crc32 says so
(crc32 of null is null, held_out is then null).
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlens.llm.common import Scratch, bounded, documents, map_rows, text_or_empty

MAX_TRAIN = 8000
BIAS = -4.0
#: Scores from here on count as toxic.
THRESHOLD = 0.3
#: A word or beginning is evidence if it was in this share of the toxic training texts, and in this many.
MIN_SHARE, MIN_TOXIC = 0.012, 4
#: How much likelier it must be there (log odds): that of CUTS which does best on folds of the training texts.
FOLDS, CUTS = 4, (3.5, 4.0, 4.5, 5.0, 5.5, 6.0)
CACHE = 200_000

#: Letters that other characters stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c"}
#: Costs of the channel: a stand-in, a dropped symbol or digit, a dropped repeat in a long run or a short one, a word's end at a separator.
STAND_IN, DROP, DROP_DIGIT, LONG_RUN, SHORT_RUN, SPLIT = 0.7, 2.5, 7.0, 0.3, 4.0, 1.0
OTHER, EDGE, SIDE = 26, 27, 28
CODE = np.full(256, EDGE, np.int64)
CODE[128:] = OTHER
CODE[97:123] = CODE[65:91] = np.arange(26)

EDGES = ".,;:?\"'()[]{}…«»“”"
SEPARATOR = " .-_*~/\\,"
SPACED = re.compile(r"(?<!\w)(?:[^\W_]|[@$!+|])(?:[ .\-_*~/\\,]{1,3}(?:[^\W_]|[@$!+|])){3,}(?!\w)")
RUN = re.compile(r"(.)\1\1")


# -- language model -----------------------------------------------------------------------------------------


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n over all documents: summed in each task, then by Spark."""

    def count(batches):
        import pyarrow as pa

        sums = np.zeros(SIDE**3, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 256):
                codes = CODE[np.frombuffer(("\n" + "\n".join(texts[at : at + 256]) + "\n").encode(), np.uint8)]
                codes = codes[np.r_[True, (codes[1:] != EDGE) | (codes[:-1] != EDGE)]]
                if len(codes) > 2:
                    sums += np.bincount((codes[:-2] * SIDE + codes[1:-1]) * SIDE + codes[2:], minlength=SIDE**3)
        grams = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int32()), pa.array(sums[grams], pa.int64())], names=["gram", "n"])

    return bounded(docs).select(text_or_empty(text_col).alias("text")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """log P(c | a, b), smoothed over shorter contexts; at most 21952 counts are read."""
    table = np.zeros((SIDE,) * 3)
    for row in counts.collect():
        table[row["gram"] // SIDE**2, row["gram"] // SIDE % SIDE, row["gram"] % SIDE] = row["n"]
    one = table.sum((0, 1)) + 1.0
    one /= one.sum()
    two = table.sum(0) + 5.0 * one
    two /= two.sum(1, keepdims=True)
    three = table + 5.0 * two[None]
    return np.log(three / three.sum(2, keepdims=True))


# -- channel ------------------------------------------------------------------------------------------------


def code_of(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else EDGE if c == " " else OTHER


def restore(noisy: str, lm: list) -> str:
    """Viterbi search over the lattice of ``noisy``; a state is the last two characters sent."""
    states: dict[tuple[str, str], tuple[float, str]] = {(" ", " "): (0.0, "")}
    run, previous = 0, ""
    for i, c in enumerate(noisy):
        run = run + 1 if c == previous else 1
        previous = c
        long = run > 2 or noisy[i : i + 3] == c * 3 or noisy[i - 1 : i + 2] == c * 3
        options: list[tuple[str, float]] = [(x, STAND_IN) for x in LEET.get(c, "")]
        if c.isalpha():
            options.append((c, 0.0))
        elif c in SEPARATOR:
            options += [("", 0.2), (" ", SPLIT)]
        else:
            options.append(("", DROP_DIGIT if c.isdigit() else DROP))
        made: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (score, sent) in states.items():
            row = lm[code_of(a)][code_of(b)]
            for x, cost in options:
                if not x:
                    step = (a, b), (score - cost, sent)
                elif x == " " == b:
                    step = (a, b), (score - cost, sent)
                else:
                    step = (b, x), (score - cost + row[code_of(x)], sent + x)
                if step[0] not in made or made[step[0]][0] < step[1][0]:
                    made[step[0]] = step[1]
            if run > 1 and (c == b or b in LEET.get(c, "")) and b != " ":
                step = (a, b), (score - (LONG_RUN if long else SHORT_RUN), sent)
                if step[0] not in made or made[step[0]][0] < step[1][0]:
                    made[step[0]] = step[1]
        states = made
    ended = ((score + lm[code_of(a)][code_of(b)][EDGE], sent) for (a, b), (score, sent) in states.items())
    return max(ended, default=(0.0, ""))[1]


def suspicious(core: str) -> bool:
    return not core.isalpha() and any(map(str.isalpha, core)) or RUN.search(core) is not None


def restored_words(token: str, lm: list) -> list[str]:
    """Words that a lower-case token stands for."""
    core = token.strip(EDGES)
    return restore(core, lm).split() if suspicious(core) else [core]


def spaced_words(text: str, lm: list) -> list[str]:
    """Words written letter by letter with separators between."""
    return [w for m in SPACED.finditer(text) for w in restore(m.group(), lm).split()]


def evidence(word: str) -> list[str]:
    return [f"={word}"] + [f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n] if len(word) >= 3 else []


# -- model --------------------------------------------------------------------------------------------------


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, labels: DataFrame, lm: np.ndarray, scratch: Scratch, most: int = MAX_TRAIN) -> DataFrame:
    """toxic, evidence of at most about ``most`` labelled texts, one of each family of near copies."""
    usable = labels.where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic IS NOT NULL")
    usable = scratch.save(usable, "usable")
    share = min(1.0, most / max(1, usable.count()))
    picked = usable.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")
    table = lm.tolist()

    def run(ids: list, texts: list, toxic: list) -> dict:
        families, found = [], []
        for text in texts:
            low = text.lower()
            words = low.split()
            hashes = [crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))]
            # The least in two orders: texts that share a passage rarely agree in both.
            families.append(min(hashes) << 31 | min(h * 0x9E3779B1 & 0x7FFFFFFF for h in hashes))
            known = {w for t in set(words) for w in restored_words(t, table)} | set(spaced_words(low, table))
            found.append(sorted({e for w in known for e in evidence(w)}))
        return {"doc_id": ids, "toxic": toxic, "family": families, "evidence": found}

    rows = scratch.save(map_rows(texts, run, "doc_id long, toxic int, family long, evidence array<string>", rows=128), "evidence")
    # A family is toxic if one of its texts is, and then the least such text stands for it.
    stands = F.min_by("evidence", F.struct(-F.col("toxic"), "doc_id", "evidence"))
    return scratch.save(rows.groupBy("family").agg(F.max("toxic").alias("toxic"), stands.alias("evidence")), "sample")


def log_odds(n_toxic: Column, n: Column) -> Column:
    """Of the columns p (toxic texts with the evidence) and n (texts with it)."""
    return F.log((F.col("p") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("n") - F.col("p") + 0.5) / (n - n_toxic + 1.0))


def least_log_odds(sample: DataFrame) -> float:
    """The cut with the best F measure when each fold of families is judged by the evidence of the others.

    Any cut's evidence brings a score past THRESHOLD by itself, so a text's strongest evidence decides.  Of
    equal cuts the highest is taken, which leaves more texts alone.
    """
    folded = sample.withColumn("fold", F.pmod(F.xxhash64(F.lit(11), "family"), F.lit(FOLDS)).cast("int"))
    sizes = {r["fold"]: (r["p"], r["n"]) for r in folded.groupBy("fold").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n = (sum(x) for x in zip(*sizes.values(), strict=True))
    seen = folded.select("family", "fold", "toxic", F.explode("evidence").alias("e"))
    inside = [F.struct(F.sum(F.when(F.col("fold") == k, F.col("toxic")).otherwise(0)).alias("p"), F.count(F.when(F.col("fold") == k, 1)).alias("n")) for k in range(FOLDS)]
    counts = seen.groupBy("e").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n"), *(c.alias(f"in{k}") for k, c in enumerate(inside))).where(F.col("p") >= MIN_TOXIC)
    others = []
    for k in range(FOLDS):
        toxic_out, n_out = n_toxic - sizes.get(k, (0, 0))[0], n - sizes.get(k, (0, 0))[1]
        least = max(MIN_TOXIC, math.ceil(MIN_SHARE * toxic_out))
        others.append(F.struct(F.lit(k).alias("fold"), (F.col("p") - F.col(f"in{k}.p")).alias("p"), (F.col("n") - F.col(f"in{k}.n")).alias("n"), F.lit(toxic_out).alias("t"), F.lit(n_out).alias("all"), F.lit(least).alias("least")))
    out = counts.select("e", F.explode(F.array(*others)).alias("o")).select("e", "o.*").where("p >= least").withColumn("w", log_odds(F.col("t"), F.col("all"))).where(F.col("w") >= CUTS[0])
    # As few entries as the weights have, times the folds: the sample is bounded.
    best = seen.join(F.broadcast(out.select("e", "fold", "w")), ["e", "fold"]).groupBy("family").agg(F.max("w").alias("w"))
    hits = sample.select("family", "toxic").join(best, "family").agg(*(F.count(F.when(F.col("w") >= c, 1)).alias(f"all{i}") for i, c in enumerate(CUTS)), *(F.sum(F.when(F.col("w") >= c, F.col("toxic"))).alias(f"toxic{i}") for i, c in enumerate(CUTS))).first()
    f_measure = {c: 2 * (hits[f"toxic{i}"] or 0) / (hits[f"all{i}"] + n_toxic) for i, c in enumerate(CUTS)}
    return max(CUTS, key=lambda c: (f_measure[c], c))


def weights(sample: DataFrame) -> dict[str, float]:
    """Log odds of the evidence that the sample supports: some thousands of entries at most, as each must be
    in MIN_SHARE of the toxic texts and texts are a bounded sample."""
    n_toxic, n = (x or 0 for x in sample.agg(F.sum("toxic"), F.count(F.lit(1))).first())
    if not n_toxic:
        return {}
    seen = sample.select("toxic", F.explode("evidence").alias("e")).groupBy("e").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n"))
    kept = seen.where(F.col("p") >= max(MIN_TOXIC, math.ceil(MIN_SHARE * n_toxic))).withColumn("w", log_odds(F.lit(n_toxic), F.lit(n))).where(F.col("w") >= least_log_odds(sample))
    return {r["e"]: r["w"] for r in kept.select("e", "w").collect()}


class WordWeights(dict):
    """The strongest evidence of each lower-case token met so far."""

    def __init__(self, model: dict[str, float], lm: list):
        self.model, self.lm = model, lm

    def of_word(self, word: str) -> float:
        return max((self.model.get(e, 0.0) for e in evidence(word)), default=0.0)

    def __missing__(self, token: str) -> float:
        if len(self) > CACHE:
            self.clear()
        w = max(map(self.of_word, restored_words(token, self.lm)), default=0.0)
        if len(token) < 64:
            self[token] = w
        return w


def scorer(model: dict[str, float], lm: np.ndarray):
    """A function from texts to scores; each worker keeps the words it has met."""
    table = lm.tolist()
    caches: list[WordWeights] = []

    def score(texts: list[str]) -> list[float]:
        if not caches:
            caches.append(WordWeights(model, table))
        own, scores = caches[0], []
        for text in texts:
            low = text.lower()
            total = sum(map(own.__getitem__, set(low.split())))
            if model and SPACED.search(low):
                total += sum(map(own.of_word, set(spaced_words(low, table))))
            scores.append(1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, BIAS + total)))))
        return scores

    return score


def reject(docs: DataFrame, model: dict[str, float], lm: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns."""
    score = scorer(model, lm)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([x < threshold for x in score(texts.tolist())], dtype=bool)

    return bounded(docs).where(clean(text_or_empty(text_col)))


def score_texts(docs: DataFrame, model: dict[str, float], lm: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of every whole text."""
    score = scorer(model, lm)

    def run(ids: list, texts: list) -> dict:
        return {id_col: ids, "score": score(texts)}

    return map_rows(docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("text")), run, f"{id_col} long, score double")


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[dict[str, float], np.ndarray]:
    lm = language_model(trigram_counts(docs))
    return weights(training_sample(docs, labels, lm, scratch)), lm


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, lm = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "toxicity"))
    scored = score_texts(docs, model, lm)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
