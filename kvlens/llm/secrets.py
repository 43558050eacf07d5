"""Secret scans: fixed patterns plus character Markov models of random strings and of ordinary identifiers.

Two first-order models are trained from labelled samples counted over all documents: values that the fixed
patterns find are samples of secrets, all other words and identifiers are samples of ordinary text; a short labelled
list says how ordinary identifiers join letters, digits and separators.  A token of 8 and more characters,
whatever they are, is a secret too when its log-likelihood ratio passes two thresholds, per character and in all.

Defined cases: a null or empty text has no spans; spans are in code points, end exclusive; fixed spans always
stay and a model's span is cut to what lies outside them; a corpus without secrets leaves the secret model flat; repeated rows give equal rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlens.llm.common import bounded, documents, map_rows, text_or_empty

#: The patterns, each with the fewest characters of its checked group.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)

#: Character classes of the models: the 64 of base 64, then "_-=", then any other and the word's edge.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CODE = np.full(128, len(ALPHABET), np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
SIDE = len(ALPHABET) + 1
#: Least log-likelihood ratio, per character and of a whole token (short tokens need a higher one per character).
THRESHOLD = 0.7
TOTAL = 8.0
#: Shares of a row that are counted, ordinary and secret, at most: the rest is the model's prior, whatever the
#: corpus's size.  A row of fewer than about FEW counts leans on its prior more.
COUNTED = (0.9, 0.5)
FEW = 50.0
#: Ordinary identifiers, for the steps between lower case, upper case, digits and separators.
LABELLED = """release-notes-2024-03-15 articles/2021/05/how-to-cook-rice chapter_12_section_34 2023-11-30 2024/01/02
report_2020_final_v2 IMG_20190412_1530 src/main/java/App getUserName parseHttpResponse MAX_RETRY_COUNT user-agent
utf-8 iso-8859-1 version-1-2-3 file_name_01 page-2 section3 h264 mp4 x86_64 sha256 base64 python3 2021-Q4 covid-19
lib/python3/site-packages images/2018/07/summer-holiday-12 docs/guide/chapter-3 build_1024 test_case_15 --help --- ====
readme-first New-York README Makefile JavaScript StringBuilder isEmpty toString ISO9001 COM1 A4 B2B 10-12 555-1234
img_0042 thumbnail-640x480 1920x1080 node_modules content/uploads/2016/09/photo-3 part-00001 log_2022_08_31 and/or
"""


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the fixed patterns, by start and then kind."""
    found = []
    if HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def pair_counts(strings: list[str]) -> np.ndarray:
    """Counts of neighbouring characters in all strings together."""
    joined = "\n".join(strings).encode("ascii", "replace")
    codes = CODE[np.frombuffer(joined, np.uint8) & 127]
    return np.bincount(codes[:-1] * SIDE + codes[1:], minlength=SIDE * SIDE) if len(codes) > 1 else np.zeros(SIDE * SIDE, np.int64)


def outside(text: str, base: list[tuple[int, int, int]]) -> str:
    """The text with its fixed spans blank."""
    for start, _, end in base:
        text = text[:start] + " " * (end - start) + text[end:]
    return text


def samples(text: str) -> tuple[list[str], list[str]]:
    """Labelled strings of one text: secrets, ordinary words and identifiers."""
    secrets, base = [], base_spans(text)
    for start, kind, end in base:
        value = text[start:end]
        secrets.append(ASSIGN.match(value).group(2) if kind == 0 else value)
    return secrets, ORDINARY.findall(outside(text, base))


def train(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """label, pair, n: pair counts over the labelled strings of all documents."""

    def count(batches):
        import pyarrow as pa

        sums = np.zeros((2, SIDE * SIDE), np.int64)
        for batch in batches:
            secrets: list[str] = []
            for text in batch.column(0).to_pylist():
                found, words = samples(text)
                secrets += found
                sums[0] += pair_counts(words)
            sums[1] += pair_counts(secrets)
        label, pair = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(pair, pa.int32()), pa.array(sums[label, pair], pa.int64())], names=["label", "pair", "n"])

    parts = bounded(docs).select(text_or_empty(text_col).alias("text")).mapInArrow(count, "label int, pair int, n long")
    return parts.groupBy("label", "pair").agg(F.sum("n").alias("n"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log P(next | char, secret) - log P(next | char, ordinary), a table of SIDE x SIDE (at most 9248 counts are read)."""
    table = np.zeros((2, SIDE, SIDE))
    for row in counts.collect():
        table[row["label"], row["pair"] // SIDE, row["pair"] % SIDE] = row["n"]
    logs = []
    for counts_of, counted, before in zip(table, COUNTED, (identifier_prior(table[0]), np.full((SIDE, SIDE), 1 / SIDE)), strict=True):
        n = counts_of.sum(1, keepdims=True)
        weight = counted * n / (n + FEW)
        logs.append(np.log(weight * counts_of / np.maximum(n, 1) + (1 - weight) * before))
    return logs[1] - logs[0]


def identifier_prior(counts: np.ndarray) -> np.ndarray:
    """P(next | char) of ordinary identifiers: the next class as in LABELLED, then a character of that class as in the counts."""
    kind = np.array([0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in ALPHABET] + [4])
    member = (kind[:, None] == np.arange(5)).astype(float)
    steps = member.T @ pair_counts(LABELLED.split()).reshape(SIDE, SIDE) @ member + 0.5
    steps /= steps.sum(1, keepdims=True)
    seen = counts.sum(0)
    of_class = member @ (member.T @ seen)
    weight = 0.8 * of_class / (of_class + FEW)
    within = weight * seen / np.maximum(of_class, 1) + (1 - weight) / (member @ member.sum(0))
    return steps[kind][:, kind] * within


def model_spans(text: str, ratios: np.ndarray, taken: list[tuple[int, int, int]], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Tokens of 8 and more characters that look random, cut to their parts outside the fixed spans."""
    found = [m.span() for m in TOKEN.finditer(text)]
    if not found:
        return []
    codes = CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]  # one byte a code point
    sums = np.concatenate([[0.0], np.cumsum(ratios[codes[:-1], codes[1:]])])
    start, end = np.array(found).T
    total = sums[end - 1] - sums[start]
    random = (total >= TOTAL) & (total >= threshold * (end - start - 1))
    out = []
    for s, e in zip(start[random].tolist(), end[random].tolist(), strict=True):
        for a, _, b in taken:
            if a < e and s < b:
                if s < a:
                    out.append((s, a))
                s = b
        if s < e:
            out.append((s, e))
    return out


def all_spans(text: str, ratios: np.ndarray, threshold: float = THRESHOLD) -> tuple[list, list]:
    base = base_spans(text)
    return base, model_spans(text, ratios, base, threshold)


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, the number of spans of each kind, base (fixed spans as text) and spans (all, as text)."""
    place = {k: i for i, k in enumerate((*KINDS, "random"))}

    def run(ids: list, texts: list) -> dict:
        out: dict = {id_col: ids, **{f"n_{k}": [] for k in (*KINDS, "random")}, "base": [], "spans": []}
        for text in texts:
            base, random = all_spans(text, ratios, threshold)
            for i, k in enumerate(KINDS):
                out[f"n_{k}"].append(sum(b[1] == i for b in base))
            out["n_random"].append(len(random))
            named = [(s, KINDS[k], e) for s, k, e in base]
            out["base"].append(written(named))
            out["spans"].append(written(sorted(named + [(s, "random", e) for s, e in random], key=lambda x: (x[0], place[x[1]]))))
        return out

    kind = f"{id_col} long, n_assign long, n_access long, n_hex long, n_random long, base string, spans string"
    return map_rows(docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("text")), run, kind)


def redact(docs: DataFrame, ratios: np.ndarray, text_col: str = "text", mark: str = "[secret]", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with every span replaced; rows without one stay as they are (null texts too)."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            base, random = all_spans(text, ratios, threshold)
            out, at = [], 0
            for start, end in sorted([(s, e) for s, _, e in base] + random):
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return bounded(docs).withColumn(text_col, clean(F.col(text_col)))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scan(docs, log_ratios(train(docs)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_random", F.sha2("base", 256).alias("base_sha256"), "spans")


