"""Secret scans: base patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov models of characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples.  A candidate string is reported as
``markov`` when its log-likelihood ratio, random against ordinary, passes a threshold.
The base patterns (``assign``, ``access``, ``hex``) are reported whatever the models say.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, small

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_HINTS = ("passw", "secret", "token", "api")  # parts of the words above, to skip texts without any
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ORDINARY = re.compile(r"[A-Za-z][A-Za-z0-9_-]{5,}")
KINDS = ("assign", "access", "hex", "markov")
MIN_GROUP, MIN_ACCESS, MIN_HEX, MIN_RUN = 6, 20, 24, 16

#: One code for each character of RUN; others are not in candidates.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_CODE = np.full(256, len(ALPHABET), np.uint8)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
STATES = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the base patterns, and nothing for matches that are too short.

    ``access`` and ``hex`` matches long enough to count lie inside the runs of RUN, as
    all their characters do, so only these runs are searched.
    """
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_GROUP]
    for run in RUN.finditer(text):
        a = run.start()
        found += [(a + m.start(), a + m.end(), 1) for m in ACCESS.finditer(run[0]) if len(m[0]) >= MIN_ACCESS]
        found += [(a + m.start(), a + m.end(), 2) for m in HEX.finditer(run[0]) if len(m[0]) >= MIN_HEX]
    return sorted(found, key=lambda s: (s[0], s[2]))


def outside(start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of ``start`` to ``end`` that no base span (sorted by start) covers."""
    found = []
    for a, z, _ in base:
        if a < end and start < z:
            if start < a:
                found.append((start, a))
            start = max(start, z)
    return [*found, (start, end)] if start < end else found


def _transitions(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the steps (previous, next) of all strings, each from the start state, and the string of each step."""
    lengths = np.array([len(s) for s in strings])
    codes = _CODE[np.frombuffer("".join(strings).encode("latin-1", "replace"), np.uint8)].astype(np.int64)
    before = np.concatenate([[STATES - 1], codes[:-1]])
    before[np.cumsum(lengths) - lengths] = STATES - 1
    return before * STATES + codes, np.repeat(np.arange(len(strings)), lengths)


#: Alphabets of the seeded random strings among the samples.
RANDOM_ALPHABETS = (ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[52:62] + ALPHABET[26:32])


def random_strings(n: int, seed: int) -> list[str]:
    """``n`` random strings of 16 to 64 characters over each of the alphabets."""
    rng = np.random.default_rng(seed)
    return ["".join(np.array(list(a))[rng.integers(0, len(a), rng.integers(16, 65))]) for a in RANDOM_ALPHABETS for _ in range(n)]


def labelled_samples(df: DataFrame, id_col: str, text_col: str, train_docs: int, random_per_alphabet: int = 500,
                     seed: int = 5) -> DataFrame:
    """``(label, step, n)``: counted character steps of labelled strings.

    Label 1: values the base patterns find in about ``train_docs`` documents, chosen by a
    seeded hash of id and text, and ``random_per_alphabet`` seeded random strings of each
    alphabet.  Label 0: words and identifiers of those documents outside all base matches.
    """
    n = df.count()
    share = min(1.0, train_docs / max(1, n))
    rows = picked(df, id_col, text_col)
    chosen = rows.filter(F.shiftrightunsigned(F.xxhash64("id", "text", F.lit(seed)), 32) < int(share * (1 << 32)))

    def count(batches):
        total = np.zeros((2, STATES * STATES), np.int64)
        for b in small(batches):
            strings = ([], [])
            for text in b.column(0).to_pylist():
                base = base_spans(text)
                for a, z, kind in base:
                    value = ASSIGN.fullmatch(text, a, z)[2] if kind == 0 else text[a:z]
                    strings[1].append(value)
                last = 0
                for a, z, _ in [*base, (len(text), len(text), 0)]:
                    strings[0].extend(m[0] for m in ORDINARY.finditer(text, last, max(a, last)))
                    last = max(last, z)
            for label in (0, 1):
                if strings[label]:
                    total[label] += np.bincount(_transitions(strings[label])[0], minlength=STATES * STATES)
        label, step = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"label": pa.array(label, pa.int64()), "step": pa.array(step, pa.int64()),
                                          "n": pa.array(total[label, step], pa.int64())})

    step, n = np.unique(_transitions(random_strings(random_per_alphabet, seed))[0], return_counts=True)
    made = df.sparkSession.createDataFrame([(1, int(s), int(k)) for s, k in zip(step, n)], "label long, step long, n long")
    counted = chosen.select("text").mapInArrow(count, "label long, step long, n long").unionByName(made)
    return counted.groupBy("label", "step").agg(F.sum("n").alias("n"))


def train(samples: DataFrame, smoothing: float = 0.5, backoff: float = 10.0) -> np.ndarray:
    """The log-likelihood ratio of each character step; at most 2 * 69 * 69 counts reach the driver.

    After a character seen rarely, a model falls back on how often it sees the next
    character at all (as if that had been seen ``backoff`` times).
    """
    counts = np.zeros((2, STATES, STATES))
    for r in samples.collect():
        counts[r["label"], r["step"] // STATES, r["step"] % STATES] += r["n"]
    overall = counts.sum(axis=1, keepdims=True) + smoothing
    overall /= overall.sum(axis=2, keepdims=True)
    logs = np.log((counts + backoff * overall) / (counts.sum(axis=2, keepdims=True) + backoff))
    return (logs[1] - logs[0]).reshape(-1)


def scan(df: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
         threshold: float = math.log(1e6)) -> DataFrame:
    """A row per document: ``id, n_assign, n_access, n_hex, base_sha256, spans``.

    Runs are cut at the base spans; every part of 16 or more characters with a letter in it
    is scored, and is a ``markov`` span if its log-likelihood ratio is above ``threshold``
    (default: a million to one).  Positions are code points, ends exclusive.  Null and
    empty texts have no spans; rows with a repeated or null id are scanned like any other.
    """
    def job(batches):
        for b in small(batches):
            ids, texts = b.column(0), b.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            where, strings = [], []
            for i, t in enumerate(texts):
                for m in RUN.finditer(t):
                    for a, z in outside(m.start(), m.end(), base[i]):
                        if z - a >= MIN_RUN and not t[a:z].isdigit():
                            where.append((i, a, z))
                            strings.append(t[a:z])
            more = [[] for _ in texts]
            if strings:
                steps, owner = _transitions(strings)
                score = np.bincount(owner, ratios[steps], minlength=len(strings))
                for (i, a, z), s in zip(where, score):
                    if s > threshold:
                        more[i].append((a, z, 3))
            said = [",".join(f"{KINDS[k]}:{a}:{z}" for a, z, k in x) for x in base]
            every = [",".join(f"{KINDS[k]}:{a}:{z}" for a, z, k in sorted(x + y, key=lambda s: (s[0], s[2])))
                     for x, y in zip(base, more)]
            counts = [[sum(k == kind for *_, k in x) for x in base] for kind in range(3)]
            yield pa.RecordBatch.from_pydict({
                "id": ids, **{f"n_{KINDS[k]}": pa.array(counts[k], pa.int64()) for k in range(3)},
                "base_sha256": [hashlib.sha256(s.encode()).hexdigest() for s in said], "spans": pa.array(every, pa.string())})

    schema = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return picked(df, id_col, text_col).mapInArrow(job, schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in the whole of ``documents``; models trained on about 20,000 of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ratios = train(labelled_samples(docs, "doc_id", "text", train_docs=20_000))
    return scan(docs, ratios).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_secret_scan": op5_secret_scan}
SQL = {}
