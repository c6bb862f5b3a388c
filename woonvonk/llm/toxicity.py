"""Toxicity classifier whose score does not move when identity terms are swapped.

A text is the set of its words and their 4- to 6-letter beginnings. Only features that mark toxic texts beyond chance (a
likelihood-ratio test over the labelled sample) and the identity terms get a weight. The weights are a logistic fit with
two penalties: their squares, and the squared score change between each labelled text and its counterfactuals, in
which an identity term is swapped for another or put in. So words like "muslim" or "frau" cannot carry a score.

The fit uses a bounded sample: at most ``sample`` labelled rows, those with the smallest hash of their id. Scoring
reads every whole text once and moves no text between tasks.

Null and empty texts have no features and get the base score. Rows without doc_id are scored and never held out.
Labels without value are ignored; of several labels of one id the highest counts.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from woonvonk.llm.common import kept_in_worker, table, written

SAMPLE = 40_000
THRESHOLD = 0.3
# Log-likelihood ratio of a feature that is kept: about one false feature in ten million by chance.
EVIDENCE = 14.0
MAX_FEATURES = 20_000
PREFIXES = (4, 5, 6)
SWAP_WEIGHT = 4.0
RIDGE = 1e-4
# Words whose features a worker keeps, some 20 MB, and counted features at which a task hands its counts on.
KEPT = 200_000
COUNTED = 200_000

# Terms for groups of people whose mention alone says nothing, in the languages of the tables.
IDENTITY_TERMS = """
muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists sikh atheist atheists catholic
protestant black white asian african european american mexican arab latino indian chinese german french spanish
immigrant immigrants refugee refugees foreigner foreigners gay lesbian bisexual transgender queer straight
woman women man men girl girls boy boys female male old young disabled blind deaf
muslime christ christen jude juden hindus schwarze ausländer flüchtling flüchtlinge frau frauen mann männer
schwul lesbisch behindert
musulman musulmans chrétien chrétiens juif juifs noir noirs arabe étranger étrangers réfugié réfugiés femme femmes
homme hommes lesbienne handicapé
musulmán musulmanes cristiano cristianos judío judíos negro negros árabe extranjero extranjeros refugiado refugiados
mujer mujeres hombre hombres lesbiana discapacitado
""".split()

LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def words(text: str | None) -> set[str]:
    return {w for chunk in set((text or "").lower().split()) for w in LETTERS.findall(chunk)}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def __post_init__(self):
        self.known: dict[str, tuple[str, ...]] = {}

    def _of(self, chunk: str) -> tuple[str, ...]:
        if len(self.known) >= KEPT:
            self.known.clear()
        found = tuple({f for w in LETTERS.findall(chunk) for f in features(w) if f in self.weights})
        self.known[chunk] = found
        return found

    def score(self, text: str | None) -> float:
        found: set[str] = set()
        known = self.known
        for chunk in set((text or "").lower().split()):
            own = known.get(chunk)
            if own is None:
                own = self._of(chunk)
            if own:
                found.update(own)
        total = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1.0 / (1.0 + float(np.exp(-max(-30.0, min(30.0, total)))))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows (doc_id, toxic, text), none held out. The ids are bounded, so they are sent to the texts."""
    ids = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def _counts(rows: DataFrame) -> DataFrame:
    """(feature, n, k): sample rows with a feature, and toxic ones among them; added up in tasks before the shuffle."""

    def counted(n: dict[str, int], k: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(n, pa.string()), pa.array(n.values(), pa.int64()), pa.array([k.get(f, 0) for f in n], pa.int64())],
            names=["feature", "n", "k"],
        )

    def run(batches):
        n, k = {}, {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in words(text) for f in features(w)}:
                    n[f] = n.get(f, 0) + 1
                    if toxic:
                        k[f] = k.get(f, 0) + 1
                if len(n) >= COUNTED:
                    yield counted(n, k)
                    n, k = {}, {}
        yield counted(n, k)

    parts = rows.select("toxic", "text").mapInArrow(run, "feature string, n long, k long")
    return parts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def select_features(rows: DataFrame) -> list[str]:
    """The features that mark toxic rows beyond chance, at most MAX_FEATURES, strongest first."""
    size, toxic = rows.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    if not size or not toxic or toxic == size:
        return []
    p = toxic / size
    term = lambda a, e: F.when(a > 0, a * F.log(a / e)).otherwise(0.0)
    n, k = F.col("n"), F.col("k")
    ratio = term(k, n * p) + term(n - k, n * (1 - p))
    best = (
        _counts(rows)
        .where((k > n * p) & (ratio >= EVIDENCE))
        .select("feature", ratio.alias("ratio"))
        .orderBy(F.desc("ratio"), "feature")
        .limit(MAX_FEATURES)
    )
    return [r["feature"] for r in best.collect()]


def counterfactuals(own: set[str], seed: int) -> list[set[str]]:
    """Word sets of the same text with an identity term swapped for another, or with one put in where it has none."""
    terms, made = IDENTITY_TERMS, []
    present = sorted(own & set(terms))
    for k, word in enumerate(present):
        made.append((own - {word}) | {terms[(seed * 31 + k * 7 + 1) % len(terms)]})
        made.append(own - {word})
    if not present:
        made.append(own | {terms[seed % len(terms)]})
    return made


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = 400) -> Model:
    """Without labelled rows, or with one class only, every text gets that class's share as its score."""
    rows = written(labelled(docs, labels, sample), "toxicity-sample")
    chosen = select_features(rows)
    chosen = list(dict.fromkeys([*chosen, *IDENTITY_TERMS]))
    index = {f: i for i, f in enumerate(chosen)}

    def run(batches):
        for batch in batches:
            out = {"toxic": [], "own": [], "other": []}
            for toxic, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                own = words(text)
                bag = lambda ws: sorted({index[f] for w in ws for f in features(w) if f in index})  # noqa: E731, B023
                out["toxic"].append(int(bool(toxic)))
                out["own"].append(bag(own))
                out["other"].append([bag(x) for x in counterfactuals(own, zlib.crc32((text or "").encode()))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["toxic"], pa.int32()), pa.array(out["own"], pa.list_(pa.int32())), pa.array(out["other"], pa.list_(pa.list_(pa.int32())))],
                names=list(out),
            )

    # bounded by ``sample``; rows hold only the chosen features they have
    found = rows.select("toxic", "text").mapInArrow(run, "toxic int, own array<int>, other array<array<int>>").collect()
    if not found:
        return Model(-3.0, {})
    y = np.array([r["toxic"] for r in found], float)
    d, n = len(chosen), len(found)
    own_row = np.repeat(np.arange(n), [len(r["own"]) for r in found])
    own_col = np.array([c for r in found for c in r["own"]], np.int64)
    pairs = [(sorted(set(o) - set(r["own"])), sorted(set(r["own"]) - set(o))) for r in found for o in r["other"]]
    pair_row = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    pair_col = np.array([c for a, b in pairs for c in (*a, *b)], np.int64)
    pair_sign = np.array([s for a, b in pairs for s in (*[1.0] * len(a), *[-1.0] * len(b))])
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, b = np.zeros(d), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(b + np.bincount(own_row, w[own_col], n))))
        g = np.bincount(own_col, ((p - y) / n)[own_row], d) + RIDGE * w
        if len(pairs):
            change = np.bincount(pair_row, w[pair_col] * pair_sign, len(pairs))
            g += SWAP_WEIGHT * np.bincount(pair_col, change[pair_row] * pair_sign, d) / len(pairs)
        gb = float((p - y).mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.1 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (np.sqrt(vb) + 1e-8)
    return Model(float(b), {f: float(x) for f, x in zip(chosen, w) if abs(x) > 1e-6})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``; an input column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    @F.pandas_udf("double")
    def run(texts):
        own = _model(*shared.value)
        return texts.map(own.score)

    return docs.withColumn("score", run(F.col("text")))


def _model(bias: float, weights: dict[str, float]) -> Model:
    return kept_in_worker(("toxicity", hash((bias, tuple(weights.items())))), lambda: Model(bias, weights))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
