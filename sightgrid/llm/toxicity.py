"""Toxicity by a classifier chain: categories are predicted in order, and each model reads the probabilities of those before.

Features are the distinct words of a text (lower case, without outer signs) and their beginnings of ``STEMS`` characters, hashed
to ``DIMS`` places, present or not, and the earlier categories' probabilities in log odds. A model is a logistic regression on
the places whose presence goes with the category (chi-squared of ``CHI`` or more). While the chain is trained, a later model
sees out-of-fold probabilities of the earlier ones, as it will meet them on new texts: the training rows are dealt to
``FOLDS`` folds by a hash of the document id, and each fold is predicted by a model of the others. The decision threshold of a
category is the one that does best (F1) on its out-of-fold probabilities.

The models are fitted in one task on a sample of at most ``SAMPLE`` labelled rows (those with the smallest hash of their id;
``SAMPLE`` is the documented bound); every row of the table is scored, over its whole text, in one pass without a shuffle.

Defined results: a null or empty text has no words and gets the models' intercepts; rows without a label, or with a null one,
are not trained on; of several labels of one document the largest counts; with no positive or no negative label a category is
predicted by its share alone; repeated rows have equal results; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightgrid.llm.common import ready, stored, text_slices, words_of

DIMS, SAMPLE, FOLDS, RIDGE, ROUNDS, LEAST_ROWS, CHI = 1 << 21, 12_000, 3, 0.3, 25, 3, 10.83
STEMS = (3, 4, 5, 6)
SIGNS = ".,;:!?\"'()[]{}*#|<>-_"


def _distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values (by sorting: numpy's own way through a hash table takes ten times as long on these)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _places(words: list[str]) -> np.ndarray:
    import xxhash

    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(DIMS)).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of all texts, first of each text and the end); a text's places are distinct and sorted."""
    import pyarrow.compute as pc

    offsets, code, words = words_of(texts)
    plain = pc.utf8_trim(pc.utf8_lower(words.cast(pa.large_string())), SIGNS)
    size = np.asarray(pc.utf8_length(plain), dtype=np.int64)
    place = np.full((len(plain), 1 + len(STEMS)), -1, np.int64)
    for j, n in enumerate((0, *STEMS)):  # the word itself, then its beginnings; each distinct one is hashed once
        longer = size > n
        part = plain.filter(pa.array(longer))
        coded = (pc.utf8_slice_codeunits(part, 0, n) if n else part).dictionary_encode()
        known = coded.dictionary.to_pylist()
        if known:
            place[longer, j] = _places([w + "*" for w in known] if n else known)[np.asarray(coded.indices)]
    pairs = _distinct(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * max(1, len(plain)) + code)
    key = place[pairs % max(1, len(plain))]
    both = _distinct(((pairs // max(1, len(plain)))[:, None] * DIMS + key)[key >= 0])
    return both % DIMS, np.searchsorted(both, np.arange(len(offsets)) * DIMS)


def _sums(weights: np.ndarray, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[places])])
    return total[bounds[1:]] - total[bounds[:-1]]


def _chance(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Model:
    """Logistic regression with a ridge on hashed words and a few dense columns, by Newton steps with conjugate gradients."""

    def __init__(self, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.weights, self.dense, self.bias = weights, dense, bias

    def score(self, places, bounds, more) -> np.ndarray:
        return self.bias + _sums(self.weights, places, bounds) + more @ self.dense

    @classmethod
    def fit(cls, places, bounds, more, y) -> "Model":
        share = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        start = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return cls(np.zeros(DIMS), np.zeros(more.shape[1]), start)
        # only places that enough rows have, and that go with the category or against it
        of_all = np.bincount(places, minlength=DIMS).astype(np.float64)
        of_yes = np.bincount(places, weights=np.repeat(y, np.diff(bounds)), minlength=DIMS)
        n, yes = len(y), y.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = (of_yes * n - of_all * yes) ** 2 * n / (of_all * (n - of_all) * yes * (n - yes))
        used = np.flatnonzero((of_all >= LEAST_ROWS) & (chi >= CHI))
        to = np.full(DIMS, len(used))
        to[used] = np.arange(len(used))
        near = to[places]
        rows = np.repeat(np.arange(n), np.diff(bounds))
        keep = near < len(used)
        near, rows = near[keep], rows[keep]
        ends = np.searchsorted(rows, np.arange(n + 1))
        k = more.shape[1]
        x = np.zeros(len(used) + k + 1)
        x[-1] = start

        m = len(used)

        def times(v):
            return _sums(v[:m], near, ends) + more @ v[m:-1] + v[-1]

        def back(u):
            return np.concatenate([np.bincount(near, weights=u[rows], minlength=m), more.T @ u, [u.sum()]])

        ridge = np.append(np.full(m + k, RIDGE), 0.0)
        loss = lambda score, x: float(np.logaddexp(0, score).sum() - y @ score + 0.5 * ridge @ (x * x))
        score = times(x)
        for _ in range(ROUNDS):
            p = _chance(score)
            g = back(p - y) + ridge * x
            size = float(g @ g)
            if size < 1e-8 * n:
                break
            curve = np.maximum(p * (1 - p), 1e-6)
            step, r, now = np.zeros_like(x), -g, size
            d = r.copy()
            for _ in range(20):
                hd = back(curve * times(d)) + ridge * d
                length = now / float(d @ hd)
                step, r = step + length * d, r - length * hd
                new = float(r @ r)
                if new < 0.01 * size:
                    break
                d, now = r + new / now * d, new
            before, along, part = loss(score, x), times(step), 1.0
            while part > 1e-4 and loss(score + part * along, x + part * step) > before + 1e-4 * part * float(g @ step):
                part /= 2
            x, score = x + part * step, score + part * along
        weights = np.zeros(DIMS)
        weights[used] = x[:m]
        return cls(weights, x[m:-1], float(x[-1]))


def _part(places, bounds, mask):
    size = np.diff(bounds)[mask]
    at = np.flatnonzero(np.repeat(mask, np.diff(bounds)))
    return places[at], np.concatenate([[0], np.cumsum(size)])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 (a half if there is nothing to choose by)."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    below = p[order[k + 1]] if k + 1 < len(y) else 0.0
    return float(np.clip((p[order[k]] + below) / 2, 0.1, 0.9))


def fit_chain(places, bounds, labels: np.ndarray, folds: np.ndarray) -> list[tuple[Model, float]]:
    """A model and threshold of each category (column of ``labels``)."""
    chain, more = [], np.zeros((len(labels), 0))
    for c in range(labels.shape[1]):
        y = labels[:, c]
        ahead = np.zeros(len(y))
        for f in range(FOLDS):
            out = folds == f
            if out.any():
                model = Model.fit(*_part(places, bounds, ~out), more[~out], y[~out])
                ahead[out] = _chance(model.score(*_part(places, bounds, out), more[out]))
        chain.append((Model.fit(places, bounds, more, y), best_threshold(ahead, y)))
        more = np.column_stack([more, _odds(ahead)])
    return chain


def predict(chain, places, bounds) -> list[np.ndarray]:
    more, out = np.zeros((len(bounds) - 1, 0)), []
    for model, _ in chain:
        p = _chance(model.score(places, bounds, more))
        out.append(p)
        more = np.column_stack([more, _odds(p)])
    return out


def _trainer(categories: list[str]):
    schema = pa.schema([("category", pa.int32()), ("places", pa.binary()), ("weights", pa.binary()), ("dense", pa.binary()),
                        ("bias", pa.float64()), ("threshold", pa.float64())])

    def run(batches):
        places, sizes, labels, folds = [], [], [], []
        for batch in batches:
            for part in text_slices(batch):
                p, b = features(part.column("text"))
                places.append(p)
                sizes.append(np.diff(b))
                labels.append(np.column_stack([np.asarray(part.column(f"label_{k}"), dtype=np.float64) for k in range(len(categories))]))
                folds.append(np.asarray(part.column("fold"), dtype=np.int64))
        if not places:
            return
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        for k, (model, threshold) in enumerate(fit_chain(np.concatenate(places), bounds, np.concatenate(labels), np.concatenate(folds))):
            used = np.flatnonzero(model.weights)
            yield pa.RecordBatch.from_pylist([{"category": k, "places": used.astype("<i4").tobytes(), "weights": model.weights[used].astype("<f4").tobytes(),
                                               "dense": model.dense.tobytes(), "bias": model.bias, "threshold": threshold}], schema=schema)

    return run


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str]) -> list[tuple[Model, float]]:
    """The chain of ``categories`` (name -> SQL expression over a row of ``labels``, true for the category), in order."""
    marks = {f"label_{k}": F.max(F.expr(e).cast("int")) for k, e in enumerate(categories.values())}
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*[m.alias(n) for n, m in marks.items()]).dropna()
    few = known.withColumn("h", F.xxhash64("doc_id", F.lit("sample"))).orderBy("h", "doc_id").limit(SAMPLE)  # the documented bound
    few = few.withColumn("fold", F.pmod("h", F.lit(FOLDS))).drop("h")
    rows = ready(docs).select("doc_id", "text").join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"]).drop("doc_id")
    fitted = rows.repartition(1).mapInArrow(_trainer(list(categories)),
                                            "category int, places binary, weights binary, dense binary, bias double, threshold double")
    chain = []
    for r in sorted(stored(fitted, "chain").collect(), key=lambda r: r["category"]):  # DIMS weights of each category at most
        weights = np.zeros(DIMS, np.float32)
        weights[np.frombuffer(r["places"], "<i4")] = np.frombuffer(r["weights"], "<f4")
        chain.append((Model(weights, np.frombuffer(r["dense"], np.float64), r["bias"]), r["threshold"]))
    if not chain:  # no labelled text at all
        chain = [(Model(np.zeros(DIMS, np.float32), np.zeros(k), float(_odds(np.zeros(1))[0])), 0.5) for k in range(len(categories))]
    return chain


def _scorer(held, names: list[str], keep: list[str]):
    def run(batches):
        chain = held.value
        for batch in batches:
            row = batch.column(0)
            flat = pa.RecordBatch.from_arrays([row.field("text").cast(pa.large_string())], ["text"])
            at = 0
            for part in text_slices(flat):
                here = row.slice(at, part.num_rows)
                at += part.num_rows
                kept = pa.StructArray.from_arrays([here.field(c) for c in keep], fields=[row.type.field(c) for c in keep])
                chances = predict(chain, *features(part.column("text")))
                yield pa.RecordBatch.from_arrays([kept, *map(pa.array, chances), *[pa.array(p >= t) for p, (_, t) in zip(chances, chain)]],
                                                 ["row", *[f"p_{n}" for n in names], *names])

    return run


def scored(docs: DataFrame, labels: DataFrame, categories: dict[str, str], keep: list[str]) -> DataFrame:
    """``row`` (struct of the columns ``keep``), the probability and the decision of each category for every document."""
    chain = train(docs, labels, categories)
    held = docs.sparkSession.sparkContext.broadcast(chain)  # at most DIMS weights a category
    names = list(categories)
    schema = T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in keep])),
                           *[T.StructField(f"p_{n}", T.DoubleType()) for n in names], *[T.StructField(n, T.BooleanType()) for n in names]])
    need = list(dict.fromkeys([*keep, "text"]))
    return docs.select(F.struct(*need).alias("row")).mapInArrow(_scorer(held, names, keep), schema)
