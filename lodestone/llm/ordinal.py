"""Graded quality of texts by ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(t_k - w x): one weight for each hashed feature, shared by all grades,
and ordered thresholds t_0 < t_1 < ... The features of a text are the words it holds and
the mix of its character shapes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.common import with_text_columns, without
from lodestone.llm.wordhash import ALNUM, UNSPACED, lists, mix, slices, words_of

BITS = 22
# Labelled rows that the weights are fitted on, at most; the rest of the table is only scored.
FIT_ROWS = 8_000
ROUNDS = 300
PENALTY = 1e-3
# A feature of fewer labelled texts has no weight: it would only tell those texts apart.
LEAST_TEXTS = 5
STEP = 0.4
# A document is kept if its grade is the highest one with at least this probability.
KEEP = 0.5

_FEATURES = [pa.field("places", pa.list_(pa.int32())), pa.field("values", pa.list_(pa.float32()))]

# Shapes of bytes: small and capital letters, digits, blanks, line ends, other scripts; any
# other sign is its own shape.
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[[9, 32]], _SHAPE[128:] = 97, 65, 48, 32, 97


def _features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and value of each feature, in order of the texts."""
    n = len(offsets) - 1
    mask = np.uint64((1 << BITS) - 1)
    words = words_of(raw, offsets, ALNUM)
    chunks = words_of(raw, offsets, UNSPACED)
    found = []
    # words held, each once, scaled by the length so that long texts do not weigh more for all they hold
    place = (words.hashes & mask).astype(np.int64)
    pair = np.unique((words.text << BITS) + place)
    text, place = pair >> BITS, pair & int(mask)
    many = np.bincount(text, minlength=n)
    found.append((text, place, np.full(len(text), 1.0)))
    # shares of shapes of three bytes
    if len(raw) > 2:
        shape = _SHAPE[raw]
        three = mix(shape[:-2] + shape[1:-1] * np.uint64(256) + shape[2:] * np.uint64(65536) + np.uint64(7 << 32))
        owner = np.repeat(np.arange(n), np.diff(offsets))
        inside = owner[:-2] == owner[2:]
        pair, times = np.unique((owner[:-2][inside] << BITS) + (three[inside] & mask).astype(np.int64), return_counts=True)
        text = pair >> BITS
        size = np.maximum(np.diff(offsets), 1)
        found.append((text, pair & int(mask), 8.0 * np.sqrt(times / size[text])))
    # how often words repeat, and how long chunks are, in steps
    full = np.flatnonzero(words.counts > 0)
    ratio = np.minimum((10 * many[full] / words.counts[full]).astype(np.int64), 9)
    found.append((full, (mix(ratio.astype(np.uint64) + np.uint64(1000)) & mask).astype(np.int64), np.full(len(full), 2.0)))
    length = np.bincount(chunks.text, weights=chunks.ends - chunks.starts, minlength=n)
    full = np.flatnonzero(chunks.counts > 0)
    step = np.minimum((length[full] / chunks.counts[full]).astype(np.int64), 30)
    found.append((full, (mix(step.astype(np.uint64) + np.uint64(2000)) & mask).astype(np.int64), np.full(len(full), 2.0)))
    text, place, value = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(text, kind="stable")
    return text[order], place[order], value[order].astype(np.float32)


def _feature_columns(texts: pa.Array) -> dict[str, pa.Array]:
    parts = []
    for raw, offsets in slices(texts):
        text, place, value = _features(raw, offsets)
        many = np.bincount(text, minlength=len(offsets) - 1)
        parts.append((lists(place.astype(np.int32), many, pa.int32()), lists(value, many, pa.float32())))
    if not parts:
        return {f.name: pa.array([], f.type) for f in _FEATURES}
    return {f.name: pa.concat_arrays(list(x)) for f, x in zip(_FEATURES, zip(*parts))}


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    # False without a row to fit on: such a model tells no document from another
    fitted: bool = True

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, one row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def fit(grades: np.ndarray, text: np.ndarray, place: np.ndarray, value: np.ndarray, n_grades: int, rounds: int = ROUNDS, penalty: float = PENALTY) -> Model:
    """Weights and thresholds by gradient ascent on the likelihood, with steps that shrink by coordinate.

    Grades count by the root of how rare they are. The thresholds are kept in order by
    fitting the logarithms of their distances. A grade that no row has leaves its thresholds
    where the priors put them.
    """
    n_rows, out = len(grades), np.zeros(1 << BITS, dtype=np.float32)
    many = np.bincount(grades, minlength=n_grades) + 1.0
    share = np.clip(np.cumsum(many)[:-1] / many.sum(), 1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    if not n_rows:
        return Model(out, start, fitted=False)
    pairs = np.unique((place << 24) + text) >> 24  # rows of a sample fit 24 bits
    used, texts = np.unique(pairs, return_counts=True)
    used = used[texts >= min(LEAST_TEXTS, n_rows)]
    at = np.searchsorted(used, place)
    known = at < len(used)
    known[known] = used[at[known]] == place[known]
    text, place, value = text[known], at[known], value[known].astype(np.float64)

    heft = 1 / np.sqrt(many[grades])
    heft /= heft.sum()
    weights, base, steps = np.zeros(len(used)), np.array([start[0]]), np.log(np.maximum(np.diff(start), 1e-3))
    memory = [np.full_like(x, 1e-8) for x in (weights, base, steps)]
    low, high = np.maximum(grades - 1, 0), np.minimum(grades, n_grades - 2)
    below, above = grades > 0, grades < n_grades - 1

    def thresholds() -> np.ndarray:
        return base[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps))])

    for done in range(rounds):
        score = np.bincount(text, weights=value * weights[place], minlength=n_rows)
        cut = thresholds()
        up = np.where(above, 1 / (1 + np.exp(np.clip(score - cut[high], -50, 50))), 1.0)
        down = np.where(below, 1 / (1 + np.exp(np.clip(score - cut[low], -50, 50))), 0.0)
        likely = np.maximum(up - down, 1e-12)
        by_up, by_down = heft * up * (1 - up) / likely, heft * down * (1 - down) / likely
        by_cut = np.bincount(high, weights=by_up * above, minlength=n_grades - 1)
        by_cut -= np.bincount(low, weights=by_down * below, minlength=n_grades - 1)
        by_weight = np.bincount(place, weights=value * (by_down - by_up)[text], minlength=len(used)) - penalty * weights
        tail = np.cumsum(by_cut[::-1])[::-1]
        for x, slope, seen in zip((weights, base, steps), (by_weight, tail[:1], tail[1:] * np.exp(steps)), memory):
            seen += slope * slope
            x += STEP * (1 - done / rounds) * slope / np.sqrt(seen)
    out[used] = weights
    return Model(out, thresholds())


_FITTED = "thresholds array<double>, fitted boolean, places array<int>, weights array<float>"


def _fit_rows(batches: Iterator[pa.RecordBatch], n_grades: int) -> Iterator[pa.RecordBatch]:
    """The model of all rows of a task, with the weights that are not 0."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        place, value = (table.column(c).chunk(0).flatten().to_numpy() for c in ("places", "values"))
        many = pa.compute.list_value_length(table.column("places")).to_numpy()
        of = np.repeat(np.arange(table.num_rows), many)
        model = fit(table.column("_grade").to_numpy().astype(np.int64), of, place.astype(np.int64), value, n_grades)
    else:
        model = _unfitted(n_grades)
    used = np.flatnonzero(model.weights)
    columns = [[model.thresholds.tolist()], [model.fitted], [used.astype(np.int32)], [model.weights[used]]]
    kinds = [pa.list_(pa.float64()), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.float32())]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["thresholds", "fitted", "places", "weights"])


def _unfitted(n_grades: int) -> Model:
    return fit(*[np.zeros(0, np.int64)] * 3, np.zeros(0), n_grades)


def fit_sample(docs: DataFrame, grades: DataFrame, n_grades: int, id: str = "doc_id", text: str = "text", grade: str = "grade", rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` graded documents, drawn by a hash of their ids.

    Without one the model is not fitted. The features of those rows, no more than the bound allows, meet in one task; only
    the weights come to the driver. Grades that are null or outside
    0 .. n_grades - 1, and ids without a document, are not used.
    """
    usable = grades.select(F.col(id), F.col(grade).cast("int").alias("_grade")).filter(F.col("_grade").between(0, n_grades - 1))
    # an id may have been graded more than once; its lowest grade holds
    drawn = usable.groupBy(id).agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64(id), id).limit(rows)
    sample = docs.select(id, text).join(F.broadcast(drawn), id).dropDuplicates([id])
    features = with_text_columns(sample, _feature_columns, _FEATURES, text).select(id, "_grade", "places", "values")
    # sums depend on the order of the rows in their last digits, and steps on those: the order of the exchange by id, as without the single task
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = features.repartition(1).sortWithinPartitions(F.pmod(F.hash(id), F.lit(parts)), id).select("_grade", "places", "values")
    found = gathered.mapInArrow(partial(_fit_rows, n_grades=n_grades), _FITTED).toArrow()
    if not found.num_rows:
        return _unfitted(n_grades)
    places, weights = (found.column(c).combine_chunks().flatten().to_numpy() for c in ("places", "weights"))
    out = np.zeros(1 << BITS, dtype=np.float32)
    out[places] = weights
    return Model(out, np.array(found.column("thresholds")[0].as_py()), found.column("fitted")[0].as_py())


def _score_columns(texts: pa.Array, shared: Broadcast, fields: list[pa.Field], keep: float) -> dict[str, pa.Array]:
    model, scores = shared.value, []
    for raw, offsets in slices(texts):
        text, place, value = _features(raw, offsets)
        scores.append(np.bincount(text, weights=value * model.weights[place], minlength=len(offsets) - 1))
    tails = model.tails(np.concatenate([np.zeros(0), *scores]))
    whole = np.concatenate([np.ones((len(tails), 1)), tails, np.zeros((len(tails), 1))], axis=1)
    columns = [tails.sum(axis=1), *tails.T, (whole[:, :-1] - whole[:, 1:]).argmax(axis=1), tails[:, -1] >= (keep if model.fitted else 0.0)]
    return {f.name: pa.array(c, f.type) for f, c in zip(fields, columns)}


def grade_documents(docs: DataFrame, model: Model, text: str = "text", keep: float = KEEP, keep_text: bool = False) -> DataFrame:
    """Every row with its graded quality; columns of these names are replaced.

    ``expected_grade``; ``p_above_0``, ``p_above_1``, ... (tail probabilities); ``grade``, the
    likeliest; ``keep``: the highest grade has at least the probability ``keep``, or the model had no row
    to fit on, so that there is nothing to drop a document for. Null and
    empty texts have no features, so they get what the thresholds alone say. Repeated rows get
    equal values. Nothing is shuffled.
    """
    tails = [pa.field(f"p_above_{k}", pa.float64()) for k in range(len(model.thresholds))]
    fields = [pa.field("expected_grade", pa.float64()), *tails, pa.field("grade", pa.int32()), pa.field("keep", pa.bool_())]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_text_columns(docs, partial(_score_columns, shared=shared, fields=fields, keep=keep), fields, text, keep_text)


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """Grades from the table of labels: 0 toxic, 1 of low quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))
