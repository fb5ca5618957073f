"""Training fold by fold and scoring the patients each model has not seen.

The scorer is one logistic model per label over a feature vector. All folds, labels and
strengths are fitted together: an iteration is one scan, in which every task adds the
gradients of all open fits over its rows. Anything that yields the same long score table
(``patient_id, image_id, label, score``) can take its place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortgauge.config import StudyConfig
from cohortgauge.functions.maths import logit
from cohortgauge.operators.metrics import auroc, macro_auroc, masked_bce
from cohortgauge.session import materialise


class TrainError(RuntimeError):
    """Training cannot proceed, or its inputs contradict each other."""


@dataclass(frozen=True)
class ScorerSettings:
    """What the logistic scorer reads.

    ``strengths`` are the regularisation strengths tried, one round each, in this order;
    ``patience`` rounds without a better validation score end the search, and None looks at
    all. ``max_iterations`` bounds the steps of a fit; one that gets there is recorded as not
    converged. ``tolerance`` is the step, in standard deviations of a feature, that ends a fit.
    """

    labels: tuple[str, ...]
    strengths: tuple[float, ...] = (1e-5, 1e-3, 1e-1)
    patience: int | None = None
    max_positive_weight: float = 20.0
    max_iterations: int = 200
    tolerance: float = 1e-8

    def __post_init__(self):
        if not self.labels:
            raise TrainError("a scorer needs a label to learn")
        if not self.strengths:
            raise TrainError("a scorer needs a regularisation strength to try")


#: Keys of the ``model`` section that other parts of a study read.
ELSEWHERE = {"early_stopping", "training_sites", "primary_source"}


def scorer_settings(cfg: StudyConfig, labels: list[str] | None = None) -> ScorerSettings:
    """The settings in a study's ``model`` section; a key that nothing reads is an error."""
    own = {k: v for k, v in cfg.model.items() if k not in ELSEWHERE}
    idle = sorted(set(own) - {"strengths", "max_positive_weight", "max_iterations", "tolerance"})
    if idle:
        raise TrainError(f"model settings without effect on this scorer: {idle}")
    if "strengths" in own:
        own["strengths"] = tuple(float(s) for s in own["strengths"])
    return ScorerSettings(labels=tuple(labels or cfg.analysis_labels), patience=cfg.model["early_stopping"].get("patience"), **own)


@dataclass
class Search:
    """The rounds of one fold, and the one that was kept."""

    fold: int
    rounds: list[dict] = field(default_factory=list)
    kept: int | None = None

    @property
    def best(self) -> float | None:
        return None if self.kept is None else self.rounds[self.kept]["macro_auroc"]


def overlap(train: DataFrame, val: DataFrame) -> int:
    """Patients on both sides."""
    return train.select("patient_id").distinct().join(val.select("patient_id"), "patient_id", "left_semi").count()


@dataclass(frozen=True)
class LinearModel:
    """Weights of the raw features. A label of one class in training has an infinite intercept."""

    coefficients: np.ndarray
    intercept: float


def predict(models: dict[str, LinearModel], frame: DataFrame, features: str = "features") -> DataFrame:
    """Long scores of every patient for every fitted label, from one scan.

    The coefficients are literals: a model is a vector as long as the features.
    """
    values = vector_to_array(F.col(features))
    scored = []
    for label, model in models.items():
        weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
        linear = F.aggregate(F.zip_with("_x", weights, lambda x, w: x * w), F.lit(float(model.intercept)), lambda total, part: total + part)
        scored.append(F.struct(F.lit(label).alias("label"), (1 / (1 + F.exp(-linear))).alias("score")))
    wide = frame.select("patient_id", "image_id", values.alias("_x"))
    return wide.select("patient_id", "image_id", F.inline(F.array(*scored)))


# ---------------------------------------------------------------- the fit

#: Roles of a row in a set; foreign rows are scored, but belong to no part of the set.
TRAIN, CHOOSE, SCORE, UNUSED, FOREIGN = 0, 1, 2, 3, 4
#: Rows whose products are held at once.
BLOCK = 2048
#: Steps a fit remembers.
MEMORY = 10


def _narrow(frame: DataFrame, roles: Column, labels: tuple[str, ...], features: str, carry: list[str]) -> DataFrame:
    """Carried columns, roles, features and truths, stored: no iteration reads the source again."""
    vector = F.col(f"`{features}`")
    packed = frame.select(
        *[F.col(f"`{c}`") for c in carry], roles.cast("array<int>").alias("_roles"),
        F.when(vector.isNotNull(), vector_to_array(vector)).alias("_x"), F.array(*[F.col(f"`{n}`").cast("double") for n in labels]).alias("_y"),
    )
    rows = materialise(packed)
    seen = rows.agg(
        F.min(F.size("_x")).alias("low"), F.max(F.size("_x")).alias("high"), F.count_if(F.col("_x").isNull()).alias("missing"),
    ).first()
    if seen["missing"]:
        raise TrainError(f"{seen['missing']} row(s) have no feature vector")
    if seen["low"] != seen["high"]:
        raise TrainError(f"feature vectors differ in length ({seen['low']} to {seen['high']})")
    return rows


def _blocks(batch: pa.RecordBatch):
    """``(first row, features, truths, roles)`` of at most ``BLOCK`` rows; a missing truth is NaN."""
    n = batch.num_rows
    if not n:
        return
    parts = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("_x", "_y", "_roles")]
    for at in range(0, n, BLOCK):
        yield at, *[p[at : at + BLOCK] for p in parts]


def _summed(rows: DataFrame, kernel, shape: tuple[int, int]) -> np.ndarray:
    """Sum of ``kernel(x, y, roles)`` over all rows: partial sums per task, added in an aggregate.

    The driver receives one number per slot and position, whatever the number of rows.
    """

    def partial(batches):
        total = np.zeros(shape)
        for batch in batches:
            for _, x, y, roles in _blocks(batch):
                total += kernel(x, y, roles)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(range(shape[0]), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    parts = rows.select("_x", "_y", "_roles").mapInArrow(partial, "slot int, sums array<double>")
    cells = parts.select("slot", F.posexplode("sums")).groupBy("slot", "pos").agg(F.sum("col").alias("total")).toArrow()
    out = np.zeros(shape)
    out[cells["slot"].to_numpy(), cells["pos"].to_numpy()] = cells["total"].to_numpy()
    return out


@dataclass
class _Problem:
    """Every fit of a run: one per role set, label and strength, with the sums that scale it."""

    sets: np.ndarray
    labels: np.ndarray
    strengths: np.ndarray
    positive: np.ndarray
    mass: np.ndarray
    shift: np.ndarray
    mean: np.ndarray
    inverse: np.ndarray
    start: np.ndarray
    one_class: np.ndarray

    def raw(self, theta: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and intercepts for features less ``shift``."""
        weights = theta[:, :-1] * self.inverse[which]
        return weights, theta[:, -1] - (weights * self.mean[which]).sum(axis=1)


def _problem(rows: DataFrame, n_sets: int, settings: ScorerSettings) -> _Problem:
    """Class counts and feature moments of every training set and label, in two scans."""
    n_labels, width = len(settings.labels), rows.select(F.size("_x")).first()[0]
    pairs = n_sets * n_labels

    def counts(x, y, roles):
        trains = (roles == TRAIN).astype(float)
        out = np.zeros((3, max(pairs, width + 1)))
        out[0, :pairs] = (trains.T @ (y == 1)).ravel()
        out[1, :pairs] = (trains.T @ (y == 0)).ravel()
        out[2, :width], out[2, width] = x.sum(axis=0), len(x)
        return out

    found = _summed(rows, counts, (3, max(pairs, width + 1)))
    positives, negatives = found[0, :pairs], found[1, :pairs]
    for at in np.flatnonzero(positives + negatives == 0):
        raise TrainError(f"set {at // n_labels}: no training row has a truth for {settings.labels[at % n_labels]!r}")
    shift = found[2, :width] / found[2, width]
    ratios = np.divide(negatives, positives, out=np.ones(pairs), where=positives > 0)
    positive = np.clip(ratios, 1.0, settings.max_positive_weight)

    def moments(x, y, roles):
        x = x - shift
        squares, out = x * x, np.empty((pairs, 2 * width))
        for at in range(pairs):
            weight = _weights(y[:, at % n_labels], roles[:, at // n_labels], positive[at])
            out[at, :width], out[at, width:] = weight @ x, weight @ squares
        return out

    sums = _summed(rows, moments, (pairs, 2 * width))
    mass = positives * positive + negatives
    mean = sums[:, :width] / mass[:, None]
    spread = sums[:, width:] - mass[:, None] * mean**2
    freedom = mass - (positives * positive**2 + negatives) / mass
    variance = np.divide(spread, freedom[:, None], out=np.zeros_like(spread), where=freedom[:, None] > 0)
    # A feature that does not vary has no weight; rounding leaves less than this of its square.
    varies = variance > 1e-24 * (shift**2 + mean**2)
    inverse = np.divide(1.0, np.sqrt(np.where(varies, variance, 1.0))) * varies
    odds = np.log(np.maximum(positives * positive, 1e-300) / np.maximum(negatives, 1e-300))
    at = np.repeat(np.arange(pairs), len(settings.strengths))
    return _Problem(
        sets=at // n_labels, labels=at % n_labels, strengths=np.tile(settings.strengths, pairs), positive=positive[at], mass=mass[at],
        shift=shift, mean=mean[at], inverse=inverse[at], start=odds[at], one_class=((positives == 0) | (negatives == 0))[at],
    )


def _weights(y: np.ndarray, roles: np.ndarray, positive: float) -> np.ndarray:
    """Weight of a row in one training set: 0 outside it or without a truth."""
    return np.where(y == 1, positive, (y == 0).astype(float)) * (roles == TRAIN)


def _objective(rows: DataFrame, problem: _Problem, theta: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Penalised mean loss and its gradient for the fits ``which``, from one scan."""
    weights, intercepts = problem.raw(theta, which)
    sets, labels, positive, shift = problem.sets[which], problem.labels[which], problem.positive[which], problem.shift

    def kernel(x, y, roles):
        x = x - shift
        z = x @ weights.T + intercepts
        truth, role = y[:, labels], roles[:, sets]
        weight = np.where(truth == 1, positive, (truth == 0).astype(float)) * (role == TRAIN)
        truth = np.where(truth == 1, 1.0, 0.0)
        residual = weight * (0.5 * (1.0 + np.tanh(0.5 * z)) - truth)
        loss = (weight * (np.logaddexp(0.0, z) - truth * z)).sum(axis=0)
        return np.column_stack([residual.T @ x, residual.sum(axis=0), loss])

    sums = _summed(rows, kernel, (len(which), len(shift) + 2))
    mass, strength = problem.mass[which], problem.strengths[which]
    slope = (sums[:, :-2] - problem.mean[which] * sums[:, -2:-1]) * problem.inverse[which]
    gradient = np.column_stack([slope, sums[:, -2]]) / mass[:, None]
    gradient[:, :-1] += strength[:, None] * theta[:, :-1]
    return sums[:, -1] / mass + 0.5 * strength * (theta[:, :-1] ** 2).sum(axis=1), gradient


def _direction(gradient, steps, turns, scale):
    """Descent directions by the two-loop recursion, for all fits at once."""
    q, kept = gradient.copy(), []
    for s, t in zip(steps[::-1], turns[::-1], strict=True):
        bend = (s * t).sum(axis=1)
        rho = np.divide(1.0, bend, out=np.zeros_like(bend), where=bend > 0)
        alpha = rho * (s * q).sum(axis=1)
        q -= alpha[:, None] * t
        kept.append((rho, alpha))
    bend, size = (steps[-1] * turns[-1]).sum(axis=1), (turns[-1] * scale * turns[-1]).sum(axis=1)
    q *= scale * np.divide(bend, size, out=np.ones_like(bend), where=size > 0)[:, None]
    for (rho, alpha), s, t in zip(kept[::-1], steps, turns, strict=True):
        q += s * (alpha - rho * (t * q).sum(axis=1))[:, None]
    return -q


def _minimise(rows: DataFrame, problem: _Problem, settings: ScorerSettings) -> tuple[np.ndarray, np.ndarray]:
    """Parameters in standard deviations, and which fits ended within the iteration bound.

    Every scan evaluates one trial point of each open fit; a fit whose trial does not lower
    its loss halves its own step in the next scan. Driver memory is some 2 * MEMORY vectors
    as long as the features for each fit.
    """
    size, width = len(problem.sets), len(problem.shift) + 1
    theta = np.zeros((size, width))
    theta[:, -1] = np.where(problem.one_class, 0.0, problem.start)
    share = 1.0 / (1.0 + np.exp(-theta[:, -1]))
    scale = np.repeat((1.0 / (share * (1 - share)))[:, None], width, axis=1)
    scale[:, :-1] = 1.0 / ((share * (1 - share)) + problem.strengths)[:, None]
    value, gradient = _objective(rows, problem, theta, np.arange(size))
    steps, turns = np.zeros((MEMORY, size, width)), np.zeros((MEMORY, size, width))
    done = problem.one_class | (np.abs(scale * gradient).max(axis=1) <= settings.tolerance)
    stuck, taken, length = np.zeros(size, bool), np.zeros(size, int), np.ones(size)
    move = _direction(gradient, steps, turns, scale)
    while (which := np.flatnonzero(~(done | stuck) & (taken < settings.max_iterations))).size:
        trial = theta[which] + length[which, None] * move[which]
        tried, slope = _objective(rows, problem, trial, which)
        fall = 1e-4 * length[which] * (gradient[which] * move[which]).sum(axis=1)
        good = tried <= value[which] + fall + 1e-14 * np.abs(value[which])
        length[which[~good]] *= 0.5
        stuck[which[~good]] = length[which[~good]] < 1e-12
        hit = which[good]
        steps[:, hit], turns[:, hit] = np.roll(steps[:, hit], -1, axis=0), np.roll(turns[:, hit], -1, axis=0)
        steps[-1, hit], turns[-1, hit] = trial[good] - theta[hit], slope[good] - gradient[hit]
        theta[hit], value[hit], gradient[hit] = trial[good], tried[good], slope[good]
        taken[hit] += 1
        done[hit] = np.abs(scale[hit] * gradient[hit]).max(axis=1) <= settings.tolerance
        move[hit], length[hit] = _direction(gradient[hit], steps[:, hit], turns[:, hit], scale[hit]), 1.0
    return theta, done


def _scored(rows: DataFrame, models: list[list[LinearModel]], labels: tuple[str, ...], roles: tuple[int, ...], carry: list[str],
            names: list[tuple] | None = None) -> DataFrame:
    """Long scores of the rows that hold one of ``roles`` in a set, from one scan.

    ``models`` has a list, one model per label, for each entry of ``names``: the pair of a
    set and a round. Output: carried columns, ``fold`` (the set), ``round``, ``role``, ``label``,
    ``truth`` and ``score``.
    """
    names = names or [(k, 0) for k in range(len(models))]
    weights = np.array([[m.coefficients for m in block] for block in models])
    intercepts = np.array([[m.intercept for m in block] for block in models])
    kept = [f for f in rows.schema if f.name in carry]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in (
        ("fold", T.IntegerType()), ("round", T.IntegerType()), ("role", T.IntegerType()), ("label", T.StringType()),
        ("truth", T.DoubleType()), ("score", T.DoubleType()))]])
    order = [f.name for f in kept]

    def score(batches):
        for batch in batches:
            for at, x, y, role in _blocks(batch):
                for block, (held, turn) in enumerate(names):
                    rows_here = np.flatnonzero(np.isin(role[:, held], roles))
                    if not rows_here.size:
                        continue
                    z = x[rows_here] @ weights[block].T + intercepts[block]
                    picked = pa.array(np.repeat(rows_here + at, len(labels)))
                    n = len(picked)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[batch.column(c).take(picked) for c in order], pa.array(np.full(n, held, np.int32)), pa.array(np.full(n, turn, np.int32)),
                            pa.array(np.repeat(role[rows_here, held].astype(np.int32), len(labels))), pa.array(list(labels) * len(rows_here), pa.string()),
                            pa.array(y[rows_here].ravel(), from_pandas=True), pa.array((0.5 * (1.0 + np.tanh(0.5 * z))).ravel()),
                        ],
                        names=schema.names,
                    )

    return rows.select(*order, "_x", "_y", "_roles").mapInArrow(score, schema)


def _search(rows: DataFrame, n_sets: int, settings: ScorerSettings) -> tuple[list[list[LinearModel]], list[Search]]:
    """Fit everything, score the choosing rows with every strength, keep the best per set."""
    problem = _problem(rows, n_sets, settings)
    theta, done = _minimise(rows, problem, settings)
    weights, intercepts = problem.raw(theta, np.arange(len(theta)))
    intercepts = intercepts - weights @ problem.shift
    intercepts = np.where(problem.one_class, np.where(problem.start > 0, np.inf, -np.inf), intercepts)
    n_labels, n_rounds = len(settings.labels), len(settings.strengths)
    made = [LinearModel(w, float(b)) for w, b in zip(weights, intercepts, strict=True)]
    # Fits are numbered by set, label, strength.
    blocks = {
        (held, turn): [made[(held * n_labels + k) * n_rounds + turn] for k in range(n_labels)]
        for held in range(n_sets) for turn in range(n_rounds)
    }
    scored = materialise(_scored(rows, list(blocks.values()), settings.labels, (CHOOSE,), [], list(blocks)).where("truth IS NOT NULL"))
    keys = ["fold", "round"]
    areas = {(r["fold"], r["round"]): r["macro_auroc"] for r in macro_auroc(auroc(scored, [*keys, "label"]), keys).collect()}
    losses = {(r["fold"], r["round"]): r["loss"] for r in masked_bce(scored.withColumn("logit", logit("score")), keys).collect()}
    kept, searches = [], []
    for held in range(n_sets):
        search = Search(held)
        for turn, strength in enumerate(settings.strengths):
            late = [n for k, n in enumerate(settings.labels) if not done[(held * n_labels + k) * n_rounds + turn]]
            value = areas.get((held, turn))
            search.rounds.append({"strength": strength, "loss": losses.get((held, turn), 0.0), "macro_auroc": value, "not_converged": late})
            if value is not None and (search.best is None or value > search.best):
                search.kept = turn
            if settings.patience is not None and turn - (search.kept or 0) >= settings.patience:
                break
        if search.kept is None:
            raise TrainError(f"fold {held}: no label has both classes among the validation patients")
        kept.append(blocks[held, search.kept])
        searches.append(search)
    return kept, searches


# ---------------------------------------------------------------- entry points


def train_fold(train: DataFrame, val: DataFrame, settings: ScorerSettings, *, fold: int = 0,
               features: str = "features") -> tuple[dict[str, LinearModel], Search]:
    """Fit every strength and keep the models with the best validation macro-AUROC.

    Positives are weighted by the capped class ratio of the training rows. A row without a
    truth for a label does not count for it; a row without a feature vector raises.
    """
    shared = overlap(train, val)
    if shared:
        raise TrainError(f"training and validation share {shared} patient(s)")
    columns = [features, *settings.labels]
    both = [df.select(*[F.col(f"`{c}`") for c in columns], F.array(F.lit(r)).alias("_r")) for df, r in ((train, TRAIN), (val, CHOOSE))]
    rows = _narrow(both[0].unionByName(both[1]), F.col("_r"), settings.labels, features, [])
    kept, searches = _search(rows, 1, settings)
    searches[0].fold = fold
    return dict(zip(settings.labels, kept[0], strict=True)), searches[0]


def score_sets(frame: DataFrame, roles: Column, settings: ScorerSettings, *, n_sets: int, features: str = "features",
               carry: tuple[str, ...] = ("patient_id", "image_id")) -> tuple[DataFrame, list[Search]]:
    """Train every set, then score its choosing, held-out and foreign rows in one scan.

    ``roles`` gives a row's role in each of ``n_sets`` sets: ``TRAIN``, ``CHOOSE``, ``SCORE``,
    ``FOREIGN`` or ``UNUSED``. Columns: ``carry``, ``fold`` (the set), ``role``, ``label``, ``truth``,
    ``score``. Two scans gather moments, then each iteration is one scan for all sets, labels and
    strengths.
    """
    rows = _narrow(frame, roles, settings.labels, features, list(carry))
    kept, searches = _search(rows, n_sets, settings)
    return _scored(rows, kept, settings.labels, (CHOOSE, SCORE, FOREIGN), list(carry)).drop("round"), searches


def rotating_roles(fold: str, n_folds: int) -> Column:
    """Roles from a fold number alone: fold k is scored, fold k+1 chooses, the others train."""
    own = F.col(fold)
    return F.array(*[
        F.when(own.isNull() | ~own.between(0, n_folds - 1), UNUSED).when(own == held, SCORE)
        .when(own == (held + 1) % n_folds, CHOOSE).otherwise(TRAIN)
        for held in range(n_folds)
    ])


def cross_predict(frame: DataFrame, settings: ScorerSettings, *, n_folds: int, fold: str = "fold",
                  features: str = "features") -> tuple[DataFrame, list[Search]]:
    """Scores of every patient by the model of the fold the patient was held out of.

    Fold k is scored by models trained on the others, less fold k+1, which chooses their
    strength. Rows of no fold or an outside one take no part. The result carries ``fold`` and
    pools with ``assemble_out_of_fold``.
    """
    scored, searches = score_sets(frame, rotating_roles(fold, n_folds), settings, n_sets=n_folds, features=features)
    return scored.where(F.col("role") == SCORE).select("patient_id", "image_id", "label", "score", "fold"), searches
