"""Draw texts so that each source reaches its share of all tokens.

Texts whose source is known belong to it wholly; for the others a classifier,
trained on a bounded sample of labelled texts, gives a posterior over the
sources. Projected-gradient least squares fits a rate, 0 to its cap, for every
text so that the expected tokens of each source meet its target; the rates
become whole numbers of uses by a deterministic draw.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.tokens import encoding, token_features, vocabulary
from siftstone.operators.layout import spread
from siftstone.operators.components import NotConverged
from siftstone.operators.ranking import grouped_position, slices_for
from siftstone.operators.scratch import written

#: Labelled texts, about, that train and test the classifier; a quarter of them is held out to set its temperature.
SAMPLE_TEXTS = 12_000
FEATURES = 4096
TEMPERATURES = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0)
#: Gradient steps before the call raises, and steps after which the rates so far are written.
MAX_STEPS, REBASE = 500, 8
MAX_SOURCES = 1000


@dataclass(frozen=True)
class Classifier:
    """Multinomial naive Bayes over token features, length-normalised, softened by one temperature."""

    log_prior: np.ndarray
    log_rate: np.ndarray  # sources x features
    temperature: float
    accuracy: float  # on held-out texts

    def posterior(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = max(1, int(counts.sum()))
        score = self.log_prior + (self.log_rate[:, bins] @ counts) / total * self.temperature
        score = np.exp(score - score.max())
        return score / score.sum()


def fit_classifier(sample: DataFrame, sources: int, width: int = FEATURES) -> Classifier:
    """From (label, bins, counts, held). Texts stay on the executors: the driver gets a sum for each source and feature, and a
    loss for each temperature. Without any labelled text all sources are equally likely."""
    train = sample.where(~F.col("held"))
    rates = np.full((sources, width), 0.1)
    prior = np.ones(sources)
    sums = train.select("label", F.explode(F.arrays_zip("bins", "counts")).alias("e")).groupBy("label", F.col("e.bins").alias("bin")).agg(F.sum("e.counts").alias("n")).toPandas()
    rates[sums["label"].to_numpy(int), sums["bin"].to_numpy(int)] += sums["n"].to_numpy(float)
    for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect():
        prior[r["label"]] += r["n"]
    log_rate = np.log(rates / rates.sum(axis=1, keepdims=True))
    log_prior = np.log(prior / prior.sum())
    models = [Classifier(log_prior, log_rate, t, float("nan")) for t in TEMPERATURES]

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, right, n = np.zeros(len(models)), np.zeros(len(models), dtype=np.int64), 0
        for batch in batches:
            for label, bins, counts in zip(*(c.to_pylist() for c in batch.columns)):
                n += 1
                for k, model in enumerate(models):
                    p = model.posterior(np.asarray(bins, dtype=int), np.asarray(counts, dtype=float))
                    loss[k] -= np.log(max(p[label], 1e-12))
                    right[k] += p.argmax() == label
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), pa.array(loss), pa.array(right), pa.array([n] * len(models), pa.int64())], ["k", "loss", "correct", "n"])

    held = sample.where("held").select("label", "bins", "counts").mapInArrow(tested, "k int, loss double, correct bigint, n bigint")
    found = [r for r in held.groupBy("k").agg(F.sum("loss").alias("loss"), F.sum("correct").alias("correct"), F.sum("n").alias("n")).orderBy("k").collect() if r["n"]]
    if not found:
        return models[0]
    best = min(found, key=lambda r: (round(r["loss"] / r["n"], 9), r["k"]))
    return Classifier(log_prior, log_rate, TEMPERATURES[best["k"]], best["correct"] / best["n"])


def clean_source(source: Column) -> Column:
    """Spellings brought together: no blanks at the edges, lower case; an empty name counts as none."""
    name = F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(name != "", name)


def _measured(docs: DataFrame, fraction: float, seed: int, path: str | None) -> DataFrame:
    """(doc_id, source, n_tokens, in_sample, bins, counts); features only where they are needed."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path, docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(shared.value)
        for batch in batches:
            n, bins, counts = [], [], []
            for text, wanted in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                if wanted:
                    k, b, c = token_features(bpe, text, FEATURES)
                    n.append(k), bins.append(b), counts.append(c)
                else:
                    n.append(len(bpe.encode_ordinary(text))), bins.append(None), counts.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), batch.column(3), pa.array(bins, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                ["doc_id", "source", "n_tokens", "in_sample", "bins", "counts"],
            )

    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    rows = docs.withColumn("in_sample", F.coalesce(F.col("source").isNotNull() & (chance < fraction), F.lit(False)))
    wanted = F.col("in_sample") | F.col("source").isNull()
    return spread(rows.select("doc_id", "source", "text", "in_sample", wanted.alias("wanted"))).mapInArrow(run, "doc_id bigint, source string, n_tokens bigint, in_sample boolean, bins array<int>, counts array<int>")


def fit_rates(units: DataFrame, target: np.ndarray, tolerance: float = 1e-7, max_steps: int = MAX_STEPS, strict: bool = True) -> tuple[list[list[float]], np.ndarray]:
    """Projected gradient over ``units`` (membership array<double>, tokens, cap, start).

    Minimises the squared gaps between expected and wanted tokens of each source
    over rates in [0, cap]. A rate is a function of its membership and of the
    scaled gaps of all earlier steps: each step is one distributed sum of a vector
    as long as the list of sources, and every REBASE steps the rates are written,
    so a step costs the same whatever its number. Ends when all gaps close or
    nothing moves any more (caps); at ``max_steps`` the call raises, or returns
    what it has with strict=False. Returns the steps and the expected tokens.
    """
    k = len(target)
    capacity = np.array(units.select([F.sum(F.col("membership")[i] * F.col("tokens")).alias(str(i)) for i in range(k)]).first(), dtype=float)
    steps: list[list[float]] = []
    recent: list[list[float]] = []
    now = units
    total = max(float(target.sum()), 1.0)
    reached, last = np.zeros(k), None
    while True:
        rate = rate_after(recent)
        reached = np.nan_to_num(np.array(now.select((rate * F.col("tokens")).alias("w"), "membership").select([F.sum(F.col("membership")[i] * F.col("w")).alias(str(i)) for i in range(k)]).first(), dtype=float))
        gap = reached - target
        if np.abs(gap).max() <= tolerance * total or (last is not None and np.allclose(reached, last, rtol=0, atol=tolerance * total * 0.01)):
            return steps, reached
        if len(steps) >= max_steps:
            if strict:
                raise NotConverged(f"largest gap {np.abs(gap).max():.3g} tokens and still moving after {max_steps} steps")
            return steps, reached
        last = reached
        step = [float(x) for x in np.where(capacity > 0, gap / np.maximum(capacity, 1.0), 0.0)]
        steps.append(step), recent.append(step)
        if len(recent) == REBASE:
            now, recent = written(now.withColumn("start", rate_after(recent)), "rates"), []


def rate_after(steps: list[list[float]]) -> Column:
    """Rate of a unit after these steps, as one JVM expression."""
    if not steps:
        return F.col("start")
    taken = F.array(*(F.array(*(F.lit(x) for x in s)) for s in steps))

    def one(rate: Column, gaps: Column) -> Column:
        slope = F.aggregate(F.zip_with(F.col("membership"), gaps, lambda m, g: m * g), F.lit(0.0), lambda s, x: s + x)
        return F.least(F.greatest(rate - slope, F.lit(0.0)), F.col("cap").cast("double"))

    return F.aggregate(taken, F.col("start"), one)


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_tokens: int | None = None, seed: int = 7, path: str | None = None, sample_texts: int = SAMPLE_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares).

    ``drawn``: (doc_id, source, n_tokens, uses) of every chosen text; source is
    null where none is known. ``shares``: one row per target source with
    target_share, reached_share (by label), expected_share (with the posteriors
    of unlabelled texts), budget_tokens (what the fitted rate allots to the labelled
    texts; met to half a text), texts, uses and tokens, and one row with source
    null for the unlabelled.

    ``total_tokens`` is the size to draw; without it the largest size at which
    every source that has texts can meet its share within its repeats. A source
    whose texts cannot fill its share is used max_repeats times and its reached
    share says so. An unlabelled text is used at most as often as the least
    max_repeats. Texts of a source without target, null texts, empty texts and
    rows with a null id are not drawn. Targets are a small table of settings.
    """
    spark = docs.sparkSession
    wanted = [r for r in targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").dropna().orderBy("source").limit(MAX_SOURCES + 1).collect()]
    drawn_schema, shares_schema = "doc_id bigint, source string, n_tokens bigint, uses int", "source string, target_share double, reached_share double, expected_share double, budget_tokens double, texts bigint, uses bigint, tokens bigint"
    if len(wanted) > MAX_SOURCES or len({r["source"] for r in wanted}) < len(wanted):
        raise ValueError(f"targets name at most {MAX_SOURCES} sources, each once")
    if not wanted:
        return spark.createDataFrame([], drawn_schema), spark.createDataFrame([], shares_schema)
    names = [r["source"] for r in wanted]
    share = np.array([r["target_share"] for r in wanted], dtype=float)
    caps = np.array([r["max_repeats"] for r in wanted], dtype=int)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), clean_source(F.col(source_col)).alias("source"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text <> ''")
    rows = rows.where(F.col("source").isNull() | F.col("source").isin(names))
    labelled = docs.where(clean_source(F.col(source_col)).isin(names)).count()  # reads the source column only
    measured = written(_measured(rows, sample_texts / max(labelled, 1), seed, path), "measured")

    place = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))))
    held = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) == 3
    model = fit_classifier(measured.where("in_sample").select(F.element_at(place, F.col("source")).alias("label"), "bins", "counts", held.alias("held")), len(names))
    unknown = measured.where("source IS NULL")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [model.posterior(np.asarray(b, dtype=int), np.asarray(c, dtype=float)).tolist() for b, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.list_(pa.float64()))], ["doc_id", "n_tokens", "membership"])

    soft = written(unknown.select("doc_id", "n_tokens", "bins", "counts").mapInArrow(predict, "doc_id bigint, n_tokens bigint, membership array<double>"), "posteriors")
    sums = measured.where("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("texts")).collect()
    have = {r["source"]: int(r["n"]) for r in sums}
    tokens = np.array([have.get(n, 0) for n in names], dtype=float)
    present = (tokens > 0) & (share > 0)
    if total_tokens is None:
        total = float(np.min(caps[present] * tokens[present] / share[present])) if present.any() else 0.0
    else:
        total = float(total_tokens)
    goal = share * total

    one_hot = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: (i == F.col("k")).cast("double"))
    cap_of = F.element_at(F.array(*(F.lit(int(c)) for c in caps)), F.col("k") + 1)
    hard = spark.createDataFrame([(k, float(t)) for k, t in enumerate(tokens)], "k int, tokens double").select(one_hot.alias("membership"), "tokens", cap_of.alias("cap"))
    single = soft.select("membership", F.col("n_tokens").cast("double").alias("tokens"), F.lit(int(caps.min())).alias("cap"))
    start = F.lit(total / max(float(tokens.sum()), 1.0))
    units = hard.unionByName(single).withColumn("start", F.least(start, F.col("cap").cast("double")))
    steps, expected = fit_rates(units, goal)

    rate = rate_after(steps)
    by_source = {r["k"]: r["rate"] for r in spark.createDataFrame([(k,) for k in range(len(names))], "k int").select("k", one_hot.alias("membership"), cap_of.alias("cap")).withColumn("start", F.least(start, F.col("cap").cast("double"))).select("k", rate.alias("rate")).collect()}
    rates = np.array([by_source[k] for k in range(len(names))])
    base = np.floor(rates + 1e-9)
    budget = np.maximum(rates - base, 0.0) * tokens
    known = measured.where("source IS NOT NULL").select("doc_id", "source", "n_tokens").withColumn("k", F.element_at(place, F.col("source")))
    at = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("k") + 1)
    # whole rates for all texts of a source; one more for those that stand first in hash order until the rest of the budget is met
    placed = grouped_position(known, ["k"], F.xxhash64("doc_id", "n_tokens", F.lit(seed)), F.col("n_tokens"), slices_for(max((r["texts"] for r in sums), default=0)))
    extra = (F.col("before") + F.col("n_tokens") / 2 < at(budget)).cast("int")
    chosen = placed.select("doc_id", "source", "n_tokens", (at(base).cast("int") + extra).alias("uses"))
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "n_tokens", F.lit(seed)), 11) / F.lit(float(1 << 53))
    loose = (
        soft.withColumn("cap", F.lit(int(caps.min()))).withColumn("start", F.least(start, F.col("cap").cast("double"))).withColumn("__r", rate)
        .select("doc_id", F.lit(None).cast("string").alias("source"), "n_tokens", (F.floor("__r") + (chance < F.col("__r") - F.floor("__r")).cast("int")).cast("int").alias("uses"))
    )
    drawn = written(chosen.unionByName(loose).where("uses > 0"), "drawn")
    sums = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"))
    rows = [(n, float(s), float(e / max(expected.sum(), 1.0)), float(b)) for n, s, e, b in zip(names, share, expected, rates * tokens)]
    goals = spark.createDataFrame([*rows, (None, 0.0, 0.0, None)], "source string, target_share double, expected_share double, budget_tokens double")
    whole = sums.agg(F.sum("tokens").alias("n")).scalar()
    shares = (
        goals.alias("g").join(sums.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source")), "left")
        .select("g.source", "target_share", (F.coalesce("tokens", F.lit(0)) / whole).alias("reached_share"), "expected_share", "budget_tokens", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    )
    return drawn, shares
