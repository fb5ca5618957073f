"""What a site's frozen models do at sites they were not trained for.

Nothing is fitted here: scores, temperatures and thresholds of the source site are joined, and
the target site's rows are only counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgauge.functions.maths import ratio
from cohortgauge.operators.calibration import decide


def decide_elsewhere(scores: DataFrame, temperatures: DataFrame, thresholds: DataFrame, arm: str = "global") -> DataFrame:
    """Decisions of every source site's models on rows of other sites.

    ``scores`` has a row per ``source_site``, ``fold``, ``label`` and row of another ``site``; parameters
    are those of ``source_site`` and ``fold``. A row without a score is predicted negative, one
    without a threshold stays undecided.
    """
    as_source = scores.withColumnsRenamed({"site": "target_site", "source_site": "site"})
    return decide(as_source, temperatures, thresholds, arm).withColumnsRenamed({"site": "source_site"})


def transport_rates(decisions: DataFrame) -> DataFrame:
    """Per source, target, label and view: rates over all fold models, and their spread.

    ``view`` is ``all`` in the rows over all views. Counts add the models of all folds, so a patient counts
    once for each model that judged them. ``fnr_low`` and ``fnr_high`` are the smallest and the
    largest rate of a single fold. A rate is NULL where no row can answer it.
    """
    keys = ["source_site", "target_site", "label"]
    known = F.col("predicted").isNotNull()
    positive, negative, flagged = known & (F.col("truth") == 1), known & (F.col("truth") == 0), F.col("predicted") == 1
    counts = decisions.groupBy(*keys, "fold", "view").agg(
        F.count_if(positive).alias("_pos"), F.count_if(positive & ~flagged).alias("_missed"),
        F.count_if(negative).alias("_neg"), F.count_if(negative & flagged).alias("_false"),
    )
    # A missing view counts in the total alone.
    both = F.array_compact(F.array(F.lit("all"), F.col("view")))
    sums = [F.sum(c).alias(c) for c in ("_pos", "_missed", "_neg", "_false")]
    folds = counts.withColumn("view", F.explode(both)).groupBy(*keys, "view", "fold").agg(*sums)
    rate = ratio(F.col("_missed"), F.col("_pos"))
    return folds.groupBy(*keys, "view").agg(
        F.sum("_pos").alias("n_positive"), F.sum("_neg").alias("n_negative"),
        ratio(F.sum("_missed"), F.sum("_pos")).alias("fnr"), ratio(F.sum("_false"), F.sum("_neg")).alias("fpr"),
        F.min(rate).alias("fnr_low"), F.max(rate).alias("fnr_high"),
    )
