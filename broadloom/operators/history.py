"""Training histories: ``trial_id, epoch, loss, val_loss, epoch_seconds``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadloom.functions.numeric import finite_or_null

# Fixed value: epochs without improvement before training stops.
PATIENCE = 5


def convergence(history: DataFrame) -> DataFrame:
    """Best epoch, last losses, epoch count and time of every trial, in one aggregate."""
    val = finite_or_null(F.col("val_loss"))
    # A missing loss is never the best one; the first minimum wins.
    key = F.when(val.isNotNull(), F.struct(val.alias("v"), F.col("epoch")))
    return (
        history.groupBy("trial_id")
        .agg(
            F.min_by("epoch", key).alias("best_epoch"),
            F.min(val).alias("best_val_loss"),
            F.max_by("loss", "epoch").alias("final_train_loss"),
            F.max_by("val_loss", "epoch").alias("final_val_loss"),
            F.max("epoch").alias("total_epochs"),
            F.sum("epoch_seconds").alias("total_training_time"),
            F.coalesce(F.avg("epoch_seconds"), F.lit(0.0)).alias("avg_epoch_time"),
        )
        .withColumn("convergence_speed", F.col("best_epoch") / F.col("total_epochs"))
    )


def early_stop(history: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Where a patience rule stops each trial and which epoch it would restore.

    ``stop_epoch`` is null when the rule never fires. Only a strictly lower
    validation loss counts as an improvement.
    """
    order = Window.partitionBy("trial_id").orderBy("epoch")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    val = finite_or_null(F.col("val_loss"))
    floor = F.min(val).over(earlier)
    improved = val.isNotNull() & (floor.isNull() | (val < floor))
    marked = (
        history.select("trial_id", "epoch", "val_loss")
        .withColumn("n", F.row_number().over(order))
        .withColumn("improved", improved)
        .withColumn("last_best", F.max(F.when(F.col("improved"), F.col("n"))).over(so_far))
        .withColumn("waited", F.col("n") - F.coalesce("last_best", F.lit(0)))
    )
    stop = F.min(F.when(F.col("waited") >= patience, F.col("epoch"))).over(
        Window.partitionBy("trial_id")
    )
    running = marked.withColumn("stop_epoch", stop).filter(
        F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch"))
    )
    return running.groupBy("trial_id").agg(
        F.first("stop_epoch").alias("stop_epoch"),
        F.max(F.when(F.col("improved"), F.col("epoch"))).alias("best_epoch"),
        F.max("epoch").alias("epochs_run"),
    )
