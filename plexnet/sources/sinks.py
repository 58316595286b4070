"""Sinks for the training outputs: cost history and model summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_history(history: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header ``epoch,cost_train,cost_val`` (one folder per model)."""
    (history.select("model_id", "epoch", "cost_train", "cost_val")
     .write.mode(mode).option("header", True).partitionBy("model_id").csv(path))


def summary_lines(summary: DataFrame, data_name: str, warm: str = "RND", stored: str = "") -> DataFrame:
    """One ';'-separated line per model: data; hidden epochs rate; hidden
    layer count; best epoch; best cost (3 decimals, decimal comma);
    optimizer_maxmu_itert; warm-start mode_stored weights lambda."""
    hidden = F.array_join(F.transform("hidden", lambda h: h.cast("string")), "-")
    best = F.translate(F.format_string("%.3f", F.col("best_cost")), ".", ",")
    line = F.concat_ws(
        ";", F.lit(data_name),
        F.concat_ws(" ", hidden, F.col("epochs").cast("string"), F.col("rate").cast("string")),
        F.col("hidden_layers").cast("string"), F.col("best_epoch").cast("string"), best,
        F.concat_ws("_", F.col("optimizer"), F.col("maxmu").cast("string"), F.col("itert").cast("string")),
        F.concat_ws(" ", F.lit(f"{warm}_{stored}"), F.col("lmbda").cast("string")))
    return summary.select("model_id", line.alias("line"))


def write_model_summary(summary: DataFrame, path: str, data_name: str, mode: str = "append", warm: str = "RND", stored: str = "") -> None:
    """Append the summary lines (the reference appends one line per trained
    model to one file)."""
    summary_lines(summary, data_name, warm, stored).select("line").coalesce(1).write.mode(mode).text(path)
