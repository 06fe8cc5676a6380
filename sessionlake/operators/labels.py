"""Label sets: what was expected of operator turns and sessions, against what the rules find, and evidence for inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as X
from . import workflow as W

SIGNAL_LABELS = "split string, conversationHash string, turnIndex bigint, expectedPole string, expectedSignal string"
ROLE_LABELS = "conversationHash string, evidenceTurnIndex bigint, expectedRole string"
#: Share of labels whose signal must be found, in the calibration split.
AGREEMENT, EVIDENCE = 0.85, 3


def signal_labels(spark: SparkSession, path: str) -> DataFrame:
    """split, conv_id, idx, pole, signal of a JSON list of labelled turns."""
    rows = spark.read.schema(SIGNAL_LABELS).option("multiLine", True).json(path)
    return rows.select("split", F.col("conversationHash").alias("conv_id"), F.col("turnIndex").alias("idx"), F.col("expectedPole").alias("pole"), F.col("expectedSignal").alias("signal"))


def role_labels(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, idx, expected of a JSON list of labelled sessions."""
    rows = spark.read.schema(ROLE_LABELS).option("multiLine", True).json(path)
    return rows.select(F.col("conversationHash").alias("conv_id"), F.col("evidenceTurnIndex").alias("idx"), F.col("expectedRole").alias("expected"))


def matches(turns: DataFrame) -> DataFrame:
    """One row per operator turn and signal, ordered by signal, conversation and turn where shown."""
    said = W.operator_turns(turns).withColumn("signals", X.signals(F.col("content"))).where(F.size("signals") > 0)
    poles = F.create_map(*(F.lit(x) for s, p, _ in R.SIGNALS for x in (s, p)))
    rows = said.select("conv_id", "idx", W.pole(F.col("signals")).alias("turn_pole"), X.snippet(F.col("content")).alias("snippet"), F.explode("signals").alias("signal"))
    return rows.withColumn("pole", poles[F.col("signal")])


def judged(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """Each label with the pole predicted for its turn (no-signal without any) and whether signal and pole agree."""
    found = matches(turns).groupBy("conv_id", "idx").agg(F.first("turn_pole").alias("prediction"), F.collect_set("signal").alias("found"))
    j = labels.join(found, ["conv_id", "idx"], "left")
    poles = F.create_map(*(F.lit(x) for s, p, _ in R.SIGNALS for x in (s, p)))
    agrees = F.coalesce(F.array_contains("found", F.col("signal")) & (poles[F.col("signal")] == F.col("pole")), F.lit(False))
    return j.select("split", "conv_id", "idx", "pole", "signal", F.coalesce("prediction", F.lit("no-signal")).alias("prediction"), agrees.alias("agrees"), F.coalesce(F.col("prediction") == F.col("pole"), F.lit(False)).alias("correct"))


def validation(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """Per split: labels, signal agreement, accuracy and the share of the commonest pole."""
    j = judged(turns, labels)
    base = j.groupBy("split", "pole").agg(F.count("*").alias("n")).groupBy("split").agg(F.max("n").alias("most"))
    g = j.groupBy("split").agg(F.count("*").alias("labels"), F.count_if("agrees").alias("agreed"), F.count_if("correct").alias("right")).join(base, "split")
    return g.select("split", "labels", (F.col("agreed") / F.col("labels")).alias("agreement"), (F.col("right") / F.col("labels")).alias("accuracy"), (F.col("most") / F.col("labels")).alias("base_rate"))


def sound(validation: dict[str, dict]) -> None:
    """Refuse a profile whose rules do not hold on the labels: validation rows by split."""
    if validation["calibration"]["agreement"] < AGREEMENT:
        raise ValueError("signals disagree with the calibration labels")
    if validation["held-out"]["accuracy"] <= validation["held-out"]["base_rate"]:
        raise ValueError("held-out accuracy does not pass the base rate")


def diverse(rows: DataFrame, key: str, eligible: Column, n: int = EVIDENCE) -> DataFrame:
    """At most n eligible rows of each key, one a conversation: labelled first, then the shortest snippet, then conversation and turn."""
    order = [F.desc("labelled"), F.length("snippet"), F.col("conv_id"), F.col("idx")]
    one = rows.where(eligible).withColumn("k", F.row_number().over(Window.partitionBy(key, "conv_id").orderBy(*order))).where("k = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n).drop("k")


def evidence(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """Evidence of each signal: labelled turns, or turns that begin as instructions do."""
    known = labels.select("conv_id", "idx", F.lit(True).alias("labelled")).distinct()
    rows = matches(turns).join(known, ["conv_id", "idx"], "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))
    return diverse(rows, "signal", F.col("labelled") | X.matches(F.col("snippet"), R.EVIDENCE_START)).select("signal", "rank", "conv_id", "idx", "snippet")


def role_evidence(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """The first labels of each role with their turns, by conversation and turn."""
    nth = F.row_number().over(Window.partitionBy("expected").orderBy("conv_id", "idx"))
    few = labels.withColumn("rank", nth).where(F.col("rank") <= EVIDENCE)
    return few.join(turns.select("conv_id", "idx", X.snippet(F.col("content")).alias("snippet")), ["conv_id", "idx"], "left").select(F.col("expected").alias("role"), "rank", "conv_id", "idx", "snippet")


def role_eligible(role: Column, content: Column) -> Column:
    """Whether a turn may show what sessions of a role are told."""
    c, out = X.trim(content), F.lit(False)
    for r, begins, never in R.ROLE_EVIDENCE:
        hit = X.matches(c, begins)
        out = F.when(role == r, hit & ~X.matches(c, never) if never else hit).otherwise(out)
    return out


def unsupported(turns: DataFrame, pointers: DataFrame) -> DataFrame:
    """Pointers (conv_id, idx, signal) that name no current operator turn with that signal."""
    return pointers.join(matches(turns).select("conv_id", "idx", "signal"), ["conv_id", "idx", "signal"], "left_anti")
