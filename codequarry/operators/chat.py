"""Conversations: valid recent history and model cascades over tables of replies."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.functions.text import strip

ROLES = ("user", "assistant")


def history(df, conv="conv_id", turn="turn", role="role", text="text", most=20):
    """The last `most` messages of each conversation with a known role and text, stripped."""
    valid = df.filter(F.col(role).isin(*ROLES) & (strip(F.col(text)) != "")).withColumn(text, strip(F.col(text)))
    last = Window.partitionBy(conv).orderBy(F.desc(turn))
    return valid.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= most).drop("_r")


def cascade(replies, keys, reason, phase="phase", attempt="attempt", status="status"):
    """The first accepted reply of each group, by phase and attempt.

    A reply that asks for more context ends its phase; later attempts of it
    don't count.
    """
    asked = F.min(F.when(F.col(status) == "needs_context", F.col(attempt))).over(Window.partitionBy(*keys, phase))
    alive = replies.withColumn("_asked", asked).filter(F.col("_asked").isNull() | (F.col(attempt) <= F.col("_asked")))
    good = alive.filter(F.col(reason).isNull() & (F.col(status) != "needs_context")).drop("_asked")
    first = Window.partitionBy(*keys).orderBy(phase, attempt)
    return good.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
