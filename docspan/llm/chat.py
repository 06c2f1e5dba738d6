"""Multi-party dialogues as training text, once from each participant's side.

For every participant the dialogue is rendered with that speaker as the assistant and all others as
named users; system turns stay system turns.  The mask lists the spans to train on: what the
assistant says, with the mark that ends it.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspan.llm.common import small, stored

#: Turns of a dialogue that one example holds at most; a longer one is rendered in parts.
PART_TURNS = 512
#: Rows of one part; only where many rows have the same turn are there more.
PART_ROWS = 2048
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """Text without marks of the format: a blank parts the characters of any that it holds."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, perspective, n_turns, text, mask, trained_chars): one row for each dialogue,
    part and participant.  mask: spans [start, end) in characters of text, in order.

    Turns are in order of turn (null last), then of role and text.  Part k holds the turns from
    k * part_turns on.  Each part is rendered for every participant of the dialogue, silent there or
    not, and begins with all system turns of the parts before it, which n_turns counts too.  Should
    equal turn numbers make a part larger than PART_ROWS, it is cut in that order into parts that
    end in .1, .2 and so on.  Turns without a number are a dialogue of their own, with part null.  A
    null role is the participant "unknown", a null text empty.  Rows without a conv_id are one
    dialogue.  Dialogues in which only the system speaks have no participant, so no row.  Repeated
    rows are repeated turns; other columns are not read.
    """
    role = F.coalesce(F.nullif(F.trim(F.col(role_col).cast("string")), F.lit("")), F.lit("unknown"))
    src = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), _plain(role).alias("role"), _plain(F.col(text_col)).alias("text"))
    src = src.withColumn("part", F.floor(F.col("turn") / part_turns).cast("long"))
    src = src.withColumn("late", F.col("turn").isNull())
    message = F.struct("late", "turn", "role", "text")
    long = stored(src.groupBy("conv_id", "late").agg(F.count("*").alias("rows"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter((F.col("rows") > PART_ROWS) | (F.col("hi") > F.col("lo"))), "long")
    rows = long.agg(F.sum("rows")).first()[0]
    whole = src if rows is None else src.join(small(long), _same(src, long, "conv_id", "late"), "left_anti")
    talks = whole.groupBy("conv_id", "late", "part").agg(F.array_sort(F.collect_list(message)).alias("said"))
    talks = talks.withColumn("perspective", F.explode(F.array_distinct(F.filter(F.transform("said", lambda m: m["role"]), lambda r: r != "system"))))
    talks = talks.select("conv_id", "part", F.lit(0).cast("long").alias("deal"), "said", "perspective")
    if rows is not None:
        talks = talks.unionByName(_long_talks(src.join(small(long), _same(src, long, "conv_id", "late"), "left_semi"), message, rows))

    def piece(m: Column) -> Column:
        own = m["role"] == F.col("perspective")
        head = F.when(own, F.lit("assistant")).when(m["role"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), m["role"]))
        before = F.concat(F.lit(OPEN), head, F.lit("\n"))
        return F.struct(before.alias("before"), F.concat(m["text"], F.lit(CLOSE)).alias("body"), own.alias("own"))

    done = talks.withColumn("pieces", F.transform("said", piece))
    line = F.transform("pieces", lambda p: F.concat(p["before"], p["body"], F.lit("\n")))
    # one pass over the pieces: where the text has got to, and the spans so far
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(seen: Column, p: Column) -> Column:
        start = seen["at"] + F.char_length(p["before"])
        end = start + F.char_length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(seen["spans"], span)).otherwise(seen["spans"]).alias("spans"))

    done = done.withColumn("mask", F.aggregate("pieces", zero, step)["spans"])
    trained = F.aggregate("mask", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    part = F.when(F.col("deal") > 0, F.concat_ws(".", F.col("part").cast("string"), F.col("deal").cast("string"))).otherwise(F.col("part").cast("string"))
    return done.select("conv_id", part.alias("part"), "perspective", F.size("said").cast("long").alias("n_turns"), F.array_join(line, "").alias("text"), "mask", trained.alias("trained_chars"))


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Equal in these columns, nulls too."""
    same = F.lit(True)
    for n in names:
        same = same & a[n].eqNullSafe(b[n])
    return same


def _long_talks(src: DataFrame, message: Column, rows: int) -> DataFrame:
    """(conv_id, part, deal, said, perspective) of dialogues that have more than one part."""
    conf = src.sparkSession.conf.get("spark.sql.shuffle.partitions")
    key = ["conv_id", "late", "part"]
    # the position of a row in its part: its place in a slice of the sorted rows, and the slices before
    src = stored(src.repartitionByRange(max(int(conf), rows // 100_000 + 1), *key, "turn", "role", "text").withColumn("slice", F.spark_partition_id()), "sliced")
    before = F.sum("rows").over(Window.partitionBy(*key).orderBy("slice")) - F.col("rows")
    offsets = stored(src.groupBy(*key, "slice").agg(F.count("*").alias("rows")).select(*(F.col(k).alias(f"o_{k}") for k in [*key, "slice"]), before.alias("offset")), "offsets")
    same = F.col("slice") == F.col("o_slice")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    nth = F.row_number().over(Window.partitionBy("slice", *key).orderBy("turn", "role", "text")) - 1
    src = src.withColumn("nth", nth).join(small(offsets), same)
    src = stored(src.select(*key, F.floor((F.col("nth") + F.col("offset")) / PART_ROWS).alias("deal"), "turn", "role", "text"), "cut")

    said = src.groupBy(*key, "deal").agg(F.array_sort(F.collect_list(message)).alias("said"))
    # what the system has said in the parts before
    parts = small(stored(src.select(*(F.col(k).alias(f"p_{k}") for k in [*key, "deal"])).distinct(), "parts"))
    earlier = F.struct(F.coalesce("part", F.lit(0)), "deal") < F.struct(F.coalesce("p_part", F.lit(0)), "p_deal")
    heads = src.filter(F.col("role") == "system").join(parts, F.col("conv_id").eqNullSafe(F.col("p_conv_id")) & (F.col("late") == F.col("p_late")) & earlier)
    heads = heads.groupBy("p_conv_id", "p_late", "p_part", "p_deal").agg(F.array_sort(F.collect_list(message)).alias("head"))
    same = F.col("deal") == F.col("p_deal")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    said = said.join(heads, same, "left").withColumn("said", F.when(F.col("head").isNull(), F.col("said")).otherwise(F.concat("head", "said")))
    speakers = stored(src.filter(F.col("role") != "system").select(F.col("conv_id").alias("s_conv_id"), F.col("late").alias("s_late"), F.col("role").alias("perspective")).distinct(), "speakers")
    said = said.join(small(speakers), F.col("conv_id").eqNullSafe(F.col("s_conv_id")) & (F.col("late") == F.col("s_late")))
    return said.select("conv_id", "part", "deal", "said", "perspective")
