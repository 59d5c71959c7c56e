"""Ordered sequences: runs, commuting neighbours, and contract checks as folds over state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def collapse_runs(df: DataFrame, by: list[str], order: list[str], same: list[str], mergeable: Column | None = None) -> DataFrame:
    """The first row of each run of equal neighbours, with ``run_length``; rows that are not mergeable stay
    single."""
    spec = Window.partitionBy(*by).orderBy(*order)
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.lag(c).over(spec)) & F.lag(F.lit(1)).over(spec).isNotNull()
    if mergeable is not None:
        equal = equal & mergeable
    begins = df.withColumn("_new", (~equal).cast("int"))
    runs = begins.withColumn("_run", F.sum("_new").over(spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    per = Window.partitionBy(*by, "_run")
    counted = runs.withColumn("run_length", F.count("*").over(per))
    return counted.where("_new = 1").drop("_new", "_run")


def commuting_pairs(df: DataFrame, by: list[str], order: list[str], read_only: Column, names: str) -> DataFrame:
    """Rows whose next row is read-only and shares no argument name with them, with ``next_*`` order columns."""
    spec = Window.partitionBy(*by).orderBy(*order)
    ahead = df.withColumn("_read", F.lead(read_only).over(spec)).withColumn("_names", F.lead(names).over(spec))
    ahead = ahead.withColumns({f"next_{c}": F.lead(c).over(spec) for c in order})
    return ahead.where(F.col("_read") & ~F.coalesce(F.arrays_overlap(F.col(names), F.col("_names")), F.lit(False))).drop("_read", "_names")


def ordered_steps(df: DataFrame, by: str, step: str, columns: list[str]) -> DataFrame:
    """(by, steps): each sequence's steps in order; a sequence is one program's trace."""
    steps = F.array_sort(F.collect_list(F.struct(F.col(step).alias("step"), *columns)))
    return df.groupBy(by).agg(steps.alias("steps"))


def _stop(state: Column, verdict: str, rule: str, at: Column) -> Column:
    return F.struct(
        *[state[f].alias(f) for f in ("cmds", "ready", "empty", "fresh")], F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"), at.cast("int").alias("at")
    )


def check_submissions(df: DataFrame, by: str, step: str, segments: int = 3, max_steps: int = 200) -> DataFrame:
    """Queue submissions, polled: steps (op, reg, ready, empty) where a read of STATUS shows both flags.

    The first command needs the last seen ready flag to be 1 (S1), the second must not follow a seen 0 (S1),
    each further one needs a ready flag of 1 seen since the queue filled (S3). At the end all segments must
    have gone out (else INSUFFICIENT_EVIDENCE) with both flags last seen as 1 (S7). Steps from ``max_steps``
    on are BUDGET_INFEASIBLE; an op other than read and write is UNKNOWN_OP. Returns judgment, contract and
    at_step of each sequence."""
    told = ordered_steps(df, by, step, ["op", "reg", "ready", "empty"])
    empty = F.struct(
        F.lit(0).alias("cmds"),
        F.lit(False).alias("ready"),
        F.lit(False).alias("empty"),
        F.lit(False).alias("fresh"),
        F.lit(None).cast("string").alias("verdict"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("int").alias("at"),
    )

    def go(s: Column, x: Column) -> Column:
        read = (x["op"] == "read") & (x["reg"] == "STATUS")
        command = (x["op"] == "write") & (x["reg"] == "COMMAND")
        at = x["place"]
        seen = F.struct(
            s["cmds"].alias("cmds"),
            x["ready"].alias("ready"),
            x["empty"].alias("empty"),
            (s["fresh"] | (x["ready"] & (s["cmds"] >= 2))).alias("fresh"),
            *[s[f].alias(f) for f in ("verdict", "rule", "at")],
        )
        sent = F.struct(
            (s["cmds"] + 1).alias("cmds"), s["ready"].alias("ready"), s["empty"].alias("empty"), F.lit(False).alias("fresh"), *[s[f].alias(f) for f in ("verdict", "rule", "at")]
        )
        return (
            F.when(s["verdict"].isNotNull(), s)
            .when(at >= max_steps, _stop(s, "BUDGET_INFEASIBLE", "", at))
            .when(read, seen)
            .when(command & (s["cmds"] < 2) & ~s["ready"], _stop(s, "VIOLATION", "S1", at))
            .when(command & (s["cmds"] >= 2) & ~s["fresh"], _stop(s, "VIOLATION", "S3", at))
            .when(command, sent)
            .when(x["op"].isin("read", "write"), s)
            .otherwise(_stop(s, "VIOLATION", "UNKNOWN_OP", at))
        )

    numbered = F.transform("steps", lambda x, i: F.struct(x["op"].alias("op"), x["reg"].alias("reg"), F.coalesce(x["ready"], F.lit(False)).alias("ready"), F.coalesce(x["empty"], F.lit(False)).alias("empty"), i.alias("place")))
    folded = told.select(by, F.aggregate(numbered, empty, go).alias("s"))
    end = (
        F.when(F.col("s.verdict").isNotNull(), F.col("s.verdict"))
        .when(F.col("s.cmds") < segments, "INSUFFICIENT_EVIDENCE")
        .when(~(F.col("s.ready") & F.col("s.empty")), "VIOLATION")
        .otherwise("SUCCESS")
    )
    rule = F.when(F.col("s.verdict").isNotNull(), F.nullif(F.col("s.rule"), F.lit(""))).when(
        (F.col("s.cmds") >= segments) & ~(F.col("s.ready") & F.col("s.empty")), F.lit("S7")
    )
    return folded.select(by, end.alias("judgment"), rule.alias("contract"), F.col("s.at").alias("at_step"))


KEYS = 16


def check_initialization(df: DataFrame, by: str, step: str, max_steps: int = 200) -> DataFrame:
    """Initialization of a shadowed control register and 16 key registers: steps (op, reg, value, idle).

    A control write needs an idle flag seen before (C1), and takes effect only while the last seen flag is 1;
    two equal writes in a row commit, a read in between or a different value starts over. A key write needs
    the commit (C3) and an idle flag seen after it (C4). At the end: no commit, or a commit without any key,
    is INSUFFICIENT_EVIDENCE; a part of the keys is a violation (C8). Writes elsewhere but to IV_0..IV_3 and
    TRIGGER are UNKNOWN_REG."""
    told = ordered_steps(df, by, step, ["op", "reg", "value", "idle"])
    fields = ("idle", "seen", "first", "done", "again", "keys", "verdict", "rule", "at")
    start = F.struct(
        F.lit(True).alias("idle"),
        F.lit(False).alias("seen"),
        F.lit(None).cast("string").alias("first"),
        F.lit(False).alias("done"),
        F.lit(False).alias("again"),
        F.array().cast("array<string>").alias("keys"),
        F.lit(None).cast("string").alias("verdict"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("int").alias("at"),
    )

    def put(s: Column, **new: Column) -> Column:
        return F.struct(*[(new[f] if f in new else s[f]).alias(f) for f in fields])

    def go(s: Column, x: Column) -> Column:
        stop = lambda verdict, rule: put(s, verdict=F.lit(verdict), rule=F.lit(rule), at=x["place"].cast("int"))
        none = F.lit(None).cast("string")
        read, write = x["op"] == "read", x["op"] == "write"
        control = x["reg"] == "CTRL_SHADOWED"
        key = x["reg"].rlike("^KEY_SHARE[01]_[0-7]$")
        known = control | key | x["reg"].rlike("^IV_[0-3]$") | (x["reg"] == "TRIGGER")
        polled = put(s, idle=x["idle"], seen=s["seen"] | (x["idle"] & ~s["done"]), again=s["again"] | (x["idle"] & s["done"]))
        return (
            F.when(s["verdict"].isNotNull(), s)
            .when(x["place"] >= max_steps, stop("BUDGET_INFEASIBLE", ""))
            .when(read & (x["reg"] == "STATUS"), polled)
            .when(read & control, put(s, first=none))
            .when(~write, s)
            .when(~known, stop("VIOLATION", "UNKNOWN_REG"))
            .when(control & ~s["seen"], stop("VIOLATION", "C1"))
            .when(control & ~s["idle"], s)
            .when(control & s["first"].isNull(), put(s, first=F.coalesce(x["value"], F.lit(""))))
            .when(control & (s["first"] == F.coalesce(x["value"], F.lit(""))), put(s, done=F.lit(True)))
            .when(control, put(s, first=none))
            .when(key & ~s["done"], stop("VIOLATION", "C3"))
            .when(key & ~s["again"], stop("VIOLATION", "C4"))
            .when(key & s["idle"], put(s, keys=F.array_union(s["keys"], F.array(x["reg"]))))
            .otherwise(s)
        )

    numbered = F.transform("steps", lambda x, i: F.struct(x["op"].alias("op"), F.coalesce(x["reg"], F.lit("")).alias("reg"), x["value"].cast("string").alias("value"), F.coalesce(x["idle"], F.lit(False)).alias("idle"), i.alias("place")))
    folded = told.select(by, F.aggregate(numbered, start, go).alias("s"))
    n_keys = F.size("s.keys")
    end = (
        F.when(F.col("s.verdict").isNotNull(), F.col("s.verdict"))
        .when(~F.col("s.done") | (n_keys == 0), "INSUFFICIENT_EVIDENCE")
        .when(n_keys < KEYS, "VIOLATION")
        .otherwise("SUCCESS")
    )
    rule = F.when(F.col("s.verdict").isNotNull(), F.nullif(F.col("s.rule"), F.lit(""))).when(F.col("s.done") & (n_keys < KEYS), F.lit("C8"))
    return folded.select(by, end.alias("judgment"), rule.alias("contract"), F.col("s.at").alias("at_step"))
