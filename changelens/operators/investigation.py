"""A-05 and A-10: an investigation's providers within a global cap, and source spans within a token budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.storage import kept
from changelens.operators.rank import merged_spans

# The providers of each goal, in turn.
GOALS = {
    "debug": ["LocalSlice", "Callees", "Callers", "Implementations"],
    "trace": ["Flow", "Callees"],
    "impact": ["Impact", "Callers"],
    "understand": ["Members", "Callees", "Callers", "Implementations"],
}
#: Members of the root whose other providers run too, when the goal is to understand it.
MEMBERS = 5


@dataclass(frozen=True)
class Windows:
    """How many rows a provider gives at first, each time it is read on, and in all."""

    initial: int = 8
    expansion: int = 16
    most: int = 64


def window_of(n: Column, windows: Windows) -> Column:
    """The window, from 0, in which a provider's row ``n`` (from 1) comes."""
    return F.when(n <= windows.initial, 0).otherwise(F.ceil((n - windows.initial) / windows.expansion)).cast("int")


def pulled(rows: DataFrame, order: list[str], available: int, windows: Windows, first_only: bool = False) -> tuple[DataFrame, int, str]:
    """The next rows of a provider with ``nth`` and ``window``, their number, and the state: complete, partial or global_cap.

    Windows read on from where the one before ended, so what they give together
    is the beginning of the provider's order; one limit finds it, of at most
    ``windows.most`` rows and one that tells whether there are more.
    """
    most = min(windows.initial if first_only else windows.most, max(1, available))
    keys = F.struct(*order)
    top = rows.orderBy(*order).limit(most + 1)
    listed = top.agg(F.array_sort(F.collect_list(F.struct(keys.alias("k"), F.struct(*rows.columns).alias("r")))).alias("all"))
    each = kept(listed.select(F.posexplode("all").alias("nth", "x")).select("x.r.*", (F.col("nth") + 1).alias("nth")))  # ``most`` + 1 rows
    n = each.count()
    got = min(n, most)
    state = "complete" if n <= most else "partial"
    if got > available or (got == available and state == "partial"):
        state = "global_cap"
    return each.where(F.col("nth") <= got).withColumn("window", window_of(F.col("nth"), windows)), got, state


def investigate(goal: str, providers: dict[str, DataFrame], most: int, order: list[str], windows: dict[str, Windows] | None = None, of_members: dict[str, DataFrame] | None = None) -> tuple[DataFrame, list[tuple[str, str, str | None, int]]]:
    """A-05: rows of the goal's providers in turn, ``most`` in all, with provider, nth and window; and (provider, state, reason, found) of each.

    ``order`` names columns without nulls that order a provider's rows. A trace
    ends with the first provider if it gives a flow. To understand a symbol, the
    first members' own rows follow (``of_members``: provider to rows with
    ``member``, the member's id), a first window of each. A provider that is
    left out of ``providers`` does not exist here.
    """
    out, states, total = None, [], 0
    plan = [p for p in GOALS[goal] if p in providers]

    def add(name: str, rows: DataFrame, first_only: bool = False) -> tuple[DataFrame, int]:
        nonlocal out, total
        got, n, state = pulled(rows, order, most - total, (windows or {}).get(name, Windows()), first_only)
        got = got.withColumn("provider", F.lit(name)).withColumn("turn", F.lit(len(states)))
        out = got if out is None else out.unionByName(got)
        total += n
        states.append((name, "partial", "global_cap", total) if state == "global_cap" else (name, state, None, n))
        return got, n

    for i, name in enumerate(plan):
        if total >= most:
            states += [(p, "not_run", "global_cap", 0) for p in plan[i:]]
            break
        got, n = add(name, providers[name])
        if goal == "trace" and name == "Flow" and n:
            states += [(p, "not_run", "early_stop", 0) for p in plan[i + 1 :]]
            break
        if goal == "understand" and name == "Members":
            members = [r["id"] for r in got.where(F.col("nth") <= MEMBERS).orderBy("nth").select("id").collect()]  # five
            for m in members:
                for other in plan[1:]:
                    if total >= most:
                        states.append((other, "not_run", "global_cap", 0))
                    else:
                        add(other, (of_members or {})[other].where(F.col("member") == m).drop("member"), True)
            break
    return out, states


def span_requests(candidates: DataFrame) -> DataFrame:
    """file, start, end, priority, id of candidates (id, file, line, start_line, end_line, depth, is_local): scopes of symbols; 0 for local evidence, 1 next to the root, 2 else."""
    start = F.coalesce("start_line", "line")
    priority = F.when(F.col("is_local"), 0).when(F.col("depth") <= 1, 1).otherwise(2)
    return candidates.where(start.isNotNull()).select("file", start.alias("start"), F.greatest(start, F.coalesce("end_line", "line")).alias("end"), priority.alias("priority"), "id")


def merged_requests(requests: DataFrame, gap: int = 2) -> DataFrame:
    """A-10: requests of a file merged where at most ``gap`` lines lie between: file, start, end, priority (the least), ids."""
    islands = merged_spans(requests.select("file", "start", "end"), gap).select("file", F.col("start").alias("lo"), F.col("end").alias("hi"))
    # The island of a request is the one with the last beginning before it: a merge of both by file and line.
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, 0)
    no = F.lit(None)
    both = islands.select("file", F.col("lo").alias("at"), F.lit(0).alias("n"), F.struct("lo", "hi").alias("island"), no.cast("int").alias("priority"), no.cast("string").alias("id")).unionByName(
        requests.select("file", F.col("start").alias("at"), F.lit(1).alias("n"), no.cast(islands.select(F.struct("lo", "hi")).schema[0].dataType).alias("island"), F.col("priority").cast("int"), F.col("id").cast("string"))
    )
    named = both.withColumn("island", F.last("island", True).over(w)).where("n = 1")
    return named.groupBy("file", F.col("island.lo").alias("start"), F.col("island.hi").alias("end")).agg(F.min("priority").alias("priority"), F.array_sort(F.collect_set("id")).alias("ids"))


def span_cost(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(chars / 4)).cast("long")


def spans_within(spans: DataFrame, budget: int, batch: int = 1000) -> DataFrame:
    """A-10: ``spans`` (file, start, priority, cost) that a budget takes, in the order of priority, file and start, with ``used``.

    A span that does not fit is passed over. Where spans of priority 0 or 1
    exist, a fourth of the budget, 64 at most, is kept from the others. The
    driver reads the next ``batch`` of the spans that fit into what is left; each
    batch takes one at least, so the budget bounds the batches.
    """
    focused = not spans.where("priority < 2").isEmpty()
    reserve = min(budget // 4, 64) if focused else 0
    keyed = kept(spans.withColumn("place", F.struct("priority", "file", "start")))
    taken, used, last = [], 0, None
    while True:
        room = budget - used
        rest = keyed.where(F.col("cost") <= F.lit(room) - F.when(F.col("priority") >= 2, reserve).otherwise(0))
        if last is not None:
            rest = rest.where(F.col("place") > F.struct(*[F.lit(v).alias(n) for n, v in last.asDict().items()]).cast(keyed.schema["place"].dataType))
        rows = rest.orderBy("place").limit(batch).select("place", "cost").collect()  # a batch
        if not rows:
            break
        for r in rows:
            if r["cost"] <= budget - used - (reserve if r["place"]["priority"] >= 2 else 0):
                used += r["cost"]
                taken.append((r["place"]["priority"], r["place"]["file"], r["place"]["start"], used))
        last = rows[-1]["place"]
    chosen = spans.sparkSession.createDataFrame(taken, f"priority int, file string, start {spans.schema['start'].dataType.simpleString()}, used long")
    return spans.join(F.broadcast(chosen), ["priority", "file", "start"])  # ``budget`` rows at most
