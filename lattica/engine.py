"""Vertex programs of Column expressions and the bulk-synchronous loop that runs them over an active frontier."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.primitives import REDUCERS
from lattica.session import released, settled


#: Ids up to which a frontier is broadcast.
BROADCAST_IDS = 500_000


class Fields:
    """Columns of one role (source, destination or edge) by name: ``src.rank``, ``edge["w"]``."""

    def __init__(self, prefix: str):
        self._prefix = prefix

    def __getattr__(self, name: str) -> Column:
        return F.col(f"{self._prefix}{name}")

    __getitem__ = __getattr__


@dataclass
class VertexProgram:
    """What a vertex gathers, how it changes, and what it does to its edges.

    ``gather`` maps (src, edge, dst) to a value, reduced by ``reduce`` (a name or a function of a Column) with ``zero`` where there
    is no in-edge. ``apply`` maps (state, acc, iteration) to (new columns, changed). ``scatter`` maps (src, edge, dst) to new edge
    columns of the out-edges of changed vertices. ``idempotent`` says that gathering a value again changes nothing (min, max), so
    only changed sources need to be read. ``uses_dst`` says that gather looks at the destination.
    """

    apply: Callable[[Fields, Column | None, int], tuple[dict[str, Column], Column]]
    gather: Callable[[Fields, Fields, Fields], Column] | None = None
    reduce: str | Callable[[Column], Column] = "sum"
    zero: object = None
    scatter: Callable[[Fields, Fields, Fields], dict[str, Column]] | None = None
    idempotent: bool = False
    uses_dst: bool = False


@dataclass
class Engine:
    """The loop: gather and apply on active vertices, then activate the out-neighbours of changed ones.

    Edges are dealt by src once, sorted and kept; a step joins them with the state without moving or sorting them. Each step's state is written to
    the shared folder, once a step, and read back: its lineage ends there, so plans stay small and a lost executor costs no earlier
    step; the state before is deleted. A frontier below ``sparse`` of the vertices filters the edges by a broadcast of its ids if they
    are no more than ``BROADCAST_IDS``. Else all edges are read, and one aggregation tells what a vertex gathers and whether it is active.
    """

    graph: Graph
    program: VertexProgram
    state: DataFrame  # id and the state columns
    sparse: float = 0.1
    partitions: int | None = None
    iteration: int = 0
    frontier_sizes: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        n = self.partitions or int(self.graph.spark.conf.get("spark.sql.shuffle.partitions"))
        self.columns = [c for c in self.state.columns if c != "id"]
        self._n = n
        self.edges = self._dealt(self.graph.edges)
        self._all = self.state.count()
        self._spare: list[DataFrame] = []
        self._hold(self.state.withColumns({"_active": F.lit(False), "_changed": F.lit(False)}))

    def _dealt(self, edges: DataFrame) -> DataFrame:
        """Edges by src in the order of src: joins with the state neither move nor sort them again."""
        kept = edges.repartition(self._n, "src").sortWithinPartitions("src").persist()
        kept.count()  # how they lie is known to later plans once they are made
        return kept

    def _hold(self, state: DataFrame) -> None:
        """Keep the new state and count what is active and changed in it."""
        before, self.state = self.state, settled(state, "state")
        released(before)
        self.n_active, self.n_changed = self.state.agg(F.count_if("_active"), F.count_if("_changed")).first()

    def set_active(self, start: int | DataFrame, end: int | None = None) -> None:
        """Activate the ids start .. end-1, or those of a DataFrame (id)."""
        if isinstance(start, DataFrame):
            chosen = start.select("id").distinct().withColumn("_set", F.lit(True))
            state = self.state.drop("_active").join(chosen, "id", "left").withColumn("_active", F.coalesce("_set", F.lit(False))).drop("_set")
        else:
            state = self.state.withColumn("_active", F.col("id").between(start, end - 1))
        self._hold(state.withColumn("_changed", F.lit(False)).select("id", *self.columns, "_active", "_changed"))

    def count_active(self) -> int:
        return self.n_active

    def _role(self, prefix: str, key: str, where: str | None = None) -> DataFrame:
        rows = self.state.filter(where) if where else self.state
        flag = [F.col("_changed").alias("_sc")] if prefix == "s_" else []
        return rows.select(F.col("id").alias(key), *flag, *(F.col(c).alias(f"{prefix}{c}") for c in self.columns))

    def _changed_ids(self) -> DataFrame:
        """(src) of the changed vertices, broadcast if they are few."""
        ids = self.state.filter("_changed").select(F.col("id").alias("src"))
        return F.broadcast(ids) if self.n_changed <= BROADCAST_IDS else ids

    def gathered(self, changed_only: bool = False) -> DataFrame:
        """(id, acc) of the vertices that have something to gather."""
        e = self.edges
        if not changed_only and self.n_active < self.sparse * self._all:
            e = e.join(self.state.filter("_active").select(F.col("id").alias("dst")), "dst", "left_semi")
        return self._reduced(e, "_changed" if changed_only else None)

    def _reduced(self, e: DataFrame, where: str | None = None, *more: Column) -> DataFrame:
        """(id, _acc) of what edges ``e`` bring, of sources ``where``; ``more`` aggregates see the source's flag as _sc."""
        p = self.program
        e = e.select("src", "dst", *(F.col(c).alias(f"e_{c}") for c in e.columns if c not in ("src", "dst")))
        source = self._role("s_", "src", where)
        e = e.join(F.broadcast(source) if where == "_changed" and self.n_changed <= BROADCAST_IDS else source, "src")
        if p.uses_dst:
            e = e.join(self._role("d_", "dst"), "dst")
        value = p.gather(Fields("s_"), Fields("e_"), Fields("d_"))
        reduce = REDUCERS[p.reduce] if isinstance(p.reduce, str) else p.reduce
        return e.select(F.col("dst").alias("id"), value.alias("_v"), "_sc").groupBy("id").agg(reduce(F.col("_v")).alias("_acc"), *more)

    def _received(self) -> DataFrame:
        """(id[, _acc]) of the vertices that a changed one leads to: the next frontier."""
        few = self.n_changed < self.sparse * self._all
        if few or self.program.gather is None:
            hit = self.edges.join(self._changed_ids(), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
            if self.program.gather is None:
                return hit
            self._spare.append(settled(hit, "frontier"))
            hit = self._spare[-1]
            if hit.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
                return F.broadcast(self._reduced(self.edges.join(F.broadcast(hit.select(F.col("id").alias("dst"))), "dst", "left_semi")))
        return self._reduced(self.edges, None, F.bool_or("_sc").alias("_hit")).filter("_hit").drop("_hit")

    def _applied(self, state: DataFrame, acc: Column | None) -> DataFrame:
        """New state of active vertices; the others keep theirs."""
        new, changed = self.program.apply(Fields(""), acc, self.iteration)
        on = F.col("_active")
        cols = [F.when(on, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in self.columns]
        return state.select("id", *cols, "_active", (on & F.coalesce(changed, F.lit(False))).alias("_changed"))

    def gather_apply(self, have_gather: bool = True) -> None:
        state, acc = self.state, None
        if have_gather and self.program.gather is not None:
            state = state.join(self.gathered(), "id", "left")
            acc = F.col("_acc") if self.program.zero is None else F.coalesce("_acc", F.lit(self.program.zero))
        self._hold(self._applied(state, acc))

    def scatter_activate(self, scatter: bool = True) -> None:
        """Update out-edges of changed vertices if the program scatters, and make their ends the next frontier."""
        p = self.program
        if scatter and p.scatter is not None:
            own = [c for c in self.edges.columns if c not in ("src", "dst")]
            e = self.edges.select("src", "dst", *(F.col(c).alias(f"e_{c}") for c in own))
            e = e.join(self._role("s_", "src").withColumn("_ch", F.lit(True)).join(self.state.filter("_changed").select(F.col("id").alias("src")), "src", "left_semi"), "src", "left")
            e = e.join(self._role("d_", "dst"), "dst")
            new = p.scatter(Fields("s_"), Fields("e_"), Fields("d_"))
            on = F.coalesce("_ch", F.lit(False))
            e = e.select("src", "dst", *((F.when(on, new[c]).otherwise(F.col(f"e_{c}")) if c in new else F.col(f"e_{c}")).alias(c) for c in own))
            old, self.edges = self.edges, self._dealt(settled(e, "edges"))
            old.unpersist()
        if self.n_changed:
            hit = self.edges.join(self._changed_ids(), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
            self._next = self.state.drop("_active").join(hit.withColumn("_hit", F.lit(True)), "id", "left").withColumn("_active", F.coalesce("_hit", F.lit(False))).drop("_hit")
        else:
            self._next = self.state.withColumn("_active", F.lit(False))

    def next_iter(self) -> None:
        self.iteration += 1
        self._hold(self._next.withColumn("_changed", F.lit(False)).select("id", *self.columns, "_active", "_changed"))

    def run(self, max_iter: int = 10_000) -> DataFrame:
        """Step until nothing is active; the state."""
        return self._run_changed(max_iter) if self.program.idempotent and self.program.scatter is None else self._run_full(max_iter)

    def _run_full(self, max_iter: int) -> DataFrame:
        return self._run_joined(max_iter) if self.program.scatter is None else self._run_steps(max_iter)

    def _run_joined(self, max_iter: int) -> DataFrame:
        """As ``_run_steps``, with one join of the edges and one written state a step: who is active is found while its messages are."""
        p, first = self.program, True
        while self.n_active if first else self.n_changed:
            self._bound(max_iter)
            if first:
                state = self.state if p.gather is None else self.state.join(self.gathered(), "id", "left")
            else:
                state = self.state.drop("_active").join(self._received().withColumn("_active", F.lit(True)), "id", "left").withColumn("_active", F.coalesce("_active", F.lit(False)))
            acc = None if p.gather is None else F.col("_acc") if p.zero is None else F.coalesce("_acc", F.lit(p.zero))
            self._hold(self._applied(state, acc))
            released(*self._spare)
            self._spare.clear()
            if self.n_active:
                self.frontier_sizes.append(self.n_active)
                self.iteration += 1
            first = False
        return self.results()

    def _run_steps(self, max_iter: int) -> DataFrame:
        """The steps one by one, for programs that change edges."""
        while self.count_active():
            self._bound(max_iter)
            self.frontier_sizes.append(self.n_active)
            self.gather_apply()
            self.scatter_activate()
            self.next_iter()
        return self.results()

    def _run_changed(self, max_iter: int) -> DataFrame:
        """As ``_run_full``, a join and an aggregation a step: messages of changed vertices are at once the activation of their
        receivers and what these gather, since what unchanged sources have to say has been gathered before."""
        acc = F.coalesce("_acc", F.lit(self.program.zero)) if self.program.zero is not None else F.col("_acc")
        first = True
        while self.n_active:
            self._bound(max_iter)
            if first:
                self.frontier_sizes.append(self.n_active)
                state = self.state.join(self.gathered(), "id", "left")
                first = False
            else:
                state = self.state.drop("_active").join(self.gathered(changed_only=True).withColumn("_active", F.lit(True)), "id", "left").withColumn("_active", F.coalesce("_active", F.lit(False)))
            self._hold(self._applied(state, acc))
            if len(self.frontier_sizes) <= self.iteration and self.n_active:
                self.frontier_sizes.append(self.n_active)
            self.iteration += 1
            if not self.n_changed:
                break
        return self.results()

    def _bound(self, max_iter: int) -> None:
        if self.iteration >= max_iter:
            raise RuntimeError(f"still active after {max_iter} iterations")

    def results(self) -> DataFrame:
        return self.state.select("id", *self.columns)

    def close(self) -> None:
        """Let go of what is kept; results must have been written or read before."""
        self.edges.unpersist()
        released(self.state)
