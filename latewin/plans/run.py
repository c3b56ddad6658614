"""One run of a mechanism over a disordered stream, as a chain of stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewin.operators import lifecycle as lc
from latewin.operators.lateness import (
    adaptive_budget,
    adaptive_watermark,
    observe_lateness,
)
from latewin.operators.windows import (
    KEYS,
    combine,
    finish,
    window_aggregate,
    windows_of_panes,
)
from latewin.plans import mechanisms as m
from latewin.schema import Mechanism, WindowConfig
from latewin.session import stage

LEAN = (
    "n",
    "event_time",
    *KEYS,
    "value",
    "max_event_time",
    "lateness",
    "budget",
    "watermark",
    "watermark_before",
)


class Run:
    """Tables of a run, each built once on first use.

    ``events`` needs n, event_time, device_id, sensor and value. ``obs`` are the
    lateness observations, ``timed`` adds budget and watermark, ``cycles`` are
    the eviction cycles with their guards and ``keys`` the window keys with
    their transitions.
    """

    def __init__(
        self,
        events: DataFrame,
        mech: Mechanism,
        cfg: WindowConfig = WindowConfig(),
        by: Sequence[str] = (),
        horizon: int | None = None,
        observed: bool = False,
        lean: bool = False,
    ):
        """With ``observed`` the events already are stored observations; with ``lean`` an
        adaptive ``timed`` stores only the columns that the life of the keys is read from."""
        self.events, self.mech, self.cfg, self.lean = events, mech, cfg, lean
        self.by, self.horizon = list(by), horizon
        if observed:
            self.obs = events

    @cached_property
    def obs(self) -> DataFrame:
        if "arrival_rate" in self.events.columns:
            return stage(self.events, "observations")
        return stage(observe_lateness(self.events, self.by), "observations")

    @cached_property
    def timed(self) -> DataFrame:
        """Observations with budget and watermark, stored once for all that read them."""
        if self.mech.budget != "adaptive":
            return m.with_watermark(self.obs, self.mech, self.by)
        policy = self.mech.lateness
        # Stored, so that the join knows whether the budgets are small enough to send around.
        budgets = stage(adaptive_budget(self.obs, policy, self.by), "budgets")
        timed = adaptive_watermark(self.obs, budgets, policy, self.by)
        return stage(timed.select(*self.by, *LEAN) if self.lean else timed, "timed")

    @cached_property
    def cycles(self) -> DataFrame | None:
        if self.mech.guard is None:
            return None
        return stage(lc.guard_series(self.timed, self.mech.guard, self.by), "cycles")

    @cached_property
    def panes(self) -> DataFrame:
        """The events reduced to panes, those behind the watermark apart."""
        return stage(lc.arrival_panes(self.timed, self.cfg, self.by), "panes")

    @cached_property
    def late_groups(self) -> DataFrame:
        """The panes behind the watermark, cut where their windows were released."""
        if self.mech.guard is None:
            return lc.uncut(self.panes)
        return stage(
            lc.late_groups(self.timed, self.keys, self.cfg, self.by, self.panes), "late-groups"
        )

    @cached_property
    def keys(self) -> DataFrame:
        """The key table; the search for late-opened keys runs only if there are any."""
        guard = self.mech.guard
        if self.mech.budget == "none":
            reach = lc.never_reached(self.obs, self.by)
        else:
            reach = stage(
                lc.reach_table(
                    self.timed, self.cfg, self.cycles, self.by, self.horizon, self.panes
                ),
                "reach",
            )
        keys = lc.lifecycle_keys(
            self.timed, reach, self.cfg, self.by, self.horizon, self.panes
        )
        keys = stage(keys, "keys")
        search = (
            guard is not None
            and guard.policy == "adaptive"
            and bool(keys.filter(lc.opened_behind()).limit(1).count())
        )
        released = lc.with_release(keys, guard, self.cycles, self.by, search)
        return stage(released, "released") if search else released

    @property
    def late(self) -> DataFrame:
        return lc.late_categories(
            self.timed, self.keys, self.cfg, self.by, self.panes, self.late_groups
        )

    @property
    def totals(self) -> DataFrame:
        return lc.tier_totals(self.keys, self.by)

    @property
    def snapshot(self) -> DataFrame:
        return m.run_snapshot(self.timed, self.keys, self.cfg, self.by, self.late)

    @property
    def _plain(self) -> DataFrame:
        return self.__dict__.get("obs", self.events)

    @property
    def held(self) -> DataFrame:
        """Rows of a mechanism without release, with tier, opened and archived; with accounting
        also the accounting cycles that find each summary held."""
        if self.mech.guard is not None:
            raise ValueError("summaries are released under a guard; see result_by_tier")
        rows = m.held_result(self.keys, self.cfg, self.by)
        if not self.mech.accounting:
            return rows
        last = self.timed.groupBy(*self.by).agg(F.max("n").alias("last_n"))
        return m.with_accounted_cycles(rows, last, self.mech.cycle_events, self.by)

    @property
    def result(self) -> DataFrame:
        """Everything except pairs that met a released window.

        Without a guard nothing can be lost, so the lifecycle is not derived; see ``held``.
        """
        if self.mech.guard is None and "panes" not in self.__dict__:
            return window_aggregate(self._plain, self.cfg, by=self.by)
        if self.mech.guard is None:
            whole = combine(self.panes, ["start", *self.by, *KEYS])
            return finish(windows_of_panes(whole, self.cfg, [*self.by, *KEYS]), self.cfg, by=self.by)
        partials = lc.surviving_partials(
            self.timed, self.keys, self.cfg, self.by, self.panes, self.late_groups
        )
        return finish(partials, self.cfg, by=self.by)
