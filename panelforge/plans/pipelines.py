"""The three user flows: factor selection, strategy back-test, timing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import evaluate as E
from ..operators import factors as Fa
from ..operators import portfolio as P
from ..sources.panels import restricted, warm_up


@dataclass
class SelectionPipeline:
    """Bars -> features -> evaluation of each factor on rebalance dates; rows before ``start`` only warm windows up."""

    bars: DataFrame
    start: str | None = None
    end: str | None = None
    rebalance: str = "none"
    factors: list[str] = field(default_factory=list)
    registry: Fa.Registry = Fa.REGISTRY

    def add(self, *names: str) -> SelectionPipeline:
        """Adds factors; ``alpha158_all`` stands for all 158."""
        for n in names:
            self.factors += [f for f in self.registry.names() if f.startswith("alpha158_")] if n == "alpha158_all" else [n]
        return self

    def signal_dates(self) -> DataFrame:
        inside = restricted(self.bars, start=self.start, end=self.end)
        return A.calendar(inside if self.rebalance == "none" else A.resample(inside, self.rebalance))

    def exposures(self) -> DataFrame:
        inside = restricted(self.bars, start=self.start, end=self.end)
        rows = inside if self.start is None else warm_up(self.bars, self.start).unionByName(inside)
        return self.registry.generate(A.dense_grid(rows), self.factors).join(self.signal_dates(), "dt", "left_semi")

    def run(self, q: int = 5) -> dict[str, dict]:
        dates = self.signal_dates()
        returns = E.rebalance_returns(restricted(self.bars, start=self.start, end=self.end), dates)
        both = self.exposures().join(returns, ["dt", "symbol"]).persist()
        try:
            return {f: E.factor_report(both.select("dt", "symbol", F.col(f).alias("factor"), "fwd_ret").where("factor IS NOT NULL"), self.rebalance, q) for f in self.factors}
        finally:
            both.unpersist()


@dataclass
class StrategyPipeline:
    """Signals -> top-k weights -> simulation -> figures."""

    bars: DataFrame
    signals: DataFrame
    k: int = 5
    least: float = 0.0
    capital: float = 1_000_000.0
    commission: float = 0.001
    slippage: float = 0.001

    def run(self) -> dict[str, DataFrame]:
        price = "adj_close" if "adj_close" in self.bars.columns else "close"
        grid = A.dense_grid(self.bars).join(self.signals.select("dt", "symbol", "signal"), ["dt", "symbol"], "left")
        weights = P.top_k_weights(grid, k=self.k, least=self.least)
        sim = P.simulate(weights, self.bars, price, self.capital, self.commission, self.slippage)
        return {"signals": self.signals, "weights": weights, "daily": sim.daily, "trades": sim.trades, "positions": sim.positions, "stats": P.performance(sim.daily)}


@dataclass
class TimingPipeline:
    """Each timing factor over all symbols in one pass."""

    bars: DataFrame
    factors: list[str] = field(default_factory=lambda: ["ma_cross_timing", "rsi_timing"])

    def run(self) -> dict[str, DataFrame]:
        out = {}
        for name in self.factors:
            make = Fa.REGISTRY.get(name)
            signals = make(self.bars).select("dt", "symbol", "signal") if name == "rsi_timing" else self.bars.select("dt", "symbol", make().alias("signal"))
            out[name] = P.timing_summary(signals, self.bars)
        return out
