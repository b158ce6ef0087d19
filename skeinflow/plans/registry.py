"""Named datasets with declared inputs, materialised in dependency order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from skeinflow.operators.quality import ExpectationError


@dataclass(frozen=True)
class Dataset:
    name: str
    layer: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    view: bool


@dataclass
class Built:
    """What a run did: the tables by name, and the messages of what failed or was left out for it."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)


class Registry:
    """Datasets by name. ``make`` gets the session and the tables of its inputs, in order."""

    def __init__(self) -> None:
        self.datasets: dict[str, Dataset] = {}

    def dataset(self, layer: str, *inputs: str, view: bool = False) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        """Registers a function under its name; a view isn't written."""

        def add(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.datasets[make.__name__] = Dataset(make.__name__, layer, inputs, make, view)
            return make

        return add

    def order(self, targets: Iterable[str] | None = None) -> list[str]:
        """The targets and all they need, inputs first; unknown names and cycles raise."""
        graph: dict[str, tuple[str, ...]] = {}
        todo = list(targets if targets is not None else self.datasets)
        while todo:
            name = todo.pop()
            if name not in self.datasets:
                raise KeyError(f"no dataset {name!r}")
            if name not in graph:
                graph[name] = self.datasets[name].inputs
                todo += graph[name]
        return list(TopologicalSorter(graph).static_order())

    def build(self, spark: SparkSession, root: str, targets: Iterable[str] | None = None) -> Built:
        """Writes each dataset to ``root``/layer/name and reads it back for those that need it.

        A dataset that fails takes only its dependants with it; the rest goes on.
        """
        done = Built()
        for name in self.order(targets):
            d = self.datasets[name]
            missing = [i for i in d.inputs if i not in done.tables]
            if missing:
                done.failed[name] = f"left out: {', '.join(missing)} failed"
                continue
            try:
                df = d.make(spark, *[done.tables[i] for i in d.inputs])
                if not d.view:
                    path = f"{root}/{d.layer}/{name}"
                    df.write.mode("overwrite").parquet(path)
                    df = spark.read.schema(df.schema).parquet(path)
                done.tables[name] = df
            except (ExpectationError, ValueError) as error:
                done.failed[name] = str(error)
            except Exception as error:  # noqa: BLE001  a task's failure arrives as a JVM error of any class
                done.failed[name] = str(error).splitlines()[0][:300]
        return done


def market(sf_dir: str) -> Registry:
    """The medallion of the plans over a directory of the synthetic tables."""
    from skeinflow.plans import dims, fixtures, fundamentals, panel, prices, sentiment

    reg = Registry()

    @reg.dataset("raw")
    def bars(spark):
        return fixtures.daily_bars(spark, sf_dir)

    @reg.dataset("silver")
    def articles(spark):
        return fixtures.scored(spark, sf_dir)

    @reg.dataset("silver", "bars")
    def price_table(spark, bars):
        return prices.price_features(bars)

    @reg.dataset("silver")
    def fundamentals_table(spark):
        return fundamentals.trailing(fundamentals.joined_statements(*fixtures.statements(spark, sf_dir)))

    @reg.dataset("gold")
    def dim_date(spark):
        return dims.dim_date(spark)

    @reg.dataset("gold")
    def dim_company(spark):
        return dims.dim_company(spark, sf_dir)

    @reg.dataset("gold")
    def embedding_facts(spark):
        return fixtures.embedding_facts(spark, sf_dir)

    @reg.dataset("gold", "dim_date", "dim_company", "articles")
    def sentiment_facts(spark, days, companies, rows):
        return sentiment.sentiment_grid(days, companies, sentiment.news_daily(rows), sentiment.press_daily(rows), sentiment.filings_daily(rows))

    @reg.dataset("gold", "price_table", "fundamentals_table", "sentiment_facts", "embedding_facts", "dim_company")
    def panel_facts(spark, p, f, s, e, c):
        return panel.feature_panel(p, f, s, e, c, [r.sector_name for r in dims.dim_sector(spark, sf_dir).orderBy("sector_name").collect()])

    return reg
