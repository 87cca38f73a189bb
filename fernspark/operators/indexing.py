"""The indexing pipeline: a builder over a DataFrame of nodes. Nothing runs before :meth:`IndexingPipeline.run`."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fernspark import schema
from fernspark.operators import nodes as N


class PipelineError(RuntimeError):
    """A strict run met a row with an error."""


@dataclass
class Stats:
    """Counters of a run."""

    processed: int = 0
    failed: int = 0
    stored: int = 0
    seconds: float = 0.0

    @property
    def per_second(self) -> float | None:
        return self.processed / self.seconds if self.seconds and self.processed else None


@dataclass(frozen=True)
class IndexingPipeline:
    """Each step returns a new pipeline. Rows carry failures in ``error``; steps leave such rows as they are."""

    df: DataFrame
    client: Any = None
    sinks: tuple = ()
    concurrency: int | None = None
    stats: Stats = field(default_factory=Stats)

    @staticmethod
    def from_loader(loader: Callable[[], DataFrame]) -> IndexingPipeline:
        return IndexingPipeline(loader())

    def _with(self, df: DataFrame, **more: Any) -> IndexingPipeline:
        return replace(self, df=df, **more)

    def with_default_client(self, client: Any) -> IndexingPipeline:
        """The model that steps take which are given as functions of a model."""
        return replace(self, client=client)

    def with_concurrency(self, n: int) -> IndexingPipeline:
        """Deals the rows to ``n`` partitions, so that so many tasks can work on them."""
        return self._with(self.df.repartition(n), concurrency=n)

    def with_embed_mode(self, mode: str) -> IndexingPipeline:
        if mode not in schema.EMBED_MODES:
            raise ValueError(f"embed modes are {schema.EMBED_MODES}")
        return self._with(self.df.withColumn("embed_mode", F.lit(mode)))

    def then(self, stage: N.Stage) -> IndexingPipeline:
        """A row for a row."""
        return self._with(stage(self.df))

    def then_with_client(self, make: Callable[[Any], N.Stage], client: Any = None) -> IndexingPipeline:
        """A step that needs a model: its own, or the pipeline's."""
        model = client or self.client
        if model is None:
            raise ValueError("the step has no model and the pipeline no default")
        return self._with(make(model)(self.df))

    def then_in_batch(self, f: Callable[[pd.DataFrame], pd.DataFrame], batch_size: int = 256) -> IndexingPipeline:
        """Rows for rows, in pandas batches of at most ``batch_size``; rows with an error pass by."""
        df = self.df

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in range(0, len(b), batch_size):
                    yield f(b.iloc[i : i + batch_size])

        done = df.where("error is null").mapInPandas(run, df.schema)
        return self._with(done.unionByName(df.where("error is not null")))

    def then_chunk(self, stage: N.Stage) -> IndexingPipeline:
        """Rows for a row."""
        return self._with(stage(self.df))

    then_expand = then_chunk

    def filter(self, keep: Column | str) -> IndexingPipeline:
        """Keeps rows, those with errors too, where the condition is true."""
        return self._with(self.df.where(keep))

    def filter_errors(self) -> IndexingPipeline:
        return self._with(self.df.where("error is null"))

    def filter_cached(self, cache: Any) -> IndexingPipeline:
        """Drops nodes that the cache has and repeats among the rest, and marks the others as cached, before they are processed."""
        return self._with(cache.filter(self.df))

    def split_by(self, test: Column) -> tuple[IndexingPipeline, IndexingPipeline]:
        """Two pipelines: where the test is true, and the rest, nulls included."""
        yes = F.coalesce(test, F.lit(False))
        return self._with(self.df.where(yes)), self._with(self.df.where(~yes))

    def merge(self, other: IndexingPipeline) -> IndexingPipeline:
        """Both pipelines' rows and sinks; other settings are this one's."""
        return self._with(self.df.unionByName(other.df, allowMissingColumns=True), sinks=tuple(dict.fromkeys([*self.sinks, *other.sinks])))

    def then_store_with(self, sink: Any) -> IndexingPipeline:
        """Rows without errors go to the sink when the pipeline runs, and on to the next step."""
        return replace(self, sinks=(*self.sinks, (sink, self.df)))

    def throttle(self, seconds: float) -> IndexingPipeline:
        """A batch has no rate, and a stream is limited where it starts: see ``loaders.records``. Here it changes nothing and says so."""
        warnings.warn("throttle changes nothing in a batch", stacklevel=2)
        return self

    def log(self, name: str = "nodes") -> tuple[IndexingPipeline, Observation]:
        """Counts rows and errors on their way; the observation has them after an action."""
        seen = Observation(name)
        return self._with(self.df.observe(seen, F.count("*").alias("nodes"), F.count_if(F.col("error").isNotNull()).alias("errors"))), seen

    def run(self, strict: bool = True) -> Stats:
        """Sets up every sink once, stores, and counts. In a strict run an error in the last step's rows raises, before anything is stored there."""
        began = time.monotonic()
        for sink in {id(s): s for s, _ in self.sinks}.values():
            sink.setup(self.df.sparkSession)
        # What each sink gets is kept, those further up too, so that steps before a sink run once and later steps go on from what was stored.
        inputs = list({id(rows): rows for _, rows in self.sinks}.values())
        held = [d.persist() for d in ([*inputs, self.df] if self.sinks and all(d is not self.df for d in inputs) else inputs)]
        try:
            total, failed, message = self.df.agg(F.count("*"), F.count_if(F.col("error").isNotNull()), F.first("error", ignorenulls=True)).first()
            if strict and failed:
                raise PipelineError(message)
            stored = 0
            for sink, rows in self.sinks:
                stored += sink.store(rows.where("error is null"))
        finally:
            for d in held:
                d.unpersist()
        self.stats.processed, self.stats.failed, self.stats.stored, self.stats.seconds = total, failed, stored, time.monotonic() - began
        return self.stats
