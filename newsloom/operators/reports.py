"""Reports over finished runs: score tables, comparisons, summaries, roll-ups, run steps and settings."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import writers
from . import quality


def check_name(name: str) -> str:
    """The name of a variant, if it has only letters, digits, `_`, `.` and `-`; names become parts of paths."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
        raise ValueError(f"not a name for a variant: {name!r}")
    return name


def upsert(old: DataFrame | None, new: DataFrame, key: str = "variant") -> DataFrame:
    """The old rows but for those of variants that come again, and the new rows."""
    return new if old is None else old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def comparison(phi: tuple[DataFrame, DataFrame], tops: tuple[DataFrame, DataFrame], attention: tuple[DataFrame, DataFrame], tolerance: float = 1e-6) -> DataFrame:
    """measure, baseline, candidate, mean, median, least of a baseline and a candidate model.

    'diversity' of each; 'term_cosine' and 'attention_correlation' of the topics matched one
    to one by their terms; 'attention_gap': the largest and mean absolute difference of the
    attention of equal topics (`candidate` is 1 if the largest is within the tolerance).
    """
    none = F.lit(None).cast("double")
    matched = quality.matching(quality.cosines(*phi))
    sides = [quality.diversity(t).select(F.col("diversity").alias(n)) for t, n in zip(tops, ("baseline", "candidate"), strict=True)]
    diversity = sides[0].crossJoin(sides[1]).select(F.lit("diversity").alias("measure"), "baseline", "candidate", none.alias("mean"), none.alias("median"), none.alias("least"))
    renamed = attention[1].join(F.broadcast(matched.select(F.col("b").alias("topic"), "a")), "topic").select("date", F.col("a").alias("topic"), "theta")
    aligned = quality.agreement(attention[0], renamed)

    def spread(df: DataFrame, value: str, name: str) -> DataFrame:
        known = df.where(F.col(value).isNotNull() & ~F.isnan(value))
        return known.agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("least")).select(F.lit(name).alias("measure"), none.alias("baseline"), none.alias("candidate"), "mean", "median", "least")

    gap = quality.agreement(*attention).agg(F.max("max_gap").alias("baseline"), F.avg("mean_gap").alias("mean"))
    gap = gap.select(F.lit("attention_gap").alias("measure"), "baseline", (F.col("baseline") <= tolerance).cast("double").alias("candidate"), "mean", none.alias("median"), none.alias("least"))
    return diversity.unionByName(spread(matched, "cosine", "term_cosine")).unionByName(spread(aligned, "r", "attention_correlation")).unionByName(gap)


def pricing_summary(runs: Mapping[str, DataFrame], digits: int = 4) -> DataFrame:
    """One table of the summaries of pricing runs, `run` first, numbers rounded; columns a run lacks are null."""
    out = None
    for name, df in runs.items():
        one = df.select(F.lit(name).alias("run"), *(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no runs")
    return out


def roll_up(status: DataFrame) -> DataFrame:
    """done, kept, parts over the rows (done, kept) of a run's parts; a null `done` is not done."""
    return status.agg(F.coalesce(F.every(F.coalesce("done", F.lit(False))), F.lit(False)).alias("done"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), F.count("*").alias("parts"))


@dataclass(frozen=True)
class Settings:
    """Sizes of a run. Environment variables with these names in capitals, after NEWSLOOM_, go before the defaults."""

    topics: int = 60
    vocabulary: int = 15_000
    passages: int = 3
    factors: int = 3
    penalties: int = 12
    seed: int = 0

    @classmethod
    def load(cls, environment: Mapping[str, str] | None = None) -> Settings:
        known = os.environ if environment is None else environment
        given = {f.name: int(known[key]) for f in fields(cls) if (key := f"NEWSLOOM_{f.name.upper()}") in known}
        out = replace(cls(), **given)
        if any(getattr(out, f.name) < (f.name != "seed") for f in fields(cls)):
            raise ValueError("sizes must be positive")
        return out


@dataclass(frozen=True)
class Step:
    """A step of a run: what it makes, from what, and how."""

    name: str
    make: Callable[[], object]
    output: str
    inputs: Sequence[str] = ()


def run_steps(steps: Sequence[Step], settings: Settings, on_stale: str = "remake") -> list[str]:
    """Names of the steps that were run: those whose output is not there or was made from other inputs or settings.

    `on_stale='raise'` refuses to go on from such an output, so that results of two corpora
    are never mixed.
    """
    done = []
    for step in steps:
        key = writers.fingerprint({"step": check_name(step.name), **{f.name: getattr(settings, f.name) for f in fields(settings)}}, *step.inputs)
        manifest = Path(f"{step.output}.step.json")
        if Path(step.output).exists() and manifest.exists():
            if json.loads(manifest.read_text())["key"] == key:
                continue
            if on_stale == "raise":
                raise ValueError(f"{step.output} was made from other inputs or settings")
        manifest.unlink(missing_ok=True)
        step.make()
        writers.atomic_json(str(manifest), {"key": key})
        done.append(step.name)
    return done
