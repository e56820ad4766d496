"""Named processors and the profiles that chain them: DataFrame in, DataFrame out, one lazy plan."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Processor = Callable[..., DataFrame]
REGISTRY: dict[str, Processor] = {}


def processor(name: str) -> Callable[[Processor], Processor]:
    def register(f: Processor) -> Processor:
        REGISTRY[name] = f
        return f

    return register


@dataclass(frozen=True)
class Step:
    name: str
    params: dict = field(default_factory=dict)


def build(profile: str, profiles: dict[str, Sequence[Step]] | None = None, overrides: dict[str, dict] | None = None) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The chain of a profile; an unknown profile has the default's. overrides: parameters by processor, which win."""
    known = profiles or PROFILES
    chain = []
    for step in known.get(profile, known["default"]):
        if step.name not in REGISTRY:
            raise KeyError(f"no processor {step.name}")
        params = {**step.params, **(overrides or {}).get(step.name, {})}
        chain.append((step.name, lambda df, f=REGISTRY[step.name], p=params: f(df, **p)))
    return chain


def to_config(profiles: dict[str, Sequence[Step]] | None = None) -> str:
    """Profiles as JSON: pipelines by name, each with its processors and their parameters."""
    told = {name: {"processors": [{"id": s.name, "params": s.params} for s in steps]} for name, steps in (profiles or PROFILES).items()}
    return json.dumps({"pipelines": told}, indent=2, sort_keys=True)


def from_config(text: str | None) -> dict[str, Sequence[Step]]:
    """Profiles from such JSON. What can't be read gives none, so that the profiles at hand are used; a processor that isn't known is an error."""
    try:
        found = json.loads(text or "{}").get("pipelines", {})
        profiles = {name: tuple(Step(p["id"], dict(p.get("params") or {})) for p in pipeline.get("processors", ())) for name, pipeline in found.items()}
    except (ValueError, AttributeError, KeyError, TypeError):
        return {}
    if unknown := sorted({s.name for steps in profiles.values() for s in steps} - set(REGISTRY)):
        raise KeyError(f"no processor {', '.join(unknown)}")
    return profiles


def run(df: DataFrame, profile: str = "default", on_error: str = "raise", **kwargs) -> DataFrame:
    """Chains a profile's processors. on_error "skip": a processor whose plan can't be built is left out and noted in
    the column `skipped`; errors in rows are the processors' own."""
    skipped = []
    for name, step in build(profile, **kwargs):
        try:
            df = df.transform(step)
        except Exception:
            if on_error != "skip":
                raise
            skipped.append(name)
    return df.withColumn("skipped", F.array(*map(F.lit, skipped)).cast("array<string>")) if on_error == "skip" else df


#: What a row has in a column when a step is reached.
Of = Callable[[str], Column]


@dataclass(frozen=True)
class RowStep:
    """A step of rows: `problem` tells why a row fails it, null if it doesn't; `change` are the columns that it sets on the others."""

    name: str
    problem: Callable[..., Column]
    change: Callable[..., dict[str, Column]]


#: Row steps by name.
ROW_STEPS: dict[str, RowStep] = {}


def row_step(name: str, change: Callable[..., dict[str, Column]] = lambda c, **_: {}) -> Callable[[Callable[..., Column]], RowStep]:
    def register(problem: Callable[..., Column]) -> RowStep:
        ROW_STEPS[name] = RowStep(name, problem, change)
        return ROW_STEPS[name]

    return register


ERROR = "struct<step: string, reason: string>"


def run_rows(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """df with `error` (step, reason): null for rows that pass all steps, else the first step that a row failed.

    A row that fails is set aside: later steps leave it as it was when it failed, and the others go on. All is one
    projection, so the source is read once whether good rows, bad ones or both are asked for. A later step is only worked
    out for rows without a problem so far.
    """
    now = {c: F.col(c) for c in df.columns}
    problems, sets = [], []
    for i, step in enumerate(steps):
        if step.name not in ROW_STEPS:
            raise KeyError(f"no row step {step.name}")
        known, here = ROW_STEPS[step.name], dict(now)
        reason = known.problem(here.__getitem__, **step.params)
        problems.append(F.when(reason.isNotNull(), F.struct(F.lit(i).alias("at"), F.lit(step.name).alias("step"), reason.alias("reason"))).cast(f"struct<at: int, {ERROR[7:]}"))
        for name, value in known.change(here.__getitem__, **step.params).items():
            now[name] = value
            sets.append((i, name, value))
    failed = "__failed"
    found = _settled(_settled(df).withColumn(failed, F.coalesce(*problems) if problems else F.lit(None).cast(f"struct<at: int, {ERROR[7:]}")))
    out = {c: F.col(c) for c in df.columns}
    for i, name, value in sets:
        out[name] = F.when(F.col(failed).isNull() | (F.col(failed)["at"] > i), value).otherwise(out.get(name, F.lit(None)))
    error = F.when(F.col(failed).isNotNull(), F.struct(F.col(failed)["step"].alias("step"), F.col(failed)["reason"].alias("reason"))).cast(ERROR)
    return found.select(*(value.alias(name) for name, value in out.items()), error.alias("error"))


def _settled(df: DataFrame) -> DataFrame:
    """df with each column worked out once: an array of one row, taken out again. Else what uses a column repeats how it was made."""
    return df.select(F.inline(F.array(F.struct(*(df[c] for c in df.columns)))))


def passed(df: DataFrame) -> DataFrame:
    return df.where("error is null").drop("error")


def set_aside(df: DataFrame) -> DataFrame:
    """The rows that failed, with step and reason."""
    return df.where("error is not null").select(*(c for c in df.columns if c != "error"), "error.*")


def error_counts(df: DataFrame) -> DataFrame:
    """Rows by step and reason; of those that passed both are null."""
    return df.groupBy("error.step", "error.reason").agg(F.count("*").alias("n"))


@row_step("tokens.text", lambda c: {"text": F.trim(c("text"))})
def has_text(c: Of) -> Column:
    return F.when(F.coalesce(F.trim(c("text")), F.lit("")) == "", "no text")


@row_step("tokens.box")
def sound_box(c: Of) -> Column:
    missing = F.greatest(*(c(side).isNull().cast("int") for side in ("x1", "y1", "x2", "y2"))) == 1
    return F.when(missing, "no box").when((c("x1") > c("x2")) | (c("y1") > c("y2")), "box is inside out")


@row_step("tokens.number", lambda c: {"score": c("confidence").try_cast("double")})
def is_number(c: Of) -> Column:
    return F.when(c("confidence").isNull(), "no confidence").when(c("confidence").try_cast("double").isNull(), "confidence is no number")


@row_step("tokens.range")
def in_range(c: Of, least: float = 0.0, most: float = 1.0) -> Column:
    return F.when(~c("score").between(least, most), "confidence out of range")


@row_step("tokens.review", lambda c, least=0.8: {"needs_review": c("score") < least})
def reviewed(c: Of, least: float = 0.8) -> Column:
    return F.lit(None).cast("string")


#: The checks of raw tokens, in the order in which a row is told what is wrong with it.
RAW_TOKENS = (Step("tokens.text"), Step("tokens.box"), Step("tokens.number"), Step("tokens.range"), Step("tokens.review"))


def describe() -> dict[str, dict]:
    """Each processor's parameters, with defaults, and its first line of documentation."""
    out = {}
    for name, f in sorted(REGISTRY.items()):
        params = [p for p in inspect.signature(f).parameters.values()][1:]
        out[name] = {"params": {p.name: None if p.default is p.empty else p.default for p in params}, "doc": (inspect.getdoc(f) or "").split("\n")[0]}
    return out


@processor("pages.limit")
def limit_pages(df: DataFrame, most: int | None = None) -> DataFrame:
    """The first pages of each document only; the filter reaches the scan."""
    return df if most is None else df.where(F.col("page_num") <= most)


@processor("tokens.not_blank")
def not_blank(df: DataFrame) -> DataFrame:
    """Tokens with text."""
    return df.where(F.trim("text") != "")


@processor("tokens.confidence")
def confident(df: DataFrame, least: float = 0.0, strict: bool = False) -> DataFrame:
    """Tokens of at least (strict: more than) a confidence."""
    return df.where(F.col("confidence") > least if strict else F.col("confidence") >= least)


@processor("tokens.merge")
def merge(df: DataFrame) -> DataFrame:
    """The best of equal tokens of several engines (column engine)."""
    from foliant.operators.layout import best_of_engines

    return best_of_engines(df)


@processor("tokens.reading_order")
def order(df: DataFrame) -> DataFrame:
    """Tokens with their rank in reading order."""
    from foliant.operators.layout import reading_order

    return reading_order(df)


@processor("tokens.review")
def review(df: DataFrame, least: float = 0.8) -> DataFrame:
    """Tokens with a flag for review."""
    return df.withColumn("needs_review", F.col("confidence") < least)


PROFILES: dict[str, Sequence[Step]] = {
    "default": (Step("tokens.not_blank"), Step("tokens.reading_order"), Step("tokens.review")),
    "performance": (Step("pages.limit", {"most": 5}), Step("tokens.not_blank"), Step("tokens.review")),
    "quality": (Step("tokens.not_blank"), Step("tokens.confidence", {"least": 0.5}), Step("tokens.reading_order"), Step("tokens.review", {"least": 0.9})),
}
