"""Population growth metrics and scenario what-ifs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.functions.numbers import safe_rate, to_number
from growthlens.operators.common import q, qs

# Default input column of each quantity.
INPUTS = {
    "prs": "Total PRs",
    "trs": "Total TRs",
    "births": "Total Births",
    "deaths": "Total Deaths",
    "estimate": "Population Estimate",
}


def growth_metrics(df: DataFrame, variant: str = "pipeline", *, inputs: Mapping[str, str] = INPUTS) -> DataFrame:
    """Add migration, natural increase, net change and their rates. Input columns that do not exist count as 0.

    pipeline:   migration = PRs - TRs; rates per 1000, growth in percent; a rate that does not exist is 0
    notebook:   like pipeline, but a component is 0 unless both of its inputs are non-zero
    documented: migration = PRs + TRs, everything in percent, 0 when an input is 0, plus shares of the growth
    """
    absent = {c: F.lit(0.0) for c in inputs.values() if c not in df.columns}
    present = {c: to_number(c) for c in inputs.values() if c in df.columns}
    df = df.withColumns({**absent, **present})
    add = {"pipeline": _pipeline, "notebook": _notebook, "documented": _documented}
    if variant not in add:
        raise ValueError(f"unknown variant {variant!r}")
    return add[variant](df, {k: q(v) for k, v in inputs.items()})


def _pipeline(df: DataFrame, i: Mapping[str, Column]) -> DataFrame:
    df = df.withColumns({"Net Migration": i["prs"] - i["trs"], "Natural Increase": i["births"] - i["deaths"]})
    df = df.withColumn("Net Population Change", q("Net Migration") + q("Natural Increase"))
    return df.withColumns(
        {
            "Net Migration Rate": safe_rate("Net Migration", i["estimate"], 1000),
            "Natural Growth Rate": safe_rate("Natural Increase", i["estimate"], 1000),
            "Population Growth Rate (%)": safe_rate("Net Population Change", i["estimate"], 100),
        }
    )


def _unless_zero(a: Column, b: Column, value: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(value)


def _notebook(df: DataFrame, i: Mapping[str, Column]) -> DataFrame:
    est = i["estimate"]
    df = df.withColumns(
        {
            "Net Migration": _unless_zero(i["prs"], i["trs"], i["prs"] - i["trs"]),
            "Natural Increase": _unless_zero(i["births"], i["deaths"], i["births"] - i["deaths"]),
        }
    )
    change = F.when(est == 0, F.lit(0.0)).otherwise(q("Net Migration") + q("Natural Increase"))
    df = df.withColumn("Net Population Change", change)

    def rate(name: str, per: float) -> Column:
        return F.when((est == 0) | (q(name) == 0), F.lit(0.0)).otherwise(F.try_divide(q(name), est) * per)

    return df.withColumns(
        {
            "Net Migration Rate": rate("Net Migration", 1000),
            "Natural Growth Rate": rate("Natural Increase", 1000),
            "Population Growth Rate (%)": rate("Net Population Change", 100),
        }
    )


def _documented(df: DataFrame, i: Mapping[str, Column]) -> DataFrame:
    df = df.withColumns(
        {
            "Net Migration": _unless_zero(i["prs"], i["trs"], i["prs"] + i["trs"]),
            "Natural Increase": _unless_zero(i["births"], i["deaths"], i["births"] - i["deaths"]),
        }
    )
    mig, nat = q("Net Migration"), q("Natural Increase")
    df = df.withColumn("Net Population Change", _unless_zero(mig, nat, mig + nat))
    change = q("Net Population Change")
    return df.withColumns(
        {
            "Net Migration Rate": safe_rate(mig, i["estimate"], 100),
            "Natural Growth Rate": safe_rate(nat, i["estimate"], 100),
            "Population Growth Rate (%)": safe_rate(change, i["estimate"], 100),
            "Net Migration %": safe_rate(mig, mig + nat, 100),
            "Natural Increase %": safe_rate(nat, mig + nat, 100),
            "Net Population Change %": safe_rate(change, mig + nat, 100),
        }
    )


def what_if(
    df: DataFrame,
    scenarios: Sequence[tuple[str, float, float]],
    variant: str = "pipeline",
    *,
    inputs: Mapping[str, str] = INPUTS,
) -> DataFrame:
    """Growth metrics with permanent and temporary inflows scaled: scenarios are (name, PR factor, TR factor).

    Scenarios are generated next to each row, so the rows are read once and nothing is joined or shuffled.
    """
    table = F.array(
        *[
            F.struct(F.lit(n).alias("scenario"), F.lit(float(p)).alias("pr"), F.lit(float(t)).alias("tr"))
            for n, p, t in scenarios
        ]
    )
    rows = df.select(*qs(df.columns), F.explode(table).alias("__s"))
    rows = rows.withColumns(
        {
            "scenario": q("__s")["scenario"],
            inputs["prs"]: to_number(inputs["prs"]) * q("__s")["pr"],
            inputs["trs"]: to_number(inputs["trs"]) * q("__s")["tr"],
        }
    )
    return growth_metrics(rows.drop("__s"), variant, inputs=inputs)
