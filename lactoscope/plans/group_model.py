"""Group model: one curve per herd and lactation group, scaled to each lactation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lactoscope.functions.expressions import error_sigma, group_name
from lactoscope.operators.fit import accepted_points, fit_points, with_herd_level
from lactoscope.operators.score import curves_on_grid, individual_scale, yields
from lactoscope.operators.selection import qualifying_records
from lactoscope.settings import RunParameters, Settings
from lactoscope.sources.tables import cut_lineage, write_result


@dataclass(frozen=True)
class GroupModel:
    """Lazy results of one run."""

    inputs: DataFrame
    parameters: DataFrame
    curves: DataFrame
    lactations: DataFrame
    yields: DataFrame

    def write(self, folder: str) -> None:
        """Store every result; yields and scales partition nothing by themselves."""
        for name in ("parameters", "curves", "lactations", "yields"):
            write_result(getattr(self, name), f"{folder}/{name}")


def group_parameters(inputs: DataFrame, settings: Settings = Settings(), by: Sequence[str] = ()) -> DataFrame:
    """Fitted curve of each lactation group and of the herd (group 0)."""
    points = group_points(inputs, settings, by)
    return fit_points(points, [*by, "LAGR"], settings.fit).withColumn("grp", group_name("LAGR"))


def group_points(inputs: DataFrame, settings: Settings = Settings(), by: Sequence[str] = ()) -> DataFrame:
    """Day points of accepted lactations per group, and over all groups as group 0."""
    rows = inputs.withColumn("SIGMA", error_sigma())
    return with_herd_level(accepted_points(rows, "LAGR", settings, by), by)


def group_model(
    events: DataFrame,
    herds: DataFrame,
    run: RunParameters,
    settings: Settings = Settings(),
    by: Sequence[str] = (),
    store_stages: bool = True,
) -> GroupModel:
    """The whole model for one herd, or for all herds due when ``by`` names the herd keys.

    ``store_stages`` writes the inputs and the parameters to the shared folder, so
    that the results that use them do not compute them again.
    """
    inputs = qualifying_records(events, herds, run, settings)
    if store_stages:
        inputs = cut_lineage(inputs)
    parameters = group_parameters(inputs, settings, by)
    if store_stages:
        parameters = cut_lineage(parameters)
    lactations = individual_scale(inputs, parameters, settings, by=by)
    keys = [*by, "LAGR", *settings.lactation_keys]
    return GroupModel(
        inputs=inputs,
        parameters=parameters,
        curves=curves_on_grid(parameters, [*by, "LAGR", "grp"]),
        lactations=lactations,
        yields=yields(lactations, ["grp", *keys]),
    )
