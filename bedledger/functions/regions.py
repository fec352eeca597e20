"""State/region look-ups.

The map is a constant of 51 states, so it is compiled into the expression: no join and
no broadcast is needed to place a row in its region.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bedledger.functions.guards import _col
from bedledger.schema import OTHER_REGION, REGION_STATES


def named_region(state: str | Column) -> Column:
    """Region of a state, NULL for a code outside the map."""
    state = _col(state)
    chosen = F
    for region, states in REGION_STATES.items():
        chosen = chosen.when(state.isin(states), F.lit(region))
    return chosen


def get_region_for_state(state: str | Column) -> Column:
    """Region of a state, 'Other' for a code outside the map."""
    return F.coalesce(named_region(state), F.lit(OTHER_REGION))


def regions_frame(spark: SparkSession) -> DataFrame:
    """The four regions in display order, as (region, position)."""
    rows = ", ".join(f"('{region}', {i})" for i, region in enumerate(REGION_STATES))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS regions(region, position)")


def states_in(selection: str | Column) -> Column:
    """Array of the states a selected name stands for; unknown names stand for themselves."""
    selection = _col(selection)
    chosen = F
    for region, states in REGION_STATES.items():
        chosen = chosen.when(selection == region, F.array(*map(F.lit, states)))
    return chosen.otherwise(F.array(selection))


def expand_selection(selections: DataFrame) -> DataFrame:
    """Distinct states for a frame of selected names (first column)."""
    name = F.col(selections.columns[0])
    return selections.select(F.explode(states_in(name)).alias("state")).distinct()


def get_states_for_selection(selections: Iterable[str]) -> list[str]:
    """Distinct states for a list of selected names, to be bound as a query parameter."""
    states: dict[str, None] = {}
    for name in selections:
        states.update(dict.fromkeys(REGION_STATES.get(name, [name])))
    return list(states)
