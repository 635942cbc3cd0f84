"""From failures to the review store: read the failure set, match, fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from qaloom.operators import decisions
from qaloom.plans import state
from qaloom.sources.failures import read_failures


def apply_failures(
    failures: DataFrame, tables: state.Tables, actor: Column, as_of: Column, order: str = "position"
) -> tuple[state.Tables, dict[str, DataFrame]]:
    """(tables after the failures, change sets with a ``summary``).

    Of repeated items the last in ``order`` counts.
    """
    changes = decisions.bulk_fail(
        read_failures(failures), tables["questions"], tables["reviews"], actor, as_of, order
    )
    changes["summary"] = decisions.bulk_fail_summary(changes)
    return state.after_bulk_fail(tables, changes), changes
