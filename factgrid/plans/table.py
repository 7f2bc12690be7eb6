"""The deterministic core from raw cells to final tables: merge, audit, fill, drop, score, resolve."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.operators import audit, gapfill, merge
from factgrid.plans.materialize import cut


@dataclass
class FinalTables:
    """rows: run_id, ent_ord, name, confidence, position. fields: run_id, ord, field, kept. cells: scored cells of them."""

    rows: DataFrame
    fields: DataFrame
    cells: DataFrame

    def long(self) -> DataFrame:
        """One row for each shown cell."""
        kept = self.fields.filter("kept").select("run_id", "field")
        return self.rows.join(self.cells.withColumnRenamed("confidence", "cell_confidence"), ["run_id", "ent_ord"]).join(kept, ["run_id", "field"], "left_semi")


#: (entities, cells, kept fields) to offers for the holes: see gapfill.apply_filled.
Filler = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def final_tables(cells: DataFrame, plan: DataFrame, filled: DataFrame | Filler | None = None) -> FinalTables:
    """Final tables of all runs at once; filled: offers for holes, or what finds them for the columns that the audit keeps. The order of the steps matters: columns are judged before holes
    are filled, rows without a value go after that, and row confidence counts columns that the last step drops."""
    # What several later steps read is cut, or each of them would plan and run all that stands before it again.
    entities, merged = map(cut, merge.merge_entities(cut(cells), plan))
    kept = cut(audit.audit_columns(entities, merged, plan.filter(F.lower("field") != "name")).filter("kept").select("run_id", "ord", "field"))
    if filled is not None:
        offers = filled if isinstance(filled, DataFrame) else filled(entities, merged, kept)
        merged = cut(gapfill.apply_filled(entities, merged, kept, offers).drop("was_filled"))
    populated = audit.drop_empty(entities, merged, kept)
    populated = cut(populated)
    own = cut(merged.join(populated.select("run_id", "ent_ord"), ["run_id", "ent_ord"], "left_semi"))
    scored = cut(audit.score_cells(own, kept))
    rows, fields = audit.finalize(cut(audit.score_rows(populated, scored, kept)), own, kept)
    return FinalTables(rows, fields, scored)
