"""One pipeline, six configurations.

Each lab-test target is a ``TargetSpec`` record; the stage code is shared.
Column names refer to the ``readings`` view (FIXTURES.md): ``result_*`` hold the
raw lab results of the different tests, and each target picks one of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from speclab.functions import scalar as S

RESULT_COLUMNS = ("result_int", "result_dbl", "result_flow", "result_grade", "result_code", "result_foam")

PRODUCT = "Brand#13"          # the one product (SKU) every stage is restricted to
MISSING = -1.0                # what a missing numeric feature is to a model: below every reading

# Column groups of the readings view standing in for the
# reference's drop lists (descriptors and identifiers that are not features).
DROP_SHORT = ("product",)                                        # T1, T4
DROP_LONG = ("product", "order_no", "batch_source", "method")    # T2, T3, T5, T6
KNOWN_CONSTANTS = ("plant", "test_code")                         # T1, T4 second list
SUBSET_NULL_COLUMNS = ("method", "feed_flow", "batch_source", "swirl")


@dataclass(frozen=True)
class TargetSpec:
    name: str
    result_col: str
    tests: tuple[str, ...]
    product: str | None = PRODUCT
    drop_cols: tuple[str, ...] = DROP_LONG
    known_constants: tuple[str, ...] = ()
    null_rule: str = "any"                      # "any" or "subset"
    null_subset: tuple[str, ...] = SUBSET_NULL_COLUMNS
    sentinel: str | None = None                 # '#' rows removed (NULL kept)
    cast: str | None = None                     # strict cast of the result before labelling
    label_kind: str = "in_set"                  # map | in_set | equals | in_range
    label_arg: object = None
    encode_text: bool = False                   # batch source / method codes (T1, T4)
    use_corr: bool = True
    use_chi2: bool = True
    split: str = "70_15_15"                     # or "80_20"
    smote: bool = True
    balance_splits: tuple[str, ...] = ("train", "test")
    max_depth: int | None = None                # depth of the limited tree (H2)
    # missing features after coercion: "impute" fills every split with the medians of the training rows,
    # "keep" leaves the gaps (balancing and training see the value MISSING), "drop" removes such rows from
    # the balanced splits; all are counted. A feature without a training median is MISSING to a model.
    missing: str = "impute"
    extra: dict = field(default_factory=dict)

    def label_expr(self, c: Column) -> Column:
        v = S.cast_strict(c, self.cast) if self.cast else c
        if self.label_kind == "map":
            return S.map_codes(v, self.label_arg)
        if self.label_kind == "in_set":
            return S.label_in_set(v, self.label_arg)
        if self.label_kind == "equals":
            return S.label_equals(v, self.label_arg)
        if self.label_kind == "in_range":
            lo, hi = self.label_arg
            return S.label_in_range(v, lo, hi)
        raise ValueError(self.label_kind)


# Label rules and model depths of the six targets.
T1 = TargetSpec("reconstitution", "result_code", ("A", "N", "R"), drop_cols=DROP_SHORT,
                known_constants=KNOWN_CONSTANTS, null_rule="subset", cast="int", label_kind="map",
                label_arg=S.RECONSTITUTION_LABELS, encode_text=True, use_corr=False, use_chi2=False,
                split="80_20", smote=False)
T2 = TargetSpec("scorched_particles", "result_int", ("N",), sentinel="#", cast="int",
                label_kind="in_set", label_arg=(0, 1, 2, 3), max_depth=20)
T3 = TargetSpec("foam_height", "result_foam", ("R",), cast="int", label_kind="in_set",
                label_arg=(10, 20), use_chi2=False, max_depth=15)
T4 = TargetSpec("scorched_particles_bs_1743", "result_grade", ("A",), drop_cols=DROP_SHORT,
                known_constants=KNOWN_CONSTANTS, null_rule="subset", sentinel="#", label_kind="equals",
                label_arg="A", encode_text=True, use_corr=False, use_chi2=False, split="80_20", smote=False)
T5 = TargetSpec("bulk_density", "result_dbl", ("N",), cast="double", label_kind="in_range",
                label_arg=(0.49, 0.51), max_depth=25)
T6 = TargetSpec("flecks", "result_grade", ("R",), label_kind="in_set", label_arg=("A+", "A-"), max_depth=15)

TARGETS = {"t1": T1, "t2": T2, "t3": T3, "t4": T4, "t5": T5, "t6": T6}
