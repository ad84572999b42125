"""scour: Spark-native profiling, cleaning and ML preparation of tables.

Every operator is a pair: a ``fit_*`` function that runs a small aggregate
job and returns plain Python parameters, and an ``apply_*`` function that
turns those parameters into a lazy projection/filter made of built-in
Spark expressions.  One-shot helpers call both.
"""

__version__ = "0.1.0"

from scour.operators.profile import dataset_summary, profile, quality_metrics  # noqa: E402
from scour.operators.splits import kfold, percent_split, stratified_split, train_test_split  # noqa: E402
from scour.operators.steps import Step, apply_steps  # noqa: E402
from scour.plans.auto import auto_clean, auto_layers, prepare, run_mode  # noqa: E402
from scour.plans.recipe import Recipe  # noqa: E402
from scour.sources.io import read_table, write_splits, write_table  # noqa: E402

__all__ = ["profile", "quality_metrics", "dataset_summary", "train_test_split", "percent_split", "kfold",
           "stratified_split", "Step", "apply_steps", "auto_layers", "prepare", "auto_clean", "run_mode",
           "Recipe", "read_table", "write_table", "write_splits"]
