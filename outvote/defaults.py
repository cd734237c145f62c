"""Default names and parameters."""

from numpy import geomspace

# The published setup of the method.
MODELS = ("cnn", "gnn", "fcd", "fcfp", "cb")
VALUE = "values"
SEED = 42
DATA_OFFSET = 1.5
DATA_OFFSETS = (0.0, 1.5, 10.0)
THRESHOLD = 5.0
THRESHOLDS = tuple(float(t) for t in geomspace(0.1, 100, 15))
TOL = 1e-8

ENTRY_ID = "entry_id"
REF_VALUE = "ref_values"
DATASET_KEYS = ("var_add", "modified_pct")
