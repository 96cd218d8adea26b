"""All registered queries and the flagship plan."""

import importlib

from pyspark.sql import functions as F

MODULES = ("ingest", "quality", "partitions", "featurize", "modelling", "serving")


def all_queries():
    found = {}
    for name in MODULES:
        found.update(importlib.import_module(f"ionforge.plans.{name}").QUERIES)
    return found


def flagship(spark, sf_dir):
    """Parse, validate and quarantine all reactions; eligible label profile per working ion."""
    from ionforge.operators.intervals import label_profile
    from ionforge.operators.validate import validate
    from ionforge.plans.fixtures import raw
    rows = validate(raw(spark, sf_dir)).where(F.col("eligible_for_baseline"))
    return label_profile(rows, ["working_ion"], "label", "composition_checks_passed", "symmetry_checks_passed")
