"""Named queries over the driver tables, each next to its SQL twin."""

import importlib

MODULES = ["scalars", "recognition", "sections", "rule_checks", "wow_checks", "guard_checks",
           "catalog_check_queries", "output_checks", "failures", "ingest_checks"]


def load_all():
    from weekloom.checks import registry
    for module in MODULES:
        importlib.import_module(f"weekloom.checks.{module}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
