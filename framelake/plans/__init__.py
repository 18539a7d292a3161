"""Registered queries; importing this package fills the registry."""
import importlib

# Query modules, in the order of the inventory's sections.
MODULES = ["voting", "features", "posequeries", "boxqueries", "sweepqueries", "evidencequeries", "samplequeries", "sourcequeries", "streamqueries"]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
