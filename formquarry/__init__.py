"""formquarry: a PySpark-native engine for inventories of business-application form dumps."""

import importlib
import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The public names and where they are; they are loaded when first asked for.
_EXPORTS = {
    "scan_forms": "sources.dump", "elem_forms": "sources.dump", "form_bins": "sources.dump", "list_files": "sources.dump", "module_paths": "sources.dump",
    "load_scan_index": "sources.indexes", "save_scan_index": "sources.indexes", "load_freshness": "sources.indexes", "save_freshness": "sources.indexes", "load_drift_report": "sources.indexes",
    "check_drift": "workflows", "form_contexts": "workflows", "report_queries": "workflows", "unpack_forms": "workflows", "unpack_report": "workflows", "update_forms_index": "workflows",
    "parse_forms": "operators.elements", "decode_objects": "operators.objects", "resolve_types": "operators.objects", "resolve_paths": "operators.bindings", "route": "operators.routing", "upsert": "operators.routing",
    "coverage": "operators.coverage", "classify_forms": "operators.classify", "summaries": "operators.summary", "stale_forms": "operators.freshness", "drift": "operators.drift", "composite_key": "functions.keys",
}
__all__ = ["__version__", *_EXPORTS]


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_EXPORTS[name]}"), name)
