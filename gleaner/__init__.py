"""gleaner: a Spark-native engine that audits image collections and tabular corpora."""

import importlib

__version__ = "0.1.0"

_EXPORTS = {
    "audit_images": "gleaner.plans.audit",
    "analyze_labels": "gleaner.plans.audit",
    "run_audit": "gleaner.plans.audit",
    "health_score": "gleaner.plans.audit",
    "render_markdown": "gleaner.plans.report",
    "render_json": "gleaner.plans.report",
    "synth_dataset": "gleaner.sources.synthetic",
}
__all__ = ["__version__", *_EXPORTS]


def __getattr__(name: str):
    """Exports load when asked for, so that workers import the kernels they need alone."""
    if name in _EXPORTS:
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(name)
