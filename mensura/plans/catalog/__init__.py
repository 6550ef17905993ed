"""One module per operator family; importing this package fills the registry."""

from . import (  # noqa: F401
    aggregates,
    checks,
    cleaning,
    contrasts,
    deltas,
    features,
    flows,
    joins,
    metrics,
    models,
    ordering,
    rules,
    sources,
    splits,
)
