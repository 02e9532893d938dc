"""All registered queries; importing the package fills the registry."""

from tabkit.plans.catalogue import (  # noqa: F401
    bands,
    cleaning,
    clusters,
    errors,
    features,
    fits,
    profiles,
    sources,
    splits,
)
