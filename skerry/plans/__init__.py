"""The engine's queries; importing this registers them all."""

from . import analytics, answers, clusters, documents, filters, gallery, graphs, joins, library, recipes, retrieval, scans, stories, streams, texts, timelines, vectors, whens, windows  # noqa: F401
