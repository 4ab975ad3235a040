"""The library's queries, by subject."""

from siftstone.plans import aggregates, catalogue, fingerprints, operations, scalars, snapshots, streams, vectors  # noqa: F401
