"""Registered queries; importing the modules fills the registry in ``queries``."""

from pixelweave.plans import images, queries, records  # noqa: F401
