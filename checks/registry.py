"""Imports every binding module so that its queries are registered."""

from checks import catalogue, features, images, quality, vectors  # noqa: F401
from checks.base import ORACLES, QUERIES  # noqa: F401
