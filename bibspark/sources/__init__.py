"""Readers and writers."""
from .tables import *  # noqa: F401,F403
