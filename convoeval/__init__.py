"""DataFrame operators for building, judging and comparing tables of support conversations."""

__version__ = "0.1.0"
