"""Spark operators over position reports: extracts, accountability and evidence checks."""

from posevidence.params import Box, ExportParams

__all__ = ["Box", "ExportParams"]
