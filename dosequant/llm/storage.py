"""Intermediate tables in the folder that driver and executors share."""

from dosequant.sources.shared import shared_folder, written

__all__ = ["shared_folder", "written"]
