"""Intermediate tables in the folder that the cluster's machines share."""

from mentionmill.tables import Table, shared_folder

__all__ = ["Table", "shared_folder"]
