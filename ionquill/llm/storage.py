"""Intermediate tables in the folder that the whole cluster shares."""

from ionquill.storage import discard, new_path, shared_dir, stored

__all__ = ["discard", "new_path", "shared_dir", "stored"]
