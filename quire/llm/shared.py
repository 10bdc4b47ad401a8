"""What the operators use of the library's storage."""

from quire.storage import cut, shared_folder

__all__ = ["cut", "shared_folder"]
