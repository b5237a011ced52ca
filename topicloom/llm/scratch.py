"""Written intermediate tables: see ``topicloom.sources.staging``."""

from topicloom.sources.staging import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
