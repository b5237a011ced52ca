"""What a Python worker holds between tasks."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Gives memory that isn't used any more back to the machine; workers outlive their tasks, and the next stage's needs
    come on top of what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def released(run):
    """run, a function of batches, with ``release`` at the end of each task."""

    def task(batches):
        yield from run(batches)
        release()

    return task
