"""Vocabulary files: found by path, read once on the driver, sent to executors as bytes (a few MB at most)."""

from __future__ import annotations

MOST_BYTES = 16 << 20


def read(path: str | None, default: str) -> bytes:
    """The file at ``path``, or the installed public vocabulary ``default``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(default)
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is over {MOST_BYTES} bytes")
    return data
