"""Where the public tokenizers' files are."""

from __future__ import annotations

import importlib.util
import os


def tokenizer_path(name: str) -> str:
    """A vocabulary file by name, as ``public_tokenizers.path`` gives it."""
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is not None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join("/opt/tokenizers", name)
