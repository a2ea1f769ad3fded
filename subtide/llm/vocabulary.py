"""Where the public tokenizer files lie."""

from __future__ import annotations

import importlib.util
import os


def word_bpe_path(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer file: from the ``public_tokenizers`` package, or else /opt/tokenizers."""
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join("/opt/tokenizers", name)
