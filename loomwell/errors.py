"""Kinds of errors: each keeps its Python base, so that callers may catch either."""

from __future__ import annotations

# The message of each kind.
MESSAGES = {
    "FileRead": "Failed to read file {path}: {source}",
    "FileWrite": "Failed to write file {path}: {source}",
    "Io": "IO Error: {source}",
    "FileNotFound": "File not found: {path}",
    "DataCorrupt": "Dataset corrupt at byte offset {offset}: {reason}",
    "MmapError": "Mmap failed for {path}: {source}",
    "DatasetEmpty": "Dataset empty: {path}",
    "ShapeMismatch": "Shape mismatch: expected {expected}, got {got}",
    "CheckpointLoad": "Checkpoint load failed: {reason}",
    "CudaError": "CUDA kernel `{kernel}` failed: {reason}",
    "CudaUnavailable": "CUDA unavailable — compile with --features cuda",
    "TokenizerError": "Tokenizer error: {reason}",
    "TokenizerLoad": "Tokenizer load failed: {reason}",
    "UnknownToken": "Unknown token ID: {id}",
    "ConfigError": "Invalid config: {reason}",
}
# Kinds without an entry are RuntimeErrors.
_BASES = {
    "FileRead": OSError, "FileWrite": OSError, "Io": OSError, "FileNotFound": FileNotFoundError, "MmapError": OSError, "DataCorrupt": ValueError,
    "DatasetEmpty": ValueError, "ShapeMismatch": ValueError, "TokenizerError": ValueError, "TokenizerLoad": ValueError, "UnknownToken": KeyError, "ConfigError": ValueError,
}


class LoomwellError(Exception):
    """Base of all kinds."""

    template = "{reason}"

    def __init__(self, **fields):
        self.fields = fields
        super().__init__(self.template.format(**fields))

    def __str__(self) -> str:
        return self.template.format(**self.fields)

    def __reduce__(self):
        return _again, (type(self).__name__, self.fields)


def _again(kind: str, fields: dict) -> LoomwellError:
    return KINDS[kind](**fields)


KINDS: dict[str, type] = {name: type(name, (LoomwellError, _BASES.get(name, RuntimeError)), {"template": text, "__module__": __name__}) for name, text in MESSAGES.items()}
globals().update(KINDS)
