"""Error codes. Row-wise work puts the code in a column; driver calls raise."""

from __future__ import annotations


class NoteError(Exception):
    """Base error with a machine-readable code."""

    code = "NOTE_ERROR"
    template = "{0}"

    def __init__(self, *args: object) -> None:
        super().__init__(self.template.format(*args))

    @property
    def message(self) -> str:
        return str(self)


def _error(name: str, code: str, template: str) -> type[NoteError]:
    return type(name, (NoteError,), {"code": code, "template": template, "__module__": __name__})


# Codes and message formats that callers match on.
VaultNotFound = _error("VaultNotFound", "VAULT_NOT_FOUND", "Vault not found at path: {0}")
PathTraversal = _error("PathTraversal", "PATH_TRAVERSAL", "Path traversal detected: {0}")
NoteNotFound = _error("NoteNotFound", "NOTE_NOT_FOUND", "Note not found: {0}")
NoteAlreadyExists = _error("NoteAlreadyExists", "NOTE_ALREADY_EXISTS", "Note already exists: {0}")
InvalidNotePath = _error("InvalidNotePath", "INVALID_NOTE_PATH", "Invalid note path: {0}")
PatchFailed = _error("PatchFailed", "AST_PATCH_FAILED", "AST patch failed: {0}")
HeadingNotFound = _error("HeadingNotFound", "HEADING_NOT_FOUND", 'Heading not found: "{0}" at depth {1}')
BlockNotFound = _error("BlockNotFound", "BLOCK_NOT_FOUND", "Block not found: {0}")
FreeformEditFailed = _error("FreeformEditFailed", "FREEFORM_EDIT_FAILED", "Freeform edit failed: {0}")
EmbeddingFailed = _error("EmbeddingFailed", "EMBEDDING_FAILED", "Embedding failed: {0}")
VectorStoreFailed = _error("VectorStoreFailed", "VECTOR_DB_ERROR", "Vector DB error: {0}")
InvalidFrontmatter = _error(
    "InvalidFrontmatter", "INVALID_FRONTMATTER_PAYLOAD", "Invalid frontmatter payload: {0}"
)
BatchLimitExceeded = _error(
    "BatchLimitExceeded",
    "BATCH_LIMIT_EXCEEDED",
    "Batch limit exceeded: {0} operations requested, max {1} allowed",
)
InvalidTransition = _error(
    "InvalidTransition", "INVALID_STATE_TRANSITION", 'Invalid state transition from "{0}" to "{1}"'
)
StartupFailed = _error("StartupFailed", "STARTUP_FAILED", "{0}")
