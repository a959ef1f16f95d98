"""Errors of the engine."""


class KeyloomError(Exception):
    """Base of all errors raised here."""


def _error(name: str, text: str, base: type = KeyloomError) -> type:
    return type(name, (base,), {"__doc__": text, "__module__": __name__})


NotFound = _error("NotFound", "No row has the key.")
KeyExists = _error("KeyExists", "A row has the key already.")
KeyEmpty = _error("KeyEmpty", "A key is null or empty.")
KeyspaceKindMismatch = _error("KeyspaceKindMismatch", "A plain keyspace was opened as a set, or the other way.")
KeyspaceExists = _error("KeyspaceExists", "The keyspace exists already.")
KeyspaceNotFound = _error("KeyspaceNotFound", "There is no such keyspace.")
ValueSizeMismatch = _error("ValueSizeMismatch", "A member hasn't the fixed size of its set.")
InvalidOptions = _error("InvalidOptions", "Arguments that don't fit together.")
ColumnAbsent = _error("ColumnAbsent", "The projection doesn't carry the column.")
MaterializeLimit = _error("MaterializeLimit", "A query would hold more bytes than its budget.")
EncodeError = _error("EncodeError", "A value has no encoded form.")
ReadOnly = _error("ReadOnly", "A write on a snapshot.")
TxClosed = _error("TxClosed", "The transaction has ended.")
Conflict = _error("Conflict", "Another writer published the version first.")
IndexError_ = _error("IndexError_", "An index can't be used as asked.")
IndexUniqueViolation = _error("IndexUniqueViolation", "Two entries of a unique index have one key.", IndexError_)
IndexNotUnique = _error("IndexNotUnique", "A single row was asked of an index that isn't unique.", IndexError_)
IndexNotFound = _error("IndexNotFound", "There is no such index.", IndexError_)
IndexExists = _error("IndexExists", "The index exists already.", IndexError_)
IndexFingerprintMismatch = _error("IndexFingerprintMismatch", "The stored index was built from another declaration.", IndexError_)
IndexDeclaration = _error("IndexDeclaration", "A declaration that can't be an index.", IndexError_)
BulkLoadOutOfOrder = _error("BulkLoadOutOfOrder", "Keys of a bulk load aren't strictly ascending.")
BulkLoadNonEmpty = _error("BulkLoadNonEmpty", "A bulk load needs an empty keyspace.")
