"""What clients of the dialect and the protocol rely on, word for word."""

#: Keywords, in upper case; none can be an identifier.
KEYWORDS = (
    "CREATE", "TABLE", "INSERT", "INTO", "VALUES", "SELECT", "FROM", "WHERE",
    "DELETE", "UPDATE", "SET", "PRIMARY", "KEY", "BEGIN", "COMMIT", "ROLLBACK",
)

#: Column types, in lower case.
TYPES = ("int", "string")

#: Texts of errors.
UNTERMINATED = "unterminated string literal"
EQUALS_AFTER_BANG = "expected '=' after '!'"
UNRECOGNIZED = "unrecognized character '{}'"
POSITION = "{} (at position {})"
EXPECTED = "expected {} but found '{}'"
AN_IDENTIFIER = "an identifier"
A_LITERAL = "a literal value"
A_COMPARISON = "a comparison operator (= != < <= > >=)"
A_STATEMENT = "expected a statement (CREATE/INSERT/SELECT/DELETE/UPDATE/BEGIN/COMMIT/ROLLBACK)"
KEY_NOT_FIRST = "PRIMARY KEY is only supported on the first column"
NO_COLUMN = "no such column: {}"
UNKNOWN_TYPE = "unknown column type '{}' (expected int or string)"
TABLE_EXISTS = "Table already exists: {}"
NO_TABLE = "Database::getTable: no such table: {}"
NOT_IN_CATALOG = "Table not found: {}"
NO_VALUES = "No values provided for insert."
INSERT_COUNT = "Mismatched column count in insert."
UPDATE_COUNT = "Mismatched column count in update."
IN_TRANSACTION = "a transaction is already in progress on this connection"
NO_TRANSACTION = "no transaction is in progress on this connection"
DEADLOCK = "LockManager: txn {} aborted to break a deadlock with txn {}"
LOCK_TIMEOUT = "LockManager: txn {} timed out waiting for a lock"
UNKNOWN_TRANSACTION = "MVCCManager::getSnapshot: txn {} is unknown or already committed/aborted"
NOT_A_NUMBER = "stoll"

#: Lines of replies; values are joined by SEPARATOR.
SEPARATOR = "|"
ERROR_LINE = "ERROR: {}\n"
ROWS_LINE = "OK {} rows\n"
AFFECTED_LINE = "OK {} rows affected\n"
DONE_LINE = "OK\n"

#: The server's port and folder where none are given, and its word for the end.
PORT = 5433
FOLDER = "db_data"
QUIT = "quit"

#: Seconds that a writer waits for a lock; pages that the cache holds.
LOCK_SECONDS = 2.0
CACHE_PAGES = 64
