"""The SQL dialect: tokens, statements, parser."""
