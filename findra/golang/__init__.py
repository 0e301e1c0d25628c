"""Go source as tables: lexer, parser, node table, checks."""
