"""Text front end: lexer, syntax tree and parser of the query language."""
