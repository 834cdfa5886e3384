"""Query text to Spark plans: lexer, parser, expression compiler."""
