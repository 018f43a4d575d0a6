"""From query text to DataFrames: lexer, parser, syntax tree, dialects and compiler."""
