"""The query language: tokens, syntax tree, parser, validator, unparser, builder, and the compiler to DataFrames."""
