"""Parts of expressions: similarity formulas and type vocabularies, all as Spark columns."""
