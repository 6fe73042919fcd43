"""Operators for preparing language-model training data.  Nothing else in the library imports this package.

Every operator takes and returns DataFrames.  Intermediate tables go to the folder the session names in
``spark.checkpoint.dir`` and are removed when the session ends."""
