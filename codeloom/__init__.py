"""codeloom: DataFrame operators for building, auditing and evaluating text and code corpora."""
