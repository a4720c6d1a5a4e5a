"""Labelled code corpora on Spark: extract, pair, split, enlarge, train, score and report."""
