"""Stratum: corpora as stand-off layers, held in DataFrames."""
