"""Varloom: DataFrame operators for expression, genotype and allele-count tables."""
