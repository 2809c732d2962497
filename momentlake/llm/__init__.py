"""Operators for preparing training data: group top-N, vector neighbours, similarity clusters, container packing, test leakage and residue filtering.

Nothing outside this package imports it; removing the folder leaves the rest working.
"""
